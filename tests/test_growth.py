"""What the driver, one task or one group holds doesn't grow with the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gesso import session
from gesso.operators import fits, mesh, relief, texture
from gesso.operators.scans import least_squares


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shadowed(spark, rng, pixels=40, lamps=5):
    rows = []
    for p in range(pixels):
        for k in range(lamps):
            for _ in range(int(rng.integers(0, 3))):
                rows.append((p, k + 1, float(rng.random() * (0.04 if rng.random() < 0.2 else 1.0))))
    lights = [(k + 1, *map(float, v / np.linalg.norm(v))) for k, v in enumerate(rng.normal(size=(lamps, 3)) * 0.4 + [0, 0, 1])]
    return spark.createDataFrame(rows, "pixel int, light_id int, intensity double"), spark.createDataFrame(lights, "light_id int, lx double, ly double, lz double")


def one_plain_round(obs, lights):
    s = relief.photometric_stereo(obs, lights, ["pixel"])
    b = s.select("pixel", *[(F.col("rho") * F.col(n)).alias(f"b{i}") for i, n in enumerate(("nx", "ny", "nz"))])
    fit = least_squares(obs.join(b.where("b0 IS NOT NULL"), "pixel"), ["light_id"], [F.col(f"b{i}") for i in range(3)], [F.col("intensity")])
    return {r["light_id"]: np.array(r["coef"]) / np.linalg.norm(r["coef"]) for r in fit.collect()}


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_light_products_are_a_packed_row_a_pattern(spark, rng, monkeypatch, most):
    obs, lights = shadowed(spark, rng)
    numbered = spark.createDataFrame([(k + 1, k) for k in range(5)], "light_id int, i int")
    pixels = fits._by_light(obs, numbered, ["pixel"])
    monkeypatch.setattr(fits, "HELD", 100)  # tasks give partial sums
    products = fits._light_products(pixels, 5)
    patterns = pixels.select("i", "c", "n").distinct().count()
    assert patterns <= products.count() <= pixels.count() and products.select("pattern").distinct().count() == patterns
    monkeypatch.setattr(fits, "PRODUCTS", most)
    got = {r[0]: np.array(r[1:]) for r in fits.refine_lights(obs, lights, ["pixel"], 1).collect()}
    for light, want in one_plain_round(obs, lights).items():
        assert got[light] == pytest.approx(want, abs=1e-9)


def test_panorama_pixels_are_spread_and_not_broadcast(spark):
    from gesso.functions import geometry as g
    from gesso.plans import mosaic as mo

    px = spark.range(0, 40 * 40).selectExpr("0 as image_id", "cast(id div 40 as int) as y", "cast(id % 40 as int) as x", "id * 0.5D as v")
    h = spark.range(1).select(F.lit(0).alias("image_id"), g.lit_matrix([1.0, 0.0, 3.0, 0.0, 1.0, 2.0, 0.0, 0.0, 1.0]).alias("h"))
    out = mo.warp_to_panorama(px, h, ["v"], 8, 8)
    joins = [x for x in plan_of(out).splitlines() if "Join" in x and "_by" in x]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    assert "REPARTITION_BY_NUM" in plan_of(out)
    assert out.count() == 1600


def test_best_face_of_a_pixel_is_found_before_the_shuffle(spark, rng):
    from gesso.operators import mesh, texture

    rows = [(i % 2, i, *map(float, rng.random(6) * 20), [float(v) for v in rng.random(3)]) for i in range(300)]
    rows += [(0, 300, 3.0, 3.0, 5.0, 5.0, 7.0, 7.0, [1.0, 1.0, 1.0]), (0, 301, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0, None), (1, 302, None, 1.0, 2.0, 3.0, 4.0, 5.0, [1.0, 1.0, 1.0]), (1, 303, *rows[1][2:])]
    t = spark.createDataFrame(rows, "patch int, f long, ax double, ay double, bx double, by double, cx double, cy double, c0 array<double>")
    px = spark.range(0, 2 * 30 * 30).selectExpr("cast(id div 900 as int) as patch", "cast(id % 900 div 30 as int) as y", "cast(id % 30 as int) as x", "0.5D as c0")
    cov = mesh.rasterise(t.withColumnRenamed("c0", "adj"), ["patch", "f"], 64, 1.41)
    value = sum((F.col("adj")[k] * F.col(w) for k, w in enumerate(("wa", "wb", "wc"))), F.lit(0.0))
    key = F.struct(F.col("inner").alias("i"), F.least("wa", "wb", "wc").alias("d"), (-F.col("f")).alias("f"))
    want = px.join(cov.groupBy("patch", "y", "x").agg(F.max_by(value, key).alias("v")), ["patch", "y", "x"], "left")
    want = {(r["patch"], r["y"], r["x"]): r["c0"] + (r["v"] or 0.0) for r in want.collect()}
    got = texture.apply_adjustment(t, px, ["c0"], step=8)
    assert {(r["patch"], r["y"], r["x"]): r["c0"] for r in got.collect()} == pytest.approx(want, abs=1e-12)
    plan = plan_of(got)
    assert "MapInPandas" in plan and "Generate explode(sequence(_x0" not in plan


def test_nearest_rows_are_those_of_all_pairs(rng):
    from gesso.operators import matching

    c = rng.integers(0, 3, (500, 6)).astype(float)  # many ties
    far = rng.normal(size=(70, 6)) * 1e-9 + 1e4
    for q, of in ((c[:90], c), (c[:5], far), (far, far), (c[:9], c[:1]), (np.where(c[:50] == 2, np.nan, c[:50]), c)):
        k = min(2, len(of))
        d = np.sqrt(((q[:, None, :] - of[None]) ** 2).sum(axis=2))
        want = np.argsort(d, axis=1, kind="stable")[:, :k]
        at, dist = matching._nearest_rows(q, of, k)
        assert (at == want).all() and np.array_equal(dist, np.take_along_axis(d, want, axis=1), equal_nan=True)


def test_crowded_cells_have_few_blocks(spark, monkeypatch):
    from gesso.operators import matching

    kp = spark.range(0, 1200).selectExpr("0 as row", "cast(id % 2 as int) as col", "id as kp", "cast(id % 97 as double) as x", "cast(id % 89 as double) as y", "array(cast(id % 31 as float), cast(id % 7 as float)) as desc")
    calls, real = spark.sparkContext.accumulator(0), matching._nearest_rows

    def counted(*a):
        calls.add(1)
        return real(*a)

    monkeypatch.setattr(matching, "_nearest_rows", counted)
    n = matching.two_nearest(kp, 97, 89, block=8).count()
    assert n > 1000 and 0 < calls.value <= 2 * matching.PARTS**2


def test_only_outer_boxes_are_candidates(spark, rng, monkeypatch):
    from gesso.operators import mesh

    rows = [(int(v), i, int(x), int(y), int(x + w), int(y + h)) for i, (v, x, y, w, h) in enumerate(rng.integers(0, [2, 30, 30, 12, 12], (600, 5)))]
    rows += [rows[3], (rows[5][0], 5, 0, 0, 45, 45), (0, 900, 20, 20, 10, 10), (0, 901, None, 0, 5, 5), (0, None, 0, 0, 50, 50)]  # twice, a patch with two boxes, an inverted one
    b = spark.createDataFrame(rows, "view int, patch int, x0 int, y0 int, x1 int, y1 int")
    area = lambda o: (o[4] - o[2]) * (o[5] - o[3])
    whole = [r for r in set(rows) if None not in r]
    want = {}
    for s in whole:
        over = [o for o in whole if o[0] == s[0] and o[1] != s[1] and o[2] <= s[2] and o[3] <= s[3] and o[4] >= s[4] and o[5] >= s[5] and (area(o) > area(s) or o[1] < s[1])]
        if over:
            best = max(over, key=lambda o: (area(o), -o[1]))
            want[s[:4]] = best[1]
    for most in (2048, 5):
        monkeypatch.setattr(mesh, "_LARGEST", most)
        monkeypatch.setattr(mesh, "_BOXES", 200)
        got = mesh.contained_patches(b).join(b.select("view", "patch", "x0", "y0").distinct(), ["view", "patch"])
        got = {(r["view"], r["patch"], r["x0"], r["y0"]): r["into"] for r in got.where("dx >= 0 AND dy >= 0").collect()}
        torn = rows[5][:2]
        assert {k: v for k, v in got.items() if k[:2] != torn} == {k: v for k, v in want.items() if k[:2] != torn}
    monkeypatch.undo()
    assert mesh._outer_boxes(b).count() < 300


def test_copies_of_a_box_are_one_candidate(spark):
    from gesso.operators import mesh

    b = spark.range(0, 12000).selectExpr("0 as view", "cast(id as int) as patch", "cast(id % 6 * 100 as int) as x0", "0 as y0", "cast(id % 6 * 100 + 9 as int) as x1", "cast(id % 6 + 3 as int) as y1")
    assert mesh._outer_boxes(b).count() <= 12


def test_faces_get_more_tasks_not_bigger_ones(spark, monkeypatch):
    faces = spark.createDataFrame([(0, i, i, i + 1, i + 2) for i in range(500)], "mesh_id int, f int, v1 int, v2 int, v3 int")
    vertices = spark.createDataFrame([(0, i, float(i), 2.0 * i, 3.0 * i) for i in range(502)], "mesh_id int, v int, x double, y double, z double")
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    out = mesh.faces_with_vertices(faces, vertices)
    assert out.rdd.getNumPartitions() == 15  # 1,500 corners
    rows = {r["f"]: r for r in out.collect()}
    assert len(rows) == 500 and all((r["v1"], r["v3"], r["x2"], r["z3"]) == (f, f + 2, f + 1.0, 3.0 * (f + 2)) for f, r in rows.items())


def test_face_quality_sends_tiles_that_faces_meet(spark, rng, monkeypatch):
    px = [(v, y, x, float(rng.random()), 1.0 * y, 1.0 * x, float(rng.random())) for v in (0, 1) for y in range(40) for x in range(40)]
    px += px[:50] + [(0, None, 3, 1.0, 1.0, 1.0, 1.0)]  # repeated pixels count twice
    faces = [(0, i, *map(float, rng.uniform(2, 14, 6))) for i in range(30)] + [(1, 30, 0.0, 0.0, 30.0, 0.0, 0.0, 30.0), (0, 31, 1.0, 1.0, 1.0, 1.0, 5.0, 5.0)]
    sent, real = [], texture.lookup

    def counted(lists):
        sent.extend((r["view"], r["_ty"], r["_tx"], len(r["_px"])) for r in lists.collect())
        return real(lists)

    monkeypatch.setattr(texture, "lookup", counted)
    t = spark.createDataFrame(faces, "view int, f int, ax double, ay double, bx double, by double, cx double, cy double")
    pixels = spark.createDataFrame(px, "view int, y int, x int, grad double, c0 double, c1 double, c2 double")
    got = {r["f"]: r for r in texture.face_quality(t, pixels, step=8).collect()}
    assert len(got) == len(faces)
    for v, f, ax, ay, bx, by, cx, cy in faces:
        whole = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
        if abs(whole) / 2 <= 0.5:
            assert got[f]["quality"] == 0 and got[f]["samples"] == 0 and got[f]["c0"] is None
            continue
        wa = lambda x, y: ((bx - x) * (cy - y) - (cx - x) * (by - y)) / whole
        wb = lambda x, y: ((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) / whole
        hit = [p for p in px if p[0] == v and p[1] is not None and min(wa(p[2], p[1]), wb(p[2], p[1]), 1 - wa(p[2], p[1]) - wb(p[2], p[1])) >= 0]
        assert got[f]["samples"] == len(hit)
        assert got[f]["quality"] == pytest.approx(sum(p[3] for p in hit))
        if hit:
            assert got[f]["c1"] == pytest.approx(np.mean([p[5] for p in hit]))
    assert {s[:3] for s in sent if s[0] == 0} <= {(0, y, x) for y in range(2) for x in range(2)}  # not all 25 tiles of the view
    assert max(s[3] for s in sent) <= 64 + 50
