import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gesso.functions import color as c
from gesso.functions import geometry as g

# published CIEDE2000 pairs (Sharma, Wu, Dalal 2005)
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
    (50.0, 2.8361, -74.0200, 50.0, 0.0, -82.7485, 3.4412),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
]


def cols(*names):
    return tuple(F.col(n) for n in names)


def test_ciede2000_published_pairs(spark):
    df = spark.createDataFrame(PAIRS, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    out = c.add_ciede2000(df, cols("l1", "a1", "b1"), cols("l2", "a2", "b2")).collect()
    for r in out:
        assert r["de00"] == pytest.approx(r["want"], abs=1e-4)


def test_colour_round_trips(spark, rng):
    rows = [tuple(map(float, v)) for v in rng.uniform(0.02, 0.95, (50, 3))]
    df = spark.createDataFrame(rows, "c0 double, c1 double, c2 double")
    rgb = cols("c0", "c1", "c2")
    there = df.select("*", *[c.linear_to_srgb(c.srgb_to_linear(v)).alias(f"s{i}") for i, v in enumerate(rgb)],
                      *[v.alias(f"l{i}") for i, v in enumerate(c.lab_to_rgb(c.rgb_to_lab(rgb)))])
    xyz = c.apply_matrix(c.SRGB_LINEAR_MATRIX, rgb)
    there = there.withColumns({f"z{i}": v for i, v in enumerate(xyz)})
    there = c.add_xyz_from_hsv(c.add_hsv_of_xyz(there, cols("z0", "z1", "z2"), "_"), cols("_h", "_s", "_v"), ("y0", "y1", "y2"))
    for r in there.collect():
        for i in range(3):
            assert r[f"s{i}"] == pytest.approx(r[f"c{i}"], abs=1e-6)
            assert r[f"l{i}"] == pytest.approx(r[f"c{i}"], abs=1e-5)
            assert r[f"y{i}"] == pytest.approx(r[f"z{i}"], abs=2e-3)


def test_white_balance_maps_white_to_white(spark):
    src, dst = (0.9, 1.0, 0.8), (0.95, 1.0, 1.09)
    df = spark.createDataFrame([src], "c0 double, c1 double, c2 double")
    for cat in c.CAT_MATRICES:
        got = df.select(*c.white_balance(cols("c0", "c1", "c2"), src, dst, cat)).first()
        assert np.allclose(list(got), dst, atol=1e-9)


def test_patch_names(spark):
    df = spark.range(-1, 26).select(c.patch_name(F.col("id")).alias("n"))
    names = [r["n"] for r in df.collect()]
    assert names[0] == names[-1] == "Invalid index" and names[1] == "Dark Skin" and names[24] == "Black"


def walk_spiral(rows, cols_):
    r, cc = (rows - 1) // 2, (cols_ - 1) // 2
    order, step, done = [(r, cc)], 1, {(r, cc)}
    while len(order) < rows * cols_:
        for d, (dr, dc) in enumerate(((0, 1), (1, 0), (0, -1), (-1, 0))):
            for _ in range(step):
                r, cc = r + dr, cc + dc
                if 0 <= r < rows and 0 <= cc < cols_ and (r, cc) not in done:
                    done.add((r, cc))
                    order.append((r, cc))
            if d % 2 == 1:
                step += 1
    return order


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (4, 4), (5, 3), (2, 7), (6, 5)])
def test_spiral_rank_matches_a_walk(spark, shape):
    rows, cc = shape
    cells = spark.createDataFrame([(r, k) for r in range(rows) for k in range(cc)], "row int, col int")
    got = cells.orderBy(g.spiral_rank(F.col("row"), F.col("col"), F.lit(rows), F.lit(cc))).collect()
    assert [(r["row"], r["col"]) for r in got] == walk_spiral(rows, cc)


def test_rigid_2d_is_the_closest_rotation(spark, rng):
    mats = [rng.normal(size=(3, 3)) * 0.2 + np.eye(3) for _ in range(20)]
    df = spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(mats)], "i int, h array<double>")
    co, si, _, _ = g.to_rigid_2d(F.col("h"))
    for r in df.select("i", co.alias("co"), si.alias("si")).collect():
        a = mats[r["i"]] / mats[r["i"]][2, 2]
        u, _, vt = np.linalg.svd(a[:2, :2])
        rot = u @ np.diag([1, np.linalg.det(u @ vt)]) @ vt
        assert np.allclose([r["co"], r["si"]], [rot[0, 0], rot[1, 0]], atol=1e-9)


def test_closest_point_against_dense_sampling(spark, rng):
    tris = rng.normal(size=(30, 4, 3))
    names = [f"{p}{a}" for p in "abcp" for a in "xyz"]
    df = spark.createDataFrame([(i, *map(float, t.ravel())) for i, t in enumerate(tris)], "i int, " + ", ".join(f"{n} double" for n in names))
    v = {p: cols(*[f"{p}{a}" for a in "xyz"]) for p in "abcp"}
    out = g.add_closest_point(df, v["p"], v["a"], v["b"], v["c"]).collect()
    w = np.array([(i / 60, j / 60, 1 - (i + j) / 60) for i in range(61) for j in range(61 - i)])
    for r in out:
        a, b, c_, p = tris[r["i"]]
        pts = w @ np.stack([a, b, c_])
        best = np.linalg.norm(pts - p, axis=1).min()
        d = np.linalg.norm(np.array(r["foot"]) - p)
        assert d <= best + 1e-9 and best - d < 0.1


def test_bounds_round_trip_and_guards(spark):
    df = spark.createDataFrame([(0.3, 0.0, 1.0), (5.0, 2.0, None), (-3.0, None, 1.0), (7.0, None, None)], "v double, lb double, ub double")
    df = df.withColumn("u", g.bounded_to_free(*cols("v", "lb", "ub")))
    for r in df.withColumn("b", g.free_to_bounded(*cols("u", "lb", "ub"))).collect():
        assert r["b"] == pytest.approx(r["v"])
    far = spark.createDataFrame([(-800.0, 2.0)], "u double, lb double").select(g.free_to_bounded(F.col("u"), F.col("lb"), F.lit(None)).alias("b"))
    assert far.first()["b"] == 2.0


def test_corner_order(spark):
    pts = [(9.0, 9.0), (0.0, 0.0), (1.0, 8.0), (10.0, 1.0)]
    df = spark.createDataFrame([(pts,)], "p array<struct<x:double,y:double>>")
    o = df.select(g.order_corners(F.col("p")).alias("o"), g.order_corners(F.col("p"), 180).alias("t")).first()
    assert [tuple(p) for p in o["o"]] == [(0.0, 0.0), (10.0, 1.0), (1.0, 8.0), (9.0, 9.0)]
    assert [tuple(p) for p in o["t"]] == [(9.0, 9.0), (1.0, 8.0), (10.0, 1.0), (0.0, 0.0)]


def test_hemisphere_is_unit_and_upper(spark):
    d = g.hemisphere_dir(F.col("id"), 40)
    for r in spark.range(40).select(*[v.alias(k) for v, k in zip(d, "xyz")]).collect():
        assert r["z"] > 0 and math.isclose(r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2, 1, rel_tol=1e-9)
