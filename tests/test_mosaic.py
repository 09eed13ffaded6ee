import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gesso.functions import geometry as g
from gesso.operators import matching as m
from gesso.plans import mosaic as mo


def test_two_nearest_is_exact_with_small_blocks(spark, rng):
    rows = []
    for r in range(2):
        for c in range(2):
            n = 90 if (r, c) == (0, 0) else 25  # one crowded cell
            for k in range(n):
                rows.append((r, c, len(rows), float(rng.uniform(0, 100)), float(rng.uniform(0, 80)), [float(v) for v in rng.normal(size=8)]))
    df = spark.createDataFrame(rows, "row int, col int, kp long, x double, y double, desc array<float>")
    got = {(x["row"], x["col"], x["dir"], x["kp"], x["rank"]): (x["match"], x["distance"]) for x in m.two_nearest(df, 100, 80, block=16).collect()}
    facing = {"right": lambda x, y: x >= 50, "left": lambda x, y: x < 50, "bottom": lambda x, y: y >= 40, "top": lambda x, y: y < 40}
    tests = dict(facing)
    for a in ("top", "bottom"):
        for b in ("left", "right"):
            tests[f"{a}_{b}"] = lambda x, y, a=a, b=b: facing[a](x, y) and facing[b](x, y)
    flip = {"top": "bottom", "bottom": "top", "left": "right", "right": "left"}
    want = {}
    desc = {r[2]: np.array(r[5], dtype=np.float32).astype(float) for r in rows}
    for d, (dr, dc) in m.DIRECTIONS.items():
        back = "_".join(flip[p] for p in d.split("_"))
        for r in rows:
            if not tests[d](r[3], r[4]):
                continue
            cand = [q for q in rows if q[0] == r[0] + dr and q[1] == r[1] + dc and tests[back](q[3], q[4])]
            best = sorted((float(np.sqrt(((desc[r[2]] - desc[q[2]]) ** 2).sum())), q[2]) for q in cand)[:2]
            for i, (dist, kp) in enumerate(best):
                want[r[0], r[1], d, r[2], i + 1] = (kp, dist)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9


def ties(spark, rng, pairs=2, n=200):
    rows = []
    for p in range(pairs):
        a, b, tx, ty = 0.98, 0.05 + 0.01 * p, 30.0, -7.0
        for k in range(n):
            x, y = rng.uniform(0, 100, 2)
            bad = k % 4 == 0
            nx, ny = (rng.uniform(-60, 60, 2) if bad else rng.normal(size=2) * 0.2)
            rows.append((p, k, float(x), float(y), float(a * x - b * y + tx + nx), float(b * x + a * y + ty + ny)))
    return spark.createDataFrame(rows, "pair int, no int, x1 double, y1 double, x2 double, y2 double")


def test_ransac_recovers_the_similarity(spark, rng):
    for r in m.ransac_similarity(ties(spark, rng), ["pair"], "no").collect():
        assert np.allclose([r["a"], r["b"], r["tx"], r["ty"]], [0.98, 0.05 + 0.01 * r["pair"], 30, -7], atol=0.2)
        assert 140 <= r["inliers"] <= 165


def shift(dx, dy):
    return [1.0, 0.0, float(dx), 0.0, 1.0, float(dy), 0.0, 0.0, 1.0]


def test_propagation_of_pure_shifts(spark):
    cells = [(r, c) for r in range(4) for c in range(5)]
    steps = []
    for r, c in cells:
        for d, (dr, dc) in (("right", (0, 1)), ("left", (0, -1)), ("top", (1, 0)), ("bottom", (-1, 0))):
            if (r + dr, c + dc) in cells:
                steps.append((r, c, d, shift(100 * dc, -80 * dr)))
    out = mo.propagate_transforms(spark.createDataFrame(steps, "row int, col int, dir string, h array<double>"), spark.createDataFrame(cells, "row int, col int")).collect()
    assert len(out) == 20
    for r in out:
        assert np.allclose(r["h"], shift(100 * (r["col"] - 2), -80 * (r["row"] - 1)))


def test_large_rotations_either_way_become_shifts(spark):
    for sign in (1, -1):
        s = np.sin(np.radians(20)) * sign
        h = [float(np.cos(np.radians(20))), -float(s), 7.0, float(s), float(np.cos(np.radians(20))), 3.0, 0.0, 0.0, 1.0]
        got = spark.createDataFrame([(h,)], "h array<double>").select(mo.guarded(F.col("h")).alias("g")).first()["g"]
        assert got == shift(7, 3)


def test_bundle_adjust_beats_outliers(spark, rng):
    rows = []
    for c in range(3):
        for k in range(80):
            x, y = rng.uniform(40, 100, 2)
            bad = k % 8 == 0
            e = rng.normal(size=2) * (30 if bad else 0.05)
            rows.append((0, c, float(x), float(y), c + 1, float(x - 50 + e[0]), float(y + 2 + e[1])))
    start = spark.createDataFrame([(0, c, shift(50.0 * c, 0.0), c == 0) for c in range(4)], "mosaic int, cell int, h array<double>, anchor boolean")
    t = spark.createDataFrame(rows, "mosaic int, c1 int, x1 double, y1 double, c2 int, x2 double, y2 double")
    for r in mo.bundle_adjust(t, start, rounds=8).collect():
        px = np.array(r["h"]).reshape(3, 3) @ np.array([20.0, 60.0, 1.0])
        assert np.allclose(px[:2], [20 + 50 * r["cell"], 60 - 2 * r["cell"]], atol=1.0)


def test_warp_identity_shift(spark, rng):
    from conftest import frame

    p = rng.random((9, 7))
    df = frame(spark, p)
    t = spark.createDataFrame([(0, shift(5, 3))], "image_id int, h array<double>")
    out = mo.warp_to_panorama(df, t, ["v"], step=4, tile=8).collect()
    assert len(out) == p.size
    for r in out:
        assert abs(r["v"] - p[r["py"] - 3, r["px"] - 5]) < 1e-9


def test_inverse_transform(spark, rng):
    h = np.eye(3) + 0.1 * rng.normal(size=(3, 3))
    got = spark.createDataFrame([(h.ravel().tolist(),)], "h array<double>").select(mo.invert3(F.col("h")).alias("i")).first()["i"]
    inv = np.linalg.inv(h)
    i = np.array(got).reshape(3, 3)
    assert np.allclose(i / i[2, 2], inv / inv[2, 2])
    assert len(g.IDENTITY9) == 9


def test_homography_adjustment_recovers_perspective(spark, rng):
    true = [np.eye(3), np.array([[1.02, 0.01, 50], [-0.01, 0.99, 3], [2e-4, -1e-4, 1]])]
    rows = []
    for k in range(150):
        x, y = rng.uniform(50, 110, 2)
        q = np.linalg.inv(true[1]) @ np.array([x, y, 1.0])
        rows.append((0, 0, float(x), float(y), 1, float(q[0] / q[2]), float(q[1] / q[2])))
    t = spark.createDataFrame(rows, "mosaic int, c1 int, x1 double, y1 double, c2 int, x2 double, y2 double")
    start = spark.createDataFrame([(0, 0, shift(0, 0), True), (0, 1, shift(50, 0), False)], "mosaic int, cell int, h array<double>, anchor boolean")
    first = mo.bundle_adjust(t, start, rounds=2).withColumn("anchor", F.col("cell") == 0)
    out = {r["cell"]: r["h"] for r in mo.bundle_adjust_homography(t, first, rounds=4).collect()}
    assert np.allclose(np.array(out[1]).reshape(3, 3), true[1], atol=1e-3)


def test_inliers_are_counted_on_packed_ties(spark, rng):
    # a row a pair and run of ties, not one for each tie and hypothesis
    rows = [(int(p), *map(float, rng.normal(0, 4, 4))) for p in rng.integers(0, 3, 500)] + [(None, 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "pair int, x1 double, y1 double, x2 double, y2 double").coalesce(1)
    drawn = [(p, [0, 3], [1.0, 0.5], [0.0, 0.2], [0.1, -1.0], [0.3, 2.0]) for p in range(3)]
    packed = [r.asDict() for r in m._packed_ties(frame, ["pair"]).collect()]
    assert sorted(r["pair"] for r in packed) == [0, 1, 2]
    by = {p: dict(zip([f"_h{c}" for c in m._DRAWN], h)) for p, *h in drawn}
    got = pd.concat(m._count_inliers(["pair"], [3.0, 6.0])(iter([pd.DataFrame([r | by[r["pair"]] for r in packed])])))
    for r in got.itertuples(index=False):
        pair, k, a, b, tx, ty, *counts = r
        gaps = [(a * x - b * y + tx - u) ** 2 + (b * x + a * y + ty - v) ** 2 for p, x, y, u, v in rows if p == pair and x is not None]
        assert counts == [sum(g <= lv * lv for g in gaps) for lv in (3.0, 6.0)]
    assert len(got) == 6
