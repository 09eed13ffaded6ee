"""Work that must grow in tasks or in rows a batch, not in one task or a call a row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gesso.operators import boxtree as bt
from gesso.operators import calibration as cal
from gesso.operators import mesh as m
from gesso.operators import texture as tx
from gesso.plans import depth as dp
from gesso.plans import tiles


def written_files(monkeypatch, module, name):
    """Files of each table that ``module`` writes as ``name``."""
    seen, write = [], module.keep

    def keep(df, called="kept", *more):
        kept = write(df, called, *more)
        if called == name:
            seen.append(len(kept.inputFiles()))
        return kept

    monkeypatch.setattr(module, "keep", keep)
    return seen


@pytest.mark.parametrize("solver", [lambda g: dp.integrate_poisson_tiled(g, tile=8, overlap=4, tolerance=1e-12, max_sweeps=0), lambda g: dp.integrate_poisson(g, tile=8, tolerance=1e-12, max_steps=0)])
def test_tiles_are_solved_by_many_tasks(spark, monkeypatch, solver):
    g = spark.range(4 * 24 * 24).select(
        F.floor(F.col("id") / 576).cast("int").alias("image_id"), F.floor(F.col("id") % 576 / 24).cast("int").alias("y"), (F.col("id") % 24).cast("int").alias("x"),
        F.sin("id").alias("p"), F.cos("id").alias("q"), F.lit(True).alias("valid"))
    files = written_files(monkeypatch, tiles, "state")
    with pytest.raises(RuntimeError):
        solver(g)  # one round is enough to see
    assert len(files) > 1 and min(files[1:]) > 1


def test_a_plane_is_multiplied_as_by_apply(rng):
    ok = rng.random((9, 7)) > 0.2
    links = np.zeros((4, 9, 7))
    links[0][:, :-1] = links[1][:, 1:] = ok[:, :-1] & ok[:, 1:]
    links[2][:-1] = links[3][1:] = ok[:-1] & ok[1:]
    on = ok & (rng.random((9, 7)) > 0.1)
    p = rng.random((9, 7)) * on
    assert np.allclose(tiles.plane_times(links, on)(p), np.where(on, tiles.apply(p, links) + tiles.SHIFT * p, 0.0), atol=1e-13)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_are_not_written_again_each_round(spark, monkeypatch):
    df = spark.createDataFrame([(f, i, 0.1 * (i % 5), 0.2 * (i % 3), 0.05 * i, 1.0) for f in (1, 2, None) for i in range(12)], "face int, view int, c0 double, c1 double, c2 double, quality double")
    rows, write = [], tx.keep

    def keep(df, name="kept"):
        kept = write(df, name)
        rows.append((name, kept.count()))
        return kept

    monkeypatch.setattr(tx, "keep", keep)
    out = tx.color_outliers(df).collect()
    assert {n for name, n in rows if name == "faces"} == {2}
    assert len(out) == 36 and all(r["quality"] == 1.0 for r in out if r["face"] is None)


def test_edge_samples_are_not_shuffled(spark):
    pixels = spark.createDataFrame([(0, y, x, float(x + 2 * y)) for y in range(20) for x in range(20)], "image_id int, y int, x int, v double")
    rows = [(1, 1, 0, 1.0, 1.0, 17.0, 15.0), (1, 2, 0, 3.0, 18.0, 3.0, 2.0), (2, 1, 0, 5.0, 5.0, 40.0, 5.0), (3, 1, 0, 30.0, 30.0, 31.0, 31.0)]
    out = tx.edge_color_difference(spark.createDataFrame(rows, "edge int, side int, image_id int, px1 double, py1 double, px2 double, py2 double"), pixels, ["v"], 4)
    means = {}
    for edge, side, _, x1, y1, x2, y2 in rows:
        n = int(max(np.hypot(x2 - x1, y2 - y1), 1.0) * 2)
        t = np.arange(n) / (n - 1)
        x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
        ok = (x >= 0) & (y >= 0) & (x <= 19) & (y <= 19)
        if ok.any():
            means[edge, side] = ((1 - t) * (x + 2 * y))[ok].sum() / (1 - t)[ok].sum()
    got = {r["edge"]: r["d_v"] for r in out.collect()}
    assert set(got) == {1, 2} and got[2] is None
    assert np.isclose(got[1], means[1, 2] - means[1, 1], atol=1e-9)
    assert "SortMergeJoin" not in plan_of(out)


def test_the_flat_plane_is_smoothed_once(spark, monkeypatch):
    img = spark.range(400).select(F.lit(0).alias("image_id"), F.floor(F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), *[(F.rand(i) * 0.5 + 0.3).alias(f"c{i}") for i in range(3)])
    seen = []
    smooth = cal.keep
    monkeypatch.setattr(cal, "keep", lambda df, name: seen.append(name) or smooth(df, name))
    out = cal.flat_plane(img, 2.0, 16)
    assert out.count() == 400 and seen == ["low"] and "FlatMapGroupsInPandas" not in plan_of(out)


def test_planes_are_not_unfolded_in_pairs(spark):
    s = spark.createDataFrame([(i, float(i % 4), float(i // 4), 0.0, 0.0, 0.0, 1.0) for i in range(16)] + [(99, None, 0.0, 0.0, 0.0, 0.0, 1.0)], "id int, x double, y double, z double, nx double, ny double, nz double")
    out = m.tangent_cells(s, 8)
    assert "posexplode" not in plan_of(out)
    got = {(r["x"], r["y"]) for r in out.where("id = 5").collect()}
    assert got == {(0.5, 0.5), (1.5, 0.5), (0.5, 1.5), (1.5, 1.5)} and out.where("id = 99").count() == 0


def test_pairs_are_searched_together(rng):
    rows = []
    for q, (n, k) in enumerate(((3, 5), (64, 32), (1, 1))):
        at, items = rng.random((n, 3)), rng.integers(0, 3, (k, 3)) / 2.0
        box = dict(zip(bt.BOX, [*items.min(axis=0), *items.max(axis=0)], strict=True))
        limits = None if q == 0 else [np.inf if i % 2 else 0.8 for i in range(n)]
        rows.append({"_q": q, "_q_id": np.arange(n), **{f"_q_{a}": at[:, i] for i, a in enumerate("xyz")}, "_p_item": np.arange(k), **{f"_p_{a}": items[:, i] for i, a in enumerate("xyz")}, "_limits": limits, **box})
    got = bt._nearest_rows(pd.DataFrame(rows), "item", ["_p_x", "_p_y", "_p_z"], 4, bt.to_points, True)
    want = set()
    for r in rows:
        for i in r["_q_id"]:
            d = np.sqrt(sum((r[f"_q_{a}"][i] - r[f"_p_{a}"]) ** 2 for a in "xyz"))
            near = sorted((v, j) for j, v in enumerate(d) if j != i and v <= (np.inf if r["_limits"] is None else r["_limits"][i]))[:4]
            want |= {(r["_q"], int(i), j) for _, j in near}
    assert set(zip(got["_q"], got["id"], got["item"], strict=True)) == want and len(got) == len(want)
