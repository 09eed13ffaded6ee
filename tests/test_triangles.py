"""Nearest triangles by pages: brute force on stacked steep triangles, levels, odd rows, bounds of what travels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gesso.operators import boxtree as bt
from gesso.operators import mesh as m
from gesso.operators import triangles as tr

CORNERS = [f"{a}{i}" for i in (1, 2, 3) for a in "xyz"]


def tables(spark, pts, tris):
    p = spark.createDataFrame([(i, *map(float, at)) for i, at in enumerate(pts)], "id long, x double, y double, z double")
    return p, spark.createDataFrame([(i, *map(float, np.ravel(t))) for i, t in enumerate(tris)], "f long, " + ", ".join(f"{c} double" for c in CORNERS))


def stacked(rng, n, side=3):
    """Steep triangles over few cells, so that their boxes overlap."""
    at = rng.integers(0, side, (n, 1, 2)) + np.array([[[0, 0], [1, 0], [0, 1]]])
    return np.concatenate([at, rng.random((n, 3, 1)) * 10], axis=2).astype(float)


def test_stacked_triangles_by_levels(spark, rng, monkeypatch):
    tris = np.vstack([stacked(rng, 1500), [[[-90, -90, 4], [90, -90, 5], [0, 90, 5]]], np.zeros((1, 3, 3))])
    tris[-1] += [1, 1, 20]  # a point
    pts = np.vstack([rng.random((300, 3)) * [3, 3, 10], [1000, 0, 5] + rng.random((20, 3)), [[1, 1, 21]]])
    p, t = tables(spark, pts, tris)
    monkeypatch.setattr(tr, "SEEDS", 20)
    monkeypatch.setattr(tr, "PAGE", 128)
    monkeypatch.setattr(tr, "VISITS", 2)
    visits, real = [], tr._visits
    monkeypatch.setattr(tr, "_visits", lambda blocks, boxes: (visits.append((out := real(blocks, boxes)).select("page", "part", F.length("i").alias("n")).collect()), out)[1])
    got = {r["id"]: r for r in m.nearest_triangle(p, t, bucket=8).collect()}
    d, feet = bt.to_triangles(pts, list(tris.reshape(-1, 9).T))
    i = np.arange(len(pts))
    foot = feet(i, d.argmin(axis=1))
    assert len(got) == len(pts)
    for k, r in got.items():
        assert (r["f"], r["distance"]) == (d[k].argmin(), d[k].min()) and np.array_equal(r["foot"], foot[k])
    assert len(visits) == 3  # two levels before that of all triangles
    asked = sum(r["n"] // 4 for r in visits[-1])
    assert asked < 0.7 * len(pts) * len({r["page"] for r in visits[-1]})
    assert max(sum(1 for r in visits[-1] if (r["page"], r["part"]) == at) for at in {(r["page"], r["part"]) for r in visits[-1]}) <= 2


def test_few_pairs_get_their_exact_distance(rng, monkeypatch):
    tris, pts, measured = stacked(rng, 4000, 1), rng.random((64, 3)) * [1, 1, 10], []
    faces, real = tr.Faces(tris), tr.Faces.measure
    monkeypatch.setattr(tr.Faces, "measure", lambda self, at, j, feet=False: (measured.append(len(j)), real(self, at, j, feet))[1])
    d, _ = bt.to_triangles(pts, list(tris.reshape(-1, 9).T))
    found, best = faces.nearest(pts, np.full(64, 1.0))
    assert np.array_equal(found, d.argmin(axis=1)) and np.array_equal(best, d.min(axis=1))
    assert sum(measured) < 0.15 * d.size
    reach = d.min(axis=1) * np.where(np.arange(64) % 2, 1.0, 0.9)
    found, best = faces.nearest(pts, reach)
    assert np.array_equal(found, np.where(np.arange(64) % 2, d.argmin(axis=1), -1)) and np.isinf(best[::2]).all()


def test_equal_triangles_and_repeated_or_missing_names(spark):
    tri = [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    rows = [(7, *tri), (3, *tri), (5, *tri), (3, *[v + 9 for v in tri]), (2**53 + 1, *[v + 50 for v in tri]), (1, *[float("nan")] * 9)]
    t = spark.createDataFrame(rows, "f long, " + ", ".join(f"{c} double" for c in CORNERS))
    p = spark.createDataFrame([(1, 0.2, 0.2, 1.0), (1, 0.2, 0.2, 0.5), (2, 50.2, 50.2, 50.5), (4, None, 0.0, 0.0), (None, 0.2, 0.2, -2.0)], "id long, x double, y double, z double")
    got = {r["id"]: (r["f"], r["distance"], r["foot"]) for r in m.nearest_triangle(p, t).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: (3, 0.5), 2: (2**53 + 1, 0.5), None: (3, 2.0)}
    assert got[2][2] == pytest.approx([50.2, 50.2, 50.0]) and got[1][2] == pytest.approx([0.2, 0.2, 0.0])
    assert m.nearest_triangle(p.where("id > 9"), t).count() == 0 and m.nearest_triangle(p, t.where("f < 0")).count() == 0
    named = t.withColumn("f", F.concat(F.lit("t"), "f"))
    assert {r["f"] for r in m.nearest_triangle(p.where("id = 1"), named).collect()} == {"t3"}
