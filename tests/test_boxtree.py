"""Searches in a tree of boxes: brute force, crowded and remote places, wide triangles, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gesso.functions import geometry as g
from gesso.operators import boxtree as bt
from gesso.operators import mesh as m

CORNERS = [f"{a}{i}" for i in (1, 2, 3) for a in "xyz"]


def points(spark, pts):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, x double, y double, z double")


def triangles(spark, tris):
    return spark.createDataFrame([(i, *map(float, np.ravel(t))) for i, t in enumerate(tris)], "f long, " + ", ".join(f"{c} double" for c in CORNERS))


def boxed(points):
    return points.select(F.col("id").alias("neighbour"), *"xyz", *[F.col(a).alias(f"{a}{i}") for i in (0, 1) for a in "xyz"])


def test_dense_cluster_and_remote_queries(spark, rng):
    pts = np.vstack([rng.random((3000, 3)) * [1, 1, 0.05], 0.5 + 1e-5 * rng.random((3000, 3))])
    far = np.vstack([[1000, 0.3, 0.2] + rng.random((200, 3)), [[0.5, 0.5, -4e5]]])
    p, q = points(spark, pts), points(spark, far)
    got = m.nearest_points(q, p, 3, exclude_self=False).collect()
    d = np.linalg.norm(far[:, None] - pts[None], axis=2)
    assert len(got) == 3 * len(far)
    for r in got:
        assert r["distance"] == pytest.approx(np.sort(d[r["id"]])[r["rank"] - 1], rel=1e-12)
        assert d[r["id"], r["neighbour"]] == pytest.approx(r["distance"], rel=1e-12)
    near = m.nearest_points(p.where("id >= 5900"), p, 4).collect()
    d = np.linalg.norm(pts[5900:, None] - pts[None], axis=2)
    d[np.arange(100), np.arange(5900, 6000)] = np.inf
    assert len(near) == 400
    for r in near:
        assert r["distance"] == pytest.approx(np.sort(d[r["id"] - 5900])[r["rank"] - 1], rel=1e-9)


@pytest.mark.parametrize("n", [4000, 16000])
def test_candidates_of_a_block_do_not_grow_with_the_points(spark, rng, n):
    pts = np.vstack([rng.random((n // 2, 3)) * [1, 1, 0], 0.5 + 1e-5 * rng.random((n // 2, 3)) * [1, 1, 0]])
    p = points(spark, pts)
    tree = bt.build(boxed(p), "neighbour", list("xyz"))
    for queries in (p, points(spark, [0.5, 0.5, 1000] + rng.random((50, 3))), points(spark, [1000, 0, 0] + rng.random((50, 3)))):
        blocks = bt.query_blocks(queries, tree)
        per = bt.candidate_buckets(blocks, tree, 5).groupBy("_q").count().agg(F.avg("count")).first()[0]
        assert per <= 40  # of 125 and 500 buckets


def test_one_wide_triangle_is_one_more_candidate(spark, rng):
    at = rng.random((3000, 1, 3)) * [10, 10, 0.1]
    small = at + 0.05 * rng.normal(size=(3000, 3, 3))
    wide = np.array([[[-50, -50, -1], [60, -50, -1], [5, 90, -1]]], float)
    q = points(spark, rng.random((300, 3)) * [10, 10, 1])
    counts, first = [], None
    for tris in (small, np.vstack([small, wide])):
        t = triangles(spark, tris)
        boxes = t.select("f", *[f(*[F.col(f"{a}{i}") for i in (1, 2, 3)]).alias(f"_{a}{n}") for n, f in ((0, F.least), (1, F.greatest)) for a in "xyz"])
        tree = bt.build(boxes.select("f", *[F.col(f"_{c}").alias(c) for c in bt.BOX]), "f", [])
        first = first or tree
        blocks = bt.query_blocks(q, first)
        counts.append(bt.candidate_buckets(blocks, tree, 1).count())
        n_blocks = blocks.count()
    # the buckets at the ends of partitions are cut anew, hence the tenth
    assert counts[1] <= 1.1 * counts[0] + n_blocks
    got = {r["id"]: r for r in m.nearest_triangle(q, triangles(spark, np.vstack([small, wide]))).collect()}
    at = np.array([[r["x"], r["y"], r["z"]] for r in q.orderBy("id").collect()])
    d, _ = bt.to_triangles(at, list(np.vstack([small, wide]).reshape(-1, 9).T))
    assert len(got) == 300
    for i, r in got.items():
        assert r["distance"] == pytest.approx(d[i].min(), abs=1e-12) and np.linalg.norm(np.array(r["foot"]) - at[i]) == pytest.approx(r["distance"], abs=1e-9)


def test_feet_equal_the_column_formula(spark, rng):
    tris = rng.normal(size=(60, 3, 3))
    tris[0, 1] = tris[0, 0]  # a side of no length
    tris[1, 2] = (tris[1, 0] + tris[1, 1]) / 2  # no area
    tris[2] = tris[2, 0]  # a point
    at = rng.normal(size=(60, 3)) * 2
    d, feet = bt.to_triangles(at, list(tris.reshape(-1, 9).T))
    i = np.arange(60)
    foot = feet(i, i)
    assert np.allclose(np.linalg.norm(foot - at, axis=1), d[i, i], atol=1e-12)
    rows = triangles(spark, tris[3:]).join(points(spark, at[3:]), F.col("f") == F.col("id"))
    rows = g.add_closest_point(rows, (F.col("x"), F.col("y"), F.col("z")), m.corner(1), m.corner(2), m.corner(3))
    for r in rows.collect():
        assert np.allclose(r["foot"], foot[r["id"] + 3], atol=1e-9)
    w = np.linspace(0, 1, 400)[:, None]
    assert d[0, 0] <= np.linalg.norm(tris[0, 0] * w + tris[0, 2] * (1 - w) - at[0], axis=1).min() + 1e-12
    assert d[1, 1] <= np.linalg.norm(tris[1, 0] * w + tris[1, 1] * (1 - w) - at[1], axis=1).min() + 1e-12
    assert d[2, 2] == pytest.approx(np.linalg.norm(tris[2, 0] - at[2]))


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, float("inf"), 0.0, 0.0), (5, 0.0, 0.0, 0.0), (6, 1.0, 0.0, 0.0), (7, -1.0, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = sorted((r["id"], r["rank"], r["neighbour"], r["distance"]) for r in m.nearest_points(p, p, 2).collect())
    assert got == [(1, 1, 5, 0.0), (1, 2, 6, 1.0), (5, 1, 1, 0.0), (5, 2, 6, 1.0), (6, 1, 1, 1.0), (6, 2, 5, 1.0), (7, 1, 1, 1.0), (7, 2, 5, 1.0)]
    none = p.where("id > 99")
    assert m.nearest_points(p, none, 2).count() == 0 and m.nearest_points(none, p, 2).count() == 0
    assert m.nearest_triangle(p, triangles(spark, np.zeros((0, 3, 3)))).count() == 0
    named = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 3.0, 0.0, 0.0)], "id string, x double, y double, z double")
    assert {(r["id"], r["neighbour"]) for r in m.nearest_points(named, named, 1).collect()} == {("a", "b"), ("b", "a")}
