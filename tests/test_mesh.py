import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from gesso.operators import mesh as m
from gesso.operators import texture as tx


def points(spark, pts):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, x double, y double, z double")


@pytest.mark.parametrize("bucket", [32, 2])
def test_nearest_points_with_copies_and_outliers(spark, rng, bucket):
    pts = rng.normal(size=(80, 3))
    pts = np.vstack([pts, np.tile(pts[0], (40, 1)), [[30, 30, 30]]])  # a pile of copies, one far point
    got = m.nearest_points(points(spark, pts), points(spark, pts), 3, bucket=bucket).collect()
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert len(got) == 3 * len(pts)
    for r in got:
        assert r["distance"] == pytest.approx(np.sort(d[r["id"]])[r["rank"] - 1], abs=1e-12)


def test_padding_repeats_the_last(spark):
    p = points(spark, [[0, 0, 0], [1, 0, 0]])
    out = m.padded_neighbours(m.nearest_points(p, p, 3), 3).orderBy("id", "rank").collect()
    assert [(r["id"], r["neighbour"], r["rank"]) for r in out] == [(0, 1, 1), (0, 1, 2), (0, 1, 3), (1, 0, 1), (1, 0, 2), (1, 0, 3)]


def relief(spark, rng, h=7, w=6):
    return m.vertex_grid(frame(spark, rng.random((h, w)), "z"), "z")


def test_grid_mesh_adjacency(spark, rng):
    _, f = relief(spark, rng)
    rows = f.collect()
    assert len(rows) == 2 * 6 * 5
    want = set()
    for a in rows:
        for b in rows:
            if a["f"] < b["f"] and len({a["v1"], a["v2"], a["v3"]} & {b["v1"], b["v2"], b["v3"]}) == 2:
                want.add((a["f"], b["f"]))
    assert {(r["f1"], r["f2"]) for r in m.face_adjacency(f).collect()} == want


def test_adjacency_of_a_shared_spine(spark):
    """Three faces on one edge are all neighbours."""
    f = spark.createDataFrame([(0, i, 0, 1, 2 + i) for i in range(3)], "mesh_id int, f int, v1 int, v2 int, v3 int")
    assert {(r["f1"], r["f2"]) for r in m.face_adjacency(f).collect()} == {(0, 1), (0, 2), (1, 2)}


def brute_ray(o, d, tri):
    a, b, c = tri
    e1, e2 = b - a, c - a
    p = np.cross(d, e2)
    det = e1 @ p
    if abs(det) < 1e-12:
        return False
    s = o - a
    u = s @ p / det
    q = np.cross(s, e1)
    v, t = d @ q / det, e2 @ q / det
    return u >= -1e-6 and v >= -1e-6 and u + v <= 1 + 1e-6 and 1e-6 < t < 1


def test_occlusion_and_culling_against_brute_force(spark, rng):
    v, f = relief(spark, rng)
    faces = m.faces_with_vertices(f, v).cache()
    rot = [1.0, 0, 0, 0, -1.0, 0, 0, 0, -1.0]
    eyes = [(0, 0, -9.0, 3.0, 14.0), (0, 1, 3.0, 3.0, 40.0), (0, 2, 3.0, 15.0, 12.0)]
    views = spark.createDataFrame([(*e, [float(x) for x in rot], 2.0, 2.0) for e in eyes], "mesh_id int, view int, ex double, ey double, ez double, rot array<double>, tx double, ty double")
    seen = tx.visible_faces(faces, views, 75).cache()
    rows = {r["f"]: r for r in faces.collect()}
    tri = {k: np.array([[r[f"{a}{i}"] for a in "xyz"] for i in (1, 2, 3)]) for k, r in rows.items()}
    want = set()
    for k, t in tri.items():
        n = np.cross(t[1] - t[0], t[2] - t[0])
        n /= np.linalg.norm(n)
        for _, view, *e in eyes:
            ray = t.mean(0) - np.array(e)
            cam = np.array(rot).reshape(3, 3) @ ray
            cosine = -(n @ ray) / np.linalg.norm(ray)
            if cosine > 0 and cam[2] > 0 and abs(cam[0]) <= 2 * cam[2] and abs(cam[1]) <= 2 * cam[2] and np.degrees(np.arccos(min(1, cosine))) <= 75:
                want.add((k, view))
    assert {(r["f"], r["view"]) for r in seen.collect()} == want
    eye = {view: np.array(e) for _, view, *e in eyes}
    hidden = {(k, view) for k, view in want if any(brute_ray(o, eye[view] - o, tri[j]) for o in tri[k] for j in tri if j != k)}
    assert {(r["f"], r["view"]) for r in tx.occluded(seen, faces, views).collect()} == hidden
    assert hidden


def test_nearest_triangle_matches_brute_force(spark, rng):
    v, f = relief(spark, rng)
    faces = m.faces_with_vertices(f, v).select("f", *[f"{a}{i}" for i in (1, 2, 3) for a in "xyz"])
    pts = rng.uniform(-3, 9, (25, 3))
    got = m.nearest_triangle(points(spark, pts), faces).collect()
    tris = np.array([[[r[f"{a}{i}"] for a in "xyz"] for i in (1, 2, 3)] for r in faces.collect()])
    w = np.array([(i / 50, j / 50, 1 - (i + j) / 50) for i in range(51) for j in range(51 - i)])
    cloud = np.einsum("wk,tka->twa", w, tris).reshape(-1, 3)
    assert len(got) == 25
    for r in got:
        best = np.linalg.norm(cloud - pts[r["id"]], axis=1).min()
        assert r["distance"] <= best + 1e-9 and best - r["distance"] < 0.15


def test_tangent_cell_of_a_lattice_is_a_square(spark):
    pts = [(float(i), float(j), 0.0) for i in range(5) for j in range(5)]
    s = points(spark, pts).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    cells = m.tangent_cells(s, 8)
    mid = [(r["x"], r["y"]) for r in cells.where("id = 12").collect()]
    assert sorted(mid) == [(1.5, 1.5), (1.5, 2.5), (2.5, 1.5), (2.5, 2.5)]
    c = m.barycenters(cells).where("id = 12").first()
    assert (c["x"], c["y"], c["z"]) == (2.0, 2.0, 0.0)


def test_color_outliers_damp_the_odd_view(spark, rng):
    rows = [(0, k, *map(float, 0.5 + 0.05 * rng.normal(size=3)), 1.0) for k in range(60)] + [(0, 99, 1.0, 0.0, 1.0, 1.0)]
    rows += [(1, k, 0.1 * k, 0.2, 0.3, 1.0) for k in range(3)]  # too few views: unchanged
    df = spark.createDataFrame(rows, "face int, view int, c0 double, c1 double, c2 double, quality double")
    for mode in ("damp", "clamp"):
        q = {(r["face"], r["view"]): r["quality"] for r in tx.color_outliers(df, mode=mode).collect()}
        assert q[0, 99] < 0.01 and all(q[1, k] == 1.0 for k in range(3))
        assert np.mean([q[0, k] > 0.3 for k in range(60)]) > 0.9


def test_rasterise_huge_triangle_in_tiles(spark):
    t = spark.createDataFrame([(0, -0.01, -0.01, 90.05, -0.01, -0.01, 90.05)], "f int, ax double, ay double, bx double, by double, cx double, cy double")
    assert m.rasterise(t, ["f"], 16).count() == sum(91 - y for y in range(91))


def test_adjustment_rim(spark):
    t = spark.createDataFrame([(0, 0, 2.0, 2.0, 8.0, 2.0, 2.0, 8.0, [1.0, 1.0, 1.0])], "patch int, f int, ax double, ay double, bx double, by double, cx double, cy double, c0 array<double>")
    px = spark.createDataFrame([(0, y, x, 0.0) for y in range(12) for x in range(12)], "patch int, y int, x int, c0 double")
    got = {(r["y"], r["x"]): r["c0"] for r in tx.apply_adjustment(t, px, ["c0"]).collect()}
    assert got[3, 3] == pytest.approx(1) and got[1, 4] == pytest.approx(1) and got[0, 4] == 0 and got[11, 11] == 0
