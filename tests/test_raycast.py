"""Blocked sight lines against brute force, with walls crowded in one place."""

import numpy as np
import pytest

from gesso.operators import boxtree as bt
from gesso.operators import raycast as rc

FACE = "mesh_id int, f int, " + ", ".join(f"{c} double" for c in rc.CORNERS)
SIGHT = "mesh_id int, f int, view int, " + ", ".join(f"{c} double" for c in (*rc.CORNERS, *rc.EYE))


def brute(sights, faces):
    out = set()
    tri = {}
    for mesh, f, *c in faces:
        if all(v is not None and np.isfinite(v) for v in c):
            tri.setdefault(mesh, []).append((f, *np.array(c).reshape(3, 3)))
    for mesh, f, view, *c in sights:
        if any(v is None or not np.isfinite(v) for v in c) or mesh not in tri:
            continue
        ids = np.array([t[0] for t in tri[mesh]])
        a, b, d2 = (np.array([t[i] for t in tri[mesh]]) for i in (1, 2, 3))
        eye = np.array(c[9:])
        for o in np.array(c[:9]).reshape(3, 3):
            d = eye - o
            e1, e2, s = b - a, d2 - a, o - a
            p, q = np.cross(d[None], e2), np.cross(s, e1)
            det = (e1 * p).sum(1)
            ok = np.abs(det) > 1e-12
            safe = np.where(ok, det, 1.0)
            u, v, t = (s * p).sum(1) / safe, (d * q).sum(1) / safe, (e2 * q).sum(1) / safe
            if (ok & (ids != f) & (u >= -1e-6) & (v >= -1e-6) & (u + v <= 1 + 1e-6) & (t > 1e-6) & (t < 1)).any():
                out.add((mesh, f, view))
                break
    return out


def run(spark, sights, faces, bucket=32):
    s, f = spark.createDataFrame(sights, SIGHT), spark.createDataFrame(faces, FACE)
    rows = [tuple(r) for r in rc.blocked(s, f, bucket).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def soup(rng, n, mesh=0, first=0, width=0.3, box=4.0):
    at = rng.uniform(0, box, (n, 1, 3)) + rng.normal(0, width, (n, 3, 3))
    return [(mesh, first + i, *map(float, at[i].ravel())) for i in range(n)]


def looks(faces, eyes):
    return [(mesh, f, view, *corners, *eye) for mesh, f, *corners in faces for view, eye in enumerate(eyes)]


@pytest.mark.parametrize("bucket", [4, 32])
def test_blocked_equals_brute_force(spark, rng, bucket):
    faces = soup(rng, 300) + soup(rng, 40, mesh=1, width=1.0) + [(0, 9000, -50.0, -50.0, 2.0, 50.0, -50.0, 2.0, 0.0, 80.0, 2.0)]
    eyes = [(2.0, 2.0, 9.0), (-30.0, 1.0, 1.0), (2.0, 2.0, 2.0)]
    sights = looks(faces, eyes)
    want = brute(sights, faces)
    assert want and len(want) < len(sights)
    assert run(spark, sights, faces, bucket) == want


def test_lines_along_axes_and_in_planes(spark):
    # flat boxes, lines parallel to them and lines through edges
    wall = lambda f, z: (0, f, 0.0, 0.0, z, 2.0, 0.0, z, 0.0, 2.0, z)
    faces = [wall(i, float(i)) for i in range(6)]
    sights = looks(faces, [(0.5, 0.5, 20.0), (0.5, 0.5, 2.5), (-5.0, 0.0, 3.0), (0.0, 0.0, 9.0)])
    want = brute(sights, faces)
    assert want and len(want) < len(sights)
    assert run(spark, sights, faces, 2) == want


def test_walls_crowded_in_one_cell_spread_and_lines_end_at_the_first(spark, rng, monkeypatch):
    # 10,000 walls within 0.01, faces below, the camera above
    at = np.sort(rng.uniform(1.0, 1.01, 10_000))
    walls = [(0, 10_000 + i, -1.0, -1.0, float(z), 3.0, -1.0, float(z), -1.0, 3.0, float(z)) for i, z in enumerate(at)]
    ground = [(0, i, i * 0.01, 0.0, 0.0, i * 0.01 + 0.01, 0.0, 0.0, i * 0.01, 0.01, 0.0) for i in range(40)]
    tested, sizes = [], []
    real_test, real_build = rc._blocked, bt.build

    def counted(pairs, *rest):
        tested.append(pairs.count())
        return real_test(pairs, *rest)

    def built(*args, **named):
        tree = real_build(*args, **named)
        sizes.append(tree.sizes[0])
        return tree

    monkeypatch.setattr(rc, "_blocked", counted)
    monkeypatch.setattr(bt, "build", built)
    sights = looks(ground, [(0.2, 0.2, 5.0)])
    assert run(spark, sights, ground + walls) == {(0, i, 0) for i in range(40)}
    assert sizes[0] >= 10_000 // 32  # a bucket holds at most 32 walls
    assert sum(tested) <= 40 * (rc.FIRST + rc.FIRST * rc.GROWTH)  # of some 12,500 pairs with all walls' buckets


def test_missing_empty_and_repeated(spark):
    a = (0, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    over = (0, 2, -9.0, -9.0, 1.0, 9.0, -9.0, 1.0, 0.0, 9.0, 1.0)
    broken = [(0, 3, None, *[0.0] * 8), (0, 4, float("nan"), *[0.0] * 8), (0, 5, float("inf"), *[0.0] * 8)]
    eye = (0.1, 0.1, 5.0)
    sights = [(0, 1, 0, *a[2:], *eye)] * 2 + [(0, 1, 1, *a[2:], None, 0.0, 5.0), (7, 1, 0, *a[2:], *eye)]
    assert run(spark, sights, [a, over, *broken]) == {(0, 1, 0)}
    assert run(spark, sights, [a, a]) == set()
    assert run(spark, sights, []) == set()
    assert run(spark, [], [a, over]) == set()


def test_more_meshes_than_roots(spark, rng):
    faces = [r for mesh in range(90) for r in soup(rng, 12, mesh, width=1.5, box=2.0)]
    sights = looks(faces, [(1.0, 1.0, 9.0)])
    assert run(spark, sights, faces, 4) == brute(sights, faces)


def test_sights_of_one_eye_travel_in_packets(spark, rng):
    # a view with two eyes, repeated sights and a face number used twice
    faces = soup(rng, 400) + soup(rng, 5)
    sights = looks(faces, [(2.0, 2.0, 9.0), (9.0, 2.0, 5.0)]) + [(0, f, 1, *c, -9.0, 0.0, 5.0) for _, f, *c in faces[:70]]
    rows = spark.createDataFrame(sights + sights[:30], SIGHT)
    lines = rows.select("mesh_id", "f", "view", *[rows[c].alias(f"o_{c}") for c in rc.CORNERS], *rc.EYE)
    packets = rc.packets_of(lines).collect()
    assert sum(len(p["_items"]) for p in packets) == len(sights) + 30
    assert max(len(p["_items"]) for p in packets) <= rc.PACKET
    assert len(packets) <= len(sights) // rc.PACKET + 20  # not a row a sight; 8 partitions and 3 eyes cut some more
    assert run(spark, sights + sights[:30], faces) == brute(sights, faces)
