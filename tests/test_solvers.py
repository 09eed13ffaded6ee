import numpy as np
import pytest
from conftest import to_plane
from pyspark.sql import functions as F

from gesso.operators.texture import cheapest_view
from gesso.plans import depth as dp
from gesso.plans import graph as gp
from gesso.plans import tiles


def grad_frame(spark, p, q, ok=None):
    h, w = p.shape
    ok = np.ones((h, w), bool) if ok is None else ok
    rows = [(0, y, x, float(p[y, x]), float(q[y, x]), bool(ok[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id int, y int, x int, p double, q double, valid boolean")


def forward(z):
    p, q = np.zeros_like(z), np.zeros_like(z)
    p[:, :-1], q[:-1] = np.diff(z, axis=1), np.diff(z, axis=0)
    return p, q


def test_fft_of_a_periodic_surface(spark):
    y, x = np.mgrid[0:24, 0:20]
    z = np.sin(2 * np.pi * x / 20) + 0.5 * np.cos(2 * np.pi * 2 * y / 24)
    p = 2 * np.pi / 20 * np.cos(2 * np.pi * x / 20)
    q = -0.5 * 2 * np.pi * 2 / 24 * np.sin(2 * np.pi * 2 * y / 24)
    for strip in (7, 64):
        assert np.allclose(to_plane(dp.integrate_fft(grad_frame(spark, p, q), strip=strip), "z", z.shape), z - z.mean(), atol=1e-9)


def test_cosine_transform_round_trip(rng):
    a = rng.normal(size=(5, 9))
    n = np.arange(9)
    direct = np.array([2 * (a * np.cos(np.pi * k * (2 * n + 1) / 18)).sum(1) for k in n]).T
    assert np.allclose(dp.dct(a, 1), direct) and np.allclose(dp.idct(dp.dct(a, 0), 0), a)


def test_dct_recovers_any_surface(spark, rng):
    z = rng.normal(size=(17, 12))
    got = to_plane(dp.integrate_dct(grad_frame(spark, *forward(z)), strip=5, tile=8), "z", z.shape)
    assert np.allclose(got - got.mean(), z - z.mean(), atol=1e-8)


def dense(p, q, ok):
    h, w = p.shape
    rows, rhs = [], []
    for y in range(h):
        for x in range(w):
            for dy, dx, g in ((0, 1, p), (1, 0, q)):
                if y + dy < h and x + dx < w and ok[y, x] and ok[y + dy, x + dx]:
                    r = np.zeros(h * w)
                    r[(y + dy) * w + x + dx], r[y * w + x] = 1, -1
                    rows.append(r)
                    rhs.append(g[y, x])
    z = np.linalg.lstsq(np.array(rows), np.array(rhs), rcond=None)[0].reshape(h, w)
    return z


@pytest.mark.parametrize("tile", [5, 64])
def test_masked_poisson_matches_dense_least_squares(spark, rng, tile):
    p, q = rng.normal(size=(11, 13)), rng.normal(size=(11, 13))
    ok = np.ones((11, 13), bool)
    ok[3:6, 4:7] = False
    out, steps, res = dp.integrate_poisson(grad_frame(spark, p, q, ok), tile=tile, tolerance=1e-9)
    got, want = to_plane(out, "z", p.shape), dense(p, q, ok)
    assert np.isnan(got[~ok]).all()
    assert np.allclose(got[ok] - got[ok].mean(), want[ok] - want[ok].mean(), atol=1e-6)
    assert res < 1e-8 and (steps <= 2 if tile == 64 else steps < 60)


def test_tiled_sweeps_equal_the_steps(spark, rng):
    y, x = np.mgrid[0:22, 0:25]
    ok = (y - 12) ** 2 + (x - 10) ** 2 > 12
    p, q = rng.normal(size=ok.shape), rng.normal(size=ok.shape)
    df = grad_frame(spark, p, q, ok)
    swept, sweeps, res = dp.integrate_poisson_tiled(df, tile=12, overlap=5, tolerance=1e-4)
    stepped, _, _ = dp.integrate_poisson(df, tile=12, tolerance=1e-7)
    a, b, want = to_plane(swept, "z", ok.shape), to_plane(stepped, "z", ok.shape), dense(p, q, ok)
    assert res <= 1e-4 and sweeps > 0
    assert np.allclose(b[ok] - b[ok].mean(), want[ok] - want[ok].mean(), atol=1e-5)
    assert np.allclose(a[ok] - a[ok].mean(), want[ok] - want[ok].mean(), atol=1e-2)
    left = tiles.residuals(df, swept).agg(F.max(F.abs("residual"))).first()[0]
    assert left < 1e-2
    with pytest.raises(RuntimeError, match="after 1 sweeps"):
        dp.integrate_poisson_tiled(df, tile=12, overlap=5, tolerance=1e-9, max_sweeps=1)


def test_steps_stay_flat_from_4_to_64_tiles(spark, rng):
    steps = []
    for side in (16, 64):
        y, x = np.mgrid[0:side, 0:side]
        p, q = np.sin(x / 5.0) + rng.normal(size=x.shape), np.cos(y / 7.0) + rng.normal(size=x.shape)
        _, n, res = dp.integrate_poisson(grad_frame(spark, p, q), tile=8, tolerance=1e-3)
        steps.append(n)
        assert res <= 1e-3
    assert steps[1] <= 1.3 * steps[0] + 2, steps


def test_images_of_their_own_and_without_valid_pixels(spark, rng):
    one, two = rng.normal(size=(2, 9, 9)), 50 * rng.normal(size=(2, 9, 9))
    df = grad_frame(spark, *one).unionByName(grad_frame(spark, *two).withColumn("image_id", F.lit(1))).unionByName(grad_frame(spark, *one).withColumns({"image_id": F.lit(2), "valid": F.lit(False)}))
    out, _, _ = dp.integrate_poisson(df, tile=5, tolerance=1e-7)
    for i, (p, q) in enumerate((one, two)):
        got, want = to_plane(out.where(F.col("image_id") == i), "z", p.shape), dense(p, q, np.ones(p.shape, bool))
        assert np.allclose(got - got.mean(), want - want.mean(), atol=1e-4)
    assert out.where("image_id = 2").count() == 0


def test_labelling_lowers_the_energy_and_ends_stable(spark, rng):
    side = 6
    faces = [(y * side + x) for y in range(side) for x in range(side)]
    edges = [(f, f + 1) for f in faces if f % side < side - 1] + [(f, f + side) for f in faces if f < side * (side - 1)]
    cost = {(f, v): float(rng.random() * 1.5) for f in faces[:-1] for v in (1, 2, 3)}
    costs = spark.createDataFrame([(f, v, c) for (f, v), c in cost.items()], "face int, view int, cost double")
    e = spark.createDataFrame(edges, "f1 int, f2 int")
    start = cheapest_view(costs).select("face", F.col("view").alias("label"))
    out = gp.label_faces(costs, e)
    assert gp.label_energy(costs, e, out) < gp.label_energy(costs, e, start)
    lab = {r["face"]: r["label"] for r in out.collect()}
    assert lab[faces[-1]] == 0 and len(lab) == 36
    near = {f: [b if a == f else a for a, b in edges if f in (a, b)] for f in faces}
    for f in faces[:-1]:
        total = {v: cost[f, v] + sum(lab[n] != v for n in near[f]) for v in (1, 2, 3)}
        assert total[lab[f]] <= min(total.values()) + 0.01


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + k) for k in range(1, 40)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), *range(100, 140), 500]], "node int")
    comp = {r["node"]: r["component"] for r in gp.connected_components(nodes, spark.createDataFrame(chain + star, "f1 int, f2 int")).collect()}
    assert all(comp[i] == 0 for i in range(61)) and all(comp[i] == 100 for i in range(100, 140)) and comp[500] == 500


def test_valid_region_drops_background_only(spark):
    p = np.ones((10, 12))
    p[:, :3] = 0  # background, touches corners
    p[5:7, 6:8] = 0  # a dark spot inside the picture stays valid
    rows = [(0, y, x, float(p[y, x])) for y in range(10) for x in range(12)]
    out = gp.valid_region(spark.createDataFrame(rows, "image_id int, y int, x int, v double"), "v", 4).collect()
    for r in out:
        want = 0 < r["y"] < 9 and 4 <= r["x"] < 11
        assert r["valid"] == want, (r["y"], r["x"])


@pytest.mark.parametrize("seed", range(4))
def test_region_labels_equal_a_flood_fill(seed):
    mask = np.random.default_rng(seed).random((17, 23)) < 0.55
    got, want, n = gp.region_labels(mask), np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if want[start]:
            continue
        n, stack = n + 1, [start]
        while stack:
            y, x = stack.pop()
            if 0 <= y < 17 and 0 <= x < 23 and mask[y, x] and not want[y, x]:
                want[y, x] = n
                stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    assert ((got == 0) == (want == 0)).all() and got.max() == n
    assert len(set(zip(got[mask], want[mask], strict=True))) == n


def test_valid_region_follows_background_through_many_tiles(spark, rng):
    p = np.ones((20, 26))
    for k, y in enumerate(range(0, 20, 4)):  # a snake from one corner through all tiles
        p[y] = 0
        p[y : y + 5, 25 if k % 2 == 0 else 0] = 0
    p[2, 10:14] = 0  # an island that no corner reaches
    rows = [(i, y, x, float(p[y, x])) for i in (0, 1) for y in range(20) for x in range(26) if i == 0 or y < 3]
    got = {(r["image_id"], r["y"], r["x"]): r["valid"] for r in gp.valid_region(spark.createDataFrame(rows, "image_id int, y int, x int, v double"), "v", 5).collect()}
    for i, h in ((0, 20), (1, 3)):
        dark, seen, stack = p[:h] == 0, set(), [(y, x) for y in (0, h - 1) for x in (0, 25)]
        while stack:
            y, x = stack.pop()
            if 0 <= y < h and 0 <= x < 26 and dark[y, x] and (y, x) not in seen:
                seen.add((y, x))
                stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        for y in range(h):
            for x in range(26):
                near = any((y + a, x + b) in seen for a in (-1, 0, 1) for b in (-1, 0, 1))
                assert got[i, y, x] == (not near and 0 < y < h - 1 and 0 < x < 25), (i, y, x)


def test_seam_levelling_matches_dense_solution(spark, rng):
    nodes = list(range(12))
    seams = [(0, 6, 0.5), (2, 8, -0.25), (5, 11, 0.1)]
    smooth = [(i, i + 1) for i in range(5)] + [(i, i + 1) for i in range(6, 11)]
    out, steps = gp.level_seams(
        spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(seams, "n1 int, n2 int, d0 double"),
        spark.createDataFrame(smooth, "n1 int, n2 int"), tolerance=1e-9)
    a, b = [], []
    for n1, n2, d in seams:
        r = np.zeros(12)
        r[n1], r[n2] = 1, -1
        a.append(r)
        b.append(d)
    for n1, n2 in smooth:
        r = np.zeros(12)
        r[n1], r[n2] = 0.1, -0.1
        a.append(r)
        b.append(0)
    want = np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0]
    got = np.array([r["d0"] for r in out.orderBy("node").collect()])
    assert np.allclose(got, want - want.mean(), atol=1e-6) and steps <= 14


def test_small_tiles_are_solved_line_by_line(rng, monkeypatch):
    monkeypatch.setattr(tiles, "descend", None)  # no steps, however many the tile would take
    for shape in ((64, 40), (7, 30), (1, 9), (5, 1)):
        ok = np.pad(rng.random(shape) > 0.2, 1)
        c = ok[1:-1, 1:-1]
        links = np.stack([c & ok[1:-1, 2:], c & ok[1:-1, :-2], c & ok[2:, 1:-1], c & ok[:-2, 1:-1]]).astype(float)
        want = rng.normal(size=shape) * (links.sum(axis=0) > 0)
        rhs = tiles.apply(want, links)
        got = tiles.solve(rhs, links)
        assert np.abs(tiles.apply(got, links) - rhs).max() < 1e-8
        assert (got[links.sum(axis=0) == 0] == 0).all()
