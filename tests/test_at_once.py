"""Small images take all steps of the masked solver in one task, large ones a written table a step; the depth is the same."""

import numpy as np

from gesso.plans import depth as dp
from gesso.plans import tiles


def test_small_images_write_no_table_a_step(spark, rng, monkeypatch):
    rows = []
    for image in (0, 1, 2):
        for y in range(13):
            for x in range(11 if image else 30):  # image 0 has eight tiles, the others four
                ok = not (4 <= y <= 6 and 3 <= x <= 8) and image != 2 or (y, x) == (2, 2)
                rows.append((image, y, x, *map(float, rng.normal(size=2) * 10**image), ok))
    grad = spark.createDataFrame(rows, "image_id int, y int, x int, p double, q double, valid boolean")
    wrote, write = [], tiles.keep
    monkeypatch.setattr(tiles, "keep", lambda df, name="kept", *more: (wrote.append(name), write(df, name, *more))[1])
    small, steps, left = dp.integrate_poisson(grad.where("image_id > 0"), tile=8)
    assert "state" not in wrote and steps > 1 and left <= 1e-5
    both, most, _ = dp.integrate_poisson(grad, tile=8)
    assert "state" in wrote and most >= steps
    monkeypatch.setattr(tiles, "AT_ONCE", 0)
    stepped, rounds, _ = dp.integrate_poisson(grad, tile=8)
    got, want = ({(r["image_id"], r["y"], r["x"]): r["z"] for r in df.collect()} for df in (both, stepped))
    assert rounds == most and got.keys() == want.keys() == {tuple(r[:3]) for r in rows if r[-1]}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-8
    assert {k: v for k, v in got.items() if k[0]} == {(r["image_id"], r["y"], r["x"]): r["z"] for r in small.collect()}
    assert got[2, 2, 2] == 0.0


def test_a_solver_is_made_once_for_many_right_sides(rng):
    on = rng.random((9, 6)) > 0.1
    links = np.zeros((4, 9, 6))
    links[0][:, :-1] = links[1][:, 1:] = on[:, :-1] & on[:, 1:]
    links[2][:-1] = links[3][1:] = on[:-1] & on[1:]
    solved = tiles.solver(links)
    for _ in range(2):
        rhs = tiles.apply(rng.random((9, 6)) * on, links)
        assert np.abs(tiles.apply(solved(rhs), links) - rhs).max() < 1e-8 and np.array_equal(solved(rhs), tiles.solve(rhs, links))
