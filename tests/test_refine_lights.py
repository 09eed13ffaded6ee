"""Light directions are refined until they no longer change, or the call raises."""

import inspect

import numpy as np
import pytest

from gesso.operators import fits
from gesso.queries import calibration_queries


def test_refine_lights_goes_on_to_the_tolerance(spark, rng):
    true = rng.normal(size=(6, 3)) * [0.4, 0.4, 0.1] + [0, 0, 1]
    n = rng.normal(size=(40, 3)) * [0.2, 0.2, 0.1] + [0, 0, 1]
    true, n = (v / np.linalg.norm(v, axis=1)[:, None] for v in (true, n))
    obs = spark.createDataFrame([(i, k + 1, float(0.8 * n[i] @ true[k])) for i in range(40) for k in range(6)], "pixel int, light_id int, intensity double")
    guess = true + 0.1 * rng.normal(size=true.shape)
    guess /= np.linalg.norm(guess, axis=1)[:, None]
    lights = spark.createDataFrame([(k + 1, *map(float, guess[k])) for k in range(6)], "light_id int, lx double, ly double, lz double")
    at = lambda df: np.array([r[1:] for r in sorted(map(tuple, df.collect()))])
    with pytest.raises(RuntimeError):
        fits.refine_lights(obs, lights, ["pixel"], tolerance=1e-9, max_rounds=1)
    done = fits.refine_lights(obs, lights, ["pixel"], tolerance=5e-3)
    assert np.abs(at(fits.refine_lights(obs, done, ["pixel"], 1)) - at(done)).max() <= 5e-3


def at(df):
    return {r[0]: r[1:] for r in df.collect()}


def test_products_give_the_directions_of_passes(spark, rng, monkeypatch):
    # shadows, missing and repeated observations, a lamp without directions, one without observations
    true = rng.normal(size=(6, 3)) * [0.5, 0.5, 0.1] + [0, 0, 1]
    n = rng.normal(size=(60, 3)) * [0.4, 0.4, 0.1] + [0, 0, 1]
    true, n = (v / np.linalg.norm(v, axis=1)[:, None] for v in (true, n))
    rows = []
    for p in range(60):
        for k in range(6):
            value = 0.8 * float(n[p] @ true[k]) + 0.01 * rng.normal()
            if rng.random() < 0.2:
                value = 0.02 * rng.random()
            for _ in range(0 if rng.random() < 0.1 else 2 if rng.random() < 0.1 else 1):
                rows.append((p % 2, p // 2, k + 1, value))
        rows += [(p % 2, p // 2, 77, 0.5), (p % 2, p // 2, 1, None)]
    rows.append((5, 0, 1, 0.5))  # a pixel with one light
    obs = spark.createDataFrame(rows, "image_id int, pixel int, light_id int, intensity double")
    guess = [(k + 1, *map(float, true[k] + 0.1 * rng.normal(size=3))) for k in range(6)] + [(9, 0.0, 0.6, 0.8)]
    lights = spark.createDataFrame(guess, "light_id int, lx double, ly double, lz double")
    keys = ["image_id", "pixel"]
    by_products = at(fits.refine_lights(obs, lights, keys, 3))
    monkeypatch.setattr(fits, "PRODUCTS", 0)
    by_passes = at(fits.refine_lights(obs, lights, keys, 3))
    assert by_products.keys() == by_passes.keys() and by_products[9] == (0.0, 0.6, 0.8)
    for light, want in by_passes.items():
        assert by_products[light] == pytest.approx(want, abs=1e-9)


def test_observations_are_read_once(spark, rng, monkeypatch):
    rows = [(p, k + 1, float(0.2 + 0.6 * rng.random())) for p in range(30) for k in range(5)]
    obs = spark.createDataFrame(rows, "pixel int, light_id int, intensity double")
    lights = spark.createDataFrame([(k + 1, float(rng.normal() * 0.3), float(rng.normal() * 0.3), 1.0) for k in range(5)], "light_id int, lx double, ly double, lz double")
    seen, real = [], fits._by_light
    monkeypatch.setattr(fits, "_by_light", lambda *a: (seen.append(1), real(*a))[1])
    monkeypatch.setattr(fits, "_refine_by_passes", None)
    assert len(fits.refine_lights(obs, lights, ["pixel"], 40).collect()) == 5
    assert len(seen) == 1
    nothing = obs.where("pixel < 0")
    assert at(fits.refine_lights(nothing, lights, ["pixel"])) == at(lights)
    assert fits.refine_lights(obs, lights.where("light_id < 0"), ["pixel"]).collect() == []


def test_query_asks_for_no_fixed_rounds(monkeypatch):
    seen = {}
    monkeypatch.setattr(calibration_queries, "observations", lambda t: None)
    monkeypatch.setattr(calibration_queries, "lights", lambda t: None)

    def refine(*args, **named):
        seen.update(inspect.signature(real).bind(*args, **named).arguments)
        raise StopIteration

    real = fits.refine_lights
    monkeypatch.setattr(fits, "refine_lights", refine)
    with pytest.raises(StopIteration):
        calibration_queries.g16(None)
    assert "rounds" not in seen and "max_rounds" not in seen
