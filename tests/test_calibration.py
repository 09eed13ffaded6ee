import numpy as np
import pytest
from pyspark.sql import functions as F

from gesso.operators import calibration as cal
from gesso.operators import fits
from gesso.plans import calibrate as plan


def chart(spark, rng, images=3):
    ref = np.clip(rng.uniform(0.05, 0.9, (24, 3)), 0, 1)
    ref[18:] = np.linspace(0.9, 0.03, 6)[:, None] * np.array([0.95, 1.0, 1.08])
    rows = []
    for i in range(images):
        m = np.eye(3) + 0.08 * rng.normal(size=(3, 3))
        got = np.clip(ref @ m.T * (0.8 + 0.1 * i) + 0.005 * rng.normal(size=ref.shape), 0.001, 1)
        rows += [(i, k + 1, *map(float, got[k]), *map(float, ref[k])) for k in range(24)]
    return spark.createDataFrame(rows, "image_id int, patch_no int, c0 double, c1 double, c2 double, r0 double, r1 double, r2 double")


def test_fold_never_gets_worse_on_gated_steps(spark, rng):
    pairs = chart(spark, rng)
    best, report, params = plan.calibrate(pairs)
    rows = report.collect()
    order = ["decode", *[s.name for s in cal.STEPS]]
    for i in range(3):
        seq = sorted((r for r in rows if r["image_id"] == i), key=lambda r: order.index(r["step"]))
        best_so_far = seq[0]["error"]
        for r in seq[1:]:
            assert r["applied"] == (r["error"] is not None and r["error"] <= best_so_far)
            if r["applied"]:
                best_so_far = r["error"]
        assert best_so_far < seq[0]["error"]
    final = {r["image_id"]: r["error"] for r in plan.measure(best, ["image_id"]).collect()}
    replayed = plan.replay(pairs, params, "image_id")
    for r in plan.measure(replayed, ["image_id"]).collect():
        assert r["error"] == pytest.approx(final[r["image_id"]], abs=1e-6)


def test_replay_leaves_images_without_parameters_alone(spark, rng):
    pairs = chart(spark, rng)
    params = {"wls": cal.fit_wls_gain(pairs.where("image_id = 0"), ["image_id"])}
    out = plan.replay(pairs, params, "image_id")
    gap = out.alias("a").join(pairs.alias("b"), ["image_id", "patch_no"]).groupBy("image_id").agg(F.max(F.abs(F.col("a.c0") - F.col("b.c0"))).alias("d"))
    d = {r["image_id"]: r["d"] for r in gap.collect()}
    assert d[0] > 0 and d[1] == 0 and d[2] == 0


def test_ridge_matches_direct_cross_validation(spark, rng):
    pairs = chart(spark, rng, 1)
    got = cal.fit_ridge(pairs, ["image_id"]).first()
    pdf = pairs.toPandas().sort_values("patch_no")
    x, y = pdf[["c0", "c1", "c2"]].to_numpy(), pdf[["r0", "r1", "r2"]].to_numpy()
    folds = np.split(np.arange(24), np.cumsum([5, 5, 5, 5]))
    scores = []
    for a in cal.RIDGE_PENALTIES:
        s = []
        for f in folds:
            tr = np.setdiff1d(np.arange(24), f)
            w = np.linalg.solve(x[tr].T @ x[tr] + a * np.eye(3), x[tr].T @ y[tr])
            rss = ((y[f] - x[f] @ w) ** 2).sum(0)
            s.append(np.mean(1 - rss / ((y[f] - y[f].mean(0)) ** 2).sum(0)))
        scores.append(np.mean(s))
    a = cal.RIDGE_PENALTIES[int(np.argmax(scores))]
    assert got["alpha"] == pytest.approx(a)
    assert np.allclose(got["coef"], np.linalg.solve(x.T @ x + a * np.eye(3), x.T @ y).T.ravel(), atol=1e-8)


def test_circle_fits(spark, rng):
    t = rng.uniform(0, 2 * np.pi, 300)
    pts = [(float(50 + 20 * np.cos(a)), float(30 + 20 * np.sin(a))) for a in t]
    df = spark.createDataFrame(pts, "x double, y double")
    r = fits.fit_circle(df.withColumn("g", F.lit(0)), ["g"]).first()
    assert np.allclose([r["cx"], r["cy"], r["r"]], [50, 30, 20], atol=1e-9)
    arc = spark.createDataFrame([(float(50 + 20 * np.cos(a) + 0.01 * rng.normal()), float(30 + 20 * np.sin(a))) for a in np.linspace(0, 1.2, 60)], "x double, y double")
    p, cost = fits.fit_circle_geometric(arc)
    assert np.allclose(p, [50, 30, 20], atol=1.0) and cost < 0.1


def test_bounded_nonlinear_fit(spark):
    x = np.linspace(0, 2, 50)
    df = spark.createDataFrame([(float(a), float(2 * np.exp(-1.5 * a))) for a in x], "x double, y double")
    c = F.col("x")
    p, cost = fits.nlls_fit(df, lambda a: a[0] * F.exp(-a[1] * c), lambda a: [F.exp(-a[1] * c), -a[0] * c * F.exp(-a[1] * c)], "y", [1.0, 1.0], [0.0, 0.0], [10.0, 5.0])
    assert np.allclose(p, [2, 1.5], atol=1e-4) and cost < 1e-8


def test_refine_lights_improves_the_fit(spark, rng):
    from gesso.operators import relief as rl

    true = rng.normal(size=(6, 3)) * [0.4, 0.4, 0.1] + [0, 0, 1]
    true /= np.linalg.norm(true, axis=1)[:, None]
    n = rng.normal(size=(150, 3)) * [0.2, 0.2, 0.1] + [0, 0, 1]
    n /= np.linalg.norm(n, axis=1)[:, None]
    obs = spark.createDataFrame([(i, k + 1, float(0.8 * n[i] @ true[k])) for i in range(150) for k in range(6)], "pixel int, light_id int, intensity double")
    guess = true + 0.05 * rng.normal(size=true.shape)
    guess /= np.linalg.norm(guess, axis=1)[:, None]
    lights = spark.createDataFrame([(k + 1, *map(float, guess[k])) for k in range(6)], "light_id int, lx double, ly double, lz double")
    err = lambda ls: rl.photometric_stereo(obs, ls, ["pixel"]).agg(F.avg("error")).first()[0]
    assert err(fits.refine_lights(obs, lights, ["pixel"], 3)) < err(lights)
