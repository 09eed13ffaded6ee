import numpy as np
from pyspark.sql import functions as F

from gesso.operators import relief as r

LIGHTS = [(1, 0.0, 0.0, 1.0), (2, 0.5, 0.0, 0.866), (3, -0.5, 0.0, 0.866), (4, 0.0, 0.5, 0.866)]
SCHEMA = "light_id int, lx double, ly double, lz double"


def hemisphere(n=10):
    y, x = np.mgrid[0:n, 0:n]
    u, v = (x - n / 2 + 0.5) / (0.8 * n), (y - n / 2 + 0.5) / (0.8 * n)
    z = np.sqrt(np.maximum(1 - u**2 - v**2, 0))
    return np.dstack([u, v, z]) / np.sqrt(u**2 + v**2 + z**2)[..., None]


def observed(spark, normals, rho=0.7, noise=None):
    rows = []
    flat = normals.reshape(-1, 3)
    for i, nrm in enumerate(flat):
        for lid, *l in LIGHTS:
            v = max(0.0, rho * float(nrm @ np.array(l)))
            rows.append((i, lid, v + (0 if noise is None else float(noise[i, lid - 1]))))
    return spark.createDataFrame(rows, "pixel int, light_id int, intensity double"), flat


def test_lambertian_round_trip(spark):
    obs, flat = observed(spark, hemisphere())
    out = r.photometric_stereo(obs, spark.createDataFrame(LIGHTS, SCHEMA), ["pixel"]).collect()
    assert len(out) > 80
    for p in out:
        if p["n_lights"] == 4:
            assert np.allclose([p["nx"], p["ny"], p["nz"]], flat[p["pixel"]], atol=1e-6) and abs(p["rho"] - 0.7) < 1e-6 and p["error"] < 1e-6


def test_coplanar_lights_give_minimum_norm(spark, rng):
    lights = LIGHTS[:3]
    vals = rng.uniform(0.2, 0.9, (12, 3))
    obs = spark.createDataFrame([(i, lid, float(vals[i, lid - 1])) for i in range(12) for lid in (1, 2, 3)], "pixel int, light_id int, intensity double")
    out = r.photometric_stereo(obs, spark.createDataFrame(lights, SCHEMA), ["pixel"]).collect()
    a = np.array([l[1:] for l in lights])
    for p in out:
        b = np.linalg.lstsq(a, vals[p["pixel"]], rcond=None)[0]
        assert not p["full_rank"]
        assert np.allclose(np.array([p["nx"], p["ny"], p["nz"]]) * p["rho"], b, atol=1e-9)


def test_too_few_distinct_lights_are_dropped(spark):
    obs = spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.6), (0, 2, 0.5), (0, 3, 0.01)], "pixel int, light_id int, intensity double")
    assert r.photometric_stereo(obs, spark.createDataFrame(LIGHTS, SCHEMA), ["pixel"]).count() == 0


def test_robust_normals_match_a_loop(spark, rng):
    noise = 0.1 * rng.normal(size=(100, 4))
    obs, flat = observed(spark, hemisphere(), noise=noise)
    got = {p["pixel"]: p for p in r.robust_normals(obs, spark.createDataFrame(LIGHTS, SCHEMA), ["pixel"]).collect()}
    l = np.array([x[1:] for x in LIGHTS])
    close = 0
    for i, nrm in enumerate(flat):
        inten = np.maximum(0, 0.7 * l @ nrm) + noise[i]
        w = np.ones(4)
        for _ in range(3):
            b = np.linalg.lstsq(l * w[:, None], inten * w, rcond=None)[0]
            w = 1 / (np.abs(inten - l @ b) + 1e-6)
            w = w / w.sum() * 4
        v = np.array([got[i]["nx"], got[i]["ny"], got[i]["nz"]]) * got[i]["rho"]
        close += np.allclose(v, b, atol=1e-3)
    # weights span six decades, so a few pixels differ in the last digits kept
    assert close >= 95


def test_light_strength_recovered(spark):
    obs, _ = observed(spark, hemisphere())
    lights = spark.createDataFrame(LIGHTS, SCHEMA)
    s = r.photometric_stereo(obs, lights, ["pixel"]).where("n_lights = 4").select("pixel", "rho", "nx", "ny", "nz")
    scaled = obs.withColumn("intensity", F.col("intensity") * (1 + 0.1 * F.col("light_id")))
    for row in r.light_strength(scaled, lights, s, ["pixel"]).collect():
        assert abs(row["strength"] - (1 + 0.1 * row["light_id"])) < 1e-6


def test_reorder_is_a_permutation(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 9)], "light_id int")
    got = [x["light_id"] for x in r.reorder_lights(df.withColumn("o", F.col("light_id"))).orderBy("light_id").collect()]
    assert got == list(range(1, 9))
    moved = {x["o"]: x["light_id"] for x in r.reorder_lights(df.withColumn("o", F.col("light_id"))).collect()}
    assert moved[4] == 1 and moved[1] == 2 and moved[8] == 5
