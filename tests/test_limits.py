"""What used to be dropped or cut at a limit: lights, pixels, levels, rounds, hypotheses, stream batches."""

import datetime as dt

import numpy as np
import pytest

from conftest import frame, to_plane
from gesso.operators import grid as gr
from gesso.operators import matching as m
from gesso.operators import mesh, relief
from gesso.plans import graph
from gesso.session import scratch_path
from gesso.sources import documents, tables
from gesso.streaming import feeds


def test_any_light_number_counts(spark):
    def surface(ids):
        lights = spark.createDataFrame([(i, *v) for i, v in zip(ids, [(0.0, 0.0, 1.0), (0.6, 0.0, 0.8), (0.0, 0.6, 0.8), (-0.6, 0.0, 0.8)])], "light_id int, lx double, ly double, lz double")
        obs = spark.createDataFrame([(7, i, 0.5 * v) for i, v in zip(ids, (1.0, 0.8, 0.8, 0.8))] + [(7, ids[0], 0.5), (8, ids[0], 0.5), (8, ids[0], 0.5), (8, ids[1], 0.5)], "pixel int, light_id int, intensity double")
        return relief.photometric_stereo(obs, lights, ["pixel"]).collect()

    for ids in ((1, 2, 3, 4), (1, 65, 129, 2)):
        (r,) = surface(ids)
        assert r["pixel"] == 7 and r["n_lights"] == 4 and r["n_obs"] == 5 and r["rho"] == pytest.approx(0.5) and r["nz"] == pytest.approx(1.0)


def test_many_lamps_share_one_inverse(spark, rng):
    dirs = rng.normal(size=(5000, 3)) * [0.3, 0.3, 0.1] + [0, 0, 1]
    lights = spark.createDataFrame([(i, *map(float, d)) for i, d in enumerate(dirs)], "light_id int, lx double, ly double, lz double")
    n = np.array([0.1, -0.2, 0.6])
    obs = spark.createDataFrame([(1, i, float(d @ n)) for i, d in enumerate(dirs)], "pixel int, light_id int, intensity double")
    r = relief.photometric_stereo_pinv(obs, lights, ["pixel"]).first()
    assert np.allclose([r["nx"] * r["rho"], r["ny"] * r["rho"], r["nz"] * r["rho"]], n)


def test_low_pass_knows_missing_pixels(spark, rng):
    plane = np.ones((40, 50))
    gone = rng.random(plane.shape) < 0.2
    rows = frame(spark, plane).where(" AND ".join(["true", *[f"NOT (y = {y} AND x = {x})" for y, x in np.argwhere(gone)[:60]]]))
    low = to_plane(gr.gaussian_low_pass(rows, ["v"], 2.0, tile=16), "v_low", plane.shape)
    assert np.nanmax(np.abs(low - 1)) < 1e-12 and np.isnan(low).sum() == 60
    values = rng.random((20, 20))
    null = frame(spark, values).selectExpr("image_id", "y", "x", "CASE WHEN x = 3 THEN NULL ELSE v END AS v")
    low = to_plane(gr.gaussian_low_pass(null, ["v"], 1.0), "v_low", values.shape)
    assert np.isnan(low[:, 3]).all() and not np.isnan(np.delete(low, 3, 1)).any()


def test_tiles_smaller_than_their_margin(spark, rng):
    values = rng.random((45, 37))
    done = gr.tile_job(frame(spark, values), "v", lambda p: p, tile=8, overlap=10)
    assert np.allclose(to_plane(done, "v", values.shape), values)
    centre = [r["w"] for r in spark.range(1).select(gr.tile_weight(gr.F.lit(9.5), gr.F.lit(9.5), 8, 10).alias("w")).collect()]
    assert centre == [1.0]


def test_boxes_of_every_size(spark):
    boxes = [(1, i, 0, 0, 2**i, 2**i) for i in range(31)]
    got = {r["patch"]: r["into"] for r in mesh.contained_patches(spark.createDataFrame(boxes, "view int, patch int, x0 int, y0 int, x1 int, y1 int")).collect()}
    assert got == {i: 30 for i in range(30)}


def test_unfinished_rounds_raise(spark):
    costs = spark.createDataFrame([(f, v, ((f * 7 + v * 5) % 11) / 20) for f in range(60) for v in (1, 2, 3)], "face int, view int, cost double")
    edges = spark.createDataFrame([(f, f + 1) for f in range(59)], "f1 int, f2 int")
    with pytest.raises(RuntimeError):
        graph.label_faces(costs, edges, max_rounds=1)
    nodes = spark.createDataFrame([(i,) for i in range(9)], "node int")
    seams = spark.createDataFrame([(i, i + 1, float(i * i % 5)) for i in range(8)], "n1 int, n2 int, d0 double")
    smooth = spark.createDataFrame([(i, i + 2) for i in range(7)], "n1 int, n2 int")
    with pytest.raises(RuntimeError):
        graph.level_seams(nodes, seams, smooth, max_steps=1)


def test_few_inliers_are_found(spark, rng):
    def pair(number, true, n=300):
        p = rng.uniform(0, 1000, (n, 2))
        q = np.stack([0.98 * p[:, 0] - 0.05 * p[:, 1] + 30, 0.05 * p[:, 0] + 0.98 * p[:, 1] - 7], 1) + rng.normal(0, 0.3, (n, 2))
        q[true:] = rng.uniform(0, 1000, (n - true, 2))
        return [(number, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, q))]

    ties = spark.createDataFrame(pair(1, 45) + pair(2, 0, 60), "pair int, no int, x1 double, y1 double, x2 double, y2 double")
    for seed in (7, 8, 9):
        got = {r["pair"]: r for r in m.ransac_similarity(ties, ["pair"], "no", seed=seed).collect()}
        assert got[1]["threshold"] == 3.0 and 40 <= got[1]["inliers"] <= 60
        assert np.allclose([got[1][k] for k in ("a", "b", "tx", "ty")], [0.98, 0.05, 30, -7], atol=1.0)
        assert 2 not in got


def test_stream_order_over_arrow_batches(spark):
    start = dt.datetime(2024, 1, 1)
    ways = ["up", "down", "left", "right"]
    rows = [(1, start + dt.timedelta(seconds=(i * 37) % 60), i, "step", ways[(i * 7) % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "stand int, ts timestamp, seq int, action string, direction string")
    path = scratch_path(spark, "commands")
    df.coalesce(1).write.parquet(path)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        job = feeds.stand_position_stream(spark.readStream.schema(df.schema).parquet(path), 9, 9).writeStream.outputMode("update").format("memory").queryName("ordered").start()
        job.processAllAvailable()
        job.stop()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    last = feeds.stand_positions(df, ["ts", "seq"], 9, 9).orderBy("ts", "seq").collect()[-1]
    got = spark.table("ordered").collect()
    assert [(r["row"], r["col"]) for r in got] == [(last["row"], last["col"])]


def test_append_checks_the_path_only(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    target = str(tmp_path / "target")
    tables.write_if_absent(rows, target, ["k"])
    tables.write_if_absent(rows, target, ["k"])
    assert spark.read.parquet(target).count() == 2
    with pytest.raises(Exception):
        tables.write_if_absent(rows, target, ["no_such_column"])
    assert spark.read.parquet(target).count() == 2


def test_custom_keys_are_escaped(spark, tmp_path):
    df = spark.createDataFrame([("i", {'a"b\\c': "1", "plain": '"x"'})], "image_id string, custom map<string,string>")
    documents.write_params(df, str(tmp_path / "p"))
    import json

    (line,) = [r["value"] for r in spark.read.text(str(tmp_path / "p")).collect()]
    assert json.loads(line) == {"image_id": "i", 'a"b\\c': 1, "plain": "x"}
