import datetime as dt

import pytest
from pyspark.sql import functions as F

from gesso.operators import sessions as s
from gesso.session import scratch_path
from gesso.streaming import feeds

T0 = dt.datetime(2024, 1, 1)


def run(stream, mode, name):
    job = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    job.processAllAvailable()
    job.stop()
    return stream.sparkSession.table(name)


def as_stream(spark, df, name):
    path = scratch_path(spark, name)
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def last(rows, key, *order):
    best = {}
    for r in rows:
        k = r[key]
        if k not in best or tuple(r[o] for o in order) >= tuple(best[k][o] for o in order):
            best[k] = r
    return best


def test_vibration_stream_equals_batch(spark):
    rows = [(i % 3, T0 + dt.timedelta(seconds=0.2 * i), 0.01 * (i % 50), 0.5, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "device int, ts timestamp, gx double, gy double, gz double")
    batch = feeds.vibration_ok(df, "5 seconds", 1.15)
    stream = feeds.vibration_ok(as_stream(spark, df, "sensor"), "5 seconds", 1.15, watermark="1 minute")
    got = run(stream, "complete", "vib")
    flat = lambda d: sorted((r["device"], r["window_start"], r["samples"], round(r["mean"], 9), r["stable"]) for r in d.collect())
    assert flat(got) == flat(batch)
    assert {r["stable"] for r in batch.collect()} == {True, False}


def test_window_with_settling_samples_only_is_stable(spark):
    df = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=1), 9.0, 9.0, 9.0)], "device int, ts timestamp, gx double, gy double, gz double")
    r = feeds.vibration_ok(df, "10 seconds", 1.0).first()
    assert r["samples"] == 0 and r["stable"]


def log(spark):
    rows = []
    for job in ("a", "b"):
        for i, e in enumerate((18.2, 17.4, 19.0, 6.2)):
            t = (T0 + dt.timedelta(seconds=10 * i)).strftime("%Y-%m-%d %H:%M:%S")
            rows += [(job, f"{t} - INFO - Current DE00 at step Steps.S{i}: {e + (job == 'b')}"), (job, f"{t} - ERROR - something else")]
    rows.append(("a", "no log line"))
    return spark.createDataFrame(rows, "job string, line string")


def test_progress_and_step_streams_equal_batch(spark):
    df = log(spark)
    lines = s.parse_lines(df)
    for name, fn in (("prog", lambda d: feeds.progress_feed(d, "job", 8)), ("steps", lambda d: feeds.step_errors(d, "job", ["message"]))):
        want = {tuple(r) for r in fn(lines).collect()}
        got = run(fn(s.parse_lines(as_stream(spark, df, name))), "complete", name)
        assert {tuple(r) for r in got.collect()} == want
    best = {r["job"]: r["best"] for r in feeds.step_errors(lines, "job", ["message"]).collect()}
    assert best == {"a": pytest.approx(6.2), "b": pytest.approx(7.2)}


def commands(spark, n=240):
    moves = "wwdsadwwdda"
    rows = [(k % 2 if k % 5 else 0, T0 + dt.timedelta(seconds=k), k, "step", moves[(k * 7) % len(moves)]) for k in range(n)]
    return spark.createDataFrame(rows, "stand int, ts timestamp, seq int, action string, direction string")


@pytest.mark.parametrize("chunks", [1, 7])
def test_stand_positions_match_a_walk_and_the_stream(spark, chunks):
    df = commands(spark)
    got = feeds.stand_positions(df, ["ts", "seq"], 4, 3, chunks).collect()
    at, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["seq"]):
        x, y = at.get(r["stand"], (1, 1))
        dx, dy = feeds.MOVES[r["direction"]]
        at[r["stand"]] = (min(max(x + dx, 1), 4), min(max(y + dy, 1), 3))
        want[r["seq"]] = at[r["stand"]]
    assert {r["seq"]: (r["row"], r["col"]) for r in got} == want
    stream = feeds.stand_position_stream(as_stream(spark, df.coalesce(1), f"cmd{chunks}").coalesce(1), 4, 3)
    out = run(stream, "update", f"stand{chunks}")
    assert set(at) <= {r["stand"] for r in out.collect()}


def test_stream_state_applies_limits_and_flags(spark):
    rows = [(1, T0, 0, "step", "s"), (1, T0, 1, "free", "d"), (1, T0, 2, "step", "w"), (1, T0, 3, "free", "w"), (1, T0, 4, "stop", "")]
    df = spark.createDataFrame(rows, "stand int, ts timestamp, seq int, action string, direction string")
    path = scratch_path(spark, "one")
    df.coalesce(1).write.parquet(path)
    stream = feeds.stand_position_stream(spark.readStream.schema(df.schema).parquet(path), 5, 5)
    r = run(stream, "update", "limits").first()
    assert (r["row"], r["col"], r["moving"]) == (2, 1, False)


def test_accept_if_not_worse_resets_at_free_steps(spark):
    rows = [(1, 0, 5.0, False), (1, 1, 4.0, True), (1, 2, 4.5, True), (1, 3, 9.0, False), (1, 4, 8.0, True), (1, 5, 8.0, True)]
    df = spark.createDataFrame(rows, "job int, n int, e double, gated boolean")
    out = s.accept_if_not_worse(df, ["job"], ["n"], "e", F.col("gated")).orderBy("n").collect()
    assert [r["accepted"] for r in out] == [True, True, False, True, True, True]
    assert [r["best_after"] for r in out] == [5.0, 4.0, 4.0, 9.0, 8.0, 8.0]
    assert last(out, "job", "n")[1]["best_after"] == 8.0
