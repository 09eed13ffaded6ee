"""Session-log queries over events: one job per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from gesso.operators import sessions as s
from gesso.registry import query
from gesso.streaming import feeds

_MSG = """CASE event_id % 8 WHEN 0 THEN 'Decoding RAW file...' WHEN 1 THEN 'RAW file decoded successfully.'
  WHEN 2 THEN 'Current DE00 at step AnalysisSteps.' || event_type || ': ' || format('{:.4f}', value / 10)
  WHEN 3 THEN 'Current DE00 at step ' || event_type || '_correction: ' || format('{:.4f}', value / 10)
  WHEN 4 THEN 'The step ' || event_type || ' didn''t improve DE00. This step will be skipped'
  WHEN 5 THEN 'Plugin ' || event_type || ' loaded successfully' WHEN 6 THEN 'Applying flat-field correction...' ELSE 'Flat-field correction applied.' END"""
LOG = f"""log AS (SELECT event_id, user_id, date_trunc('second', ts) AS ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  {_MSG} AS message, CASE WHEN event_id % 8 IN (2, 3) THEN CAST(format('{{:.4f}}', value / 10) AS DOUBLE) END AS error FROM events)"""


def log_lines(t):
    """Text lines as a session would write them."""
    e, kind = F.col("event_id") % 8, F.col("event_type")
    number = F.regexp_replace(F.format_number(F.col("value") / 10, 4), ",", "")
    message = (
        F.when(e == 0, "Decoding RAW file...").when(e == 1, "RAW file decoded successfully.")
        .when(e == 2, F.concat(F.lit("Current DE00 at step AnalysisSteps."), kind, F.lit(": "), number))
        .when(e == 3, F.concat(F.lit("Current DE00 at step "), kind, F.lit("_correction: "), number))
        .when(e == 4, F.concat(F.lit("The step "), kind, F.lit(" didn't improve DE00. This step will be skipped")))
        .when(e == 5, F.concat(F.lit("Plugin "), kind, F.lit(" loaded successfully")))
        .when(e == 6, "Applying flat-field correction...").otherwise("Flat-field correction applied."))
    level = F.when(kind == "error", "ERROR").otherwise("INFO")
    return t.events.select("event_id", "user_id", s.format_line(F.col("ts"), level, message).alias("line"))


@query("S14_log_lines", "WITH " + LOG + " SELECT event_id, user_id, ts, level, message FROM log")
def s14(t):
    return s.parse_lines(log_lines(t)).select("event_id", "user_id", "ts", "level", "message")


@query("A47_log_report", "WITH " + LOG + """, b AS (SELECT *, max(CASE WHEN event_id % 8 = 0 THEN epoch(ts) END) OVER w AS d0, max(CASE WHEN event_id % 8 = 6 THEN epoch(ts) END) OVER w AS f0
  FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, count(*) AS lines, count(*) FILTER (event_id % 8 = 5) AS plugins, count(error) AS steps, count(*) FILTER (event_id % 8 = 4) AS skipped,
  arg_max(error, (ts, event_id)) FILTER (error IS NOT NULL) AS last_error, CAST(NULL AS DOUBLE) AS taken_s,
  CAST(sum(CASE WHEN event_id % 8 = 1 THEN epoch(ts) - d0 END) AS BIGINT) AS raw_decode_s, CAST(sum(CASE WHEN event_id % 8 = 7 THEN epoch(ts) - f0 END) AS BIGINT) AS flat_field_s,
  CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS total_s FROM b GROUP BY user_id""")
def a47(t):
    return s.log_report(s.parse_lines(log_lines(t)), "user_id", ["event_id"])


@query("W3_accept_if_not_worse", """WITH e AS (SELECT user_id, event_id, ts, value AS error, event_type <> 'signup' AS gated FROM events),
 g AS (SELECT *, sum(CASE WHEN gated THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM e),
 b AS (SELECT *, min(error) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM g)
SELECT event_id, best_before, NOT gated OR best_before IS NULL OR error <= best_before AS accepted,
  CASE WHEN NOT gated OR best_before IS NULL OR error <= best_before THEN error ELSE best_before END AS best_after FROM b""")
def w3(t):
    rows = t.events.select("user_id", "event_id", "ts", F.col("value").alias("error"), "event_type")
    out = s.accept_if_not_worse(rows, ["user_id"], ["ts", "event_id"], "error", F.col("event_type") != "signup")
    return out.select("event_id", "best_before", "accepted", "best_after")


@query("A53_batch_outcome", """SELECT status, count(*) AS files, count(error) AS errors, min(error) AS first_error FROM (SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN event_type = 'error' THEN 'failed on ' || props END AS error FROM events) GROUP BY status""")
def a53(t):
    bad = F.col("event_type") == "error"
    return s.batch_outcome(t.events.select(
        F.col("event_id").alias("path"), F.when(bad, "error").otherwise("success").alias("status"),
        F.when(bad, F.concat(F.lit("failed on "), "props")).alias("error")))


@query("S26_stage_timings", """SELECT event_id, round((epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 1e6, 3) AS absolute_s,
  round(coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), 0) / 1e6, 3) AS relative_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def s26(t):
    out = s.stage_timings(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["event_id"])
    return out.select("event_id", F.round("absolute_s", 3).alias("absolute_s"), F.round("relative_s", 3).alias("relative_s"))


@query("T2_progress_feed", "WITH " + LOG + """ SELECT user_id, least(count(*) FILTER (level = 'INFO') * 100e0 / 120, 100e0) AS percent,
  arg_max(error, (ts, event_id)) FILTER (error IS NOT NULL) AS last_error FROM log GROUP BY user_id""")
def t2(t):
    out = s.progress(s.parse_lines(log_lines(t)), "user_id", 120, ["event_id"])
    return out.select("user_id", "percent", "last_error")


@query("T5_step_error_stream", "WITH " + LOG + """, e AS (SELECT * FROM log WHERE error IS NOT NULL)
SELECT user_id, count(*) AS steps, min(error) AS best, arg_max(error, (ts, event_id)) AS last_error FROM e GROUP BY user_id""")
def t5(t):
    return feeds.step_errors(s.parse_lines(log_lines(t)), "user_id", ["event_id"])


@query("T1_vibration_ok", """WITH w AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, ts, value FROM events),
 k AS (SELECT user_id, start, avg(value) FILTER (epoch(ts) - epoch(start) >= 600) AS mean, count(*) FILTER (epoch(ts) - epoch(start) >= 600) AS samples FROM w GROUP BY 1, 2)
SELECT user_id AS device, start AS window_start, samples, round(mean, 5) AS mean, coalesce(mean <= 38.7e0, true) AS stable FROM k""")
def t1(t):
    rows = t.events.select(F.col("user_id").alias("device"), "ts", F.col("value").alias("gx"), F.lit(0.0).alias("gy"), F.lit(0.0).alias("gz"))
    out = feeds.vibration_ok(rows, delta="6 hours", threshold=38.7, settle_s=600)
    return out.select("device", "window_start", "samples", F.round("mean", 5).alias("mean"), "stable")


COMMANDS = """cmd AS (SELECT user_id AS stand, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id,
  CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS dr, CASE event_id % 4 WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS dc FROM events)"""


@query("T4_stand_position", "WITH RECURSIVE " + COMMANDS + """, walk AS (SELECT stand, n, event_id, greatest(1, least(5, 1 + dr)) AS row, greatest(1, least(6, 1 + dc)) AS col FROM cmd WHERE n = 1
 UNION ALL SELECT c.stand, c.n, c.event_id, greatest(1, least(5, w.row + c.dr)), greatest(1, least(6, w.col + c.dc)) FROM walk w JOIN cmd c ON c.stand = w.stand AND c.n = w.n + 1)
SELECT event_id, stand, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, chr(CAST(64 + row AS INTEGER)) || col AS label FROM walk""")
def t4(t):
    way = F.element_at(F.array(*map(F.lit, "wsda")), (F.col("event_id") % 4 + 1).cast("int"))
    cmds = t.events.select(F.col("user_id").alias("stand"), "ts", "event_id", F.lit("step").alias("action"), way.alias("direction"))
    return feeds.stand_positions(cmds, ["ts", "event_id"], rows=5, cols=6).select("event_id", "stand", "row", "col", "label")


@query("T4_light_states", """SELECT user_id AS stand, CAST(event_id % 8 + 1 AS INTEGER) AS light_id, arg_max(event_type <> 'error', (ts, event_id)) AS lit FROM events GROUP BY 1, 2""")
def t4_lights(t):
    cmds = t.events.select(F.col("user_id").alias("stand"), "ts", "event_id", (F.col("event_id") % 8 + 1).cast("int").alias("light_id"),
                           (F.col("event_type") != "error").alias("state"))
    return feeds.light_states(cmds, ["ts", "event_id"])
