"""Session logs, step errors and batch outcomes as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gesso.operators.scans import running

LINE_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) - ([A-Z]+) - (.*)$"
# both "Steps.NAME" and plain names occur
STEP_PATTERN = r"Current DE00 at step ([\w.]+): (\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
SKIP_PATTERN = r"The step ([\w.]+) didn't improve DE00"
PLUGIN_PATTERN = r"Plugin (\w+) loaded successfully"
TAKEN_PATTERN = r"Time taken: (\d+\.\d+) seconds"
#: stage name -> (start text, end text)
STAGES = {
    "raw_decode": ("Decoding RAW file...", "RAW file decoded successfully"),
    "flat_field": ("Applying flat-field correction...", "Flat-field correction applied"),
}


def parse_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds ts, level and message; null where a line has another form."""
    def part(i: int) -> Column:
        return F.when(F.col(line).rlike(LINE_PATTERN), F.regexp_extract(line, LINE_PATTERN, i))

    return df.withColumns({"ts": F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss"), "level": part(2), "message": part(3)})


def format_line(ts: Column, level: Column, message: Column) -> Column:
    return F.concat_ws(" - ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), level, message)


def _matched(message: Column, pattern: str, group: int) -> Column:
    return F.when(message.rlike(pattern), F.regexp_extract(message, pattern, group))


def step_events(lines: DataFrame) -> DataFrame:
    """Adds step, error, skipped_step, plugin and taken_s to parsed lines."""
    m = F.col("message")
    return lines.withColumns(
        {
            "step": _matched(m, STEP_PATTERN, 1),
            "error": _matched(m, STEP_PATTERN, 2).cast("double"),
            "skipped_step": _matched(m, SKIP_PATTERN, 1),
            "plugin": _matched(m, PLUGIN_PATTERN, 1),
            "taken_s": _matched(m, TAKEN_PATTERN, 1).cast("double"),
        }
    )


def log_report(lines: DataFrame, job: str, order: Sequence[str]) -> DataFrame:
    """One row per job: counts, last error, stage durations, total time.

    ``order`` continues the timestamp as a tie-break. A stage lasts from its
    latest start line to the end line; several runs of a stage add up.
    """
    rows = step_events(lines)
    m = F.col("message")
    starts = {f"_s_{k}": F.when(m.contains(a), F.unix_timestamp("ts")) for k, (a, _) in STAGES.items()}
    rows = running(
        rows.withColumns(starts), [job], ["ts", *order],
        [(f"_b_{k}", "max", f"_s_{k}", False) for k in STAGES],
    )
    spent = [
        F.sum(F.when(m.contains(b), F.unix_timestamp("ts") - F.col(f"_b_{k}"))).alias(f"{k}_s")
        for k, (_, b) in STAGES.items()
    ]
    last = F.struct("ts", *order)
    return rows.groupBy(job).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("plugin").alias("plugins"),
        F.count("step").alias("steps"),
        F.count("skipped_step").alias("skipped"),
        F.max_by("error", F.when(F.col("error").isNotNull(), last)).alias("last_error"),
        F.max("taken_s").alias("taken_s"),
        *spent,
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("total_s"),
    )


def accept_if_not_worse(df: DataFrame, keys: Sequence[str], order: Sequence[str], error: str, gated: Column) -> DataFrame:
    """Adds best_before, accepted and best_after to a series of step errors.

    A gated step is accepted when its error is not above the best so far. An
    ungated step is always accepted and becomes the best, better or not. So
    the best is the minimum since the last ungated step.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn("_free", F.when(gated, 0).otherwise(1))
    rows = running(rows, keys, order, [("_segment", "sum", "_free", True)])
    rows = running(rows, [*keys, "_segment"], order, [("best_before", "min", error, False)])
    best, e = F.col("best_before"), F.col(error)
    ok = (F.col("_free") == 1) | best.isNull() | (e <= best)
    return rows.withColumns({"accepted": ok, "best_after": F.when(ok, e).otherwise(best)}).drop("_free", "_segment")


def progress(lines: DataFrame, job: str, expected: int, order: Sequence[str]) -> DataFrame:
    """Percentage of expected information lines per job and the last error value."""
    rows = step_events(lines)
    last = F.struct("ts", *order)
    info = F.count(F.when(F.col("level") == "INFO", 1))
    return rows.groupBy(job).agg(
        F.least(info * 100.0 / expected, F.lit(100.0)).alias("percent"),
        F.max_by("error", F.when(F.col("error").isNotNull(), last)).alias("last_error"),
    )


def batch_outcome(results: DataFrame) -> DataFrame:
    """Counts per status of a ``(path, status, error)`` table."""
    return results.groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), F.count("error").alias("errors"), F.min("error").alias("first_error")
    )


def stage_timings(events: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str = "ts") -> DataFrame:
    """Seconds since the job began and since the previous stage."""
    keys, order = list(keys), list(order)
    rows = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = running(rows, keys, [ts, *order], [("_first", "min", "_us", True), ("_prev", "max", "_us", False)])
    return rows.withColumns(
        {
            "absolute_s": (F.col("_us") - F.col("_first")) / 1e6,
            "relative_s": (F.col("_us") - F.coalesce("_prev", "_us")) / 1e6,
        }
    ).drop("_us", "_first", "_prev")
