"""Calibration of many chart images at once, and replay of saved parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gesso.functions import color
from gesso.operators import calibration as cal
from gesso.operators.scans import attach
from gesso.session import cut, fence

FREE_STEPS = ("decode", "flat_field")


def measure(rows: DataFrame, keys: Sequence[str], space: str = "xyz") -> DataFrame:
    """Mean colour error per image."""
    scored = color.add_delta_e(rows, cal.cols(cal.MEASURED), cal.cols(cal.REFERENCE), "de00", space)
    return scored.groupBy(*keys).agg(F.avg("de00").alias("error"))


def calibrate(pairs: DataFrame, key: str = "image_id", steps: Sequence[cal.Step] = tuple(cal.STEPS), space: str = "xyz"):
    """Fold over candidate corrections for all images together.

    Per image a step is kept when its error is not above the best so far;
    otherwise the image keeps its colours and the step has no parameters.
    Returns (colours, report, {step: parameters of accepted images}).
    Patch tables have 24 (or 140) rows per image. Each step ends in a
    checkpoint so that the plan does not grow.
    """
    best = cut(pairs)
    error = cut(measure(best, [key], space))
    report = error.select(key, F.lit("decode").alias("step"), "error", F.lit(True).alias("applied"))
    params = {}
    for step in steps:
        fitted = cut(step.fit(best, [key]))
        trial = cut(step.apply(best, fitted, [key]))
        now = measure(trial, [key], space).withColumnRenamed("error", "_now")
        judged = cut(
            error.join(now, key, "left").withColumn(
                "_ok", F.col("_now").isNotNull() & ~F.isnan("_now") & ((F.col("_now") <= F.col("error")) if step.gated else F.lit(True))
            )
        )
        verdict = judged.select(key, "_ok")
        kept = trial.join(verdict.where("_ok"), key, "left_semi")
        old = best.join(verdict.where("_ok"), key, "left_anti")
        best = cut(kept.select(*pairs.columns).unionByName(old.select(*pairs.columns)))
        params[step.name] = fitted.join(verdict.where("_ok"), key, "left_semi")
        report = report.unionByName(
            judged.select(key, F.lit(step.name).alias("step"), F.col("_now").alias("error"), F.col("_ok").alias("applied"))
        )
        error = judged.select(key, F.when(F.col("_ok"), F.col("_now")).otherwise(F.col("error")).alias("error"))
    return best, report, params


def replay(pixels: DataFrame, params: dict[str, DataFrame], key: str, steps: Sequence[cal.Step] = tuple(cal.STEPS)) -> DataFrame:
    """Apply accepted parameters to the pixels of many images.

    One narrow pipeline over the pixels, no union and no shuffle: parameter
    tables have a row per image and are broadcast if counted small. An image
    without parameters for a step keeps its values there.
    """
    out = pixels
    names = list(pixels.columns)
    for step in steps:
        p = params.get(step.name)
        if p is None:
            continue
        p = cut(p)
        marked = attach(out, p.select(key).withColumn("_has", F.lit(True)), [key])
        kept = marked.withColumns({f"_old{i}": F.col(c) for i, c in enumerate(cal.MEASURED)})
        done = step.apply(kept, p, [key])
        done = done.withColumns({c: F.when(F.col("_has"), F.col(c)).otherwise(F.col(f"_old{i}")) for i, c in enumerate(cal.MEASURED)})
        out = fence(done.select(*names), *cal.MEASURED)
    return out
