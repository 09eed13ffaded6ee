"""Order-dependent helpers that never need one task per key.

* ``running``: prefix aggregates along an order, for keys of any size.
* ``exact_quantiles``: interpolated percentiles by counting, not sorting.
* ``least_squares``: one pass of normal sums and a small solve per group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gesso.session import cut, lookup

_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """Add ``_chunk``: consecutive, similar-sized pieces of the (keys, order) sequence.

    Range partitioning includes the order columns, so a key that holds a third
    of the rows is spread over a third of the chunks. The result is written
    out, which pins the chunk numbers whatever happens to an executor.
    """
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in [*keys, *order]])
    return cut(ranged.withColumn("_chunk", F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[tuple[str, str, str, bool]],
    chunks: int | None = None,
) -> DataFrame:
    """Prefix aggregates per key.

    ``specs`` holds ``(output, kind, column, inclusive)`` with kind one of
    sum, count, min, max. Work is two-level: a window inside each chunk plus
    the combined totals of the earlier chunks of the same key. A chunk border
    cuts at most one key, so there are fewer carried totals than chunks and
    that side is safe to broadcast.
    """
    keys, order = list(keys), list(order)
    rows = ordered_chunks(df, keys, order, chunks)
    totals = rows.groupBy(*keys, "_chunk").agg(
        *[_FIRST[kind](column).alias(f"_t{i}") for i, (_, kind, column, _) in enumerate(specs)]
    )
    before = (
        Window.partitionBy(*keys, F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_chunk").alias("_kc"),
        F.row_number().over(Window.partitionBy(*keys, F.lit(0)).orderBy("_chunk")).alias("_nth"),
        *[_MERGE[kind](f"_t{i}").over(before).alias(f"_p{i}") for i, (_, kind, _, _) in enumerate(specs)],
    ).where("_nth > 1")
    same = F.col("_chunk") == F.col("_kc")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(F.broadcast(carried), same, "left")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    out = joined
    for i, (name, kind, column, inclusive) in enumerate(specs):
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        local = _FIRST[kind](column).over(frame)
        out = out.withColumn(name, _COMBINE[kind](F.col(f"_p{i}"), local))
    helpers = ["_chunk", "_kc", "_nth", *[f"_k{i}" for i in range(len(keys))], *[f"_p{i}" for i in range(len(specs))]]
    return out.drop(*helpers)


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Row number over the whole table (1-based) without a single-task sort."""
    numbered = df.withColumn("_one", F.lit(1))
    return running(numbered, [], order, [(name, "count", "_one", True)]).drop("_one")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    bins: int = 4096,
    settle: int = 1_000_000,
) -> DataFrame:
    """Interpolated percentiles, one row per key: ``keys, q0, q1, ...``.

    Ranks are located by counting rows per equal-width bin of the interval
    that still contains them, narrowing until no interval holds more than
    ``settle`` rows (or only equal values); then distinct values of that
    interval are counted. All shuffled data are counts. NaN and null are
    ignored.
    """
    keys = list(keys)
    on = keys or ["_g"]
    src = df.select(*keys, F.col(value).cast("double").alias("_v"))
    src = src.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not keys:
        src = src.withColumn("_g", F.lit(0))
    stats = src.groupBy(*on).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    targets = (
        stats.withColumn("_w", F.explode(wanted))
        .withColumn("_pos", F.col("_w.p") * (F.col("_n") - 1))
        .withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
        .select(
            *on, F.col("_w.i").alias("_i"), "_pos", "_r", "_lo", "_hi",
            F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_c"),
        )
    )
    targets = cut(targets)
    for _ in range(64):
        crowded = targets.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_c")))).first()[0]
        if crowded is None or crowded <= settle:
            break
        ivals = lookup(targets.select(*on, "_lo", "_hi").distinct())
        step = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins
        bin_no = F.when(F.col("_lo") < F.col("_hi"), F.least(F.floor(step), F.lit(bins - 1))).otherwise(0)
        counts = (
            src.join(ivals, on)
            .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
            .groupBy(*on, "_lo", "_hi", bin_no.alias("_bin"))
            .agg(F.count("_v").alias("_bc"), F.min("_v").alias("_bl"), F.max("_v").alias("_bh"))
        )
        upto = Window.partitionBy(*on, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_cum", F.sum("_bc").over(upto) - F.col("_bc"))
        inside = (F.col("_r") - F.col("_below")).between(F.col("_cum"), F.col("_cum") + F.col("_bc") - 1)
        targets = cut(
            targets.drop("_c")
            .join(counts, [*on, "_lo", "_hi"])
            .where(inside)
            .select(
                *on, "_i", "_pos", "_r", F.col("_bl").alias("_lo"), F.col("_bh").alias("_hi"),
                (F.col("_below") + F.col("_cum")).alias("_below"), F.col("_bc").alias("_c"),
            )
        )
    ivals = lookup(targets.select(*on, "_lo", "_hi").distinct())
    values = (
        src.join(ivals, on)
        .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*on, "_lo", "_hi", "_v")
        .agg(F.count("_v").alias("_vc"))
    )
    upto = Window.partitionBy(*on, "_lo", "_hi").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_cum", F.sum("_vc").over(upto) - F.col("_vc"))
    inside = (F.col("_r") - F.col("_below")).between(F.col("_cum"), F.col("_cum") + F.col("_vc") - 1)
    found = targets.join(values, [*on, "_lo", "_hi"]).where(inside)
    ends = found.groupBy(*on, "_i").agg(
        F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.max("_pos").alias("_pos")
    )
    ends = ends.withColumn("_q", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos")))
    out = ends.groupBy(*on).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(probs))]
    )
    return out if keys else out.drop("_g")


def _solve_stack(grams: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """Solve a stack of small symmetric systems; singular ones by pseudo-inverse."""
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", grams), 1e-300))
    scaled = grams / scale[:, :, None] / scale[:, None, :]
    inverse = np.linalg.pinv(scaled, rcond=1e-13, hermitian=True)
    solution = inverse @ (rights / scale[:, :, None])
    return solution / scale[:, :, None]


def solver(features: int, targets: int):
    """Pandas UDF: flat upper-triangle sums and right-hand sums to coefficients.

    The result is target-major: the coefficients of target 0, then target 1.
    """
    rows, cols = np.triu_indices(features)

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, right: pd.Series) -> pd.Series:
        if len(gram) == 0:
            return pd.Series([], dtype=object)
        flat = np.stack([np.asarray(g, dtype=float) for g in gram])
        mats = np.zeros((len(flat), features, features))
        mats[:, rows, cols] = flat
        mats[:, cols, rows] = flat
        rhs = np.stack([np.asarray(r, dtype=float) for r in right]).reshape(len(flat), targets, features)
        solution = _solve_stack(mats, rhs.transpose(0, 2, 1)).transpose(0, 2, 1)
        return pd.Series(list(solution.reshape(len(flat), -1)))

    return solve


def normal_sums(
    df: DataFrame, keys: Sequence[str], features: Sequence[Column], targets: Sequence[Column], weight: Column | None = None
) -> DataFrame:
    """One aggregate per group: ``_gram`` (upper triangle) and ``_right``."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    k = len(features)
    named = df.select(
        *keys,
        *[f.cast("double").alias(f"_f{i}") for i, f in enumerate(features)],
        *[t.cast("double").alias(f"_y{i}") for i, t in enumerate(targets)],
        w.alias("_w"),
    )
    gram = [F.sum(F.col("_w") * F.col(f"_f{i}") * F.col(f"_f{j}")) for i in range(k) for j in range(i, k)]
    right = [F.sum(F.col("_w") * F.col(f"_y{m}") * F.col(f"_f{i}")) for m in range(len(targets)) for i in range(k)]
    flat = named.groupBy(*keys).agg(
        *[g.alias(f"_g{i}") for i, g in enumerate(gram)],
        *[r.alias(f"_r{i}") for i, r in enumerate(right)],
        F.count(F.lit(1)).alias("_rows"),
    )
    return flat.where("_rows > 0").select(
        *keys,
        F.array(*[f"_g{i}" for i in range(len(gram))]).alias("_gram"),
        F.array(*[f"_r{i}" for i in range(len(right))]).alias("_right"),
        "_rows",
    )


def least_squares(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[Column],
    targets: Sequence[Column],
    weight: Column | None = None,
    name: str = "coef",
) -> DataFrame:
    """Weighted linear fit per group: ``keys, coef`` (target-major array)."""
    sums = normal_sums(df, keys, features, targets, weight)
    solve = solver(len(features), len(targets))
    return sums.select(*keys, solve("_gram", "_right").alias(name))


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join per-group values; a one-row table becomes a scalar subquery."""
    keys = list(keys)
    if keys:
        return df.join(lookup(small), keys, "left")
    one = small.select(F.struct(*small.columns).alias("_s")).scalar()
    return df.withColumn("_s", one).select("*", *[F.col("_s")[c].alias(c) for c in small.columns]).drop("_s")


def linear_value(coef: str | Column, features: Sequence[Column], target: int = 0) -> Column:
    """Dot product of fitted coefficients with feature expressions."""
    coef = F.col(coef) if isinstance(coef, str) else coef
    k = len(features)
    total = None
    for i, f in enumerate(features):
        term = coef.getItem(target * k + i) * f
        total = term if total is None else total + term
    return total
