"""Image statistics and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gesso.operators import grid as gr
from gesso.operators.scans import attach, exact_quantiles


def image_stats(df: DataFrame, value: str, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    v = F.col(value)
    usable = F.when(~F.isnan(v) & ~F.abs(v).eqNullSafe(F.lit(float("inf"))), v)
    return df.groupBy(*keys).agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"),
        F.min(usable).alias("min"), F.max(usable).alias("max"), F.avg(usable).alias("mean"),
        F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)).alias("has_nan"),
        F.coalesce(F.bool_or(F.abs(v) == float("inf")), F.lit(False)).alias("has_inf"),
    )


def bit_depth(top: Column) -> Column:
    """Divider by image maximum: 65535 above 255, else 255."""
    return F.when(top > 255, 65535.0).otherwise(255.0)


def loader_divider(top: Column) -> Column:
    """Divider used when loading: 65536 above 1000, else 255."""
    return F.when(top > 1000, 65536.0).otherwise(255.0)


def scale_bits(df: DataFrame, value: str, keys: Sequence[str], loader: bool = True) -> DataFrame:
    rule = loader_divider if loader else bit_depth
    tops = df.groupBy(*keys).agg(rule(F.max(value)).alias("_d"))
    return attach(df, tops, keys).withColumn(value, F.col(value) / F.col("_d")).drop("_d")


def percentile_normalise(df: DataFrame, value: str, keys: Sequence[str], p: float) -> DataFrame:
    """Divide by the p-th percentile of each image where it is positive."""
    q = exact_quantiles(df, keys, value, [p])
    out = attach(df, q, keys)
    return out.withColumn(value, F.when(F.col("q0") > 0, F.col(value) / F.col("q0")).otherwise(F.col(value))).drop("q0")


def normalise_minmax(df: DataFrame, value: str, keys: Sequence[str], out: str = "scaled") -> DataFrame:
    """To [0,1] by finite minimum and maximum; NaN to 0, infinities to the ends."""
    v = F.col(value)
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    ends = df.groupBy(*keys).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    rows = attach(df, ends, keys)
    share = F.when(F.col("_hi") > F.col("_lo"), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    share = F.when(v.isNull() | F.isnan(v), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    return rows.withColumn(out, share).drop("_lo", "_hi")


def normalise_by_max(df: DataFrame, value: str, keys: Sequence[str], out: str = "scaled") -> DataFrame:
    tops = df.groupBy(*keys).agg(F.max(value).alias("_hi"))
    return attach(df, tops, keys).withColumn(out, F.when(F.col("_hi") > 0, F.col(value) / F.col("_hi")).otherwise(0.0)).drop("_hi")


def quantise(share: Column, bits: int = 8) -> Column:
    """Truncate a [0,1] share to an integer channel."""
    return F.floor(share * (65535 if bits == 16 else 255)).cast("int")


def images_mean(df: DataFrame, value: str) -> DataFrame:
    """Per-pixel mean over images."""
    return df.groupBy("y", "x").agg(F.avg(value).alias(value))


def psnr(a: DataFrame, b: DataFrame, value: str, peak: float = 1.0) -> DataFrame:
    """Per image; non-finite pixels give a null result with ``error`` set."""
    both = a.select(*gr.KEY, F.col(value).alias("_a")).join(b.select(*gr.KEY, F.col(value).alias("_b")), gr.KEY)
    gap = F.col("_a") - F.col("_b")
    bad = F.isnan(gap) | (F.abs(gap) == float("inf"))
    out = both.groupBy("image_id").agg(F.avg(F.when(~bad, gap * gap)).alias("mse"), F.bool_or(bad).alias("_bad"))
    value_db = F.when(F.col("mse") > 0, 10 * F.log10(peak * peak / F.col("mse")))
    return out.select(
        "image_id", "mse", F.when(~F.col("_bad"), value_db).alias("psnr"), F.when(F.col("_bad"), "non-finite pixels").alias("error")
    )


def ssim(a: DataFrame, b: DataFrame, value: str, peak: float = 1.0, size: int = 7, tile: int = gr.TILE) -> DataFrame:
    """Mean structural similarity over windows that lie inside the image."""
    x, y = F.col("wa"), F.col("wb")
    both = a.select(*gr.KEY, F.col(value).alias("wa")).join(b.select(*gr.KEY, F.col(value).alias("wb")), gr.KEY)
    both = both.withColumns({"waa": x * x, "wbb": y * y, "wab": x * y})
    m = gr.box_means(both, ["wa", "wb", "waa", "wbb", "wab"], size, "none", tile)
    n = size * size
    unbiased = n / (n - 1)
    ma, mb = F.col("wa_mean"), F.col("wb_mean")
    va = unbiased * (F.col("waa_mean") - ma * ma)
    vb = unbiased * (F.col("wbb_mean") - mb * mb)
    cov = unbiased * (F.col("wab_mean") - ma * mb)
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    s = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    r = size // 2
    sized = gr.with_dims(m)
    whole = F.col("y").between(r, F.col("_h") - 1 - r) & F.col("x").between(r, F.col("_w") - 1 - r)
    return sized.where(whole).groupBy("image_id").agg(F.avg(s).alias("ssim"))


# Weights of the noise estimate by number of channels averaged.
NOISE_WEIGHTS = (0.8, 0.852, 0.323)


def noise_level(df: DataFrame, keys: Sequence[str], channels: Sequence[str], tile: int = gr.TILE) -> DataFrame:
    """Noise sigma per patch and channel: median absolute diagonal detail of
    2x2 blocks / 0.6745, and the weighted mean over three channels.

    The detail filter is the orthonormal 2x2 one (a - b - c + d) / 2.
    """
    b = gr.blocks(df, channels, tile).where((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0))
    b = b.where((F.col("y") < F.col("_h") - 1) & (F.col("x") < F.col("_w") - 1))
    detail = lambda c: F.abs(F.col(f"{c}_00") - F.col(f"{c}_01") - F.col(f"{c}_10") + F.col(f"{c}_11")) / 2
    long = b.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), detail(c).alias("d")) for c in channels])).alias("e"))
    med = exact_quantiles(long.select(*keys, "e.channel", "e.d"), [*keys, "channel"], "d", [0.5])
    return med.withColumn("sigma", F.col("q0") / 0.6745).drop("q0")


def combined_noise(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean channel sigma over patches, then the weighted sum of channels."""
    per = levels.groupBy(*keys, "channel").agg(F.avg("sigma").alias("sigma"))
    order = {f"c{i}": w for i, w in enumerate(NOISE_WEIGHTS)}
    weight = F.lit(0.0)
    for c, w in order.items():
        weight = F.when(F.col("channel") == c, w).otherwise(weight)
    return per.groupBy(*keys).agg((F.sum(F.col("sigma") * weight) / float(np.sum(NOISE_WEIGHTS))).alias("sigma"))
