"""The provided tables read as imaging tables (Spark side of ``sqltext``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gesso.queries.sqltext import LIGHT_ROWS
from gesso.registry import Tables
from gesso.session import fixed


def patches(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        k.alias("patch_id"),
        (k % 24 + 1).cast("int").alias("patch_no"),
        F.col("p_brand").alias("step"),
        F.col("p_type").alias("image_id"),
        (0.05 + 0.9 * (size / 51.37)).alias("c0"),
        (0.05 + 0.9 * ((k * 37 % 101) / 100.73)).alias("c1"),
        (0.05 + 0.9 * ((k * 61 + size * 13) % 103 / 102.91)).alias("c2"),
    )


def reference(t: Tables) -> DataFrame:
    """24 rows whatever the table size: one per patch number."""
    return patches(t).groupBy("patch_no").agg(
        F.avg("c0").alias("r0"), F.avg("c1").alias("r1"), F.avg("c2").alias("r2")
    )


def observations(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("pixel"),
        F.col("l_linenumber").cast("int").alias("light_id"),
        (F.col("l_extendedprice") / 110000.0).alias("intensity"),
    )


def lights(t: Tables) -> DataFrame:
    return fixed(t.spark, LIGHT_ROWS, "light_id int, lx double, ly double, lz double")


def grid(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        F.floor(k / 4000).cast("int").alias("image_id"),
        F.floor(k % 4000 / 40).cast("int").alias("y"),
        (k % 40).cast("int").alias("x"),
        (F.col("o_totalprice") / 499979.7).alias("v"),
    )


def normals(t: Tables) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    raw = t.orders.select(
        F.floor(k / 4000).cast("int").alias("image_id"),
        F.floor(k % 4000 / 40).cast("int").alias("y"),
        (k % 40).cast("int").alias("x"),
        (F.sin(price / 9000.0) * 0.6).alias("nx"),
        (F.cos(price / 7000.0) * 0.5).alias("ny"),
        F.lit(1.0).alias("nz"),
    )
    n = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return raw.select("image_id", "y", "x", *[(F.col(c) / n).alias(c) for c in ("nx", "ny", "nz")])


def rounded(digits: int = 5, **columns):
    """Aliased, rounded output columns."""
    return [F.round(v, digits).alias(k) for k, v in columns.items()]


class Cols:
    """A tuple of columns that is resolved when used, not when imported."""

    def __init__(self, *names: str):
        self.names = names

    def __iter__(self):
        return iter([F.col(n) for n in self.names])

    def __getitem__(self, i: int):
        return F.col(self.names[i])

    def __len__(self) -> int:
        return len(self.names)
