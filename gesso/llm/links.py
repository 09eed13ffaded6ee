"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gesso.session import forget, keep


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest value of its neighbourhood."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; ``root`` is the smallest node reachable.

    Nodes are longs. Loops, repeated and reversed links are fine, null ends are
    ignored. A node without links is not in the result. The rounds go on until
    nothing changes; each is written below the shared folder, and the one
    before it is deleted.
    """
    spark = links.sparkSession
    a, b = F.least("a", "b"), F.greatest("a", "b")
    now = keep(links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(a.alias("a"), b.alias("b")).distinct(), "links", tidy=True)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark = tuple(seen)
        new = keep(_small_star(_large_star(now)), "links", tidy=True)
        forget(now)
        now = new
    if mark is None:
        return spark.createDataFrame([], "node long, root long")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
