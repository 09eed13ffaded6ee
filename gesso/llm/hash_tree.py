"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards, each with a weight. A row descends from
the root: at each level every child draws ``-ln(u) / weight`` with ``u`` hashed
from the row's id and the child's name, and the smallest draw wins. A child is
won in proportion to its weight, and a changed weight moves rows only to or
from that child: nothing moves between its siblings, and nothing inside
subtrees whose weights stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gesso.llm.words import unit_draw
from gesso.session import keep


@dataclass(frozen=True)
class Shard:
    """A leaf: its number, the names above it and the weights on the way."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Shard]:
    """Shards 0 .. n-1 of weight one in racks of ``per_rack`` and regions of ``racks`` racks.

    ``shards`` must fill whole regions, so that all weights are in proportion.
    """
    if shards < 1 or shards % (per_rack * racks):
        raise ValueError("shards must fill whole regions; add single ones with grow()")
    return [Shard(s, f"g{s // (per_rack * racks)}", f"g{s // (per_rack * racks)}k{s // per_rack % racks}") for s in range(shards)]


def grow(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` with one more shard in a region of its own.

    The other regions keep their weights, so rows move into the new shard only.
    """
    n = max(s.shard for s in tree) + 1
    return [*tree, Shard(n, f"g+{n}", f"g+{n}k", weight)]


def _levels(tree: Sequence[Shard]) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level: parent name to its (child, weight), inner weights being sums."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for s in tree:
        if s.weight <= 0:
            raise ValueError("weights must be positive")
        for level, parent, child in zip(levels, ("", s.region, s.rack), (s.region, s.rack, str(s.shard)), strict=True):
            level.setdefault(parent, {}).setdefault(child, 0.0)
            level[parent][child] += s.weight
    return [{p: list(c.items()) for p, c in level.items()} for level in levels]


def _won(key: Column, children: list[tuple[str, float]], seed: str) -> Column:
    """Name of the child with the smallest draw; equal draws go to the smaller name."""
    if len(children) == 1:
        return F.lit(children[0][0])
    draws = [F.struct((-F.log(unit_draw(F.lit(seed), F.lit(c), key)) / F.lit(w)).alias("draw"), F.lit(c).alias("child")) for c, w in children]
    return F.least(*draws)["child"]


def descend(frame: DataFrame, key: Column, tree: Sequence[Shard], prefix: str, seed: str = "tree") -> DataFrame:
    """``frame`` with ``<prefix>region``, ``<prefix>rack`` and ``<prefix>shard``.

    Each level is a projection of its own; only the children of the node won
    so far draw. The tree is a parameter, as large as the cluster, not as the data.
    """
    parent, names = F.lit(""), ("region", "rack", "shard")
    for name, level in zip(names, _levels(tree), strict=True):
        won = F.lit(None).cast("string")
        for node, children in level.items():
            won = F.when(parent == node, _won(key, children, seed)).otherwise(won)
        frame = frame.withColumn(prefix + name, won)
        parent = F.col(prefix + name)
    return frame.withColumn(prefix + "shard", F.col(prefix + "shard").cast("int"))


def shard_rows(docs: DataFrame, tree: Sequence[Shard], grown: Sequence[Shard] | None = None, seed: str = "tree") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack`` for each row of ``docs(doc_id, text)``.

    ``doc_id`` and the tree alone decide the shard (law ``key``): rows of an id,
    null included, stay together, and equal texts go where their ids go.
    ``grown_shard`` is the shard in ``grown`` (default: one more shard). A null
    text has size 1 and checksum 0. Slots number the rows of a shard from 0
    without gaps; they follow the order in which rows are stored, are cut by
    input partition, and so hold for a hot shard too. Repeated rows have a slot
    each. Other columns are not read.
    """
    grown = list(grown) if grown is not None else grow(tree)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = descend(descend(rows, F.col("doc_id"), tree, "", seed), F.col("doc_id"), grown, "grown_", seed)
    stored = keep(placed.drop("grown_region", "grown_rack").withColumn("row", F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned(F.col("row"), 33)
    counted = stored.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("shard", "part", before.alias("start"))
    in_part = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    numbered = stored.withColumn("part", part).withColumn("place", in_part.cast("long"))
    return numbered.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"), "grown_shard", "region", "rack"
    )
