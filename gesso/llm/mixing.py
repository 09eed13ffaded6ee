"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key ``-ln(u) / quality``. A source is read
in key order: whole epochs first, then the documents whose running total of
words fits the rest of the target. Running totals come in two steps, inside
slices of the key range and over the totals of the slices, so a source of any
share is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gesso.llm.words import BLANK_RUN, free_prefix, unit_draw, word_count
from gesso.session import keep

#: fixed by the contract: weights of the sources in code point order, repeating
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: rows of a slice of one source's keys, on average
SLICE_ROWS = 2_000
#: sources up to which their targets are broadcast; beyond, they are joined
MOST_BROADCAST = 10_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` for ``sizes(source, source_size)``, one row a source.

    Sources in code point order, null last, get the weights in turn and share
    the sum of all sizes. A source's target stops at ``most`` times its size;
    the excess goes to the others by weight until none is above. That is the
    level L with target = min(most * size, weight * L), found from running
    sums in the order in which sources reach their stop. The table is as long
    as the number of sources.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    ranked = sizes.select("source", "source_size", weight.alias("weight"))
    stop = F.col("source_size") * most
    full = Window.orderBy(stop / F.col("weight"), F.col("source").isNull(), "source")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.select(
        "source", "source_size", "weight", stop.alias("stop"),
        F.coalesce(F.sum(stop).over(before), F.lit(0)).alias("stopped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("stopped_weight"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.row_number().over(full).alias("place"),
    )
    level = (F.col("all_size") - F.col("stopped")) / (F.col("all_weight") - F.col("stopped_weight"))
    free = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("stop"))
    held = F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(everything)
    return free.withColumn("held", held).select(
        "source", "source_size",
        F.when(F.col("held").isNull() | (F.col("place") < F.col("held.place")), F.col("stop").cast("double")).otherwise(F.col("weight") * F.col("held.level")).alias("target"),
    )


def draw(doc_id: Column, quality: Column, seed: str) -> Column:
    """The exponential key: small keys come first, sooner on average for better documents."""
    return -F.log(unit_draw(F.lit(seed), doc_id)) / quality


def mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, slice_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of a stored table ``rows(source, doc_id, size, key, tie, row)``, and where each source ends.

    The first table has ``doc_id, source, size, source_size, target, taken``;
    the second ``source, epochs, last``, where ``last`` is the order (key,
    doc_id, size, tie, row) of the last document in the fractional part, null if none.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes, weights, most).join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    capped = F.col("target") >= F.col("source_size") * most
    epochs = F.when(F.col("source_size") == 0, 0).when(capped, most).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = keep(plan.withColumn("slices", F.ceil(F.col("n") / (slice_rows or SLICE_ROWS)).cast("long")), "targets")
    known = plan.select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", "slices")
    joined = rows.join(F.broadcast(known) if plan.count() <= MOST_BROADCAST else known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # keys are spread about evenly by 1 - exp(-key); where a slice ends does not matter for the order
    cut = F.floor((1 - F.exp(-F.col("key"))) * F.col("slices"))
    sliced = joined.withColumn("slice", F.least(cut, F.col("slices") - 1))
    totals = sliced.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("s"), F.col("slice").alias("c"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "tie", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sliced.withColumn("upto", F.sum("size").over(inside)).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("c")))
    upto = F.col("start") + F.col("upto")
    # the document at the end is in if that brings the total nearer to the target
    more = (upto - F.col("size") < F.col("rest")) & (2 * upto - F.col("size") <= 2 * F.col("rest"))
    taken = summed.withColumn("more", more)
    result = taken.select("doc_id", "source", "size", "source_size", "target", ((F.col("epochs") + F.col("more").cast("long")) * F.col("size")).alias("taken"))
    last = taken.where("more").groupBy("source").agg(F.max(F.struct("key", "doc_id", "size", "tie", "row")).alias("last"))
    ends = plan.select("source", "epochs").join(last.select(F.col("source").alias("s"), "last"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return result, ends


def clean_share(text: Column) -> Column:
    """A quality weight in (0, 1]: the share of non-blank characters that are neither digits nor markup symbols."""
    dense = F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, "")
    return (F.length(F.regexp_replace(dense, "[0-9#*$%&|<>]+", "")) + 1.0) / (F.length(dense) + 1.0)


def _draws(docs: DataFrame, quality: Column | None, seed: str, names: dict[str, str]) -> DataFrame:
    """``docs`` with the columns row, size, tie and key under the names given."""
    text = F.col("text")
    weight = clean_share(text) if quality is None else F.when(quality > 0, quality).otherwise(1.0)
    return docs.withColumns({
        names["row"]: F.monotonically_increasing_id(),
        names["size"]: word_count(text),
        names["tie"]: F.md5(F.coalesce(text, F.lit("")).cast("binary")),
        names["key"]: draw(F.col("doc_id"), weight, seed),
    })


NARROW = ("source", "doc_id", "size", "key", "tie", "row")


def mix_documents(docs: DataFrame, quality: Column | None = None, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs(doc_id, text, source)``.

    ``quality`` is a positive weight, by default ``clean_share`` of the text;
    null and other values count as 1. Sizes are words, 0 for null and empty
    texts. Rows with the same id share a draw; with the same key too they
    follow each other by size, text and place. A null source is a source, an
    empty one too. With no words at all every target is 0. Other columns are
    not read, unless ``quality`` does.
    """
    rows = _draws(docs, quality, seed, {n: n for n in NARROW}).select(*NARROW)
    result, _ = mix(keep(rows, "draws"), weights, most)
    return result.drop("source")


def mixed_rows(docs: DataFrame, quality: Column | None = None, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns and their names stay.

    The mix itself runs on a narrow table. Only the order of the last document
    of each source meets the stored rows, so texts are not shuffled.
    """
    prefix = free_prefix(docs.columns)
    own = {c: prefix + c for c in (*NARROW, "epochs", "last")}
    stored = keep(_draws(docs, quality, seed, own), "rows")
    narrow = stored.select("source", "doc_id", *[F.col(own[c]).alias(c) for c in ("size", "key", "tie", "row")])
    _, ends = mix(narrow, weights, most)
    ends = keep(ends.select(*[F.col(c).alias(own[c]) for c in ("source", "epochs", "last")]), "ends")
    ends = F.broadcast(ends) if ends.count() <= MOST_BROADCAST else ends
    order = F.struct(own["key"], "doc_id", own["size"], own["tie"], own["row"])
    more = F.when(F.col(own["last"]).isNotNull() & (order <= F.col(own["last"])), 1).otherwise(0)
    joined = stored.join(ends, F.col("source").eqNullSafe(F.col(own["source"])))
    copies = F.array_repeat(F.lit(0), (F.col(own["epochs"]) + more).cast("int"))
    return joined.select(*[stored[f"`{c}`"] for c in docs.columns], F.explode(copies).alias(own["epochs"])).drop(own["epochs"])
