"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments. If two fingerprints
differ in at most four bits, one of the segments differs in at most one, so
both have a segment variant in common in which one bit is a wildcard. The
64 variants of each different fingerprint are indexed; equal variants are
joined and every pair found is verified on all 64 bits.

Buckets of up to ``SMALL`` fingerprints are joined by equality. Larger ones
are cut into blocks by hash; each pair of blocks becomes one group, in which a
breadth-first search hands out verified links that connect what the block pair
connects, fewer than it has fingerprints. No link between components is lost,
and no group emits all its pairs.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gesso.llm.links import components
from gesso.llm.spans import map_texts
from gesso.session import forget, keep

#: bits of the segments; with three of them at most one bit of one segment differs
WIDTHS = (22, 21, 21)
MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: fingerprints of a bucket that an equality join may pair, and of a block beyond that
SMALL = 12
BLOCK = 2048
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number; 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    last = max(shingle, 1) - 1
    starts = [0, *(e + 1 for e in ends[: len(ends) - last - 1])]
    stops = ends[last:] or ends[-1:]
    n, ones, digest = len(stops), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _HASHES_AT_ONCE):
        upto = min(n, at + _HASHES_AT_ONCE)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:upto], stops[at:upto], strict=False)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """``rows`` with the fingerprint ``fp`` in place of ``text``."""
    schema = StructType([*[f for f in rows.schema.fields if f.name != "text"], StructField("fp", LongType())])
    return map_texts(rows, "text", schema, lambda: lambda texts: [pa.array(map(fingerprint, texts), pa.int64())])


def variants(fp: Column) -> Column:
    """The 64 one-wildcard segment variants; each holds the wildcard's place and the segment's other bits."""
    keys, start = [], 0
    for width in WIDTHS:
        segment = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for bit in range(width):
            rest = segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)).cast("long"))
            keys.append(rest.bitwiseOR(F.lit((start + bit) << max(WIDTHS)).cast("long")))
        start += width
    return F.array(*keys)


def _near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def _spanning_links(max_bits: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        left = np.unique(pdf["fp"].to_numpy(np.int64))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = np.bitwise_count(left ^ at) <= max_bits
                if near.any():
                    found.append((np.full(int(near.sum()), at), left[near]))
                    queue.extend(left[near])
                    left = left[~near]
        if not found:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([x for _, x in found])})

    return links


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Verified links ``a, b`` between the different values of ``prints(fp)``.

    They connect exactly what all pairs within ``max_bits`` (at most 4)
    connect; inside large buckets some pairs stand for the others.
    """
    if max_bits >= 2 * len(WIDTHS) - 1:
        raise ValueError("three segments with one wildcard find at most 4 differing bits")
    keyed = prints.select("fp", F.explode(variants(F.col("fp"))).alias("key"))
    shared = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where(F.col("n") > 1)
    shared = keep(shared, "variants", tidy=True)
    few = shared.where(F.col("n") <= small)
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b"), max_bits))
        .select("a", "b")
    )
    blocks = F.ceil(F.col("n") / block).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    dealt = (
        shared.where(F.col("n") > small)
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
        .select("key", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    spanning = dealt.groupBy("key", "lo", "hi").applyInPandas(_spanning_links(max_bits), "a long, b long")
    links = keep(pairs.union(spanning).distinct(), "links", tidy=True)
    forget(shared)
    return links


def simhash_groups(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, component_id`` for ``rows(doc_id, fp)``: the smallest ``doc_id`` reachable by links.

    Null ids count only where a whole component has no other; its
    ``component_id`` is null then.
    """
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    least = keep(least, "prints")
    roots = components(near_links(least.select("fp"), max_bits))
    rooted = least.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.select("fp", "root").join(lows, "root").select("fp", "component_id")


def simhash_near_dups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs(doc_id, text)``.

    A null text, an empty one and one of blanks have fingerprint zero and link
    like any other. Repeated rows and ids keep a row each. Other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    rows = keep(with_fingerprints(docs.select("doc_id", "text")), "fingerprints")
    groups = simhash_groups(rows, max_bits)
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_dups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: the smallest ``doc_id``, the first row of it as stored.

    All columns and their names stay; null ids come last in a group. The
    result is a kept table, what it was made from is deleted.
    """
    row = "gesso__row"
    stored = keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows", tidy=True)
    rows = keep(with_fingerprints(stored.select("doc_id", row, "text")), "fingerprints", tidy=True)
    least = keep(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row)).alias("low")), "prints", tidy=True)
    roots = components(near_links(least.select("fp"), max_bits))
    rooted = least.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    stay = rooted.groupBy("root").agg(F.min("low").alias("low")).select(F.col(f"low.{row}").alias(row))
    left = keep(stored.join(stay, row, "left_semi").drop(row), "fingerprinted", tidy=True)
    for table in (stored, rows, least):
        forget(table)
    return left
