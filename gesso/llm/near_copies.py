"""Near copies by shingle similarity: MinHash bands find candidates, exact sets decide.

Two texts are near copies if their sets of five-word shingles share at least
80 % of their union. Fingerprints of 64 bits are too coarse for that, since
such texts differ by many bits. Here each different set gets ``BANDS`` keys,
each made of ``ROWS`` least hashes; texts with a key in common are candidates,
and the sets themselves are compared. A pair at 80 % has no key in common once
in 300,000 times (``(1 - 0.8 ** 4) ** 24``); closer pairs still less often.

Buckets of up to ``SMALL`` sets are joined by equality. Larger ones are cut
into blocks by hash; each pair of blocks becomes one group, in which a
breadth-first search hands out links that connect what the block pair
connects, fewer than it has sets.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from gesso.llm.links import components
from gesso.llm.spans import map_texts
from gesso.llm.words import free_prefix
from gesso.session import forget, keep

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 24, 4
SEED = 42
#: sets of a bucket that an equality join may pair; shingles of a block beyond that
SMALL = 12
BLOCK_SHINGLES = 1 << 18
_HASHES_AT_ONCE = 1 << 11
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes; fewer words than a shingle are one, no words none."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: max(0, len(ends) - shingle)])]
    stops = ends[shingle - 1 :] or ends[-1:]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys of a set as signed 64-bit numbers; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _HASHES_AT_ONCE):
        mixed = hashes[at : at + _HASHES_AT_ONCE] * _FACTORS[0] + _FACTORS[1]
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def with_marks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``node`` (a hash of the shingle set), ``size`` and ``bands`` in place of ``text``."""
    extra = [StructField("node", LongType()), StructField("size", IntegerType()), StructField("bands", ArrayType(LongType()))]
    schema = StructType([*[f for f in rows.schema.fields if f.name != "text"], *extra])

    def work(texts: list[str | None]) -> list[pa.Array]:
        nodes, sizes, bands = [], [], []
        for text in texts:
            found = shingle_set(text)
            nodes.append(xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED))
            sizes.append(len(found))
            bands.append(band_keys(found))
        return [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))]

    return map_texts(rows, "text", schema, lambda: work)


def with_sets(rows: DataFrame) -> DataFrame:
    """``rows`` with the shingle set ``hashes`` in place of ``text``."""
    schema = StructType([*[f for f in rows.schema.fields if f.name != "text"], StructField("hashes", ArrayType(LongType()))])
    return map_texts(rows, "text", schema, lambda: lambda texts: [pa.array([shingle_set(t).view(np.int64) for t in texts], pa.list_(pa.int64()))])


def _spanning_links(percent: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        nodes, sizes = pdf["node"].to_numpy(np.int64), pdf["hashes"].map(len).to_numpy(np.int64)
        known, codes = np.unique(np.concatenate(pdf["hashes"].to_list()), return_inverse=True)
        own = np.split(codes, np.cumsum(sizes)[:-1])
        mark = np.zeros(len(known), np.int32)
        left, flat, pairs = np.arange(1, len(nodes)), codes[sizes[0] :], []
        queue = [0]
        while len(left):
            if not queue:
                queue, left = [left[0]], left[1:]
                flat = flat[sizes[queue[0]] :]
                continue
            at = queue.pop()
            mark[own[at]] = 1
            both = np.add.reduceat(mark[flat], np.concatenate([[0], np.cumsum(sizes[left])[:-1]]))
            mark[own[at]] = 0
            near = 100 * both >= percent * (sizes[at] + sizes[left] - both)
            if near.any():
                pairs += [(nodes[at], nodes[x]) for x in left[near]]
                queue.extend(left[near])
                flat, left = flat[np.repeat(~near, sizes[left])], left[~near]
        return pd.DataFrame({"a": pd.Series([a for a, _ in pairs], dtype="int64"), "b": pd.Series([b for _, b in pairs], dtype="int64")})

    return links


def near_links(nodes: DataFrame, texts: DataFrame, percent: int = PERCENT, small: int = SMALL, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Verified links ``a, b`` between the sets of ``nodes(node, size, bands, row)``; ``texts(row, text)`` has a text of each.

    They connect what all candidates of ``percent`` similarity connect; inside
    large buckets some pairs stand for the others.
    """
    keyed = nodes.select("node", "row", "size", F.explode("bands").alias("key"))
    same = Window.partitionBy("key")
    shared = keyed.withColumns({"n": F.count("*").over(same), "total": F.sum("size").over(same)}).where(F.col("n") > 1)
    shared = keep(shared, "bands", tidy=True)
    sets = keep(with_sets(texts.join(shared.select("row", "node").distinct(), "row").select("node", "text")), "sets", tidy=True)
    few = shared.where(F.col("n") <= small)
    pairs = (
        few.select("key", F.col("node").alias("a"), F.col("size").alias("m"))
        .join(few.select("key", F.col("node").alias("b"), F.col("size").alias("n")), "key")
        .where((F.col("a") < F.col("b")) & (100 * F.least("m", "n") >= percent * F.greatest("m", "n")))
        .select("a", "b")
        .distinct()
    )
    one, two = (sets.select(F.col("node").alias(c), F.col("hashes").alias(h)) for c, h in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    compared = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sizes"))
    verified = compared.where(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select("a", "b")
    blocks = F.ceil(F.col("total") / block).cast("long")
    mine = F.pmod(F.xxhash64("node"), blocks)
    dealt = (
        shared.where(F.col("n") > small)
        .select("key", "node", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
        .select("key", "node", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    )
    spanning = dealt.join(sets, "node").groupBy("key", "lo", "hi").applyInPandas(_spanning_links(percent), "a long, b long")
    links = keep(verified.union(spanning).distinct(), "links", tidy=True)
    forget(shared)
    forget(sets)
    return links


def drop_near_copies(docs: DataFrame, percent: int = PERCENT, small: int = SMALL, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs`` with one row of each group: the smallest ``doc_id``, the first row of it as stored.

    Groups are what links of ``percent`` similarity connect; texts without
    words are alike. All columns and their names stay; null ids come last.
    """
    row = free_prefix(docs.columns) + "row"
    stored = keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows", tidy=True)
    marks = keep(with_marks(stored.select("doc_id", row, "text")), "marks", tidy=True)
    least = marks.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row, "size", "bands")).alias("low"))
    least = keep(least.select("node", F.struct("low.no_id", "low.doc_id", f"low.{row}").alias("low"), "low.size", "low.bands"), "nodes", tidy=True)
    forget(marks)
    nodes = least.select("node", "size", "bands", F.col(f"low.{row}").alias("row"))
    roots = components(near_links(nodes, stored.select(F.col(row).alias("row"), "text"), percent, small, block))
    rooted = least.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = rooted.groupBy("root").agg(F.min("low").alias("low")).select(F.col(f"low.{row}").alias(row))
    return stored.join(stay, row, "left_semi").drop(row)
