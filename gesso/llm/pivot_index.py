"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots) in order.
Inverted lists by label and pivot hold the vectors that have the pivot among
their nearest. Within a list, vectors that share enough pivots are candidates;
each candidate pair is verified by its cosine in double precision. A pair is
handled in the list of its smallest shared pivot alone.

Equal vectors stand as one with a multiplicity. Lists longer than ``BLOCK`` are
cut into blocks, and each pair of blocks is a group of its own. Groups hand out
per-vector link counts and links that span what they connect, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from gesso.llm.links import components
from gesso.session import keep

LEAST_COSINE = 0.98
#: reference points, a sample of the vectors bounded by this number
PIVOTS = 384
#: rows they are drawn from, and the cosine beyond which two of them are too close
SAMPLE, APART = 1536, 0.8
#: nearest pivots that describe a vector, and how many of them candidates share at least
NEAREST, SHARED = 8, 2
#: vectors of a list that one group compares
BLOCK = 1024


def _can_link() -> Column:
    """Whether a row has a label and a vector of finite numbers, not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False))


def choose_pivots(distinct: DataFrame, most: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Up to ``most`` unit vectors from a sample of ``sample`` rows, those of the smallest hash, all of the sample's most frequent length.

    A row that lies within ``APART`` of a pivot chosen before is passed over:
    many pivots in one dense spot would order it by chance.
    """
    rows = distinct.select("embedding", F.xxhash64("label", "embedding").alias("h")).orderBy("h").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    lengths = [len(r["embedding"]) for r in rows]
    size = max(sorted(set(lengths)), key=lengths.count)
    units = _unit(np.array([r["embedding"] for r in rows if len(r["embedding"]) == size], np.float64))
    chosen: list[int] = []
    for i, u in enumerate(units):
        if len(chosen) < most and not (chosen and (units[chosen] @ u > APART).any()):
            chosen.append(i)
    return units[chosen]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def describe(distinct: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """``distinct`` with ``unit`` vectors and ``near``, the numbers of the nearest pivots in order.

    Vectors of another length than the pivots' are described by the first
    pivots, all alike, so that they still meet.
    """
    schema = StructType([*distinct.schema.fields, StructField("unit", ArrayType(DoubleType())), StructField("near", ArrayType(IntegerType()))])

    def run(batches):
        for pdf in batches:
            units, near = [None] * len(pdf), [list(range(min(nearest, len(pivots))))] * len(pdf)
            sizes = pdf["embedding"].map(len).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                unit = _unit(np.stack([np.asarray(pdf["embedding"].iloc[i], np.float64) for i in at]))
                for i, u in zip(at, unit, strict=True):
                    units[i] = u
                if pivots.shape[1] == size:
                    order = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :nearest]
                    for i, o in zip(at, order, strict=True):
                        near[i] = o.tolist()
            yield pdf.assign(unit=units, near=near)

    return distinct.mapInPandas(run, schema)


def _compare(least: float, shared: int, pivots: int):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        if len(pdf) < 2:
            return none
        lo, hi, pivot = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]), int(pdf["pivot"].iloc[0])
        pdf = pdf.sort_values("id")
        sizes = pdf["unit"].map(len).to_numpy()
        parts = []
        for size in np.unique(sizes):
            part = pdf[sizes == size]
            x, ids = np.stack(part["unit"].to_numpy()), part["id"].to_numpy(np.int64)
            times, block = part["times"].to_numpy(np.int64), part["block"].to_numpy()
            has = np.zeros((len(ids), pivots), np.float32)
            for row, near in zip(has, part["near"], strict=True):
                row[near] = 1
            together = has @ has.T
            below = has[:, :pivot]
            mine = (below @ below.T) == 0 if pivot else np.ones_like(together, bool)
            near = (together >= min(shared, pivots)) & mine & (x @ x.T >= least)
            np.fill_diagonal(near, False)
            if lo != hi:
                near &= block[:, None] != block[None, :]
            linked = np.flatnonzero(near.any(1))
            if len(linked):
                parts.append(pd.DataFrame({"a": ids[linked], "b": ids[linked], "n": near[linked] @ times}))
                a, b = _span(near)
                parts.append(pd.DataFrame({"a": ids[a], "b": ids[b], "n": 0}))
        return pd.concat(parts) if parts else none

    return compare


def _span(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the matrix ``near``."""
    left, a, b = np.ones(len(near), bool), [], []
    for root in np.flatnonzero(near.any(1)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue:
            at = queue.pop()
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            a += [at] * len(new)
            b += new.tolist()
            queue += new.tolist()
    return np.array(a, int), np.array(b, int)


def near_dup_vectors(vectors: DataFrame, least: float = LEAST_COSINE, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding, label)``.

    Rows link if their labels are equal and their cosine is ``least`` or more.
    Null labels, null, empty and zero vectors and those with null or
    non-finite components link with nothing. Every vector is indexed; a link is
    missed only if its ends share fewer than ``shared`` of their ``nearest``
    pivots. Repeated rows count as vectors of their own. Null ids don't name a
    component unless alone. Other columns are not read.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    # equal vectors of a label become one
    hashed = keep(rows.where(_can_link()).groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    points = choose_pivots(hashed, pivots)
    described = keep(describe(hashed.select("label", "embedding", "low", "times", "id"), points, nearest).drop("embedding"), "described")
    lists = described.select("label", "id", "times", "unit", "near", F.explode("near").alias("pivot"))
    sizes = lists.groupBy("label", "pivot").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = (
        lists.join(F.broadcast(sizes) if sizes.count() <= 50_000 else sizes, ["label", "pivot"])
        .withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("label", "pivot", "id", "times", "unit", "near", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    )
    found = keep(dealt.groupBy("label", "pivot", "lo", "hi").applyInPandas(_compare(least, shared, max(1, len(points))), "a long, b long, n long"), "links")
    counts = found.where(F.col("a") == F.col("b")).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    roots = components(found.where(F.col("a") != F.col("b")).select("a", "b"))
    rooted = described.select("id", "low", "times").join(roots.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    groups = rooted.join(lows, "root").select("id", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    known = hashed.select("label", "embedding", "id").join(groups, "id").drop("id")
    # what can't link meets nothing here; its ids spread it over the tasks
    keyed = rows.withColumn("key", F.when(_can_link(), F.xxhash64("label", "embedding")).otherwise(F.xxhash64("vec_id"))).join(
        known.select(F.col("label").alias("l"), F.col("embedding").alias("e"), F.xxhash64("label", "embedding").alias("k"), "n_links", "component_id"),
        (F.col("key") == F.col("k")) & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")),
        "left",
    )
    own = F.coalesce("component_id", "vec_id")
    return keyed.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
