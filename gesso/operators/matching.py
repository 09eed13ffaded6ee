"""Keypoint matching between neighbouring grid cells and tie-point tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gesso.functions import geometry as g
from gesso.operators.scans import attach
from gesso.session import cut, lookup

# Neighbour offsets (row, col) and their names.
DIRECTIONS = {
    "right": (0, 1), "left": (0, -1), "top": (1, 0), "bottom": (-1, 0),
    "bottom_left": (-1, -1), "bottom_right": (-1, 1), "top_left": (1, -1), "top_right": (1, 1),
}


def cell_neighbours(cells: DataFrame) -> DataFrame:
    """Each cell with its existing neighbours: row, col, dir, nrow, ncol."""
    steps = F.array(*[F.struct(F.lit(k).alias("dir"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for k, (r, c) in DIRECTIONS.items()])
    wanted = cells.select("row", "col", F.explode(steps).alias("s")).select(
        "row", "col", F.col("s.dir").alias("dir"), (F.col("row") + F.col("s.dr")).alias("nrow"), (F.col("col") + F.col("s.dc")).alias("ncol")
    )
    present = cells.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"))
    return wanted.join(present, ["nrow", "ncol"])


def in_overlap(x: Column, y: Column, w: Column, h: Column, direction: Column, source: bool) -> Column:
    """Is a keypoint in the half or quadrant facing the neighbour (image rows
    run downwards)? The neighbour's own side is the complement."""
    right, low = x >= w / 2, y >= h / 2
    facing = {"right": (True, None), "left": (False, None), "bottom": (None, True), "top": (None, False),
              "bottom_right": (True, True), "bottom_left": (False, True), "top_right": (True, False), "top_left": (False, False)}
    test = F.lit(True)
    for name, (want_right, want_low) in facing.items():
        parts = []
        if want_right is not None:
            parts.append(right if want_right == source else ~right)
        if want_low is not None:
            parts.append(low if want_low == source else ~low)
        both = parts[0] if len(parts) == 1 else parts[0] & parts[1]
        test = F.when(direction == name, both).otherwise(test)
    return test


def match_score(distance: Column) -> Column:
    return 1.0 / (distance + 1e-6)


#: blocks of a cell while they hold no more than ``MOST`` keypoints
PARTS, MOST = 4, 8192
#: distances a task holds at once, and pairs that it computes number by number
_CHUNK, _PAIRS = 1 << 21, 1 << 16


def _nearest_rows(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of ``c`` for each row of ``q`` and their distances; ties by place.

    A matrix product gives all squared distances up to rounding; what lies
    within the bound of its error of the k-th is computed number by number, so
    the result is that of all pairs computed so.
    """
    exact = lambda i, j: np.concatenate([np.sqrt(((q[i[n : n + _PAIRS]] - c[j[n : n + _PAIRS]]) ** 2).sum(axis=1)) for n in range(0, len(i), _PAIRS)])
    sq, sc = (q * q).sum(axis=1), (c * c).sum(axis=1)
    plain = bool(np.isfinite(sq).all() and np.isfinite(sc).all())
    slack = 32 * (q.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(sq) + np.sqrt(sc.max())) ** 2 if plain else sq
    best, dist = [], []
    step = max(1, _CHUNK // len(c))
    for n in range(0, len(q), step):
        rows = slice(n, n + step)
        near = np.ones((len(sq[rows]), len(c)), bool)
        if plain:
            rough = sq[rows, None] + sc[None] - 2 * (q[rows] @ c.T)
            near = rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + slack[rows])[:, None]
        i, j = np.nonzero(near)
        d = exact(i + n, j)
        order = np.lexsort((j, d, i))
        first = np.concatenate([[0], np.cumsum(near.sum(axis=1))[:-1]])
        take = order[first[:, None] + np.arange(k)[None]]
        best.append(j[take])
        dist.append(d[take])
    return np.concatenate(best), np.concatenate(dist)


def two_nearest(keypoints: DataFrame, width: float, height: float, block: int = 2048) -> DataFrame:
    """The two nearest descriptors in each neighbouring cell, exactly.

    ``keypoints``: row, col, kp, x, y, desc. Output row, col, dir, kp, match,
    distance, rank. Cells are split into up to ``PARTS`` blocks of about
    ``block`` keypoints, then their blocks grow up to ``MOST`` and beyond that
    in number; a task compares one block with one block and returns two
    candidates per keypoint, so a crowded cell means more tasks, not a bigger
    one, and few copies of each keypoint.
    """
    counts = keypoints.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.lit(block), F.least(F.lit(max(block, MOST)), F.ceil(F.col("n") / PARTS)))
    split = lookup(counts.select("row", "col", F.ceil(F.col("n") / size).cast("int").alias("_nb")))
    cells = counts.select("row", "col")
    pairs = lookup(cell_neighbours(cells))
    base = keypoints.join(split, ["row", "col"]).withColumn("_b", F.pmod(F.xxhash64("kp"), F.col("_nb")).cast("int"))
    w, h = F.lit(float(width)), F.lit(float(height))
    near = split.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("_nb").alias("_mb"))
    left = base.join(pairs, ["row", "col"]).where(in_overlap(F.col("x"), F.col("y"), w, h, F.col("dir"), True))
    left = left.join(near, ["nrow", "ncol"])
    left = left.select("row", "col", "dir", F.col("kp").alias("kp"), F.col("desc").alias("desc"), F.col("_b").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("_mb") - 1)).alias("db"))
    here = pairs.withColumnsRenamed({"row": "row0", "col": "col0"}).withColumnsRenamed({"nrow": "row", "ncol": "col"})
    right = base.join(here, ["row", "col"]).where(in_overlap(F.col("x"), F.col("y"), w, h, F.col("dir"), False))
    right = right.join(split.select(F.col("row").alias("row0"), F.col("col").alias("col0"), F.col("_nb").alias("_qb")), ["row0", "col0"])
    right = right.select(
        F.col("row0").alias("row"), F.col("col0").alias("col"), F.col("dir").alias("dir"), F.col("kp").alias("kp"), F.col("desc").alias("desc"), F.explode(F.sequence(F.lit(0), F.col("_qb") - 1)).alias("sb"), F.col("_b").alias("db")
    )
    key = ["row", "col", "dir", "sb", "db"]

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            kinds = {"row": "int32", "col": "int32", "dir": object, "kp": "int64", "match": "int64", "distance": "float64"}
            return pd.DataFrame({c: pd.Series([], dtype=k) for c, k in kinds.items()})
        b = b.sort_values("kp")
        q, c = np.stack(a["desc"]).astype(float), np.stack(b["desc"]).astype(float)
        ids = b["kp"].to_numpy()
        k = min(2, len(b))
        at, dist = _nearest_rows(q, c, k)
        match = ids[at]
        return pd.DataFrame({
            "row": a["row"].iloc[0], "col": a["col"].iloc[0], "dir": a["dir"].iloc[0],
            "kp": np.repeat(a["kp"].to_numpy(), k), "match": match.ravel(), "distance": dist.ravel(),
        })

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        nearest, "row int, col int, dir string, kp long, match long, distance double"
    )
    order = Window.partitionBy("row", "col", "dir", "kp").orderBy("distance", "match")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 2")


def ratio_matches(candidates: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Adds ``good``: the nearest is clearly nearer than the second."""
    flat = candidates.groupBy("row", "col", "dir", "kp").agg(
        F.min_by("match", "rank").alias("match"), F.min("distance").alias("distance"),
        F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"),
    )
    return flat.withColumn("good", F.coalesce(F.col("distance") < ratio * F.col("second"), F.lit(False)))


def match_summary(matches: DataFrame, keys: Sequence[str], minimum: int) -> DataFrame:
    """Raw, good and inlier counts per pair; pairs with enough inliers stay."""
    return matches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("good"), F.count_if(F.col("good") & F.col("inlier")).alias("inliers")
    ).where(F.col("inliers") >= minimum)


def cap_matches_per_pair(matches: DataFrame, keys: Sequence[str], n: int, score: str = "score", tie: str = "kp") -> DataFrame:
    """Best ``n`` matches of each pair. The rank limit runs before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return matches.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


# -- tie points ------------------------------------------------------------------


def reprojection_error(ties: DataFrame, h: str = "h") -> DataFrame:
    """Adds ``error``: distance of H(x1, y1) to (x2, y2)."""
    qx, qy = g.apply_homography(F.col(h), F.col("x1"), F.col("y1"))
    return ties.withColumn("error", F.sqrt(F.pow(qx - F.col("x2"), 2) + F.pow(qy - F.col("y2"), 2)))


def error_below(ties: DataFrame, limit: float) -> DataFrame:
    return ties.where(F.col("error") <= limit)


def best_ties(ties: DataFrame, n: int, tie: str = "point_no") -> DataFrame:
    """The n best pairs by error, at least 4 (both sides stay together)."""
    return ties.orderBy("error", tie).limit(max(4, n))


def error_summary(ties: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and largest error; an error text when there are fewer than 4
    points or one side misses points."""
    out = ties.groupBy(*keys).agg(
        F.count("x1").alias("n1"), F.count("x2").alias("n2"), F.avg("error").alias("mean"), F.max("error").alias("max")
    )
    bad = F.when(F.col("n1") != F.col("n2"), "unequal counts").when(F.col("n1") < 4, "fewer than 4 points")
    return out.select(*keys, "n1", "n2", F.when(bad.isNull(), F.col("mean")).alias("mean"), F.when(bad.isNull(), F.col("max")).alias("max"), bad.alias("problem"))


def reprojection_mean(ties: DataFrame) -> DataFrame:
    """Final cost (half the squared errors) per residual."""
    return ties.agg((F.sum(F.col("error") * F.col("error")) / 2 / F.count("error")).alias("mean_cost"))


def pair_points(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """Points of two images by number, with where each was found."""
    a = first.select(*key, F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = second.select(*key, F.col("x").alias("x2"), F.col("y").alias("y2"))
    found = F.when(F.col("x1").isNotNull() & F.col("x2").isNotNull(), "both").when(F.col("x1").isNotNull(), "first").when(F.col("x2").isNotNull(), "second").otherwise("none")
    return a.join(b, list(key), "full_outer").withColumn("found", found)


#: orders in which the ties of a pair are paired off
SHUFFLES = 8


def ransac_draws(share: float, confidence: float) -> int:
    """Two-point samples needed so that one of them holds inliers only, at a given share of inliers."""
    return math.ceil(math.log(1 - confidence) / math.log(1 - share * share))


#: ties that a task packs at once, and distances that it computes at once
_TIES, _GAPS = 1 << 16, 1 << 18
_DRAWN = ("_k", "a", "b", "tx", "ty")


def _packed_ties(ties: DataFrame, keys: list[str]) -> DataFrame:
    """Ties as a row a pair and run of ``_TIES`` rows of a task, with ``_xy`` (x1, y1, x2, y2 one after the other) as bytes."""
    ends = ["x1", "y1", "x2", "y2"]

    def fold(held: list[pd.DataFrame]) -> pd.DataFrame:
        run = pd.concat(held, ignore_index=True)
        parts = run.groupby(keys, sort=False) if keys else [((), run)]
        return pd.DataFrame([(*key, part[ends].to_numpy(float).T.tobytes()) for key, part in parts], columns=[*keys, "_xy"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= _TIES:
                yield fold(held)
                held, n = [], 0
        if n:
            yield fold(held)

    rows = ties.select(*keys, *[F.col(c).cast("double").alias(c) for c in ends])
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    return rows.mapInPandas(pack, T.StructType([*[ties.schema[c] for c in keys], T.StructField("_xy", T.BinaryType())]))


def _count_inliers(keys: list[str], levels: list[float]):
    """Per packed row and hypothesis, its ties within each threshold."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                x1, y1, x2, y2 = np.frombuffer(row["_xy"]).reshape(4, -1)[:, :, None]
                drawn = {c: np.asarray(row[f"_h{c}"]) for c in _DRAWN}
                a, b, tx, ty = (drawn[c] for c in _DRAWN[1:])
                found = np.zeros((len(levels), len(a)), np.int64)
                step = max(1, _GAPS // max(1, len(a)))
                for n in range(0, len(x1), step):
                    to = slice(n, n + step)
                    dx, dy = a * x1[to] - b * y1[to] + tx - x2[to], b * x1[to] + a * y1[to] + ty - y2[to]
                    d = dx * dx + dy * dy
                    for i, lv in enumerate(levels):
                        found[i] += np.count_nonzero(d <= lv * lv, axis=0)
                yield pd.DataFrame({**{c: [row[c]] * len(a) for c in keys}, **drawn, **{f"_c{i}": found[i] for i in range(len(levels))}})

    return count


def ransac_similarity(
    ties: DataFrame, keys: Sequence[str], order: str, threshold: float = 3.0, least_share: float = 0.15, confidence: float = 0.999, top: float = 100.0,
    wanted: int = 16, seed: int = 7,
) -> DataFrame:
    """Similarity transform per pair: a, b, tx, ty with x2 = a x1 - b y1 + tx,
    y2 = b x1 + a y1 + ty, plus inliers and threshold.

    Hypotheses come from seeded two-point samples, as many as find the
    transform with ``confidence`` if at least ``least_share`` of the ties agree.
    They are drawn in ``SHUFFLES`` orders of the ties, so a pair with few ties has
    fewer. Inliers are counted for every hypothesis at every threshold (doubled
    up to ``top``), summed before they are shuffled. The first threshold with
    more than ``wanted`` inliers wins, and a last pass refits on the inliers by
    sums. A pair for which no threshold has that many has no row.
    """
    keys = list(keys)
    each = math.ceil(ransac_draws(least_share, confidence) / SHUFFLES)
    orders = ties.withColumn("_o", F.explode(F.array(*[F.lit(o) for o in range(SHUFFLES)])))
    draw = Window.partitionBy(*keys, "_o").orderBy(F.xxhash64(order, F.lit(seed), "_o"), order)
    picked = orders.withColumn("_i", F.row_number().over(draw)).where(F.col("_i") <= 2 * each)
    sample = F.struct("x1", "y1", "x2", "y2")
    two = picked.groupBy(*keys, (F.col("_o") * each + F.floor((F.col("_i") - 1) / 2)).cast("int").alias("_k")).agg(
        F.min_by(sample, "_i").alias("p"), F.max_by(sample, "_i").alias("q"), F.count(F.lit(1)).alias("_n")
    ).where("_n = 2")
    ux, uy = F.col("q.x1") - F.col("p.x1"), F.col("q.y1") - F.col("p.y1")
    vx, vy = F.col("q.x2") - F.col("p.x2"), F.col("q.y2") - F.col("p.y2")
    size = ux * ux + uy * uy
    two = two.withColumns({"a": F.try_divide(ux * vx + uy * vy, size), "b": F.try_divide(ux * vy - uy * vx, size)}).where("a IS NOT NULL")
    two = two.withColumns({
        "tx": F.col("p.x2") - F.col("a") * F.col("p.x1") + F.col("b") * F.col("p.y1"), "ty": F.col("p.y2") - F.col("b") * F.col("p.x1") - F.col("a") * F.col("p.y1")
    })
    hyps = cut(two.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", "a", "b", "tx", "ty"))).alias("_h")))  # as many as draws, at most
    levels = [threshold]
    while levels[-1] * 2 <= top:
        levels.append(levels[-1] * 2)

    def gap(h: Column) -> Column:
        dx = h["a"] * F.col("x1") - h["b"] * F.col("y1") + h["tx"] - F.col("x2")
        dy = h["b"] * F.col("x1") + h["a"] * F.col("y1") + h["ty"] - F.col("y2")
        return dx * dx + dy * dy

    flat = hyps.select(*keys, *[F.col("_h")[c].alias(f"_h{c}") for c in _DRAWN])
    drawn = attach(_packed_ties(ties, keys), flat, keys).where("_h_k IS NOT NULL")
    rows = drawn.mapInPandas(_count_inliers(keys, levels), T.StructType([
        *[ties.schema[c] for c in keys], T.StructField("_k", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in _DRAWN[1:]],
        *[T.StructField(f"_c{i}", T.LongType()) for i in range(len(levels))],
    ]))
    counts = rows.groupBy(*keys, "_k").agg(F.first(F.struct(*_DRAWN)).alias("_m"), *[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(levels))])
    best = counts.groupBy(*keys).agg(*[F.max(F.struct(F.col(f"_c{i}").alias("n"), (-F.col("_k")).alias("k"), F.col("_m").alias("m"))).alias(f"_b{i}") for i in range(len(levels))])
    choice = F.coalesce(*[F.when(F.col(f"_b{i}.n") > wanted, F.struct(F.lit(lv).alias("t"), F.col(f"_b{i}.m").alias("m"))) for i, lv in enumerate(levels)])
    chosen = best.withColumn("_w", choice).where("_w IS NOT NULL").select(*keys, F.col("_w.t").alias("threshold"), F.col("_w.m").alias("_m"))
    inl = attach(ties, chosen, keys).where(gap(F.col("_m")) <= F.col("threshold") * F.col("threshold"))
    s = inl.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("inliers"), F.first("threshold").alias("threshold"), *[F.avg(c).alias(f"m_{c}") for c in ("x1", "y1", "x2", "y2")],
        F.avg(F.col("x1") * F.col("x2") + F.col("y1") * F.col("y2")).alias("dot"), F.avg(F.col("x1") * F.col("y2") - F.col("y1") * F.col("x2")).alias("crs"),
        F.avg(F.col("x1") ** 2 + F.col("y1") ** 2).alias("sq"),
    )
    c = lambda n: F.col(n)
    var = c("sq") - c("m_x1") ** 2 - c("m_y1") ** 2
    s = s.withColumns({
        "a": F.try_divide(c("dot") - c("m_x1") * c("m_x2") - c("m_y1") * c("m_y2"), var),
        "b": F.try_divide(c("crs") - c("m_x1") * c("m_y2") + c("m_y1") * c("m_x2"), var),
    })
    return s.select(*keys, "a", "b", (c("m_x2") - c("a") * c("m_x1") + c("b") * c("m_y1")).alias("tx"),
                    (c("m_y2") - c("b") * c("m_x1") - c("a") * c("m_y1")).alias("ty"), "inliers", "threshold")
