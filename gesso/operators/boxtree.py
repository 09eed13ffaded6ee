"""Nearest points and triangles by a tree of boxes, searched level by level as joins.

Items are sorted along a Z-order curve and cut into buckets of a fixed number;
eight neighbouring boxes make a box of the next level, up to at most 64. A
crowded place is then many small boxes and an empty region none at all, so
neither dense clusters nor remote queries change the number of steps.

Queries travel in blocks no wider than a usual bucket. At each level a block
keeps the boxes that may hold an answer: those not farther than the distance
within which enough items must lie. Buckets are verified in three steps, the
surest first, and each step's distances rule out buckets of the next one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gesso.session import forget, keep

LOW, HIGH = ("x0", "y0", "z0"), ("x1", "y1", "z1")
BOX = (*LOW, *HIGH)
#: eight children a box
FAN_BITS = 3
#: boxes of the highest level; twenty sizes at most, so the bound is always reached
ROOTS, SIZES = 64, 20
#: levels of up to so many rows (some 600 bytes each) are broadcast
BROADCAST_NODES = 50_000
#: queries a block
BLOCK = 64
#: buckets by distance that a block verifies in the second step
SECOND = 4
#: the second step is left out where a block has no more candidates than this on average; the result is the same
FEW = 16
#: buckets in more than this share of all pairs (one in HOT) are joined by broadcast, at most HOT of them
HOT = 1000
#: pairs of block and bucket whose results a task holds at once, at most 64 rows each
PAIRS = 256
#: rounding of distances
SLACK = 1 + 1e-14
AXIS_BITS = 21
NODES = f"array<struct<_g int, _b long, {', '.join(f'{c} double' for c in BOX)}, n long>>"


def finite(*columns: str) -> Column:
    """Whether all coordinates are there and finite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    return F.coalesce(ok, F.lit(False))


def _spread(v: Column) -> Column:
    """The 21 low bits of ``v``, two zero bits after each."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _z_order(df: DataFrame, centre: Sequence[Column]) -> DataFrame:
    """Add ``_z`` and ``_zz``: Z-order codes of 42 bits an axis in the cube around all centres."""
    named = df.withColumns({f"_c{i}": c for i, c in enumerate(centre)})
    ends = named.agg(*[f(f"_c{i}").alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    span = max((ends[f"hi{i}"] or 0.0) - (ends[f"lo{i}"] or 0.0) for i in range(3)) or 1.0
    most = 1 << AXIS_BITS
    scaled = {f"_s{i}": (F.col(f"_c{i}") - (ends[f"lo{i}"] or 0.0)) / span * most for i in range(3)}
    cells = {f"_i{i}": F.least(F.floor(f"_s{i}"), F.lit(most - 1)) for i in range(3)}
    parts = {f"_j{i}": F.least(F.floor((F.col(f"_s{i}") - F.col(f"_i{i}")) * most), F.lit(most - 1)) for i in range(3)}
    named = named.withColumns(scaled).withColumns(cells).withColumns(parts)
    code = lambda n: F.shiftleft(_spread(F.col(f"{n}0")), 2).bitwiseOR(F.shiftleft(_spread(F.col(f"{n}1")), 1)).bitwiseOR(_spread(F.col(f"{n}2")))
    return named.withColumns({"_z": code("_i"), "_zz": code("_j")}).drop(*[f"_{n}{i}" for n in "csij" for i in range(3)])


def _numbered(df: DataFrame, centre: Sequence[Column], first: Sequence[str], ident: str, size: int) -> DataFrame:
    """Rows in Z-order with a bucket number ``_b`` whose high bits are the partition's.

    One range shuffle; equal centres are ordered by ``ident``. The table is
    written, so the numbers stay whatever happens to an executor.
    """
    spark = df.sparkSession
    order = [*first, "_z", "_zz", ident]
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _z_order(df, centre).repartitionByRange(chunks, *order).sortWithinPartitions(*order)
    rows = keep(rows.withColumn("_at", F.monotonically_increasing_id()).drop("_z", "_zz"), "z-order")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    most = rows.agg(F.max(place)).first()[0] or 0
    bits = -(-max(most // size, 1).bit_length() // FAN_BITS) * FAN_BITS
    return rows.withColumn("_b", F.shiftleft(F.shiftright("_at", 33), bits) + F.floor(place / size))


@dataclass
class BoxTree:
    """``levels[0]`` has a row a bucket with its items; the others a row a box with its ``kids``."""

    levels: list[DataFrame]
    sizes: list[int]
    width: float
    box: tuple[float, ...]

    @property
    def top(self) -> list:
        return self.levels[-1].select("_g", "_b", *BOX, "n").collect()

    def forget(self) -> None:
        for level in self.levels:
            forget(level)


def build(items: DataFrame, ident: str, payload: Sequence[str], bucket: int = 32, keys: Sequence[str] = ()) -> BoxTree:
    """The tree of ``items`` (``ident``, box columns x0..z1, ``payload``), or one tree for each value of ``keys``.

    Boxes are grouped by the power of four of their width (twenty at most), so
    a few wide triangles have buckets of their own and don't widen those of
    their small neighbours. Lists are bounded: ``bucket`` items or eight boxes.
    """
    width = F.greatest(*[F.col(h) - F.col(lo) for lo, h in zip(LOW, HIGH)])
    widest = items.agg(F.max(width)).first()[0] or 0.0
    group = F.lit(0)
    if widest > 0:
        least = int(np.floor(np.log2(widest) / 2)) - SIZES + 1
        group = F.greatest(F.when(width > 0, F.floor(F.log2(width) / 2)), F.lit(least)).cast("int")
    rows = items.select(*keys, ident, *payload, *BOX, group.alias("_g"))
    rows = _numbered(rows, [(F.col(lo) + F.col(h)) / 2 for lo, h in zip(LOW, HIGH)], [*keys, "_g"], ident, bucket)
    ends = [F.min(c).alias(c) for c in LOW] + [F.max(c).alias(c) for c in HIGH]
    held = rows.groupBy(*keys, "_g", "_b").agg(*ends, F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(ident, *payload))).alias("_items"))
    held = held.select(*keys, "_g", "_b", *BOX, "n", *[F.col("_items")[c].alias(f"_p_{c}") for c in (ident, *payload)])
    levels = [keep(held, "buckets")]
    seen = levels[0].agg(F.count(F.lit(1)), F.avg(F.greatest(*[F.col(h) - F.col(lo) for lo, h in zip(LOW, HIGH)])), *ends).first()
    sizes, wide, box = [seen[0]], seen[1], tuple(v or 0.0 for v in seen[2:])
    # many trees have more roots in all, but each ends at a single number
    while sizes[-1] > ROOTS and (not keys or levels[-1].agg(F.max("_b")).first()[0] > 0):
        below = levels[-1].withColumn("_up", F.shiftright("_b", FAN_BITS))
        above = below.groupBy(*keys, "_g", F.col("_up").alias("_b")).agg(*ends, F.sum("n").alias("n"), F.collect_list(F.struct("_b", *BOX, "n")).alias("kids"))
        levels.append(keep(above, "boxes"))
        sizes.append(levels[-1].count())
    forget(rows)
    return BoxTree(levels, sizes, wide or 0.0, box)


def query_blocks(queries: DataFrame, tree: BoxTree) -> DataFrame:
    """Blocks of up to 64 neighbouring queries (id, x, y, z) inside one cell.

    A cell is as wide as a usual bucket. Far from all items distances to them
    differ by little, so there cells shrink with the distance, at last to one
    query, and the blocks' own extent doesn't blur those differences.
    """
    rows = _numbered(queries, [F.col(a) for a in "xyz"], [], "id", BLOCK)
    gaps = [F.greatest(F.lit(0.0), F.lit(lo) - F.col(a), F.col(a) - F.lit(hi)) for a, lo, hi in zip("xyz", tree.box[:3], tree.box[3:])]
    cells = [F.col(a).alias(f"_{a}") for a in "xyz"]
    if tree.width > 0:
        away = F.greatest(F.sqrt(sum((v * v for v in gaps), F.lit(0.0))), F.lit(tree.width))
        rows = rows.withColumn("_w", tree.width * F.pow(F.lit(2.0), F.floor(F.log2(tree.width / away))))
        cells = ["_w", *[F.floor(F.col(a) / F.col("_w")).alias(f"_{a}") for a in "xyz"]]
    ends = [F.min(a).alias(c) for a, c in zip("xyz", LOW)] + [F.max(a).alias(c) for a, c in zip("xyz", HIGH)]
    out = rows.groupBy("_b", *cells).agg(F.min("_at").alias("_q"), *ends, F.array_sort(F.collect_list(F.struct("id", "x", "y", "z"))).alias("_items"))
    blocks = keep(out.select("_q", *BOX, *[F.col("_items")[c].alias(f"_q_{c}") for c in ("id", "x", "y", "z")]), "blocks")
    forget(rows)
    return blocks


def _prune(rows: DataFrame, need: int) -> DataFrame:
    """Drop boxes that lie beyond a distance within which a block surely has ``need`` items."""
    gaps = [F.greatest(F.lit(0.0), F.col(lo) - F.col(f"q{h}"), F.col(f"q{lo}") - F.col(h)) for lo, h in zip(LOW, HIGH)]
    far = [F.greatest(F.col(h) - F.col(f"q{lo}"), F.col(f"q{h}") - F.col(lo)) for lo, h in zip(LOW, HIGH)]
    rows = rows.withColumns({"_near": F.sqrt(sum((v * v for v in gaps), F.lit(0.0))), "_far": F.sqrt(sum((v * v for v in far), F.lit(0.0)))})
    rows = rows.withColumn("_sum", F.sum("n").over(Window.partitionBy("_q").orderBy("_far", "_g", "_b")))
    reach = F.min(F.when(F.col("_sum") >= need, F.col("_far"))).over(Window.partitionBy("_q"))
    rows = rows.withColumn("_reach", reach)
    return rows.where(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach") * SLACK)).drop("_reach")


def candidate_buckets(blocks: DataFrame, tree: BoxTree, need: int) -> DataFrame:
    """(_q, _g, _b, _near, _far, n, _sum): buckets that may hold one of the ``need`` nearest of a query in the block."""
    top = tree.top
    at = [F.col(c).alias(f"q{c}") for c in BOX]
    if not top:
        return blocks.select("_q", F.lit(0).alias("_g"), F.lit(0).cast("long").alias("_b"), *[F.lit(0.0).alias(c) for c in ("_near", "_far")], F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("_sum")).limit(0)
    nodes = F.from_json(F.lit(json.dumps([r.asDict() for r in top])), NODES)
    rows = _prune(blocks.select("_q", *at, F.inline(nodes)), need)
    for level, size in list(zip(tree.levels, tree.sizes))[:0:-1]:
        kids = level.select("_g", "_b", "kids")
        kids = F.broadcast(kids) if size <= BROADCAST_NODES else kids
        down = rows.select("_q", *[f"q{c}" for c in BOX], "_g", "_b").join(kids, ["_g", "_b"])
        rows = _prune(down.select("_q", *[f"q{c}" for c in BOX], "_g", F.inline("kids")), need)
    return rows.select("_q", "_g", "_b", "_near", "_far", "n", "_sum")


#: distances (queries by items) and, for chosen pairs, their feet
Kernel = Callable[[np.ndarray, Sequence[np.ndarray]], tuple[np.ndarray, Callable | None]]


def _often(pairs: DataFrame) -> DataFrame:
    """Buckets wanted by more than a thousandth of all pairs, so fewer than a thousand; they are broadcast and heat no task."""
    wanted = pairs.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_wanted"))
    return keep(wanted.where(F.col("_wanted") * HOT > F.lit(pairs.count())).select("_g", "_b"), "often")


def _verify(pairs: DataFrame, blocks: DataFrame, tree: BoxTree, often: DataFrame, limits: DataFrame | None, ident: str, payload: Sequence[str], k: int, kernel: Kernel, exclude_self: bool, foot: bool) -> DataFrame:
    """Up to k items a query and bucket, none beyond the query's limit: _q, _i, id, item, distance (, foot)."""
    spark = pairs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = tree.levels[0].select("_g", "_b", *BOX, *[f"_p_{c}" for c in (ident, *payload)])
    hot = F.broadcast(bucket.join(F.broadcast(often), ["_g", "_b"]))
    narrow = pairs.select("_q", "_g", "_b").repartition(tasks, "_q", "_g", "_b")
    rows = narrow.join(hot, ["_g", "_b"]).unionByName(narrow.join(F.broadcast(often), ["_g", "_b"], "left_anti").join(bucket, ["_g", "_b"])).drop("_g", "_b")
    rows = rows.join(blocks.drop(*BOX), "_q")
    rows = rows.join(limits, "_q", "left") if limits is not None else rows.withColumn("_limits", F.lit(None).cast("array<double>"))
    names = [f"_p_{c}" for c in payload]
    schema = T.StructType([
        T.StructField("_q", T.LongType()), T.StructField("_i", T.IntegerType()),
        T.StructField("id", blocks.schema["_q_id"].dataType.elementType), T.StructField("item", bucket.schema[f"_p_{ident}"].dataType.elementType),
        T.StructField("distance", T.DoubleType()), *([T.StructField("foot", T.ArrayType(T.DoubleType()))] if foot else []),
    ])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[n : n + PAIRS] for b in batches for n in range(0, len(b), PAIRS)):
            out = {f.name: [] for f in schema.fields}
            for row in batch.to_dict("records"):
                ids, items = np.asarray(row["_q_id"]), np.asarray(row[f"_p_{ident}"])
                at = np.stack([row["_q_x"], row["_q_y"], row["_q_z"]], axis=1)
                limit = np.full(len(ids), np.inf) if row["_limits"] is None else np.asarray(row["_limits"])
                low, high = (np.array([row[c] for c in side]) for side in (LOW, HIGH))
                gap = np.maximum(0.0, np.maximum(low - at, at - high))
                (some,) = np.nonzero(np.sqrt((gap * gap).sum(axis=1)) <= limit * SLACK)
                if not len(some):
                    continue
                distance, feet = kernel(at[some], [np.asarray(row[c], float) for c in names])
                if exclude_self:
                    distance = np.where(ids[some, None] == items[None, :], np.inf, distance)
                distance = np.where(distance <= limit[some, None], distance, np.inf)
                best = np.argsort(distance, axis=1, kind="stable")[:, :k] if k > 1 else distance.argmin(axis=1)[:, None]
                i, j = np.repeat(np.arange(len(some)), best.shape[1]), best.ravel()
                hit = np.isfinite(distance[i, j])
                i, j = i[hit], j[hit]
                out["_q"].append(np.full(len(i), row["_q"]))
                out["_i"].append(some[i].astype("int32"))
                out["id"].append(ids[some[i]])
                out["item"].append(items[j])
                out["distance"].append(distance[i, j])
                out["foot"].extend(feet(i, j))
            if out["_q"]:
                yield pd.DataFrame({c: v if c == "foot" else np.concatenate(v) for c, v in out.items()})

    def nearest_at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The same for kernels without feet: a row a query and bucket, its items beside it."""
        for batch in (b.iloc[n : n + PAIRS] for b in batches for n in range(0, len(b), PAIRS)):
            yield _nearest_rows(batch, ident, names, k, kernel, exclude_self)

    return rows.mapInPandas(nearest if foot else nearest_at_once, schema)


def _nearest_rows(batch: pd.DataFrame, ident: str, names: Sequence[str], k: int, kernel: Kernel, exclude_self: bool) -> pd.DataFrame:
    """Up to k items of each query and bucket of ``batch`` within the query's limit, ties by their order."""
    flat = lambda c: np.concatenate([np.asarray(v) for v in batch[c]])
    asked, held = batch["_q_id"].map(len).to_numpy(), batch[f"_p_{ident}"].map(len).to_numpy()
    pair = np.repeat(np.arange(len(batch)), asked)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(asked) - asked, asked)
    at, ids = np.stack([flat(f"_q_{a}").astype(float) for a in "xyz"], axis=1), flat("_q_id")
    limit = np.concatenate([np.full(n, np.inf) if v is None else np.asarray(v, float) for n, v in zip(asked, batch["_limits"], strict=True)])
    low, high = (batch[list(side)].to_numpy(float)[pair] for side in (LOW, HIGH))
    gap = np.maximum(0.0, np.maximum(low - at, at - high))
    (some,) = np.nonzero(np.sqrt((gap * gap).sum(axis=1)) <= limit * SLACK)
    # buckets as rows of equal length: items beyond a bucket's own repeat its last and don't count
    start = np.cumsum(held) - held
    spot = start[:, None] + np.minimum(np.arange(held.max()), held[:, None] - 1)
    there = np.arange(held.max()) < held[:, None]
    items, of = flat(f"_p_{ident}")[spot], pair[some]
    columns = [flat(c).astype(float)[spot] for c in names]
    distance, _ = kernel(at[some], [c[of] for c in columns])
    out = there[of] & (distance <= limit[some, None])
    if exclude_self:
        out &= ids[some, None] != items[of]
    distance = np.where(out, distance, np.inf)
    rows, found = np.arange(len(some)), []
    for _ in range(min(k, distance.shape[1])):
        best = distance.argmin(axis=1)
        value = distance[rows, best]
        hit = np.isfinite(value)
        found.append((rows[hit], best[hit], value[hit]))
        distance[rows, best] = np.inf
    row, best, value = (np.concatenate(v) for v in zip(*found, strict=True))
    return pd.DataFrame({
        "_q": batch["_q"].to_numpy()[of[row]], "_i": place[some[row]].astype("int32"), "id": ids[some[row]], "item": items[of[row], best], "distance": value,
    })


def search(queries: DataFrame, items: DataFrame, ident: str, payload: Sequence[str], k: int, kernel: Kernel, need: int | None = None, exclude_self: bool = False, foot: bool = False, bucket: int = 32) -> DataFrame:
    """The k nearest items of each query, ties by ``ident``: id, item, distance, rank (, foot). Exact."""
    need = need or k
    items = keep(items, "items")
    tree = build(items, ident, payload, bucket)
    blocks = query_blocks(keep(queries.where(finite("x", "y", "z")).select("id", "x", "y", "z"), "queries"), tree)
    left, found, limits = keep(candidate_buckets(blocks, tree, need), "candidates"), None, None
    often = _often(left)
    used = [items, blocks, left, often]
    by_id = Window.partitionBy("id").orderBy("distance", "item")
    crowded = left.count() > FEW * blocks.count()
    for step in ("surest", "nearest", "rest") if crowded else ("surest", "rest"):
        if step == "surest":
            # the buckets that alone hold enough items within the reach
            left = left.withColumn("_now", F.col("_sum") - F.col("n") < need)
        else:
            limits = keep(_limits(found, blocks, k), "limits")
            order = Window.partitionBy("_q").orderBy("_near", "_far", "_g", "_b")
            near = left.join(limits.select("_q", "_reach"), "_q", "left").where(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach") * SLACK)).drop("_reach")
            left = keep(near.withColumn("_now", F.row_number().over(order) <= SECOND if step == "nearest" else F.lit(True)), "candidates")
            used += [limits, left]
            if left.isEmpty():
                break
        lists = limits.select("_q", "_limits") if limits is not None else None
        fresh = _verify(left.where("_now"), blocks, tree, often, lists, ident, payload, k, kernel, exclude_self, foot)
        both = fresh if found is None else found.drop("rank").unionByName(fresh)
        if found is not None:
            used.append(found)
        found = keep(both.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k), "found")
        left = left.where("NOT _now").drop("_now")
    tree.forget()
    for table in used:
        forget(table)
    return found.select("id", "item", "distance", "rank", *(["foot"] if foot else []))


def _limits(found: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Per block the k-th distance of each of its queries so far, in their order, and the largest of them.

    Queries with fewer than k items have no limit (infinity); lists are as long as a block.
    """
    each = found.groupBy("_q", "_i").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).where(F.col("n") >= k)
    known = each.groupBy("_q").agg(F.map_from_entries(F.collect_list(F.struct("_i", "d"))).alias("_known"))
    spots = F.sequence(F.lit(0), F.size("_q_id") - 1)
    got = blocks.join(known, "_q").select("_q", F.transform(spots, lambda i: F.coalesce(F.try_element_at("_known", i), F.lit(float("inf")))).alias("_limits"))
    return got.withColumn("_reach", F.array_max("_limits"))


# -- kernels -----------------------------------------------------------------------


def to_points(at: np.ndarray, columns: Sequence[np.ndarray]) -> tuple[np.ndarray, None]:
    """Distances of queries to points, the same for all or a row of points each."""
    delta = at[:, None, :] - np.stack(columns, axis=-1)
    return np.sqrt((delta * delta).sum(axis=2)), None


def to_triangles(at: np.ndarray, columns: Sequence[np.ndarray]) -> tuple[np.ndarray, Callable]:
    """Distances of queries to triangles: to the plane if the foot lies inside, else to the nearest side."""
    corners = [np.stack(columns[3 * i : 3 * i + 3], axis=1) for i in range(3)]
    normal = np.cross(corners[1] - corners[0], corners[2] - corners[0])
    square = (normal * normal).sum(axis=1)
    along = lambda v, w: np.einsum("qtk,tk->qt", v, w)
    height = along(at[:, None, :] - corners[0][None], normal) / np.where(square > 0, square, 1.0)
    inside = np.broadcast_to(square > 0, height.shape)
    best, side_no, share_on = np.full(height.shape, np.inf), np.zeros(height.shape, int), np.zeros(height.shape)
    sides = [corners[(i + 1) % 3] - corners[i] for i in range(3)]
    for i, side in enumerate(sides):
        off = at[:, None, :] - corners[i][None]
        # the normal component of ``off`` drops out, so this asks for the foot's place
        inside = inside & (along(off, np.cross(normal, side)) >= 0)
        length = (side * side).sum(axis=1)
        share = np.clip(along(off, side) / np.where(length > 0, length, 1.0), 0.0, 1.0)
        off = off - share[:, :, None] * side[None]
        apart = np.sqrt(np.einsum("qtk,qtk->qt", off, off))
        nearer = apart < best
        best, side_no, share_on = np.where(nearer, apart, best), np.where(nearer, i, side_no), np.where(nearer, share, share_on)

    def feet(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        start, side = np.stack(corners)[side_no[i, j], j], np.stack(sides)[side_no[i, j], j]
        return np.where(inside[i, j, None], at[i] - height[i, j, None] * normal[j], start + share_on[i, j, None] * side)

    return np.where(inside, np.abs(height) * np.sqrt(square)[None], best), feet
