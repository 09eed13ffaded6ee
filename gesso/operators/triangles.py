"""Nearest triangles by pages of triangles that stay where they are; the points travel.

Triangles lie in pages of ``PAGE``, neighbours on a Z-order curve, and move
once. Points travel in blocks of up to ``BLOCK`` to the pages that may hold
something nearer than what is known: the first triangle of each row of a page
is searched before, and the first of each row of those before that, down to
at most ``SEEDS`` that are compared with all points. So wide or stacked
triangles, whose boxes all overlap, don't make all pairs of block and page.

Inside a page a block drops triangles whose box is out of reach, then those
whose plane is: one matrix product. What is left gets its exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gesso.operators import boxtree as bt
from gesso.session import forget, keep, spread, tasks_for

CORNERS = tuple(f"{a}{i}" for i in (1, 2, 3) for a in "xyz")
#: triangles a page, and pages at most (beyond that a page holds more)
PAGE, PAGES = 4096, 1 << 15
#: triangles that are compared with all points, at most
SEEDS = 1 << 15
#: points a block, and blocks of a task's that meet a page together
BLOCK, VISITS = 64, 256
#: share of the largest coordinate by which rounding may move a distance or a bound
ROUND = 1e-12


def _plain(values: Sequence) -> list:
    """Names as Spark had them: numbers that pandas holds as floats beside missing ones are whole again, missing ones None."""
    held = pd.Series(values)
    if not held.hasnans:
        return held.tolist()
    return [None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v for v in held]


def build_pages(items: DataFrame, n: int, leaf: int) -> DataFrame:
    """Rows of up to ``leaf`` triangles in Z-order: page, box (x0..z1), f, corners as raw doubles, and the ``first`` one's.

    Triangles are ordered by the power of four of their width first, so wide
    ones have pages of their own; a page is cut where that power changes. The
    curve's axes are as long as a usual triangle along them, so that steep
    triangles aren't cut into layers whose boxes all overlap.
    """
    spark = items.sparkSession
    ends = [f(*[F.col(f"{a}{i}") for i in (1, 2, 3)]).alias(f"_{a}{k}") for k, f in ((0, F.least), (1, F.greatest)) for a in "xyz"]
    rows = items.select("f", *CORNERS, *ends)
    width = F.greatest(*[F.col(f"_{a}1") - F.col(f"_{a}0") for a in "xyz"])
    rows = rows.withColumn("_g", F.coalesce(F.when(width > 0, F.floor(F.log2(width) / 2)), F.lit(-600)).cast("int"))
    usual = items.agg(*[F.avg(F.greatest(*[F.col(f"{a}{i}") for i in (1, 2, 3)]) - F.least(*[F.col(f"{a}{i}") for i in (1, 2, 3)])) for a in "xyz"]).first()
    least = max([v or 0.0 for v in usual]) / 1000 or 1.0
    centre = [(F.col(f"_{a}0") / 2 + F.col(f"_{a}1") / 2) / max(v or 0.0, least) for a, v in zip("xyz", usual, strict=True)]
    order = ["_g", "_z", "_zz", "f"]
    rows = bt._z_order(rows, centre).select("f", *CORNERS, *order[:-1]).repartitionByRange(tasks_for(n, spark), *order).sortWithinPartitions(*order)
    page = max(PAGE, -(-n // PAGES))
    schema = T.StructType([T.StructField("page", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in bt.BOX], T.StructField("f", T.ArrayType(items.schema["f"].dataType)), T.StructField("corners", T.BinaryType()), T.StructField("first", T.BinaryType())])

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, left, group, held = TaskContext.get().partitionId() << 40, 0, None, 0
        for pdf in batches:
            out, groups = [], pdf["_g"].to_numpy()
            corners, names, at = pdf[list(CORNERS)].to_numpy(float).reshape(-1, 3, 3), _plain(pdf["f"]), 0
            cuts = [*(np.flatnonzero(np.diff(groups)) + 1), len(groups)]
            for end in cuts:
                while at < end:
                    if groups[at] != group or held >= page:
                        left, group, held = left + 1, groups[at], 0
                    some = slice(at, min(at + leaf, end, at + page - held))
                    part = corners[some]
                    low, high = part.min(axis=(0, 1)), part.max(axis=(0, 1))
                    out.append((here + left, *low, *high, names[some], part.tobytes(), part[0].tobytes()))
                    held, at = held + len(part), some.stop
            yield pd.DataFrame(out, columns=schema.names)

    return keep(rows.select("f", *CORNERS, "_g").mapInPandas(leaves, schema), "pages", True)


def _sample(leaves: DataFrame) -> DataFrame:
    """The first triangle of each row as a row; the others aren't read."""
    fields = [leaves.schema["page"], *[T.StructField(c, T.DoubleType()) for c in CORNERS]]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.frombuffer(b"".join(pdf["first"])).reshape(-1, 9)
            yield pd.DataFrame({"page": pdf["page"], **{c: at[:, i] for i, c in enumerate(CORNERS)}})

    return keep(leaves.select("page", "first").mapInPandas(first, T.StructType(fields)).withColumnRenamed("page", "f"), "sample")


class Faces:
    """Triangles with what rules them out (boxes, planes) and what their distances take."""

    def __init__(self, corners: np.ndarray):
        self.corners = corners
        self.low, self.high = corners.min(axis=1).T.copy(), corners.max(axis=1).T.copy()
        self.starts = [np.ascontiguousarray(corners[:, i]) for i in range(3)]
        self.sides = [self.starts[(i + 1) % 3] - self.starts[i] for i in range(3)]
        self.normal = np.cross(self.sides[0], self.starts[2] - self.starts[0])
        self.square = (self.normal * self.normal).sum(axis=1)
        self.inward = [np.cross(self.normal, side) for side in self.sides]
        self.lengths = [(side * side).sum(axis=1) for side in self.sides]
        length = np.sqrt(self.square)[:, None]
        self.unit = np.divide(self.normal, length, out=np.zeros_like(self.normal), where=length > 0)
        level = np.einsum("nik,nk->ni", corners, self.unit)
        # a point of the triangle is between its corners' levels, whatever rounding did to the normal
        self.least, self.most = level.min(axis=1), level.max(axis=1)
        self.scale = float(np.abs(corners).max()) if len(corners) else 0.0

    def measure(self, at: np.ndarray, j: np.ndarray, feet: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Distances of points to the triangles ``j``, one each, and their feet, as ``boxtree.to_triangles`` has them."""
        along = lambda v, w: np.einsum("nk,nk->n", v, w)
        normal, square = self.normal[j], self.square[j]
        inside, best, foot = square > 0, np.full(len(at), np.inf), np.empty_like(at) if feet else None
        for i in range(3):
            side, length = self.sides[i][j], self.lengths[i][j]
            off = at - self.starts[i][j]
            if not i:
                height = along(off, normal) / np.where(square > 0, square, 1.0)
            inside &= along(off, self.inward[i][j]) >= 0
            share = along(off, side) / np.where(length > 0, length, 1.0)
            off -= np.minimum(np.maximum(share, 0.0), 1.0)[:, None] * side
            apart = np.sqrt(along(off, off))
            if feet:
                nearer = apart < best
                foot[nearer] = (self.starts[i][j] + np.clip(share, 0.0, 1.0)[:, None] * side)[nearer]
            best = np.minimum(best, apart)
        if feet:
            foot = np.where(inside[:, None], at - height[:, None] * normal, foot)
        return np.where(inside, np.abs(height) * np.sqrt(square), best), foot

    def nearest(self, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the nearest triangle of each point within its reach (the first of equals), -1 without one, and its distance."""
        found, best = np.full(len(at), -1), np.full(len(at), np.inf)
        pad = ROUND * max(self.scale, float(np.abs(at).max()))
        lo, hi = (at - reach[:, None] - pad).min(axis=0), (at + reach[:, None] + pad).max(axis=0)
        limit, near = reach * (1 + 1e-9) + pad, np.ones(self.low.shape[1], bool)
        for k in range(3):
            near &= (self.low[k] <= hi[k]) & (self.high[k] >= lo[k])
        near = np.flatnonzero(near)
        place = np.arange(len(near))
        # a few from all over come first, then more: the others have those to beat
        turns = [near[place % 64 == 0], near[(place % 8 == 0) & (place % 64 > 0)], near[place % 8 > 0]] if len(near) > 64 else [near]
        for part in (turn[n : n + 2048] for turn in turns for n in range(0, len(turn), 2048)):
            level = at @ self.unit[part].T
            apart = np.maximum(level - self.most[part], self.least[part] - level)
            i, j = np.nonzero(apart <= (reach * (1 + 1e-9) + pad)[:, None])
            j = part[j]
            for k in range(3):
                ok = (self.low[k][j] <= (at[:, k] + reach + pad)[i]) & (self.high[k][j] >= (at[:, k] - reach - pad)[i])
                i, j = i[ok], j[ok]
            if not len(i):
                continue
            distance, _ = self.measure(at[i], j)
            # of each point the nearest, the first of equals
            nearest = np.full(len(at), np.inf)
            np.minimum.at(nearest, i, distance)
            top = distance == nearest[i]
            i, j = i[top], j[top]
            first = np.full(len(at), len(self.square))
            np.minimum.at(first, i, j)
            better = (nearest <= limit) & ((nearest < best) | ((nearest == best) & (first < found)))
            found, best = np.where(better, first, found), np.where(better, nearest, best)
            reach = np.minimum(reach, best)
        return found, best


def _parts(at: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of points in groups of up to ``most``, cut across the longest side: at its widest gap, or in the middle."""
    out, todo = [], [np.arange(len(at))]
    while todo:
        some = todo.pop()
        if len(some) <= 8:
            out.append(some)
            continue
        part = at[some]
        wide = np.ptp(part, axis=0)
        axis = int(wide.argmax())
        order = np.argsort(part[:, axis], kind="stable")
        gaps = np.diff(part[order, axis])
        gap = int(gaps.argmax())
        if gaps[gap] > wide[axis] / 2:
            middle = gap + 1
        elif len(some) > most:
            middle = len(some) // 2
        else:
            out.append(some)
            continue
        todo += [some[order[middle:]], some[order[:middle]]]
    return out


def _blocks(queries: DataFrame, seeds: np.ndarray) -> DataFrame:
    """Blocks of neighbouring points: _q, their ids, coordinates, and the distance of each to the nearest of ``seeds``."""
    kind = queries.schema["id"].dataType.simpleString()
    order = ["_z", "_zz", "id"]
    rows = bt._z_order(queries, [F.col(a) for a in "xyz"])
    rows = rows.repartitionByRange(tasks_for(0, queries.sparkSession), *order).sortWithinPartitions(*order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        faces, middles, number = Faces(seeds), seeds.mean(axis=1), TaskContext.get().partitionId() << 40
        for pdf in batches:
            out, every, ids = [], pdf[["x", "y", "z"]].to_numpy(float), _plain(pdf["id"])
            for some in _parts(every, BLOCK):
                at = every[some]
                # a seed near the middle bounds the search
                away = middles - at.mean(axis=0)
                reach, _ = faces.measure(at, np.full(len(at), (away * away).sum(axis=1).argmin()))
                reach = np.minimum(reach, faces.nearest(at, reach)[1])
                out.append((number, [ids[i] for i in some], at.tobytes(), reach.tobytes()))
                number += 1
            yield pd.DataFrame(out, columns=["_q", "ids", "at", "reach"])

    return keep(rows.select("id", *"xyz").mapInPandas(fold, f"_q long, ids array<{kind}>, at binary, reach binary"), "blocks")


def _visits(blocks: DataFrame, boxes: dict[str, np.ndarray]) -> DataFrame:
    """A row for each block and page in reach, with places and coordinates of the block's points that may find something there.

    ``part`` numbers a page's visitors by task and in hundreds, so that a page which many ask is asked in many tasks.
    """
    low, high = boxes["low"], boxes["high"]
    scale = max(float(np.abs(low).max()), float(np.abs(high).max()))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, asked = TaskContext.get().partitionId() << 24, np.zeros(len(low), int)
        for pdf in batches:
            for n in range(0, len(pdf), BLOCK):
                out = []
                for q, raw, known, places, nearer in pdf.iloc[n : n + BLOCK].itertuples(index=False, name=None):
                    at, reach = np.frombuffer(raw).reshape(-1, 3), np.frombuffer(known).copy()
                    if places is not None:
                        np.minimum.at(reach, np.asarray(places, int), np.asarray(nearer))
                    pad = ROUND * max(scale, float(np.abs(at).max()))
                    gap = np.maximum(0.0, np.maximum(low - at.max(axis=0), at.min(axis=0) - high))
                    for k in np.flatnonzero(np.sqrt((gap * gap).sum(axis=1)) <= reach.max() * (1 + 1e-9) + pad):
                        gaps = np.maximum(0.0, np.maximum(low[k] - at, at - high[k]))
                        (some,) = np.nonzero(np.sqrt((gaps * gaps).sum(axis=1)) <= reach * (1 + 1e-9) + pad)
                        if len(some):
                            out.append((boxes["page"][k], here + asked[k] // VISITS, q, some.astype("int32").tobytes(), at[some].tobytes(), reach[some].tobytes()))
                            asked[k] += 1
                yield pd.DataFrame(out, columns=["page", "part", "_q", "i", "at", "reach"])

    rows = blocks.select("_q", "at", "reach", *(["places", "nearer"] if "places" in blocks.columns else [F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<double>").alias("nearer")]))
    return keep(rows.mapInPandas(visit, "page long, part long, _q long, i binary, at binary, reach binary"), "visits", True)


def _answers(leaves: DataFrame, visits: DataFrame) -> DataFrame:
    """Of each visit the nearest triangle of each point: _q, i, f, distance, foot (fx, fy, fz)."""
    asked = visits.select("page", "part").distinct()
    kind = leaves.schema["f"].dataType
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    held = leaves.join(asked, "page").select("page", "part", F.lit(0).alias("_kind"), "f", "corners", none("_q", "long"), *[none(c, "binary") for c in ("i", "at", "reach")])
    come = visits.select("page", "part", F.lit(1).alias("_kind"), none("f", kind), none("corners", "binary"), "_q", "i", "at", "reach")
    # a page's triangles come before its visitors
    rows = spread(held.unionByName(come), "page", "part").sortWithinPartitions("page", "part", "_kind", "_q")
    columns = ["_q", "i", "f", "distance", "fx", "fy", "fz"]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, raw, names, faces = None, [], [], None
        for pdf in batches:
            out: list[tuple] = []
            for page, part, visitor, f, corners, q, i, at, reach in pdf.itertuples(index=False, name=None):
                if (page, part) != place:
                    place, raw, names, faces = (page, part), [], [], None
                if not visitor:
                    raw.append(np.frombuffer(corners))
                    names.append(f)
                    continue
                if faces is None:
                    names = np.concatenate(names)
                    order = _order(names)
                    faces, names, raw = Faces(np.concatenate(raw).reshape(-1, 3, 3)[order]), names[order], []
                at = np.frombuffer(at).reshape(-1, 3)
                found, distance = faces.nearest(at, np.frombuffer(reach))
                (hit,) = np.nonzero(found >= 0)
                if len(hit):
                    _, foot = faces.measure(at[hit], found[hit], feet=True)
                    out.append((np.full(len(hit), int(q)), np.frombuffer(i, "int32")[hit], names[found[hit]], distance[hit], *foot.T))
                if len(out) >= VISITS:
                    yield _table(columns, out)
                    out = []
            if out:
                yield _table(columns, out)

    return rows.mapInPandas(meet, T.StructType([T.StructField("_q", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("f", kind.elementType), *[T.StructField(c, T.DoubleType()) for c in columns[3:]]]))


def _table(columns: Sequence[str], rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate(v) for c, v in zip(columns, zip(*rows, strict=True), strict=True)})


def _order(names: np.ndarray) -> np.ndarray:
    """Places of names in their order, missing ones first."""
    there = ~pd.isna(names)
    if names.dtype == object:
        return np.array(sorted(range(len(names)), key=lambda k: (there[k], names[k] if there[k] else 0)), int)
    return np.lexsort((np.arange(len(names)), names, there))


def _boxes(leaves: DataFrame) -> dict[str, np.ndarray]:
    """The pages' boxes, at most ``PAGES`` and those that end a task or a width early."""
    ends = [F.min(c).alias(c) for c in bt.LOW] + [F.max(c).alias(c) for c in bt.HIGH]
    seen = leaves.groupBy("page").agg(*ends).orderBy("page").toPandas()
    return {"page": seen["page"].to_numpy(), "low": seen[list(bt.LOW)].to_numpy(float), "high": seen[list(bt.HIGH)].to_numpy(float)}


def nearest(queries: DataFrame, triangles: DataFrame, leaf: int = 32) -> DataFrame:
    """Nearest of ``triangles`` (f, x1..z3, doubles) of each of ``queries`` (id, x, y, z, doubles): id, f, distance, foot; ties by f. Exact.

    All coordinates are finite. The searches of points of one id count as one.
    """
    queries = keep(queries, "queries")
    items = keep(triangles, "triangles", True)
    levels: list[DataFrame] = []
    while (n := items.count()) > SEEDS or not levels:
        levels.append(build_pages(items, n, leaf))
        forget(items)
        items = _sample(levels[-1])
    seeds = items.select(*CORNERS).toPandas().to_numpy(float).reshape(-1, 3, 3)
    forget(items)
    if not len(seeds):
        return queries.select("id", F.lit(None).cast(triangles.schema["f"].dataType).alias("f"), F.lit(0.0).alias("distance"), F.array(F.lit(0.0)).alias("foot")).limit(0)
    blocks = rows = _blocks(queries, seeds)
    for leaves in levels[::-1]:
        visits = _visits(rows, _boxes(leaves))
        answers = _answers(leaves, visits)
        if leaves is levels[0]:
            best = answers.groupBy("_q", "i").agg(F.min(F.struct("distance", "f", "fx", "fy", "fz")).alias("b"))
            named = blocks.select("_q", F.posexplode("ids").alias("i", "id")).join(best, ["_q", "i"])
            one = named.groupBy("id").agg(F.min("b").alias("b"))
            found = keep(one.select("id", "b.f", "b.distance", F.array("b.fx", "b.fy", "b.fz").alias("foot")), "found")
        else:
            better = answers.groupBy("_q").agg(F.collect_list(F.struct("i", "distance")).alias("b")).select("_q", F.col("b.i").alias("places"), F.col("b.distance").alias("nearer"))
            rows = keep(blocks.join(better, "_q", "left"), "blocks", True)
        forget(visits)
        forget(leaves)
    for table in {id(t): t for t in (queries, blocks, rows)}.values():
        forget(table)
    return found
