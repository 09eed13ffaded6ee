"""Iterative jobs over face and vertex graphs.

Each round is a few joins and aggregates; rounds end in a checkpoint so that
plans stay short and survive lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gesso.operators import grid as gr
from gesso.session import keep


def both_ways(edges: DataFrame, a: str = "f1", b: str = "f2") -> DataFrame:
    """Directed copies u -> v without self loops."""
    two = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    return edges.where(F.col(a) != F.col(b)).select(F.explode(two).alias("e")).select("e.*")


def label_energy(costs: DataFrame, edges: DataFrame, labels: DataFrame) -> float:
    """Sum of chosen costs plus 1 per edge between different labels."""
    unary = labels.join(costs.select("face", F.col("view").alias("label"), "cost"), ["face", "label"], "left")
    total = unary.agg(F.sum(F.coalesce("cost", F.lit(0.0)))).first()[0] or 0.0
    l1, l2 = labels.select(F.col("face").alias("f1"), F.col("label").alias("a")), labels.select(F.col("face").alias("f2"), F.col("label").alias("b"))
    cuts = edges.join(l1, "f1").join(l2, "f2").where("a <> b").count()
    return float(total + cuts)


def label_faces(costs: DataFrame, edges: DataFrame, max_rounds: int = 1000, min_gain: float = 0.01, patience: int = 5) -> DataFrame:
    """A view label per face; lower cost and fewer label changes win.

    ``costs``: face, view, cost; ``edges``: f1, f2. Starts from the cheapest
    view. In a round each face finds its best label given its neighbours, and
    moves if its gain is the largest around it (ties by number). Neighbours
    never move together, so the energy falls with every move. Stops when
    ``patience`` rounds together gain less than ``min_gain``. A local optimum.
    Faces without any view get label 0.
    """
    costs = keep(costs.groupBy("face", "view").agg(F.min("cost").alias("cost")))
    faces = edges.select(F.explode(F.array("f1", "f2")).alias("face")).union(costs.select("face")).distinct()
    links = keep(both_ways(edges.select("f1", "f2").distinct()).distinct())
    first = costs.groupBy("face").agg(F.min(F.struct("cost", "view")).alias("m")).select("face", F.col("m.view").alias("label"))
    labels = keep(faces.join(first, "face", "left").select("face", F.coalesce("label", F.lit(0)).alias("label")))
    gains: list[float] = []
    for _ in range(max_rounds):
        seen = links.join(labels.select(F.col("face").alias("v"), "label"), "v").groupBy(F.col("u").alias("face"), F.col("label").alias("view")).agg(F.count(F.lit(1)).alias("same"))
        option = costs.join(seen, ["face", "view"], "left").select("face", "view", (F.col("cost") - F.coalesce("same", F.lit(0))).alias("score"))
        best = option.groupBy("face").agg(F.min(F.struct("score", "view")).alias("m"))
        now = option.join(labels.select("face", F.col("label").alias("view")), ["face", "view"]).select("face", F.col("score").alias("_now"))
        want = keep(best.join(now, "face").select("face", F.col("m.view").alias("view"), (F.col("_now") - F.col("m.score")).alias("gain")).where("gain > 1e-12"))
        rival = links.join(want.select(F.col("face").alias("v"), "gain"), "v").groupBy(F.col("u").alias("face")).agg(F.max(F.struct("gain", (-F.col("v")).alias("n"))).alias("r"))
        moves = want.join(rival, "face", "left").where(F.col("r").isNull() | (F.struct("gain", (-F.col("face")).alias("n")) > F.col("r")))
        moves = keep(moves.select("face", "view", "gain"))
        total = moves.agg(F.sum("gain")).first()[0] or 0.0
        gains.append(total)
        if total > 0:
            labels = keep(labels.join(moves.select("face", "view"), "face", "left").select("face", F.coalesce("view", "label").alias("label")))
        if total == 0 or (len(gains) >= patience and sum(gains[-patience:]) < min_gain):
            return labels
    raise RuntimeError(f"labels still improve after {max_rounds} rounds")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node number of each component: node, component.

    ``nodes``: node; ``edges``: f1, f2. Every round takes the smallest
    component among neighbours and then jumps to that component's own one, so
    long chains shrink in few rounds. Hot nodes only mean aggregation.
    """
    links = keep(both_ways(edges).distinct())
    comp = keep(nodes.select("node", F.col("node").alias("c")).distinct())
    while True:
        near = links.join(comp.select(F.col("node").alias("v"), "c"), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("n"))
        step = comp.join(near, "node", "left").select("node", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        # hook the old representative to the new one, then jump
        hook = step.groupBy(F.col("old").alias("node")).agg(F.min("c").alias("h"))
        step = step.join(hook, "node", "left").select("node", "old", F.least("c", F.coalesce("h", "c")).alias("c"))
        step = keep(step)
        top = step.select(F.col("node").alias("c"), F.col("c").alias("up"))
        new = keep(step.join(top, "c", "left").select("node", "old", F.least(F.col("c"), F.coalesce("up", "c")).alias("c")))
        comp = new.select("node", "c")
        if new.where("c <> old").limit(1).count() == 0:
            break
    return comp.withColumnRenamed("c", "component")


def label_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of faces with equal labels (label 0 left out)."""
    used = labels.where("label <> 0")
    a, b = used.select(F.col("face").alias("f1"), F.col("label").alias("a")), used.select(F.col("face").alias("f2"), F.col("label").alias("b"))
    same = edges.join(a, "f1").join(b, "f2").where("a = b").select("f1", "f2")
    comp = connected_components(used.select(F.col("face").alias("node")), same)
    return used.join(comp.withColumnRenamed("node", "face"), "face")


def region_labels(mask: np.ndarray) -> np.ndarray:
    """4-connected regions of a plane: 0 outside, regions numbered from 1; runs of pixels are united, not pixels."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    n = len(row)
    if not n:
        return np.zeros((h, w), np.int32)
    # runs of the next row that a run touches: those that end after its start and start before its end
    width = w + 1
    lo = np.searchsorted(row * width + stop, (row + 1) * width + start, "right")
    hi = np.searchsorted(row * width + start, (row + 1) * width + stop, "left")
    times = np.maximum(hi - lo, 0)
    u = np.repeat(np.arange(n), times)
    v = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
    part = np.arange(n)
    while True:
        low = part.copy()
        for a, b in ((u, v), (v, u)):
            np.minimum.at(low, part[a], part[b])
            np.minimum.at(low, a, part[b])
        low = low[low]
        if (low == part).all():
            break
        part = low
    number = np.unique(part, return_inverse=True)[1] + 1
    out = np.zeros((h, w), np.int32)
    flat = np.repeat(row * w + start, stop - start) + np.arange((stop - start).sum()) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start)
    out.ravel()[flat] = np.repeat(number, stop - start)
    return out


def valid_region(pixels: DataFrame, value: str, tile: int = gr.TILE) -> DataFrame:
    """Pixels that belong to the picture: not black background joined to an
    image corner, one pixel away from it and from the border. Adds ``valid``.

    Black regions are labelled inside tiles; the graph that joins them has a
    node for each region at a tile border only, so it grows with the borders
    and not with the black area.
    """
    kind = pixels.schema["image_id"].dataType.simpleString()
    size = gr.tile_for(tile, 1)
    sized = gr.with_dims(pixels.select(*gr.KEY, F.col(value).alias("_v")))
    sized = sized.withColumns({"_ty": F.floor(F.col("y") / size).cast("int"), "_tx": F.floor(F.col("x") / size).cast("int")})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx, h, w = (int(pdf[c].iloc[0]) for c in ("_ty", "_tx", "_h", "_w"))
        y0, x0 = ty * size, tx * size
        ny, nx = min(size, h - y0), min(size, w - x0)
        there, black = np.zeros((ny, nx), bool), np.zeros((ny, nx), bool)
        iy, ix = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        there[iy, ix], black[iy, ix] = True, pdf["_v"].to_numpy() == 0
        found = region_labels(black)
        corners = {int(found[y - y0, x - x0]) for y in (0, h - 1) for x in (0, w - 1) if y0 <= y < y0 + ny and x0 <= x < x0 + nx} - {0}
        first = (ty * (w // size + 1) + tx) << 32
        name = lambda line: [first + int(k) if k else None for k in line]
        row = [pdf["image_id"].iloc[0], ty, tx, ny, nx, h, w, found.tobytes(), there.tobytes(), [first + k for k in sorted(corners)]]
        return pd.DataFrame([[*row, name(found[0]), name(found[-1]), name(found[:, 0]), name(found[:, -1])]], columns=columns)

    columns = ["image_id", "_ty", "_tx", "ny", "nx", "_h", "_w", "labels", "there", "corners", "north", "south", "west", "east"]
    schema = f"image_id {kind}, _ty int, _tx int, ny int, nx int, _h int, _w int, labels binary, there binary, corners array<long>, north array<long>, south array<long>, west array<long>, east array<long>"
    tiles = keep(sized.groupBy("image_id", "_ty", "_tx").applyInPandas(label, schema), "labels")

    def line(side: str, ty: Column, tx: Column, axis: str, name: str) -> DataFrame:
        rows = tiles.select("image_id", ty.alias("by"), tx.alias("bx"), F.lit(axis).alias("axis"), F.posexplode(side).alias("at", "n"))
        return rows.where("n IS NOT NULL").select("image_id", "by", "bx", "axis", "at", F.struct("image_id", "n").alias(name))

    ty, tx, key = F.col("_ty"), F.col("_tx"), ["image_id", "by", "bx", "axis", "at"]
    one = line("east", ty, tx, "x", "f1").unionByName(line("south", ty, tx, "y", "f1"))
    two = line("west", ty, tx - 1, "x", "f2").unionByName(line("north", ty - 1, tx, "y", "f2"))
    edges = keep(one.join(two, key).select("f1", "f2").distinct(), "links")
    seeds = keep(tiles.select("image_id", F.explode("corners").alias("n")).select(F.struct("image_id", "n").alias("node")), "seeds")
    nodes = edges.select(F.col("f1").alias("node")).unionByName(edges.select(F.col("f2").alias("node"))).unionByName(seeds).distinct()
    comp = connected_components(nodes, edges)
    back = comp.join(comp.join(seeds, "node", "left_semi").select("component").distinct(), "component", "left_semi")
    # the labels of a tile that are background: at most as many as its border has pixels, and its corners
    width = F.floor(F.col("_w") / size) + 1
    owned = tiles.select("image_id", "_ty", "_tx", (ty * width + tx).cast("bigint").alias("_tile"))
    marks = back.select(F.col("node.image_id").alias("image_id"), F.shiftright("node.n", 32).alias("_tile"), F.col("node.n").bitwiseAND((1 << 32) - 1).cast("int").alias("k"))
    marks = marks.groupBy("image_id", "_tile").agg(F.collect_set("k").alias("back")).join(owned, ["image_id", "_tile"]).drop("_tile")

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                found = np.frombuffer(t.labels, np.int32).reshape(t.ny, t.nx)
                there = np.frombuffer(t.there, bool).reshape(t.ny, t.nx)
                marked = np.isin(found, t.back) if t.back is not None else np.zeros(found.shape, bool)
                yy, xx = np.nonzero(there)
                yield pd.DataFrame({"image_id": t.image_id, "y": yy + t.ty * size, "x": xx + t.tx * size, "_h": t.h, "_w": t.w, "_b": marked[there].astype(np.int32)})

    drawn = tiles.join(marks, ["image_id", "_ty", "_tx"], "left").select("image_id", F.col("_ty").alias("ty"), F.col("_tx").alias("tx"), "ny", "nx", F.col("_h").alias("h"), F.col("_w").alias("w"), "labels", "there", "back")
    flags = drawn.mapInPandas(unfold, f"image_id {kind}, y int, x int, _h int, _w int, _b int")
    h = gr.halo(flags, 1, 1, "none", tile)
    near = F.max("_b").over(gr.along_x().rangeBetween(-1, 1))
    h = h.withColumn("_n", near).withColumn("_n", F.max("_n").over(gr.along_y().rangeBetween(-1, 1)))
    border = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("_h") - 1) | (F.col("x") == F.col("_w") - 1)
    return h.where("_core").select(*gr.KEY, ((F.col("_n") == 0) & ~border).alias("valid"))


def level_seams(
    nodes: DataFrame, seams: DataFrame, smooth: DataFrame, channels: Sequence[str] = ("d0",), weight: float = 0.1, tolerance: float = 1e-4, max_steps: int = 10_000
) -> tuple[DataFrame, int]:
    """Adjustment per (vertex, label) node that evens colours along seams.

    ``nodes``: node; ``seams``: n1, n2 and per channel the wanted difference
    x(n1) - x(n2); ``smooth``: n1, n2, neighbouring vertices of one label.
    Minimises squared seam errors plus ``weight`` squared times smoothness;
    each channel has mean 0. Conjugate gradients for all channels together:
    a step is one join along edges, one aggregate and the dot products.
    """
    k = len(channels)
    links = seams.select("n1", "n2", F.lit(1.0).alias("w")).unionByName(smooth.select("n1", "n2", F.lit(weight * weight).alias("w")))
    two = F.array(F.struct(F.col("n1").alias("u"), F.col("n2").alias("v"), "w"), F.struct(F.col("n2").alias("u"), F.col("n1").alias("v"), "w"))
    links = keep(links.select(F.explode(two).alias("e")).select("e.*").groupBy("u", "v").agg(F.sum("w").alias("w")))
    degree = links.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("deg"))
    signed = F.array(F.struct(F.col("n1").alias("node"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(channels)]),
                     F.struct(F.col("n2").alias("node"), *[(-F.col(c)).alias(f"b{i}") for i, c in enumerate(channels)]))
    right = seams.select(F.explode(signed).alias("s")).select("s.*").groupBy("node").agg(*[F.sum(f"b{i}").alias(f"b{i}") for i in range(k)])
    st = nodes.select("node").distinct().join(degree, "node", "left").join(right, "node", "left")
    st = keep(st.select(
        "node", F.coalesce("deg", F.lit(0.0)).alias("deg"), *[F.lit(0.0).alias(f"x{i}") for i in range(k)],
        *[F.coalesce(f"b{i}", F.lit(0.0)).alias(f"r{i}") for i in range(k)], *[F.coalesce(f"b{i}", F.lit(0.0)).alias(f"p{i}") for i in range(k)]))
    sums = lambda df, a, b: np.array([v or 0.0 for v in df.agg(*[F.sum(F.col(f"{a}{i}") * F.col(f"{b}{i}")) for i in range(k)]).first()])
    rr = sums(st, "r", "r")
    goal = tolerance**2 * rr
    steps = 0
    while steps < max_steps and np.any(rr > np.maximum(goal, 1e-24)):
        near = links.join(st.select(F.col("node").alias("v"), *[f"p{i}" for i in range(k)]), "v")
        flow = near.groupBy(F.col("u").alias("node")).agg(*[F.sum(F.col("w") * F.col(f"p{i}")).alias(f"_s{i}") for i in range(k)])
        st2 = st.join(flow, "node", "left").withColumns({f"a{i}": F.col("deg") * F.col(f"p{i}") - F.coalesce(f"_s{i}", F.lit(0.0)) for i in range(k)})
        st2 = keep(st2.drop(*[f"_s{i}" for i in range(k)]))
        curve = sums(st2, "p", "a")
        alpha = [float(a / c) if c > 0 else 0.0 for a, c in zip(rr, curve)]
        moved = st2.withColumns({
            **{f"x{i}": F.col(f"x{i}") + alpha[i] * F.col(f"p{i}") for i in range(k)}, **{f"r{i}": F.col(f"r{i}") - alpha[i] * F.col(f"a{i}") for i in range(k)}})
        new = sums(moved, "r", "r")
        beta = [float(n / o) if o > 0 else 0.0 for n, o in zip(new, rr)]
        st = moved.withColumns({f"p{i}": F.col(f"r{i}") + beta[i] * F.col(f"p{i}") for i in range(k)}).drop(*[f"a{i}" for i in range(k)])
        rr = new
        steps += 1
        if not any(alpha):
            break
    else:
        if steps >= max_steps and np.any(rr > np.maximum(goal, 1e-24)):
            raise RuntimeError(f"seams not level after {max_steps} steps: squared residuals {rr.tolist()}")
    mean = st.agg(F.struct(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)]).alias("m")).scalar()
    out = st.withColumn("_m", mean)
    return out.select("node", *[(F.col(f"x{i}") - F.col(f"_m.m{i}")).alias(c) for i, c in enumerate(channels)]), steps
