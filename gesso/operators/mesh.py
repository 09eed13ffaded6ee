"""Meshes as vertex and face tables, and neighbour searches in space."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gesso.functions import geometry as g
from gesso.operators import boxtree as bt
from gesso.operators import grid as gr
from gesso.operators import triangles as tr
from gesso.operators.scans import attach, exact_quantiles
from gesso.session import cut, keep, lookup, spread, tasks_for

CORNERS = ("v1", "v2", "v3")


def vertex_grid(depth: DataFrame, z: str = "z", step: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of depth images; heights scaled so p99 becomes 10.

    Vertex and face numbers follow from the pixel position, so nothing is
    counted or sorted. Images must be complete.
    """
    lows = depth.groupBy("image_id").agg(F.min(z).alias("_lo"))
    q = exact_quantiles(depth, ["image_id"], z, [0.99]).withColumnRenamed("q0", "_p99")
    rows = gr.with_dims(depth.select(*gr.KEY, F.col(z).alias("_z")))
    rows = attach(attach(rows, lows, ["image_id"]), q, ["image_id"])
    height = (F.col("_z") - F.col("_lo")) / (F.col("_p99") - F.col("_lo") + 1e-8) * 10
    v = F.col("y").cast("bigint") * F.col("_w") + F.col("x")
    vertices = rows.select(
        F.col("image_id").alias("mesh_id"), v.alias("v"), (F.col("x") * step).alias("x"), (F.col("y") * step).alias("y"), (height * step).alias("z")
    )
    return vertices, grid_faces(depth)


def grid_faces(depth: DataFrame) -> DataFrame:
    """Two triangles per cell of complete images: mesh_id, f, v1, v2, v3."""
    rows = gr.with_dims(depth.select(*gr.KEY))
    v = F.col("y").cast("bigint") * F.col("_w") + F.col("x")
    inner = rows.where((F.col("y") < F.col("_h") - 1) & (F.col("x") < F.col("_w") - 1))
    f = 2 * (F.col("y").cast("bigint") * (F.col("_w") - 1) + F.col("x"))
    w = F.col("_w")
    tri = lambda n, a, b, c: F.struct((f + n).alias("f"), a.alias("v1"), b.alias("v2"), c.alias("v3"))
    two = F.array(tri(0, v, v + 1, v + w), tri(1, v + 1, v + w + 1, v + w))
    return inner.select(F.col("image_id").alias("mesh_id"), F.explode(two).alias("t")).select("mesh_id", "t.*")


def faces_with_vertices(faces: DataFrame, vertices: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Faces with corner coordinates x1..z3: corners are unpivoted, joined
    once and folded back. Tasks grow in number with the faces, not in size."""
    corners = faces.select(mesh, "f", F.posexplode(F.array(*CORNERS)).alias("_k", "v"))
    tasks = tasks_for(3 * faces.count(), faces.sparkSession)
    at = corners.repartition(tasks, mesh, "v").join(vertices.repartition(tasks, mesh, "v"), [mesh, "v"]).repartition(tasks, mesh, "f")
    pick = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    return at.groupBy(mesh, "f").agg(
        *[pick(k, "v").alias(f"v{k + 1}") for k in range(3)], *[pick(k, c).alias(f"{c}{k + 1}") for k in range(3) for c in ("x", "y", "z")]
    )


def corner(i: int) -> tuple[Column, Column, Column]:
    return F.col(f"x{i}"), F.col(f"y{i}"), F.col(f"z{i}")


def canonical_edge(a: Column, b: Column) -> Column:
    """Smaller vertex first; null for a self loop."""
    return F.when(a != b, F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))


def face_edges(faces: DataFrame, mesh: str = "mesh_id", *extra: str) -> DataFrame:
    e = F.array(*[canonical_edge(F.col(a), F.col(b)) for a, b in (("v1", "v2"), ("v2", "v3"), ("v1", "v3"))])
    out = faces.select(mesh, "f", *extra, F.explode(e).alias("e")).where("e IS NOT NULL")
    return out.select(mesh, "f", *extra, F.col("e.a").alias("a"), F.col("e.b").alias("b"))


def face_adjacency(faces: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Pairs f1 < f2 of faces that share an edge.

    Nearly every edge has at most two faces, and their smallest and largest
    number is the pair: one aggregate, no self-join. Only edges with more
    faces (a broken mesh) are joined with themselves.
    """
    edges = face_edges(faces, mesh)
    g_ = cut(edges.groupBy(mesh, "a", "b").agg(F.min("f").alias("f1"), F.max("f").alias("f2"), F.count(F.lit(1)).alias("n")))
    plain = g_.where("n = 2 AND f1 < f2").select(mesh, "f1", "f2")
    many = g_.where("n > 2").select(mesh, "a", "b")
    if many.limit(1).count() == 0:
        return plain.distinct()
    crowded = edges.join(lookup(many), [mesh, "a", "b"])
    left = crowded.select(mesh, "a", "b", F.col("f").alias("f1"))
    right = crowded.select(mesh, "a", "b", F.col("f").alias("f2"))
    more = left.join(right, [mesh, "a", "b"]).where("f1 < f2").select(mesh, "f1", "f2")
    return plain.unionByName(more).distinct()


def seam_edges(faces: DataFrame, labels: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Edges between faces of different labels: a, b, l1 < l2."""
    labelled = faces.join(labels.select(mesh, "f", "label"), [mesh, "f"])
    edges = face_edges(labelled, mesh, "label")
    per = cut(edges.groupBy(mesh, "a", "b").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count(F.lit(1)).alias("n")))
    plain = per.where("n = 2 AND l1 < l2").select(mesh, "a", "b", "l1", "l2")
    many = per.where("n > 2 AND l1 < l2").select(mesh, "a", "b")
    if many.limit(1).count() == 0:
        return plain
    crowded = edges.join(lookup(many), [mesh, "a", "b"]).select(mesh, "a", "b", "label").distinct()
    left = crowded.withColumnRenamed("label", "l1")
    right = crowded.select(mesh, "a", "b", F.col("label").alias("l2"))
    more = left.join(right, [mesh, "a", "b"]).where("l1 < l2").select(mesh, "a", "b", "l1", "l2")
    return plain.unionByName(more)


def edge_projections(edges: DataFrame, projections: DataFrame) -> DataFrame:
    """Seam edges whose two vertices were projected into the same patch
    through a common face.

    ``projections``: vertex, patch, px, py, faces (array).
    """
    flat = projections.select("vertex", "patch", "px", "py", F.explode("faces").alias("face"))
    end = lambda v, s: flat.select(F.col("vertex").alias(v), "patch", "face", F.col("px").alias(f"px{s}"), F.col("py").alias(f"py{s}"))
    out = edges.join(end("a", 1), "a").join(end("b", 2), ["b", "patch", "face"])
    return out.select("a", "b", "patch", "px1", "py1", "px2", "py2").distinct()


def merge_projections(rows: DataFrame) -> DataFrame:
    """One record per vertex and patch; a vertex touches few faces."""
    return rows.groupBy("vertex", "patch").agg(
        F.avg("px").alias("px"), F.avg("py").alias("py"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("faces")))).alias("faces")
    )


def redundant_faces(faces: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Faces dropped because another face has the same vertices; the larger
    number stays."""
    key = F.sort_array(F.array(*CORNERS))
    keep = faces.groupBy(mesh, key.alias("_k")).agg(F.max("f").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return faces.withColumn("_k", key).join(keep, [mesh, "_k"]).where("f < _keep").select(mesh, "f", F.col("_keep").alias("kept"))


#: boxes a task looks through, and the largest of them by which it leaves out others
_BOXES, _LARGEST = 50_000, 2048


def _outer_boxes(boxes: DataFrame) -> DataFrame:
    """``boxes`` without rows that are nobody's best container, since they lie in a better one.

    What contains a container contains what is in it, so only boxes that lie in
    no better one are needed. Tasks compare boxes that are near each other,
    largest first, with the ``_LARGEST`` of them; rows left over cost time, not
    right results. This is repeated while it halves the rows. A patch with two
    boxes in a view can't be its own container, so it doesn't push out others.
    """
    sides = ["x0", "y0", "x1", "y1"]
    rows = boxes.select("view", "patch", *sides).dropna().distinct()
    box = F.struct(*sides)
    alone = rows.groupBy("view", "patch").agg((F.min(box) == F.max(box)).alias("_alone"))
    wide, high = (F.col(b).cast("long") - F.col(a) for a, b in (("x0", "x1"), ("y0", "y1")))
    fair = (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))
    rows = rows.join(alone, ["view", "patch"]).withColumns({"_area": wide * high, "_fair": fair})
    rows = keep(rows, "boxes")
    n = rows.count()
    cell = rows.agg(F.max(F.greatest(wide, high, F.lit(1)))).scalar()
    schema = rows.schema

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        view, known = None, None
        for batch in batches:
            for at, part in batch.groupby("view", sort=False):
                if view is None or at != view:
                    view, known = at, part.iloc[:0]
                able = part[part["_alone"] & part["_fair"]]
                pool = pd.concat([known, able.drop_duplicates(sides).iloc[: max(0, _LARGEST - len(known))]])
                by = {c: pool[c].to_numpy()[None] for c in [*sides, "_area", "patch"]}
                stay = np.ones(len(part), bool)
                for i in range(0, len(part), 512):
                    own = {c: part[c].to_numpy()[i : i + 512, None] for c in by}
                    within = (by["x0"] <= own["x0"]) & (by["y0"] <= own["y0"]) & (by["x1"] >= own["x1"]) & (by["y1"] >= own["y1"])
                    better = (by["_area"] > own["_area"]) | ((by["_area"] == own["_area"]) & (by["patch"] < own["patch"]))
                    stay[i : i + 512] = ~(within & better).any(axis=1)
                left = part[stay | ~part["_fair"].to_numpy()]
                known = pd.concat([known, left[left["_alone"] & left["_fair"]]]).iloc[:_LARGEST]
                yield left

    while True:
        tasks = -(-n // _BOXES) or 1
        near = rows.withColumns({"_cx": F.floor(F.col("x0") / cell), "_cy": F.floor(F.col("y0") / cell)})
        near = near.repartitionByRange(tasks, "view", "_cx", "_cy", "x0", "y0", "patch").sortWithinPartitions("view", F.desc("_area"), "patch")
        rows, before = keep(near.drop("_cx", "_cy").mapInPandas(outer, schema), "boxes"), n
        n = rows.count()
        if tasks == 1 or 2 * n > before:
            return rows.select("view", "patch", *sides)


def contained_patches(boxes: DataFrame) -> DataFrame:
    """Representative of each patch box lying wholly in another of its view.

    ``boxes``: view, patch, x0, y0, x1, y1 (integers). A box contains another
    if it is larger, or equal with a smaller number; the largest container
    wins, ties by number. A box is entered under the few cells of the grid
    level that fits its size, so that big boxes cost no more than small ones;
    the candidate looks up its corner once per level in use. Boxes that lie in
    a better container are no candidates (see ``_outer_boxes``). Output: view,
    patch, into, dx, dy.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1))
    big = _outer_boxes(boxes).withColumn("_lv", F.ceil(F.log2(side)).cast("int"))
    levels = sorted(r[0] for r in big.select("_lv").distinct().collect())  # exponents of integers: 64 at most
    size = F.pow(F.lit(2.0), F.col("_lv"))
    reach = lambda a, b: F.sequence(F.floor(F.col(a) / size).cast("int"), F.floor(F.col(b) / size).cast("int"))
    big = big.withColumn("_cx", F.explode(reach("x0", "x1"))).withColumn("_cy", F.explode(reach("y0", "y1")))
    big = big.select("view", "_lv", "_cx", "_cy", F.struct("x0", "y0", "x1", "y1", "patch").alias("_o"))
    small = boxes.withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in levels])))
    small = small.withColumns({"_cx": F.floor(F.col("x0") / size).cast("int"), "_cy": F.floor(F.col("y0") / size).cast("int")})
    pair = small.join(big, ["view", "_lv", "_cx", "_cy"])
    side_of = lambda p, a: (F.col(f"{p}{a}1") - F.col(f"{p}{a}0")).cast("long")
    area = lambda p: side_of(p, "x") * side_of(p, "y")
    within = (F.col("_o.x0") <= F.col("x0")) & (F.col("_o.y0") <= F.col("y0")) & (F.col("_o.x1") >= F.col("x1")) & (F.col("_o.y1") >= F.col("y1"))
    larger = (area("_o.") > area("")) | (F.col("_o.patch") < F.col("patch"))
    hit = pair.where(within & larger & (F.col("_o.patch") != F.col("patch")))
    best = hit.groupBy("view", "patch", "x0", "y0").agg(F.max(F.struct(area("_o.").alias("s"), (-F.col("_o.patch")).alias("n"), F.col("_o").alias("o"))).alias("m"))
    return best.select("view", "patch", F.col("m.o.patch").alias("into"), (F.col("x0") - F.col("m.o.x0")).alias("dx"), (F.col("y0") - F.col("m.o.y0")).alias("dy"))


def raster_tiles(triangles: DataFrame, keys: Sequence[str], step: int, slack: float = 0.0) -> DataFrame:
    """A row per triangle and tile of ``step`` pixels that its box meets, spread over the tasks: the part of the box in
    the tile is ``_x0.._x1``, ``_y0.._y1``."""
    t = triangles.withColumns({
        "_x0": F.ceil(F.least("ax", "bx", "cx") - slack), "_x1": F.floor(F.greatest("ax", "bx", "cx") + slack),
        "_y0": F.ceil(F.least("ay", "by", "cy") - slack), "_y1": F.floor(F.greatest("ay", "by", "cy") + slack),
    }).where("_x0 <= _x1 AND _y0 <= _y1")
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / step), F.floor(F.col(b) / step))
    t = t.withColumn("_ty", F.explode(cells("_y0", "_y1"))).withColumn("_tx", F.explode(cells("_x0", "_x1")))
    t = spread(t, *keys, "_ty", "_tx")
    ends = lambda a, b, k: (F.greatest(F.col(a), F.col(k) * step), F.least(F.col(b), F.col(k) * step + step - 1))
    (x0, x1), (y0, y1) = ends("_x0", "_x1", "_tx"), ends("_y0", "_y1", "_ty")
    return t.withColumns({"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1}).drop("_ty", "_tx")


def rasterise(triangles: DataFrame, keys: Sequence[str], step: int = 64, slack: float = 0.0) -> DataFrame:
    """Pixels (integer centres) covered by 2-D triangles ax..cy: keys, y, x and
    weights wa, wb, wc.

    The box of a triangle is first cut into tiles that are spread over the
    tasks and only then unfolded, so one huge triangle is many rows of work.
    """
    t = raster_tiles(triangles, keys, step, slack)
    t = t.withColumn("y", F.explode(F.sequence("_y0", "_y1"))).withColumn("x", F.explode(F.sequence("_x0", "_x1")))
    w = g.barycentric(F.col("x"), F.col("y"), *[F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy")])
    t = t.withColumns({"wa": w[0], "wb": w[1]}).withColumn("wc", 1 - F.col("wa") - F.col("wb"))
    keep = g.inside((F.col("wa"), F.col("wb"), F.col("wc")))
    extra = [c for c in triangles.columns if c not in keys and c not in ("ax", "ay", "bx", "by", "cx", "cy")]
    if slack > 0:
        # also pixels within ``slack`` of an edge
        def near(p, q):
            (px, py), (qx, qy) = p, q
            d2 = F.pow(qx - px, 2) + F.pow(qy - py, 2)
            s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((F.col("x") - px) * (qx - px) + (F.col("y") - py) * (qy - py), d2), F.lit(0.0))))
            return F.pow(F.col("x") - px - s * (qx - px), 2) + F.pow(F.col("y") - py - s * (qy - py), 2) <= slack * slack

        a, b, c = ((F.col(f"{k}x"), F.col(f"{k}y")) for k in "abc")
        t = t.withColumn("inner", F.coalesce(keep, F.lit(False)))
        keep = F.col("inner") | near(a, b) | near(b, c) | near(a, c)
        extra.append("inner")
    return t.where(keep).select(*keys, *extra, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "wa", "wb", "wc")


# -- neighbour searches ------------------------------------------------------------


def nearest_points(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = True, bucket: int = 32) -> DataFrame:
    """The k nearest ``points`` (id, x, y, z) of each query (id, x, y, z):
    id, neighbour, distance, rank; ties by the neighbour's id. Exact.

    A search in a tree of boxes (see ``boxtree``) with ``bucket`` points a
    leaf. Of points at the same place at most k + 1 can matter, so piles of
    copies are thinned before. Sets with fewer than k points give fewer rows
    (see ``padded_neighbours``). Rows without finite coordinates are nobody's
    neighbour and have none; ids are unique.
    """
    need = k + (1 if exclude_self else 0)
    pile = Window.partitionBy("x", "y", "z").orderBy("id")
    pool = points.where(bt.finite(*"xyz")).select("id", "x", "y", "z").withColumn("_n", F.row_number().over(pile)).where(F.col("_n") <= need)
    boxes = pool.select(F.col("id").alias("neighbour"), *"xyz", *[F.col(a).cast("double").alias(f"{a}{i}") for i in (0, 1) for a in "xyz"])
    found = bt.search(queries, boxes, "neighbour", list("xyz"), k, bt.to_points, need, exclude_self, bucket=bucket)
    return found.withColumnRenamed("item", "neighbour")


def padded_neighbours(found: DataFrame, k: int) -> DataFrame:
    """Repeat the last neighbour where there are fewer than k."""
    last = found.groupBy("id").agg(F.max("rank").alias("_r"), F.max_by("neighbour", "rank").alias("_n"), F.max_by("distance", "rank").alias("_d")).where(F.col("_r") < k)
    more = last.select("id", F.col("_n").alias("neighbour"), F.col("_d").alias("distance"), F.explode(F.sequence(F.col("_r") + 1, F.lit(k))).alias("rank"))
    return found.select("id", "neighbour", "distance", "rank").unionByName(more)


def nearest_triangle(queries: DataFrame, triangles: DataFrame, bucket: int = 32) -> DataFrame:
    """Nearest triangle and foot point of each query point: id, f, distance,
    foot; ties by f. ``triangles``: f, x1..z3. Exact.

    Triangles lie in pages that the points visit (see ``triangles``), ``bucket``
    in a row. Wide ones have pages of their own. Rows without finite
    coordinates take no part.
    """
    held = triangles.where(bt.finite(*tr.CORNERS)).select("f", *[F.col(c).cast("double").alias(c) for c in tr.CORNERS])
    asked = queries.where(bt.finite(*"xyz")).select("id", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    return tr.nearest(asked, held, bucket)


def tangent_cells(samples: DataFrame, k: int = 16, padding: float = 0.01, reach: float = 20.0) -> DataFrame:
    """Corner points of each sample's restricted tangent cell: id, x, y, z.

    ``samples``: id, x, y, z, nx, ny, nz. The tangent plane is intersected
    with every pair of the sample's half-space planes (box, k bisectors, two
    points off the surface); points inside all half-spaces remain, equal ones
    merge. All pairs are of the fixed plane list of one sample, not of data.
    """
    found = padded_neighbours(nearest_points(samples, samples, k), k)
    pts = samples.select(F.col("id").alias("neighbour"), "x", "y", "z")
    near = found.join(pts, "neighbour").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "x", "y", "z"))).alias("_near"))
    box = samples.agg(F.struct(*[(f(a) + s * padding).alias(f"{a}{i}") for a in "xyz" for i, f, s in ((0, F.min, -1), (1, F.max, 1))]).alias("b")).scalar()
    rows = spread(samples.join(near, "id", "left"), "id").withColumn("_b", box)
    s, n = (F.col("x"), F.col("y"), F.col("z")), (F.col("nx"), F.col("ny"), F.col("nz"))
    rows = rows.withColumn("_p", g.half_spaces(s, n, F.coalesce("_near", F.expr("array()").cast(near.schema["_near"].dataType)), F.col("_b"), reach))
    flat = F.flatten(F.transform("_p", lambda q: F.array(q.nx, q.ny, q.nz, q.d)))
    rows = rows.select("id", *[F.col(c).cast("double").alias(c) for c in ("nx", "ny", "nz")], g.dot(n, s).cast("double").alias("_d"), flat.alias("_p"))
    # a plane with an unknown number holds no point, so such a sample has no corners
    rows = rows.where(F.col("_d").isNotNull() & ~F.exists("_p", lambda v: v.isNull()))
    schema = StructType([samples.schema["id"], *[StructField(a, DoubleType()) for a in "xyz"]])

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["_p"].map(len)
            for size, some in batch.groupby(sizes):
                first, second = np.triu_indices(size // 4, 1)
                for at in range(0, len(some), SAMPLES):
                    yield _cell_corners(some.iloc[at : at + SAMPLES], first, second)

    return unique_points(rows.mapInPandas(corners, schema), ["id"])


#: samples whose planes a task intersects at once
SAMPLES = 256


def _cell_corners(part: pd.DataFrame, first: np.ndarray, second: np.ndarray) -> pd.DataFrame:
    """Points of the tangent planes on two half-space planes and inside all, of samples with equally many planes.

    NaN compares as in Spark: larger than all numbers.
    """
    planes = np.stack(part["_p"].to_list()).astype(float).reshape(len(part), -1, 4)
    normal = tuple(part[c].to_numpy(float)[:, None] for c in ("nx", "ny", "nz"))
    one, two = ([planes[:, at, i] for i in range(4)] for at in (first, second))
    with np.errstate(all="ignore"):
        det, nums = g.solve3((normal, tuple(one[:3]), tuple(two[:3])), (part["_d"].to_numpy(float)[:, None], one[3], two[3]))
        sample, pair = np.nonzero((np.abs(det) > 1e-12) | np.isnan(det))
        x, y, z = (v[sample, pair] / det[sample, pair] for v in nums)
        inside = np.ones(len(x), bool)
        for i in range(planes.shape[1]):
            nx, ny, nz, d = planes[sample, i].T
            inside &= (nx * x + ny * y + nz * z <= d + 1e-8) | np.isnan(d)
    return pd.DataFrame({"id": part["id"].to_numpy()[sample[inside]], "x": x[inside], "y": y[inside], "z": z[inside]})


def unique_points(points: DataFrame, keys: Sequence[str], digits: int = 8) -> DataFrame:
    """Merge points equal after rounding to ``digits``."""
    rounded = points.withColumns({a: F.round(a, digits) + 0.0 for a in "xyz"})
    return rounded.dropDuplicates([*keys, "x", "y", "z"])


def barycenters(cells: DataFrame) -> DataFrame:
    return cells.groupBy("id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count(F.lit(1)).alias("corners"))
