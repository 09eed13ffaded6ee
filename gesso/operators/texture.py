"""Views, data costs, labels and seams of textured meshes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, StructField, StructType

from gesso.functions import geometry as g
from gesso.operators import grid as gr
from gesso.operators.mesh import corner, face_edges, raster_tiles
from gesso.operators.raycast import blocked
from gesso.operators.scans import attach, global_rank
from gesso.session import cut, forget, keep, lookup, spread


def visible_faces(faces: DataFrame, views: DataFrame, max_angle: float = 75.0) -> DataFrame:
    """Faces seen by each view, after culling: mesh_id, f, view, angle.

    ``faces``: mesh_id, f, x1..z3. ``views``: mesh_id, view, ex, ey, ez, rot
    (9-array, world to camera, z forwards), tx, ty (half width and height of
    the field as tangents). No cross join: the field of a view meets the
    height range of its mesh in a rectangle (the whole mesh if a corner ray
    misses it); rectangles and face centres meet on grid cells of the level
    that fits the rectangle. Back faces, faces behind the camera, outside the
    field or at a grazing angle are dropped.
    """
    m = g.face_center(corner(1), corner(2), corner(3))
    n = g.facet_normal(corner(1), corner(2), corner(3))
    f = faces.select("mesh_id", "f", *[c.alias(k) for k, c in zip(("mx", "my", "mz"), m)], *[c.alias(k) for k, c in zip(("nx", "ny", "nz"), n)])
    box = f.groupBy("mesh_id").agg(*[a(c).alias(f"{c}{i}") for c in ("mx", "my", "mz") for i, a in ((0, F.min), (1, F.max))])
    v = attach(views, box, ["mesh_id"])
    xs, ys, miss = [], [], F.lit(False)
    for sx in (-1, 1):
        for sy in (-1, 1):
            d = [F.col("rot")[i] * F.col("tx") * sx + F.col("rot")[3 + i] * F.col("ty") * sy + F.col("rot")[6 + i] for i in range(3)]
            for z in ("mz0", "mz1"):
                t = F.try_divide(F.col(z) - F.col("ez"), d[2])
                miss = miss | t.isNull() | (t < 0)
                xs.append(F.col("ex") + t * d[0])
                ys.append(F.col("ey") + t * d[1])
    v = v.withColumns({"_x0": F.least(*xs), "_x1": F.greatest(*xs), "_y0": F.least(*ys), "_y1": F.greatest(*ys), "_miss": miss})
    side = {"x0": F.greatest(F.col("_x0"), F.col("mx0")), "x1": F.least(F.col("_x1"), F.col("mx1")), "y0": F.greatest(F.col("_y0"), F.col("my0")), "y1": F.least(F.col("_y1"), F.col("my1"))}
    v = v.withColumns({f"_{k}": F.when(F.col("_miss"), F.col(f"m{k}")).otherwise(c) for k, c in side.items()}).where("_x0 <= _x1 AND _y0 <= _y1")
    v = v.withColumn("_lv", F.ceil(F.log2(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-6)))).cast("int"))
    v = cut(v)
    levels = sorted(r[0] for r in v.select("_lv").distinct().collect())  # exponents of doubles: some two thousand at most
    if not levels:
        levels = [0]
    size = F.pow(F.lit(2.0), F.col("_lv"))
    v = v.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_x0") / size), F.floor(F.col("_x1") / size))))
    v = v.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_y0") / size), F.floor(F.col("_y1") / size))))
    v = v.select("mesh_id", "view", "_lv", "_cx", "_cy", "ex", "ey", "ez", "rot", "tx", "ty")
    keyed = f.withColumn("_lv", F.explode(F.array(*[F.lit(x) for x in levels])))
    keyed = keyed.withColumns({"_cx": F.floor(F.col("mx") / size), "_cy": F.floor(F.col("my") / size)})
    pair = keyed.join(lookup(v), ["mesh_id", "_lv", "_cx", "_cy"])
    return view_cull(pair, max_angle).select("mesh_id", "f", "view", "angle")


def view_cull(pairs: DataFrame, max_angle: float = 75.0) -> DataFrame:
    """Keep face-view pairs that face the camera, lie in front of it, inside
    its field and within ``max_angle`` degrees; adds ``angle``."""
    ray = g.sub((F.col("mx"), F.col("my"), F.col("mz")), (F.col("ex"), F.col("ey"), F.col("ez")))
    rows = pairs.withColumns({f"_r{i}": c for i, c in enumerate(ray)})
    r = tuple(F.col(f"_r{i}") for i in range(3))
    cam = [F.col("rot")[3 * k] * r[0] + F.col("rot")[3 * k + 1] * r[1] + F.col("rot")[3 * k + 2] * r[2] for k in range(3)]
    facing = -g.dot((F.col("nx"), F.col("ny"), F.col("nz")), r) / g.norm(r)
    rows = rows.withColumns({"_cosine": facing, "_px": cam[0], "_py": cam[1], "_pz": cam[2]})
    ok = (F.col("_cosine") > 0) & (F.col("_pz") > 0) & (F.abs("_px") <= F.col("tx") * F.col("_pz")) & (F.abs("_py") <= F.col("ty") * F.col("_pz"))
    rows = rows.where(ok).withColumn("angle", F.degrees(F.acos(F.least(F.col("_cosine"), F.lit(1.0)))))
    return rows.where(F.col("angle") <= max_angle).drop("_r0", "_r1", "_r2", "_cosine", "_px", "_py", "_pz")


def occluded(pairs: DataFrame, faces: DataFrame, views: DataFrame) -> DataFrame:
    """Face-view pairs where a ray from a corner to the camera hits another face."""
    eyes = lookup(views.select("mesh_id", "view", "ex", "ey", "ez"))
    corners = [f"{a}{i}" for i in (1, 2, 3) for a in "xyz"]
    sights = pairs.select("mesh_id", "f", "view").join(faces.select("mesh_id", "f", *corners), ["mesh_id", "f"])
    return blocked(sights.join(eyes, ["mesh_id", "view"]), faces)


def unoccluded(pairs: DataFrame, faces: DataFrame, views: DataFrame) -> DataFrame:
    pairs = keep(pairs, "pairs")  # used twice
    return pairs.join(occluded(pairs, faces, views), ["mesh_id", "f", "view"], "left_anti")


def face_quality(triangles: DataFrame, pixels: DataFrame, norm: str = "sum", step: int = 64) -> DataFrame:
    """Quality and mean colour of each face in each view.

    ``triangles``: view, f, ax..cy; ``pixels``: view, y, x, grad, c0, c1, c2.
    ``sum`` adds gradient magnitudes over covered pixels, ``area`` is mean
    gradient times area. Faces of half a pixel or less score 0. The pixels of a
    tile travel as one list, and only the tiles that faces meet; the covered
    pixels of a face are summed where they are unfolded and not shuffled.
    """
    area = F.abs(g.triangle_area2(*[F.col(c) for c in _SIDES])) / 2
    t = triangles.withColumn("area", area)
    place = ["view", "_ty", "_tx"]
    tiles = raster_tiles(t.where("area > 0.5").select("view", "f", "area", *_SIDES), ["view", "f"], step)
    tiles = tiles.withColumns({"_ty": F.floor(F.col("_y0") / step), "_tx": F.floor(F.col("_x0") / step)})
    px = pixels.withColumns({"_ty": F.floor(F.col("y") / step), "_tx": F.floor(F.col("x") / step)})
    px = px.join(tiles.select(*place).distinct(), place, "left_semi")
    lists = px.groupBy(*place).agg(F.collect_list(F.struct("y", "x", "grad", "c0", "c1", "c2")).alias("_px"))
    rows = tiles.join(lookup(lists), place).select("view", "f", "area", *_SIDES, "_x0", "_x1", "_y0", "_y1", F.inline("_px"))
    rows = rows.where(F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1")))
    w = g.barycentric(F.col("x"), F.col("y"), *[F.col(c) for c in _SIDES])
    rows = rows.withColumns({"_wa": w[0], "_wb": w[1]})
    hit = rows.where(g.inside((F.col("_wa"), F.col("_wb"), 1 - F.col("_wa") - F.col("_wb"))))
    total = F.sum("grad") if norm == "sum" else F.avg("grad") * F.first("area")
    q = hit.groupBy("view", "f").agg(total.alias("quality"), *[F.avg(c).alias(c) for c in ("c0", "c1", "c2")], F.count(F.lit(1)).alias("samples"))
    return t.select("view", "f", "area").join(q, ["view", "f"], "left").select(
        "view", "f", "area", F.coalesce("quality", F.lit(0.0)).alias("quality"), "c0", "c1", "c2", F.coalesce("samples", F.lit(0)).alias("samples")
    )


def drop_zero_quality(df: DataFrame) -> DataFrame:
    return df.where("quality <> 0")


def quality_percentile(df: DataFrame, p: float = 0.995, bins: int = 10000) -> DataFrame:
    """Upper bound of the histogram bin that passes the percentile (one row).

    Values are counted into equal bins of [0, max]; the running count is over
    at most ``bins`` rows.
    """
    top = df.agg(F.max("quality")).scalar()
    rows = df.select(F.col("quality"), top.alias("_max"))
    at = F.floor(F.greatest(F.lit(0.0), F.least(F.col("_max"), F.col("quality"))) / F.col("_max") * (bins - 1))
    counts = rows.groupBy(F.when(F.col("_max") > 0, at).otherwise(0).alias("_b"), "_max").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_max").orderBy("_b")
    counts = counts.withColumns({"_cum": F.sum("_n").over(w), "_all": F.sum("_n").over(Window.partitionBy("_max"))})
    return counts.where(F.col("_cum") > p * F.col("_all")).agg((F.min("_b") / (bins - 1) * F.first("_max")).alias("percentile"))


def data_cost(df: DataFrame, percentile: DataFrame) -> DataFrame:
    """cost = 1 - min(1, quality / percentile)."""
    rows = attach(df, percentile, [])
    return rows.withColumn("cost", 1 - F.least(F.lit(1.0), F.coalesce(F.try_divide("quality", "percentile"), F.lit(1.0)))).drop("percentile")


def cheapest_view(costs: DataFrame) -> DataFrame:
    return costs.groupBy("face").agg(F.min(F.struct("cost", "view")).alias("m")).select("face", "m.view", "m.cost")


def unseen_faces(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_if(F.col("label") == 0).alias("unseen"), F.count(F.lit(1)).alias("faces"))


def color_outliers(
    df: DataFrame, keys: Sequence[str] = ("face",), mode: str = "damp", threshold: float = 6e-3, rounds: int = 10, minimal_covariance: float = 5e-4, minimal_inliers: int = 4
) -> DataFrame:
    """Lower the quality of views whose mean colour disagrees on a face.

    Rounds of mean and covariance over the inlier views of each face, a
    Gaussian weight deciding the next inliers. Faces whose covariance becomes
    small keep only their inliers; faces with too few inliers or a singular
    covariance stay as they are. After the last round ``damp`` multiplies
    quality by a wide Gaussian (inverse covariance x 0.2) and ``clamp`` sets it
    to 0 below ``threshold``. Every round is one aggregate, so a face may have
    any number of views. Views are shuffled by face once and cached in that
    order; a round writes a row a face: its state, and mean and covariance of
    the last round it was open in, from which a view's weight follows.
    """
    keys = list(keys)
    names = ("c0", "c1", "c2")
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    held = [*[f"_m{i}" for i in range(3)], *[f"_v{i}{j}" for i, j in pairs]]
    v = lambda i, j: F.col(f"_v{min(i, j)}{max(i, j)}")
    m3 = tuple(tuple(v(i, j) for j in range(3)) for i in range(3))
    # faces in tasks by the same shuffle, so that rounds join and sum without moving views
    views = spread(df, *keys).sortWithinPartitions(*keys).persist()
    try:
        faces = None
        for _ in range(rounds):
            used = views if faces is None else _weighed(views, faces.where("_st = 'open'"), keys, names, "inner").where(F.exp(-0.5 * F.col("_q2")) >= threshold)
            stats = used.groupBy(*keys).agg(
                F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)],
                *[F.covar_samp(names[i], names[j]).alias(f"_v{i}{j}") for i, j in pairs],
            )
            biggest = F.greatest(*[F.abs(F.col(f"_v{i}{j}")) for i, j in pairs])
            rows = stats.withColumns({"_big": biggest, "_det": g.det3(*m3)})
            few = F.col("_n") < minimal_inliers
            singular = F.abs(F.col("_det")) <= 1e-12 * F.pow(F.col("_big"), 3)
            verdict = F.when(few, "fail").when(F.col("_big") < minimal_covariance, "tight").when(F.coalesce(singular, F.lit(True)), "fail").otherwise("open")
            fresh = rows.select(*keys, verdict.alias("_st"), *held, "_det")
            if faces is None:
                here = F.col("_st") == "open"
                faces = keep(fresh.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys, "_st", *[F.when(here, F.col(c)).alias(c) for c in (*held, "_det")]), "faces")
            else:
                # a face without inliers has no sums: it fails, with what it held
                new = fresh.select(*keys, F.col("_st").alias("_new"), F.struct(*held, "_det").alias("_now"))
                after = F.when(F.col("_st") == "open", F.coalesce("_new", F.lit("fail"))).otherwise(F.col("_st"))
                moved = [F.when(F.col("_new") == "open", F.col(f"_now.{c}")).otherwise(F.col(c)).alias(c) for c in (*held, "_det")]
                before, faces = faces, keep(faces.join(new, keys, "left").select(*keys, after.alias("_st"), *moved), "faces")
                forget(before)
            if faces.where("_st = 'open'").limit(1).count() == 0:
                break
        q = F.col("quality")
        if faces is None:
            return df
        rows = _weighed(views, faces, keys, names, "left")
        weight, wide = F.exp(-0.5 * F.col("_q2")), F.exp(-0.1 * F.col("_q2"))
        ended = q * wide if mode == "damp" else F.when(weight < threshold, 0.0).otherwise(q)
        inner = F.col("_det").isNull() | (weight >= threshold)
        out = F.when(F.col("_st") == "tight", F.when(inner, q).otherwise(0.0)).when(F.col("_st") == "open", ended).otherwise(q)
        done = keep(rows.withColumn("quality", out).select(*df.columns), "qualities")
        forget(faces)
        return done
    finally:
        views.unpersist()


def _weighed(views: DataFrame, faces: DataFrame, keys: Sequence[str], names: Sequence[str], how: str) -> DataFrame:
    """Views with ``_q2``, the square of their distance from their face's mean by its covariance; null where there is none."""
    rows = views.join(faces.hint("merge"), list(keys), how)
    v = lambda i, j: F.col(f"_v{min(i, j)}{max(i, j)}")
    rows = rows.withColumns({f"_d{i}": F.col(c) - F.col(f"_m{i}") for i, c in enumerate(names)})
    _, nums = g.solve3(tuple(tuple(v(i, j) for j in range(3)) for i in range(3)), tuple(F.col(f"_d{i}") for i in range(3)))
    quad = F.try_divide(sum((F.col(f"_d{i}") * nums[i] for i in range(3)), F.lit(0.0)), F.col("_det"))
    return rows.withColumn("_q2", quad)


# -- seams -----------------------------------------------------------------------


def vertex_labels(faces: DataFrame, labels: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Distinct labels (0 left out) around each vertex with dense row numbers."""
    f = faces.join(labels.where("label <> 0").select(mesh, "f", "label"), [mesh, "f"])
    pairs = f.select(mesh, F.explode(F.array("v1", "v2", "v3")).alias("v"), "label").distinct()
    ranked = global_rank(pairs, [mesh, "v", "label"], "row_no")
    return ranked.withColumn("row_no", F.col("row_no") - 1)


def edge_color_difference(edges: DataFrame, pixels: DataFrame, columns: Sequence[str], tile: int = gr.TILE) -> DataFrame:
    """Weighted mean colour along each projected edge and label, and their
    difference (second label minus first).

    ``edges``: edge, side (1 or 2), image_id, px1, py1, px2, py2. Samples lie
    half a pixel apart; the weight falls from 1 at the first vertex to 0.
    The samples of an edge in one tile travel as one row and meet the tile's
    blocks as one map; they are unfolded where they are summed.
    """
    length = F.greatest(F.sqrt(F.pow(F.col("px2") - F.col("px1"), 2) + F.pow(F.col("py2") - F.col("py1"), 2)), F.lit(1.0))
    ends = ["px1", "py1", "px2", "py2"]
    e = spread(edges.select("edge", "side", "image_id", *ends), "edge").withColumn("_n", F.floor(length * 2).cast("int"))

    def place(i: Column) -> tuple[Column, Column, Column]:
        share = i / (F.col("_n") - 1)
        return share, F.col("py1") + share * (F.col("py2") - F.col("py1")), F.col("px1") + share * (F.col("px2") - F.col("px1"))

    tile_of = lambda v: F.floor(F.floor(v).cast("int") / tile)
    e = e.withColumn("_tiles", F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.struct(tile_of(place(i)[1]).alias("_ty"), tile_of(place(i)[2]).alias("_tx"))))
    new = lambda i: (i == 0) | (F.get("_tiles", i) != F.get("_tiles", i - 1))
    e = e.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.col("_n") - 1), new))
    runs = F.transform("_starts", lambda s, i: F.struct(F.get("_tiles", s).alias("_t"), s.alias("_s0"), (F.coalesce(F.get("_starts", i + 1), F.col("_n")) - 1).alias("_s1")))
    runs = e.withColumn("_r", F.explode(runs)).select("edge", "side", "image_id", *ends, "_n", "_r._t._ty", "_r._t._tx", "_r._s0", "_r._s1")
    on = ["image_id", "_ty", "_tx"]
    b = gr.blocks(pixels.join(edges.select("image_id").distinct(), "image_id", "left_semi"), columns, tile)
    b = b.withColumns({"_ty": F.floor(F.col("y") / tile), "_tx": F.floor(F.col("x") / tile)})
    block = F.struct("_h", "_w", *[f"{c}_{k}" for c in columns for k in ("00", "01", "10", "11")])
    held = b.groupBy(*on, "y", "x").agg(F.collect_list(block).alias("_b"))
    held = held.groupBy(*on, "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "_b"))).alias("_b"))
    maps = held.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("y", "_b"))).alias("_px"))

    rows = runs.join(lookup(maps), on).withColumn("_i", F.explode(F.sequence("_s0", "_s1")))
    share, sy, sx = place(F.col("_i"))
    rows = rows.withColumns({"_wt": 1 - share, "_sy": sy, "_sx": sx})
    rows = rows.withColumns({"_by": F.floor("_sy").cast("int"), "_bx": F.floor("_sx").cast("int")})
    rows = rows.select("edge", "side", "_wt", "_sy", "_sx", "_by", "_bx", F.inline(F.try_element_at(F.try_element_at("_px", F.col("_by")), F.col("_bx"))))
    rows = rows.where((F.col("_sy") <= F.col("_h") - 1) & (F.col("_sx") <= F.col("_w") - 1))
    fy, fx = F.col("_sy") - F.col("_by"), F.col("_sx") - F.col("_bx")
    got = rows.select("edge", "side", "_wt", *[gr.bilinear(c, fy, fx).alias(c) for c in columns])
    mean = got.groupBy("edge", "side").agg(*[F.try_divide(F.sum(F.col("_wt") * F.col(c)), F.sum("_wt")).alias(c) for c in columns])
    at = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    return mean.groupBy("edge").agg(*[(at(2, c) - at(1, c)).alias(f"d_{c}") for c in columns])


def corner_adjustments(faces: DataFrame, labels: DataFrame, solved: DataFrame, columns: Sequence[str], mesh: str = "mesh_id") -> DataFrame:
    """Solved vertex-label values at the corners of each face: arrays of 3."""
    f = faces.join(labels.select(mesh, "f", "label"), [mesh, "f"])
    c = f.select(mesh, "f", "label", F.posexplode(F.array("v1", "v2", "v3")).alias("_k", "v")).join(solved, [mesh, "v", "label"], "left")
    pick = lambda k, x: F.coalesce(F.max(F.when(F.col("_k") == k, F.col(x))), F.lit(0.0))
    return c.groupBy(mesh, "f").agg(*[F.array(*[pick(k, x) for k in range(3)]).alias(x) for x in columns])


def apply_adjustment(triangles: DataFrame, pixels: DataFrame, columns: Sequence[str], rim: float = 1.41, step: int = 64) -> DataFrame:
    """Add interpolated corner adjustments to patch pixels.

    ``triangles``: patch, f, ax..cy and per column an array of 3 corner
    values; ``pixels``: patch, y, x, columns. Pixels inside a face
    interpolate; those within ``rim`` of a face extrapolate from the nearest
    one; others keep their colour.
    """
    adj = triangles.where("patch IS NOT NULL").select("patch", "f", *[F.col(c).cast("double") for c in _SIDES], *[F.col(c).cast("array<double>").alias(f"adj_{c}") for c in columns])
    best = _nearest_faces(raster_tiles(adj, ["patch", "f"], step, rim), pixels.schema["patch"].dataType, columns, rim, step)
    key = F.struct("inner", "depth", (-F.col("f")).alias("f"))
    best = best.groupBy("patch", "y", "x").agg(F.max_by(F.struct(*[f"v_{c}" for c in columns]), key).alias("v"))
    rows = pixels.join(best, ["patch", "y", "x"], "left")
    return rows.withColumns({c: F.col(c) + F.coalesce(F.col(f"v.v_{c}"), F.lit(0.0)) for c in columns}).drop("v")


_SIDES = ("ax", "ay", "bx", "by", "cx", "cy")
#: pixels a task unfolds at once, and rows of best faces it holds before it hands them on
_AT_ONCE = 1 << 19


def _nearest_faces(tiles: DataFrame, patch: DataType, columns: Sequence[str], rim: float, step: int) -> DataFrame:
    """The face that decides each pixel, of those that a task has seen: patch, y, x, inner, depth, f, v_<column>.

    ``tiles`` as by ``raster_tiles``. A task unfolds some triangles at a time
    and keeps one row a pixel, so what is shuffled doesn't grow with the number
    of faces that cover a pixel. Weights and distances are those of ``rasterise``.
    """
    names = [f"v_{c}" for c in columns]
    schema = StructType([
        StructField("patch", patch), StructField("y", IntegerType()), StructField("x", IntegerType()), StructField("inner", BooleanType()),
        StructField("depth", DoubleType()), StructField("f", tiles.schema["f"].dataType), *[StructField(n, DoubleType()) for n in names],
    ])

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        """One row a pixel: inner faces first, then the largest depth (none is least), then the smallest number."""
        ordered = rows.sort_values(["inner", "depth", "f"], ascending=[False, False, True], na_position="last", kind="stable")
        return ordered.drop_duplicates(["patch", "y", "x"])

    def covered(part: pd.DataFrame) -> pd.DataFrame:
        x0, x1, y0, y1 = (part[c].to_numpy(np.int64) for c in ("_x0", "_x1", "_y0", "_y1"))
        wide = x1 - x0 + 1
        each = wide * (y1 - y0 + 1)
        row = np.repeat(np.arange(len(part)), each)
        place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        iy, ix = y0[row] + place // wide[row], x0[row] + place % wide[row]
        y, x = iy.astype(float), ix.astype(float)
        ax, ay, bx, by, cx, cy = (part[c].to_numpy(float)[row] for c in _SIDES)
        twice = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (rx - px) * (qy - py)
        whole = twice(ax, ay, bx, by, cx, cy)
        whole = np.where(whole == 0, np.nan, whole)
        wa, wb = twice(x, y, bx, by, cx, cy) / whole, twice(ax, ay, x, y, cx, cy) / whole
        wc = 1 - wa - wb

        def near(px, py, qx, qy):
            d2 = (qx - px) ** 2 + (qy - py) ** 2
            s = np.where(d2 == 0, 0.0, ((x - px) * (qx - px) + (y - py) * (qy - py)) / np.where(d2 == 0, 1.0, d2))
            s = np.clip(s, 0.0, 1.0)
            return (x - px - s * (qx - px)) ** 2 + (y - py - s * (qy - py)) ** 2 <= rim * rim

        inner = (wa >= 0) & (wb >= 0) & (wc >= 0)
        (hit,) = np.nonzero(inner | near(ax, ay, bx, by) | near(bx, by, cx, cy) | near(ax, ay, cx, cy))
        out = {"patch": part["patch"].to_numpy()[row[hit]], "y": iy[hit].astype("int32"), "x": ix[hit].astype("int32"), "inner": inner[hit]}
        out |= {"depth": np.fmin(np.fmin(wa, wb), wc)[hit], "f": part["f"].to_numpy()[row[hit]]}
        for c, n in zip(columns, names):
            corners = np.array([[np.nan] * 3 if v is None else [v[k] if k < len(v) and v[k] is not None else np.nan for k in range(3)] for v in part[f"adj_{c}"]])
            at = corners[row[hit]]
            out[n] = 0.0 + at[:, 0] * wa[hit] + at[:, 1] * wb[hit] + at[:, 2] * wc[hit]
        return best(pd.DataFrame(out))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            share = max(1, _AT_ONCE // (step * step))
            for i in range(0, len(batch), share):
                held.append(covered(batch.iloc[i : i + share]))
                rows += len(held[-1])
                if rows > _AT_ONCE:
                    held = [best(pd.concat(held))]
                    rows = len(held[0])
                    if rows > _AT_ONCE // 2:
                        yield held.pop()
                        rows = 0
        if held:
            yield best(pd.concat(held))

    found = tiles.select("patch", "f", *_SIDES, *[f"adj_{c}" for c in columns], "_x0", "_x1", "_y0", "_y1").mapInPandas(work, schema)
    return found.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in ("depth", *names)})
