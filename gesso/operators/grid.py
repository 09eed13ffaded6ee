"""Operators over pixel tables ``image_id, y, x, value...``.

Neighbourhood operators cut images into tiles. A pixel is copied to every
tile whose margin contains it (``halo``), one shuffle brings tiles together,
and windows or kernels then work inside a tile. So neither a huge image nor a
long row ends in one task, and the shuffle grows by the margin only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gesso.operators.scans import attach

KEY = ["image_id", "y", "x"]
TILE = 512
_TILE_KEYS = ["image_id", "_ty", "_tx"]


def image_dims(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))


def with_dims(df: DataFrame) -> DataFrame:
    return attach(df, image_dims(df), ["image_id"])


def _copies(pos: Column, size: Column, before: int, after: int, border: str) -> Column:
    """Positions at which a pixel shows up, margin positions included."""
    low, high = F.lit(-before), size - 1 + after
    if border == "none":
        return F.array(pos)
    if border == "nearest":
        first = F.when(pos == 0, F.sequence(low, F.lit(0))).otherwise(F.array(pos))
        last = F.when(pos == size - 1, F.sequence(size - 1, high)).otherwise(F.array(pos))
        return F.array_distinct(F.concat(first, last))
    if border == "reflect":
        period = 2 * size
        images = lambda m: F.array(period * m + pos, period * m - 1 - pos)
    elif border == "reflect101":
        period = F.greatest(2 * (size - 1), F.lit(1))
        images = lambda m: F.array(period * m + pos, period * m - pos)
    elif border == "wrap":
        period = size
        images = lambda m: F.array(period * m + pos)
    else:
        raise ValueError(f"unknown border {border}")
    turns = F.ceil(F.lit(float(max(before, after))) / period).cast("int") + 1
    all_positions = F.flatten(F.transform(F.sequence(-turns, turns), images))
    near_edge = (pos <= before) | (pos <= after) | (pos >= size - 1 - before) | (pos >= size - 1 - after)
    mirrored = F.array_distinct(F.filter(all_positions, lambda p: p.between(low, high)))
    return F.when(near_edge, mirrored).otherwise(F.array(pos))


def _placed(pos: Column, size: Column, before: int, after: int, border: str, tile: int) -> Column:
    """Array of (position, tile) pairs along one axis."""
    last = F.floor((size - 1) / tile).cast("int")

    def tiles(p: Column) -> Column:
        t0 = F.greatest(F.floor((p - after) / tile).cast("int"), F.lit(0))
        t1 = F.least(F.floor((p + before) / tile).cast("int"), last)
        return F.transform(F.sequence(t0, t1), lambda t: F.struct(p.cast("int").alias("p"), t.alias("t")))

    inner = pos % tile
    simple = (inner >= after) & (inner < tile - before) & (pos > before) & (pos > after)
    simple = simple & (pos < size - 1 - before) & (pos < size - 1 - after)
    one = F.array(F.struct(pos.cast("int").alias("p"), F.floor(pos / tile).cast("int").alias("t")))
    return F.when(simple, one).otherwise(
        F.flatten(F.transform(_copies(pos, size, before, after, border), tiles))
    )


def tile_for(tile: int, margin: int) -> int:
    """The tile size that is used: at least twice the margin, so that a pixel is copied to its neighbours only."""
    return max(tile, 2 * max(margin, 1))


def halo(
    df: DataFrame, before: int, after: int | None = None, border: str = "none", tile: int = TILE, axes: str = "yx"
) -> DataFrame:
    """Copy pixels to the tiles that need them and shuffle once by tile.

    ``before``/``after`` is the margin towards smaller/larger coordinates.
    Adds ``_ty, _tx, _h, _w`` and ``_core`` (the pixel belongs to the tile).
    """
    after = before if after is None else after
    df = df if "_h" in df.columns else with_dims(df)
    tile = tile_for(tile, max(before, after))
    out = df
    for axis, size, key in (("y", "_h", "_ty"), ("x", "_w", "_tx")):
        if axis in axes:
            pairs = _placed(F.col(axis), F.col(size), before, after, border, tile)
            out = out.withColumn("_a", F.explode(pairs)).withColumns({axis: F.col("_a.p"), key: F.col("_a.t")}).drop("_a")
        else:
            out = out.withColumn(key, F.floor(F.col(axis) / tile).cast("int"))
    core = (F.floor(F.col("y") / tile) == F.col("_ty")) & (F.floor(F.col("x") / tile) == F.col("_tx"))
    core = core & F.col("y").between(0, F.col("_h") - 1) & F.col("x").between(0, F.col("_w") - 1)
    return out.withColumn("_core", core).repartition(*_TILE_KEYS)


def core(df: DataFrame, *keep: str) -> DataFrame:
    """Drop margin pixels and helper columns."""
    names = keep or [c for c in df.columns if not c.startswith("_")]
    return df.where("_core").select(*names)


def along_x() -> Window:
    return Window.partitionBy(*_TILE_KEYS, "y").orderBy("x")


def along_y() -> Window:
    return Window.partitionBy(*_TILE_KEYS, "x").orderBy("y")


def at_x(c: str | Column, d: int) -> Column:
    """Value ``d`` columns to the right, null where there is no pixel."""
    return F.first(c).over(along_x().rangeBetween(d, d))


def at_y(c: str | Column, d: int) -> Column:
    return F.first(c).over(along_y().rangeBetween(d, d))


def _span(c: Column, w: Window, before: int, after: int) -> Column:
    """Sum over [-before, after] as a difference of two running sums, so the
    cost per pixel does not depend on the span."""
    start = Window.unboundedPreceding
    upto = F.sum(c).over(w.rangeBetween(start, after))
    earlier = F.sum(c).over(w.rangeBetween(start, -before - 1))
    return upto - F.coalesce(earlier, F.lit(0.0))


def box_means(df: DataFrame, columns: Sequence[str], size: int, border: str = "reflect", tile: int = TILE) -> DataFrame:
    """Adds ``<c>_mean`` over size x size windows (left-heavy for even sizes)."""
    before, after = size // 2, size - 1 - size // 2
    out = halo(df, before, after, border, tile)
    out = out.withColumns({f"_r{i}": _span(F.col(c), along_x(), before, after) for i, c in enumerate(columns)})
    out = out.withColumn("_rn", _span(F.lit(1.0), along_x(), before, after))
    n = _span(F.col("_rn"), along_y(), before, after)
    out = out.withColumns({f"{c}_mean": _span(F.col(f"_r{i}"), along_y(), before, after) / n for i, c in enumerate(columns)})
    return core(out)


def wallis(
    df: DataFrame, value: str, size: int = 100, target_mean: float = 127.0, target_std: float = 50.0,
    a: float = 0.0, b: float = 1.0, tile: int = TILE,
) -> DataFrame:
    """Local contrast normalisation, truncated to 0..255; adds ``wallis``."""
    rows = df.withColumns({"_v": F.col(value), "_v2": F.col(value) * F.col(value)}).withColumnsRenamed({"_v": "wv", "_v2": "wv2"})
    m = box_means(rows, ["wv", "wv2"], size, "reflect", tile)
    mean = F.col("wv_mean")
    std = F.sqrt(F.greatest(F.col("wv2_mean") - mean * mean, F.lit(0.0)))
    gain = F.greatest(std + a, F.lit(1e-4))
    out = target_std * (F.col(value) - mean) / gain + target_mean * b + mean * (1 - b)
    limited = F.greatest(F.lit(0.0), F.least(F.lit(255.0), out))
    return m.withColumn("wallis", F.floor(limited).cast("int")).drop("wv", "wv2", "wv_mean", "wv2_mean")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    t = np.arange(-r, r + 1)
    w = np.exp(-0.5 * (t / sigma) ** 2)
    return w / w.sum()


def gaussian_low_pass(
    df: DataFrame, columns: Sequence[str], sigma: float, border: str = "reflect", suffix: str = "_low", tile: int = TILE
) -> DataFrame:
    """Separable Gaussian of several columns; a numpy kernel per tile.

    Missing pixels and nulls have no weight: what is known is averaged by the
    weights that fall on it. Null stays null. Tiles are at least eight radii
    wide, so that margins stay small beside them.
    """
    w = gaussian_weights(sigma)
    r = len(w) // 2
    tile = max(tile, 8 * r)
    keep = list(df.columns)
    haloed = halo(df, r, r, border, tile).select(*[c for c in keep if c not in KEY], *KEY, "_core", "_ty", "_tx")

    def blur(plane: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            acc, n = np.zeros(plane.shape), plane.shape[axis]
            for k, weight in enumerate(w):
                d = k - r
                if abs(d) >= n:
                    continue
                to, src = [slice(None), slice(None)], [slice(None), slice(None)]
                to[axis], src[axis] = slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d))
                acc[tuple(to)] += weight * plane[tuple(src)]
            plane = acc
        return plane

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        iy, ix = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        shape = (int(iy.max()) + 1, int(ix.max()) + 1)
        inner = pdf["_core"].to_numpy()
        out = pdf.loc[inner, keep].copy()
        for c in columns:
            plane, known = np.zeros(shape), np.zeros(shape)
            values = pdf[c].to_numpy(float)
            there = ~np.isnan(values)
            plane[iy[there], ix[there]] = values[there]
            known[iy[there], ix[there]] = 1
            plane, weight = blur(plane), blur(known)
            plane = np.divide(plane, weight, out=np.full(shape, np.nan), where=weight > 0)
            plane[iy[~there], ix[~there]] = np.nan
            out[c + suffix] = plane[iy[inner], ix[inner]]
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema += "".join(f", `{c}{suffix}` double" for c in columns)
    return haloed.groupBy(*_TILE_KEYS).applyInPandas(smooth, schema)


def gradients(df: DataFrame, value: str, kind: str = "forward", tile: int = TILE) -> DataFrame:
    """Adds gx and gy. Forward and backward differences are 0 on the last or
    first pixel; central ones become one-sided there."""
    v = F.col(value)
    out = halo(df, 1, 1, "none", tile)
    out = out.withColumns({"_l": at_x(value, -1), "_r": at_x(value, 1), "_u": at_y(value, -1), "_d": at_y(value, 1)})

    def one(prev: str, nxt: str) -> Column:
        p, n = F.col(prev), F.col(nxt)
        if kind == "forward":
            return F.coalesce(n - v, F.lit(0.0))
        if kind == "backward":
            return F.coalesce(v - p, F.lit(0.0))
        return F.coalesce((n - p) / 2, n - v, v - p, F.lit(0.0))

    return core(out.withColumns({"gx": one("_l", "_r"), "gy": one("_u", "_d")}))


def divergence(df: DataFrame, p: str = "p", q: str = "q", tile: int = TILE) -> DataFrame:
    """Adds ``div``: backward differences of p, q, both 0 on the far edge."""
    out = halo(df, 1, 1, "none", tile)
    out = out.withColumns(
        {"_fx": F.when(F.col("x") < F.col("_w") - 1, F.col(p)).otherwise(0.0), "_fy": F.when(F.col("y") < F.col("_h") - 1, F.col(q)).otherwise(0.0)}
    )
    dx = F.col("_fx") - F.coalesce(at_x("_fx", -1), F.lit(0.0))
    dy = F.col("_fy") - F.coalesce(at_y("_fy", -1), F.lit(0.0))
    return core(out.withColumn("div", dx + dy))


def laplacian(df: DataFrame, value: str, tile: int = TILE) -> DataFrame:
    """Adds ``lap``: neighbours minus own value, missing neighbours left out."""
    out = halo(df, 1, 1, "none", tile)
    parts = [at_x(value, -1), at_x(value, 1), at_y(value, -1), at_y(value, 1)]
    out = out.withColumns({f"_n{i}": p for i, p in enumerate(parts)})
    total = sum((F.coalesce(F.col(f"_n{i}") - F.col(value), F.lit(0.0)) for i in range(4)), F.lit(0.0))
    return core(out.withColumn("lap", total))


# Derivative kernels as (smoothing, difference) factors.
SMOOTHING = {"sobel": (1.0, 2.0, 1.0), "scharr": (3.0, 10.0, 3.0)}


def derivative_3x3(df: DataFrame, columns: Sequence[str], kind: str = "scharr", border: str = "reflect101", tile: int = TILE) -> DataFrame:
    """Adds ``<c>_dx`` and ``<c>_dy`` by separable 3x3 filters."""
    s0, s1, s2 = SMOOTHING[kind]
    out = halo(df, 1, 1, border, tile)
    rows = {}
    for i, c in enumerate(columns):
        rows[f"_dx{i}"] = at_x(c, 1) - at_x(c, -1)
        rows[f"_sm{i}"] = s0 * at_x(c, -1) + s1 * F.col(c) + s2 * at_x(c, 1)
    out = out.withColumns(rows)
    cols = {}
    for i, c in enumerate(columns):
        cols[f"{c}_dx"] = s0 * at_y(f"_dx{i}", -1) + s1 * F.col(f"_dx{i}") + s2 * at_y(f"_dx{i}", 1)
        cols[f"{c}_dy"] = at_y(f"_sm{i}", 1) - at_y(f"_sm{i}", -1)
    return core(out.withColumns(cols))


def normals_from_depth(df: DataFrame, z: str = "z", kind: str = "scharr", tile: int = TILE) -> DataFrame:
    """Adds nx, ny, nz = (-dx, -dy, 1) at unit length."""
    out = derivative_3x3(df, [z], kind, tile=tile)
    dx, dy = F.col(f"{z}_dx"), F.col(f"{z}_dy")
    n = F.sqrt(dx * dx + dy * dy + 1)
    return out.withColumns({"nx": -dx / n, "ny": -dy / n, "nz": 1 / n}).drop(f"{z}_dx", f"{z}_dy")


def curvatures(df: DataFrame, p: str = "p", q: str = "q", tile: int = TILE) -> DataFrame:
    """Adds gaussian and mean curvature of gradient planes.

    The Gaussian one uses 3x3 Sobel filters (horizontal sign left minus
    right), the mean one plain central differences.
    """
    out = halo(df, 1, 1, "reflect101", tile)
    rows = {}
    for c in (p, q):
        rows[f"_{c}x"] = at_x(c, 1) - at_x(c, -1)
        rows[f"_{c}s"] = at_x(c, -1) + 2 * F.col(c) + at_x(c, 1)
        rows[f"_{c}y"] = at_y(c, 1) - at_y(c, -1)
    out = out.withColumns(rows)

    def sobel_x(c: str) -> Column:
        return -(at_y(f"_{c}x", -1) + 2 * F.col(f"_{c}x") + at_y(f"_{c}x", 1))

    def sobel_y(c: str) -> Column:
        return at_y(f"_{c}s", 1) - at_y(f"_{c}s", -1)

    out = out.withColumns({"_ixx": sobel_x(p), "_ixy": sobel_y(p), "_iyy": sobel_y(q), "_iyx": sobel_x(q)})
    pp, qq = F.col(p), F.col(q)
    slope = 1 + pp * pp + qq * qq
    gauss = (F.col("_ixx") * F.col("_iyy") - F.col("_ixy") * F.col("_iyx")) / (slope * slope)
    mean = (1 + pp * pp) * F.col(f"_{q}y") - pp * qq * (F.col(f"_{p}y") + F.col(f"_{q}x")) + (1 + qq * qq) * F.col(f"_{p}x")
    return core(out.withColumns({"gaussian": gauss, "mean": mean / F.pow(slope, F.lit(1.5))}))


def clean_peaks(df: DataFrame, value: str, threshold: float = 2.0, tile: int = TILE) -> DataFrame:
    """Replace missing values and peaks by the 3x3 local mean; adds ``cleaned``.

    Missing counts as zero in the mean. A peak deviates from its local mean by
    more than ``threshold`` standard deviations of the image. Edge pixels use
    the mean of the nearest inner pixel.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.withColumns({"wv0": F.coalesce(v, F.lit(0.0)), "wmissing": v.isNull()})
    sd = rows.groupBy("image_id").agg(F.stddev_pop("wv0").alias("wsd"))
    out = halo(attach(rows, sd, ["image_id"]), 2, 2, "none", tile)
    out = out.withColumn("_rx", at_x("wv0", -1) + F.col("wv0") + at_x("wv0", 1))
    out = out.withColumn("_rx", F.when(F.col("x") == 0, at_x("_rx", 1)).when(F.col("x") == F.col("_w") - 1, at_x("_rx", -1)).otherwise(F.col("_rx")))
    out = out.withColumn("_ry", at_y("_rx", -1) + F.col("_rx") + at_y("_rx", 1))
    out = out.withColumn("_ry", F.when(F.col("y") == 0, at_y("_ry", 1)).when(F.col("y") == F.col("_h") - 1, at_y("_ry", -1)).otherwise(F.col("_ry")))
    local = F.col("_ry") / 9
    peak = F.abs(F.col("wv0") - local) > threshold * F.col("wsd")
    fixed = F.when(F.col("wmissing") | peak, local).otherwise(F.col("wv0"))
    return core(out.withColumn("cleaned", F.coalesce(fixed, F.col("wv0")))).drop("wv0", "wmissing", "wsd")


# -- coordinates and sampling -----------------------------------------------------


def flip_vertical(df: DataFrame) -> DataFrame:
    return with_dims(df).withColumn("y", F.col("_h") - 1 - F.col("y")).drop("_h", "_w")


def decimate_coarse(df: DataFrame, k: int) -> DataFrame:
    """Every k-th row and column, renumbered."""
    hit = (F.pmod(F.col("x"), F.lit(k)) == 0) & (F.pmod(F.col("y"), F.lit(k)) == 0)
    step = lambda c: F.floor(F.col(c) / k).cast("int")
    return df.where(hit).withColumns({"y": step("y"), "x": step("x")})


def blocks(df: DataFrame, columns: Sequence[str], tile: int = TILE) -> DataFrame:
    """Each pixel with its right, lower and lower-right neighbour:
    ``<c>_00, _01, _10, _11`` (edge pixels repeat)."""
    out = halo(df, 1, 1, "none", tile)
    right = {f"_x{i}": F.coalesce(at_x(c, 1), F.col(c)) for i, c in enumerate(columns)}
    out = out.withColumns(right)
    cells = {}
    for i, c in enumerate(columns):
        cells[f"{c}_00"] = F.col(c)
        cells[f"{c}_01"] = F.col(f"_x{i}")
        cells[f"{c}_10"] = F.coalesce(at_y(c, 1), F.col(c))
        cells[f"{c}_11"] = F.coalesce(at_y(f"_x{i}", 1), F.col(f"_x{i}"))
    return out.withColumns(cells).where("_core")


def bilinear(c: str, fy: Column, fx: Column) -> Column:
    top = F.col(f"{c}_00") * (1 - fx) + F.col(f"{c}_01") * fx
    low = F.col(f"{c}_10") * (1 - fx) + F.col(f"{c}_11") * fx
    return top * (1 - fy) + low * fy


def decimate_smooth(df: DataFrame, columns: Sequence[str], k: int, tile: int = TILE) -> DataFrame:
    """Bilinear resize to size // k (pixel centres aligned).

    Each source pixel knows which output pixel samples its 2x2 block, so no
    output grid and no join is needed.
    """
    b = blocks(df, columns, tile)

    def target(pos: Column, size: Column) -> tuple[Column, Column, Column]:
        count = F.floor(size / k)
        scale = size / count
        i = F.ceil((pos + 0.5) / scale - 0.5)
        src = (i + 0.5) * scale - 0.5
        return i, src - pos, (count > 0) & (i >= 0) & (i < count) & (src >= pos) & (src < pos + 1)

    i, fy, ok_y = target(F.col("y"), F.col("_h"))
    j, fx, ok_x = target(F.col("x"), F.col("_w"))
    b = b.withColumns({"_i": i, "_j": j, "_fy": fy, "_fx": fx, "_ok": ok_y & ok_x}).where("_ok")
    return b.select(
        "image_id", F.col("_i").cast("int").alias("y"), F.col("_j").cast("int").alias("x"),
        *[bilinear(c, F.col("_fy"), F.col("_fx")).alias(c) for c in columns],
    )


def sample(df: DataFrame, columns: Sequence[str], wanted: DataFrame, sy: str, sx: str, tile: int = TILE) -> DataFrame:
    """Bilinear values at fractional positions: ``wanted`` has image_id, sy, sx.

    One equi-join on the block holding the position. Positions outside the
    image have no row in the result. Neither side is broadcast: ``wanted`` is
    often unfolded from a few rows, by whose size Spark would judge it.
    """
    b = blocks(df, columns, tile).select(
        "image_id", F.col("y").alias("_by"), F.col("x").alias("_bx"), "_h", "_w", *[f"{c}_{s}" for c in columns for s in ("00", "01", "10", "11")]
    )
    at = wanted.withColumns({"_by": F.floor(sy).cast("int"), "_bx": F.floor(sx).cast("int")})
    joined = at.hint("merge").join(b.hint("merge"), ["image_id", "_by", "_bx"])
    joined = joined.where((F.col(sy) <= F.col("_h") - 1) & (F.col(sx) <= F.col("_w") - 1))
    fy, fx = F.col(sy) - F.col("_by"), F.col(sx) - F.col("_bx")
    return joined.select(*wanted.columns, *[bilinear(c, fy, fx).alias(c) for c in columns])


def undistort(df: DataFrame, columns: Sequence[str], camera: dict, k, p, tile: int = TILE) -> DataFrame:
    """Lens correction: each pixel takes the value at its distorted position."""
    from gesso.functions.geometry import undistort_coords

    sx, sy = undistort_coords(F.col("x"), F.col("y"), camera["fx"], camera["fy"], camera["cx"], camera["cy"], k, p)
    wanted = df.select(*KEY, sy.alias("_sy"), sx.alias("_sx"))
    return sample(df.select(*KEY, *columns), columns, wanted, "_sy", "_sx", tile).drop("_sy", "_sx")


def valid_positions(mask: DataFrame, wanted: DataFrame, sy: str, sx: str, tile: int = TILE) -> DataFrame:
    """Flag positions inside the image whose bilinear neighbours are valid.

    ``mask`` has image_id, y, x, valid; a missing pixel is invalid. Adds ``ok``.
    """
    flags = mask.select(*KEY, F.when(F.col("valid"), 1.0).otherwise(0.0).alias("m"))
    b = blocks(flags, ["m"], tile)
    all_four = F.least("m_00", "m_01", "m_10", "m_11") > 0
    b = b.select("image_id", F.col("y").alias("_by"), F.col("x").alias("_bx"), "_h", "_w", all_four.alias("_four"))
    at = wanted.withColumns({"_by": F.floor(sy).cast("int"), "_bx": F.floor(sx).cast("int")})
    inside = (F.col(sy) <= F.col("_h") - 1) & (F.col(sx) <= F.col("_w") - 1)
    joined = at.hint("merge").join(b.hint("merge"), ["image_id", "_by", "_bx"], "left")
    return joined.select(*wanted.columns, F.coalesce(inside & F.col("_four"), F.lit(False)).alias("ok"))


# -- tiles --------------------------------------------------------------------------


def tile_pixels(df: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Pixels of overlapping tiles with their position inside the tile."""
    out = halo(df, overlap, overlap, "none", tile)
    step = tile_for(tile, overlap)
    return out.withColumns(
        {"ty": F.col("_ty"), "tx": F.col("_tx"), "in_y": F.col("y") - F.col("_ty") * step, "in_x": F.col("x") - F.col("_tx") * step}
    ).drop("_h", "_w", "_core", "_ty", "_tx")


def tile_weight(in_y: Column, in_x: Column, tile: int, overlap: int) -> Column:
    """Gaussian weight by distance from the tile centre."""
    tile = tile_for(tile, overlap)
    full = tile + 2 * overlap
    s = full / 4.0
    mid = (tile - 1) / 2.0
    return F.exp(-(F.pow(in_y - mid, 2) + F.pow(in_x - mid, 2)) / (2 * s * s))


def tile_recombine(df: DataFrame, value: str, tile: int, overlap: int) -> DataFrame:
    """Weighted average of the copies of each pixel."""
    w = tile_weight(F.col("in_y"), F.col("in_x"), tile, overlap)
    return df.groupBy(*KEY).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def local_shrinkage(sigma: float, size: int = 3):
    """Kernel: pull pixels towards their local mean as far as noise explains."""

    def run(plane: np.ndarray) -> np.ndarray:
        r = size // 2
        padded = np.pad(plane, r, mode="edge")
        views = np.lib.stride_tricks.sliding_window_view(padded, (size, size))
        mean, var = views.mean(axis=(2, 3)), views.var(axis=(2, 3))
        gain = np.maximum(var - sigma**2, 0) / np.maximum(var, 1e-12)
        return mean + gain * (plane - mean)

    return run


def tile_job(df: DataFrame, value: str, kernel, tile: int = 256, overlap: int = 16) -> DataFrame:
    """Run a numpy kernel on overlapping tiles and blend the results."""
    pixels = tile_pixels(df.select(*KEY, value), tile, overlap)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        iy, ix = (pdf["y"] - pdf["y"].min()).to_numpy(), (pdf["x"] - pdf["x"].min()).to_numpy()
        plane = np.zeros((iy.max() + 1, ix.max() + 1))
        plane[iy, ix] = pdf[value].to_numpy()
        return pdf.assign(**{value: kernel(plane)[iy, ix]})

    kind = df.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, y int, x int, {value} double, ty int, tx int, in_y int, in_x int"
    done = pixels.select("image_id", "y", "x", F.col(value).cast("double").alias(value), "ty", "tx", "in_y", "in_x")
    done = done.groupBy("image_id", "ty", "tx").applyInPandas(run, schema)
    return tile_recombine(done, value, tile, overlap)


# -- running sums -------------------------------------------------------------------


def islands(df: DataFrame, valid: str, keys: Sequence[str], order: str) -> DataFrame:
    """Contiguous valid runs along one image line: adds ``segment`` (null on
    invalid pixels). Lines are at most an image side long."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.when(F.col(valid) & F.coalesce(F.lag(valid).over(w), F.lit(False)) & (F.lag(order).over(w) == F.col(order) - 1), 0).otherwise(1)
    out = df.withColumn("_gap", F.when(F.col(valid), gap).otherwise(0))
    return out.withColumn("segment", F.when(F.col(valid), F.sum("_gap").over(w))).drop("_gap")


def integrate_direct(grad: DataFrame) -> DataFrame:
    """Depth by summing p along the centre row, then q along every column.

    ``grad``: image_id, y, x, p, q, valid. An invalid pixel breaks a chain;
    beyond it the sum starts again at 0. If the centre is invalid the nearest
    valid pixel is the start.
    """
    sized = with_dims(grad)
    cy, cx = F.floor(F.col("_h") / 2), F.floor(F.col("_w") / 2)
    away = F.pow(F.col("y") - cy, 2) + F.pow(F.col("x") - cx, 2)
    start = sized.where("valid").groupBy("image_id").agg(F.min(F.struct(away.alias("d"), "y", "x")).alias("_s"))
    rows = attach(sized, start.select("image_id", F.col("_s.y").alias("_cy"), F.col("_s.x").alias("_cx")), ["image_id"])

    def chain(df: DataFrame, keys: list, pos: str, centre: str, slope: str, base: Column) -> DataFrame:
        # the centre line takes part in both directions and starts both chains
        both = df.withColumn(
            "_dir", F.explode(F.when(F.col(pos) > F.col(centre), F.array(F.lit(1)))
                              .when(F.col(pos) < F.col(centre), F.array(F.lit(-1))).otherwise(F.array(F.lit(1), F.lit(-1)))))
        both = both.withColumn("_step", (F.col(pos) - F.col(centre)) * F.col("_dir"))
        w = Window.partitionBy(*keys, "_dir").orderBy("_step")
        linked = F.col("valid") & F.lag("valid").over(w) & (F.lag("_step").over(w) == F.col("_step") - 1)
        move = F.when(F.col("_dir") == 1, F.lag(slope).over(w)).otherwise(-F.col(slope))
        both = both.withColumns({
            "_break": F.when((F.col("_step") == 0) | linked, 0).otherwise(1),
            "_move": F.when((F.col("_step") > 0) & linked, move).otherwise(0.0), "_base": F.when(F.col("_step") == 0, base)})
        both = both.withColumn("_isle", F.sum("_break").over(w))
        inside = Window.partitionBy(*keys, "_dir", "_isle").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
        z = F.sum("_move").over(inside) + F.coalesce(F.first("_base", ignorenulls=True).over(inside), F.lit(0.0))
        both = both.withColumn("_z", F.when(F.col("valid"), z).otherwise(0.0))
        return both.where((F.col("_dir") == 1) | (F.col("_step") > 0))

    line = chain(rows.where(F.col("y") == F.col("_cy")), ["image_id"], "x", "_cx", "p", F.lit(0.0))
    line = line.select("image_id", "x", F.col("_z").alias("_z0"))
    columns = rows.join(line, ["image_id", "x"], "left").withColumn("_z0", F.coalesce("_z0", F.lit(0.0)))
    done = chain(columns, ["image_id", "x"], "y", "_cy", "q", F.col("_z0"))
    return done.select(*KEY, F.col("_z").alias("z"))
