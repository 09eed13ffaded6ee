"""Global alignment of grid cells and the panorama."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gesso.functions import geometry as g
from gesso.operators import grid as gr
from gesso.operators.scans import attach
from gesso.session import keep, lookup, spread


def guarded(h: Column, limit: float = 5.0) -> Column:
    """Translation only where the rotation exceeds ``limit`` degrees."""
    return F.when(F.abs(g.rotation_degrees(h)) > limit, g.translation_only(h)).otherwise(h)


def average_paths(a: Column, b: Column) -> Column:
    """Element-wise mean of two estimates, or the one that exists."""
    mean = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    return F.coalesce(mean, a, b)


def propagate_transforms(steps: DataFrame, cells: DataFrame) -> DataFrame:
    """Transform of every cell to the centre cell: row, col, h.

    ``steps``: row, col, dir (right, left, top, bottom), h, the transform of
    the neighbour in that direction to the cell. Each cell is reached twice,
    along the centre row and then its column, and the other way round; the two
    are averaged, or the one that exists is taken (null if a link is missing on
    both). A line of cells is folded in a window; lines are as long as
    a grid side.
    """
    size = cells.agg(F.struct((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols")).alias("s")).scalar()
    base = cells.withColumn("_s", size).select(
        "row", "col", g.centre_index(F.col("_s.rows")).alias("_cr"), g.centre_index(F.col("_s.cols")).alias("_cc")
    )
    towards = {("col", 1): "right", ("col", -1): "left", ("row", 1): "top", ("row", -1): "bottom"}

    def walk(axis: str, line: DataFrame, start: Column) -> DataFrame:
        """Fold step transforms outwards along ``axis``; ``start`` is the
        transform on the centre line."""
        centre = "_cc" if axis == "col" else "_cr"
        other = "row" if axis == "col" else "col"
        line = line.withColumn("_side", F.signum(F.col(axis) - F.col(centre)).cast("int"))
        inner = F.col(axis) - F.col("_side")
        want = F.when(F.col("_side") > 0, towards[(axis, 1)]).when(F.col("_side") < 0, towards[(axis, -1)])
        keyed = line.withColumns({"_ir": inner if axis == "row" else F.col("row"), "_ic": inner if axis == "col" else F.col("col"), "_want": want})
        st = steps.select(F.col("row").alias("_ir"), F.col("col").alias("_ic"), F.col("dir").alias("_want"), F.col("h").alias("_step"))
        keyed = keyed.join(st, ["_ir", "_ic", "_want"], "left").withColumn("_base", start)
        w = Window.partitionBy(other, F.col("_side")).orderBy(F.abs(F.col(axis) - F.col(centre)))
        chain = F.collect_list(F.struct(F.col("_step").alias("h"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        full = F.count("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)) == F.abs(F.col(axis) - F.col(centre))
        folded = F.aggregate(F.col("_chain"), F.col("_base"), lambda acc, s: guarded(g.compose(acc, s.h)))
        keyed = keyed.withColumns({"_chain": chain, "_full": full})
        return keyed.withColumn("_h", F.when(F.col("_side") == 0, F.col("_base")).when(F.col("_full"), folded))

    identity = g.lit_matrix(g.IDENTITY9)

    def path(first: str, second: str) -> DataFrame:
        on_line = F.col("row") == F.col("_cr") if first == "col" else F.col("col") == F.col("_cc")
        trunk = walk(first, base.where(on_line), identity).select(F.col(first), F.col("_h").alias("_trunk"))
        return walk(second, base.join(trunk, first, "left"), F.col("_trunk")).select("row", "col", F.col("_h"))

    one = path("col", "row").withColumnRenamed("_h", "_a")
    two = path("row", "col").withColumnRenamed("_h", "_b")
    return one.join(two, ["row", "col"]).select("row", "col", average_paths(F.col("_a"), F.col("_b")).alias("h"))


def extents(transforms: DataFrame, width: float, height: float, keys: Sequence[str] = ()) -> DataFrame:
    """Bounding box of transformed image corners, rounded outwards."""
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (width, 0), (width, height), (0, height))])
    c = transforms.withColumn("_c", F.explode(corners))
    px, py = g.apply_homography(F.col("h"), F.col("_c.x"), F.col("_c.y"))
    c = c.withColumns({"_px": px, "_py": py})
    # conversion to integer drops the fraction
    to_int = lambda e: e.cast("int")
    return c.groupBy(*keys).agg(
        to_int(F.min("_px") - 0.5).alias("x0"), to_int(F.min("_py") - 0.5).alias("y0"), to_int(F.max("_px") + 0.5).alias("x1"), to_int(F.max("_py") + 0.5).alias("y1")
    )


def bundle_adjust(ties: DataFrame, start: DataFrame, mosaic: str = "mosaic", rounds: int | None = None, loss: str = "cauchy", scale: float = 1.0, tolerance: float = 1e-5) -> DataFrame:
    """Affine transforms of all cells of each mosaic by robust least squares.

    ``ties``: mosaic, c1, x1, y1, c2, x2, y2 (cell ids); ``start``: mosaic,
    cell, h, anchor (boolean, one cell per mosaic stays fixed). Per round one
    aggregate gives 3x3 blocks per cell pair; the system of a mosaic is solved
    in one group by conjugate gradients on these blocks, in memory that grows
    with its cells alone. Rounds go on until no transform changes by more than
    ``tolerance``, or as often as ``rounds`` says.
    """
    current = keep(start.select(mosaic, "cell", "h", "anchor"))
    weight = g.cauchy_weight if loss == "cauchy" else g.huber_weight
    for done in range(rounds or MAX_ROUNDS):
        lk = lookup(current)
        side = lambda i: lk.select(mosaic, F.col("cell").alias(f"c{i}"), F.col("h").alias(f"_h{i}"))
        rows = ties.join(side(1), [mosaic, "c1"]).join(side(2), [mosaic, "c2"])
        p = {i: (F.col(f"x{i}"), F.col(f"y{i}"), F.lit(1.0)) for i in (1, 2)}
        at = lambda i, r: sum((F.col(f"_h{i}")[3 * r + k] * p[i][k] for k in range(3)), F.lit(0.0))
        gap = F.sqrt(F.pow(at(1, 0) - at(2, 0), 2) + F.pow(at(1, 1) - at(2, 1), 2))
        rows = rows.withColumn("_w", weight(gap, scale))
        sums = [
            F.sum(F.col("_w") * p[a][i] * p[b][j]).alias(f"s{a}{b}{i}{j}")
            for a, b in ((1, 1), (1, 2), (2, 2)) for i in range(3) for j in range(3)
        ]
        names = [f"s{a}{b}{i}{j}" for a, b in ((1, 1), (1, 2), (2, 2)) for i in range(3) for j in range(3)]
        blocks = rows.groupBy(mosaic, "c1", "c2").agg(*sums).select(mosaic, "c1", "c2", F.array(*names).alias("b"))
        current, before = keep(_solve_blocks(blocks, current, mosaic)), current
        if rounds is None and _change(before, current, mosaic) <= tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"transforms still change after {done + 1} rounds")
    return current.select(mosaic, "cell", "h")


MAX_ROUNDS = 200


def _change(before: DataFrame, after: DataFrame, mosaic: str) -> float:
    """Largest change of a matrix entry, against one plus its size."""
    both = after.select(mosaic, "cell", "h").join(before.select(mosaic, "cell", F.col("h").alias("_b")), [mosaic, "cell"])
    gap = F.array_max(F.zip_with("h", "_b", lambda a, b: F.abs(a - b) / (1 + F.abs(b))))
    return float(both.agg(F.max(gap)).first()[0] or 0.0)


def _block_solve(first: np.ndarray, second: np.ndarray, blocks: np.ndarray, rhs: np.ndarray, free: np.ndarray, limit: int = 20_000) -> np.ndarray:
    """Solve sum over pairs (i, j) of [[s0, -s1], [-s1', s2]] x = rhs on the free cells.

    ``blocks``: pairs x 3 x k x k; ``rhs``: cells x k x columns. Conjugate
    gradients for all columns, preconditioned by the cells' own blocks; only
    blocks are kept, never a matrix of all cells.
    """
    k = blocks.shape[-1]
    own = np.zeros((len(rhs), k, k))
    np.add.at(own, first, blocks[:, 0])
    np.add.at(own, second, blocks[:, 2])
    back = np.zeros_like(own)
    if free.any():
        back[free] = np.linalg.pinv(own[free], rcond=1e-13, hermitian=True)
    cross = blocks[:, 1]

    def times(x: np.ndarray) -> np.ndarray:
        y = own @ x
        np.add.at(y, first, -(cross @ x[second]))
        np.add.at(y, second, -(cross.transpose(0, 2, 1) @ x[first]))
        y[~free] = 0
        return y

    x = np.zeros_like(rhs)
    r = np.where(free[:, None, None], rhs, 0.0)
    z = back @ r
    p, rz = z.copy(), (r * z).sum(axis=(0, 1))
    stop = 1e-22 * np.maximum(rz, 1e-300)
    for _ in range(limit):
        if (rz <= stop).all():
            return x
        ap = times(p)
        curve = (p * ap).sum(axis=(0, 1))
        alpha = np.divide(rz, curve, out=np.zeros_like(rz), where=(curve > 0) & (rz > stop))
        if not alpha.any():
            return x
        x += alpha * p
        r -= alpha * ap
        z = back @ r
        new = (r * z).sum(axis=(0, 1))
        p = z + np.divide(new, rz, out=np.zeros_like(rz), where=rz > 0) * p
        rz = new
    raise RuntimeError(f"block system not solved after {limit} steps")


def _solve_blocks(blocks: DataFrame, current: DataFrame, mosaic: str) -> DataFrame:
    kind = current.schema[mosaic].dataType.simpleString()

    def solve(b: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("cell").reset_index(drop=True)
        place = {c: i for i, c in enumerate(cells["cell"])}
        h = np.stack(cells["h"]).astype(float)
        params = np.stack([h[:, 0:3], h[:, 3:6]], axis=2)
        fixed = cells["anchor"].to_numpy(bool)
        if len(b) and fixed.any():
            first, second = b["c1"].map(place).to_numpy(), b["c2"].map(place).to_numpy()
            s = np.stack(b["b"]).astype(float).reshape(-1, 3, 3, 3)
            free = ~fixed & np.isin(np.arange(len(cells)), np.concatenate([first, second]))
            # anchors keep their values, whose terms go to the right side
            held = np.where(free[:, None, None], 0.0, params)
            rhs = np.zeros_like(params)
            np.add.at(rhs, first, s[:, 1] @ held[second])
            np.add.at(rhs, second, s[:, 1].transpose(0, 2, 1) @ held[first])
            params[free] = _block_solve(first, second, s, rhs, free)[free]
        out = [[*row[:, 0], *row[:, 1], 0.0, 0.0, 1.0] for row in params]
        return pd.DataFrame({mosaic: cells[mosaic], "cell": cells["cell"], "h": out, "anchor": cells["anchor"]})

    return blocks.groupBy(mosaic).cogroup(current.groupBy(mosaic)).applyInPandas(
        solve, f"{mosaic} {kind}, cell int, h array<double>, anchor boolean"
    )


def bundle_adjust_homography(ties: DataFrame, start: DataFrame, mosaic: str = "mosaic", rounds: int | None = None, loss: str = "cauchy", scale: float = 1.0, tolerance: float = 1e-5) -> DataFrame:
    """Homographies (8 free numbers, h22 = 1) of all cells by Gauss-Newton.

    Same tables as ``bundle_adjust``. A round is one aggregate of 8x8 blocks
    and gradients per cell pair, then a damped step per mosaic. Start from the
    affine solution. Rounds end as in ``bundle_adjust``.
    """
    current = keep(start.select(mosaic, "cell", "h", "anchor"))
    weight = g.cauchy_weight if loss == "cauchy" else g.huber_weight
    for done in range(rounds or MAX_ROUNDS):
        lk = lookup(current)
        side = lambda i: lk.select(mosaic, F.col("cell").alias(f"c{i}"), F.col("h").alias(f"_h{i}"))
        rows = ties.join(side(1), [mosaic, "c1"]).join(side(2), [mosaic, "c2"])
        for i in (1, 2):
            x, y, h = F.col(f"x{i}"), F.col(f"y{i}"), F.col(f"_h{i}")
            rows = rows.withColumn(f"_d{i}", h[6] * x + h[7] * y + h[8]).where(F.abs(f"_d{i}") > 1e-12)
            px, py = g.apply_homography(h, x, y)
            rows = rows.withColumns({f"_px{i}": px, f"_py{i}": py})
            d, zero = F.col(f"_d{i}"), F.lit(0.0)
            near = [x / d, y / d, 1 / d]
            jx = [*near, zero, zero, zero, -F.col(f"_px{i}") * x / d, -F.col(f"_px{i}") * y / d]
            jy = [zero, zero, zero, *near, -F.col(f"_py{i}") * x / d, -F.col(f"_py{i}") * y / d]
            rows = rows.withColumns({f"_jx{i}": F.array(*jx), f"_jy{i}": F.array(*jy)})
        rows = rows.withColumns({"_rx": F.col("_px1") - F.col("_px2"), "_ry": F.col("_py1") - F.col("_py2")})
        rows = rows.withColumn("_w", weight(F.sqrt(F.col("_rx") ** 2 + F.col("_ry") ** 2), scale))
        j = lambda i, k: (F.col(f"_jx{i}")[k], F.col(f"_jy{i}")[k])
        both = lambda p, q: F.sum(F.col("_w") * (p[0] * q[0] + p[1] * q[1]))
        r = (F.col("_rx"), F.col("_ry"))
        sums = [both(j(a, i), j(b, k)) for a, b in ((1, 1), (1, 2), (2, 2)) for i in range(8) for k in range(8)]
        sums += [both(j(i, k), r) for i in (1, 2) for k in range(8)]
        flat = rows.groupBy(mosaic, "c1", "c2").agg(*[s.alias(f"s{n}") for n, s in enumerate(sums)])
        blocks = flat.select(mosaic, "c1", "c2", F.array(*[f"s{n}" for n in range(len(sums))]).alias("b"))
        current, before = keep(_step_blocks(blocks, current, mosaic)), current
        if rounds is None and _change(before, current, mosaic) <= tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"homographies still change after {done + 1} rounds")
    return current.select(mosaic, "cell", "h")


def _step_blocks(blocks: DataFrame, current: DataFrame, mosaic: str) -> DataFrame:
    kind = current.schema[mosaic].dataType.simpleString()

    def step(b: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("cell").reset_index(drop=True)
        place = {c: i for i, c in enumerate(cells["cell"])}
        h = np.stack(cells["h"]).astype(float)
        h = h / h[:, 8:9]
        if len(b):
            first, second = b["c1"].map(place).to_numpy(), b["c2"].map(place).to_numpy()
            v = np.stack(b["b"]).astype(float)
            s, e = v[:, :192].reshape(-1, 3, 8, 8), v[:, 192:].reshape(-1, 2, 8)
            free = ~cells["anchor"].to_numpy(bool) & np.isin(np.arange(len(cells)), np.concatenate([first, second]))
            grad, size = np.zeros((len(cells), 8)), np.zeros((len(cells), 8))
            np.add.at(grad, first, e[:, 0])
            np.add.at(grad, second, -e[:, 1])
            diagonal = np.arange(8)
            np.add.at(size, first, s[:, 0, diagonal, diagonal])
            np.add.at(size, second, s[:, 2, diagonal, diagonal])
            size = np.sqrt(np.maximum(size, 1e-30))
            # unit diagonal, then a little damping
            one, two = size[first], size[second]
            s = np.stack([s[:, 0] / one[:, :, None] / one[:, None, :], s[:, 1] / one[:, :, None] / two[:, None, :], s[:, 2] / two[:, :, None] / two[:, None, :]], axis=1)
            count = np.bincount(np.concatenate([first, second]), minlength=len(cells)).astype(float)
            s[:, 0] += 1e-9 / count[first][:, None, None] * np.eye(8)
            s[:, 2] += 1e-9 / count[second][:, None, None] * np.eye(8)
            delta = _block_solve(first, second, s, -(grad / size)[:, :, None], free)[:, :, 0] / size
            h[free, :8] += delta[free]
        return pd.DataFrame({mosaic: cells[mosaic], "cell": cells["cell"], "h": list(h), "anchor": cells["anchor"]})

    return blocks.groupBy(mosaic).cogroup(current.groupBy(mosaic)).applyInPandas(
        step, f"{mosaic} {kind}, cell int, h array<double>, anchor boolean"
    )


def invert3(h: Column) -> Column:
    """Adjugate of a 9-array: the inverse up to scale, enough for points."""
    e = lambda a, b, c, d: h[a] * h[d] - h[b] * h[c]
    return F.array(
        e(4, 5, 7, 8), e(2, 1, 8, 7), e(1, 2, 4, 5), e(5, 3, 8, 6), e(0, 2, 6, 8), e(2, 0, 5, 3), e(3, 4, 6, 7), e(1, 0, 7, 6), e(0, 1, 3, 4)
    )


def warp_to_panorama(pixels: DataFrame, transforms: DataFrame, columns: Sequence[str], step: int = 64, tile: int = gr.TILE) -> DataFrame:
    """Resample images into panorama pixels: image_id, py, px, values.

    ``transforms``: image_id, h (image to panorama). The box of each image is
    cut into panorama tiles, spread over tasks, and only then unfolded into
    pixels, which look up their bilinear block by an equi-join.
    """
    dims = gr.image_dims(pixels)
    t = lookup(transforms.join(dims, "image_id"))
    corners = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in (
        (F.lit(0), F.lit(0)), (F.col("_w") - 1, F.lit(0)), (F.col("_w") - 1, F.col("_h") - 1), (F.lit(0), F.col("_h") - 1))])
    c = t.withColumn("_c", F.explode(corners))
    px, py = g.apply_homography(F.col("h"), F.col("_c.x"), F.col("_c.y"))
    box = c.groupBy("image_id").agg(
        F.floor(F.min(px)).alias("x0"), F.ceil(F.max(px)).alias("x1"), F.floor(F.min(py)).alias("y0"), F.ceil(F.max(py)).alias("y1"), F.first("h").alias("h")
    )
    tiles = box.withColumn("_ty", F.explode(F.sequence(F.floor(F.col("y0") / step), F.floor(F.col("y1") / step))))
    tiles = tiles.withColumn("_tx", F.explode(F.sequence(F.floor(F.col("x0") / step), F.floor(F.col("x1") / step))))
    tiles = spread(tiles, "image_id", "_ty", "_tx")
    span = lambda a, b, t: F.sequence(F.greatest(F.col(a), F.col(t) * step), F.least(F.col(b), F.col(t) * step + step - 1))
    out = tiles.withColumn("py", F.explode(span("y0", "y1", "_ty"))).withColumn("px", F.explode(span("x0", "x1", "_tx")))
    out = out.withColumn("_i", invert3(F.col("h")))
    sx, sy = g.apply_homography(F.col("_i"), F.col("px"), F.col("py"))
    wanted = out.select("image_id", F.col("py").cast("int").alias("py"), F.col("px").cast("int").alias("px"), sy.alias("_sy"), sx.alias("_sx"))
    return gr.sample(pixels.select(*gr.KEY, *columns), columns, wanted, "_sy", "_sx", tile).drop("_sy", "_sx")


def paint_mask(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pixels that may be written: every channel above zero."""
    test = F.lit(True)
    for c in columns:
        test = test & (F.col(c) > 0)
    return df.where(test)


def paint_by_spiral(warped: DataFrame, ranks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Panorama pixels; where images overlap the later cell in spiral order wins."""
    rows = paint_mask(warped, columns).join(lookup(ranks.select("image_id", "spiral_rank")), "image_id")
    return rows.groupBy("py", "px").agg(F.max_by(F.struct(*columns), "spiral_rank").alias("_v")).select("py", "px", *[F.col(f"_v.{c}").alias(c) for c in columns])


def transforms_for_meshes(meshes: DataFrame, transforms: DataFrame, pano_height: float, image_height: float) -> DataFrame:
    """4x4 rigid transform per mesh; identity where the cell has none."""
    rows = meshes.join(transforms, ["row", "col"], "left")
    cos, sin, tx, ty = g.to_rigid_2d(F.col("h"))
    m = g.to_rigid_3d(cos, sin, tx, ty, F.lit(float(pano_height)), F.lit(float(image_height)))
    eye = g.lit_matrix([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])
    return rows.withColumn("m", F.when(F.col("h").isNull(), eye).otherwise(m)).drop("h")
