"""Least-squares depth of masked gradients, on packed tiles with a coarse level.

An image is cut into tiles, one row each, whose planes travel as bytes. Tiles
exchange border strips; beside the work inside tiles there is a plane per
tile (a level and two slopes added to it), whose system, a row a tile, is
solved image by image. Without that level the steps grow with the number of tiles, since a
change would cross one tile a step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gesso.operators import grid as gr
from gesso.session import forget, keep
from gesso.session import spread as dealt

TILE = ["image_id", "ty", "tx"]
LINKS = ("er", "el", "ed", "eu")


def equations(grad: DataFrame, tile: int) -> DataFrame:
    """Per pixel: links er, el, ed, eu (1 where it and that neighbour are valid)
    and the right side b of sum (z - z_neighbour) = b."""
    g = gr.halo(grad.select(*gr.KEY, "p", "q", "valid"), 1, 1, "none", tile)
    ok = F.col("valid")
    both = {}
    for name, shifted in (("er", gr.at_x("valid", 1)), ("el", gr.at_x("valid", -1)), ("ed", gr.at_y("valid", 1)), ("eu", gr.at_y("valid", -1))):
        both[name] = F.when(ok & F.coalesce(shifted, F.lit(False)), 1).otherwise(0)
    g = g.withColumns({**both, "_pl": F.coalesce(gr.at_x("p", -1), F.lit(0.0)), "_qu": F.coalesce(gr.at_y("q", -1), F.lit(0.0))})
    b = F.col("el") * F.col("_pl") - F.col("er") * F.col("p") + F.col("eu") * F.col("_qu") - F.col("ed") * F.col("q")
    return g.where("_core").select(*gr.KEY, "_h", "_w", "valid", *LINKS, F.when(ok, b).otherwise(0.0).alias("b"))


def residuals(grad: DataFrame, depth: DataFrame, tile: int = gr.TILE) -> DataFrame:
    """``residual`` of each valid pixel's equation at ``depth`` (z), straight from the pixels."""
    g = grad.select(*gr.KEY, "p", "q", "valid").join(depth.select(*gr.KEY, "z"), gr.KEY, "left")
    g = gr.halo(g, 1, 1, "none", tile)
    total = F.lit(0.0)
    for at, d, slope, sign in ((gr.at_x, 1, "p", 1), (gr.at_x, -1, "p", -1), (gr.at_y, 1, "q", 1), (gr.at_y, -1, "q", -1)):
        step = F.col(slope) if d > 0 else at(slope, d)
        total = total + F.when(F.coalesce(at("valid", d), F.lit(False)), F.col("z") - at("z", d) + sign * step).otherwise(0.0)
    return g.withColumn("residual", total).where("_core AND valid").select(*gr.KEY, "residual")


def apply(x: np.ndarray, links: np.ndarray, sides: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Sum over links of the pixel less its neighbour; ``sides`` holds the lines next to the plane."""
    er, el, ed, eu = links
    y = (er + el + ed + eu) * x
    y[:, :-1] -= er[:, :-1] * x[:, 1:]
    y[:, 1:] -= el[:, 1:] * x[:, :-1]
    y[:-1] -= ed[:-1] * x[1:]
    y[1:] -= eu[1:] * x[:-1]
    for side, line in (sides or {}).items():
        if side == "right":
            y[:, -1] -= er[:, -1] * line
        elif side == "left":
            y[:, 0] -= el[:, 0] * line
        elif side == "down":
            y[-1] -= ed[-1] * line
        else:
            y[0] -= eu[0] * line
    return y


#: added to the diagonal inside a tile, so that a part cut off from all others has one solution
SHIFT = 1e-10


def descend(times, scale: np.ndarray, rhs: np.ndarray, tolerance: float, limit: int) -> tuple[np.ndarray, float]:
    """Conjugate gradients with a diagonal preconditioner: the solution and its relative residual."""
    x, r = np.zeros_like(rhs), rhs.copy()
    whole = float(np.vdot(rhs, rhs))
    z = scale * r
    p, rz, rr = z.copy(), float(np.vdot(r, z)), whole
    for _ in range(limit):
        if rr <= tolerance**2 * whole or rz <= 0:
            break
        ap = times(p)
        curve = float(np.vdot(p, ap))
        if curve <= 0:
            break
        x += rz / curve * p
        r -= rz / curve * ap
        rr = float(np.vdot(r, r))
        np.multiply(scale, r, out=z)
        new = float(np.vdot(r, z))
        p *= new / rz
        p += z
        rz = new
    return x, (rr / whole) ** 0.5 if whole > 0 else 0.0


def plane_times(links: np.ndarray, on: np.ndarray):
    """The system of a plane on its pixels ``on``, for planes that are 0 elsewhere; each call returns the same buffer."""
    er, el, ed, eu = links * on
    er, el, ed, eu = er[:, :-1].copy(), el[:, 1:].copy(), ed[:-1], eu[1:]
    own = np.where(on, links.sum(axis=0) + SHIFT, 0.0)
    y, across, down = np.empty_like(own), np.empty_like(er), np.empty_like(ed)

    def times(p: np.ndarray) -> np.ndarray:
        np.multiply(own, p, out=y)
        for weight, there, here, held in (
            (er, p[:, 1:], y[:, :-1], across), (el, p[:, :-1], y[:, 1:], across), (ed, p[1:], y[:-1], down), (eu, p[:-1], y[1:], down),
        ):
            np.multiply(weight, there, out=held)
            np.subtract(here, held, out=here)
        return y

    return times


#: numbers that the inverses of a plane's lines may hold, for planes that are solved line by line
LINES = 1 << 20
#: tolerance from which steps are cheaper than lines
LOOSE = 1e-5


def elimination(links: np.ndarray, on: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """What solves one plane's system for a right side by elimination, a line along its shorter side at a time.

    The lines' inverses are made once. A second pass takes out rounding.
    """
    if on.shape[1] > on.shape[0]:
        turned = elimination(links[[2, 3, 0, 1]].transpose(0, 2, 1), on.T)
        return lambda rhs: turned(rhs.T).T
    n, m = on.shape
    own = np.where(on, links.sum(axis=0) + SHIFT, 1.0)
    along = np.where(on[:, :-1] & on[:, 1:], links[0][:, :-1], 0.0)
    down = np.where(on[:-1] & on[1:], links[2][:-1], 0.0)
    inverse, at = np.empty((n, m, m)), np.arange(m)
    for k in range(n):
        line = -(down[k - 1][:, None] * inverse[k - 1] * down[k - 1]) if k else np.zeros((m, m))
        line[at, at] += own[k]
        line[at[:-1], at[1:]] -= along[k]
        line[at[1:], at[:-1]] -= along[k]
        inverse[k] = np.linalg.inv(line)

    def solved(rhs: np.ndarray) -> np.ndarray:
        x = np.zeros((n, m))
        for _ in range(2):
            y = np.where(on, rhs - apply(x, links) - SHIFT * x, 0.0)
            for k in range(1, n):
                y[k] += down[k - 1] * (inverse[k - 1] @ y[k - 1])
            y[-1] = inverse[-1] @ y[-1]
            for k in range(n - 2, -1, -1):
                y[k] = inverse[k] @ (y[k] + down[k] * y[k + 1])
            x += y
        return x

    return solved


def solver(links: np.ndarray, free: np.ndarray | None = None, tolerance: float = 1e-9) -> Callable[[np.ndarray], np.ndarray]:
    """What solves one plane's system on its ``free`` pixels, 0 elsewhere, for a right side; it raises if that isn't
    solved after as many steps as pixels, and some more."""
    degree = links.sum(axis=0)
    on = degree > 0 if free is None else free & (degree > 0)
    times = plane_times(links, on)
    by_lines = elimination(links, on) if tolerance < LOOSE and on.size * min(on.shape) <= LINES else None

    def solved(rhs: np.ndarray) -> np.ndarray:
        if by_lines is not None:
            x, right = by_lines(rhs), np.where(on, rhs, 0.0)
            left = float(np.linalg.norm(right - times(x)) / (np.linalg.norm(right) or 1.0))
        else:
            x, left = descend(times, np.where(on, 1 / np.maximum(degree, 1), 0.0), np.where(on, rhs, 0.0), tolerance, rhs.size + 100)
        if left > max(1e-4, tolerance):
            raise RuntimeError(f"a tile is not solved: relative residual {left:.3g}")
        return x

    return solved


def solve(rhs: np.ndarray, links: np.ndarray, free: np.ndarray | None = None, tolerance: float = 1e-9) -> np.ndarray:
    """One plane's system on its ``free`` pixels, 0 elsewhere (see ``solver``)."""
    return solver(links, free, tolerance)(rhs)


def basis_sums(plane: np.ndarray) -> list[float]:
    """Sums of a tile's plane times 1, the height and the width from its middle: the coarse unknowns."""
    y, x = centred(*plane.shape)
    return [float(plane.sum()), float((plane * y).sum()), float((plane * x).sum())]


def centred(ny: int, nx: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.arange(ny) - (ny - 1) / 2)[:, None], (np.arange(nx) - (nx - 1) / 2)[None, :]


def coarse_plane(c: np.ndarray, links: np.ndarray) -> np.ndarray:
    """A tile's level and slopes on its linked pixels."""
    y, x = centred(*links.shape[1:])
    return (c[0] + c[1] * y + c[2] * x) * (links.sum(axis=0) > 0)


def _moments(mask: np.ndarray) -> list[float]:
    at = np.arange(len(mask)) - (len(mask) - 1) / 2
    return [float(mask.sum()), float((mask * at).sum()), float((mask * at * at).sum())]


def coarse_solve(pdf: pd.DataFrame, rho: np.ndarray) -> np.ndarray:
    """A plane (level and two slopes) per tile for the sums ``rho``, a row a tile.

    ``right`` and ``down`` have the moments of the links across those borders,
    ``inner`` the tile's own vertical and horizontal links. The sums of a
    connected part of the tiles cancel but for rounding, which is taken out.
    """
    n = len(pdf)
    ty, tx, ny, nx = (pdf[c].to_numpy().astype(int) for c in ("ty", "tx", "ny", "nx"))
    at = {key: i for i, key in enumerate(zip(ty.tolist(), tx.tolist(), strict=True))}
    inner = np.array(pdf["inner"].tolist())
    borders = []
    for column, dy, dx, size in (("right", 0, 1, nx), ("down", 1, 0, ny)):
        moments = np.array(pdf[column].tolist())
        u = np.flatnonzero(moments[:, 0])
        v = np.array([at[ty[k] + dy, tx[k] + dx] for k in u], int)
        # along the border the slope over it, across it the tiles' half widths
        borders.append((u, v, moments[u].T, *((1, 2) if dx else (2, 1)), (size[u] - 1) / 2, -(size[v] - 1) / 2))
    part = np.arange(n)
    while True:
        low = part.copy()
        for u, v, *_ in borders:
            np.minimum.at(low, u, part[v])
            np.minimum.at(low, v, part[u])
        low = np.minimum(low, low[low])
        if (low == part).all():
            break
        part = low
    rhs = rho.astype(float).copy()
    rhs[:, 0] -= (np.bincount(part, rhs[:, 0], n) / np.maximum(np.bincount(part, minlength=n), 1))[part]
    degree = np.concatenate([np.zeros((n, 1)), inner], axis=1)

    def spread(out: np.ndarray, where: np.ndarray, sign: int, along: int, across: int, g0: np.ndarray, g1: np.ndarray, edge: np.ndarray) -> None:
        np.add.at(out, (where, 0), sign * g0)
        np.add.at(out, (where, along), sign * g1)
        np.add.at(out, (where, across), sign * edge * g0)

    def times(c: np.ndarray) -> np.ndarray:
        out = c * np.concatenate([np.zeros((n, 1)), inner], axis=1)
        for u, v, (s0, s1, s2), along, across, eu, ev in borders:
            level = c[u, 0] + eu * c[u, across] - c[v, 0] - ev * c[v, across]
            slope = c[u, along] - c[v, along]
            g0, g1 = s0 * level + s1 * slope, s1 * level + s2 * slope
            spread(out, u, 1, along, across, g0, g1, eu)
            spread(out, v, -1, along, across, g0, g1, ev)
        return out

    for u, v, (s0, _, s2), along, across, eu, ev in borders:
        for where, edge in ((u, eu), (v, ev)):
            np.add.at(degree, (where, 0), s0)
            np.add.at(degree, (where, along), s2)
            np.add.at(degree, (where, across), edge * edge * s0)
    return descend(times, np.where(degree > 0, 1 / np.where(degree > 0, degree, 1), 0.0), np.where(degree > 0, rhs, 0.0), 1e-9, 12 * n + 50)[0]


def _raw(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, np.float64).tobytes()


def _plane(raw: bytes, ny: int, nx: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(ny, nx).copy()


def _link_planes(raw: bytes, ny: int, nx: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, ny, nx).astype(np.float64)


def packed(grad: DataFrame, tile: int, overlap: int = 0) -> DataFrame:
    """A row a tile: its place, core size, the margins around it, and links and right side of core and margins.

    ``right`` and ``down`` have the moments of the links over those borders,
    ``inner`` counts the tile's own, ``tiles`` the tiles that the image is cut into;
    ``valid`` is the core's mask.
    """
    kind = grad.schema["image_id"].dataType.simpleString()
    size = gr.tile_for(tile, overlap)
    eq = equations(grad, max(size, gr.TILE)).withColumns({"_t": F.lit(size)})
    near = gr.halo(eq, overlap, overlap, "none", size)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx, h, w = (int(pdf[c].iloc[0]) for c in ("_ty", "_tx", "_h", "_w"))
        y0, x0 = max(ty * size - overlap, 0), max(tx * size - overlap, 0)
        y1, x1 = min((ty + 1) * size + overlap, h), min((tx + 1) * size + overlap, w)
        planes = np.zeros((6, y1 - y0, x1 - x0))
        iy, ix = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        for i, c in enumerate((*LINKS, "b")):
            planes[i, iy, ix] = pdf[c].to_numpy()
        planes[5, iy, ix] = pdf["valid"].eq(True).to_numpy()
        top, left = ty * size - y0, tx * size - x0
        ny, nx = min(size, h - ty * size), min(size, w - tx * size)
        core = planes[:, top : top + ny, left : left + nx]
        row = [pdf["image_id"].iloc[0], -(-h // size) * -(-w // size), ty, tx, ny, nx, top, left, y1 - y0, x1 - x0, planes[:4].astype(np.uint8).tobytes(), _raw(planes[4])]
        own = [float(core[2][:-1].sum()), float(core[0][:, :-1].sum())]
        row += [_moments(core[0][:, -1]), _moments(core[2][-1]), own, basis_sums(core[4]), float((core[4] ** 2).sum()), (core[5] > 0).tobytes()]
        return pd.DataFrame([row], columns=_PACKED)

    schema = f"image_id {kind}, tiles long, ty int, tx int, ny int, nx int, top int, left int, h int, w int, links binary, b binary, right array<double>, down array<double>, inner array<double>, b_sums array<double>, bb double, valid binary"
    return keep(dealt(near, "image_id", "_ty", "_tx").groupBy("image_id", "_ty", "_tx").applyInPandas(pack, schema), "packed")


_PACKED = ["image_id", "tiles", "ty", "tx", "ny", "nx", "top", "left", "h", "w", "links", "b", "right", "down", "inner", "b_sums", "bb", "valid"]


def unpacked(state: DataFrame, tile: int, masks: DataFrame) -> DataFrame:
    """Depth of the valid pixels from packed ``x``, by the tiles' masks ``valid``; the minimum of each image is 0."""
    kind = state.schema["image_id"].dataType.simpleString()

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = [np.frombuffer(x)[np.frombuffer(on, bool)] for x, on in zip(pdf["x"], pdf["valid"], strict=True)]
            yield pd.DataFrame({"image_id": pdf["image_id"], "_lo": [float(np.fmin.reduce(v)) if len(v) else None for v in seen]}).dropna(subset="_lo")

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                y, x = np.nonzero(np.frombuffer(row.valid, bool).reshape(row.ny, row.nx))
                z = np.frombuffer(row.x).reshape(row.ny, row.nx)[y, x] - row.low
                yield pd.DataFrame({"image_id": row.image_id, "y": y + row.ty * tile, "x": x + row.tx * tile, "z": z})

    ends = state.select(*TILE, "ny", "nx", "x").join(masks, TILE)
    low = ends.select("image_id", "x", "valid").mapInPandas(lowest, f"image_id {kind}, _lo double").groupBy("image_id").agg(F.min("_lo").alias("low"))
    return gr.attach(dealt(ends, *TILE), low, ["image_id"]).mapInPandas(unfold, f"image_id {kind}, y int, x int, z double")


# -- conjugate gradients ------------------------------------------------------------------

_CG = "image_id {k}, ty int, tx int, ny int, nx int, links binary, x binary, r binary, p binary, s binary, z binary, w binary, right array<double>, down array<double>, inner array<double>, alpha double, gamma double, rz double, wz double, rr double, rr0 double, rho array<double>, sigma array<double>, omega array<double>"


def conjugate_gradients(grad: DataFrame, tile: int = 256, tolerance: float = 1e-5, max_steps: int = 2000) -> tuple[DataFrame, int, float]:
    """Depth of gradients ``p, q, valid`` (least squares over links between valid neighbours), steps and relative residual.

    The preconditioner adds each tile's own solution and the coarse planes.
    Step lengths are an image's own, and an image that is done leaves the
    loop. Both dot products of a step come from one pass, so a step is one
    shuffle of tiles with their neighbours' border lines, one written table
    and one small job on a row a tile. Images of up to ``AT_ONCE`` tiles take
    the same steps inside one task. Raises if the residual isn't down to
    ``tolerance`` after ``max_steps``, or the curvature isn't positive.
    """
    kind = grad.schema["image_id"].dataType.simpleString()
    schema = _CG.format(k=kind)
    names = [f.split()[0] for f in schema.split(", ")]
    every = packed(grad, tile)
    size = gr.tile_for(tile, 0)
    masks = keep(every.select(*TILE, "valid"), "valid")
    finished: list[DataFrame] = []
    steps, worst = 0, 0.0
    few = every.where(F.col("tiles") <= AT_ONCE)
    ended = keep(dealt(few, "image_id").groupBy("image_id").applyInPandas(_steps_at_once(tolerance, max_steps), f"image_id {kind}, ty int, tx int, ny int, nx int, x binary, steps long, ratio double, done boolean"), "finished")
    seen = ended.agg(F.max("steps"), F.max("ratio"), F.max(F.when(~F.col("done"), F.col("ratio")))).first()
    if seen[2] is not None:
        raise RuntimeError(f"residual {seen[2]:.3g} after {max_steps} steps")
    if seen[0] is not None:
        finished.append(ended.select(*TILE, "ny", "nx", "x"))
        most, worst = seen[0], seen[1]
    else:
        most = 0
    tiles = every.where(F.col("tiles") > AT_ONCE)
    if tiles.isEmpty():
        forget(every)
        return unpacked(finished[0] if finished else ended.select(*TILE, "ny", "nx", "x"), size, masks), most, worst

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            none = [bytes(8 * n * m) for n, m in zip(pdf["ny"], pdf["nx"], strict=True)]
            yield pd.DataFrame({
                **{c: pdf[c] for c in ("image_id", "ty", "tx", "ny", "nx", "links", "right", "down", "inner")}, "r": pdf["b"], **{c: none for c in "xpszw"},
                "alpha": 0.0, "gamma": 0.0, "rz": 0.0, "wz": 0.0, "rr": pdf["bb"], "rr0": 0.0, "rho": pdf["b_sums"], "sigma": [[0.0] * 3] * len(pdf), "omega": [[0.0] * 3] * len(pdf),
            })[names]

    state = tiles.mapInPandas(begin, schema)
    scalars = "image_id {k}, ty int, tx int, alpha_new double, beta double, c array<double>, gamma_new double, start double, done boolean, ratio double".format(k=kind)

    def advance(first: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rr, start = float(pdf["rr"].sum()), float(pdf["rr0"].iloc[0])
            start = rr if first else start
            gamma, delta = float(pdf["rz"].sum()), float(pdf["wz"].sum())
            done = rr <= tolerance**2 * start
            alpha = beta = 0.0
            if not first and not done:
                alpha, beta = _lengths(gamma, delta, float(pdf["gamma"].iloc[0]), float(pdf["alpha"].iloc[0]), (rr / start) ** 0.5)
            rho, omega, sigma = (np.array(pdf[k].tolist()) for k in ("rho", "omega", "sigma"))
            c = np.zeros((len(pdf), 3)) if done else coarse_solve(pdf, rho - alpha * (omega + beta * sigma))
            out = pdf[TILE].copy()
            for k, v in (("alpha_new", alpha), ("beta", beta), ("c", c.tolist()), ("gamma_new", gamma), ("start", start), ("done", done), ("ratio", (rr / start) ** 0.5 if start > 0 else 0.0)):
                out[k] = v
            return out

        return run

    strips = f"{schema}, side string, strip binary"

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The step, the preconditioner, and the border lines of ``z`` as rows for the neighbours."""
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                x, r, p, s, z, w = (_plane(getattr(t, k), t.ny, t.nx) for k in "xrpszw")
                links = _link_planes(t.links, t.ny, t.nx)
                p, s = z + t.beta * p, w + t.beta * s
                x, r = x + t.alpha_new * p, r - t.alpha_new * s
                quiet = float((r * r).sum()) <= 1e-26 * t.start  # rounding is all that is left in this tile
                z = (np.zeros_like(r) if quiet else solve(r, links)) + coarse_plane(t.c, links)
                base = {k: None for k in names}
                own = {**t._asdict(), "alpha": t.alpha_new, "gamma": t.gamma_new, "rr0": t.start, **{k: _raw(v) for k, v in zip("xrpsz", (x, r, p, s, z), strict=True)}}
                rows.append({**base, **{k: own[k] for k in names}, "side": "", "strip": None})
                for dy, dx, side, line in ((0, -1, "right", z[:, 0]), (0, 1, "left", z[:, -1]), (-1, 0, "down", z[0]), (1, 0, "up", z[-1])):
                    if {"right": links[1][:, 0], "left": links[0][:, -1], "down": links[3][0], "up": links[2][-1]}[side].any():
                        rows.append({**base, "image_id": t.image_id, "ty": t.ty + dy, "tx": t.tx + dx, "side": side, "strip": _raw(line)})
            yield _typed(rows, [*names, "side", "strip"])

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["side"] == ""].iloc[0]
        near = {s: np.frombuffer(v) for s, v in zip(pdf["side"], pdf["strip"], strict=True) if s}
        ny, nx = int(own["ny"]), int(own["nx"])
        r, s, z = (_plane(own[k], ny, nx) for k in "rsz")
        w = apply(z, _link_planes(own["links"], ny, nx), near)
        out = own[names].to_dict() | {"w": _raw(w), "rz": float((r * z).sum()), "wz": float((w * z).sum()), "rr": float((r * r).sum()), "rho": basis_sums(r), "sigma": basis_sums(s), "omega": basis_sums(w)}
        return _typed([out], names)

    small = ["image_id", "ty", "tx", "ny", "nx", "right", "down", "inner", "alpha", "gamma", "rz", "wz", "rr", "rr0", "rho", "sigma", "omega"]
    state = keep(state, "state")
    forget(every)
    while True:
        plan = keep(state.select(*small).groupBy("image_id").applyInPandas(advance(steps == 0), scalars), "step")
        seen = plan.agg(F.sum((~F.col("done")).cast("long")), F.max("ratio"), F.max(F.when(F.col("done"), F.col("ratio"))), F.sum(F.col("done").cast("long"))).first()
        worst = max(worst, (seen[2] or 0.0) if steps else 0.0)
        if seen[3]:
            finished.append(keep(state.join(plan.where("done").select(*TILE), TILE, "left_semi").select(*TILE, "ny", "nx", "x"), "finished"))
        if not seen[0]:
            break
        if steps > max_steps:
            raise RuntimeError(f"residual {seen[1]:.3g} after {max_steps} steps")
        moved = state.join(plan.where("NOT done"), TILE).mapInPandas(update, strips)
        new = keep(dealt(moved, *TILE).groupBy(*TILE).applyInPandas(multiply, schema), "state")
        forget(plan)
        forget(state)
        state = new
        steps += 1
    if not finished:
        finished = [state.select(*TILE, "ny", "nx", "x")]
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return unpacked(out, size, masks), max(steps - 1, most), worst


def _lengths(gamma: float, delta: float, before: float, step: float, left: float) -> tuple[float, float]:
    """Length of the next step and share of the last direction in it."""
    beta = gamma / before if before > 0 else 0.0
    curve = delta - (beta * gamma / step if step > 0 else 0.0)
    if curve <= 0.1 * delta:  # cancelled: begin anew along z
        beta, curve = 0.0, delta
    if not (curve > 0 and gamma > 0):
        raise RuntimeError(f"no positive curvature, residual {left:.3g}")
    return gamma / curve, beta


#: tiles of an image up to which a task takes all its steps
AT_ONCE = 4


def _steps_at_once(tolerance: float, max_steps: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The steps of ``conjugate_gradients`` on one image's packed tiles; each tile's solver is made once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ty", "tx"], ignore_index=True)
        places = list(zip(pdf["ty"].tolist(), pdf["tx"].tolist(), strict=True))
        sizes = list(zip(pdf["ny"].tolist(), pdf["nx"].tolist(), strict=True))
        links = [_link_planes(raw, *n) for raw, n in zip(pdf["links"], sizes, strict=True)]
        r = [_plane(raw, *n) for raw, n in zip(pdf["b"], sizes, strict=True)]
        x, p, s, z, w = ([np.zeros(n) for n in sizes] for _ in range(5))
        parts: list[Callable | None] = [None] * len(r)
        rho, omega, sigma = np.array(pdf["b_sums"].tolist()), np.zeros((len(r), 3)), np.zeros((len(r), 3))
        rr = start = float(pdf["bb"].sum())
        gamma = delta = before = alpha = beta = 0.0
        taken = 0
        while not (done := rr <= tolerance**2 * start) and taken <= max_steps:
            if taken:
                alpha, beta = _lengths(gamma, delta, before, alpha, (rr / start) ** 0.5)
            c = coarse_solve(pdf, rho - alpha * (omega + beta * sigma))
            before = gamma
            for i, link in enumerate(links):
                p[i], s[i] = z[i] + beta * p[i], w[i] + beta * s[i]
                x[i], r[i] = x[i] + alpha * p[i], r[i] - alpha * s[i]
                quiet = float((r[i] * r[i]).sum()) <= 1e-26 * start  # rounding is all that is left in this tile
                if not quiet and parts[i] is None:
                    parts[i] = solver(link)
                z[i] = (np.zeros(sizes[i]) if quiet else parts[i](r[i])) + coarse_plane(c[i], link)
            at = dict(zip(places, z, strict=True))
            for i, (ty, tx) in enumerate(places):
                near = {"right": (ty, tx + 1), "left": (ty, tx - 1), "down": (ty + 1, tx), "up": (ty - 1, tx)}
                lines = {"right": np.s_[:, 0], "left": np.s_[:, -1], "down": np.s_[0], "up": np.s_[-1]}
                w[i] = apply(z[i], links[i], {side: at[place][lines[side]] for side, place in near.items() if place in at})
            gamma, delta, rr = (sum(float((a * b).sum()) for a, b in zip(u, v, strict=True)) for u, v in ((r, z), (w, z), (r, r)))
            rho, omega, sigma = (np.array([basis_sums(v) for v in planes]) for planes in (r, w, s))
            taken += 1
        ratio = (rr / start) ** 0.5 if start > 0 else 0.0
        return pdf[[*TILE, "ny", "nx"]].assign(x=[_raw(v) for v in x], steps=max(taken - 1, 0), ratio=ratio, done=done)

    return run


def _typed(rows: list[dict], names: list[str]) -> pd.DataFrame:
    """Rows with missing numbers as nullable columns."""
    out = pd.DataFrame({c: pd.Series([row.get(c) for row in rows], dtype=None if rows else object) for c in names})
    for c in ("ny", "nx"):
        if c in names:
            out[c] = out[c].astype("Int64")
    return out


# -- overlapping tiles --------------------------------------------------------------------


def schwarz_sweeps(grad: DataFrame, tile: int = 4096, overlap: int = 256, tolerance: float = 1e-5, max_sweeps: int = 500, relax: float = 1.0) -> tuple[DataFrame, int, float]:
    """The same depth by sweeps over overlapping tiles, sweeps and relative residual.

    In a sweep each tile takes its plane from the coarse level and its
    margin from its neighbours, solves core and margin with the outermost
    line held, and keeps the core. All tiles use the values of the sweep
    before, so the result doesn't depend on an order. Sweeps go on until the
    residual of all images is down to ``tolerance``; beyond ``max_sweeps``
    that is an error.
    """
    kind = grad.schema["image_id"].dataType.simpleString()
    size = gr.tile_for(tile, overlap)
    margin = max(overlap, 1)
    tiles = packed(grad, tile, margin)
    schema = f"image_id {kind}, ty int, tx int, ny int, nx int, top int, left int, h int, w int, links binary, b binary, x binary, north binary, south binary, west binary, east binary, right array<double>, down array<double>, inner array<double>, b_sums array<double>, own array<double>, bb double, rr double"
    names = [f.split()[0] for f in schema.split(", ")]

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = list(zip(pdf["ny"], pdf["nx"], strict=True))
            across, along = [bytes(8 * m) for _, m in sizes], [bytes(8 * n) for n, _ in sizes]
            yield pdf.assign(x=[bytes(8 * n * m) for n, m in sizes], north=across, south=across, west=along, east=along, own=[[0.0] * 3] * len(pdf), rr=pdf["bb"])[names]

    def flows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Border lines by the border they lie at, each from both sides."""
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                links = np.frombuffer(t.links, np.uint8).reshape(4, t.h, t.w)[:, t.top : t.top + t.ny, t.left : t.left + t.nx]
                for axis, line, edge, mask, here in (
                    ("x", t.east, (t.ty, t.tx), links[0][:, -1], True), ("x", t.west, (t.ty, t.tx - 1), links[1][:, 0], False),
                    ("y", t.south, (t.ty, t.tx), links[2][-1], True), ("y", t.north, (t.ty - 1, t.tx), links[3][0], False),
                ):
                    if mask.any():
                        rows.append((t.image_id, axis, *edge, here, t.ty, t.tx, ((t.nx if axis == "x" else t.ny) - 1) / (2.0 if here else -2.0), line, mask.tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "axis", "ey", "ex", "here", "ty", "tx", "half", "line", "mask"])

    @F.pandas_udf("array<double>")
    def flow(a: pd.Series, b: pd.Series, mask: pd.Series) -> pd.Series:
        out = []
        for u, v, m in zip(a, b, mask, strict=True):
            f = (np.frombuffer(u) - np.frombuffer(v)) * np.frombuffer(m, np.uint8)
            out.append([float(f.sum()), float((f * (np.arange(len(f)) - (len(f) - 1) / 2)).sum())])
        return pd.Series(out)

    def constants(pdf: pd.DataFrame) -> pd.DataFrame:
        rho = np.stack([np.array([x[k] for x in pdf["b_sums"]]) - pdf[f"f{k}"].to_numpy() - np.array([x[k] for x in pdf["own"]]) for k in range(3)], axis=1)
        return pdf[TILE].assign(c=coarse_solve(pdf, rho).tolist())

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each tile with its coarse plane added, and what its eight neighbours need of it."""
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                links = np.frombuffer(t.links, np.uint8).reshape(4, t.h, t.w)[:, t.top : t.top + t.ny, t.left : t.left + t.nx]
                x = _plane(t.x, t.ny, t.nx) + coarse_plane(t.c, links)
                rows.append({**{k: getattr(t, k) for k in names}, "x": _raw(x), "sy": 0, "sx": 0, "part": None, "part_ny": None})
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if (dy or dx) and not (dy < 0 and t.top == 0) and not (dx < 0 and t.left == 0):
                            part = x[slice(0, margin) if dy < 0 else slice(-margin, None) if dy > 0 else slice(None), slice(0, margin) if dx < 0 else slice(-margin, None) if dx > 0 else slice(None)]
                            rows.append({"image_id": t.image_id, "ty": t.ty + dy, "tx": t.tx + dx, "sy": -dy, "sx": -dx, "part": _raw(part), "part_ny": part.shape[0]})
            out = _typed(rows, [*names, "sy", "sx", "part", "part_ny"])
            for c in ("top", "left", "h", "w", "part_ny"):
                out[c] = out[c].astype("Int64")
            yield out

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = (pdf["sy"] == 0) & (pdf["sx"] == 0)
        if not mine.any():
            return pd.DataFrame(columns=names)  # a neighbour beyond the image
        own = pdf[mine].iloc[0]
        ny, nx, top, left, h, w = (int(own[k]) for k in ("ny", "nx", "top", "left", "h", "w"))
        links, b = _link_planes(own["links"], h, w), _plane(own["b"], h, w)
        x = np.zeros((h, w))
        x[top : top + ny, left : left + nx] = _plane(own["x"], ny, nx)
        for _, e in pdf[~mine].iterrows():
            part = np.frombuffer(e["part"]).reshape(int(e["part_ny"]), -1)
            ys = slice(top - part.shape[0], top) if e["sy"] < 0 else slice(top + ny, top + ny + part.shape[0]) if e["sy"] > 0 else slice(top, top + ny)
            xs = slice(left - part.shape[1], left) if e["sx"] < 0 else slice(left + nx, left + nx + part.shape[1]) if e["sx"] > 0 else slice(left, left + nx)
            x[ys, xs] = part
        held = np.zeros((h, w), bool)
        held[: 1 if top else 0] = True
        held[h - 1 if top + ny < h else h :] = True
        held[:, : 1 if left else 0] = True
        held[:, w - 1 if left + nx < w else w :] = True
        inside = (slice(top, top + ny), slice(left, left + nx))
        r = b - apply(x, links)
        rr = float((r[inside] ** 2).sum())
        quiet = float((r * r).sum()) <= 1e-26 * float(own["bb"])
        new = (x if quiet else x + relax * solve(r, links, ~held, tolerance=1e-4))[inside]
        # links inside the tile only: what crosses its borders is added from both sides' lines
        own_links = links[(slice(None), *inside)].copy()
        own_links[0][:, -1] = own_links[1][:, 0] = own_links[2][-1] = own_links[3][0] = 0
        out = own[names].to_dict() | {"x": _raw(new), "north": _raw(new[0]), "south": _raw(new[-1]), "west": _raw(new[:, 0]), "east": _raw(new[:, -1]), "own": basis_sums(apply(new, own_links)), "rr": rr}
        return pd.DataFrame([out], columns=names).astype({k: int for k in ("ny", "nx", "top", "left", "h", "w")})

    state = keep(tiles.mapInPandas(begin, schema), "state")
    masks = keep(tiles.select(*TILE, "valid"), "valid")
    forget(tiles)
    edges = f"image_id {kind}, axis string, ey int, ex int, here boolean, ty int, tx int, half double, line binary, mask binary"
    for sweeps in range(max_sweeps + 1):
        meet = state.select(*TILE, "ny", "nx", "top", "left", "h", "w", "links", "north", "south", "west", "east").mapInPandas(flows, edges)
        border = meet.groupBy("image_id", "axis", "ey", "ex").agg(
            *[F.max(F.when(F.col("here") == on, F.col(c))).alias(f"{c}{k}") for k, on in ((0, True), (1, False)) for c in ("line", "mask", "ty", "tx", "half")]
        )
        met = border.withColumn("f", flow("line0", "line1", "mask0"))
        ends = []
        for k, sign in ((0, 1.0), (1, -1.0)):
            level, slope, across = F.col("f")[0] * sign, F.col("f")[1] * sign, F.col("f")[0] * sign * F.col(f"half{k}")
            wide = F.col("axis") == "x"
            ends.append(F.struct(F.col(f"ty{k}").alias("ty"), F.col(f"tx{k}").alias("tx"), level.alias("f0"), F.when(wide, slope).otherwise(across).alias("f1"), F.when(wide, across).otherwise(slope).alias("f2")))
        flux = met.select("image_id", F.explode(F.array(*ends)).alias("e")).select("image_id", "e.*").groupBy(*TILE).agg(*[F.sum(f"f{k}").alias(f"f{k}") for k in range(3)])
        sums = state.select(*TILE, "ny", "nx", "right", "down", "inner", "b_sums", "own").join(flux, TILE, "left").na.fill(0.0, ["f0", "f1", "f2"])
        c = keep(sums.groupBy("image_id").applyInPandas(constants, f"image_id {kind}, ty int, tx int, c array<double>"), "constants")
        moved = state.join(c, TILE).mapInPandas(spread, f"{schema}, sy int, sx int, part binary, part_ny int")
        new = keep(dealt(moved, *TILE).groupBy(*TILE).applyInPandas(sweep, schema), "state")
        forget(state)
        forget(c)
        state = new
        left_over = state.groupBy("image_id").agg(F.sum("rr").alias("rr"), F.sum("bb").alias("bb"))
        worst = left_over.agg(F.max(F.sqrt(F.try_divide("rr", "bb")))).first()[0] or 0.0
        if worst <= tolerance:
            return unpacked(state, size, masks), sweeps, worst
    raise RuntimeError(f"residual {worst:.3g} after {max_sweeps} sweeps")
