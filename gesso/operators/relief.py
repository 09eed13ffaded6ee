"""Photometric stereo, light calibration and surface clean-up."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gesso.functions import color
from gesso.functions import geometry as g
from gesso.operators import grid as gr
from gesso.operators.quality import normalise_minmax
from gesso.operators.scans import attach, exact_quantiles, least_squares, linear_value
from gesso.session import cut, fence, lookup

AXES = ("lx", "ly", "lz")
PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
#: intensity above which an observation counts as lit
LIT = 0.05


def lit_mask(df: DataFrame, threshold: float = 0.05, value: str = "intensity") -> DataFrame:
    return df.withColumn("lit", F.col(value) > threshold)


def enabled_lights(lights: DataFrame) -> DataFrame:
    return lights.where("enabled")


# Fixed value: old column position for each new one in the alternative wiring.
WIRING = (3, 0, 1, 2, 7, 4, 5, 6)


def reorder_lights(df: DataFrame, light: str = "light_id", order: Sequence[int] = WIRING) -> DataFrame:
    """Renumber lights (from 1): the new light i is the old ``order[i]``."""
    new_of_old = {old + 1: new + 1 for new, old in enumerate(order)}
    table = F.create_map(*[F.lit(v) for pair in new_of_old.items() for v in pair])
    return df.withColumn(light, F.coalesce(table[F.col(light)], F.col(light)))


def with_lights(obs: DataFrame, lights: DataFrame) -> DataFrame:
    """Observations with their light direction. Light tables have one row per
    lamp of the stand; the broadcast is behind a row count all the same."""
    return obs.join(lookup(lights), "light_id")


def _sums(w: Column | None = None) -> list[Column]:
    weight = F.lit(1.0) if w is None else w
    out = [F.sum(weight * F.col(AXES[i]) * F.col(AXES[j])).alias(f"a{i}{j}") for i, j in PAIRS]
    out += [F.sum(weight * F.col(AXES[i]) * F.col("intensity")).alias(f"r{i}") for i in range(3)]
    return out


def _solve(df: DataFrame, relative: float | None = None) -> DataFrame:
    """Adds b0, b1, b2 from the sums a.. and r..; singular systems
    get the minimum-norm solution.

    A rank-2 symmetric matrix becomes invertible by adding u u', u being its
    unit null vector, without changing the minimum-norm solution. One of rank
    1 is its trace times a projection. A system counts as regular by its
    determinant, or with ``relative`` by its smallest against its largest
    eigenvalue (strongly weighted sums are nearly singular by nature).
    """
    a = lambda i, j: F.col(f"a{min(i, j)}{max(i, j)}")
    rows = tuple(tuple(a(i, j) for j in range(3)) for i in range(3))
    trace = F.col("a00") + F.col("a11") + F.col("a22")
    df = df.withColumns({"_det": g.det3(*rows), "_tr": trace})
    pairs = [g.cross(rows[0], rows[1]), g.cross(rows[0], rows[2]), g.cross(rows[1], rows[2])]
    df = df.withColumns({f"_c{k}{i}": c for k, v in enumerate(pairs) for i, c in enumerate(v)})
    size = {k: F.col(f"_c{k}0") ** 2 + F.col(f"_c{k}1") ** 2 + F.col(f"_c{k}2") ** 2 for k in range(3)}
    df = df.withColumns({f"_s{k}": v for k, v in size.items()})
    best = F.when((F.col("_s0") >= F.col("_s1")) & (F.col("_s0") >= F.col("_s2")), 0).when(F.col("_s1") >= F.col("_s2"), 1).otherwise(2)
    pick = lambda i: F.when(best == 0, F.col(f"_c0{i}")).when(best == 1, F.col(f"_c1{i}")).otherwise(F.col(f"_c2{i}"))
    df = df.withColumns({**{f"_u{i}": pick(i) for i in range(3)}, "_sb": F.greatest("_s0", "_s1", "_s2")})
    ratio = F.abs(F.col("_det")) > F.lit(relative or 0.0) * F.sqrt("_sb") * F.col("_tr")
    full = ratio if relative else F.abs(F.col("_det")) > 1e-6
    rank2 = F.sqrt("_sb") > 1e-9 * F.col("_tr") * F.col("_tr")
    lift = F.when(full | ~rank2, 0.0).otherwise(F.try_divide(F.lit(1.0), F.col("_sb")))
    df = df.withColumns({f"_m{i}{j}": F.col(f"a{i}{j}") + lift * F.col(f"_u{i}") * F.col(f"_u{j}") for i, j in PAIRS})
    m = lambda i, j: F.col(f"_m{min(i, j)}{max(i, j)}")
    det, nums = g.solve3(tuple(tuple(m(i, j) for j in range(3)) for i in range(3)), tuple(F.col(f"r{i}") for i in range(3)))
    df = df.withColumns({"_d": det, **{f"_n{i}": v for i, v in enumerate(nums)}})
    solved = {
        f"b{i}": F.when(full | rank2, F.try_divide(F.col(f"_n{i}"), F.col("_d"))).otherwise(F.try_divide(F.col(f"r{i}"), F.col("_tr")))
        for i in range(3)
    }
    helpers = ["_det", "_tr", "_sb", "_d", *[f"_c{k}{i}" for k in range(3) for i in range(3)]]
    helpers += [f"_s{k}" for k in range(3)] + [f"_u{i}" for i in range(3)] + [f"_n{i}" for i in range(3)] + [f"_m{i}{j}" for i, j in PAIRS]
    return fence(df.withColumns(solved).withColumn("full_rank", full).drop(*helpers), "b0", "b1", "b2")


def photometric_stereo(obs: DataFrame, lights: DataFrame, keys: Sequence[str], threshold: float = LIT, min_lights: int = 3) -> DataFrame:
    """Least-squares albedo and unit normal per pixel, in one aggregate.

    Lit observations only; a pixel needs ``min_lights`` distinct lights, and
    repeated observations of a light count as one light. Observations are
    dealt once by pixel; both aggregates, by light and by pixel, use that. Also
    gives the root-mean-square intensity error of the fit.
    """
    lit = obs.where(F.col("intensity") > threshold).select(*keys, "light_id", "intensity").repartition(*keys)
    i = F.col("intensity")
    per_light = lit.groupBy(*keys, "light_id").agg(F.count(F.lit(1)).alias("n"), F.sum(i).alias("s"), F.sum(i * i).alias("ii"))
    axis = [F.col(a) for a in AXES]
    sums = (
        with_lights(per_light, lights)
        .groupBy(*keys)
        .agg(
            *[F.sum(F.col("n") * axis[j] * axis[k]).alias(f"a{j}{k}") for j, k in PAIRS], *[F.sum(axis[j] * F.col("s")).alias(f"r{j}") for j in range(3)],
            F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("n_lights"), F.sum("ii").alias("ii"),
        )
        .where(F.col("n_lights") >= min_lights)
        .withColumn("n_lights", F.col("n_lights").cast("int"))
    )
    out = _solve(sums)
    b = tuple(F.col(f"b{i}") for i in range(3))
    fit = sum((b[i] * F.col(f"r{i}") for i in range(3)), F.lit(0.0))
    out = out.withColumns({"rho": g.norm(b), "error": F.sqrt(F.greatest(F.col("ii") - fit, F.lit(0.0)) / F.col("n_obs"))})
    out = out.withColumns({k: F.when(F.col("rho") > 1e-8, b[i] / F.col("rho")) for i, k in enumerate(("nx", "ny", "nz"))})
    return out.select(*keys, "n_obs", "n_lights", "full_rank", F.greatest("rho", F.lit(1e-8)).alias("rho"), "nx", "ny", "nz", "error")


def photometric_stereo_pinv(obs: DataFrame, lights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All lights through one shared pseudo-inverse; albedo clipped to [0,1].

    The inverse of the 3 x 3 sums of light directions is all that reaches the
    driver, so there may be any number of lamps. A missing observation counts
    as dark.
    """
    total = lights.agg(*[F.coalesce(F.sum(F.col(AXES[i]) * F.col(AXES[j])), F.lit(0.0)).alias(f"a{i}{j}") for i, j in PAIRS]).first()
    inverse = np.linalg.pinv(np.array([[total[f"a{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]), hermitian=True)
    weights = lights.select("light_id", *[sum((float(inverse[i, j]) * F.col(AXES[j]) for j in range(3)), F.lit(0.0)).alias(f"p{i}") for i in range(3)])
    b = obs.join(lookup(weights), "light_id").groupBy(*keys).agg(
        *[F.sum(F.col(f"p{i}") * F.col("intensity")).alias(f"b{i}") for i in range(3)]
    )
    length = F.greatest(F.lit(0.0), F.least(F.lit(1.0), g.norm(tuple(F.col(f"b{i}") for i in range(3)))))
    b = b.withColumn("rho", F.when(length == 0, 1.0).otherwise(length))
    nz = F.col("b2") / F.col("rho")
    return b.select(*keys, "rho", (F.col("b0") / F.col("rho")).alias("nx"), (F.col("b1") / F.col("rho")).alias("ny"),
                    F.when(nz == 0, 1.0).otherwise(nz).alias("nz"))


def robust_normals(obs: DataFrame, lights: DataFrame, keys: Sequence[str], rounds: int = 3) -> DataFrame:
    """Iteratively reweighted fit, weights 1 / (|residual| + 1e-6).

    Both sides of each equation are multiplied by the weight, hence weight
    squared in the sums. Scaling all weights of a pixel does not change its
    solution, so they are not normalised. Each round joins the pixel's
    solution back to the observations, whose shuffle is the same every time.
    """
    rows = with_lights(obs, lights).select(*keys, *AXES, "intensity")
    fit = _solve(rows.groupBy(*keys).agg(*_sums()), 1e-14).select(*keys, "b0", "b1", "b2")
    for _ in range(rounds - 1):
        both = rows.join(fit, list(keys))
        r = F.col("intensity") - sum((F.col(a) * F.col(f"b{i}") for i, a in enumerate(AXES)), F.lit(0.0))
        w = 1.0 / (F.abs(r) + 1e-6)
        scaled = both.withColumn("_w", w)
        top = scaled.groupBy(*keys).agg(*_sums(F.col("_w") * F.col("_w")), F.sum(F.col("_w") * F.col("_w")).alias("_ws"))
        norm = [F.try_divide(F.col(c), F.col("_ws")).alias(c) for c in [*[f"a{i}{j}" for i, j in PAIRS], "r0", "r1", "r2"]]
        fit = _solve(top.select(*keys, *norm), 1e-14).select(*keys, "b0", "b1", "b2")
    b = tuple(F.col(f"b{i}") for i in range(3))
    out = fit.withColumn("rho", g.norm(b))
    return out.select(*keys, "rho", *[F.when(F.col("rho") > 0, b[i] / F.col("rho")).alias(k) for i, k in enumerate(("nx", "ny", "nz"))])


def intensity_error(obs: DataFrame, lights: DataFrame, surface: DataFrame, keys: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """Root-mean-square gap between observed and rendered intensity per pixel
    over its lit lights, for any surface (rho, nx, ny, nz)."""
    rows = with_lights(obs.where(F.col("intensity") > threshold), lights).join(surface, list(keys))
    shade = F.col("rho") * sum((F.col(a) * F.col(n) for a, n in zip(AXES, ("nx", "ny", "nz"))), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col("intensity") - shade, 2))).alias("error"))


def error_statistics(errors: DataFrame, column: str = "error") -> DataFrame:
    """One row: rms, mean, median, p90, max of finite errors."""
    e = F.col(column)
    errors = cut(errors.select(column))  # read several times below
    ok = errors.where(e.isNotNull() & ~F.isnan(e) & (e != float("inf")))
    base = ok.agg(F.sqrt(F.avg(e * e)).alias("rms"), F.avg(e).alias("mean"), F.max(e).alias("max"))
    q = exact_quantiles(ok, [], column, [0.5, 0.9]).select(F.col("q0").alias("median"), F.col("q1").alias("p90"))
    return attach(base, q, [])


def light_strength(obs: DataFrame, lights: DataFrame, surface: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scale per light that best explains its image: sum(a I) / sum(a a)."""
    rows = with_lights(obs, lights).join(surface, list(keys))
    a = F.col("rho") * sum((F.col(x) * F.col(n) for x, n in zip(AXES, ("nx", "ny", "nz"))), F.lit(0.0))
    rows = rows.select("light_id", a.alias("a"), "intensity")
    return rows.groupBy("light_id").agg(
        F.try_divide(F.sum(F.col("a") * F.col("intensity")), F.sum(F.col("a") * F.col("a"))).alias("strength")
    )


def strength_residual(obs: DataFrame, lights: DataFrame, surface: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per light: cost and derivative of sum (I - s rho max(0, n.l))^2 / 2."""
    rows = with_lights(obs, lights).join(surface, list(keys))
    dot = sum((F.col(x) * F.col(n) for x, n in zip(AXES, ("nx", "ny", "nz"))), F.lit(0.0))
    rows = rows.select("light_id", "strength", (F.col("rho") * F.greatest(dot, F.lit(0.0))).alias("a"), "intensity")
    r = F.col("intensity") - F.col("strength") * F.col("a")
    return rows.groupBy("light_id").agg(F.sum(r * r / 2).alias("cost"), F.sum(-r * F.col("a")).alias("slope"))


# -- normals ------------------------------------------------------------------------


def lay_normals(df: DataFrame) -> DataFrame:
    """Subtract the mean of nx and ny of each image."""
    means = df.groupBy("image_id").agg(F.avg("nx").alias("_mx"), F.avg("ny").alias("_my"))
    return attach(df, means, ["image_id"]).withColumns({"nx": F.col("nx") - F.col("_mx"), "ny": F.col("ny") - F.col("_my")}).drop("_mx", "_my")


def _unit_soft(v: Sequence[Column]) -> list[Column]:
    n = F.sqrt(sum((c * c for c in v), F.lit(0.0))) + 1e-8
    return [c / n for c in v]


def recenter_normals(df: DataFrame) -> DataFrame:
    """Shift the mean normal of each image to (0, 0, 1), then unit length."""
    means = df.groupBy("image_id").agg(*[F.avg(c).alias(f"_m{c}") for c in ("nx", "ny", "nz")])
    rows = attach(df, means, ["image_id"])
    moved = {f"_v{c}": F.col(c) - F.col(f"_m{c}") + t for c, t in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))}
    rows = rows.withColumns(moved)
    v = _unit_soft([F.col(c) for c in moved])
    return rows.withColumns(dict(zip(("nx", "ny", "nz"), v))).drop(*moved, "_mnx", "_mny", "_mnz")


def match_normal_distribution(source: DataFrame, target: DataFrame) -> DataFrame:
    """Give ``target`` the per-channel mean and spread of ``source``."""
    names = ("nx", "ny", "nz")
    stats = lambda d, p: d.groupBy("image_id").agg(*[f(c).alias(f"_{p}{k}{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = attach(attach(target, stats(source, "i"), ["image_id"]), stats(target, "o"), ["image_id"])
    moved = {
        f"_v{c}": (F.col(c) - F.col(f"_om{c}")) * (F.col(f"_is{c}") / (F.col(f"_os{c}") + 1e-8)) + F.col(f"_im{c}") for c in names
    }
    rows = rows.withColumns(moved)
    out = rows.withColumns(dict(zip(names, _unit_soft([F.col(c) for c in moved]))))
    return out.select(*target.columns)


def remove_bow(df: DataFrame, sigma: float, normalise: bool = False, tile: int = gr.TILE) -> DataFrame:
    """Subtract the Gaussian low-pass of the normals, add (0, 0, 1), clip."""
    names = ("nx", "ny", "nz")
    low = gr.gaussian_low_pass(df.select(*gr.KEY, *names), names, sigma, "reflect", "_low", tile)
    v = [F.col(c) - F.col(f"{c}_low") + t for c, t in zip(names, (0.0, 0.0, 1.0))]
    if normalise:
        low = low.withColumns({f"_v{c}": e for c, e in zip(names, v)})
        v = _unit_soft([F.col(f"_v{c}") for c in names])
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    return low.select(*gr.KEY, *[clip(e).alias(c) for c, e in zip(names, v)])


def subtract_residual(df: DataFrame, plane: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Normals minus a calibrated plane ``y, x, r0[, r1, r2]``; a grey plane
    applies to all channels, pixels without plane value stay."""
    names = [c for c in plane.columns if c not in ("y", "x")]
    rows = df.join(plane, ["y", "x"], "left")
    use = {c: F.col(c) - F.coalesce(F.col(names[i] if len(names) > 1 else names[0]), F.lit(0.0)) for i, c in enumerate(columns)}
    return rows.withColumns(use).drop(*names)


def ambient_occlusion(df: DataFrame, n: int = 64) -> DataFrame:
    """Mean of max(0, normal . d) over a lattice of sky directions.

    The lattice is a literal array folded per pixel; no join.
    """
    turn = 2 * math.pi / ((1 + math.sqrt(5)) / 2)
    dirs = []
    for i in range(n):
        z = 1 - (2 * i + 1) / (2 * n)
        if z > 0:
            r = math.sqrt(1 - z * z)
            dirs.append((math.cos(turn * i) * r, math.sin(turn * i) * r, z))
    sky = F.array(*[F.struct(*[F.lit(c).alias(k) for k, c in zip("abc", d)]) for d in dirs])
    lit = F.aggregate(
        sky, F.lit(0.0),
        lambda s, d: s + F.greatest(F.lit(0.0), F.col("nx") * d.a + F.col("ny") * d.b + F.col("nz") * d.c),
    )
    return df.withColumn("ao", lit / len(dirs))


def reflect_light(df: DataFrame, light: Sequence[float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """max(0, normal . light), divided by the image maximum."""
    size = math.sqrt(sum(c * c for c in light))
    shade = F.greatest(F.lit(0.0), sum((F.col(n) * (c / size) for n, c in zip(("nx", "ny", "nz"), light)), F.lit(0.0)))
    rows = df.withColumn("_v", shade)
    tops = rows.groupBy("image_id").agg(F.max("_v").alias("_hi"))
    rows = attach(rows, tops, ["image_id"])
    return rows.withColumn("reflection", F.when(F.col("_hi") > 0, F.col("_v") / F.col("_hi")).otherwise(F.col("_v"))).drop("_v", "_hi")


# -- depth trends -------------------------------------------------------------------


def _monomials(x: Column, y: Column, degree: int) -> list[Column]:
    out = []
    for i in range(degree + 1):
        for j in range(degree + 1 - i):
            term = F.lit(1.0)
            for _ in range(i):
                term = term * x
            for _ in range(j):
                term = term * y
            out.append(term)
    return out


def remove_trend(df: DataFrame, z: str, degree: int, keep_mean: bool = True, valid: str | None = None, zero_invalid: bool = False) -> DataFrame:
    """Subtract the least-squares polynomial surface of each image.

    Coordinates run over [-1, 1], which spans the same polynomials as pixel
    coordinates. ``keep_mean`` restores the mean height of the fitted pixels;
    ``zero_invalid`` sets masked pixels to 0.
    """
    rows = gr.with_dims(df)
    rows = rows.withColumns({"_px": F.col("x") / F.col("_w") * 2 - 1, "_py": F.col("y") / F.col("_h") * 2 - 1})
    good = F.col(z).isNotNull() & ~F.isnan(F.col(z)) & (F.abs(F.col(z)) != float("inf"))
    if valid:
        good = good & F.col(valid)
    feats = _monomials(F.col("_px"), F.col("_py"), degree)
    used = rows.where(good)
    fit = least_squares(used, ["image_id"], feats, [F.col(z)])
    rows = attach(rows, fit, ["image_id"])
    flat = F.col(z) - linear_value("coef", feats)
    if keep_mean:
        rows = attach(rows, used.groupBy("image_id").agg(F.avg(z).alias("_mean")), ["image_id"])
        flat = flat + F.col("_mean")
    if zero_invalid and valid:
        flat = F.when(F.col(valid), flat).otherwise(0.0)
    return rows.withColumn("flat", flat).drop("_h", "_w", "_px", "_py", "coef", "_mean")


# -- light calibration on a sphere -----------------------------------------------------


def _inside_circle() -> Column:
    return F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2) <= F.col("r") * F.col("r")


def highlight_direction(df: DataFrame, circles: DataFrame, value: str = "v", percent: float = 0.99) -> DataFrame:
    """Unit direction of the highlight centroid on a chrome sphere.

    Pixels inside the sphere above the percentile count; if there are none
    the 90th percentile is tried; without any the direction is (0, 0, 1).
    """
    rows = attach(df, circles, ["image_id"]).where(_inside_circle())
    q = exact_quantiles(rows, ["image_id"], value, [percent, 0.9])
    rows = attach(rows, q, ["image_id"])
    hot = {i: F.col(value) > F.col(f"q{i}") for i in (0, 1)}
    agg = rows.groupBy("image_id").agg(
        F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("r").alias("r"),
        *[F.avg(F.when(hot[i], F.col(c))).alias(f"{c}{i}") for i in (0, 1) for c in ("x", "y")],
    )
    dx = F.coalesce("x0", "x1") - F.col("cx")
    dy = F.coalesce("y0", "y1") - F.col("cy")
    agg = agg.withColumns({"_dx": dx, "_dy": dy})
    agg = agg.withColumn("_dz", F.sqrt(F.greatest(F.col("r") * F.col("r") - F.col("_dx") ** 2 - F.col("_dy") ** 2, F.lit(0.0))))
    v = g.unit((F.col("_dx"), F.col("_dy"), F.col("_dz")))
    return circles.select("image_id").join(
        agg.select("image_id", *[c.alias(k) for c, k in zip(v, AXES)]), "image_id", "left"
    ).select("image_id", *[F.coalesce(k, F.lit(d)).alias(k) for k, d in zip(AXES, (0.0, 0.0, 1.0))])


def brightest_direction(df: DataFrame, circles: DataFrame, value: str = "v") -> DataFrame:
    """View axis mirrored at the sphere normal of the brightest pixel."""
    rows = attach(df, circles, ["image_id"]).where(_inside_circle())
    # first in row order among equals
    key = F.struct(F.col(value).alias("v"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))
    top = rows.groupBy("image_id").agg(F.max(F.struct(key.alias("k"), F.struct("x", "y", "cx", "cy", "r").alias("p"))).alias("t")).select("image_id", "t.p.*")
    nx, ny = (F.col("x") - F.col("cx")) / F.col("r"), (F.col("y") - F.col("cy")) / F.col("r")
    top = top.withColumns({"_nx": nx, "_ny": ny})
    nz = F.sqrt(F.greatest(1 - F.col("_nx") ** 2 - F.col("_ny") ** 2, F.lit(0.0)))
    top = top.withColumn("_nz", nz)
    n = (F.col("_nx"), F.col("_ny"), F.col("_nz"))
    return top.select("image_id", (2 * n[2] * n[0]).alias("lx"), (2 * n[2] * n[1]).alias("ly"), (2 * n[2] * n[2] - 1).alias("lz"))


# -- albedo outputs ----------------------------------------------------------------------


def reflection_residual(lit: DataFrame, albedo: DataFrame) -> DataFrame:
    """Grey of the fully lit image minus the flipped albedo / max, to [0,1].

    ``lit``: image_id, y, x, c0, c1, c2; ``albedo``: image_id, y, x, rho.
    """
    flipped = gr.flip_vertical(albedo)
    tops = albedo.groupBy("image_id").agg(F.max("rho").alias("_hi"))
    rows = attach(lit.join(flipped, gr.KEY), tops, ["image_id"])
    grey = color.luminance((F.col("c0"), F.col("c1"), F.col("c2")), 4)
    rows = rows.select(*gr.KEY, (grey - F.col("rho") / F.col("_hi")).alias("_v"))
    return normalise_minmax(rows, "_v", ["image_id"], "residual").drop("_v")


def relabelled_albedo(lit: DataFrame, albedo: DataFrame) -> DataFrame:
    """RGB of Lab colours with L from the albedo and a, b from the flipped lit image."""
    tops = albedo.groupBy("image_id").agg(F.max("rho").alias("_hi"))
    rows = attach(albedo.join(gr.flip_vertical(lit), gr.KEY), tops, ["image_id"])
    rows = color.add_lab(rows, color.rgb_to_xyz(tuple(color.srgb_to_linear(F.col(c)) for c in ("c0", "c1", "c2"))), ("_l", "_a", "_b"))
    rows = rows.withColumn("_l", 100 * color.clip01(F.col("rho") / F.col("_hi")))
    rgb = color.lab_to_rgb((F.col("_l"), F.col("_a"), F.col("_b")))
    return rows.select(*gr.KEY, *[c.alias(k) for c, k in zip(rgb, "rgb")])
