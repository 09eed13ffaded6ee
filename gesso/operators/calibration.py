"""Colour-chart measurement, fits and replay.

Patch tables: ``image_id, patch_no, c0, c1, c2`` joined with reference values
``r0, r1, r2``. A fit is one aggregate of normal sums per group and a small
solve; applying it is a row expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gesso.functions import color
from gesso.operators.scans import attach, least_squares, linear_value, normal_sums
from gesso.session import keep, lookup

MEASURED = ("c0", "c1", "c2")
REFERENCE = ("r0", "r1", "r2")
#: patch numbers (from 1) of the grey row of a 24-patch chart
GREYS = (19, 20, 21, 22, 23, 24)
WHITE, BLACK, RED, FOURTH_GREY = 19, 24, 15, 22


def cols(names: Sequence[str]) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def with_reference(patches: DataFrame, reference: DataFrame) -> DataFrame:
    """Patches with their reference values by patch number."""
    return patches.join(lookup(reference), "patch_no")


# -- measuring --------------------------------------------------------------------


def crop_window(px: Column, py: Column, size: Column, width: Column, height: Column) -> Column:
    """Struct x0, x1, y0, y1 (end exclusive): centred window inside the image."""
    half = F.floor(size / 2).cast("int")
    zero = F.lit(0)
    return F.struct(
        F.greatest(px - half, zero).alias("x0"), F.least(px + half, width).alias("x1"),
        F.greatest(py - half, zero).alias("y0"), F.least(py + half, height).alias("y1"),
    )


def crop_patch(pixels: DataFrame, centres: DataFrame, bucket: int = 64) -> DataFrame:
    """Pixels of each patch window: ``centres`` has image_id, patch_no, px, py,
    size, width, height.

    A window is spread over the coordinate buckets it touches and joined by
    equality on them; the range test follows.
    """
    w = centres.withColumn("_w", crop_window(*cols(("px", "py", "size", "width", "height"))))
    reach = lambda a, b: F.sequence(F.floor(F.col(f"_w.{a}") / bucket), F.floor((F.col(f"_w.{b}") - 1) / bucket))
    w = w.where((F.col("_w.x1") > F.col("_w.x0")) & (F.col("_w.y1") > F.col("_w.y0")))
    w = w.withColumn("_by", F.explode(reach("y0", "y1"))).withColumn("_bx", F.explode(reach("x0", "x1")))
    keyed = pixels.withColumns({"_by": F.floor(F.col("y") / bucket), "_bx": F.floor(F.col("x") / bucket)})
    hit = keyed.join(lookup(w.select("image_id", "patch_no", "_w", "_by", "_bx")), ["image_id", "_by", "_bx"])
    inside = (F.col("x") >= F.col("_w.x0")) & (F.col("x") < F.col("_w.x1")) & (F.col("y") >= F.col("_w.y0")) & (F.col("y") < F.col("_w.y1"))
    return hit.where(inside).withColumns({"in_x": F.col("x") - F.col("_w.x0"), "in_y": F.col("y") - F.col("_w.y0")}).drop("_w", "_by", "_bx")


def patch_means(pixels: DataFrame, centres: DataFrame, channels: Sequence[str]) -> DataFrame:
    return crop_patch(pixels, centres).groupBy("image_id", "patch_no").agg(*[F.avg(c).alias(c) for c in channels])


def patch_mosaic(pixels: DataFrame, centres: DataFrame, tile: int, across: int = 6) -> DataFrame:
    """Crop-only image: patch windows laid out row by row, ``across`` per row."""
    cut_out = crop_patch(pixels, centres)
    row, col = F.floor((F.col("patch_no") - 1) / across), (F.col("patch_no") - 1) % across
    return cut_out.withColumns({"y": (row * tile + F.col("in_y")).cast("int"), "x": (col * tile + F.col("in_x")).cast("int")}).drop("in_x", "in_y")


def brightest_patch(patches: DataFrame, white: int = 18) -> DataFrame:
    """Index (from 0) of the largest channel mean per image; the chart is the
    right way round when it is the white patch."""
    mean = (F.col("c0") + F.col("c1") + F.col("c2")) / 3
    top = patches.groupBy("image_id").agg(F.max(F.struct(mean.alias("m"), (-F.col("patch_no")).alias("n"))).alias("t"))
    index = (-F.col("t.n") - 1).cast("int")
    return top.select("image_id", index.alias("brightest"), (index == white).alias("upright"))


def step_stats(errors: DataFrame, keys: Sequence[str], error: str = "de00") -> DataFrame:
    e = F.col(error)
    return errors.groupBy(*keys).agg(
        F.avg(e).alias("mean"), F.stddev_pop(e).alias("sd"), F.max(e).alias("max"), F.min(e).alias("min")
    )


# -- fits -------------------------------------------------------------------------


def affine_features(c: Sequence[Column]) -> list[Column]:
    return [*c, F.lit(1.0)]


def root_features(c: Sequence[Column]) -> list[Column]:
    """Root-polynomial terms of degree 2: exposure-independent."""
    r, g, b = (F.greatest(v, F.lit(0.0)) for v in c)
    return [*c, F.sqrt(r * g), F.sqrt(g * b), F.sqrt(r * b)]


def polynomial_features(c: Sequence[Column], degree: int) -> list[Column]:
    """All monomials of three inputs up to ``degree``, constant included."""
    out = []
    for total in range(degree + 1):
        for i in range(total, -1, -1):
            for j in range(total - i, -1, -1):
                term = F.lit(1.0)
                for v, times in zip(c, (i, j, total - i - j)):
                    for _ in range(times):
                        term = term * v
                out.append(term)
    return out


def patch_weights(grey: float, other: float) -> Column:
    return F.when(F.col("patch_no").isin(*GREYS), grey).otherwise(other)


def fit_color(pairs: DataFrame, keys: Sequence[str], features: Callable, weight: Column | None = None) -> DataFrame:
    """``keys, coef``: map from measured to reference colours."""
    return least_squares(pairs, keys, features(cols(MEASURED)), list(cols(REFERENCE)), weight)


def apply_color(df: DataFrame, fit: DataFrame, keys: Sequence[str], features: Callable, clip: bool = True, inside: tuple | None = None) -> DataFrame:
    """Apply fitted maps row by row. ``inside`` limits the change to values in
    that range, channel by channel."""
    rows = attach(df, fit, keys)
    terms = features(cols(MEASURED))
    out = {}
    for i, name in enumerate(MEASURED):
        v = linear_value("coef", terms, i)
        v = color.clip01(v) if clip else v
        if inside:
            v = F.when(F.col(name).between(*inside), v).otherwise(F.col(name))
        out[f"_o{i}"] = v
    rows = rows.withColumns(out)
    return rows.withColumns({n: F.col(f"_o{i}") for i, n in enumerate(MEASURED)}).drop("coef", *out)


RIDGE_PENALTIES = np.logspace(-3, 3, 100)


def fit_ridge(pairs: DataFrame, keys: Sequence[str], order: str = "patch_no", folds: int = 5, size: int = 24) -> DataFrame:
    """3x3 ridge map without intercept; the penalty with the best mean score
    over contiguous folds of the patch numbers.

    Sums are additive, so one aggregate per (group, fold) serves every
    training set; all penalties are tried on those 3x3 sums.
    """
    widths = [size // folds + (1 if i < size % folds else 0) for i in range(folds)]
    ends = np.cumsum(widths)
    fold = F.lit(folds - 1)
    for i in range(folds - 2, -1, -1):
        fold = F.when(F.col(order) <= int(ends[i]), i).otherwise(fold)
    rows = pairs.withColumn("_fold", fold)
    sums = normal_sums(rows, [*keys, "_fold"], list(cols(MEASURED)), list(cols(REFERENCE)))
    extra = rows.groupBy(*keys, "_fold").agg(
        F.array(*[F.sum(r) for r in REFERENCE]).alias("_sy"), F.array(*[F.sum(F.col(r) * F.col(r)) for r in REFERENCE]).alias("_syy")
    )
    packed = sums.join(extra, [*keys, "_fold"]).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_fold", "_gram", "_right", "_sy", "_syy", "_rows"))).alias("f")
    )

    def best(folds_column: pd.Series) -> pd.Series:
        out = []
        iu = np.triu_indices(3)
        for parts in folds_column:
            g, r, sy, syy, n = [], [], [], [], []
            for p in parts:
                m = np.zeros((3, 3))
                m[iu] = p["_gram"]
                g.append(m + m.T - np.diag(np.diag(m)))
                r.append(np.asarray(p["_right"], float).reshape(3, 3))
                sy.append(np.asarray(p["_sy"], float))
                syy.append(np.asarray(p["_syy"], float))
                n.append(p["_rows"])
            g, r, sy, syy, n = map(np.array, (g, r, sy, syy, n))
            scores = []
            for alpha in RIDGE_PENALTIES:
                fold_scores = []
                for k in range(len(n)):
                    w = np.linalg.solve(g.sum(0) - g[k] + alpha * np.eye(3), (r.sum(0) - r[k]).T)
                    rss = syy[k] - 2 * np.einsum("it,ti->t", w, r[k]) + np.einsum("it,ij,jt->t", w, g[k], w)
                    spread = syy[k] - sy[k] ** 2 / n[k]
                    fold_scores.append(np.mean(1 - rss / np.maximum(spread, 1e-300)))
                scores.append(np.mean(fold_scores))
            alpha = RIDGE_PENALTIES[int(np.argmax(scores))]
            w = np.linalg.solve(g.sum(0) + alpha * np.eye(3), r.sum(0).T)
            out.append({"alpha": float(alpha), "coef": w.T.ravel().tolist()})
        return pd.DataFrame(out, columns=["alpha", "coef"])

    udf = F.pandas_udf(best, "alpha double, coef array<double>")
    return packed.select(*keys, udf("f").alias("m")).select(*keys, "m.alpha", "m.coef")


def ridge_features(c: Sequence[Column]) -> list[Column]:
    return list(c)


def fit_wls_gain(pairs: DataFrame, keys: Sequence[str], direction: str = "reference") -> DataFrame:
    """One gain per channel without intercept, grey patches weighted 1/6.

    ``reference`` regresses measured on reference values (and the gain is then
    multiplied onto measured ones, as the reference values ask); ``measured``
    is the opposite regression.
    """
    w = patch_weights(1 / 6, 1 / 18)

    def gain(m: str, r: str) -> Column:
        x, y = (r, m) if direction == "reference" else (m, r)
        return F.try_divide(F.sum(w * F.col(x) * F.col(y)), F.sum(w * F.col(x) * F.col(x)))

    return pairs.groupBy(*keys).agg(*[gain(m, r).alias(f"g{i}") for i, (m, r) in enumerate(zip(MEASURED, REFERENCE))])


def validate_fit(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = sum((F.pow(F.col(m) - F.col(r), 2) for m, r in zip(MEASURED, REFERENCE)), F.lit(0.0)) / 3
    return pairs.groupBy(*keys).agg(F.avg(gap).alias("mse"))


def exposure_params(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value range and saturation ratio from the white, black and red patches."""
    rows = color.add_hsv_of_xyz(pairs, cols(MEASURED), "_m")
    rows = color.add_hsv_of_xyz(rows, cols(REFERENCE), "_r")
    at = lambda n, c: F.max(F.when(F.col("patch_no") == n, F.col(c)))
    a = rows.groupBy(*keys).agg(
        at(WHITE, "_mv").alias("mw"), at(BLACK, "_mv").alias("mb"), at(RED, "_ms").alias("mr"),
        at(WHITE, "_rv").alias("rw"), at(BLACK, "_rv").alias("rb"), at(RED, "_rs").alias("rr"),
    )
    return a.select(
        *keys, F.col("rb").alias("low"), (F.col("rw") - F.col("rb")).alias("expected_range"),
        (F.col("mw") - F.col("mb")).alias("measured_range"), F.try_divide("mr", "rr").alias("saturation_ratio"),
        F.col("mb").alias("measured_black"),
    )


# -- flat field -------------------------------------------------------------------


def flat_plane(df: DataFrame, sigma: float = 2.0, tile: int = 512) -> DataFrame:
    """Value plane of a white image (XYZ columns), smoothed, shifted to max 1."""
    from gesso.operators import grid as gr

    value = color.add_hsv_of_xyz(df, cols(MEASURED), "_f").select(*gr.KEY, F.col("_fv").alias("plane"))
    low = keep(gr.gaussian_low_pass(value, ["plane"], sigma, tile=tile), "low")  # used twice
    tops = low.groupBy("image_id").agg(F.max("plane_low").alias("_hi"))
    return attach(low, tops, ["image_id"]).select(*gr.KEY, (F.col("plane_low") + 1 - F.col("_hi")).alias("plane"))


def apply_flat_plane(df: DataFrame, plane: DataFrame, out: Sequence[str] = MEASURED) -> DataFrame:
    """Divide image brightness by the plane, pixel by pixel (equi-join)."""
    rows = df.join(plane.select("y", "x", "plane"), ["y", "x"])
    rows = color.add_hsv_of_xyz(rows, cols(MEASURED), "_f")
    rows = rows.withColumn("_fv", F.try_divide("_fv", "plane")).drop(*MEASURED, "plane")
    return color.add_xyz_from_hsv(rows, cols(("_fh", "_fs", "_fv")), out).drop("_fh", "_fs", "_fv")


def flat_gain(df: DataFrame, value: str, keys: Sequence[str] = ("image_id",), tolerance: float = 0.01) -> DataFrame:
    """Plane divided by its mean; ``warning`` where the mean is not 1."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    rows = attach(df, means, keys)
    return rows.withColumns(
        {"gain": F.try_divide(value, "_m"), "warning": F.abs(F.col("_m") - 1) > tolerance}
    ).drop("_m")


def grey_gain(patches: DataFrame, keys: Sequence[str], grey: int = FOURTH_GREY) -> DataFrame:
    """Per-channel gain that makes one grey patch neutral."""
    at = [F.max(F.when(F.col("patch_no") == grey, F.col(c))).alias(f"_{c}") for c in MEASURED]
    a = patches.groupBy(*keys).agg(*at)
    mean = (F.col("_c0") + F.col("_c1") + F.col("_c2")) / 3
    return a.select(*keys, *[F.try_divide(mean, F.col(f"_{c}")).alias(f"gain_{c}") for c in MEASURED])


# -- steps ------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """A correction: ``fit`` gives parameters from measured/reference pairs,
    ``apply`` uses them on any table with c0, c1, c2."""

    name: str
    fit: Callable[[DataFrame, Sequence[str]], DataFrame]
    apply: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]
    gated: bool = True


def _apply_exposure(df, p, keys):
    packed = p.select(*keys, F.struct("low", "expected_range", "measured_range", "saturation_ratio", "measured_black").alias("_p"))
    rows = attach(df, packed, keys)
    out = color.add_exposure(rows, cols(MEASURED), F.col("_p"), ("_o0", "_o1", "_o2"))
    return out.withColumns({n: F.col(f"_o{i}") for i, n in enumerate(MEASURED)}).drop("_p", "_o0", "_o1", "_o2")


def _fit_white(pairs, keys):
    at = lambda c: F.max(F.when(F.col("patch_no") == FOURTH_GREY, F.col(c)))
    return pairs.groupBy(*keys).agg(*[at(c).alias(f"s{i}") for i, c in enumerate(MEASURED)], *[at(c).alias(f"d{i}") for i, c in enumerate(REFERENCE)])


def _apply_white(df, p, keys):
    """inv(M) diag(M dst / M src) M with the white points as columns."""
    m = color.CAT_MATRICES["BRADFORD"]
    back = np.linalg.inv(np.array(m)).tolist()
    rows = attach(df, p, keys)
    cone = color.apply_matrix(m, cols(MEASURED))
    src, dst = color.apply_matrix(m, cols(("s0", "s1", "s2"))), color.apply_matrix(m, cols(("d0", "d1", "d2")))
    rows = rows.withColumns({f"_k{i}": cone[i] * F.try_divide(dst[i], src[i]) for i in range(3)})
    out = color.apply_matrix(back, cols(("_k0", "_k1", "_k2")))
    rows = rows.withColumns(dict(zip(MEASURED, out)))
    return rows.drop("s0", "s1", "s2", "d0", "d1", "d2", "_k0", "_k1", "_k2")


def _apply_gain(df, p, keys):
    rows = attach(df, p, keys)
    return rows.withColumns({c: F.col(c) * F.col(f"g{i}") for i, c in enumerate(MEASURED)}).drop("g0", "g1", "g2")


def _poly(c):
    return polynomial_features(c, 2)


STEPS = [
    Step("exposure", exposure_params, _apply_exposure),
    Step("white_balance", _fit_white, _apply_white),
    Step("affine", lambda p, k: fit_color(p, k, affine_features), lambda d, p, k: apply_color(d, p, k, affine_features)),
    Step("ridge", lambda p, k: fit_ridge(p, k).drop("alpha"), lambda d, p, k: apply_color(d, p, k, ridge_features)),
    Step("root_polynomial", lambda p, k: fit_color(p, k, root_features), lambda d, p, k: apply_color(d, p, k, root_features)),
    Step("wls", fit_wls_gain, _apply_gain),
    Step("polynomial", lambda p, k: fit_color(p, k, _poly, F.pow(patch_weights(1 / 6, 1 / 18), F.lit(2))), lambda d, p, k: apply_color(d, p, k, _poly, inside=(0.2, 0.8))),
]


def step_enabled(planned: DataFrame, config: DataFrame, mode: str) -> DataFrame:
    """Planned (image, step) rows that run. ``config`` has image_id, step,
    skip, has_params; a missing row means neither. Replay needs parameters."""
    rows = planned.join(config, ["image_id", "step"], "left")
    run = ~F.coalesce("skip", F.lit(False))
    if mode == "replay":
        run = run & F.coalesce("has_params", F.lit(False))
    return rows.where(run).select(*planned.columns)
