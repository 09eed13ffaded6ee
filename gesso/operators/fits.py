"""Circles, spheres and other nonlinear fits.

Nonlinear fits loop on the driver over at most a few dozen numbers; every
residual and Jacobian sum is one aggregate over the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gesso.operators.scans import _solve_stack, attach
from gesso.session import forget, keep, lookup

#: numbers of light products (patterns by twice the square of the lights) up to which they come to the driver, packed: 16 MB
PRODUCTS = 2_000_000
#: numbers of light products that a task holds at once, 64 MB
HELD = 8_000_000


def fit_circle(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Algebraic circle per group from centred moments: cx, cy, r."""
    means = points.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    p = attach(points, means, keys).withColumns({"_u": F.col("x") - F.col("_mx"), "_v": F.col("y") - F.col("_my")})
    u, v = F.col("_u"), F.col("_v")
    m = p.groupBy(*keys).agg(
        F.first("_mx").alias("mx"), F.first("_my").alias("my"), F.count(F.lit(1)).alias("n"),
        F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"),
        F.sum(u * u * u + u * v * v).alias("ru"), F.sum(v * v * v + u * u * v).alias("rv"),
    )
    c = lambda n: F.col(n)
    det = c("uu") * c("vv") - c("uv") * c("uv")
    cu = F.try_divide((c("ru") * c("vv") - c("rv") * c("uv")) / 2, det)
    cv = F.try_divide((c("rv") * c("uu") - c("ru") * c("uv")) / 2, det)
    m = m.withColumns({"cu": cu, "cv": cv})
    # mean squared distance to the centre = (Suu + Svv) / n + cu^2 + cv^2
    r = F.sqrt((c("uu") + c("vv")) / c("n") + c("cu") * c("cu") + c("cv") * c("cv"))
    return m.select(*keys, (c("mx") + c("cu")).alias("cx"), (c("my") + c("cv")).alias("cy"), r.alias("r"))


def gauss_newton(
    df: DataFrame, start: Sequence[float], residual: Callable[[Sequence[Column]], Column], jacobian: Callable[[Sequence[Column]], Sequence[Column]],
    lower: Sequence[float | None] | None = None, upper: Sequence[float | None] | None = None,
    rounds: int = 30, tolerance: float = 1e-10,
) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt with one aggregate per trial.

    ``residual`` and ``jacobian`` build column expressions from literal
    parameters. Bounds are honoured in the free variables of the usual
    logit/log maps.
    """
    k = len(start)
    lo, hi = lower or [None] * k, upper or [None] * k

    def to_free(p):
        out = []
        for v, a, b in zip(p, lo, hi):
            if a is not None and b is not None:
                s = min(max((v - a) / (b - a), 1e-9), 1 - 1e-9)
                out.append(np.log(s / (1 - s)))
            elif a is not None:
                out.append(np.log(max(v - a, 1e-12)))
            elif b is not None:
                out.append(-np.log(max(b - v, 1e-12)))
            else:
                out.append(v)
        return np.array(out, float)

    def to_bounded(u):
        out, slope = [], []
        for x, a, b in zip(u, lo, hi):
            if a is not None and b is not None:
                s = 1 / (1 + np.exp(-x))
                out.append(a + (b - a) * s)
                slope.append((b - a) * s * (1 - s))
            elif a is not None:
                e = np.exp(max(x, -709.0))
                out.append(a + e)
                slope.append(e)
            elif b is not None:
                e = np.exp(-min(x, 709.0))
                out.append(b - e)
                slope.append(e)
            else:
                out.append(x)
                slope.append(1.0)
        return np.array(out), np.array(slope)

    def sums(p):
        lits = [F.lit(float(v)) for v in p]
        rows = df.select(residual(lits).alias("_r"), *[j.alias(f"_j{i}") for i, j in enumerate(jacobian(lits))])
        row = rows.agg(
            F.sum(F.col("_r") * F.col("_r")).alias("cost"),
            *[F.sum(F.col(f"_j{i}") * F.col(f"_j{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)],
            *[F.sum(F.col(f"_j{i}") * F.col("_r")).alias(f"g{i}") for i in range(k)],
        ).first()
        h = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                h[i, j] = h[j, i] = row[f"h{i}_{j}"] or 0.0
        return row["cost"] or 0.0, h, np.array([row[f"g{i}"] or 0.0 for i in range(k)])

    free = to_free(start)
    p, slope = to_bounded(free)
    cost, h, g = sums(p)
    damping = 1e-3
    for _ in range(rounds):
        hs, gs = h * np.outer(slope, slope), g * slope
        step = -np.linalg.pinv(hs + damping * np.diag(np.maximum(np.diag(hs), 1e-12))) @ gs
        trial = free + step
        tp, ts = to_bounded(trial)
        tcost, th, tg = sums(tp)
        if tcost <= cost:
            done = cost - tcost <= tolerance * max(cost, 1e-300) or np.max(np.abs(step)) < 1e-12
            free, p, slope, cost, h, g = trial, tp, ts, tcost, th, tg
            damping = max(damping / 10, 1e-12)
            if done:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return p, float(cost)


def fit_circle_geometric(points: DataFrame, start: Sequence[float] | None = None) -> tuple[np.ndarray, float]:
    """Circle minimising squared distances, from the algebraic start."""
    if start is None:
        row = fit_circle(points.withColumn("_g", F.lit(0)), ["_g"]).first()
        start = [row["cx"], row["cy"], row["r"]]
    x, y = F.col("x"), F.col("y")
    dist = lambda p: F.sqrt(F.pow(x - p[0], 2) + F.pow(y - p[1], 2))
    return gauss_newton(
        points, start, lambda p: dist(p) - p[2],
        lambda p: [F.coalesce(F.try_divide(p[0] - x, dist(p)), F.lit(0.0)), F.coalesce(F.try_divide(p[1] - y, dist(p)), F.lit(0.0)), F.lit(-1.0)],
    )


def fit_sphere(points: DataFrame, start: Sequence[float]) -> tuple[np.ndarray, float]:
    """Sphere (cx, cy, cz, r) minimising squared distances."""
    axes = ("x", "y", "z")
    dist = lambda p: F.sqrt(sum((F.pow(F.col(a) - p[i], 2) for i, a in enumerate(axes)), F.lit(0.0)))
    return gauss_newton(
        points, start, lambda p: dist(p) - p[3],
        lambda p: [*[F.coalesce(F.try_divide(p[i] - F.col(a), dist(p)), F.lit(0.0)) for i, a in enumerate(axes)], F.lit(-1.0)],
    )


def nlls_fit(
    df: DataFrame, model: Callable[[Sequence[Column]], Column], gradient: Callable[[Sequence[Column]], Sequence[Column]],
    y: str, start: Sequence[float], lower=None, upper=None, rounds: int = 30,
) -> tuple[np.ndarray, float]:
    """Bounded least squares of a model given as a column expression."""
    return gauss_newton(df, start, lambda p: model(p) - F.col(y), gradient, lower, upper, rounds)


def _by_light(obs: DataFrame, lights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row a pixel: arrays by light number ``i`` of its observations ``c``, of the lit ones ``n``, and their sums ``t`` and ``s``."""
    from gesso.operators.relief import LIT

    lit = F.col("intensity") > LIT
    rows = obs.join(lookup(lights.select("light_id", "i")), "light_id").where(F.col("intensity").isNotNull())
    sums = rows.groupBy(*keys, "i").agg(
        F.count(F.lit(1)).alias("c"), F.count_if(lit).alias("n"), F.sum("intensity").alias("t"), F.coalesce(F.sum(F.when(lit, F.col("intensity"))), F.lit(0.0)).alias("s")
    )
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "c", "n", "t", "s"))).alias("_r"))  # one entry a light
    return whole.select(*[F.col("_r")[c].alias(c) for c in "icnts"]).where(F.size(F.filter("n", lambda n: n > 0)) >= 3)


def _light_products(pixels: DataFrame, k: int) -> DataFrame:
    """(pattern, products), both packed: per pattern of counts the sums of s s' and s t' (k by k each) over its pixels.

    A task adds up its pixels by matrix products, ``HELD`` numbers at a time;
    what it gives is sorted by pattern and added up again in one pass, so no
    task holds more however many patterns there are.
    """
    numbers = 2 * k * k

    def packed(held: dict[bytes, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"pattern": list(held), "products": [part.tobytes() for part in held.values()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            row = np.repeat(np.arange(len(batch)), batch["i"].map(len).to_numpy())
            light = np.concatenate(batch["i"].to_numpy())
            dense = {}
            for name in "cnts":
                dense[name] = np.zeros((len(batch), k))
                dense[name][row, light] = np.concatenate(batch[name].to_numpy())
            kinds, which = np.unique(np.hstack([dense["c"], dense["n"]]).astype("int64"), axis=0, return_inverse=True)
            which = which.ravel()
            order = np.argsort(which, kind="stable")
            for kind, own in zip(kinds, np.split(order, np.cumsum(np.bincount(which))[:-1])):
                s, t = dense["s"][own], dense["t"][own]
                part, name = np.concatenate([(s.T @ s).ravel(), (s.T @ t).ravel()]), kind.tobytes()
                held[name] = held[name] + part if name in held else part
                if len(held) * numbers > HELD:
                    yield packed(held)
                    held = {}
        if held:
            yield packed(held)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for name, part in zip(batch["pattern"], batch["products"]):
                part, name = np.frombuffer(part), bytes(name)
                if name not in held and len(held) * numbers > HELD:
                    yield packed(held)
                    held = {}
                held[name] = held[name] + part if name in held else part
        if held:
            yield packed(held)

    schema = "pattern binary, products binary"
    return pixels.mapInPandas(add, schema).repartition("pattern").sortWithinPartitions("pattern").mapInPandas(merge, schema)


def _inverses(a: np.ndarray) -> np.ndarray:
    """Inverses of symmetric 3x3 sums by the rule of ``photometric_stereo``: as they are if their determinant passes
    1e-6, else with the null direction filled in, else (rank one) by their trace."""
    det, trace = np.linalg.det(a), np.trace(a, axis1=1, axis2=2)
    crossed = np.stack([np.cross(a[:, i], a[:, j]) for i, j in ((0, 1), (0, 2), (1, 2))], axis=1)
    size = (crossed * crossed).sum(axis=2)
    best, each = size.argmax(axis=1), np.arange(len(a))
    u, most = crossed[each, best], size[each, best]
    full, rank2 = np.abs(det) > 1e-6, np.sqrt(most) > 1e-9 * trace * trace
    out = np.eye(3)[None] / np.where(trace > 0, trace, 1.0)[:, None, None]
    out[full] = np.linalg.inv(a[full])
    lift = rank2 & ~full
    out[lift] = np.linalg.inv(a[lift] + u[lift, :, None] * u[lift, None, :] / most[lift, None, None])
    return out


def _unpacked(rows: pd.DataFrame, k: int) -> tuple[np.ndarray, ...]:
    """Observations and lit observations by light, sums of s s' and of s t' of each pattern."""
    patterns = np.frombuffer(b"".join(map(bytes, rows["pattern"])), np.int64).reshape(len(rows), 2 * k).astype(float)
    values = np.frombuffer(b"".join(map(bytes, rows["products"]))).reshape(len(rows), 2, k, k)
    return patterns[:, :k], patterns[:, k:], values[:, 0], values[:, 1]


def _direction_sums(axes: np.ndarray, counts: np.ndarray, lit: np.ndarray, ss: np.ndarray, st: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least-squares sums of each light's direction, with the surface by the directions ``axes``."""
    surface = _inverses(np.einsum("pk,ki,kj->pij", lit, axes, axes)) @ axes.T
    normal = surface @ ss @ surface.transpose(0, 2, 1)
    return np.einsum("pk,pij->kij", counts, normal), np.einsum("pis,psk->ki", surface, st)


def _next_directions(axes: np.ndarray, gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Unit directions of the sums. Lights without a fit keep theirs."""
    fresh = _solve_stack(gram, right[:, :, None])[:, :, 0]
    length = np.sqrt((fresh * fresh).sum(axis=1, keepdims=True))
    return np.where(length > 0, fresh / np.where(length > 0, length, 1.0), axes)


def refine_lights(
    obs: DataFrame, lights: DataFrame, keys: Sequence[str], rounds: int | None = None, tolerance: float = 1e-4, max_rounds: int = 100_000
) -> DataFrame:
    """Alternate surface and light directions.

    Given the surface, each light direction is a linear least-squares problem
    (intensity = b . l), then brought back to unit length; given the lights,
    the surface is refitted. The rounds go on until no component of a direction
    changes by more than ``tolerance``, and raise after ``max_rounds``;
    ``rounds`` asks for so many instead.

    A pixel's surface is linear in its lit intensities, by a matrix that only
    its pattern (observations and lit observations by light) decides. So one
    pass adds up a light-by-light product matrix a pattern, and the rounds run
    on these, whatever the number of pixels: on the driver up to ``PRODUCTS``
    numbers, beyond that as a pass over the table of products a round, of
    which only the sums by light reach the driver. Missing intensities are
    left out.
    """
    axes = ("lx", "ly", "lz")
    known = [tuple(r) for r in lights.select("light_id", *axes).orderBy("light_id").collect()]  # lamps of one stand
    k, kind = len(known), lights.schema["light_id"].dataType.simpleString()
    out = f"light_id {kind}, lx double, ly double, lz double"
    spark = obs.sparkSession
    if k == 0:
        return spark.createDataFrame([], out)
    numbered = spark.createDataFrame([(r[0], i) for i, r in enumerate(known)], f"light_id {kind}, i int")
    products = keep(_light_products(_by_light(obs, numbered, keys), k), "products")
    current, patterns = np.array([r[1:] for r in known], float), products.count()
    if patterns:
        if patterns * 2 * k * k <= PRODUCTS:
            held = _unpacked(pd.DataFrame(products.collect(), columns=products.columns), k)
            current = _refined(current, lambda at: _direction_sums(at, *held), rounds, tolerance, max_rounds)
        else:
            current = _refine_by_passes(products, current, rounds, tolerance, max_rounds)
    forget(products)
    return spark.createDataFrame([(r[0], *map(float, v)) for r, v in zip(known, current)], out)


def _refined(axes: np.ndarray, sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], rounds: int | None, tolerance: float, max_rounds: int) -> np.ndarray:
    """The rounds of ``refine_lights``."""
    change = None
    for _ in range(max_rounds if rounds is None else rounds):
        fresh = _next_directions(axes, *sums(axes))
        change, axes = float(np.abs(fresh - axes).max()), fresh
        if rounds is None and change <= tolerance:
            return axes
    if rounds is None:
        raise RuntimeError(f"light directions still change by {change} after {max_rounds} rounds")
    return axes


def _refine_by_passes(products: DataFrame, axes: np.ndarray, rounds: int | None, tolerance: float, max_rounds: int) -> np.ndarray:
    """The rounds with a pass over ``products`` each; a task gives one row of sums."""
    k = len(axes)

    def sums(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gram, right = np.zeros((k, 3, 3)), np.zeros((k, 3))
            for batch in batches:
                if len(batch):
                    g, r = _direction_sums(at, *_unpacked(batch, k))
                    gram, right = gram + g, right + r
            yield pd.DataFrame({"sums": [np.concatenate([gram.ravel(), right.ravel()])]})

        whole = np.sum([r["sums"] for r in products.mapInPandas(part, "sums array<double>").collect()], axis=0)
        return whole[: 9 * k].reshape(k, 3, 3), whole[9 * k :].reshape(k, 3)

    return _refined(axes, sums, rounds, tolerance, max_rounds)
