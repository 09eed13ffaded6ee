"""SQL text for the DuckDB twins of the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from gesso.functions import color as c

# -- stand-in tables as common table expressions ------------------------------

PATCHES = """patches AS (
  SELECT p_partkey AS patch_id, CAST(p_partkey % 24 + 1 AS INTEGER) AS patch_no, p_brand AS step, p_type AS image_id,
         0.05e0 + 0.9e0 * (p_size / 51.37e0) AS c0,
         0.05e0 + 0.9e0 * ((p_partkey * 37 % 101) / 100.73e0) AS c1,
         0.05e0 + 0.9e0 * ((p_partkey * 61 + p_size * 13) % 103 / 102.91e0) AS c2
  FROM part)"""
REFERENCE = """reference AS (
  SELECT patch_no, avg(c0) AS r0, avg(c1) AS r1, avg(c2) AS r2 FROM patches GROUP BY patch_no)"""
OBS = """obs AS (
  SELECT l_orderkey AS pixel, CAST(l_linenumber AS INTEGER) AS light_id, l_extendedprice / 110000e0 AS intensity
  FROM lineitem)"""
LIGHT_ROWS = [
    (1, 0.0, 0.0, 1.0),
    (2, 0.5, 0.0, 0.866),
    (3, -0.5, 0.0, 0.866),
    (4, 0.0, 0.5, 0.866),
    (5, 0.0, -0.5, 0.866),
    (6, 0.35, 0.35, 0.869),
    (7, -0.35, -0.35, 0.869),
]
LIGHTS = "lights(light_id, lx, ly, lz) AS (VALUES " + ", ".join(
    f"({i}, {x!r}e0, {y!r}e0, {z!r}e0)" for i, x, y, z in LIGHT_ROWS
) + ")"
# images of 100 x 40 pixels: image = key div 4000, row and column from the rest
GRID = """grid AS (
  SELECT CAST(o_orderkey // 4000 AS INTEGER) AS image_id, CAST(o_orderkey % 4000 // 40 AS INTEGER) AS y,
         CAST(o_orderkey % 40 AS INTEGER) AS x, o_totalprice / 499979.7e0 AS v
  FROM orders)"""
NORMALS = """normals AS (
  SELECT image_id, y, x, nx / n AS nx, ny / n AS ny, nz / n AS nz FROM (
    SELECT image_id, y, x, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS n FROM (
      SELECT CAST(o_orderkey // 4000 AS INTEGER) AS image_id, CAST(o_orderkey % 4000 // 40 AS INTEGER) AS y,
             CAST(o_orderkey % 40 AS INTEGER) AS x, sin(o_totalprice / 9000e0) * 0.6e0 AS nx,
             cos(o_totalprice / 7000e0) * 0.5e0 AS ny, 1e0 AS nz FROM orders)))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def clip01(e: str) -> str:
    return f"greatest(0e0, least(1e0, {e}))"


def matrix(m: list, v: Sequence[str]) -> list[str]:
    return ["(" + " + ".join(f"({float(w)!r}::DOUBLE) * ({x})" for w, x in zip(row, v)) + ")" for row in m]


def to_linear(e: str) -> str:
    return f"(CASE WHEN ({e}) <= {c.SRGB_DECODE_KNEE!r}::DOUBLE THEN ({e}) / 12.92e0 ELSE pow((({e}) + 0.055e0) / 1.055e0, 2.4e0) END)"


def to_srgb(e: str) -> str:
    e = f"greatest(({e}), 0e0)"
    return f"(CASE WHEN {e} <= 0.0031308e0 THEN {e} * 12.92e0 ELSE 1.055e0 * pow({e}, 1 / 2.4e0) - 0.055e0 END)"


def lab_f(e: str) -> str:
    return f"(CASE WHEN ({e}) > pow(6 / 29e0, 3) THEN pow(({e}), 1 / 3e0) ELSE ({e}) / (3 * pow(6 / 29e0, 2)) + 4 / 29e0 END)"


def lab(v: Sequence[str]) -> list[str]:
    f = [lab_f(f"({x}) / {w!r}::DOUBLE") for x, w in zip(v, c.WHITE_D65)]
    return [f"(116 * {f[1]} - 16)", f"(500 * ({f[0]} - {f[1]}))", f"(200 * ({f[1]} - {f[2]}))"]


def ciede_ctes(source: str, keep: str, name: str = "de") -> str:
    """CTE chain computing ``de00`` from columns l1 a1 b1 l2 a2 b2 of ``source``."""
    return f"""{name}_1 AS (SELECT *, (sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2 AS cbar FROM {source}),
{name}_2 AS (SELECT *, 1 + 0.5e0 * (1 - sqrt(pow(cbar,7) / (pow(cbar,7) + pow(25e0,7)))) AS g FROM {name}_1),
{name}_3 AS (SELECT *, sqrt(g*a1*g*a1 + b1*b1) AS cp1, sqrt(g*a2*g*a2 + b2*b2) AS cp2,
   (degrees(atan2(b1, g*a1)) + 360) % 360 AS h1, (degrees(atan2(b2, g*a2)) + 360) % 360 AS h2 FROM {name}_2),
{name}_4 AS (SELECT *, CASE WHEN abs(h2-h1) <= 180 THEN h2-h1 WHEN h2 <= h1 THEN h2-h1+360 ELSE h2-h1-360 END AS dh,
   CASE WHEN abs(h2-h1) <= 180 THEN (h1+h2)/2 WHEN h1+h2 < 360 THEN (h1+h2+360)/2 ELSE (h1+h2-360)/2 END AS hm,
   (l1+l2)/2 AS lm, (cp1+cp2)/2 AS cm FROM {name}_3),
{name}_5 AS (SELECT *, 1 - 0.17e0*cos(radians(hm-30)) + 0.24e0*cos(radians(2*hm)) + 0.32e0*cos(radians(3*hm+6))
   - 0.20e0*cos(radians(4*hm-63)) AS t, 30*exp(-pow((hm-275)/25e0,2)) AS turn,
   2*sqrt(pow(cm,7)/(pow(cm,7)+pow(25e0,7))) AS rc FROM {name}_4),
{name}_6 AS (SELECT *, (l2-l1)/(1+0.015e0*pow(lm-50,2)/sqrt(20+pow(lm-50,2))) AS sl, (cp2-cp1)/(1+0.045e0*cm) AS sc,
   2*sqrt(cp1*cp2)*sin(radians(dh/2))/(1+0.015e0*cm*t) AS sh FROM {name}_5),
{name} AS (SELECT {keep}, sqrt(sl*sl+sc*sc+sh*sh-rc*sin(radians(2*turn))*sc*sh) AS de00 FROM {name}_6)"""


def xyz_to_srgb(v: Sequence[str]) -> list[str]:
    lin = matrix(c.LINEAR_SRGB_MATRIX, v)
    return [
        f"(CASE WHEN {e} <= 0.0031308e0 THEN {e} * 12.92e0 ELSE 1.055e0 * pow({e}, 1 / 2.4e0) - 0.055e0 END)" for e in lin
    ]


def hsv_ctes(source: str, name: str) -> str:
    """Adds h, s, val to the columns of ``source`` (which has r, g, b)."""
    return f"""{name}_m AS (SELECT *, greatest(r,g,b) AS val, least(r,g,b) AS low FROM {source}),
{name} AS (SELECT * EXCLUDE (low), CASE WHEN val = low THEN 0e0
   WHEN val = b THEN ((60*((r-g)/(val-low)+4)) % 360 + 360) % 360
   WHEN val = g THEN ((60*((b-r)/(val-low)+2)) % 360 + 360) % 360
   ELSE (60*((((g-b)/(val-low)) % 6 + 6) % 6)) % 360 END AS h,
   CASE WHEN val = 0 THEN 0e0 ELSE (val-low)/val END AS s FROM {name}_m)"""


def hsv_to_rgb_ctes(source: str, name: str) -> str:
    """Adds r2, g2, b2 from h, s, val of ``source``."""
    def pick(letters: str) -> str:
        whens = " ".join(f"WHEN h < {60 * (i + 1)} THEN {e}" for i, e in enumerate(letters.split()[:5]))
        return f"(CASE {whens} ELSE {letters.split()[5]} END)"

    return f"""{name}_c AS (SELECT *, val*s AS ch FROM {source}),
{name}_x AS (SELECT *, ch*(1-abs((h/60e0) % 2 - 1)) AS xx, val-ch AS mm FROM {name}_c),
{name} AS (SELECT * EXCLUDE (ch, xx, mm), {pick('ch xx 0e0 0e0 xx ch')}+mm AS r2, {pick('xx ch ch xx 0e0 0e0')}+mm AS g2,
   {pick('0e0 0e0 xx ch ch xx')}+mm AS b2 FROM {name}_x)"""


def fit_ctes(
    source: str, keys: Sequence[str], features: Sequence[str], targets: Sequence[str], keep: Sequence[str],
    name: str = "fit", weight: str = "1e0", where: str = "true",
) -> str:
    """Least squares in SQL by orthogonalising the features one after another.

    Yields CTE ``name`` with ``keep`` and fitted0.. per row. Rows that fail
    ``where`` get fitted values but do not take part in the sums.
    """
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    k, m = len(features), len(targets)
    cols = ", ".join(keep)
    steps = [
        f"{name}_0 AS (SELECT {cols}, CASE WHEN {where} THEN {weight} ELSE 0e0 END AS w_, "
        + ", ".join(f"({f})::DOUBLE AS q{i}" for i, f in enumerate(features))
        + ", " + ", ".join(f"({t})::DOUBLE AS y{i}, ({t})::DOUBLE AS e{i}" for i, t in enumerate(targets))
        + f" FROM {source})"
    ]
    for j in range(k):
        size = f"nullif(sum(w_*q{j}*q{j}) OVER ({part}), 0)"

        def drop(e: str) -> str:
            return f"{e} - coalesce(q{j} * sum(w_*q{j}*{e}) OVER ({part}) / {size}, 0)"

        parts = [cols, "w_", *[f"q{i}" for i in range(j + 1)]]
        parts += [f"{drop(f'q{i}')} AS q{i}" for i in range(j + 1, k)]
        parts += [f"y{i}, {drop(f'e{i}')} AS e{i}" for i in range(m)]
        steps.append(f"{name}_{j + 1} AS (SELECT {', '.join(parts)} FROM {name}_{j})")
    fitted = ", ".join(f"y{i} - e{i} AS fitted{i}" for i in range(m))
    steps.append(f"{name} AS (SELECT {cols}, w_, {fitted} FROM {name}_{k})")
    return ",\n".join(steps)
