"""Photometric stereo over lineitem; normals and depth over orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gesso.functions import geometry as g
from gesso.operators import relief as r
from gesso.queries import sqltext as q
from gesso.queries.grid_queries import DIMS, gauss_sql
from gesso.queries.standins import grid, lights, normals, observations, rounded
from gesso.registry import query

KEYS = ["image_id", "y", "x"]


def _solve_ctes(source, name):
    """b0..b2 of 3x3 sums with the minimum-norm rule for coplanar lights."""
    return f"""{name}_c AS (SELECT *, a00*(a11*a22-a12*a12)-a01*(a01*a22-a12*a02)+a02*(a01*a12-a11*a02) AS det,
  a01*a12-a02*a11 AS p0, a02*a01-a00*a12 AS p1, a00*a11-a01*a01 AS p2, a01*a22-a02*a12 AS q0, a02*a02-a00*a22 AS q1, a00*a12-a01*a02 AS q2,
  a11*a22-a12*a12 AS s0, a12*a02-a01*a22 AS s1, a01*a12-a11*a02 AS s2 FROM {source}),
{name}_n AS (SELECT *, p0*p0+p1*p1+p2*p2 AS np, q0*q0+q1*q1+q2*q2 AS nq, s0*s0+s1*s1+s2*s2 AS ns FROM {name}_c),
{name}_u AS (SELECT *, CASE WHEN np >= nq AND np >= ns THEN p0 WHEN nq >= ns THEN q0 ELSE s0 END AS u0, CASE WHEN np >= nq AND np >= ns THEN p1 WHEN nq >= ns THEN q1 ELSE s1 END AS u1,
  CASE WHEN np >= nq AND np >= ns THEN p2 WHEN nq >= ns THEN q2 ELSE s2 END AS u2, greatest(np, nq, ns) AS nb FROM {name}_n),
{name}_m AS (SELECT *, abs(det) > 1e-6 AS full_rank, CASE WHEN abs(det) > 1e-6 THEN 0 ELSE 1 / nb END AS k FROM {name}_u),
{name}_t AS (SELECT *, a00+k*u0*u0 AS m00, a01+k*u0*u1 AS m01, a02+k*u0*u2 AS m02, a11+k*u1*u1 AS m11, a12+k*u1*u2 AS m12, a22+k*u2*u2 AS m22 FROM {name}_m),
{name}_d AS (SELECT *, m00*(m11*m22-m12*m12)-m01*(m01*m22-m12*m02)+m02*(m01*m12-m11*m02) AS dd FROM {name}_t),
{name} AS (SELECT *, (r0*(m11*m22-m12*m12)-m01*(r1*m22-m12*r2)+m02*(r1*m12-m11*r2))/dd AS b0,
  (m00*(r1*m22-m12*r2)-r0*(m01*m22-m12*m02)+m02*(m01*r2-r1*m02))/dd AS b1, (m00*(m11*r2-r1*m12)-m01*(m01*r2-r1*m02)+r0*(m01*m12-m11*m02))/dd AS b2 FROM {name}_d)"""


def _sums(w="1", extra=""):
    return f"""sum({w}*lx*lx) AS a00, sum({w}*lx*ly) AS a01, sum({w}*lx*lz) AS a02, sum({w}*ly*ly) AS a11, sum({w}*ly*lz) AS a12, sum({w}*lz*lz) AS a22,
  sum({w}*lx*intensity) AS r0, sum({w}*ly*intensity) AS r1, sum({w}*lz*intensity) AS r2{extra}"""


PS = f"""lit AS (SELECT * FROM obs JOIN lights USING (light_id) WHERE intensity > 0.05e0),
sums AS (SELECT pixel, {_sums(extra=', count(*) AS n_obs, count(DISTINCT light_id) AS n_lights, sum(intensity*intensity) AS ii')} FROM lit GROUP BY pixel HAVING count(DISTINCT light_id) >= 3),
{_solve_ctes('sums', 'sol')},
ps AS (SELECT pixel, n_obs, CAST(n_lights AS INTEGER) AS n_lights, full_rank, b0, b1, b2, sqrt(b0*b0+b1*b1+b2*b2) AS rho, sqrt(greatest(ii - b0*r0 - b1*r1 - b2*r2, 0) / n_obs) AS error FROM sol)"""
BASE = q.with_(q.OBS, q.LIGHTS, PS)


@query("A4_photometric_stereo", BASE + "SELECT pixel, n_obs, n_lights, full_rank, round(rho, 5) AS rho, round(b0/rho, 4) AS nx, round(b1/rho, 4) AS ny, round(b2/rho, 4) AS nz FROM ps")
def a4(t):
    s = r.photometric_stereo(observations(t), lights(t), ["pixel"])
    return s.select("pixel", "n_obs", "n_lights", "full_rank", F.round("rho", 5).alias("rho"), *rounded(4, nx=F.col("nx"), ny=F.col("ny"), nz=F.col("nz")))


def surface(t):
    return r.photometric_stereo(observations(t), lights(t), ["pixel"]).select("pixel", "rho", "nx", "ny", "nz")


@query("A8_intensity_error", q.with_(q.OBS, q.LIGHTS, PS) + """SELECT pixel, round(sqrt(avg(pow(intensity - (b0*lx + b1*ly + b2*lz), 2))), 5) AS error FROM lit JOIN ps USING (pixel) GROUP BY pixel""")
def a8(t):
    return r.intensity_error(observations(t), lights(t), surface(t), ["pixel"]).select("pixel", F.round("error", 5).alias("error"))


@query("A8_error_statistics", BASE + """SELECT round(sqrt(avg(error*error)), 5) AS rms, round(avg(error), 5) AS mean, round(max(error), 5) AS max,
 round(quantile_cont(error, 0.5), 5) AS median, round(quantile_cont(error, 0.9), 5) AS p90 FROM ps""")
def a8_stats(t):
    s = r.error_statistics(r.photometric_stereo(observations(t), lights(t), ["pixel"]))
    return s.select(*rounded(**{k: F.col(k) for k in ("rms", "mean", "max", "median", "p90")}))


_W = np.linalg.pinv(np.array([row[1:] for row in q.LIGHT_ROWS]))
_WSQL = "wts(light_id, p0, p1, p2) AS (VALUES " + ", ".join("(" + ", ".join([str(row[0]), *[f"{float(_W[k, i])!r}::DOUBLE" for k in range(3)]]) + ")" for i, row in enumerate(q.LIGHT_ROWS)) + ")"


@query("A5_photometric_stereo_pinv", q.with_(q.OBS, _WSQL) + """, b AS (SELECT pixel, sum(p0*intensity) AS b0, sum(p1*intensity) AS b1, sum(p2*intensity) AS b2 FROM obs JOIN wts USING (light_id) GROUP BY pixel),
 l AS (SELECT *, least(1e0, sqrt(b0*b0+b1*b1+b2*b2)) AS n FROM b), m AS (SELECT *, CASE WHEN n = 0 THEN 1 ELSE n END AS rho FROM l)
SELECT pixel, round(rho, 5) AS rho, round(b0/rho, 4) AS nx, round(b1/rho, 4) AS ny, round(CASE WHEN b2 = 0 THEN 1 ELSE b2/rho END, 4) AS nz FROM m""")
def a5(t):
    s = r.photometric_stereo_pinv(observations(t), lights(t), ["pixel"])
    return s.select("pixel", F.round("rho", 5).alias("rho"), *rounded(4, nx=F.col("nx"), ny=F.col("ny"), nz=F.col("nz")))


@query("A10_robust_normals")
def a10(t):
    s = r.robust_normals(observations(t), lights(t), ["pixel"])
    return s.select("pixel", F.round("rho", 4).alias("rho"), *rounded(3, nx=F.col("nx"), ny=F.col("ny"), nz=F.col("nz")))


@query("A9_light_strength", BASE + """SELECT light_id, round(sum((b0*lx+b1*ly+b2*lz)*intensity)/sum(pow(b0*lx+b1*ly+b2*lz, 2)), 5) AS strength FROM obs JOIN lights USING (light_id) JOIN ps USING (pixel) GROUP BY light_id""")
def a9(t):
    return r.light_strength(observations(t), lights(t), surface(t), ["pixel"]).select("light_id", F.round("strength", 5).alias("strength"))


@query("A9_strength_residual", BASE + """SELECT light_id, round(avg(pow(intensity - 0.9e0*greatest(0, b0*lx+b1*ly+b2*lz), 2)/2), 6) AS cost, round(-avg((intensity - 0.9e0*greatest(0, b0*lx+b1*ly+b2*lz))*greatest(0, b0*lx+b1*ly+b2*lz)), 6) AS slope
 FROM obs JOIN lights USING (light_id) JOIN ps USING (pixel) GROUP BY light_id""")
def a9_residual(t):
    obs = observations(t)
    n = obs.join(surface(t).select("pixel"), "pixel", "left_semi").groupBy("light_id").agg(F.count("*").alias("n"))
    out = r.strength_residual(obs, lights(t).withColumn("strength", F.lit(0.9)), surface(t), ["pixel"]).join(n, "light_id")
    return out.select("light_id", F.round(F.col("cost") / F.col("n"), 6).alias("cost"), F.round(F.col("slope") / F.col("n"), 6).alias("slope"))


@query("J7_observations_lights", q.with_(q.OBS, q.LIGHTS) + "SELECT light_id, count(*) AS n, round(avg(intensity * lz), 5) AS shade FROM obs JOIN lights USING (light_id) GROUP BY light_id")
def j7(t):
    return r.with_lights(observations(t), lights(t)).groupBy("light_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("intensity") * F.col("lz")), 5).alias("shade"))


@query("P9_lit_mask", q.with_(q.OBS) + "SELECT light_id, intensity > 0.05e0 AS lit, count(*) AS n FROM obs GROUP BY 1, 2")
def p9(t):
    return r.lit_mask(observations(t)).groupBy("light_id", "lit").agg(F.count("*").alias("n"))


@query("P12_enabled_lights", q.with_(q.OBS) + ", l AS (SELECT light_id, avg(intensity) AS strength FROM obs GROUP BY 1) SELECT light_id, round(strength, 5) AS strength FROM l WHERE strength > (SELECT avg(strength) FROM l)")
def p12(t):
    l = observations(t).groupBy("light_id").agg(F.avg("intensity").alias("strength"))
    l = l.withColumn("enabled", F.col("strength") > l.agg(F.avg("strength")).scalar())
    return r.enabled_lights(l).select("light_id", F.round("strength", 5).alias("strength"))


@query("P13_reorder_lights", q.with_(q.OBS) + "SELECT CAST([2, 3, 4, 1, 6, 7, 8, 5][light_id] AS INTEGER) AS light_id, count(*) AS n, round(sum(intensity), 3) AS total FROM obs GROUP BY 1")
def p13(t):
    return r.reorder_lights(observations(t)).groupBy("light_id").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 3).alias("total"))


N = q.with_(q.NORMALS)


def _n(df, digits=5):
    return df.select(*KEYS, *rounded(digits, nx=F.col("nx"), ny=F.col("ny"), nz=F.col("nz")))


@query("P10_fill_normals", N + """SELECT image_id, y, x, round(CASE WHEN (y + x) % 5 = 0 THEN 0 ELSE nx END, 5) AS nx, round(CASE WHEN (y + x) % 5 = 0 THEN 0 ELSE ny END, 5) AS ny, round(CASE WHEN (y + x) % 7 = 0 OR (y + x) % 5 = 0 THEN 0.5e0 ELSE nz END, 5) AS nz FROM normals""")
def p10(t):
    hole, gap = (F.col("y") + F.col("x")) % 5 == 0, (F.col("y") + F.col("x")) % 7 == 0
    rows = normals(t).withColumns({c: F.when(hole, F.lit(float("nan"))).otherwise(F.col(c)) for c in ("nx", "ny", "nz")})
    rows = rows.withColumn("nz", F.when(~gap, F.col("nz")))
    return _n(rows.withColumns(dict(zip(("nx", "ny", "nz"), g.fill_normals((F.col("nx"), F.col("ny"), F.col("nz")))))))


@query("P11_clip_normals", N + "SELECT image_id, y, x, round(greatest(-1, least(1, 3*nx)), 5) AS nx, round(greatest(-1, least(1, 3*ny)), 5) AS ny, round(greatest(0, least(1, 2*nz - 1.9e0)), 5) AS nz FROM normals")
def p11(t):
    v = g.clip_normals((3 * F.col("nx"), 3 * F.col("ny"), 2 * F.col("nz") - 1.9))
    return normals(t).select(*KEYS, *rounded(nx=v[0], ny=v[1], nz=v[2]))


@query("A12_lay_normals", N + "SELECT image_id, y, x, round(nx - avg(nx) OVER w, 5) AS nx, round(ny - avg(ny) OVER w, 5) AS ny, round(nz, 5) AS nz FROM normals WINDOW w AS (PARTITION BY image_id)")
def a12(t):
    return _n(r.lay_normals(normals(t)))


@query("A13_recenter_normals", N + """, m AS (SELECT image_id, y, x, nx - avg(nx) OVER w AS a, ny - avg(ny) OVER w AS b, nz - avg(nz) OVER w + 1 AS c FROM normals WINDOW w AS (PARTITION BY image_id))
SELECT image_id, y, x, round(a/(sqrt(a*a+b*b+c*c)+1e-8), 5) AS nx, round(b/(sqrt(a*a+b*b+c*c)+1e-8), 5) AS ny, round(c/(sqrt(a*a+b*b+c*c)+1e-8), 5) AS nz FROM m""")
def a13(t):
    return _n(r.recenter_normals(normals(t)))


@query("A14_match_distribution", N + """, o AS (SELECT image_id, y, x, ny AS ox, nx AS oy, nz*nz AS oz FROM normals), j AS (SELECT * FROM o JOIN normals USING (image_id, y, x)),
 m AS (SELECT image_id, y, x, (ox - avg(ox) OVER w)*(stddev_pop(nx) OVER w/(stddev_pop(ox) OVER w + 1e-8)) + avg(nx) OVER w AS a, (oy - avg(oy) OVER w)*(stddev_pop(ny) OVER w/(stddev_pop(oy) OVER w + 1e-8)) + avg(ny) OVER w AS b,
  (oz - avg(oz) OVER w)*(stddev_pop(nz) OVER w/(stddev_pop(oz) OVER w + 1e-8)) + avg(nz) OVER w AS c FROM j WINDOW w AS (PARTITION BY image_id))
SELECT image_id, y, x, round(a/(sqrt(a*a+b*b+c*c)+1e-8), 5) AS nx, round(b/(sqrt(a*a+b*b+c*c)+1e-8), 5) AS ny, round(c/(sqrt(a*a+b*b+c*c)+1e-8), 5) AS nz FROM m""")
def a14(t):
    src = normals(t)
    out = src.select(*KEYS, F.col("ny").alias("nx"), F.col("nx").alias("ny"), (F.col("nz") * F.col("nz")).alias("nz"))
    return _n(r.match_normal_distribution(src, out))


@query("W11_remove_bow", q.with_(q.NORMALS, q.GRID, DIMS) + ", " + gauss_sql(1.3, ("nx", "ny", "nz"), "normals") + """, m AS (SELECT n.image_id, n.y, n.x, n.nx - low.nx AS a, n.ny - low.ny AS b, n.nz - low.nz + 1 AS c FROM normals n JOIN low USING (image_id, y, x))
SELECT image_id, y, x, round(greatest(-1, least(1, a)), 5) AS nx, round(greatest(-1, least(1, b)), 5) AS ny, round(greatest(-1, least(1, c)), 5) AS nz FROM m""")
def w11(t):
    return _n(r.remove_bow(normals(t), 1.3, tile=16))


@query("P26_subtract_residual", N + ", pl AS (SELECT y, x, avg(nx) / 3 AS r0 FROM normals GROUP BY y, x) SELECT image_id, y, x, round(nx - r0, 5) AS nx, round(ny - r0, 5) AS ny, round(nz - r0, 5) AS nz FROM normals JOIN pl USING (y, x)")
def p26(t):
    n = normals(t)
    plane = n.groupBy("y", "x").agg((F.avg("nx") / 3).alias("r0"))
    return _n(r.subtract_residual(n, plane, ["nx", "ny", "nz"]))


def _sky(n=16):
    import math

    turn = 2 * math.pi / ((1 + math.sqrt(5)) / 2)
    out = []
    for i in range(n):
        z = 1 - (2 * i + 1) / (2 * n)
        s = math.sqrt(1 - z * z)
        out.append((math.cos(turn * i) * s, math.sin(turn * i) * s, z))
    return out


@query("A43_ambient_occlusion", N + "SELECT image_id, y, x, round((" + " + ".join(f"greatest(0e0, nx*({a!r}::DOUBLE)+ny*({b!r}::DOUBLE)+nz*({c!r}::DOUBLE))" for a, b, c in _sky()) + ")/16, 5) AS ao FROM normals")
def a43(t):
    return r.ambient_occlusion(normals(t), 16).select(*KEYS, F.round("ao", 5).alias("ao"))


@query("M23_hemisphere_dirs", "WITH d(i, x, y, z) AS (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for i, (a, b, c) in enumerate(_sky())) + ") SELECT s_suppkey, round(x, 5) AS dx, round(y, 5) AS dy, round(z, 5) AS dz FROM supplier JOIN d ON s_suppkey % 16 = i")
def m23(t):
    d = g.hemisphere_dir(F.col("s_suppkey") % 16, 16)
    return t.supplier.select("s_suppkey", *rounded(dx=d[0], dy=d[1], dz=d[2]))


@query("M26_reflect", N + ", s AS (SELECT image_id, y, x, greatest(0, (nx*1 + ny*2 + nz*3) / sqrt(14)) AS v FROM normals) SELECT image_id, y, x, round(v / max(v) OVER (PARTITION BY image_id), 5) AS reflection FROM s")
def m26(t):
    return r.reflect_light(normals(t), (1.0, 2.0, 3.0)).select(*KEYS, F.round("reflection", 5).alias("reflection"))


def _trend(degree, keep_mean):
    feats = [f"pow(px, {i}) * pow(py, {j})" for i in range(degree + 1) for j in range(degree + 1 - i)]
    head = q.with_(q.GRID, DIMS, "co AS (SELECT image_id, y, x, v, x / w * 2e0 - 1 AS px, y / h * 2e0 - 1 AS py FROM grid JOIN dims USING (image_id))",
                   q.fit_ctes("co", ["image_id"], feats, ["v"], KEYS + ["v"]))
    mean = " + avg(v) OVER (PARTITION BY image_id)" if keep_mean else ""
    return head + f"SELECT image_id, y, x, round(v - fitted0{mean}, 5) AS flat FROM fit"


@query("A15_remove_plane", _trend(1, True))
def a15(t):
    return r.remove_trend(grid(t), "v", 1).select(*KEYS, F.round("flat", 5).alias("flat"))


@query("A15_remove_quadratic", _trend(2, True))
def a15_quadratic(t):
    return r.remove_trend(grid(t), "v", 2).select(*KEYS, F.round("flat", 5).alias("flat"))


def _poly_masked():
    feats = [f"pow(px, {i}) * pow(py, {j})" for i in range(4) for j in range(4 - i)]
    return q.with_(q.GRID, DIMS, "co AS (SELECT image_id, y, x, v, v > 0.2e0 AS ok, x / w * 2e0 - 1 AS px, y / h * 2e0 - 1 AS py FROM grid JOIN dims USING (image_id))",
                   q.fit_ctes("co", ["image_id"], feats, ["v"], KEYS + ["v", "ok"], where="ok")) + "SELECT image_id, y, x, round(CASE WHEN ok THEN v - fitted0 ELSE 0 END, 5) AS flat FROM fit"


@query("A16_remove_poly", _poly_masked())
def a16(t):
    rows = grid(t).withColumn("valid", F.col("v") > 0.2)
    return r.remove_trend(rows, "v", 3, keep_mean=False, valid="valid", zero_invalid=True).select(*KEYS, F.round("flat", 5).alias("flat"))


@query("A17_remove_cubic", _trend(3, False))
def a17(t):
    return r.remove_trend(grid(t), "v", 3, keep_mean=False).select(*KEYS, F.round("flat", 5).alias("flat"))


_DISC = "disc AS (SELECT *, 19.5e0 AS cx, 40e0 AS cy, 15e0 AS r FROM grid WHERE pow(x - 19.5e0, 2) + pow(y - 40, 2) <= 225)"


def circles(df):
    return df.select("image_id").distinct().select("image_id", F.lit(19.5).alias("cx"), F.lit(40.0).alias("cy"), F.lit(15.0).alias("r"))


@query("A28_highlight_direction", q.with_(q.GRID, _DISC) + """, p AS (SELECT image_id, quantile_cont(v, 0.97) AS t FROM disc GROUP BY image_id),
 c AS (SELECT image_id, avg(x) - 19.5e0 AS dx, avg(y) - 40 AS dy FROM disc JOIN p USING (image_id) WHERE v > t GROUP BY image_id)
SELECT image_id, round(dx/15, 5) AS lx, round(dy/15, 5) AS ly, round(sqrt(225-dx*dx-dy*dy)/15, 5) AS lz FROM c""")
def a28(t):
    df = grid(t)
    return r.highlight_direction(df, circles(df), "v", 0.97).select("image_id", *rounded(lx=F.col("lx"), ly=F.col("ly"), lz=F.col("lz")))


@query("A29_brightest_direction", q.with_(q.GRID, _DISC) + """, p AS (SELECT image_id, arg_max((x - cx)/r, (v, -y, -x)) AS a, arg_max((y - cy)/r, (v, -y, -x)) AS b FROM disc GROUP BY image_id)
SELECT image_id, round(2*a*sqrt(1-a*a-b*b), 5) AS lx, round(2*b*sqrt(1-a*a-b*b), 5) AS ly, round(1-2*a*a-2*b*b, 5) AS lz FROM p""")
def a29(t):
    df = grid(t)
    return r.brightest_direction(df, circles(df)).select("image_id", *rounded(lx=F.col("lx"), ly=F.col("ly"), lz=F.col("lz")))


_LIT = "lit AS (SELECT image_id, y, x, 0.1e0 + 0.8e0*v AS c0, 0.9e0 - 0.7e0*v AS c1, 0.2e0 + 0.5e0*v*v AS c2 FROM grid), alb AS (SELECT image_id, y, x, 0.2e0 + v*v AS rho FROM grid)"


def lit_and_albedo(t):
    v = F.col("v")
    df = grid(t)
    return (df.select(*KEYS, (0.1 + 0.8 * v).alias("c0"), (0.9 - 0.7 * v).alias("c1"), (0.2 + 0.5 * v * v).alias("c2")), df.select(*KEYS, (0.2 + v * v).alias("rho")))


@query("A45_reflection_residual", q.with_(q.GRID, DIMS, _LIT) + """, m AS (SELECT image_id, max(rho) AS hi FROM alb GROUP BY image_id),
 d AS (SELECT l.image_id, l.y, l.x, 0.2126e0*c0 + 0.7152e0*c1 + 0.0722e0*c2 - rho/hi AS v FROM lit l JOIN dims USING (image_id) JOIN m USING (image_id) JOIN alb a ON a.image_id = l.image_id AND a.y = h - 1 - l.y AND a.x = l.x)
SELECT image_id, y, x, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 5) AS residual FROM d WINDOW w AS (PARTITION BY image_id)""")
def a45(t):
    return r.reflection_residual(*lit_and_albedo(t)).select(*KEYS, F.round("residual", 5).alias("residual"))


def _a46_sql():
    from gesso.queries.colour_queries import _lab_back_sql

    lab = q.lab(q.matrix(q.c.RGB_TO_XYZ, [q.to_linear(c) for c in ("c0", "c1", "c2")]))
    back = _lab_back_sql(["ll", "la", "lb"])
    return q.with_(q.GRID, DIMS, _LIT, "m AS (SELECT image_id, max(rho) AS hi FROM alb GROUP BY image_id)",
                   f"k AS (SELECT a.image_id, a.y, a.x, 100 * {q.clip01('rho / hi')} AS ll, {lab[1]} AS la, {lab[2]} AS lb FROM alb a JOIN dims USING (image_id) JOIN m USING (image_id) JOIN lit l ON l.image_id = a.image_id AND a.y = h - 1 - l.y AND a.x = l.x)") + \
        "SELECT image_id, y, x, " + ", ".join(f"round({e}, 4) AS {n}" for e, n in zip(back, "rgb")) + " FROM k"


@query("A46_relabelled_albedo", _a46_sql())
def a46(t):
    return r.relabelled_albedo(*lit_and_albedo(t)).select(*KEYS, *rounded(4, r=F.col("r"), g=F.col("g"), b=F.col("b")))
