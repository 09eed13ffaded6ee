"""Pixel-table queries: orders read as 100 x 40 images."""

from __future__ import annotations

from pyspark.sql import functions as F

from gesso.operators import grid as gr
from gesso.operators import quality as ql
from gesso.queries import sqltext as q
from gesso.queries.standins import grid, normals, rounded
from gesso.registry import query

DIMS = "dims AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM grid GROUP BY image_id)"
G = q.with_(q.GRID, DIMS)
KEYS = ["image_id", "y", "x"]
T = 16  # small tiles so that the queries cross tile borders


def _out(df, digits=5, **cols):
    return df.select(*KEYS, *rounded(digits, **cols))


def refl(e, n):
    """Mirror index with the edge pixel repeated."""
    return f"(CASE WHEN {e} < 0 THEN -1 - ({e}) WHEN {e} >= {n} THEN 2 * {n} - 1 - ({e}) ELSE {e} END)"


def refl101(e, n):
    return f"(CASE WHEN {e} < 0 THEN -({e}) WHEN {e} >= {n} THEN 2 * {n} - 2 - ({e}) ELSE {e} END)"


def window_sql(size, border=refl):
    b, a = size // 2, size - 1 - size // 2
    return f"""nb AS (SELECT g.image_id, g.y, g.x, g.v AS own, n.v AS v, dy.d AS dy, dx.d AS dx FROM grid g JOIN dims USING (image_id)
  CROSS JOIN (SELECT unnest(range(-{b}, {a + 1})) AS d) dy CROSS JOIN (SELECT unnest(range(-{b}, {a + 1})) AS d) dx
  JOIN grid n ON n.image_id = g.image_id AND n.y = {border('g.y + dy.d', 'h')} AND n.x = {border('g.x + dx.d', 'w')})"""


@query("W7_box_mean", G + ", " + window_sql(6) + " SELECT image_id, y, x, round(avg(v), 5) AS mean FROM nb GROUP BY image_id, y, x")
def w7(t):
    return _out(gr.box_means(grid(t), ["v"], 6, "reflect", T), mean=F.col("v_mean"))


@query("W7_wallis", G + ", " + window_sql(6) + """, s AS (SELECT image_id, y, x, 255 * any_value(own) AS own, avg(255 * v) AS m, sqrt(greatest(avg(65025 * v * v) - pow(avg(255 * v), 2), 0)) AS sd FROM nb GROUP BY image_id, y, x)
SELECT image_id, y, x, CAST(floor(greatest(0, least(255, 50 * (own - m) / greatest(sd + 1, 1e-4) + 127 * 0.7e0 + m * 0.3e0))) AS INTEGER) AS wallis FROM s""")
def w7_wallis(t):
    rows = grid(t).withColumn("v", 255 * F.col("v"))
    return gr.wallis(rows, "v", 6, a=1.0, b=0.7, tile=T).select(*KEYS, "wallis")


def gauss_sql(sigma, values=("v",), source="grid"):
    w = gr.gaussian_weights(sigma)
    r = len(w) // 2
    table = ", ".join(f"({i - r}, {x!r}::DOUBLE)" for i, x in enumerate(w.tolist()))
    across = ", ".join(f"sum(k.w * n.{v}) AS {v}, sum(k.w) FILTER (n.{v} IS NOT NULL) AS {v}_w" for v in values)
    down = ", ".join(f"CASE WHEN any_value(g.{v}) IS NOT NULL THEN sum(k.w * n.{v}) / sum(k.w * n.{v}_w) END AS {v}" for v in values)
    return f"""kern(d, w) AS (VALUES {table}),
places AS (SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, h, w FROM (SELECT image_id, h, w, unnest(range(h)) AS y FROM dims) CROSS JOIN LATERAL (SELECT unnest(range(w)) AS x)),
gx AS (SELECT g.image_id, g.y, g.x, {across} FROM places g CROSS JOIN kern k
  JOIN {source} n ON n.image_id = g.image_id AND n.y = g.y AND n.x = {refl('g.x + k.d', 'g.w')} GROUP BY g.image_id, g.y, g.x),
low AS (SELECT g.image_id, g.y, g.x, {down} FROM {source} g JOIN dims USING (image_id) CROSS JOIN kern k
  JOIN gx n ON n.image_id = g.image_id AND n.x = g.x AND n.y = {refl('g.y + k.d', 'dims.h')} GROUP BY g.image_id, g.y, g.x)"""


@query("W8_gaussian_low_pass", G + ", " + gauss_sql(1.3) + " SELECT image_id, y, x, round(v, 5) AS low FROM low")
def w8(t):
    return _out(gr.gaussian_low_pass(grid(t), ["v"], 1.3, tile=T), low=F.col("v_low"))


_N4 = """nn AS (SELECT *, lag(v) OVER wx AS l, lead(v) OVER wx AS r, lag(v) OVER wy AS u, lead(v) OVER wy AS d FROM grid
 WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y))"""


@query("W6_gradient", G + ", " + _N4 + """ SELECT image_id, y, x, round(coalesce(r - v, 0), 5) AS fx, round(coalesce(v - u, 0), 5) AS by,
  round(coalesce((r - l) / 2, r - v, v - l), 5) AS cx, round(coalesce((d - u) / 2, d - v, v - u), 5) AS cy,
  round(coalesce(l - v, 0) + coalesce(r - v, 0) + coalesce(u - v, 0) + coalesce(d - v, 0), 5) AS lap FROM nn""")
def w6(t):
    g = grid(t)
    out = gr.gradients(g, "v", "forward", T).select(*KEYS, "v", F.col("gx").alias("fx"))
    out = gr.gradients(out, "v", "backward", T).select(*KEYS, "v", "fx", F.col("gy").alias("by"))
    out = gr.gradients(out, "v", "central", T).select(*KEYS, "v", "fx", "by", F.col("gx").alias("cx"), F.col("gy").alias("cy"))
    out = gr.laplacian(out, "v", T)
    return _out(out, fx=F.col("fx"), by=F.col("by"), cx=F.col("cx"), cy=F.col("cy"), lap=F.col("lap"))


@query("W6_divergence", G + """, f AS (SELECT g.*, CASE WHEN x < w - 1 THEN v ELSE 0 END AS fx, CASE WHEN y < h - 1 THEN v * v ELSE 0 END AS fy FROM grid g JOIN dims USING (image_id))
SELECT image_id, y, x, round(fx - coalesce(lag(fx) OVER (PARTITION BY image_id, y ORDER BY x), 0) + fy - coalesce(lag(fy) OVER (PARTITION BY image_id, x ORDER BY y), 0), 5) AS div FROM f""")
def w6_div(t):
    rows = grid(t).select(*KEYS, F.col("v").alias("p"), (F.col("v") * F.col("v")).alias("q"))
    return _out(gr.divergence(rows, tile=T), div=F.col("div"))


_SCHARR = window_sql(3, refl101) + """, dd AS (SELECT image_id, y, x, sum(v * dx * CASE dy WHEN 0 THEN 10 ELSE 3 END) AS dx, sum(v * dy * CASE dx WHEN 0 THEN 10 ELSE 3 END) AS dy FROM nb GROUP BY image_id, y, x)"""


@query("W12_scharr_normals", G + ", " + _SCHARR + """ SELECT image_id, y, x, round(-dx / sqrt(dx*dx+dy*dy+1), 5) AS nx, round(-dy / sqrt(dx*dx+dy*dy+1), 5) AS ny, round(1 / sqrt(dx*dx+dy*dy+1), 5) AS nz FROM dd""")
def w12(t):
    return _out(gr.normals_from_depth(grid(t), "v", tile=T), nx=F.col("nx"), ny=F.col("ny"), nz=F.col("nz"))


@query("W13_curvatures", G + """, pq AS (SELECT image_id, y, x, v AS p, v * v - 0.3e0 AS q FROM grid),
""" + window_sql(3, refl101).replace("grid g", "pq g").replace("grid n", "pq n").replace("g.v AS own, n.v AS v", "g.p AS p0, g.q AS q0, n.p AS p, n.q AS q") + """,
 k AS (SELECT image_id, y, x, any_value(p0) AS p, any_value(q0) AS q, -sum(p * dx * CASE dy WHEN 0 THEN 2 ELSE 1 END) AS ixx, sum(p * dy * CASE dx WHEN 0 THEN 2 ELSE 1 END) AS ixy,
  sum(q * dy * CASE dx WHEN 0 THEN 2 ELSE 1 END) AS iyy, -sum(q * dx * CASE dy WHEN 0 THEN 2 ELSE 1 END) AS iyx,
  sum(CASE WHEN dy = 0 THEN p * dx END) AS px, sum(CASE WHEN dx = 0 THEN p * dy END) AS py, sum(CASE WHEN dy = 0 THEN q * dx END) AS qx, sum(CASE WHEN dx = 0 THEN q * dy END) AS qy FROM nb GROUP BY image_id, y, x)
SELECT image_id, y, x, round((ixx*iyy - ixy*iyx) / pow(1+p*p+q*q, 2), 4) AS gaussian, round(((1+p*p)*qy - p*q*(py+qx) + (1+q*q)*px) / pow(1+p*p+q*q, 1.5e0), 4) AS mean FROM k""")
def w13(t):
    rows = grid(t).select(*KEYS, F.col("v").alias("p"), (F.col("v") * F.col("v") - 0.3).alias("q"))
    return _out(gr.curvatures(rows, tile=T), 4, gaussian=F.col("gaussian"), mean=F.col("mean"))


@query("W10_clean_peaks", G + """, f AS (SELECT image_id, y, x, CASE WHEN (y * 7 + x * 3) % 11 = 0 THEN NULL ELSE v END AS v FROM grid), z AS (SELECT *, coalesce(v, 0) AS a FROM f),
 sd AS (SELECT image_id, stddev_pop(a) AS sd FROM z GROUP BY image_id),
 c AS (SELECT z.*, greatest(1, least(h - 2, z.y)) AS cy, greatest(1, least(w - 2, z.x)) AS cx, sd FROM z JOIN dims USING (image_id) JOIN sd USING (image_id)),
 m AS (SELECT c.image_id, c.y, c.x, any_value(c.v) AS v, any_value(c.a) AS a, any_value(sd) AS sd, sum(n.a) / 9 AS local FROM c JOIN z n ON n.image_id = c.image_id AND n.y BETWEEN c.cy - 1 AND c.cy + 1 AND n.x BETWEEN c.cx - 1 AND c.cx + 1 GROUP BY c.image_id, c.y, c.x)
SELECT image_id, y, x, round(CASE WHEN v IS NULL OR abs(a - local) > 1.2e0 * sd THEN local ELSE a END, 5) AS cleaned FROM m""")
def w10(t):
    hole = (F.col("y") * 7 + F.col("x") * 3) % 11 == 0
    rows = grid(t).withColumn("v", F.when(~hole, F.col("v")))
    return _out(gr.clean_peaks(rows, "v", 1.2, T), cleaned=F.col("cleaned"))


@query("W16_island_segments", G + """, f AS (SELECT *, v > 0.3e0 AS ok FROM grid), i AS (SELECT *, row_number() OVER (PARTITION BY image_id, y ORDER BY x) - row_number() OVER (PARTITION BY image_id, y, ok ORDER BY x) AS k FROM f)
SELECT image_id, y, x, CASE WHEN ok THEN dense_rank() OVER (PARTITION BY image_id, y, ok ORDER BY k) ELSE 0 END AS segment FROM i""")
def w16(t):
    rows = grid(t).withColumn("valid", F.col("v") > 0.3)
    out = gr.islands(rows, "valid", ["image_id", "y"], "x")
    return out.select(*KEYS, F.coalesce("segment", F.lit(0)).alias("segment"))


@query("W5_integrate_direct")
def w5(t):
    g = grid(t).select(*KEYS, (F.col("v") - 0.4).alias("p"), (F.col("v") * F.col("v") - 0.3).alias("q"), (F.col("v") > 0.05).alias("valid"))
    return _out(gr.integrate_direct(g), z=F.col("z"))


@query("W5_integrate_full", G + """, c AS (SELECT g.*, v - 0.4e0 AS p, v * v - 0.3e0 AS q, h // 2 AS cy, w // 2 AS cx FROM grid g JOIN dims USING (image_id)),
 r AS (SELECT image_id, x, CASE WHEN x >= cx THEN coalesce(sum(CASE WHEN x >= cx THEN p END) OVER (PARTITION BY image_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
   ELSE -sum(CASE WHEN x < cx THEN p END) OVER (PARTITION BY image_id ORDER BY x DESC ROWS UNBOUNDED PRECEDING) END AS z0 FROM c WHERE y = cy)
SELECT image_id, y, x, round(z0 + CASE WHEN y >= cy THEN coalesce(sum(CASE WHEN y >= cy THEN q END) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
   ELSE -sum(CASE WHEN y < cy THEN q END) OVER (PARTITION BY image_id, x ORDER BY y DESC ROWS UNBOUNDED PRECEDING) END, 5) AS z FROM c JOIN r USING (image_id, x)""")
def w5_full(t):
    g = grid(t).select(*KEYS, (F.col("v") - 0.4).alias("p"), (F.col("v") * F.col("v") - 0.3).alias("q"), F.lit(True).alias("valid"))
    return _out(gr.integrate_direct(g), z=F.col("z"))


@query("P16_flip_vertical", G + " SELECT image_id, CAST(h - 1 - y AS INTEGER) AS y, x, round(v, 5) AS v FROM grid JOIN dims USING (image_id)")
def p16(t):
    return _out(gr.flip_vertical(grid(t)), v=F.col("v"))


@query("P17_decimate_coarse", G + " SELECT image_id, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x, round(v, 5) AS v FROM grid WHERE y % 3 = 0 AND x % 3 = 0")
def p17(t):
    return _out(gr.decimate_coarse(grid(t), 3), v=F.col("v"))


def lerp(y, x):
    """Bilinear value at (y, x) from grid rows a b c d joined on floor/ceil."""
    return f"(1-({y}-floor({y})))*((1-({x}-floor({x})))*a.v+({x}-floor({x}))*b.v)+({y}-floor({y}))*((1-({x}-floor({x})))*c.v+({x}-floor({x}))*d.v)"


def four(src, y, x):
    one = lambda k, yy, xx: f"JOIN grid {k} ON {k}.image_id = {src}.image_id AND {k}.y = {yy} AND {k}.x = {xx}"
    fy, fx = f"floor({y})", f"floor({x})"
    cy, cx = f"least({fy} + 1, {src}.h - 1)", f"least({fx} + 1, {src}.w - 1)"
    return " ".join([one("a", fy, fx), one("b", fy, cx), one("c", cy, fx), one("d", cy, cx)])


@query("P18_decimate_smooth", G + """, o AS (SELECT image_id, h, w, i, unnest(range(w // 3)) AS j FROM (SELECT *, unnest(range(h // 3)) AS i FROM dims)),
 s AS (SELECT *, (i + 0.5e0) * (h / (h // 3)) - 0.5e0 AS sy, (j + 0.5e0) * (w / (w // 3)) - 0.5e0 AS sx FROM o)
SELECT s.image_id, CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x, round(""" + lerp("sy", "sx") + ", 5) AS v FROM s " + four("s", "sy", "sx"))
def p18(t):
    return _out(gr.decimate_smooth(grid(t), ["v"], 3, T), v=F.col("v"))


_CAM = dict(fx=60.0, fy=60.0, cx=19.5, cy=49.5)


@query("M13_undistort", G + """, u AS (SELECT g.image_id, g.y, g.x, h, w, (x - 19.5e0) / 60 AS u, (y - 49.5e0) / 60 AS v FROM grid g JOIN dims USING (image_id)),
 k AS (SELECT *, u*u+v*v AS r2, 1 - 0.1e0*(u*u+v*v) + 0.02e0*pow(u*u+v*v, 2) - 0.001e0*pow(u*u+v*v, 3) AS rad FROM u),
 s AS (SELECT image_id, y, x, h, w, 60*(u*rad + 2*0.001e0*u*v + 0.002e0*(r2+2*u*u)) + 19.5e0 AS sx, 60*(v*rad + 0.001e0*(r2+2*v*v) + 2*0.002e0*u*v) + 49.5e0 AS sy FROM k)
SELECT s.image_id, s.y, s.x, round(""" + lerp("sy", "sx") + ", 5) AS v FROM s " + four("s", "sy", "sx") + " WHERE sy >= 0 AND sx >= 0 AND sy <= s.h - 1 AND sx <= s.w - 1")
def m13(t):
    return _out(gr.undistort(grid(t), ["v"], _CAM, (-0.1, 0.02, -0.001), (0.001, 0.002), T), v=F.col("v"))


@query("P24_valid_pixel", G + """, s AS (SELECT g.image_id, g.y, g.x, h, w, y + 0.37e0 * v - 0.1e0 AS sy, x + 0.61e0 * v - 0.1e0 AS sx FROM grid g JOIN dims USING (image_id)),
 m AS (SELECT s.image_id, s.y, s.x, sy >= 0 AND sx >= 0 AND sy <= s.h - 1 AND sx <= s.w - 1 AS inside, bool_and(n.v > 0.2e0) AS ok FROM s LEFT JOIN grid n ON n.image_id = s.image_id
   AND n.y BETWEEN floor(sy) AND least(floor(sy) + 1, s.h - 1) AND n.x BETWEEN floor(sx) AND least(floor(sx) + 1, s.w - 1) GROUP BY s.image_id, s.y, s.x, sy, sx, s.h, s.w)
SELECT image_id, y, x, inside AND coalesce(ok, false) AS ok FROM m""")
def p24(t):
    g = grid(t)
    wanted = g.select(*KEYS, (F.col("y") + 0.37 * F.col("v") - 0.1).alias("sy"), (F.col("x") + 0.61 * F.col("v") - 0.1).alias("sx"))
    mask = g.select(*KEYS, (F.col("v") > 0.2).alias("valid"))
    return gr.valid_positions(mask, wanted, "sy", "sx", T).select(*KEYS, "ok")


@query("J21_halo", G + """ SELECT CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, image_id, count(*) AS pixels, round(sum(v), 4) AS total FROM grid JOIN dims USING (image_id)
 CROSS JOIN (SELECT unnest(range(7)) AS ty) CROSS JOIN (SELECT unnest(range(3)) AS tx)
 WHERE y BETWEEN ty * 16 - 3 AND ty * 16 + 18 AND x BETWEEN tx * 16 - 3 AND tx * 16 + 18 AND ty <= (h - 1) // 16 AND tx <= (w - 1) // 16 GROUP BY ty, tx, image_id""")
def j21(t):
    out = gr.halo(grid(t), 3, 3, "none", T)
    return out.groupBy("image_id", F.col("_ty").alias("ty"), F.col("_tx").alias("tx")).agg(
        F.count("*").alias("pixels"), F.round(F.sum("v"), 4).alias("total"))


@query("A34_tile_recombine", G + " SELECT image_id, y, x, round(v, 5) AS v FROM grid")
def a34(t):
    tiles = gr.tile_pixels(grid(t), T, 4)
    return _out(gr.tile_recombine(tiles, "v", T, 4), v=F.col("v"))


@query("G18_tile_job")
def g18(t):
    return _out(gr.tile_job(grid(t), "v", gr.local_shrinkage(0.05), T, 4), v=F.col("v"))


@query("A37_image_stats", G + " SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width, round(min(v), 5) AS min, round(max(v), 5) AS max, round(avg(v), 5) AS mean, false AS has_nan, false AS has_inf FROM grid GROUP BY image_id")
def a37(t):
    s = ql.image_stats(grid(t), "v")
    return s.select("image_id", "height", "width", *rounded(min=F.col("min"), max=F.col("max"), mean=F.col("mean")), "has_nan", "has_inf")


_PAIR = ", nz AS (SELECT image_id, y, x, v + 0.03e0 * sin(v * 991) AS v FROM grid)"


def noisy(g):
    return g.withColumn("v", F.col("v") + 0.03 * F.sin(F.col("v") * 991))


@query("A36_psnr", G + _PAIR + " SELECT image_id, round(avg(pow(a.v - b.v, 2)), 7) AS mse, round(10 * log10(1 / avg(pow(a.v - b.v, 2))), 4) AS psnr, CAST(NULL AS VARCHAR) AS error FROM grid a JOIN nz b USING (image_id, y, x) GROUP BY image_id")
def a36(t):
    g = grid(t)
    return ql.psnr(g, noisy(g), "v").select("image_id", F.round("mse", 7).alias("mse"), F.round("psnr", 4).alias("psnr"), "error")


@query("A36_ssim", G + _PAIR + """, w AS (SELECT c.image_id, c.y, c.x, avg(a.v) AS ma, avg(b.v) AS mb, var_samp(a.v) AS va, var_samp(b.v) AS vb, covar_samp(a.v, b.v) AS cv FROM grid c JOIN dims d USING (image_id)
  JOIN grid a ON a.image_id = c.image_id AND a.y BETWEEN c.y - 3 AND c.y + 3 AND a.x BETWEEN c.x - 3 AND c.x + 3 JOIN nz b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x
  WHERE c.y BETWEEN 3 AND d.h - 4 AND c.x BETWEEN 3 AND d.w - 4 GROUP BY c.image_id, c.y, c.x)
SELECT image_id, round(avg((2*ma*mb + 1e-4) * (2*cv + 9e-4) / ((ma*ma + mb*mb + 1e-4) * (va + vb + 9e-4))), 5) AS ssim FROM w GROUP BY image_id""")
def a36_ssim(t):
    g = grid(t)
    return ql.ssim(g, noisy(g), "v", tile=T).select("image_id", F.round("ssim", 5).alias("ssim"))


@query("A35_noise_level", G + """, d AS (SELECT a.image_id, abs(a.v - b.v - c.v + e.v) / 2 AS d FROM grid a JOIN grid b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x + 1
 JOIN grid c ON c.image_id = a.image_id AND c.y = a.y + 1 AND c.x = a.x JOIN grid e ON e.image_id = a.image_id AND e.y = a.y + 1 AND e.x = a.x + 1 WHERE a.y % 2 = 0 AND a.x % 2 = 0)
SELECT image_id, 'c0' AS channel, round(quantile_cont(d, 0.5) / 0.6745e0, 5) AS sigma FROM d GROUP BY image_id""")
def a35(t):
    rows = grid(t).withColumnRenamed("v", "c0")
    return ql.noise_level(rows, ["image_id"], ["c0"], T).select("image_id", "channel", F.round("sigma", 5).alias("sigma"))


@query("A11_images_mean", G + " SELECT y, x, round(avg(v), 5) AS v FROM grid GROUP BY y, x")
def a11(t):
    return ql.images_mean(grid(t), "v").select("y", "x", F.round("v", 5).alias("v"))


@query("A44_normalise", G + """, e AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM grid GROUP BY image_id)
SELECT image_id, y, x, round((v - lo) / (hi - lo), 5) AS scaled, round(v / hi, 5) AS share, CAST(floor((v - lo) / (hi - lo) * 255) AS INTEGER) AS q8, CAST(floor((v - lo) / (hi - lo) * 65535) AS INTEGER) AS q16 FROM grid JOIN e USING (image_id)""")
def a44(t):
    out = ql.normalise_by_max(ql.normalise_minmax(grid(t), "v", ["image_id"]), "v", ["image_id"], "share")
    return out.select(*KEYS, *rounded(scaled=F.col("scaled"), share=F.col("share")), ql.quantise(F.col("scaled")).alias("q8"), ql.quantise(F.col("scaled"), 16).alias("q16"))


@query("A6_bit_depth", "SELECT CAST(l_linenumber AS INTEGER) AS light_id, CASE WHEN max(l_extendedprice) > 255 THEN 65535e0 ELSE 255e0 END AS divider, CASE WHEN max(l_quantity) > 1000 THEN 65536e0 ELSE 255e0 END AS loader FROM lineitem GROUP BY 1")
def a6(t):
    return t.lineitem.groupBy(F.col("l_linenumber").cast("int").alias("light_id")).agg(
        ql.bit_depth(F.max("l_extendedprice")).alias("divider"), ql.loader_divider(F.max("l_quantity")).alias("loader"))


@query("P20_scale_bits", """SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS light_id, round(l_extendedprice / CASE WHEN max(l_extendedprice) OVER (PARTITION BY l_linenumber) > 1000 THEN 65536 ELSE 255 END, 6) AS v FROM lineitem""")
def p20(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("int").alias("light_id"), F.col("l_extendedprice").alias("v"))
    return ql.scale_bits(rows, "v", ["light_id"]).select("l_orderkey", "light_id", F.round("v", 6).alias("v"))


@query("A7_percentile_normalise", """WITH p AS (SELECT l_linenumber, quantile_cont(l_extendedprice, 0.99) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS light_id, round(CASE WHEN p > 0 THEN l_extendedprice / p ELSE l_extendedprice END, 5) AS v FROM lineitem JOIN p USING (l_linenumber)""")
def a7(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("int").alias("light_id"), F.col("l_extendedprice").alias("v"))
    return ql.percentile_normalise(rows, "v", ["light_id"], 0.99).select("l_orderkey", "light_id", F.round("v", 5).alias("v"))
