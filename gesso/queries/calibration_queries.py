"""Colour-chart fits over the part table; p_type is the image."""

from __future__ import annotations

from pyspark.sql import functions as F

from gesso.functions import color as c
from gesso.operators import calibration as cal
from gesso.operators import fits
from gesso.operators import quality as ql
from gesso.plans import calibrate as plan
from gesso.queries import sqltext as q
from gesso.queries.grid_queries import DIMS, gauss_sql
from gesso.queries.standins import Cols, grid, lights, observations, patches, reference, rounded
from gesso.registry import query

PAIRS = "pairs AS (SELECT * FROM patches JOIN reference USING (patch_no))"
HEAD = (q.PATCHES, q.REFERENCE, PAIRS)
IMG = ["image_id"]


def pairs(t):
    return cal.with_reference(patches(t), reference(t))


def chart_pairs(t):
    """One row per image and patch number."""
    p = patches(t).groupBy("image_id", "patch_no").agg(*[F.avg(x).alias(x) for x in cal.MEASURED])
    return cal.with_reference(p, reference(t))


@query("J1_patches_reference", q.with_(*HEAD) + "SELECT patch_id, patch_no, round(c0 - r0, 5) AS d0, round(c1 - r1, 5) AS d1, round(c2 - r2, 5) AS d2 FROM pairs")
def j1(t):
    return pairs(t).select("patch_id", "patch_no", *rounded(**{f"d{i}": F.col(f"c{i}") - F.col(f"r{i}") for i in range(3)}))


_CENTRES = """ce AS (SELECT image_id, k AS patch_no, 5 + (k * 13) % 31 AS px, 3 + (k * 29) % 71 AS py, 8 + k % 3 AS size, w, h FROM dims CROSS JOIN (SELECT unnest(range(1, 25)) AS k)),
 wi AS (SELECT *, greatest(px - size // 2, 0) AS x0, least(px + size // 2, w) AS x1, greatest(py - size // 2, 0) AS y0, least(py + size // 2, h) AS y1 FROM ce)"""


def centres(g):
    from gesso.operators.grid import image_dims

    d = image_dims(g).withColumn("patch_no", F.explode(F.sequence(F.lit(1), F.lit(24))))
    k = F.col("patch_no")
    return d.select("image_id", "patch_no", (5 + (k * 13) % 31).alias("px"), (3 + (k * 29) % 71).alias("py"), (8 + k % 3).alias("size"), F.col("_w").alias("width"), F.col("_h").alias("height"))


@query("A1_patch_means", q.with_(q.GRID, DIMS, _CENTRES) + "SELECT wi.image_id, CAST(patch_no AS INTEGER) AS patch_no, round(avg(v), 5) AS v FROM wi JOIN grid g ON g.image_id = wi.image_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2")
def a1(t):
    g = grid(t)
    return cal.patch_means(g, centres(g), ["v"]).select("image_id", "patch_no", F.round("v", 5).alias("v"))


@query("P15_crop_patch", q.with_(q.GRID, DIMS, _CENTRES) + "SELECT wi.image_id, CAST(patch_no AS INTEGER) AS patch_no, CAST(y - y0 AS INTEGER) AS in_y, CAST(x - x0 AS INTEGER) AS in_x, round(v, 5) AS v FROM wi JOIN grid g ON g.image_id = wi.image_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def p15(t):
    g = grid(t)
    return cal.crop_patch(g, centres(g)).select("image_id", "patch_no", F.col("in_y").cast("int").alias("in_y"), F.col("in_x").cast("int").alias("in_x"), F.round("v", 5).alias("v"))


@query("G22_patch_mosaic", q.with_(q.GRID, DIMS, _CENTRES) + "SELECT wi.image_id, CAST((patch_no - 1) // 6 * 12 + y - y0 AS INTEGER) AS y, CAST((patch_no - 1) % 6 * 12 + x - x0 AS INTEGER) AS x, round(v, 5) AS v FROM wi JOIN grid g ON g.image_id = wi.image_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def g22_mosaic(t):
    g = grid(t)
    return cal.patch_mosaic(g, centres(g), 12).select("image_id", "y", "x", F.round("v", 5).alias("v"))


@query("A3_brightest_patch", q.with_(q.PATCHES) + ", m AS (SELECT image_id, patch_no, avg((c0+c1+c2)/3) AS m FROM patches GROUP BY 1, 2) SELECT image_id, arg_max(patch_no, m) - 1 AS brightest, arg_max(patch_no, m) - 1 = 18 AS upright FROM m GROUP BY image_id")
def a3(t):
    p = patches(t).groupBy("image_id", "patch_no").agg(*[F.avg(x).alias(x) for x in cal.MEASURED])
    return cal.brightest_patch(p)


_DE = ", ".join([
    "pr AS (SELECT *, " + ", ".join(f"{e} AS {n}" for e, n in zip(q.lab(["c0", "c1", "c2"]), ["l1", "a1", "b1"])) + ", "
    + ", ".join(f"{e} AS {n}" for e, n in zip(q.lab(["r0", "r1", "r2"]), ["l2", "a2", "b2"])) + " FROM pairs)",
    q.ciede_ctes("pr", "step, image_id, patch_id, patch_no"),
])


def scored(t):
    return c.add_delta_e(pairs(t), Cols("c0", "c1", "c2"), Cols("r0", "r1", "r2"), "de00")


@query("A2_step_stats", q.with_(*HEAD, _DE) + "SELECT step, round(avg(de00), 4) AS mean, round(stddev_pop(de00), 4) AS sd, round(max(de00), 4) AS max, round(min(de00), 4) AS min FROM de GROUP BY step")
def a2(t):
    s = cal.step_stats(scored(t), ["step"])
    return s.select("step", *rounded(4, mean=F.col("mean"), sd=F.col("sd"), max=F.col("max"), min=F.col("min")))


@query("X1_union_steps", q.with_(*HEAD, _DE) + "SELECT step, CAST(patch_no AS INTEGER) AS patch_no, round(avg(de00), 4) AS de00 FROM de GROUP BY step, patch_no UNION ALL SELECT 'all', CAST(patch_no AS INTEGER), round(avg(de00), 4) FROM de GROUP BY patch_no")
def x1(t):
    s = scored(t)
    one = s.groupBy("step", "patch_no").agg(F.round(F.avg("de00"), 4).alias("de00"))
    return one.unionByName(s.groupBy("patch_no").agg(F.round(F.avg("de00"), 4).alias("de00")).withColumn("step", F.lit("all")))


def _fit_sql(features, clip=True, weight="1e0", inside=False):
    def out(i):
        e = f"fitted{i}"
        e = q.clip01(e) if clip else e
        return f"CASE WHEN c{i} BETWEEN 0.2e0 AND 0.8e0 THEN {e} ELSE c{i} END" if inside else e

    return q.with_(*HEAD, q.fit_ctes("pairs", IMG, features, ["r0", "r1", "r2"], ["image_id", "patch_id", "c0", "c1", "c2"], weight=weight)) + \
        "SELECT patch_id, " + ", ".join(f"round({out(i)}, 4) AS o{i}" for i in range(3)) + " FROM fit"


def _fitted(t, features, **kw):
    p = pairs(t)
    weight = kw.pop("weight", None)
    out = cal.apply_color(p, cal.fit_color(p, IMG, features, weight), IMG, features, **kw)
    return out.select("patch_id", *rounded(4, **{f"o{i}": F.col(f"c{i}") for i in range(3)}))


@query("A18_fit_affine_color", _fit_sql(["c0", "c1", "c2", "1"]))
def a18(t):
    return _fitted(t, cal.affine_features)


@query("A20_fit_root_polynomial", _fit_sql(["c0", "c1", "c2", "sqrt(c0*c1)", "sqrt(c1*c2)", "sqrt(c0*c2)"]))
def a20(t):
    return _fitted(t, cal.root_features)


_W2 = "CASE WHEN patch_no >= 19 THEN pow(1/6e0, 2) ELSE pow(1/18e0, 2) END"


@query("A22_fit_poly_color", _fit_sql(["1", "c0", "c1", "c2", "c0*c0", "c0*c1", "c0*c2", "c1*c1", "c1*c2", "c2*c2"], weight=_W2, inside=True))
def a22(t):
    return _fitted(t, lambda v: cal.polynomial_features(v, 2), weight=F.pow(cal.patch_weights(1 / 6, 1 / 18), F.lit(2)), inside=(0.2, 0.8))


@query("A19_fit_ridge_color")
def a19(t):
    return cal.fit_ridge(pairs(t), IMG).select("image_id", F.round("alpha", 5).alias("alpha"), *[F.round(F.col("coef")[i], 4).alias(f"w{i}") for i in range(9)])


@query("A21_fit_wls_gain", q.with_(*HEAD) + "SELECT image_id, " + ", ".join(f"round(sum(w*c{i}*r{i})/sum(w*r{i}*r{i}), 5) AS g{i}" for i in range(3)) + " FROM (SELECT *, CASE WHEN patch_no >= 19 THEN 1/6e0 ELSE 1/18e0 END AS w FROM pairs) GROUP BY image_id")
def a21(t):
    return cal.fit_wls_gain(pairs(t), IMG).select("image_id", *rounded(g0=F.col("g0"), g1=F.col("g1"), g2=F.col("g2")))


@query("A23_validate_fit", q.with_(*HEAD, q.fit_ctes("pairs", IMG, ["c0", "c1", "c2", "1"], ["r0", "r1", "r2"], ["image_id", "r0", "r1", "r2"])) + "SELECT image_id, round(avg((pow(fitted0-r0,2)+pow(fitted1-r1,2)+pow(fitted2-r2,2))/3), 6) AS mse FROM fit GROUP BY image_id")
def a23(t):
    p = pairs(t)
    out = cal.apply_color(p, cal.fit_color(p, IMG, cal.affine_features), IMG, cal.affine_features, clip=False)
    return cal.validate_fit(out, IMG).select("image_id", F.round("mse", 6).alias("mse"))


def _hsv_of(prefix, name):
    enc = ", ".join(f"{e} AS {n}" for e, n in zip(q.xyz_to_srgb([f"{prefix}{i}" for i in range(3)]), "rgb"))
    return f"e{name} AS (SELECT image_id, patch_no, {enc} FROM chart), " + q.hsv_ctes(f"e{name}", name)


@query("A24_exposure_params", q.with_(q.PATCHES, q.REFERENCE, "chart AS (SELECT image_id, patch_no, avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2, any_value(r0) AS r0, any_value(r1) AS r1, any_value(r2) AS r2 FROM patches JOIN reference USING (patch_no) GROUP BY 1, 2)", _hsv_of("c", "hm"), _hsv_of("r", "hr")) + """
 , k AS (SELECT m.image_id, max(m.val) FILTER (patch_no = 19) AS mw, max(m.val) FILTER (patch_no = 24) AS mb, max(m.s) FILTER (patch_no = 15) AS mr, max(r.val) FILTER (patch_no = 19) AS rw, max(r.val) FILTER (patch_no = 24) AS rb, max(r.s) FILTER (patch_no = 15) AS rr FROM hm m JOIN hr r USING (image_id, patch_no) GROUP BY m.image_id)
SELECT image_id, round(rb, 5) AS low, round(rw - rb, 5) AS expected_range, round(mw - mb, 5) AS measured_range, round(mr / rr, 5) AS saturation_ratio, round(mb, 5) AS measured_black FROM k""")
def a24(t):
    p = cal.exposure_params(chart_pairs(t), IMG)
    return p.select("image_id", *rounded(**{k: F.col(k) for k in ("low", "expected_range", "measured_range", "saturation_ratio", "measured_black")}))


@query("A49_flat_gain", q.with_(q.GRID) + "SELECT image_id, y, x, round(v / avg(v) OVER w, 5) AS gain, abs(avg(v) OVER w - 1) > 0.01e0 AS warning FROM grid WINDOW w AS (PARTITION BY image_id)")
def a49(t):
    return cal.flat_gain(grid(t), "v").select("image_id", "y", "x", F.round("gain", 5).alias("gain"), "warning")


@query("A49_grey_gain", q.with_(q.PATCHES) + ", g AS (SELECT image_id, max(c0) AS a, max(c1) AS b, max(c2) AS c FROM patches WHERE patch_no = 22 GROUP BY image_id) SELECT image_id, round((a+b+c)/3/a, 5) AS gain_c0, round((a+b+c)/3/b, 5) AS gain_c1, round((a+b+c)/3/c, 5) AS gain_c2 FROM g")
def a49_grey(t):
    return cal.grey_gain(patches(t), IMG).select("image_id", *rounded(gain_c0=F.col("gain_c0"), gain_c1=F.col("gain_c1"), gain_c2=F.col("gain_c2")))


def colour_image(t):
    v = F.col("v")
    return grid(t).select("image_id", "y", "x", (0.2 + 0.6 * v).alias("c0"), (0.7 - 0.4 * v).alias("c1"), (0.3 + 0.5 * v * v).alias("c2"))


_COLOUR = "ci AS (SELECT image_id, y, x, 0.2e0 + 0.6e0*v AS c0, 0.7e0 - 0.4e0*v AS c1, 0.3e0 + 0.5e0*v*v AS c2 FROM grid)"
_ENCODED = "en AS (SELECT image_id, y, x, " + ", ".join(f"{e} AS {n}" for e, n in zip(q.xyz_to_srgb(["c0", "c1", "c2"]), "rgb")) + " FROM ci)"


@query("A50_flat_plane", q.with_(q.GRID, DIMS, _COLOUR, _ENCODED, "pl AS (SELECT image_id, y, x, greatest(r, g, b) AS v FROM en)", gauss_sql(2.0, ("v",), "pl"))
       + "SELECT image_id, y, x, round(v + 1 - max(v) OVER (PARTITION BY image_id), 5) AS plane FROM low")
def a50(t):
    return cal.flat_plane(colour_image(t), 2.0, 16).select("image_id", "y", "x", F.round("plane", 5).alias("plane"))


@query("J18_calibration_plane", q.with_(q.GRID) + ", p AS (SELECT y, x, avg(v) + 0.5e0 AS plane FROM grid GROUP BY y, x) SELECT image_id, y, x, round(v / plane, 5) AS v FROM grid JOIN p USING (y, x)")
def j18(t):
    g = grid(t)
    plane = ql.images_mean(g, "v").select("y", "x", (F.col("v") + 0.5).alias("plane"))
    return g.join(plane, ["y", "x"]).select("image_id", "y", "x", F.round(F.col("v") / F.col("plane"), 5).alias("v"))


_DECODED = [f"(CASE WHEN {e} <= 0.04045e0 THEN {e} / 12.92e0 ELSE pow(({e} + 0.055e0) / 1.055e0, 2.4e0) END)" for e in ("r2", "g2", "b2")]


@query("A50_apply_flat_plane", q.with_(
    q.GRID, "p AS (SELECT y, x, avg(v) + 0.5e0 AS plane FROM grid GROUP BY y, x)", _COLOUR, _ENCODED, q.hsv_ctes("en", "hs"),
    "mv AS (SELECT image_id, y, x, h, s, val / plane AS val FROM hs JOIN p USING (y, x))", q.hsv_to_rgb_ctes("mv", "bk"))
    + "SELECT image_id, y, x, " + ", ".join(f"round({e}, 4) AS c{i}" for i, e in enumerate(q.matrix(c.SRGB_LINEAR_MATRIX, _DECODED))) + " FROM bk")
def a50_apply(t):
    img = colour_image(t)
    plane = ql.images_mean(grid(t), "v").select("y", "x", (F.col("v") + 0.5).alias("plane"))
    return cal.apply_flat_plane(img, plane).select("image_id", "y", "x", *rounded(4, c0=F.col("c0"), c1=F.col("c1"), c2=F.col("c2")))


@query("P23_step_enabled", """WITH p AS (SELECT DISTINCT p_brand AS image_id, p_type AS step FROM part), k AS (SELECT p_brand AS image_id, p_type AS step, bool_or(p_size = 50) AS skip, bool_or(p_size < 40) AS has_params FROM part GROUP BY 1, 2)
SELECT image_id, step FROM p JOIN k USING (image_id, step) WHERE NOT skip AND has_params""")
def p23(t):
    planned = t.part.select(F.col("p_brand").alias("image_id"), F.col("p_type").alias("step")).distinct()
    conf = t.part.groupBy(F.col("p_brand").alias("image_id"), F.col("p_type").alias("step")).agg(
        F.bool_or(F.col("p_size") == 50).alias("skip"), F.bool_or(F.col("p_size") < 40).alias("has_params"))
    return cal.step_enabled(planned, conf, "replay")


@query("G22_calibrate")
def g22(t):
    _, report, _ = plan.calibrate(chart_pairs(t))
    return report.select("image_id", "step", F.round("error", 3).alias("error"), "applied")


@query("G21_replay_corrections")
def g21(t):
    _, _, params = plan.calibrate(chart_pairs(t))
    out = plan.replay(patches(t), params, "image_id")
    return out.select("patch_id", *rounded(3, c0=F.col("c0"), c1=F.col("c1"), c2=F.col("c2")))


PTS = "pts AS (SELECT CAST(o_custkey % 8 AS INTEGER) AS group_id, 50 + 20 * cos(o_orderkey * 0.37e0) + o_totalprice / 499979.7e0 AS x, 30 + 20 * sin(o_orderkey * 0.37e0) - o_totalprice / 999959.4e0 AS y FROM orders)"


def circle_points(t):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return t.orders.select((F.col("o_custkey") % 8).cast("int").alias("group_id"),
                           (50 + 20 * F.cos(k * 0.37) + price / 499979.7).alias("x"), (30 + 20 * F.sin(k * 0.37) - price / 999959.4).alias("y"))


@query("A25_fit_circle", q.with_(PTS) + """, m AS (SELECT *, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM pts WINDOW w AS (PARTITION BY group_id)),
 s AS (SELECT group_id, any_value(mx) AS mx, any_value(my) AS my, sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv, sum(u*u*u+u*v*v)/2 AS ru, sum(v*v*v+u*u*v)/2 AS rv FROM m GROUP BY group_id),
 c AS (SELECT group_id, mx + (ru*vv-rv*uv)/(uu*vv-uv*uv) AS cx, my + (rv*uu-ru*uv)/(uu*vv-uv*uv) AS cy FROM s)
SELECT group_id, round(any_value(cx), 5) AS cx, round(any_value(cy), 5) AS cy, round(sqrt(avg(pow(x-cx,2)+pow(y-cy,2))), 5) AS r FROM pts JOIN c USING (group_id) GROUP BY group_id""")
def a25(t):
    return fits.fit_circle(circle_points(t), ["group_id"]).select("group_id", *rounded(cx=F.col("cx"), cy=F.col("cy"), r=F.col("r")))


@query("A26_fit_circle_geometric")
def a26(t):
    p, cost = fits.fit_circle_geometric(circle_points(t))
    return t.spark.createDataFrame([(*(round(float(v), 5) for v in p), round(cost, 3))], "cx double, cy double, r double, cost double")


@query("A26_fit_sphere")
def a26_sphere(t):
    k = F.col("o_orderkey")
    pts = t.orders.select((3 + 9 * F.sin(k * 0.11) * F.cos(k * 0.37)).alias("x"), (1 + 9 * F.sin(k * 0.11) * F.sin(k * 0.37)).alias("y"), (9 * F.cos(k * 0.11) + F.col("o_totalprice") / 4999797.0).alias("z"))
    p, cost = fits.fit_sphere(pts, [0.0, 0.0, 0.0, 5.0])
    return t.spark.createDataFrame([(*(round(float(v), 5) for v in p), round(cost, 3))], "cx double, cy double, cz double, r double, cost double")


@query("G17_nlls_fit")
def g17(t):
    xy = t.lineitem.select((F.col("l_quantity") / 50).alias("x"), (2.0 * F.exp(-1.5 * F.col("l_quantity") / 50) + F.col("l_discount")).alias("y"))
    x = F.col("x")
    p, cost = fits.nlls_fit(xy, lambda a: a[0] * F.exp(-a[1] * x), lambda a: [F.exp(-a[1] * x), -a[0] * x * F.exp(-a[1] * x)], "y", [1.0, 1.0], [0.0, 0.0], [10.0, 5.0])
    return t.spark.createDataFrame([(*(round(float(v), 4) for v in p), round(cost, 3))], "a double, b double, cost double")


@query("G16_refine_lights")
def g16(t):
    out = fits.refine_lights(observations(t), lights(t), ["pixel"])
    return out.select("light_id", *rounded(4, lx=F.col("lx"), ly=F.col("ly"), lz=F.col("lz")))
