"""Matching and alignment queries over embeddings, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gesso.functions import geometry as g
from gesso.operators import matching as m
from gesso.plans import mosaic as mo
from gesso.queries import sqltext as q
from gesso.queries.catalog_queries import CELLS, cells
from gesso.queries.grid_queries import DIMS
from gesso.queries.standins import grid, rounded
from gesso.registry import query

_DIR = ", ".join(f"('{k}', {r}, {c})" for k, (r, c) in m.DIRECTIONS.items())
DIRS = f"dirs(dir, dr, dc) AS (VALUES {_DIR})"
KP = """kp AS (SELECT CAST(label // 4 AS INTEGER) AS row, CAST(label % 4 AS INTEGER) AS col, vec_id AS kp, CAST(vec_id % 97 AS DOUBLE) AS x, CAST(vec_id * 7 % 89 AS DOUBLE) AS y, embedding AS desc_ FROM embeddings)"""


def keypoints(t):
    k, lab = F.col("vec_id"), F.col("label")
    return t.embeddings.select(F.floor(lab / 4).cast("int").alias("row"), (lab % 4).cast("int").alias("col"), k.alias("kp"),
                               (k % 97).cast("double").alias("x"), (k * 7 % 89).cast("double").alias("y"), F.col("embedding").alias("desc"))


@query("J5_cell_neighbours", q.with_(CELLS, DIRS) + "SELECT a.row, a.col, dir, b.row AS nrow, b.col AS ncol FROM cells a CROSS JOIN dirs JOIN cells b ON b.row = a.row + dr AND b.col = a.col + dc")
def j5(t):
    return m.cell_neighbours(cells(t).select("row", "col"))


def _facing(x, y, flip):
    r, l_, b, t_ = f"{x} >= 48.5e0", f"{x} < 48.5e0", f"{y} >= 44.5e0", f"{y} < 44.5e0"
    if flip:
        r, l_, b, t_ = l_, r, t_, b
    parts = {"right": r, "left": l_, "bottom": b, "top": t_, "bottom_right": f"{r} AND {b}", "bottom_left": f"{l_} AND {b}", "top_right": f"{r} AND {t_}", "top_left": f"{l_} AND {t_}"}
    return "CASE dir " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in parts.items()) + " END"


@query("P14_overlap_half", q.with_(KP, DIRS) + f"SELECT dir, count(*) FILTER ({_facing('x', 'y', False)}) AS src, count(*) FILTER ({_facing('x', 'y', True)}) AS dst FROM kp CROSS JOIN dirs GROUP BY dir")
def p14(t):
    k = keypoints(t).withColumn("dir", F.explode(F.array(*map(F.lit, m.DIRECTIONS))))
    args = (F.col("x"), F.col("y"), F.lit(97.0), F.lit(89.0), F.col("dir"))
    return k.groupBy("dir").agg(F.count_if(m.in_overlap(*args, True)).alias("src"), F.count_if(m.in_overlap(*args, False)).alias("dst"))


_NN = f"""nn AS (SELECT a.row, a.col, dir, a.kp, b.kp AS match, sqrt(list_sum(list_transform(list_zip(a.desc_, b.desc_), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2)))) AS distance
 FROM kp a CROSS JOIN dirs JOIN kp b ON b.row = a.row + dr AND b.col = a.col + dc WHERE {_facing('a.x', 'a.y', False)} AND {_facing('b.x', 'b.y', True)}),
 rk AS (SELECT *, row_number() OVER (PARTITION BY row, col, dir, kp ORDER BY distance, match) AS rank FROM nn)"""


def candidates(t):
    return m.two_nearest(keypoints(t), 97, 89, block=64)


@query("J6_two_nearest_ratio", q.with_(KP, DIRS, _NN) + """SELECT row, col, dir, kp, arg_min(match, rank) AS match, round(min(distance), 5) AS distance, coalesce(min(distance) < 0.8e0 * max(distance) FILTER (rank = 2), false) AS good
 FROM rk WHERE rank <= 2 GROUP BY row, col, dir, kp""")
def j6(t):
    return m.ratio_matches(candidates(t), 0.8).select("row", "col", "dir", "kp", "match", F.round("distance", 5).alias("distance"), "good")


@query("W2_two_nearest", q.with_(KP, DIRS, _NN) + "SELECT row, col, dir, kp, match, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 2")
def w2(t):
    return candidates(t).select("row", "col", "dir", "kp", "match", "rank")


@query("A38_match_summary", q.with_(KP, DIRS, _NN) + """, f AS (SELECT row, col, dir, kp, min(distance) AS d, max(distance) FILTER (rank = 2) AS s FROM rk WHERE rank <= 2 GROUP BY row, col, dir, kp)
SELECT row, col, dir, count(*) AS raw, count(*) FILTER (d < 0.9e0 * s) AS good, count(*) FILTER (d < 0.9e0 * s AND kp % 3 <> 0) AS inliers FROM f GROUP BY row, col, dir HAVING count(*) FILTER (d < 0.9e0 * s AND kp % 3 <> 0) >= 1""")
def a38(t):
    r = m.ratio_matches(candidates(t), 0.9).withColumn("inlier", F.col("kp") % 3 != 0)
    return m.match_summary(r, ["row", "col", "dir"], 1)


@query("M31_match_score", q.with_(KP) + "SELECT kp, round(1 / (sqrt(x*x + y*y) + 1e-6), 5) AS score FROM kp")
def m31(t):
    k = keypoints(t)
    return k.select("kp", F.round(m.match_score(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)), 5).alias("score"))


@query("W1_cap_matches_per_pair", """SELECT l_suppkey, l_orderkey, l_partkey, CAST(p AS INTEGER) AS place FROM (SELECT l_suppkey, l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY 1/(l_extendedprice+1e-6) DESC, l_orderkey * 1000000 + l_partkey) AS p FROM lineitem) WHERE p <= 5""")
def w1(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", m.match_score(F.col("l_extendedprice")).alias("score"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("kp"))
    return m.cap_matches_per_pair(rows, ["l_suppkey"], 5).select("l_suppkey", "l_orderkey", "l_partkey", "place")


TIES = """ties AS (SELECT CAST(o_custkey % 12 AS INTEGER) AS pair, o_orderkey AS point_no, o_totalprice / 12999.37e0 AS x1, (o_orderkey * 31 % 997) / 9.91e0 AS y1,
  0.98e0 * (o_totalprice / 12999.37e0) - 0.05e0 * ((o_orderkey * 31 % 997) / 9.91e0) + 30 + CASE WHEN o_orderkey % 5 = 0 THEN 25 ELSE 0.2e0 END * sin(o_orderkey * 1.7e0) AS x2,
  0.05e0 * (o_totalprice / 12999.37e0) + 0.98e0 * ((o_orderkey * 31 % 997) / 9.91e0) - 7 + CASE WHEN o_orderkey % 5 = 0 THEN 25 ELSE 0.2e0 END * cos(o_orderkey * 1.3e0) AS y2 FROM orders)"""
ERR = "er AS (SELECT *, sqrt(pow(0.98e0*x1 - 0.05e0*y1 + 30 - x2, 2) + pow(0.05e0*x1 + 0.98e0*y1 - 7 - y2, 2)) AS error FROM ties)"


def ties(t):
    k = F.col("o_orderkey")
    x1, y1 = F.col("o_totalprice") / 12999.37, (k * 31 % 997) / 9.91
    wild = F.when(k % 5 == 0, 25.0).otherwise(0.2)
    return t.orders.select(
        (F.col("o_custkey") % 12).cast("int").alias("pair"), k.alias("point_no"), x1.alias("x1"), y1.alias("y1"),
        (0.98 * x1 - 0.05 * y1 + 30 + wild * F.sin(k * 1.7)).alias("x2"), (0.05 * x1 + 0.98 * y1 - 7 + wild * F.cos(k * 1.3)).alias("y2"))


def tie_errors(t):
    h = g.lit_matrix([0.98, -0.05, 30, 0.05, 0.98, -7, 0, 0, 1])
    return m.reprojection_error(ties(t).withColumn("h", h))


@query("P22_error_below", q.with_(TIES, ERR) + "SELECT pair, point_no, round(error, 5) AS error FROM er WHERE error <= 1.5e0")
def p22(t):
    return m.error_below(tie_errors(t), 1.5).select("pair", "point_no", F.round("error", 5).alias("error"))


@query("O2_best_ties", q.with_(TIES, ERR) + "SELECT point_no, round(error, 5) AS error FROM er ORDER BY er.error, point_no LIMIT 50")
def o2(t):
    return m.best_ties(tie_errors(t), 50).select("point_no", F.round("error", 5).alias("error"))


@query("A39_error_summary", q.with_(TIES, ERR) + "SELECT pair, count(x1) AS n1, count(x2) AS n2, round(avg(error), 5) AS mean, round(max(error), 5) AS max, CAST(NULL AS VARCHAR) AS problem FROM er GROUP BY pair")
def a39(t):
    return m.error_summary(tie_errors(t), ["pair"]).select("pair", "n1", "n2", F.round("mean", 5).alias("mean"), F.round("max", 5).alias("max"), "problem")


@query("A51_reprojection_mean", q.with_(TIES, ERR) + "SELECT round(sum(error*error)/2/count(*), 5) AS mean_cost FROM er")
def a51(t):
    return m.reprojection_mean(tie_errors(t)).select(F.round("mean_cost", 5).alias("mean_cost"))


@query("J22_pair_points", """WITH a AS (SELECT o_orderkey AS n, o_totalprice AS x FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT l_orderkey AS n, max(l_extendedprice) AS x FROM lineitem GROUP BY 1)
SELECT coalesce(a.n, b.n) AS n, CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN 'both' WHEN a.x IS NOT NULL THEN 'first' ELSE 'second' END AS found FROM a FULL JOIN b ON a.n = b.n""")
def j22(t):
    a = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("n"), F.col("o_totalprice").alias("x"), F.lit(0.0).alias("y"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("n")).agg(F.max("l_extendedprice").alias("x")).withColumn("y", F.lit(0.0))
    return m.pair_points(a, b, ["n"]).select("n", "found")


@query("G9_ransac_similarity")
def g9(t):
    out = m.ransac_similarity(ties(t), ["pair"], "point_no")
    return out.select("pair", *rounded(3, a=F.col("a"), b=F.col("b"), tx=F.col("tx"), ty=F.col("ty")), "inliers", "threshold")


def grid_steps(t):
    """Pairwise transforms between neighbouring cells, from label positions."""
    n = m.cell_neighbours(cells(t).select("row", "col")).where(F.col("dir").isin("right", "left", "top", "bottom"))
    dr, dc = F.col("nrow") - F.col("row"), F.col("ncol") - F.col("col")
    jit = F.sin((F.col("row") * 7 + F.col("col") * 3).cast("double"))
    zero, one = F.lit(0.0), F.lit(1.0)
    return n.select("row", "col", "dir", F.array(one, zero, 100.0 * dc + jit, zero, one, -80.0 * dr + jit * 2, zero, zero, one).alias("h"))


_J = "sin((r * 7 + c * 3)::DOUBLE)"


@query("G7_propagate_transforms", "WITH " + CELLS + """, ce AS (SELECT max(row) // 2 AS cr, max(col) // 2 AS cc FROM cells),
 st AS (SELECT row AS r, col AS c, sin((row * 7 + col * 3)::DOUBLE) AS j FROM cells),
 a AS (SELECT t.row, t.col, (SELECT coalesce(sum(j), 0) FROM st, ce WHERE r = cr AND ((t.col > cc AND c >= cc AND c < t.col) OR (t.col < cc AND c <= cc AND c > t.col))) + (SELECT coalesce(sum(j), 0) FROM st, ce WHERE c = t.col AND ((t.row > cr AND r >= cr AND r < t.row) OR (t.row < cr AND r <= cr AND r > t.row))) AS pa,
  (SELECT coalesce(sum(j), 0) FROM st, ce WHERE c = cc AND ((t.row > cr AND r >= cr AND r < t.row) OR (t.row < cr AND r <= cr AND r > t.row))) + (SELECT coalesce(sum(j), 0) FROM st, ce WHERE r = t.row AND ((t.col > cc AND c >= cc AND c < t.col) OR (t.col < cc AND c <= cc AND c > t.col))) AS pb FROM cells t)
SELECT row, col, round(100 * (col - cc) + (pa + pb) / 2, 5) AS tx, round(-80 * (row - cr) + pa + pb, 5) AS ty FROM a, ce""")
def g7(t):
    out = mo.propagate_transforms(grid_steps(t), cells(t).select("row", "col"))
    return out.select("row", "col", F.round(F.col("h")[2], 5).alias("tx"), F.round(F.col("h")[5], 5).alias("ty"))


@query("A42_average_paths", """SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE (o_totalprice + o_custkey) / 2 END, 4) AS v FROM orders""")
def a42(t):
    a = F.array(F.col("o_totalprice"))
    b = F.when(F.col("o_orderkey") % 3 != 0, F.array(F.col("o_custkey").cast("double")))
    return t.orders.select("o_orderkey", F.round(mo.average_paths(a, b)[0], 4).alias("v"))


IMG_H = "th AS (SELECT image_id, 1e0 AS h0, 0.02e0 AS h1, 30e0*image_id + 0.31e0 AS h2, -0.02e0 AS h3, 1e0 AS h4, 5.2e0*image_id + 0.4e0 AS h5, h, w FROM dims)"


def image_transforms(g_):
    i = F.col("image_id")
    zero, one = F.lit(0.0), F.lit(1.0)
    return g_.select("image_id").distinct().select("image_id", F.array(one, F.lit(0.02), 30.0 * i + 0.31, F.lit(-0.02), one, 5.2 * i + 0.4, zero, zero, one).alias("h"))


@query("A27_extents", q.with_(q.GRID, DIMS, IMG_H) + """, c AS (SELECT image_id, h0*cx + h1*cy + h2 AS px, h3*cx + h4*cy + h5 AS py FROM th CROSS JOIN (VALUES (0, 0), (40, 0), (40, 100), (0, 100)) k(cx, cy))
SELECT image_id, CAST(trunc(min(px) - 0.5e0) AS INTEGER) AS x0, CAST(trunc(min(py) - 0.5e0) AS INTEGER) AS y0, CAST(trunc(max(px) + 0.5e0) AS INTEGER) AS x1, CAST(trunc(max(py) + 0.5e0) AS INTEGER) AS y1 FROM c GROUP BY image_id""")
def a27(t):
    return mo.extents(image_transforms(grid(t)), 40, 100, ["image_id"])


_WARP = """, bx AS (SELECT *, CAST(floor(least(h2, h0*(w-1)+h2, h1*(h-1)+h2)) AS INTEGER) AS x0, CAST(ceil(h0*(w-1)+h1*(h-1)+h2) AS INTEGER) AS x1, CAST(floor(h3*(w-1)+h5) AS INTEGER) AS y0, CAST(ceil(h4*(h-1)+h5) AS INTEGER) AS y1 FROM th),
 pp AS (SELECT *, unnest(range(x0, x1 + 1)) AS px FROM (SELECT *, unnest(range(y0, y1 + 1)) AS py FROM bx)),
 s AS (SELECT image_id, h, w, px, py, (h4*(px-h2) - h1*(py-h5)) / (h0*h4-h1*h3) AS sx, (h0*(py-h5) - h3*(px-h2)) / (h0*h4-h1*h3) AS sy FROM pp)"""


def _warp_select():
    from gesso.queries.grid_queries import four, lerp

    return "SELECT s.image_id, CAST(py AS INTEGER) AS py, CAST(px AS INTEGER) AS px, " + lerp("sy", "sx") + " AS v FROM s " + four("s", "sy", "sx") + " WHERE sy >= 0 AND sx >= 0 AND sy <= s.h - 1 AND sx <= s.w - 1"


@query("G19_warp_to_panorama", q.with_(q.GRID, DIMS, IMG_H) + _WARP + ", wv AS (" + _warp_select() + ") SELECT image_id, py, px, round(v, 5) AS v FROM wv")
def g19(t):
    g_ = grid(t)
    return mo.warp_to_panorama(g_, image_transforms(g_), ["v"], 16, 16).select("image_id", "py", "px", F.round("v", 5).alias("v"))


@query("W9_paint_by_spiral", q.with_(q.GRID, DIMS, IMG_H) + _WARP + ", wv AS (" + _warp_select() + ") SELECT py, px, round(arg_max(v, image_id * 7 % 5 * 1000 + image_id), 5) AS v FROM wv WHERE v > 0 GROUP BY py, px")
def w9(t):
    g_ = grid(t)
    warped = mo.warp_to_panorama(g_, image_transforms(g_), ["v"], 16, 16)
    i = F.col("image_id")
    ranks = g_.select("image_id").distinct().withColumn("spiral_rank", i * 7 % 5 * 1000 + i)
    return mo.paint_by_spiral(warped, ranks, ["v"]).select("py", "px", F.round("v", 5).alias("v"))


@query("P25_paint_mask", q.with_(q.PATCHES) + "SELECT patch_id FROM patches WHERE c0 - 0.2e0 > 0 AND c1 - 0.3e0 > 0 AND c2 > 0")
def p25(t):
    from gesso.queries.standins import patches

    p = patches(t).withColumns({"c0": F.col("c0") - 0.2, "c1": F.col("c1") - 0.3})
    return mo.paint_mask(p, ["c0", "c1", "c2"]).select("patch_id")


@query("G8_bundle_adjust")
def g8(t):
    """Two mosaics of 13 cells in a row; ties between consecutive cells."""
    rows = ties(t).select(
        (F.col("point_no") % 2).cast("int").alias("mosaic"), F.col("pair").alias("c1"), F.col("x2").alias("x1"), F.col("y2").alias("y1"),
        (F.col("pair") + 1).alias("c2"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    cell = rows.select("mosaic", F.explode(F.array("c1", "c2")).alias("cell")).distinct()
    start = cell.withColumns({"h": g.lit_matrix(g.IDENTITY9), "anchor": F.col("cell") == 0})
    out = mo.bundle_adjust(rows, start, tolerance=1e-3)
    return out.select("mosaic", "cell", F.round(F.col("h")[2], 2).alias("tx"), F.round(F.col("h")[5], 2).alias("ty"))


@query("G8_bundle_adjust_homography")
def g8_homography(t):
    """The same ties, homographies from the affine start."""
    rows = ties(t).select(
        (F.col("point_no") % 2).cast("int").alias("mosaic"), F.col("pair").alias("c1"), F.col("x2").alias("x1"), F.col("y2").alias("y1"),
        (F.col("pair") + 1).alias("c2"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    cell = rows.select("mosaic", F.explode(F.array("c1", "c2")).alias("cell")).distinct()
    start = cell.withColumns({"h": g.lit_matrix(g.IDENTITY9), "anchor": F.col("cell") == 0})
    affine = mo.bundle_adjust(rows, start, rounds=2).withColumn("anchor", F.col("cell") == 0)
    out = mo.bundle_adjust_homography(rows, affine, rounds=4)
    return out.select("mosaic", "cell", F.round(F.col("h")[2], 1).alias("tx"), F.round(F.col("h")[5], 1).alias("ty"))


@query("J19_mesh_transform", "WITH " + CELLS + """, ce AS (SELECT *, row % 3 = 0 AS has FROM cells) SELECT row, col, CASE WHEN has THEN round(100e0 * col, 4) ELSE 0 END AS x, CASE WHEN has THEN round(20000 - 80e0 * row - 8742, 4) ELSE 0 END AS y FROM ce""")
def j19(t):
    c = cells(t).select("row", "col")
    zero, one = F.lit(0.0), F.lit(1.0)
    tr = c.where("row % 3 = 0").select("row", "col", F.array(one, zero, 100.0 * F.col("col"), zero, one, 80.0 * F.col("row"), zero, zero, one).alias("h"))
    out = mo.transforms_for_meshes(c, tr, 20000, 8742)
    return out.select("row", "col", F.round(F.col("m")[3], 4).alias("x"), F.round(F.col("m")[7], 4).alias("y"))
