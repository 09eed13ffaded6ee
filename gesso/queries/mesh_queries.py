"""Mesh, texture, solver and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gesso.functions import geometry as g
from gesso.operators import grid as gr
from gesso.operators import mesh as m
from gesso.operators import texture as tx
from gesso.plans import depth as dp
from gesso.plans import graph as gp
from gesso.plans import tiles
from gesso.queries import sqltext as q
from gesso.queries.geometry_queries import SCAL, TRI, tri
from gesso.queries.grid_queries import DIMS, four, lerp
from gesso.queries.standins import grid, rounded
from gesso.registry import query

KEYS = ["image_id", "y", "x"]
FACES = """px AS (SELECT image_id AS mesh_id, y::BIGINT * w + x AS v, 2 * (y::BIGINT * (w - 1) + x) AS f, h, w, y, x FROM grid JOIN dims USING (image_id)),
 fc AS (SELECT mesh_id, f, v AS v1, v + 1 AS v2, v + w AS v3 FROM px WHERE y < h - 1 AND x < w - 1 UNION ALL SELECT mesh_id, f + 1, v + 1, v + w + 1, v + w FROM px WHERE y < h - 1 AND x < w - 1)"""
VERTS = """st AS (SELECT image_id, min(v) AS lo, quantile_cont(v, 0.99) AS p99 FROM grid GROUP BY image_id),
 vt AS (SELECT g.image_id AS mesh_id, y::BIGINT * w + x AS v, x::DOUBLE AS x, y::DOUBLE AS y, (g.v - lo) / (p99 - lo + 1e-8) * 10 AS z FROM grid g JOIN dims USING (image_id) JOIN st USING (image_id))"""
EDGES = "ed0 AS (SELECT mesh_id, f, unnest([least(v1, v2), least(v2, v3), least(v1, v3)]) AS a, unnest([greatest(v1, v2), greatest(v2, v3), greatest(v1, v3)]) AS b FROM fc), ed AS (SELECT *, mesh_id::VARCHAR || ':' || a || ':' || b AS k FROM ed0)"
LABELS = "lb AS (SELECT mesh_id, f, CAST(f // 7 * 31 % 5 AS INTEGER) AS label, mesh_id * 100000000 + f AS fk FROM fc)"
MESH = q.with_(q.GRID, DIMS, FACES)


def mesh(t):
    return m.vertex_grid(grid(t), "v")


def mesh_faces(t):
    return m.grid_faces(grid(t))


def labels(faces):
    return faces.select("mesh_id", "f", (F.floor(F.col("f") / 7) * 31 % 5).cast("int").alias("label"))


@query("M27_vertex_grid", q.with_(q.GRID, DIMS, VERTS) + "SELECT mesh_id, v, x, y, round(z, 5) AS z FROM vt")
def m27(t):
    v, _ = mesh(t)
    return v.select("mesh_id", "v", "x", "y", F.round("z", 5).alias("z"))


@query("M27_faces", MESH + "SELECT * FROM fc")
def m27_faces(t):
    return mesh_faces(t)


# corners by one combined key: the SQL engine otherwise joins on the mesh alone
CORNERS = """vk AS (SELECT mesh_id * 100000000 + v AS k, x, y, z FROM vt),
 cr AS (SELECT mesh_id, f, v1, v2, v3, unnest([1, 2, 3]) AS i, mesh_id * 100000000 + unnest([v1, v2, v3]) AS k FROM fc),
 fv AS (SELECT mesh_id, f, any_value(v1) AS v1, any_value(v2) AS v2, any_value(v3) AS v3, """ + ", ".join(
    f"max({a}) FILTER (i = {i}) AS {a}{i}" for i in (1, 2, 3) for a in "xyz") + """ FROM cr JOIN vk USING (k) GROUP BY mesh_id, f)"""


@query("J9_faces_with_vertices", q.with_(q.GRID, DIMS, FACES, VERTS, CORNERS) + """SELECT mesh_id, f, v1, v2, v3, round((x1+x2+x3)/3, 5) AS mx, round((z1+z2+z3)/3, 5) AS mz FROM fv""")
def j9(t):
    v, f = mesh(t)
    out = m.faces_with_vertices(f, v)
    c = g.face_center(m.corner(1), m.corner(2), m.corner(3))
    return out.select("mesh_id", "f", "v1", "v2", "v3", *rounded(mx=c[0], mz=c[2]))


@query("J10_face_adjacency", MESH + f", {EDGES} SELECT DISTINCT x.mesh_id, x.f AS f1, y.f AS f2 FROM ed x JOIN ed y ON x.k = y.k AND x.f < y.f")
def j10(t):
    return m.face_adjacency(mesh_faces(t))


@query("J11_seam_edges", MESH + f", {EDGES}, {LABELS} SELECT x.mesh_id, x.a, x.b, least(p.label, r.label) AS l1, greatest(p.label, r.label) AS l2 FROM ed x JOIN ed y ON x.k = y.k AND x.f < y.f JOIN lb p ON p.fk = x.mesh_id * 100000000 + x.f JOIN lb r ON r.fk = y.mesh_id * 100000000 + y.f WHERE p.label <> r.label")
def j11(t):
    f = mesh_faces(t)
    return m.seam_edges(f, labels(f))


@query("P27_canonical_edge", MESH + f", {EDGES} SELECT mesh_id, a, b, count(*) AS faces FROM ed WHERE a < b GROUP BY mesh_id, a, b")
def p27(t):
    return m.face_edges(mesh_faces(t)).groupBy("mesh_id", "a", "b").agg(F.count("*").alias("faces"))


@query("X3_distinct_edges", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def x3(t):
    return t.lineitem.select(m.canonical_edge(F.col("l_partkey"), F.col("l_suppkey")).alias("e")).where("e IS NOT NULL").select("e.a", "e.b").distinct()


PROJ = "pr AS (SELECT l_partkey AS vertex, l_suppkey AS patch, l_quantity * 1.37e0 AS px, l_extendedprice / 1003.7e0 AS py, l_orderkey % 50 AS face FROM lineitem)"


def projections(t):
    return t.lineitem.select(F.col("l_partkey").alias("vertex"), F.col("l_suppkey").alias("patch"), (F.col("l_quantity") * 1.37).alias("px"), (F.col("l_extendedprice") / 1003.7).alias("py"), F.array(F.col("l_orderkey") % 50).alias("faces"))


@query("X4_merge_projections", q.with_(PROJ) + "SELECT vertex, patch, round(avg(px), 5) AS px, round(avg(py), 5) AS py, count(DISTINCT face) AS faces FROM pr GROUP BY vertex, patch")
def x4(t):
    r = m.merge_projections(projections(t))
    return r.select("vertex", "patch", *rounded(px=F.col("px"), py=F.col("py")), F.size("faces").cast("bigint").alias("faces"))


@query("J12_edge_projections", q.with_(PROJ) + """, mp AS (SELECT vertex, patch, avg(px) AS px, avg(py) AS py, list(DISTINCT face) AS faces FROM pr GROUP BY vertex, patch)
SELECT e.p_partkey AS a, e.p_partkey + 1 AS b, x.patch, round(x.px, 5) AS px1, round(y.px, 5) AS px2 FROM part e JOIN mp x ON x.vertex = e.p_partkey JOIN mp y ON y.vertex = e.p_partkey + 1 AND y.patch = x.patch WHERE list_has_any(x.faces, y.faces)""")
def j12(t):
    e = t.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    r = m.edge_projections(e, m.merge_projections(projections(t)))
    return r.select("a", "b", "patch", *rounded(px1=F.col("px1"), px2=F.col("px2")))


@query("J13_redundant_faces", """WITH f AS (SELECT o_orderkey AS f, list_sort([o_custkey % 11, o_orderkey % 7 + 11, o_custkey % 5 + 20]) AS k FROM orders), m AS (SELECT k, max(f) AS kept FROM f GROUP BY k) SELECT 0 AS mesh_id, f, kept FROM f JOIN m USING (k) WHERE f < kept""")
def j13(t):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    f = t.orders.select(F.lit(0).alias("mesh_id"), o.alias("f"), (c % 11).alias("v1"), (o % 7 + 11).alias("v2"), (c % 5 + 20).alias("v3"))
    return m.redundant_faces(f)


@query("J14_contained_patches", """WITH b AS (SELECT CAST(p_size % 5 AS INTEGER) AS view, p_partkey AS patch, p_partkey*37%200 AS x0, p_partkey*53%200 AS y0, p_partkey*37%200 + p_partkey%30 + 1 AS x1, p_partkey*53%200 + p_partkey*7%30 + 1 AS y1 FROM part),
 c AS (SELECT s.view, s.patch, o.patch AS into_, s.x0 - o.x0 AS dx, s.y0 - o.y0 AS dy, row_number() OVER (PARTITION BY s.view, s.patch ORDER BY (o.x1-o.x0)*(o.y1-o.y0) DESC, o.patch) AS rn FROM b s JOIN b o ON s.view = o.view AND o.x0 <= s.x0 AND o.y0 <= s.y0 AND o.x1 >= s.x1 AND o.y1 >= s.y1
   AND ((o.x1-o.x0)*(o.y1-o.y0) > (s.x1-s.x0)*(s.y1-s.y0) OR o.patch < s.patch) AND o.patch <> s.patch)
SELECT view, patch, into_ AS "into", dx, dy FROM c WHERE rn = 1""")
def j14(t):
    k = F.col("p_partkey")
    b = t.part.select((F.col("p_size") % 5).cast("int").alias("view"), k.alias("patch"), (k * 37 % 200).alias("x0"), (k * 53 % 200).alias("y0"),
                      (k * 37 % 200 + k % 30 + 1).alias("x1"), (k * 53 % 200 + k * 7 % 30 + 1).alias("y1"))
    return m.contained_patches(b)


POINTS = "pt AS (SELECT p_partkey AS id, (p_partkey * 37 % 211) / 2.11e0 AS x, (p_partkey * 101 % 223) / 2.23e0 AS y, p_size * 0.137e0 AS z FROM part)"


def points(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), ((k * 37 % 211) / 2.11).alias("x"), ((k * 101 % 223) / 2.23).alias("y"), (F.col("p_size") * 0.137).alias("z"))


@query("J15_nearest_points", q.with_(POINTS) + """, d AS (SELECT a.id, b.id AS neighbour, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)) AS distance FROM pt a JOIN pt b ON a.id <> b.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d) SELECT id, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4""")
def j15(t):
    p = points(t)
    out = m.padded_neighbours(m.nearest_points(p, p, 4), 4)
    return out.select("id", F.round("distance", 5).alias("distance"), "rank")


@query("J16_nearest_triangle")
def j16(t):
    v, f = mesh(t)
    faces = m.faces_with_vertices(f, v).select("mesh_id", "f", *[f"{a}{i}" for i in (1, 2, 3) for a in "xyz"])
    pts = points(t).select("id", (F.col("x") * 0.4).alias("x"), F.col("y"), F.col("z"))
    return m.nearest_triangle(pts, faces.withColumn("f", F.col("f") * 1000 + F.col("mesh_id"))).select("id", "f", F.round("distance", 4).alias("distance"))


# distance to a triangle: its plane where the foot is inside, else the nearest of its three sides
_SIDES = ", ".join(
    f"sqrt(pow(x-x{i}-s{i}*(x{j}-x{i}),2)+pow(y-y{i}-s{i}*(y{j}-y{i}),2)+pow(z-z{i}-s{i}*(z{j}-z{i}),2))" for i, j in ((1, 2), (2, 3), (3, 1))
)
_SHARES = ", ".join(
    f"greatest(0e0, least(1e0, ((x-x{i})*(x{j}-x{i})+(y-y{i})*(y{j}-y{i})+(z-z{i})*(z{j}-z{i}))/(pow(x{j}-x{i},2)+pow(y{j}-y{i},2)+pow(z{j}-z{i},2)))) AS s{i}" for i, j in ((1, 2), (2, 3), (3, 1))
)
_INSIDE = " AND ".join(
    f"((y{j}-y{i})*(z-z{i})-(z{j}-z{i})*(y-y{i}))*nx+((z{j}-z{i})*(x-x{i})-(x{j}-x{i})*(z-z{i}))*ny+((x{j}-x{i})*(y-y{i})-(y{j}-y{i})*(x-x{i}))*nz >= 0" for i, j in ((1, 2), (2, 3), (3, 1))
)


@query("J16_nearest_distance", q.with_(q.GRID, DIMS, FACES, VERTS, CORNERS, POINTS) + f""", tn AS (SELECT *, (y2-y1)*(z3-z1)-(z2-z1)*(y3-y1) AS nx, (z2-z1)*(x3-x1)-(x2-x1)*(z3-z1) AS ny, (x2-x1)*(y3-y1)-(y2-y1)*(x3-x1) AS nz FROM fv),
 pr AS (SELECT pt.id, pt.x * 0.4e0 AS x, pt.y, pt.z, tn.* EXCLUDE (mesh_id, f, v1, v2, v3) FROM pt, tn),
 sh AS (SELECT *, {_SHARES}, abs((x-x1)*nx+(y-y1)*ny+(z-z1)*nz)/sqrt(nx*nx+ny*ny+nz*nz) AS flat FROM pr)
SELECT id, round(min(CASE WHEN {_INSIDE} THEN flat ELSE least({_SIDES}) END), 4) AS distance FROM sh GROUP BY id""")
def j16_distance(t):
    return j16(t).select("id", "distance")


@query("X5_unique_points", "SELECT DISTINCT 0 AS id, round(l_quantity / 3, 8) AS x, round(l_discount, 8) AS y, round(l_tax, 8) AS z FROM lineitem")
def x5(t):
    p = t.lineitem.select(F.lit(0).alias("id"), (F.col("l_quantity") / 3).alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return m.unique_points(p, ["id"])


@query("G14_tangent_cells")
def g14(t):
    p = points(t)
    s = p.select("id", "x", "y", "z", (0.2 * F.sin(F.col("x"))).alias("nx"), (0.2 * F.cos(F.col("y"))).alias("ny"), F.lit(1.0).alias("nz"))
    out = m.barycenters(m.tangent_cells(s, 6))
    return out.select("id", "corners", *rounded(4, x=F.col("x"), y=F.col("y"), z=F.col("z")))


VIEWS = """vw AS (SELECT CAST(s_suppkey % 4 AS INTEGER) AS mesh_id, CAST(s_suppkey AS INTEGER) AS view, 5e0 + s_suppkey * 13 % 30 AS ex, 10e0 + s_suppkey * 29 % 60 AS ey, 60e0 AS ez FROM supplier)"""


def views(t):
    k = F.col("s_suppkey")
    return t.supplier.select((k % 4).cast("int").alias("mesh_id"), k.cast("int").alias("view"), (5.0 + k * 13 % 30).alias("ex"), (10.0 + k * 29 % 60).alias("ey"), F.lit(60.0).alias("ez"),
                             g.lit_matrix([1, 0, 0, 0, -1, 0, 0, 0, -1]).alias("rot"), F.lit(0.1).alias("tx"), F.lit(0.08).alias("ty"))


_FACEGEO = CORNERS + """,
 fn AS (SELECT *, (y2-y1)*(z3-z1)-(z2-z1)*(y3-y1) AS kx, (z2-z1)*(x3-x1)-(x2-x1)*(z3-z1) AS ky, (x2-x1)*(y3-y1)-(y2-y1)*(x3-x1) AS kz, (x1+x2+x3)/3 AS mx, (y1+y2+y3)/3 AS my, (z1+z2+z3)/3 AS mz FROM fv),
 pv AS (SELECT fn.mesh_id, f, view, (kx*(ex-mx)+ky*(ey-my)+kz*(ez-mz))/sqrt(kx*kx+ky*ky+kz*kz)/sqrt(pow(ex-mx,2)+pow(ey-my,2)+pow(ez-mz,2)) AS cs FROM fn JOIN vw ON vw.mesh_id = fn.mesh_id AND ez > mz AND abs(mx-ex) <= 0.1e0*(ez-mz) AND abs(my-ey) <= 0.08e0*(ez-mz)),
 vis AS (SELECT *, degrees(acos(least(1, cs))) AS angle FROM pv WHERE cs > 0 AND degrees(acos(least(1, cs))) <= 75)"""


def faces3d(t):
    v, f = mesh(t)
    return m.faces_with_vertices(f, v)


@query("J8_visible_faces", q.with_(q.GRID, DIMS, FACES, VERTS, VIEWS, _FACEGEO) + "SELECT mesh_id, f, view, round(angle, 3) AS angle FROM vis")
def j8(t):
    return tx.visible_faces(faces3d(t), views(t)).select("mesh_id", "f", "view", F.round("angle", 3).alias("angle"))


@query("P19_view_cull", q.with_(q.GRID, DIMS, FACES, VERTS, VIEWS, _FACEGEO) + "SELECT view, count(*) AS faces FROM vis WHERE angle <= 40 GROUP BY view")
def p19(t):
    return tx.visible_faces(faces3d(t), views(t), 40).groupBy("view").agg(F.count("*").alias("faces"))


_RAYS = """, ry AS (SELECT vis.mesh_id, vis.f, vis.view, unnest([x1, x2, x3]) AS ox, unnest([y1, y2, y3]) AS oy, unnest([z1, z2, z3]) AS oz, ex, ey, ez FROM vis JOIN fn USING (mesh_id, f) JOIN vw ON vw.mesh_id = vis.mesh_id AND vw.view = vis.view),
 hx AS (SELECT ry.*, w.f AS wall, x2-x1 AS ax, y2-y1 AS ay, z2-z1 AS az, x3-x1 AS bx, y3-y1 AS by_, z3-z1 AS bz, ox-x1 AS sx, oy-y1 AS sy, oz-z1 AS sz, ex-ox AS dx, ey-oy AS dy, ez-oz AS dz
   FROM ry JOIN fv w ON w.mesh_id = ry.mesh_id AND w.f <> ry.f AND greatest(x1,x2,x3) >= least(ox,ex) - 1e-6 AND least(x1,x2,x3) <= greatest(ox,ex) + 1e-6 AND greatest(y1,y2,y3) >= least(oy,ey) - 1e-6 AND least(y1,y2,y3) <= greatest(oy,ey) + 1e-6),
 px2 AS (SELECT *, dy*bz-dz*by_ AS p0, dz*bx-dx*bz AS p1, dx*by_-dy*bx AS p2, sy*az-sz*ay AS q0, sz*ax-sx*az AS q1, sx*ay-sy*ax AS q2 FROM hx),
 ds AS (SELECT *, ax*p0+ay*p1+az*p2 AS det FROM px2),
 ht AS (SELECT mesh_id, f, view, (sx*p0+sy*p1+sz*p2)/det AS u, (dx*q0+dy*q1+dz*q2)/det AS v, (bx*q0+by_*q1+bz*q2)/det AS t FROM ds WHERE abs(det) > 1e-12),
 oc AS (SELECT DISTINCT mesh_id, f, view FROM ht WHERE u >= -1e-6 AND v >= -1e-6 AND u + v <= 1 + 1e-6 AND t > 1e-6 AND t < 1)
SELECT vis.mesh_id, vis.f, vis.view FROM vis ANTI JOIN oc USING (mesh_id, f, view)"""


@query("J17_seen_faces", q.with_(q.GRID, DIMS, FACES, VERTS, VIEWS, _FACEGEO) + _RAYS)
def j17_seen(t):
    return j17(t).select("mesh_id", "f", "view")


@query("J17_occlusion")
def j17(t):
    f, v = faces3d(t), views(t)
    return tx.unoccluded(tx.visible_faces(f, v), f, v)


_TRI2 = "t2 AS (SELECT id AS f, CAST(id % 4 AS INTEGER) AS view, ax, ay, bx, by_, cx, cy, abs((bx-ax)*(cy-ay)-(cx-ax)*(by_-ay)) / 2 AS area, (bx-ax)*(cy-ay)-(cx-ax)*(by_-ay) AS d FROM tri)"


def flat_triangles(t):
    return tri(t).select(F.col("id").alias("f"), (F.col("id") % 4).cast("int").alias("view"), "ax", "ay", "bx", "by", "cx", "cy")


@query("A33_face_quality", q.with_(q.GRID, SCAL, TRI, _TRI2) + """, c AS (SELECT t2.f, t2.view, t2.area, v, ((bx-g.x)*(cy-g.y)-(cx-g.x)*(by_-g.y))/d AS wa, ((g.x-ax)*(cy-ay)-(cx-ax)*(g.y-ay))/d AS wb FROM t2 JOIN grid g ON g.image_id = t2.view AND g.x BETWEEN least(ax,bx,cx) AND greatest(ax,bx,cx) AND g.y BETWEEN least(ay,by_,cy) AND greatest(ay,by_,cy) WHERE area > 0.5e0),
 s AS (SELECT f, view, sum(v) AS quality, avg(v*v) AS c0, count(*) AS samples FROM c WHERE wa >= 0 AND wb >= 0 AND 1 - wa - wb >= 0 GROUP BY f, view)
SELECT t2.f, t2.view, round(coalesce(quality, 0), 4) AS quality, round(c0, 5) AS c0, coalesce(samples, 0) AS samples FROM t2 LEFT JOIN s USING (f, view)""")
def a33(t):
    v = F.col("v")
    px = grid(t).select(F.col("image_id").alias("view"), "y", "x", v.alias("grad"), (v * v).alias("c0"), v.alias("c1"), v.alias("c2"))
    return tx.face_quality(flat_triangles(t), px, step=8).select("f", "view", F.round("quality", 4).alias("quality"), F.round("c0", 5).alias("c0"), "samples")


@query("M19_rasterise_triangle", q.with_(SCAL, TRI, _TRI2) + """, bx AS (SELECT *, unnest(range(CAST(ceil(least(ay,by_,cy)) AS INTEGER), CAST(floor(greatest(ay,by_,cy)) AS INTEGER) + 1)) AS y FROM t2),
 p AS (SELECT *, unnest(range(CAST(ceil(least(ax,bx,cx)) AS INTEGER), CAST(floor(greatest(ax,bx,cx)) AS INTEGER) + 1)) AS x FROM bx), w AS (SELECT f, y, x, ((bx-x)*(cy-y)-(cx-x)*(by_-y))/d AS wa, ((x-ax)*(cy-ay)-(cx-ax)*(y-ay))/d AS wb FROM p)
SELECT f, CAST(count(*) AS BIGINT) AS pixels, round(avg(wa), 4) AS wa FROM w WHERE wa >= 0 AND wb >= 0 AND 1 - wa - wb >= 0 GROUP BY f""")
def m19_raster(t):
    r = m.rasterise(flat_triangles(t).drop("view"), ["f"], 8)
    return r.groupBy("f").agg(F.count("*").alias("pixels"), F.round(F.avg("wa"), 4).alias("wa"))


COST = "cs AS (SELECT l_partkey AS face, CAST(l_suppkey + 1 AS INTEGER) AS view, max(l_quantity) - 1 AS quality FROM lineitem GROUP BY 1, 2)"
PCT = """mx AS (SELECT max(quality) AS m FROM cs), hb AS (SELECT CAST(floor(quality / m * 9999) AS BIGINT) AS b, count(*) AS n FROM cs, mx GROUP BY 1),
 cu AS (SELECT b, sum(n) OVER (ORDER BY b) AS c, sum(n) OVER () AS a FROM hb), pc AS (SELECT min(b) / 9999e0 * (SELECT m FROM mx) AS percentile FROM cu WHERE c > 0.9e0 * a)"""


def qualities(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("face"), (F.col("l_suppkey") + 1).cast("int").alias("view")).agg((F.max("l_quantity") - 1).alias("quality"))


@query("P21_drop_zero_quality", q.with_(COST) + "SELECT face, view, quality FROM cs WHERE quality <> 0")
def p21(t):
    return tx.drop_zero_quality(qualities(t))


@query("A30_quality_percentile", q.with_(COST, PCT) + "SELECT round(percentile, 5) AS percentile FROM pc")
def a30(t):
    return tx.quality_percentile(qualities(t), 0.9).select(F.round("percentile", 5).alias("percentile"))


def costs(t):
    ql = qualities(t)
    return tx.data_cost(ql, tx.quality_percentile(ql, 0.9)).select("face", "view", "cost")


@query("A31_data_cost", q.with_(COST, PCT) + "SELECT face, view, round(1 - least(1, quality / percentile), 5) AS cost FROM cs, pc")
def a31(t):
    return costs(t).select("face", "view", F.round("cost", 5).alias("cost"))


@query("O4_cheapest_view", q.with_(COST, PCT) + ", k AS (SELECT face, view, 1 - least(1, quality / percentile) AS cost FROM cs, pc) SELECT face, arg_min(view, (cost, view)) AS view, round(min(cost), 5) AS cost FROM k GROUP BY face")
def o4(t):
    return tx.cheapest_view(costs(t)).select("face", "view", F.round("cost", 5).alias("cost"))


@query("A32_color_outliers")
def a32(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("face"), F.col("l_orderkey").alias("view"), (F.col("l_discount") * 5).alias("c0"), (F.col("l_tax") * 6).alias("c1"), (F.col("l_quantity") / 50).alias("c2"), F.col("l_quantity").alias("quality"))
    return tx.color_outliers(rows).select("face", "view", F.round("quality", 4).alias("quality"))


def part_edges(t):
    k = F.col("p_partkey")
    e = t.part.select(k.alias("f1"), F.explode(F.array(k + 1, k + 37)).alias("f2"))
    return e.join(t.part.select(k.alias("f2")), "f2", "left_semi").select("f1", "f2")


@query("G5_label_faces")
def g5(t):
    return gp.label_faces(costs(t), part_edges(t))


@query("A52_unseen_faces", q.with_(q.GRID, DIMS, FACES, LABELS) + "SELECT count(*) FILTER (label = 0) AS unseen, count(*) AS faces FROM lb")
def a52(t):
    return tx.unseen_faces(labels(mesh_faces(t)))


@query("G6_connected_components", """WITH c AS (SELECT c_custkey AS k, c_nationkey % 2 AS p FROM customer), s AS (SELECT *, CASE WHEN lag(p) OVER (ORDER BY k) = p AND lag(k) OVER (ORDER BY k) = k - 1 THEN 0 ELSE 1 END AS b FROM c),
 r AS (SELECT *, sum(b) OVER (ORDER BY k) AS run FROM s) SELECT k AS node, min(k) OVER (PARTITION BY run) AS component FROM r""")
def g6(t):
    k = F.col("c_custkey")
    a = t.customer.select(k.alias("f1"), (F.col("c_nationkey") % 2).alias("p"), (k + 1).alias("f2"))
    b = t.customer.select(k.alias("f2"), (F.col("c_nationkey") % 2).alias("p"))
    return gp.connected_components(t.customer.select(k.alias("node")), a.join(b, ["f2", "p"]).select("f1", "f2"))


@query("A40_vertex_labels", q.with_(q.GRID, DIMS, FACES, LABELS) + ", p AS (SELECT DISTINCT mesh_id, unnest([v1, v2, v3]) AS v, label FROM fc JOIN lb USING (mesh_id, f) WHERE label <> 0) SELECT mesh_id, v, label, row_number() OVER (ORDER BY mesh_id, v, label) - 1 AS row_no FROM p")
def a40(t):
    f = mesh_faces(t)
    return tx.vertex_labels(f, labels(f))


@query("J23_corner_values", q.with_(q.GRID, DIMS, FACES, LABELS) + "SELECT mesh_id, f, round((v1 + v2 + v3) * 0.01e0 * (label + 1), 5) AS total FROM fc JOIN lb USING (mesh_id, f)")
def j23(t):
    f = mesh_faces(t)
    lab = labels(f)
    per = f.join(lab, ["mesh_id", "f"]).select("mesh_id", F.explode(F.array("v1", "v2", "v3")).alias("v"), "label").distinct()
    solved = per.withColumn("d0", F.col("v") * 0.01 * (F.col("label") + 1))
    out = tx.corner_adjustments(f, lab, solved, ["d0"])
    return out.select("mesh_id", "f", F.round(F.col("d0")[0] + F.col("d0")[1] + F.col("d0")[2], 5).alias("total"))


_SEG = """eg AS (SELECT id AS edge, 1 AS side, CAST(id % 4 AS INTEGER) AS image_id, ax AS px1, ay AS py1, bx AS px2, by_ AS py2 FROM tri UNION ALL SELECT id, 2, CAST((id + 1) % 4 AS INTEGER), cx, cy, bx + 5, by_ + 3 FROM tri),
 ns AS (SELECT *, CAST(floor(greatest(sqrt(pow(px2-px1,2)+pow(py2-py1,2)), 1) * 2) AS INTEGER) AS n FROM eg), sq AS (SELECT *, unnest(range(n)) / (n - 1)::DOUBLE AS fr FROM ns),
 s AS (SELECT edge, side, sq.image_id, 1 - fr AS wt, py1 + fr*(py2-py1) AS sy, px1 + fr*(px2-px1) AS sx, h, w FROM sq JOIN dims USING (image_id))"""


@query("A41_edge_color_difference", q.with_(q.GRID, DIMS, SCAL, TRI, _SEG) + ", gv AS (SELECT s.edge, s.side, s.wt, " + lerp("sy", "sx") + " AS v FROM s " + four("s", "sy", "sx") + " WHERE sy >= 0 AND sx >= 0 AND sy <= s.h - 1 AND sx <= s.w - 1), mn AS (SELECT edge, side, sum(wt*v)/sum(wt) AS c FROM gv GROUP BY 1, 2) SELECT edge, round(max(c) FILTER (side = 2) - max(c) FILTER (side = 1), 5) AS d_v FROM mn GROUP BY edge")
def a41(t):
    tr = tri(t)
    one = tr.select(F.col("id").alias("edge"), F.lit(1).alias("side"), (F.col("id") % 4).cast("int").alias("image_id"), F.col("ax").alias("px1"), F.col("ay").alias("py1"), F.col("bx").alias("px2"), F.col("by").alias("py2"))
    two = tr.select(F.col("id").alias("edge"), F.lit(2).alias("side"), ((F.col("id") + 1) % 4).cast("int").alias("image_id"), F.col("cx").alias("px1"), F.col("cy").alias("py1"), (F.col("bx") + 5).alias("px2"), (F.col("by") + 3).alias("py2"))
    return tx.edge_color_difference(one.unionByName(two), grid(t), ["v"], 16).select("edge", F.round("d_v", 5).alias("d_v"))


@query("G10_level_seams")
def g10(t):
    k = F.col("p_partkey")
    two = t.part.select(k.alias("v"), F.explode(F.array(F.lit(1), F.lit(2))).alias("l"))
    nodes = two.select((F.col("v") * 10 + F.col("l")).alias("node"))
    seams = t.part.select((k * 10 + 1).alias("n1"), (k * 10 + 2).alias("n2"), (F.sin(F.col("p_retailprice")) * 0.1).alias("d0"))
    e = part_edges(t).withColumn("l", F.explode(F.array(F.lit(1), F.lit(2))))
    smooth = e.select((F.col("f1") * 10 + F.col("l")).alias("n1"), (F.col("f2") * 10 + F.col("l")).alias("n2"))
    out, _ = gp.level_seams(nodes, seams, smooth)
    return out.select("node", F.round("d0", 3).alias("d0"))


@query("G11_apply_adjustment")
def g11(t):
    tr = flat_triangles(t).withColumnRenamed("view", "patch").withColumn("c0", F.array(F.col("ax") / 100, F.col("by") / 100, F.col("cy") / 100))
    px = grid(t).select(F.col("image_id").alias("patch"), "y", "x", F.col("v").alias("c0"))
    return tx.apply_adjustment(tr, px, ["c0"], step=8).select("patch", "y", "x", F.round("c0", 5).alias("c0"))


@query("G15_valid_region", "WITH RECURSIVE " + q.GRID + ", " + DIMS + """, bk AS (SELECT image_id, y, x, h, w FROM grid JOIN dims USING (image_id) WHERE v < 0.6e0),
 fl(image_id, y, x) AS (SELECT image_id, y, x FROM bk WHERE y IN (0, h - 1) AND x IN (0, w - 1)
   UNION SELECT bk.image_id, bk.y, bk.x FROM fl JOIN (SELECT unnest([0, 0, 1, -1]) AS dy, unnest([1, -1, 0, 0]) AS dx) s ON true JOIN bk ON bk.image_id = fl.image_id AND bk.y = fl.y + dy AND bk.x = fl.x + dx),
 nb AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM fl, (SELECT unnest(range(-1, 2)) AS dy) a, (SELECT unnest(range(-1, 2)) AS dx) b)
SELECT g.image_id, g.y, g.x, nb.x IS NULL AND g.y > 0 AND g.x > 0 AND g.y < h - 1 AND g.x < w - 1 AS valid FROM grid g JOIN dims USING (image_id) LEFT JOIN nb ON nb.image_id = g.image_id AND nb.y = g.y AND nb.x = g.x""")
def g15(t):
    px = grid(t).withColumn("v", F.when(F.col("v") < 0.6, 0.0).otherwise(F.col("v")))
    return gp.valid_region(px, "v")


def gradient(t, masked=False):
    v = F.col("v")
    ok = (v > 0.05) if masked else F.lit(True)
    return grid(t).select(*KEYS, (v - 0.45).alias("p"), (v * v - 0.3).alias("q"), ok.alias("valid"))


@query("G1_integrate_fft")
def g1(t):
    return dp.integrate_fft(gradient(t), strip=16).select(*KEYS, F.round("z", 4).alias("z"))


@query("G2_integrate_dct")
def g2(t):
    return dp.integrate_dct(gradient(t), 16, 16).select(*KEYS, F.round("z", 4).alias("z"))


@query("G3_integrate_poisson")
def g3(t):
    out, _, _ = dp.integrate_poisson(gradient(t, True), tile=64)
    return out.select(*KEYS, F.round("z", 2).alias("z"))


_ZERO = q.with_(q.GRID) + "SELECT image_id, y, x, 0e0 AS residual FROM grid WHERE v > 0.05e0"


def _residual(t, out):
    left = tiles.residuals(gradient(t, True), out)
    return left.select(*KEYS, F.when(F.abs("residual") <= 2e-3, F.lit(0.0)).otherwise(F.col("residual")).alias("residual"))


@query("G3_residual", _ZERO)
def g3_residual(t):
    """What the depth leaves of each valid pixel's equation, beyond the tolerance: nothing."""
    return _residual(t, dp.integrate_poisson(gradient(t, True), tile=64)[0])


@query("G4_residual", _ZERO)
def g4_residual(t):
    return _residual(t, dp.integrate_poisson_tiled(gradient(t, True), tile=64, overlap=16)[0])


@query("G4_integrate_poisson_tiled")
def g4(t):
    out, _, _ = dp.integrate_poisson_tiled(gradient(t, True), tile=64, overlap=16)
    return out.select(*KEYS, F.round("z", 2).alias("z"))
