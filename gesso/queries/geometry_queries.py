"""Geometry functions over orders, customers and suppliers read as points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gesso.functions import geometry as g
from gesso.queries import sqltext as q
from gesso.queries.standins import Cols, normals, rounded
from gesso.registry import query

SCAL = """scal AS (SELECT o_orderkey AS id, o_totalprice / 509987.3e0 AS a, (o_custkey % 89) / 88.31e0 AS b,
  (o_orderkey * 17 % 97) / 96.17e0 AS c FROM orders)"""
HOMO = """homo AS (SELECT *, 1 + 0.1e0*a AS h0, 0.05e0*b AS h1, 10*c AS h2, -0.04e0*a AS h3, 0.9e0 + 0.1e0*b AS h4,
  7*a AS h5, 0.0005e0*b AS h6, 0.0003e0*c AS h7, 1e0 AS h8 FROM scal)"""


def scal(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"), (F.col("o_totalprice") / 509987.3).alias("a"),
        ((F.col("o_custkey") % 89) / 88.31).alias("b"), ((k * 17 % 97) / 96.17).alias("c"))


def homo(t):
    a, b, c = Cols("a", "b", "c")
    return scal(t).withColumn("h", F.array(
        1 + 0.1 * a, 0.05 * b, 10 * c, -0.04 * a, 0.9 + 0.1 * b, 7 * a, 0.0005 * b, 0.0003 * c, F.lit(1.0)))


@query("M10_tilt_slant", q.with_(SCAL) + """, l AS (SELECT id, a, b, sin(radians(89*b))*cos(radians(360*a-180)) AS lx,
  sin(radians(89*b))*sin(radians(360*a-180)) AS ly, cos(radians(89*b)) AS lz FROM scal)
SELECT id, round(lx, 5) AS lx, round(ly, 5) AS ly, round(lz, 5) AS lz,
  round(CASE WHEN b > 0.01e0 THEN degrees(atan2(ly, lx)) END, 4) AS tilt,
  round(degrees(acos(greatest(-1, least(1, lz)))), 4) AS slant FROM l""")
def m10(t):
    df = scal(t)
    v = g.tilt_slant_to_light(360 * F.col("a") - 180, 89 * F.col("b"))
    df = df.withColumns(dict(zip(("lx", "ly", "lz"), v)))
    tilt, slant = g.light_to_tilt_slant(tuple(Cols("lx", "ly", "lz")))
    return df.select("id", *rounded(lx=F.col("lx"), ly=F.col("ly"), lz=F.col("lz")),
                     *rounded(4, tilt=F.when(F.col("b") > 0.01, tilt), slant=slant))


@query("M11_normal_rgb", q.with_(q.NORMALS) + """, e AS (SELECT image_id, y, x,
  CAST(round_even((nx+1)/2*255e0, 0) AS INTEGER) AS r, CAST(round_even((ny+1)/2*255e0, 0) AS INTEGER) AS g,
  CAST(round_even((nz+1)/2*255e0, 0) AS INTEGER) AS b FROM normals), f AS (SELECT *, r/255e0*2-1 AS fx, g/255e0*2-1 AS fy, b/255e0*2-1 AS fz FROM e)
SELECT image_id, y, x, r, g, b, round(fx/sqrt(fx*fx+fy*fy+fz*fz), 5) AS nx, round(fy/sqrt(fx*fx+fy*fy+fz*fz), 5) AS ny,
  round(fz/sqrt(fx*fx+fy*fy+fz*fz), 5) AS nz FROM f""")
def m11(t):
    df = normals(t)
    rgb = g.normal_to_rgb(tuple(Cols("nx", "ny", "nz")))
    df = df.select("image_id", "y", "x", *[v.alias(k) for k, v in zip("rgb", rgb)])
    back = g.rgb_to_normal(tuple(Cols("r", "g", "b")))
    return df.select("image_id", "y", "x", "r", "g", "b", *rounded(nx=back[0], ny=back[1], nz=back[2]))


@query("M14_apply_homography", q.with_(SCAL, HOMO) + """, p AS (SELECT id, 40*b AS px, 30*a AS py, homo.* EXCLUDE (id) FROM homo)
SELECT id, round((h0*px+h1*py+h2)/(h6*px+h7*py+h8), 5) AS qx, round((h3*px+h4*py+h5)/(h6*px+h7*py+h8), 5) AS qy,
  round(sqrt(pow((h0*px+h1*py+h2)/(h6*px+h7*py+h8)-(px+5),2)+pow((h3*px+h4*py+h5)/(h6*px+h7*py+h8)-(py+3),2)), 5) AS residual FROM p""")
def m14(t):
    x, y = 40 * F.col("b"), 30 * F.col("a")
    df = homo(t)
    one = g.apply_homography(F.col("h"), x, y)
    two = g.apply_homography(g.lit_matrix([1, 0, 5, 0, 1, 3, 0, 0, 1]), x, y)
    gap = F.sqrt(F.pow(one[0] - two[0], 2) + F.pow(one[1] - two[1], 2))
    return df.select("id", *rounded(qx=one[0], qy=one[1], residual=gap))


@query("M15_compose_rotation", q.with_(SCAL, HOMO) + """
SELECT id, round(h0*h0+h1*h3+h2*h6, 5) AS c0, round(h0*h1+h1*h4+h2*h7, 5) AS c1, round(h0*h2+h1*h5+h2*h8, 5) AS c2,
  round(h3*h2+h4*h5+h5*h8, 5) AS c5, round(h6*h2+h7*h5+h8*h8, 5) AS c8,
  round(h2 + 3*a*h8, 5) AS t2, round(h5 - 2*b*h8, 5) AS t5, round(degrees(atan2(h3-h1, h0+h4)), 5) AS angle FROM homo""")
def m15(t):
    h = F.col("h")
    df = homo(t).withColumns({"sq": g.compose(h, h), "moved": g.translate(h, 3 * F.col("a"), -2 * F.col("b"))})
    sq, moved = F.col("sq"), F.col("moved")
    return df.select("id", *rounded(c0=sq[0], c1=sq[1], c2=sq[2], c5=sq[5], c8=sq[8], t2=moved[2], t5=moved[5],
                                    angle=g.rotation_degrees(h)))


_RIGID = """, r AS (SELECT *, sqrt(pow(h0+h4,2)+pow(h3-h1,2)) AS n FROM homo),
  k AS (SELECT *, (h0+h4)/n AS co, (h3-h1)/n AS si FROM r)"""


@query("M16_rigid_2d", q.with_(SCAL, HOMO) + _RIGID + """
SELECT id, round(co, 5) AS cos, round(si, 5) AS sin, round(h2, 5) AS tx, round(h5, 5) AS ty FROM k""")
def m16(t):
    co, si, tx, ty = g.to_rigid_2d(F.col("h"))
    return homo(t).select("id", *rounded(cos=co, sin=si, tx=tx, ty=ty))


@query("M17_rigid_3d_euler", q.with_(SCAL, HOMO) + _RIGID + """
SELECT id, round(h2 - si*8742, 5) AS x, round(20000 - h5 - co*8742, 5) AS y, 0e0 AS roll, 0e0 AS pitch,
  round(degrees(atan2(-si, co)), 4) AS yaw FROM k""")
def m17(t):
    co, si, tx, ty = g.to_rigid_2d(F.col("h"))
    df = homo(t).select("id", g.to_rigid_3d(co, si, tx, ty, F.lit(20000.0), F.lit(8742.0)).alias("m"))
    m = F.col("m")
    roll, pitch, yaw = g.euler_zyx(m)
    return df.select("id", F.round(m[3], 5).alias("x"), F.round(m[7], 5).alias("y"),
                     (F.round(roll, 4) + 0.0).alias("roll"), (F.round(pitch, 4) + 0.0).alias("pitch"), F.round(yaw, 4).alias("yaw"))


@query("M18_order_corners", q.with_(SCAL) + """, p AS (SELECT id, b AS x0, c AS y0, 10+a AS x1, b AS y1, c AS x2, 8+a AS y2, 9+b AS x3, 9+c AS y3 FROM scal)
SELECT id, round(x0, 5) AS tl_x, round(y0, 5) AS tl_y, round(x1, 5) AS tr_x, round(y2, 5) AS bl_y, round(x3, 5) AS br_x,
  greatest(x0,x1,x2,x3)-least(x0,x1,x2,x3) > greatest(y0,y1,y2,y3)-least(y0,y1,y2,y3) AS horizontal, true AS cyclic FROM p""")
def m18(t):
    a, b, c = Cols("a", "b", "c")

    def pt(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    df = scal(t).withColumn("pts", F.array(pt(9 + b, 9 + c), pt(b, c), pt(c, 8 + a), pt(10 + a, b)))
    df = df.withColumn("o", g.order_corners(F.col("pts"), 0))
    o = F.col("o")
    moved = F.transform(F.col("pts"), lambda p: F.struct((p.x * 2 + 5).alias("x"), (p.y * 2 + 7).alias("y")))
    return df.select(
        "id", F.round(o[0].x, 5).alias("tl_x"), F.round(o[0].y, 5).alias("tl_y"), F.round(o[1].x, 5).alias("tr_x"),
        F.round(o[2].y, 5).alias("bl_y"), F.round(o[3].x, 5).alias("br_x"),
        g.is_horizontal(F.col("pts")).alias("horizontal"), g.same_cyclic_order(F.col("pts"), moved).alias("cyclic"))


TRI = """tri AS (SELECT id, 3*a AS ax, 2*b AS ay, c AS az, 10+b AS bx, 3*c AS bz, a AS by_, 2*c AS cx, 9+2*a AS cy, 2*b AS cz, 12*b-1 AS px, 11*c-1 AS py, 4*a-1 AS pz FROM scal)"""


def tri(t):
    a, b, c = Cols("a", "b", "c")
    return scal(t).select(
        "id", (3 * a).alias("ax"), (2 * b).alias("ay"), c.alias("az"), (10 + b).alias("bx"), a.alias("by"), (3 * c).alias("bz"),
        (2 * c).alias("cx"), (9 + 2 * a).alias("cy"), (2 * b).alias("cz"),
        (12 * b - 1).alias("px"), (11 * c - 1).alias("py"), (4 * a - 1).alias("pz"))


@query("M19_triangle_barycentric", q.with_(SCAL, TRI) + """, w AS (SELECT *, (bx-ax)*(cy-ay)-(cx-ax)*(by_-ay) AS d FROM tri),
  v AS (SELECT *, ((bx-px)*(cy-py)-(cx-px)*(by_-py))/d AS wa, ((px-ax)*(cy-ay)-(cx-ax)*(py-ay))/d AS wb FROM w)
SELECT id, round(abs(d)/2, 5) AS area, round(wa, 5) AS wa, round(wb, 5) AS wb, round(1-wa-wb, 5) AS wc,
  wa >= 0 AND wb >= 0 AND 1-wa-wb >= 0 AS inside, round(least(ax,bx,cx), 5) AS x0, round(greatest(ay,by_,cy), 5) AS y1 FROM v""")
def m19(t):
    df = tri(t)
    corners = tuple(Cols("ax", "ay", "bx", "by", "cx", "cy"))
    w = g.barycentric(F.col("px"), F.col("py"), *corners)
    df = df.withColumns({"wa": w[0], "wb": w[1], "area": F.abs(g.triangle_area2(*corners)) / 2})
    df = df.withColumn("wc", 1 - F.col("wa") - F.col("wb"))
    return df.select("id", *rounded(area=F.col("area"), wa=F.col("wa"), wb=F.col("wb"), wc=F.col("wc")),
                     g.inside(tuple(Cols("wa", "wb", "wc"))).alias("inside"),
                     *rounded(x0=F.least("ax", "bx", "cx"), y1=F.greatest("ay", "by", "cy")))


_FACET = """, n0 AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS kx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ky,
  (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS kz, (ax+bx+cx)/3 AS mx, (ay+by_+cy)/3 AS my, (az+bz+cz)/3 AS mz FROM tri),
  n1 AS (SELECT *, sqrt(kx*kx+ky*ky+kz*kz) AS kn, sqrt(pow(px-mx,2)+pow(py-my,2)+pow(60-mz,2)) AS en FROM n0)"""


@query("M20_facet_normal_angle", q.with_(SCAL, TRI) + _FACET + """
SELECT id, round(kx/kn, 5) AS nx, round(ky/kn, 5) AS ny, round(kz/kn, 5) AS nz, round(mx, 5) AS mx, round(my, 5) AS my, round(mz, 5) AS mz,
  round(degrees(acos((kx*(px-mx)+ky*(py-my)+kz*(60-mz))/kn/en)), 3) AS angle FROM n1""")
def m20(t):
    A, B, C = tuple(Cols("ax", "ay", "az")), tuple(Cols("bx", "by", "bz")), tuple(Cols("cx", "cy", "cz"))
    n, m = g.facet_normal(A, B, C), g.face_center(A, B, C)
    df = tri(t).withColumns({**dict(zip(("nx", "ny", "nz"), n)), **dict(zip(("mx", "my", "mz"), m))})
    N, M = tuple(Cols("nx", "ny", "nz")), tuple(Cols("mx", "my", "mz"))
    angle = g.view_angle(N, M, (F.col("px"), F.col("py"), F.lit(60.0)))
    return df.select("id", *rounded(**dict(zip(("nx", "ny", "nz", "mx", "my", "mz"), (*N, *M)))), F.round(angle, 3).alias("angle"))


_SEG = ["a", "b", "c"]


def _segment(i, j):
    p, r = _SEG[i], _SEG[j]
    y = {"a": "ay", "b": "by_", "c": "cy"}
    d = f"(({r}x-{p}x)*({r}x-{p}x)+({y[r]}-{y[p]})*({y[r]}-{y[p]})+({r}z-{p}z)*({r}z-{p}z))"
    s = f"greatest(0, least(1, ((px-{p}x)*({r}x-{p}x)+(py-{y[p]})*({y[r]}-{y[p]})+(pz-{p}z)*({r}z-{p}z))/{d}))"
    return f"pow(px-{p}x-{s}*({r}x-{p}x),2)+pow(py-{y[p]}-{s}*({y[r]}-{y[p]}),2)+pow(pz-{p}z-{s}*({r}z-{p}z),2)"


@query("M21_closest_point", q.with_(SCAL, TRI) + _FACET + f""", d AS (SELECT *, (px-ax)*kx/kn+(py-ay)*ky/kn+(pz-az)*kz/kn AS h,
  least({_segment(0, 1)}, {_segment(1, 2)}, {_segment(0, 2)}) AS edge2 FROM n1),
  f AS (SELECT *, px-h*kx/kn AS fx, py-h*ky/kn AS fy, pz-h*kz/kn AS fz FROM d),
  s AS (SELECT *, ((by_-fy)*(cz-fz)-(bz-fz)*(cy-fy))*kx+((bz-fz)*(cx-fx)-(bx-fx)*(cz-fz))*ky+((bx-fx)*(cy-fy)-(by_-fy)*(cx-fx))*kz AS sa,
   ((cy-fy)*(az-fz)-(cz-fz)*(ay-fy))*kx+((cz-fz)*(ax-fx)-(cx-fx)*(az-fz))*ky+((cx-fx)*(ay-fy)-(cy-fy)*(ax-fx))*kz AS sb,
   ((ay-fy)*(bz-fz)-(az-fz)*(by_-fy))*kx+((az-fz)*(bx-fx)-(ax-fx)*(bz-fz))*ky+((ax-fx)*(by_-fy)-(ay-fy)*(bx-fx))*kz AS sc FROM f)
SELECT id, round(sqrt(CASE WHEN sa >= 0 AND sb >= 0 AND sc >= 0 THEN h*h ELSE edge2 END), 4) AS distance FROM s""")
def m21(t):
    P, A, B, C = (tuple(Cols(f"{k}x", f"{k}y", f"{k}z")) for k in "pabc")
    df = g.add_closest_point(tri(t), P, A, B, C)
    foot = tuple(F.col("foot")[i] for i in range(3))
    return df.select("id", F.round(g.norm(g.sub(P, foot)), 4).alias("distance"))


@query("M22_bounds", q.with_(SCAL) + """, b AS (SELECT id, a AS v, CASE WHEN id % 4 IN (0, 1) THEN -0.1e0 END AS lb,
  CASE WHEN id % 4 IN (0, 2) THEN 1.1e0 END AS ub FROM scal)
SELECT id, round(CASE WHEN lb IS NOT NULL AND ub IS NOT NULL THEN ln((v-lb)/(ub-v)) WHEN lb IS NOT NULL THEN ln(v-lb)
  WHEN ub IS NOT NULL THEN -ln(ub-v) ELSE v END, 4) AS u, round(v, 5) AS back FROM b""")
def m22(t):
    case = F.col("id") % 4
    df = scal(t).select("id", F.col("a").alias("v"), F.when(case.isin(0, 1), -0.1).alias("lb"), F.when(case.isin(0, 2), 1.1).alias("ub"))
    df = df.withColumn("u", g.bounded_to_free(*Cols("v", "lb", "ub")))
    return df.select("id", F.round("u", 4).alias("u"), F.round(g.free_to_bounded(*Cols("u", "lb", "ub")), 5).alias("back"))


@query("M24_cell_labels", """
SELECT c_custkey, chr(CAST(c_nationkey + 65 AS INTEGER)) || (c_custkey % 12 + 1) AS label, CAST(c_nationkey AS INTEGER) AS row,
  CAST(c_custkey % 12 AS INTEGER) AS col FROM customer""")
def m24(t):
    df = t.customer.select("c_custkey", g.cell_label(F.col("c_nationkey"), F.col("c_custkey") % 12).alias("label"))
    row, col = g.parse_cell(F.col("label"))
    return df.select("c_custkey", "label", row.cast("int").alias("row"), col.alias("col"))


@query("M25_reverse_letters", """
WITH c AS (SELECT c_custkey, chr(CAST(c_nationkey + 65 AS INTEGER)) AS letter, c_custkey % 12 + 1 AS num FROM customer),
l AS (SELECT letter, row_number() OVER (ORDER BY letter) AS i, row_number() OVER (ORDER BY letter DESC) AS j FROM (SELECT DISTINCT letter FROM c))
SELECT c_custkey, c.letter || num AS old_label, l2.letter || num AS new_label FROM c JOIN l l1 ON c.letter = l1.letter JOIN l l2 ON l1.i = l2.j""")
def m25(t):
    from gesso.operators.catalog import reverse_row_letters

    cells = t.customer.select("c_custkey", g.cell_label(F.col("c_nationkey"), F.col("c_custkey") % 12).alias("old_label"))
    return reverse_row_letters(cells, "old_label", "new_label")


@query("M30_robust_weights", q.with_(SCAL) + """, r AS (SELECT id, 4*a-2 AS r FROM scal)
SELECT id, round(CASE WHEN abs(r) <= 1 THEN 1 ELSE 1/abs(r) END, 5) AS hw, round(CASE WHEN abs(r) <= 1 THEN r*r/2 ELSE abs(r)-0.5e0 END, 5) AS hc,
  round(1/(1+r*r), 5) AS cw, round(0.5e0*ln(1+r*r), 5) AS cc FROM r""")
def m30(t):
    r = 4 * F.col("a") - 2
    return scal(t).select("id", *rounded(hw=g.huber_weight(r), hc=g.huber_cost(r), cw=g.cauchy_weight(r), cc=g.cauchy_cost(r)))


@query("O6_centre_cell", """
SELECT s_suppkey, CAST(floor((s_nationkey + 1 - 1) / 2e0) AS INTEGER) AS center_row, CAST(floor((s_suppkey % 7) / 2e0) AS INTEGER) AS center_col FROM supplier""")
def o6(t):
    return t.supplier.select("s_suppkey", g.centre_index(F.col("s_nationkey") + 1).alias("center_row"),
                             g.centre_index(F.col("s_suppkey") % 7 + 1).alias("center_col"))


@query("M32_half_spaces", q.with_(SCAL) + """, s AS (SELECT id, 5*a AS sx, 5*b AS sy, c AS sz, 5*b AS qx, 5*c AS qy, a AS qz FROM scal),
  box AS (SELECT min(sx)-0.01e0 AS x0, max(sx)+0.01e0 AS x1, min(sy)-0.01e0 AS y0, max(sy)+0.01e0 AS y1, min(sz)-0.01e0 AS z0, max(sz)+0.01e0 AS z1 FROM s),
  pts AS (SELECT *, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS k FROM s, box),
  pl AS (SELECT id, k, CASE k WHEN 1 THEN 1e0 WHEN 2 THEN -1e0 WHEN 7 THEN qx-sx ELSE 0e0 END AS nx,
   CASE k WHEN 3 THEN 1e0 WHEN 4 THEN -1e0 WHEN 7 THEN qy-sy ELSE 0e0 END AS ny,
   CASE k WHEN 5 THEN 1e0 WHEN 6 THEN -1e0 WHEN 7 THEN qz-sz WHEN 8 THEN 20e0 WHEN 9 THEN -20e0 ELSE 0e0 END AS nz,
   CASE k WHEN 1 THEN x1 WHEN 2 THEN -x0 WHEN 3 THEN y1 WHEN 4 THEN -y0 WHEN 5 THEN z1 WHEN 6 THEN -z0
    WHEN 7 THEN (qx*qx+qy*qy+qz*qz-sx*sx-sy*sy-sz*sz)/2 WHEN 8 THEN (pow(sz+20,2)-sz*sz)/2 ELSE (pow(sz-20,2)-sz*sz)/2 END AS d FROM pts)
SELECT id, round(nx, 5) AS nx, round(ny, 5) AS ny, round(nz, 5) AS nz, round(d, 4) AS d FROM pl""")
def m32(t):
    from gesso.operators.scans import attach

    a, b, c = Cols("a", "b", "c")
    s = scal(t).select("id", (5 * a).alias("sx"), (5 * b).alias("sy"), c.alias("sz"),
                       F.array(F.struct((5 * b).alias("x"), (5 * c).alias("y"), a.alias("z"))).alias("near"))
    box = s.agg(*[f(f"s{k}").alias(f"{k}{i}") for k in "xyz" for i, f in ((0, F.min), (1, F.max))])
    pad = box.select(F.struct(*[(F.col(f"{k}{i}") + (0.01 if i else -0.01)).alias(f"{k}{i}") for k in "xyz" for i in (0, 1)]).alias("box"))
    rows = attach(s, pad, [])
    planes = g.half_spaces(tuple(Cols("sx", "sy", "sz")), (F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.col("near"), F.col("box"))
    out = rows.select("id", F.explode(planes).alias("p"))
    return out.select("id", *rounded(nx=F.col("p.nx") + 0.0, ny=F.col("p.ny") + 0.0, nz=F.col("p.nz") + 0.0), F.round("p.d", 4).alias("d"))
