"""Vectors, transforms, triangles and index arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(v: Vec) -> Column:
    return F.sqrt(dot(v, v))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def unit(v: Vec) -> Vec:
    """Unit vector; null components for a zero vector."""
    n = norm(v)
    return tuple(F.when(n > 0, c / n) for c in v)


def det3(a: Vec, b: Vec, c: Vec) -> Column:
    return dot(a, cross(b, c))


def solve3(m: tuple[Vec, Vec, Vec], r: Vec) -> tuple[Column, Vec]:
    """Determinant and Cramer numerators of a 3x3 system given by rows."""
    cols = tuple(zip(*m))
    det = det3(*cols)
    return det, (det3(r, cols[1], cols[2]), det3(cols[0], r, cols[2]), det3(cols[0], cols[1], r))


def tilt_slant_to_light(tilt_deg: Column, slant_deg: Column) -> Vec:
    """Spherical angles to a unit direction; slant is measured from the view axis."""
    t, s = F.radians(tilt_deg), F.radians(slant_deg)
    return (F.sin(s) * F.cos(t), F.sin(s) * F.sin(t), F.cos(s))


def light_to_tilt_slant(v: Vec) -> tuple[Column, Column]:
    """Tilt in (-180, 180], slant in [0, 180]."""
    return F.degrees(F.atan2(v[1], v[0])), F.degrees(F.acos(F.least(F.greatest(v[2], F.lit(-1.0)), F.lit(1.0))))


def normal_to_rgb(v: Vec, depth: int = 8) -> Vec:
    """Map [-1,1] to integer channels, half to even."""
    top = 255.0 if depth == 8 else 65535.0
    return tuple(F.rint((c + 1) / 2 * top).cast("int") for c in v)


def rgb_to_normal(rgb: Vec, depth: int = 8) -> Vec:
    """Inverse of ``normal_to_rgb``, brought to unit length."""
    top = 255.0 if depth == 8 else 65535.0
    return unit(tuple(c / top * 2 - 1 for c in rgb))


def clip_normals(v: Vec) -> Vec:
    def limit(c: Column, low: float) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(1.0), c))

    return limit(v[0], -1.0), limit(v[1], -1.0), limit(v[2], 0.0)


def fill_normals(v: Vec) -> Vec:
    """Missing normals become (0, 0, 0.5)."""
    return tuple(F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(d)) for c, d in zip(v, (0.0, 0.0, 0.5)))


# -- planar transforms: h is an array of 9 doubles, row major ----------------

IDENTITY9 = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def lit_matrix(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def apply_homography(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Transformed point; null where the denominator is zero."""
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def compose(a: Column, b: Column) -> Column:
    """Matrix product of two 9-arrays."""
    cells = []
    for r in range(3):
        for c in range(3):
            cells.append(a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c])
    return F.array(*cells)


def translate(h: Column, dx: Column, dy: Column) -> Column:
    """Shift applied after ``h``."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return compose(F.array(one, zero, dx, zero, one, dy, zero, zero, one), h)


def translation_only(h: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(one, zero, h[2], zero, one, h[5], zero, zero, one)


def rotation_degrees(h: Column) -> Column:
    """Angle of the rotation closest to the upper-left 2x2 block."""
    return F.degrees(F.atan2(h[3] - h[1], h[0] + h[4]))


def to_rigid_2d(h: Column) -> tuple[Column, Column, Column, Column]:
    """Closest proper rotation (cos, sin) and translation of h / h22."""
    a, b, c, d = (h[i] / h[8] for i in (0, 1, 3, 4))
    length = F.sqrt((a + d) * (a + d) + (c - b) * (c - b))
    cos = F.when(length > 0, (a + d) / length).otherwise(1.0)
    sin = F.when(length > 0, (c - b) / length).otherwise(0.0)
    return cos, sin, h[2] / h[8], h[5] / h[8]


def to_rigid_3d(cos: Column, sin: Column, tx: Column, ty: Column, pano_h: Column, image_h: Column) -> Column:
    """16-array, y axis flipped so the origin stays at the image's lower left."""
    zero, one = F.lit(0.0), F.lit(1.0)
    # flip R flip = [[cos, sin], [-sin, cos]]; flip (0, image_h) = (0, -image_h)
    x = tx - sin * image_h
    y = pano_h - ty - cos * image_h
    return F.array(cos, sin, zero, x, -sin, cos, zero, y, zero, zero, one, zero, zero, zero, zero, one)


def euler_zyx(m: Column) -> tuple[Column, Column, Column]:
    """Roll, pitch, yaw in degrees of a 16-array."""
    sy = F.sqrt(m[0] * m[0] + m[4] * m[4])
    flat = sy < 1e-6
    roll = F.when(flat, F.atan2(-m[6], m[5])).otherwise(F.atan2(m[9], m[10]))
    pitch = F.atan2(-m[8], sy)
    yaw = F.when(flat, F.lit(0.0)).otherwise(F.atan2(m[4], m[0]))
    return F.degrees(roll), F.degrees(pitch), F.degrees(yaw)


def undistort_coords(x: Column, y: Column, fx: float, fy: float, cx: float, cy: float, k, p) -> tuple[Column, Column]:
    """Where an undistorted pixel comes from in the distorted image.

    ``k`` = (k1, k2, k3) radial and ``p`` = (p1, p2) tangential terms.
    """
    u, v = (x - cx) / fx, (y - cy) / fy
    r2 = u * u + v * v
    radial = 1 + k[0] * r2 + k[1] * r2 * r2 + k[2] * r2 * r2 * r2
    du = u * radial + 2 * p[0] * u * v + p[1] * (r2 + 2 * u * u)
    dv = v * radial + p[0] * (r2 + 2 * v * v) + 2 * p[1] * u * v
    return fx * du + cx, fy * dv + cy


# -- triangles ---------------------------------------------------------------


def triangle_area2(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area in the plane."""
    return (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)


def barycentric(px, py, ax, ay, bx, by, cx, cy) -> Vec:
    whole = triangle_area2(ax, ay, bx, by, cx, cy)
    wa = F.try_divide(triangle_area2(px, py, bx, by, cx, cy), whole)
    wb = F.try_divide(triangle_area2(ax, ay, px, py, cx, cy), whole)
    return wa, wb, 1 - wa - wb


def inside(weights: Vec, slack: float = 0.0) -> Column:
    low = F.lit(-slack)
    return (weights[0] >= low) & (weights[1] >= low) & (weights[2] >= low)


def facet_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    return unit(cross(sub(b, a), sub(c, a)))


def face_center(a: Vec, b: Vec, c: Vec) -> Vec:
    return tuple((p + q + r) / 3 for p, q, r in zip(a, b, c))


def view_angle(normal: Vec, center: Vec, eye: Vec) -> Column:
    """Degrees between the facet normal and the direction to the eye."""
    cosine = dot(normal, unit(sub(eye, center)))
    return F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


def add_closest_point(df: DataFrame, p: Vec, a: Vec, b: Vec, c: Vec, out: str = "foot") -> DataFrame:
    """Adds ``out`` = array(x, y, z): the point of a triangle nearest to ``p``.

    The foot of the perpendicular counts if its barycentric weights are not
    negative. Otherwise the nearest point lies on an edge: of the three clamped
    feet on the edges the closest one, the first of equal ones. A triangle
    without area has edges only.
    """
    u, v, q = sub(b, a), sub(c, a), sub(p, a)
    df = df.withColumns({"_uu": dot(u, u), "_uv": dot(u, v), "_vv": dot(v, v), "_qu": dot(q, u), "_qv": dot(q, v)})
    uu, uv, vv, qu, qv = (F.col(n) for n in ("_uu", "_uv", "_vv", "_qu", "_qv"))
    area = uu * vv - uv * uv
    df = df.withColumns({"_wb": F.try_divide(vv * qu - uv * qv, area), "_wc": F.try_divide(uu * qv - uv * qu, area)})
    wb, wc = F.col("_wb"), F.col("_wc")
    inside = F.coalesce((wb >= 0) & (wc >= 0) & (wb + wc <= 1), F.lit(False))

    def on_edge(order: int, s: Vec, e: Vec) -> Column:
        way = sub(e, s)
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot(sub(p, s), way), dot(way, way)), F.lit(0.0))))
        at = tuple(s[i] + share * way[i] for i in range(3))
        gap = sub(p, at)
        return F.struct(dot(gap, gap).alias("d"), F.lit(order).alias("o"), F.array(*at).alias("at"))

    df = df.withColumns({f"_e{i}": on_edge(i, s, e) for i, (s, e) in enumerate(((a, b), (b, c), (c, a)))})
    edge = F.least("_e0", "_e1", "_e2")["at"]
    middle = F.array(*[a[i] + wb * u[i] + wc * v[i] for i in range(3)])
    return df.withColumn(out, F.when(inside, middle).otherwise(edge)).drop("_uu", "_uv", "_vv", "_qu", "_qv", "_wb", "_wc", "_e0", "_e1", "_e2")


def order_corners(points: Column, angle: int = 0) -> Column:
    """Four corner structs (x, y): top left, top right, bottom left, bottom
    right of the image turned by ``angle`` (0, 90, -90, 180)."""

    def extreme(key, largest: bool) -> Column:
        ranked = F.transform(points, lambda p: F.struct(key(p).alias("k"), p.x.alias("x"), p.y.alias("y")))
        pick = F.array_max(ranked) if largest else F.array_min(ranked)
        return F.struct(pick.x.alias("x"), pick.y.alias("y"))

    near, far = extreme(lambda p: p.x + p.y, False), extreme(lambda p: p.x + p.y, True)
    right, left = extreme(lambda p: p.y - p.x, False), extreme(lambda p: p.y - p.x, True)
    order = {0: (near, right, left, far), 90: (right, far, near, left), -90: (left, near, far, right), 180: (far, left, right, near)}
    return F.array(*order[angle])


def corner_ranks(points: Column) -> Column:
    """Positions of the corners sorted by angle around their centroid."""
    n = F.size(points)
    cx = F.aggregate(points, F.lit(0.0), lambda s, p: s + p.x) / n
    cy = F.aggregate(points, F.lit(0.0), lambda s, p: s + p.y) / n
    keyed = F.transform(points, lambda p, i: F.struct(F.atan2(p.y - cy, p.x - cx).alias("t"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s.i)


def same_cyclic_order(a: Column, b: Column) -> Column:
    return corner_ranks(a) == corner_ranks(b)


def is_horizontal(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return (F.array_max(xs) - F.array_min(xs)) > (F.array_max(ys) - F.array_min(ys))


def half_spaces(s: Vec, n: Vec, neighbours: Column, box: Column, reach: float = 20.0) -> Column:
    """Array of planes (nx, ny, nz, d) with n.x <= d around a sample: the six
    box sides, the bisector to each neighbour and to two points off the surface.

    ``neighbours`` is an array of structs x, y, z; ``box`` a struct of bounds.
    """

    def plane(a, b, c, d) -> Column:
        return F.struct(a.alias("nx"), b.alias("ny"), c.alias("nz"), d.alias("d"))

    zero, one = F.lit(0.0), F.lit(1.0)
    sides = [
        plane(one, zero, zero, box.x1), plane(-one, zero, zero, -box.x0),
        plane(zero, one, zero, box.y1), plane(zero, -one, zero, -box.y0),
        plane(zero, zero, one, box.z1), plane(zero, zero, -one, -box.z0),
    ]
    own = dot(s, s)

    def bisector(q: Vec) -> Column:
        return plane(q[0] - s[0], q[1] - s[1], q[2] - s[2], (dot(q, q) - own) / 2)

    off = [bisector(tuple(a + sign * reach * b for a, b in zip(s, n))) for sign in (1.0, -1.0)]
    return F.concat(F.array(*sides), F.transform(neighbours, lambda q: bisector((q.x, q.y, q.z))), F.array(*off))


# -- bounds, weights, sampling -----------------------------------------------


def bounded_to_free(v: Column, lb: Column, ub: Column) -> Column:
    """Logit or log map of a bounded value; null bound = unbounded."""
    inf = F.lit(float("inf"))
    share = (v - lb) / (ub - lb)
    both = F.when(share <= 0, -inf).when(share >= 1, inf).otherwise(F.ln(share / (1 - share)))
    low = F.when(v <= lb, -inf).otherwise(F.ln(v - lb))
    high = F.when(v >= ub, inf).otherwise(-F.ln(ub - v))
    return (
        F.when(lb.isNotNull() & ub.isNotNull(), both).when(lb.isNotNull(), low).when(ub.isNotNull(), high).otherwise(v)
    )


def free_to_bounded(u: Column, lb: Column, ub: Column) -> Column:
    """Inverse of ``bounded_to_free``; exponents beyond +-709 land on the bound."""
    both = lb + (ub - lb) / (1 + F.exp(-u))
    low = F.when(u < -709, lb).otherwise(lb + F.exp(u))
    high = F.when(u > 709, ub).otherwise(ub - F.exp(-u))
    return (
        F.when(lb.isNotNull() & ub.isNotNull(), both).when(lb.isNotNull(), low).when(ub.isNotNull(), high).otherwise(u)
    )


def huber_weight(r: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(r) <= delta, F.lit(1.0)).otherwise(delta / F.abs(r))


def huber_cost(r: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(r) <= delta, r * r / 2).otherwise(delta * (F.abs(r) - delta / 2))


def cauchy_weight(r: Column, scale: float = 1.0) -> Column:
    return 1 / (1 + r * r / (scale * scale))


def cauchy_cost(r: Column, scale: float = 1.0) -> Column:
    return scale * scale / 2 * F.log1p(r * r / (scale * scale))


def hemisphere_dir(i: Column, n: int) -> Vec:
    """Direction ``i`` of ``n`` of a Fibonacci lattice on the upper half sphere."""
    turn = 2 * math.pi / ((1 + math.sqrt(5)) / 2)
    z = 1 - (2 * i + 1) / (2 * n)
    r = F.sqrt(1 - z * z)
    return r * F.cos(turn * i), r * F.sin(turn * i), z


# -- grid labels -------------------------------------------------------------


def number_to_letter(n: Column) -> Column:
    """1 -> A, 26 -> Z."""
    return F.char((n + 64).cast("bigint"))


def letter_to_number(s: Column) -> Column:
    return F.ascii(F.upper(s)) - 64


def cell_label(row: Column, col: Column) -> Column:
    """0-based row and column to a label such as B3."""
    return F.concat(number_to_letter(row + 1), (col + 1).cast("string"))


CELL_PATTERN = r"^([A-Za-z])(\d+)$"


def parse_cell(label: Column) -> tuple[Column, Column]:
    """0-based row and column of a label; null where it is no label."""
    ok = label.rlike(CELL_PATTERN)
    row = F.when(ok, letter_to_number(F.regexp_extract(label, CELL_PATTERN, 1)) - 1)
    col = F.when(ok, F.regexp_extract(label, CELL_PATTERN, 2).cast("int") - 1)
    return row, col


def centre_index(n: Column) -> Column:
    """Middle index; the lower one for even sizes."""
    return F.floor((n - 1) / 2).cast("int")


def spiral_rank(row: Column, col: Column, rows: Column, cols: Column) -> Column:
    """Order key of an outward spiral (right, down, left, up) from the centre.

    Positions outside the grid are skipped by the walk, which leaves the
    relative order of the inside ones unchanged, so the closed form of the
    unbounded spiral is a valid key.
    """
    dr, dc = row - centre_index(rows), col - centre_index(cols)
    k = F.greatest(F.abs(dr), F.abs(dc))
    start = (2 * k - 1) * (2 * k - 1)
    # each ring starts at (-k+1, k), goes down the right side, left, up, right
    right = start + dr + k - 1
    bottom = start + 2 * k - 1 + (k - dc)
    left = start + 4 * k - 1 + (k - dr)
    top = start + 6 * k - 1 + (dc + k)
    return (
        F.when(k == 0, 0)
        .when((dc == k) & (dr > -k), right)
        .when(dr == k, bottom)
        .when(dc == -k, left)
        .otherwise(top)
        .cast("bigint")
    )


def radial_key(row: Column, col: Column, rows: Column, cols: Column) -> Column:
    """(ring, row, col) struct: rings outward, each in row-major order."""
    dr, dc = row - centre_index(rows), col - centre_index(cols)
    return F.struct(F.greatest(F.abs(dr), F.abs(dc)).alias("ring"), dr.alias("dr"), dc.alias("dc"))
