"""Colour functions over measured patches (part table)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gesso.functions import color as c
from gesso.functions import geometry as g
from gesso.queries import sqltext as q
from gesso.queries.standins import Cols, patches, reference, rounded
from gesso.registry import query

RGB = Cols("c0", "c1", "c2")
RGB_SQL = ["c0", "c1", "c2"]


def _triple_sql(exprs, names, digits=5):
    return ", ".join(f"round({e}, {digits}) AS {n}" for e, n in zip(exprs, names))


_paired = q.with_(
    q.PATCHES, q.REFERENCE,
    "pair AS (SELECT patch_id, "
    + ", ".join(f"{e} AS {n}" for e, n in zip(q.lab(RGB_SQL), ["l1", "a1", "b1"])) + ", "
    + ", ".join(f"{e} AS {n}" for e, n in zip(q.lab(["r0", "r1", "r2"]), ["l2", "a2", "b2"]))
    + " FROM patches JOIN reference USING (patch_no))",
    q.ciede_ctes("pair", "patch_id"),
)


@query("M1_ciede2000", _paired + "SELECT patch_id, round(de00, 4) AS de00 FROM de")
def m1(t):
    joined = patches(t).join(F.broadcast(reference(t)), "patch_no")
    scored = c.add_delta_e(joined, RGB, Cols("r0", "r1", "r2"), "de", "xyz")
    return scored.select("patch_id", F.round("de", 4).alias("de00"))


@query("M1_delta_e_linear_rgb", q.with_(
    q.PATCHES, q.REFERENCE,
    "pair AS (SELECT patch_id, "
    + ", ".join(f"{e} AS {n}" for e, n in zip(q.lab(q.matrix(c.RGB_TO_XYZ, RGB_SQL)), ["l1", "a1", "b1"])) + ", "
    + ", ".join(f"{e} AS {n}" for e, n in zip(q.lab(q.matrix(c.RGB_TO_XYZ, ["r0", "r1", "r2"])), ["l2", "a2", "b2"]))
    + " FROM patches JOIN reference USING (patch_no))",
    q.ciede_ctes("pair", "patch_id")) + "SELECT patch_id, round(de00, 4) AS de00 FROM de")
def m1_linear(t):
    joined = patches(t).join(F.broadcast(reference(t)), "patch_no")
    scored = c.add_delta_e(joined, RGB, Cols("r0", "r1", "r2"), "de", "linear_rgb")
    return scored.select("patch_id", F.round("de", 4).alias("de00"))


@query("M2_srgb_linear", q.with_(q.PATCHES) + f"""
SELECT patch_id, {_triple_sql([q.to_linear(x) for x in RGB_SQL], ['lin0', 'lin1', 'lin2'])},
       {_triple_sql([q.to_srgb(x) for x in RGB_SQL], ['enc0', 'enc1', 'enc2'])} FROM patches""")
def m2(t):
    return patches(t).select(
        "patch_id",
        *[F.round(c.srgb_to_linear(x), 5).alias(f"lin{i}") for i, x in enumerate(RGB)],
        *[F.round(c.linear_to_srgb(x), 5).alias(f"enc{i}") for i, x in enumerate(RGB)],
    )


@query("M3_rgb_xyz_lab", q.with_(q.PATCHES) + f"""
SELECT patch_id, {_triple_sql(q.matrix(c.RGB_TO_XYZ, RGB_SQL), ['x', 'y', 'z'])},
       {_triple_sql(q.lab(q.matrix(c.RGB_TO_XYZ, RGB_SQL)), ['l', 'a', 'b'])},
       round(CASE WHEN c1 = 0 THEN 0 ELSE c0 * c2 / c1 END, 5) AS xyy_x,
       round(CASE WHEN c1 = 0 THEN 0 ELSE (1 - c0 - c1) * c2 / c1 END, 5) AS xyy_z FROM patches""")
def m3(t):
    xyz = c.rgb_to_xyz(RGB)
    lab = c.xyz_to_lab(xyz)
    xyy = c.xyy_to_xyz(*RGB)
    return patches(t).select("patch_id", *rounded(
        x=xyz[0], y=xyz[1], z=xyz[2], l=lab[0], a=lab[1], b=lab[2], xyy_x=xyy[0], xyy_z=xyy[2]))


def _lab_back_sql(v):
    fy = f"(({v[0]}) + 16) / 116e0"
    fs = [f"({fy} + ({v[1]}) / 500e0)", f"({fy})", f"({fy} - ({v[2]}) / 200e0)"]
    xyz = [
        f"((CASE WHEN {f} > 6 / 29e0 THEN pow({f}, 3) ELSE ({f} - 4 / 29e0) * (3 * pow(6 / 29e0, 2)) END) * {w!r}::DOUBLE)"
        for f, w in zip(fs, c.WHITE_D65)
    ]
    return [q.clip01(q.to_srgb(e)) for e in q.matrix(np.linalg.inv(np.array(c.RGB_TO_XYZ)).tolist(), xyz)]


_LAB_IN = ["100e0 * c0", "60e0 * c1 - 30e0", "60e0 * c2 - 30e0"]


@query("M4_lab_rgb", q.with_(q.PATCHES) + f"""
SELECT patch_id, {_triple_sql(_lab_back_sql(_LAB_IN), ['r', 'g', 'b'])},
  {_triple_sql(q.lab(q.matrix(c.RGB_TO_XYZ, [q.to_linear(q.clip01(q.to_srgb(x))) for x in RGB_SQL])), ['ll', 'la', 'lb'], 4)},
  {_triple_sql(q.lab(q.matrix(c.RGB_TO_XYZ, [q.to_linear(x) for x in RGB_SQL])), ['sl', 'sa', 'sb'], 4)} FROM patches""")
def m4(t):
    rgb = c.lab_to_rgb((100.0 * RGB[0], 60.0 * RGB[1] - 30.0, 60.0 * RGB[2] - 30.0))
    lin, enc = c.linear_to_lab(RGB), c.rgb_to_lab(RGB)
    return patches(t).select(
        "patch_id", *rounded(r=rgb[0], g=rgb[1], b=rgb[2]),
        *rounded(4, ll=lin[0], la=lin[1], lb=lin[2], sl=enc[0], sa=enc[1], sb=enc[2]))


_D50 = c.adaptation_matrix("BRADFORD", c._white_xyz(c.WHITE_10DEG_D50_XY), c._white_xyz(c.WHITE_10DEG_D65_XY))


@query("M5_output_spaces", q.with_(q.PATCHES) + f"""
SELECT patch_id, {_triple_sql(q.xyz_to_srgb(RGB_SQL), ['s0', 's1', 's2'])},
  {_triple_sql(q.xyz_to_srgb(q.matrix(_D50, RGB_SQL)), ['d0', 'd1', 'd2'])},
  {_triple_sql(q.matrix(c.CIE_RGB_TO_XYZ, RGB_SQL), ['e0', 'e1', 'e2'])},
  {_triple_sql(q.matrix(c.XYZ_TO_CIE_RGB, RGB_SQL), ['f0', 'f1', 'f2'])},
  {_triple_sql(q.matrix(c.PROPHOTO_TO_XYZ_D50, [f'pow({x}, 1.8e0)' for x in RGB_SQL]), ['p0', 'p1', 'p2'])},
  round(pow(c0, 2.2e0), 5) AS adobe_lin, round(pow(c0, 1 / 2.2e0), 5) AS adobe_enc,
  round(CASE WHEN c1 <= 0.031248e0 THEN c1 / 16 ELSE pow(c1, 1.8e0) END, 5) AS pro_lin,
  round(CASE WHEN c1 <= 0.001953e0 THEN c1 * 16 ELSE pow(c1, 1 / 1.8e0) END, 5) AS pro_enc FROM patches""")
def m5(t):
    s, d, e = c.xyz_to_srgb(RGB), c.xyz_to_srgb(RGB, "d50"), c.cie_rgb_to_xyz(RGB)
    f, p = c.xyz_to_cie_rgb(RGB), c.prophoto_to_xyz_d50(RGB)
    named = {f"{k}{i}": v[i] for k, v in (("s", s), ("d", d), ("e", e), ("f", f), ("p", p)) for i in range(3)}
    return patches(t).select("patch_id", *rounded(
        **named, adobe_lin=c.adobe_to_linear(RGB[0]), adobe_enc=c.linear_to_adobe(RGB[0]),
        pro_lin=c.prophoto_to_linear(RGB[1]), pro_enc=c.linear_to_prophoto(RGB[1])))


def _srgb_cte(v, keep="patch_id"):
    return f"enc AS (SELECT {keep}, " + ", ".join(f"{e} AS {n}" for e, n in zip(q.xyz_to_srgb(v), "rgb")) + " FROM patches)"


@query("M6_xyz_hsv", q.with_(
    q.PATCHES, _srgb_cte(RGB_SQL), q.hsv_ctes("enc", "hsv"), q.hsv_to_rgb_ctes("hsv", "back")) + f"""
SELECT patch_id, round(h, 4) AS h, round(s, 5) AS s, round(val, 5) AS v,
  {_triple_sql(q.matrix(c.SRGB_LINEAR_MATRIX, [
      f"(CASE WHEN {e} <= 0.04045e0 THEN {e} / 12.92e0 ELSE pow(({e} + 0.055e0) / 1.055e0, 2.4e0) END)" for e in ("r2", "g2", "b2")]),
      ['x', 'y', 'z'], 4)} FROM back""")
def m6(t):
    out = c.add_hsv_of_xyz(patches(t), RGB, "_")
    out = c.add_xyz_from_hsv(out, Cols("_h", "_s", "_v"), ("x", "y", "z"))
    return out.select("patch_id", F.round("_h", 4).alias("h"), *rounded(s=F.col("_s"), v=F.col("_v")),
                      *rounded(4, x=F.col("x"), y=F.col("y"), z=F.col("z")))


@query("M7_luminance_exposure", q.with_(q.PATCHES) + """
SELECT patch_id, round(0.299e0*c0 + 0.587e0*c1 + 0.114e0*c2, 5) AS y1,
  round(0.299e0*pow(c0,2.2e0) + 0.587e0*pow(c1,2.2e0) + 0.114e0*pow(c2,2.2e0), 5) AS y2,
  round(0.2126729e0*c0 + 0.7151522e0*c1 + 0.0721750e0*c2, 5) AS y3,
  round(0.2126e0*c0 + 0.7152e0*c1 + 0.0722e0*c2, 5) AS y4,
  round(least(greatest((c0 - 0.5e0) * (400 * c1 / 100e0 * (1 / 8e0) / (c2 * c2)), -0.5e0), 0.5e0), 5) AS factor FROM patches""")
def m7(t):
    factor = c.exposure_factor(RGB[0] - 0.5, 400 * RGB[1], F.lit(1 / 8), RGB[2])
    return patches(t).select("patch_id", *rounded(
        **{f"y{k}": c.luminance(RGB, k) for k in (1, 2, 3, 4)}, factor=factor))


_SRC, _DST = (0.9, 1.0, 0.8), c.WHITE_D65


@query("M8_white_balance", q.with_(q.PATCHES) + "SELECT patch_id, " + ", ".join(
    _triple_sql(q.matrix(c.adaptation_matrix(cat, _SRC, _DST), RGB_SQL), [f"{cat.lower()}_{i}" for i in range(3)])
    for cat in c.CAT_MATRICES) + " FROM patches")
def m8(t):
    out = {}
    for cat in c.CAT_MATRICES:
        for i, v in enumerate(c.white_balance(RGB, _SRC, _DST, cat)):
            out[f"{cat.lower()}_{i}"] = v
    return patches(t).select("patch_id", *rounded(**out))


_EXPOSURE = {"low": 0.1, "expected_range": 0.8, "measured_range": 0.9, "saturation_ratio": 1.1, "measured_black": 0.05}


@query("M12_exposure_apply", q.with_(
    q.PATCHES, _srgb_cte(RGB_SQL), q.hsv_ctes("enc", "hsv"),
    "moved AS (SELECT patch_id, h, s / 1.1e0 AS s, greatest(0e0, least(1e0, 0.1e0 + (val - 0.05e0) * 0.8e0 / 0.9e0)) AS val FROM hsv)",
    q.hsv_to_rgb_ctes("moved", "back")) + f"""
SELECT patch_id, {_triple_sql(q.matrix(c.SRGB_LINEAR_MATRIX, [
      f"(CASE WHEN {e} <= 0.04045e0 THEN {e} / 12.92e0 ELSE pow(({e} + 0.055e0) / 1.055e0, 2.4e0) END)" for e in ("r2", "g2", "b2")]),
      ['x', 'y', 'z'], 4)} FROM back""")
def m12(t):
    out = c.add_exposure(patches(t), RGB, _EXPOSURE, ("x", "y", "z"), clip=True)
    return out.select("patch_id", *rounded(4, x=F.col("x"), y=F.col("y"), z=F.col("z")))


@query("M28_ycbcr_grey", q.with_(q.PATCHES) + """
SELECT patch_id, round(0.299e0*c0 + 0.587e0*c1 + 0.114e0*c2, 5) AS yy,
  round(-0.168736e0*c0 - 0.331264e0*c1 + 0.5e0*c2 + 0.5e0, 5) AS cb,
  round(0.5e0*c0 - 0.418688e0*c1 - 0.081312e0*c2 + 0.5e0, 5) AS cr FROM patches""")
def m28(t):
    y, cb, cr = c.rgb_to_ycbcr(RGB)
    return patches(t).select("patch_id", *rounded(yy=y, cb=cb, cr=cr))


_NAMES = "[" + ", ".join("'" + n + "'" for n in c.PATCH_NAMES) + "]"


@query("M29_patch_name", f"""
SELECT p_partkey, CASE WHEN p_size - 10 BETWEEN 0 AND 23 THEN {_NAMES}[p_size - 9] ELSE 'Invalid index' END AS name FROM part""")
def m29(t):
    return t.part.select("p_partkey", c.patch_name(F.col("p_size") - 10).alias("name"))


@query("P28_profile_kind", """
SELECT page_id, CASE WHEN contains(d, 'display p3') THEN 'display-p3' WHEN contains(d, 'srgb') THEN 'srgb' ELSE 'none' END AS kind
FROM (SELECT page_id, lower(CASE WHEN contains(url, '/fr/') THEN 'Display P3 of ' WHEN contains(url, '/en/') THEN 'sRGB IEC of ' ELSE '' END || url) AS d FROM pages)""")
def p28(t):
    url = F.col("url")
    description = F.concat(
        F.when(url.contains("/fr/"), "Display P3 of ").when(url.contains("/en/"), "sRGB IEC of ").otherwise(""), url)
    return t.pages.select("page_id", c.profile_kind(description).alias("kind"))


@query("M9_vector_algebra", q.with_(q.PATCHES) + """
SELECT patch_id, round(c0 / n, 5) AS ux, round(c1 / n, 5) AS uy, round(c2 / n, 5) AS uz, round(n, 5) AS n,
  round(c0 * c1 + c1 * c2 + c2 * c0, 5) AS d, round(c1 * c0 - c2 * c2, 5) AS kx, round(c2 * c1 - c0 * c0, 5) AS ky,
  round(c0 * c2 - c1 * c1, 5) AS kz FROM (SELECT *, sqrt(c0*c0 + c1*c1 + c2*c2) AS n FROM patches)""")
def m9(t):
    other = (RGB[1], RGB[2], RGB[0])
    u, k = g.unit(RGB), g.cross(RGB, other)
    return patches(t).select("patch_id", *rounded(
        ux=u[0], uy=u[1], uz=u[2], n=g.norm(RGB), d=g.dot(RGB, other), kx=k[0], ky=k[1], kz=k[2]))
