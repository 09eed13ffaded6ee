"""Reader and writer round trips below the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from gesso.functions import geometry as g
from gesso.operators import relief as r
from gesso.operators import sessions as s
from gesso.plans import mosaic as mo
from gesso.plans.plugins import Registry, run_sequence
from gesso.queries import sqltext as q
from gesso.queries.calibration_queries import HEAD, _DE, scored
from gesso.queries.catalog_queries import CELLS, cells
from gesso.queries.grid_queries import DIMS
from gesso.queries.mesh_queries import COST, PCT, costs
from gesso.queries.mosaic_queries import IMG_H, KP, _WARP, _warp_select, image_transforms, keypoints
from gesso.queries.standins import grid, lights, observations, patches, reference, rounded
from gesso.registry import query
from gesso.session import scratch_path
from gesso.sources import documents as d
from gesso.sources import images as im
from gesso.sources import tables as tb


@query("S1_read_project_docs", "SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS title, s_acctbal AS stepx, CAST(s_nationkey AS INTEGER) AS width FROM supplier")
def s1(t):
    path = scratch_path(t.spark, "projects")
    docs = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("stepx"), F.col("s_nationkey").alias("width"), F.lit("x").alias("unknown_key"))
    d.write_project_docs(docs, path)
    return d.read_project_docs(t.spark, path).where("_corrupt_record IS NULL").select("id", "title", "stepx", "width")


@query("S2_write_project_docs", "SELECT CAST(s_suppkey AS VARCHAR) AS folder, 1::BIGINT AS documents FROM supplier")
def s2(t):
    path = scratch_path(t.spark, "projects")
    d.write_project_docs(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")), path)
    raw = t.spark.read.text(path)
    return raw.groupBy(F.col("_k").cast("string").alias("folder")).agg(F.count("*").alias("documents"))


@query("S3_session_round_trip", "SELECT CAST(o_orderkey AS VARCHAR) AS key, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS value FROM orders")
def s3(t):
    path = scratch_path(t.spark, "session")
    d.save_session(t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("value")), path)
    return d.load_session(t.spark, path)


@query("S4_find_files", "SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '.TIF' ELSE '.png' END AS path FROM pages WHERE page_id % 2 = 0")
def s4(t):
    files = t.pages.select("page_id", F.concat("url", F.when(F.col("page_id") % 2 == 0, ".TIF").otherwise(".png")).alias("path"))
    return files.where(im.has_extension(F.col("path"), "tif"))


_FILES = "fl AS (SELECT c_custkey AS id, chr(CAST(c_nationkey + 65 AS INTEGER)) || (c_custkey % 12 + 1) AS folder, c_nationkey AS r, c_custkey % 12 AS c, c_custkey || CASE WHEN c_custkey % 3 = 0 THEN 'albedo.tif' ELSE 'depth.tif' END AS name FROM customer)"


def files(t):
    k = F.col("c_custkey")
    name = F.concat(k.cast("string"), F.when(k % 3 == 0, "albedo.tif").otherwise("depth.tif"))
    label = g.cell_label(F.col("c_nationkey"), k % 12)
    return im.file_parts(t.customer.select(F.concat(F.lit("/data/maps/"), label, F.lit("/"), name).alias("path")))


@query("S5_scan_grid", "WITH " + _FILES + " SELECT DISTINCT folder, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM fl")
def s5(t):
    return im.scan_grid(files(t)).select("folder", F.col("row").cast("int").alias("row"), "col")


@query("S6_pick_cell_file", "WITH " + _FILES + " SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, min(name) AS name FROM fl WHERE id % 3 = 0 GROUP BY 1, 2")
def s6(t):
    return im.pick_cell_file(files(t), "albedo").select(F.col("row").cast("int").alias("row"), "col", "name")


@query("S7_load_image_stack", q.with_(q.GRID, DIMS) + """, r AS (SELECT image_id AS light_id, y, x, h, 255 * v / 1.05e0 AS c1 FROM grid JOIN dims USING (image_id)), k AS (SELECT light_id, CAST(h - 1 - y AS INTEGER) AS y, x, c1 / 255 AS i FROM r),
 p AS (SELECT light_id, quantile_cont(i, 0.95) AS p FROM k GROUP BY light_id) SELECT light_id, y, x, round(i / p, 5) AS intensity FROM k JOIN p USING (light_id)""")
def s7(t):
    v = F.col("v")
    px = grid(t).select(F.col("image_id").alias("light_id"), "y", "x", (v * 10).alias("c0"), (255 * v / 1.05).alias("c1"), v.alias("c2"))
    return im.load_image_stack(px, 1, 1, 0.95).select("light_id", "y", "x", F.round("intensity", 5).alias("intensity"))


_MEASURED = "ml AS (SELECT light_id, avg(intensity) AS lx, max(intensity) AS ly, min(intensity) AS lz FROM obs GROUP BY light_id)"


def measured_lights(t):
    return observations(t).groupBy("light_id").agg(F.avg("intensity").alias("lx"), F.max("intensity").alias("ly"), F.min("intensity").alias("lz"))


@query("S8_lights_text", q.with_(q.OBS, _MEASURED) + "SELECT light_id, round(lx, 5) AS lx, round(ly, 5) AS ly, round(lz, 5) AS lz FROM ml")
def s8(t):
    path = scratch_path(t.spark, "lights")
    d.write_lights(measured_lights(t), path)
    return d.read_lights(t.spark, path).select("light_id", *rounded(lx=F.col("lx"), ly=F.col("ly"), lz=F.col("lz")))


@query("S9_import_lights", q.with_(q.OBS, _MEASURED) + "SELECT light_id, round(lx, 5) AS lx, light_id % 2 = 0 AS enabled FROM ml")
def s9(t):
    path = scratch_path(t.spark, "lights.json")
    d.export_lights(measured_lights(t).withColumn("enabled", F.col("light_id") % 2 == 0), path)
    return d.import_lights(t.spark, path).select("light_id", F.round("lx", 5).alias("lx"), "enabled")


@query("S10_read_reference_chart", q.with_(q.PATCHES, q.REFERENCE) + "SELECT patch_no, round(r0, 5) AS r0, round(r1, 5) AS r1, round(r2, 5) AS r2 FROM reference")
def s10(t):
    path = scratch_path(t.spark, "chart")
    one = reference(t).agg(F.map_from_entries(F.collect_list(F.struct(F.col("patch_no").cast("string"), F.array("r0", "r1", "r2")))).alias("m"))
    one.select(F.struct(F.struct(F.col("m").alias("referenceXYZValues")).alias("TARGET")).alias("CONFIG")).coalesce(1).write.json(path)
    return d.read_reference_chart(t.spark, path, "referenceXYZValues").select("patch_no", *rounded(r0=F.col("r0"), r1=F.col("r1"), r2=F.col("r2")))


@query("S11_params_round_trip", """SELECT CAST(s_suppkey AS VARCHAR) AS image_id, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS low, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey::DOUBLE END AS w0, '{"k":' || s_nationkey || '}' AS note FROM supplier""")
def s11(t):
    path = scratch_path(t.spark, "params")
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    rows = t.supplier.select(
        k.cast("string").alias("image_id"), F.when(k % 2 == 0, F.struct(bal.alias("expected_minimum"), F.lit(0.5).alias("expected_range"))).alias("exposure_correction"),
        F.when(k % 3 == 0, F.struct(F.array(F.col("s_nationkey").cast("double")).alias("src_white_point"))).alias("white_balance_correction"),
        F.create_map(F.lit("my_note"), F.concat(F.lit('{"k":'), F.col("s_nationkey").cast("string"), F.lit("}"))).alias("custom"))
    d.write_params(rows, path)
    p = d.read_params(t.spark, path)
    return p.select("image_id", F.col("exposure_correction.expected_minimum").alias("low"), F.get("white_balance_correction.src_white_point", F.lit(0)).alias("w0"), F.col("custom")["my_note"].alias("note"))


def _report(t):
    return scored(t).withColumn("applied", F.col("patch_no") > 0)


@query("S12_write_comparison", q.with_(*HEAD, _DE) + "SELECT image_id, step, count(*) AS patches, round(avg(de00), 4) AS mean, true AS applied FROM de GROUP BY image_id, step")
def s12(t):
    path = scratch_path(t.spark, "comparison")
    tb.write_comparison(_report(t), path)
    back = t.spark.read.json(path)
    return back.select("image_id", "step", F.size("patches").cast("bigint").alias("patches"), F.round("mean", 4).alias("mean"), "applied")


STEPS = [f"Brand#{i}" for i in range(1, 26)]


@query("S13_append_analytics", q.with_(*HEAD, _DE, "means AS MATERIALIZED (SELECT image_id, step, round(avg(de00), 4) AS m FROM de GROUP BY image_id, step)")
       + "SELECT image_id, " + ", ".join(f"max(m) FILTER (step = '{s}') AS b{i}" for i, s in enumerate(STEPS, 1)) + " FROM means GROUP BY image_id")
def s13(t):
    path = scratch_path(t.spark, "analytics")
    tb.append_analytics(scored(t), STEPS, path)
    return t.spark.read.parquet(path).select("image_id", *[F.round(f"`{s}`", 4).alias(f"b{i}") for i, s in enumerate(STEPS, 1)])


@query("S15_keypoints", q.with_(KP) + "SELECT row, col, count(*) AS n, round(sum(x), 3) AS sx FROM kp GROUP BY row, col")
def s15(t):
    path = scratch_path(t.spark, "keypoints")
    tb.write_keypoints(keypoints(t).select("kp", "x", "y", "desc", "row", "col"), path)
    return tb.read_keypoints(t.spark, path).groupBy("row", "col").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"))


@query("S16_matches", "SELECT CAST(l_suppkey % 5 AS INTEGER) AS row, CAST(l_linenumber AS INTEGER) AS col, count(*) AS n FROM lineitem GROUP BY 1, 2")
def s16(t):
    path = scratch_path(t.spark, "matches")
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("y1"), (F.col("l_suppkey") % 5).cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"))
    tb.write_matches(rows, path)
    return tb.read_matches(t.spark, path).groupBy("row", "col").agg(F.count("*").alias("n"))


def cell_transforms(t):
    zero, one = F.lit(0.0), F.lit(1.0)
    return cells(t).select("row", "col", F.array(one, zero, 100.5 * F.col("col"), zero, one, -80.25 * F.col("row"), zero, zero, one).alias("h"))


@query("S17_transforms", "WITH " + CELLS + " SELECT label || ': 1.000000 0.000000 ' || format('{:.6f}', 100.5e0*col) || ' 0.000000 1.000000 ' || format('{:.6f}', -80.25e0*row + 0) || ' 0.000000 0.000000 1.000000' AS value FROM cells")
def s17(t):
    path = scratch_path(t.spark, "transforms")
    tb.write_transforms(cell_transforms(t), path, 5000, 4000)
    lines = tb.transform_lines(t.spark.read.parquet(path))
    return lines.select(F.regexp_replace("value", r"-0\.000000", "0.000000").alias("value"))


@query("S18_flat_field", q.with_(q.GRID) + "SELECT y, x, round(avg(v), 5) AS plane FROM grid GROUP BY y, x")
def s18(t):
    path = scratch_path(t.spark, "flat")
    tb.write_flat_field(grid(t).groupBy("y", "x").agg(F.avg("v").alias("plane")), path)
    return tb.read_flat_field(t.spark, path).select("y", "x", F.round("plane", 5).alias("plane"))


@query("S19_reuse_labels", q.with_(COST, PCT) + ", k AS (SELECT face, view, 1 - least(1, quality / percentile) AS cost FROM cs, pc) SELECT face, arg_min(view, (cost, view)) AS label FROM k GROUP BY face")
def s19(t):
    from gesso.operators.texture import cheapest_view

    path = scratch_path(t.spark, "labels")
    c = costs(t)
    tb.checkpoint_costs(c, cheapest_view(c).select("face", F.col("view").alias("label")), path)
    n = t.lineitem.select("l_partkey").distinct().count()
    return tb.reuse_labels(t.spark, path, n, t.supplier.count())


@query("S23_camera_manifest", q.with_(q.GRID, DIMS, IMG_H) + _WARP + ", wv AS (" + _warp_select() + """), b AS (SELECT image_id, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM wv WHERE v > 0 GROUP BY image_id)
SELECT CAST(image_id AS VARCHAR) AS name, format('{:.6f}', -(x0 + (x1-x0+1)/2e0)) || ' ' || format('{:.6f}', -(4000 - y0 - (y1-y0+1)/2e0)) || ' ' || format('{:.6f}', (x1-x0+1)*2.355650009e0) || ' 1.0 0.0 0.0 0.0 1.0 0.0 0.0 0.0 -1.0' || chr(10) || '2.355650009 0.0 0.0 1.0 0.5 0.5' AS value FROM b""")
def s23(t):
    g_ = grid(t)
    warped = mo.warp_to_panorama(g_, image_transforms(g_), ["v"], 16, 16)
    boxes = tb.pixel_boxes(warped, ["image_id"], ["v"]).withColumn("name", F.col("image_id").cast("string"))
    return tb.camera_manifest(boxes, F.lit(4000))


@query("S24_pair_cameras", """WITH f AS (SELECT c_nationkey AS folder, CAST(c_custkey // 2 AS VARCHAR) AS stem, c_custkey FROM customer), k AS (SELECT folder, stem, stem || '.CAM' AS camera FROM f WHERE c_custkey % 2 = 0), i AS (SELECT folder, stem, min(stem || '.tiff') AS image FROM f WHERE c_custkey % 2 = 1 GROUP BY 1, 2)
SELECT CAST(k.folder AS VARCHAR) AS folder, k.stem, camera, image FROM k LEFT JOIN i ON k.folder = i.folder AND k.stem = i.stem""")
def s24(t):
    k = F.col("c_custkey")
    name = F.concat(F.floor(k / 2).cast("string"), F.when(k % 2 == 0, ".CAM").otherwise(".tiff"))
    f = im.file_parts(t.customer.select(F.concat_ws("/", F.lit("/out"), F.col("c_nationkey").cast("string"), name).alias("path")))
    return im.pair_cameras_with_images(f)


@query("S25_transform_report", "WITH " + CELLS + " SELECT row, col, 'Translation: ' || format('{:.6f}', 100.5e0*col) || ' ' || format('{:.6f}', 20000 + 80.25e0*row - 8742) || ' 0.000000' AS line FROM cells")
def s25(t):
    m = mo.transforms_for_meshes(cells(t).select("row", "col"), cell_transforms(t), 20000, 8742)
    path = scratch_path(t.spark, "report")
    rep = tb.transform_report(m)
    tb.write_text(rep, path)
    return rep.select("row", "col", F.element_at(F.filter(F.split("value", "\n"), lambda x: x.startswith("Translation")), 1).alias("line"))


@query("S27_write_if_absent", "SELECT o_orderkey, o_orderstatus = 'F' AS first_run FROM orders")
def s27(t):
    path = scratch_path(t.spark, "outputs")
    rows = t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("first_run"))
    tb.write_if_absent(rows.where("first_run"), path, ["o_orderkey"])
    tb.write_if_absent(rows, path, ["o_orderkey"])
    return t.spark.read.parquet(path)


@query("S28_exif_rows", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'Maker' END AS camera_make, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS focal_length, round(1 / (1 + event_id % 500)::DOUBLE, 6) AS shutter_s FROM events")
def s28(t):
    k = F.get_json_object("props", "$.k")
    pair = lambda name, v: F.struct(F.lit(name).alias("k"), v.alias("v"))
    pairs = F.array(
        pair("EXIF:FocalLength", k), pair("EXIF:ExposureTime", F.concat(F.lit("1/"), (1 + F.col("event_id") % 500).cast("string"))),
        pair("EXIF:Make", F.when(F.col("event_type") == "view", "Maker")), pair("EXIF:ISO", F.when(F.col("event_id") >= 0, "auto")))
    attrs = F.map_from_entries(F.filter(pairs, lambda e: e.v.isNotNull()))
    out = d.read_exif_rows(t.events.select("event_id", attrs.alias("attributes")))
    return out.select("event_id", "camera_make", "focal_length", F.round("shutter_s", 6).alias("shutter_s"))


@query("S29_output_path", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name || '_normal.tif' WHEN 1 THEN s_name || '.ply' ELSE s_name || '_bump.tif' END AS path FROM supplier")
def s29(t):
    k = F.col("s_suppkey") % 3
    return t.supplier.select("s_suppkey", im.output_path(F.col("s_name"), F.when(k == 0, "normal").when(k == 1, "ply").otherwise("bump")).alias("path"))


@query("T3_incoming_images", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS doubled FROM orders")
def t3(t):
    """A file stream of parquet tables, processed and appended once."""
    from gesso.streaming.feeds import incoming_images

    source, target, state = (scratch_path(t.spark, n) for n in ("incoming", "done", "state"))
    rows = t.orders.select("o_orderkey", "o_totalprice")
    rows.write.parquet(source)
    rows.write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(source)
    job = incoming_images(stream, lambda b: b.dropDuplicates(["o_orderkey"]).select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("doubled")), target, ["o_orderkey"], state)
    job.processAllAvailable()
    job.stop()
    return t.spark.read.parquet(target)


@query("U1_plugin_sequence", q.with_(q.PATCHES) + "SELECT patch_id, round(greatest(0, least(1, 1.2e0*c0 + 0.1e0)), 5) AS c0 FROM patches")
def u1(t):
    reg = Registry()
    reg.register("gain")(lambda df, factor: df.withColumn("c0", F.col("c0") * factor))
    reg.register("offset")(lambda df, amount=0.0: df.withColumn("c0", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c0") + amount))))
    steps = [("gain", {"factor": 1.2, "ignored": 1}), ("offset", {"amount": 0.1})]
    return run_sequence(reg, steps, patches(t)).select("patch_id", F.round("c0", 5).alias("c0"))
