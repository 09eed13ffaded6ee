"""Catalog, grid-cell and lookup queries (supplier, customer, nation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gesso.functions import geometry as g
from gesso.operators import catalog as c
from gesso.registry import query
from gesso.session import lookup

PROJ = """proj AS (SELECT c_custkey AS id, c_name AS title, CAST(400 + c_custkey * 7 % 1900 AS INTEGER) AS width,
  CAST(300 + c_custkey * 11 % 1700 AS INTEGER) AS height, CASE WHEN c_nationkey % 2 = 0 THEN 'vertical' ELSE 'horizontal' END AS stand,
  CASE WHEN c_custkey % 3 = 0 THEN '2D' WHEN c_custkey % 3 = 1 THEN 'filigree' ELSE '3D' END AS output,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'low' ELSE 'high' END AS sensitivity FROM customer)"""


def projects(t):
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("id"), F.col("c_name").alias("title"),
        (400 + k * 7 % 1900).cast("int").alias("width"), (300 + k * 11 % 1700).cast("int").alias("height"),
        F.when(F.col("c_nationkey") % 2 == 0, "vertical").otherwise("horizontal").alias("stand"),
        F.when(k % 3 == 0, "2D").when(k % 3 == 1, "filigree").otherwise("3D").alias("output"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "low").otherwise("high").alias("sensitivity"))


@query("P1_project_rows", """SELECT CAST(o_orderkey AS INTEGER) AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at,
  o_totalprice AS stepx, o_orderstatus = 'F' AS calibration_overwrite FROM orders""")
def p1(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").cast("string").alias("stepx"), F.when(F.col("o_orderstatus") == "F", "true").otherwise("false").alias("calibration_overwrite"))
    return c.project_rows(rows, c.project_schema())


@query("P2_fill_defaults", """SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 'TestTitle' ELSE c_name END AS title,
  CASE WHEN c_acctbal < 0 THEN 240e0 ELSE c_acctbal END AS stepx, 3 AS vibration_check_time FROM customer""")
def p2(t):
    rows = t.customer.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("title"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("stepx"))
    wanted = {k: c.PROJECT_DEFAULTS[k][1] for k in ("title", "stepx", "vibration_check_time")}
    return c.fill_defaults(rows, wanted)


@query("P3_whitelist", "SELECT s_suppkey AS id, s_name AS title FROM supplier")
def p3(t):
    rows = t.supplier.withColumnsRenamed({"s_suppkey": "id", "s_name": "title"})
    return c.whitelist(rows, list(c.PROJECT_DEFAULTS))


@query("P4_search_title", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def p4(t):
    return c.search_title(t.part.select("p_partkey", "p_name"), "RING", "p_name")


@query("P5_shot_mode", "WITH " + PROJ + """ SELECT id, CASE WHEN width > 1200 OR height > 900 THEN 'multishot' ELSE 'oneshot' END AS shot_mode FROM proj""")
def p5(t):
    return projects(t).select("id", c.shot_mode(F.col("width"), F.col("height"), 1200, 900).alias("shot_mode"))


_CODE = """, f AS (SELECT *, CASE WHEN stand = 'vertical' THEN 'v' ELSE 'h' END || CASE output WHEN '2D' THEN '2d' WHEN 'filigree' THEN 'f' ELSE '3d' END
  || CASE WHEN width > 1200 OR height > 900 THEN 'm' ELSE 'o' END AS code FROM proj)"""


def _coded(t):
    mode = c.shot_mode(F.col("width"), F.col("height"), 1200, 900)
    return projects(t).withColumn("code", c.flow_code(F.col("stand"), F.col("output"), mode))


@query("P6_flow_code", "WITH " + PROJ + _CODE + " SELECT code, count(*) AS projects FROM f GROUP BY code")
def p6(t):
    return _coded(t).groupBy("code").agg(F.count("*").alias("projects"))


@query("P7_first_stage", "WITH " + PROJ + _CODE + """ SELECT id, CASE WHEN code = 'hfm' THEN 'mosaic' WHEN code = 'hfo' THEN 'project'
  WHEN stand = 'horizontal' THEN 'calibration' ELSE 'capture' END AS stage FROM f""")
def p7(t):
    return _coded(t).select("id", c.first_stage(F.col("code"), F.col("stand")).alias("stage"))


@query("P8_sensitivity", "WITH " + PROJ + """ SELECT id, CASE WHEN sensitivity = 'low' THEN 3.5e0 ELSE 3.8e0 END AS threshold, width / 10e0 AS step_cm FROM proj""")
def p8(t):
    return projects(t).select("id", c.sensitivity_threshold(F.col("sensitivity")).alias("threshold"), (F.col("width") / 10.0).alias("step_cm"))


DOCS = """docs AS (SELECT s_suppkey + CASE WHEN s_suppkey % 9 = 0 THEN 1000000 ELSE 0 END AS id, s_name AS title,
  CASE WHEN s_suppkey % 7 = 0 THEN s_acctbal + 1 WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS budget FROM supplier WHERE s_suppkey % 10 <> 0),
  cat AS (SELECT s_suppkey AS id, s_name AS title, s_acctbal AS budget FROM supplier)"""


def catalog_and_documents(t):
    """The stored catalog, and a copy with missing, changed and new documents."""
    k = F.col("s_suppkey")
    cat = t.supplier.select(k.alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("budget"))
    docs = t.supplier.where(k % 10 != 0).select(
        (k + F.when(k % 9 == 0, 1000000).otherwise(0)).alias("id"), F.col("s_name").alias("title"),
        F.when(k % 7 == 0, F.col("s_acctbal") + 1).when(k % 5 == 0, None).otherwise(F.col("s_acctbal")).alias("budget"))
    return cat, docs


@query("J2_sync_documents", "WITH " + DOCS + """ SELECT coalesce(d.id, c.id) AS id, coalesce(d.title, c.title) AS title, coalesce(d.budget, c.budget) AS budget,
  CASE WHEN c.id IS NULL THEN 'insert' WHEN d.id IS NULL THEN 'keep' WHEN (d.title IS NOT NULL AND d.title IS DISTINCT FROM c.title)
   OR (d.budget IS NOT NULL AND d.budget IS DISTINCT FROM c.budget) THEN 'update' ELSE 'same' END AS action FROM cat c FULL JOIN docs d ON c.id = d.id""")
def j2(t):
    cat, docs = catalog_and_documents(t)
    return c.sync_documents(cat, docs, "id", ["title", "budget"])


@query("J2_any_change", "WITH " + DOCS + """ SELECT bool_or(c.id IS NULL OR (d.budget IS NOT NULL AND d.budget IS DISTINCT FROM c.budget)) AS changed
  FROM docs d LEFT JOIN cat c ON c.id = d.id""")
def j2_any(t):
    cat, docs = catalog_and_documents(t)
    return c.any_change(c.sync_documents(cat, docs, "id", ["title", "budget"]))


@query("J3_without_document", "WITH " + DOCS + " SELECT * FROM cat WHERE id NOT IN (SELECT id FROM docs)")
def j3(t):
    cat, docs = catalog_and_documents(t)
    return c.without_document(cat, docs, "id")


@query("J4_duplicate_title", """WITH inc AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN replace(c_name, 'Customer', 'Supplier') ELSE c_name END AS title FROM customer)
SELECT id, title, title IN (SELECT s_name FROM supplier) AS rejected FROM inc""")
def j4(t):
    k = F.col("c_custkey")
    inc = t.customer.select(k.alias("id"), F.when(k % 4 == 0, F.regexp_replace("c_name", "Customer", "Supplier")).otherwise(F.col("c_name")).alias("title"))
    ok, dup = c.split_by_title(inc, t.supplier.select(F.col("s_name").alias("title")))
    return ok.withColumn("rejected", F.lit(False)).unionByName(dup.withColumn("rejected", F.lit(True))).select("id", "title", "rejected")


@query("J24_apply_updates", """SELECT c.c_custkey AS id, CASE WHEN u.o_custkey IS NOT NULL THEN 'ordered ' || u.n ELSE c.c_name END AS title, c.c_acctbal AS budget
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) u ON c.c_custkey = u.o_custkey
WHERE c.c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def j24(t):
    cat = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("budget"))
    changes = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.concat(F.lit("ordered "), F.count("*").cast("string")).alias("title"))
    return c.apply_updates(cat, changes, t.supplier.select(F.col("s_suppkey").alias("id")), "id", ["title"])


@query("X2_id_difference", "WITH " + DOCS + " SELECT id FROM cat EXCEPT ALL SELECT id FROM docs")
def x2(t):
    cat, docs = catalog_and_documents(t)
    return cat.select("id").exceptAll(docs.select("id"))


@query("O1_sort_catalog", "SELECT o_orderkey AS id, o_orderpriority AS title, o_orderdate AS created_at FROM orders ORDER BY title, id")
def o1(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"))
    return c.sort_catalog(rows, "alpha")


@query("J20_equipment_lookup", """WITH tags AS (SELECT upper(replace(n_name, ' ', '')) AS k, min_by(n_regionkey, n_nationkey) AS m FROM nation GROUP BY 1),
rows AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unknown ' || c_nationkey ELSE ' ' || lower(n_name) || ' ' END AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, raw, coalesce(m, -1) AS matched, CASE WHEN m IS NULL THEN 'not found: ' || raw END AS error FROM rows LEFT JOIN tags ON upper(replace(trim(raw), ' ', '')) = k""")
def j20(t):
    k = F.col("c_custkey")
    rows = t.customer.join(lookup(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.when(k % 7 == 0, F.concat(F.lit("unknown "), F.col("c_nationkey").cast("string")))
        .otherwise(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).alias("raw"))
    out = c.normalised_lookup(rows, "raw", t.nation, "n_name", "n_regionkey", "n_nationkey")
    return out.withColumn("matched", F.coalesce("matched", F.lit(-1)))


@query("W15_bounded_history", """SELECT event_id, user_id, age FROM (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS age FROM events) WHERE age <= 10""")
def w15(t):
    return c.bounded_history(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 10).select("event_id", "user_id", "age")


CELLS = """cells AS (SELECT DISTINCT CAST(c_nationkey AS INTEGER) AS row, CAST(c_custkey % 12 AS INTEGER) AS col,
  chr(CAST(c_nationkey + 65 AS INTEGER)) || (c_custkey % 12 + 1) AS label FROM customer)"""


def cells(t):
    row, col = F.col("c_nationkey"), (F.col("c_custkey") % 12).cast("int")
    return t.customer.select(row.cast("int").alias("row"), col.alias("col"), g.cell_label(row, col).alias("label")).distinct()


@query("W4_next_cell", "WITH " + CELLS + " SELECT label, coalesce(lead(label) OVER (ORDER BY row, col), label) AS next_label FROM cells")
def w4(t):
    return c.next_cell(cells(t), "label")


_RING = """, s AS (SELECT row, col, row - (SELECT max(row) // 2 FROM cells) AS dr, col - (SELECT max(col) // 2 FROM cells) AS dc FROM cells),
k AS (SELECT *, greatest(abs(dr), abs(dc)) AS ring FROM s),
p AS (SELECT *, CASE WHEN ring = 0 THEN 0 WHEN dc = ring AND dr > -ring THEN 2*ring - (ring - dr) WHEN dr = ring THEN 2*ring + (ring - dc)
   WHEN dc = -ring THEN 4*ring + (ring - dr) ELSE 6*ring + (ring + dc) END AS along FROM k)"""


@query("W14_cell_ranks", "WITH " + CELLS + _RING + """ SELECT row, col, row_number() OVER (ORDER BY ring, along) - 1 AS spiral_rank,
  row_number() OVER (ORDER BY ring, dr, dc) - 1 AS radial_rank FROM p""")
def w14(t):
    return c.cell_ranks(cells(t), "row", "col")


@query("O5_sort_cells", "WITH " + CELLS + " SELECT label FROM cells ORDER BY row, col")
def o5(t):
    return c.sort_cells(cells(t).select("label"), "label")


@query("A54_shots_plan", """WITH p AS (SELECT l_suppkey AS id, count(*) AS images FROM lineitem GROUP BY 1),
 w AS (SELECT id, images // 9 AS n, CAST(floor((floor((400 + id * 37 % 4000) / 240e0) * 240e0 + 250) / 500) AS BIGINT) AS per_row FROM p),
 e AS (SELECT id, greatest(per_row, 1) AS pr, unnest(range(greatest(n, 1))) AS cell_no FROM w)
SELECT id, cell_no, cell_no // pr AS row, cell_no % pr AS col, CASE WHEN cell_no // pr < 26 THEN chr(CAST(65 + cell_no // pr AS INTEGER)) || (cell_no % pr + 1) END AS label FROM e""")
def a54(t):
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("images"))
    p = p.withColumns({"width": 400 + F.col("id") * 37 % 4000, "stepx": F.lit(240.0)})
    return c.shots_plan(p, "images", "width", "stepx").select("id", "cell_no", "row", "col", "label")


@query("A54_grid_extent", "WITH " + CELLS + """ SELECT max(row) + 1 AS rows, max(col) + 1 AS cols, CAST(max(row) // 2 AS INTEGER) AS center_row, CAST(max(col) // 2 AS INTEGER) AS center_col FROM cells""")
def grid_extent(t):
    return cells(t).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols")).select(
        "*", g.centre_index(F.col("rows")).alias("center_row"), g.centre_index(F.col("cols")).alias("center_col"))


@query("O7_remove_nearest", """WITH p AS (SELECT CAST(o_orderkey // 4000 AS INTEGER) AS image_id, o_orderkey AS id, o_totalprice / 5000e0 AS x, (o_custkey % 89) / 0.9e0 AS y FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pow(x - 30 - image_id, 2) + pow(y - 40, 2), id) AS rn FROM p)
SELECT image_id, id FROM r WHERE rn > 1""")
def o7(t):
    k = F.col("o_orderkey")
    pts = t.orders.select(F.floor(k / 4000).cast("int").alias("image_id"), k.alias("id"), (F.col("o_totalprice") / 5000.0).alias("x"), ((F.col("o_custkey") % 89) / 0.9).alias("y"))
    clicks = pts.select("image_id").distinct().select("image_id", (30.0 + F.col("image_id")).alias("cx"), F.lit(40.0).alias("cy"))
    return c.remove_nearest(pts, ["image_id"], "id", clicks).select("image_id", "id")
