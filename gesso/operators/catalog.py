"""Project catalog, grid cells and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gesso.functions import geometry as g
from gesso.operators.scans import global_rank
from gesso.session import lookup

# Project columns, types and defaults of the catalog format.
PROJECT_DEFAULTS: dict[str, tuple[str, object]] = {
    "id": ("int", None),
    "title": ("string", "TestTitle"),
    "artist": ("string", ""),
    "location": ("string", ""),
    "address": ("string", ""),
    "width": ("int", 1000),
    "height": ("int", 1000),
    "thumbnail": ("string", "test.jpg"),
    "created_at": ("timestamp", None),
    "stand_type": ("string", "vertical"),
    "output_type": ("string", "3D"),
    "sensitivity": ("string", "low"),
    "vibration_check_time": ("int", 3),
    "nshoty": ("int", 5),
    "nshotx": ("int", 5),
    "stepx": ("double", 240.0),
    "stepy": ("double", 180.0),
    "shot_mode": ("string", "multishot"),
    "calibration_chart_path": ("string", ""),
    "calibration_flatfield_file_path": ("string", ""),
    "calibration_sharpen": ("boolean", False),
    "calibration_light_balance": ("boolean", False),
    "calibration_folder_path": ("string", ""),
    "calibration_output_path": ("string", ""),
    "calibration_process_subfolders": ("boolean", False),
    "calibration_overwrite": ("boolean", False),
    "calibration_process_format": ("string", "tif"),
    "calibration_output_colorspace": ("string", "display-p3"),
    "calibration_savein_path": ("string", ""),
    "relief_all_lights_image_dir": ("string", ""),
    "relief_direction_images_dir": ("string", ""),
    "relief_output_directory": ("string", ""),
    "mosaic_maps_path": ("string", ""),
    "mosaic_tex_out_path": ("string", ""),
    "viewer_artwork_dir_path": ("string", ""),
    "viewer_template_dir_path": ("string", ""),
    "viewer_output_path": ("string", ""),
    "viewer_template_zip": ("string", ""),
}


def renamed_prefixes(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Columns of an older document format under today's names, by prefix."""
    new = {c: now + c[len(old):] for c in df.columns for old, now in prefixes.items() if c.startswith(old)}
    return df.withColumnsRenamed(new)


TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def project_schema() -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{k} {kind}" for k, (kind, _) in PROJECT_DEFAULTS.items()))


def project_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Plain record form: numbers and booleans coerced, timestamps as text."""
    def plain(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.date_format(c, TIMESTAMP_FORMAT)
        return c.cast(f.dataType)

    return df.select(*[plain(f).alias(f.name) for f in schema.fields if f.name in df.columns])


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Column defaults for null or absent keys; callables give expressions."""
    def value(name: str) -> Column:
        d = defaults[name]
        lit = d() if callable(d) else F.lit(d)
        return F.coalesce(F.col(name), lit) if name in df.columns else lit

    return df.withColumns({name: value(name) for name in defaults})


def whitelist(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep known columns only."""
    return df.select(*[c for c in columns if c in df.columns])


def search_title(df: DataFrame, text: str, column: str = "title") -> DataFrame:
    return df.where(F.lower(column).contains(text.lower()))


def shot_mode(width: Column, height: Column, max_w: float, max_h: float) -> Column:
    return F.when((width > max_w) | (height > max_h), "multishot").otherwise("oneshot")


def flow_code(stand: Column, output: Column, shot: Column) -> Column:
    return F.concat(
        F.when(stand == "vertical", "v").otherwise("h"),
        F.when(output == "2D", "2d").when(output == "filigree", "f").otherwise("3d"),
        F.when(shot == "oneshot", "o").otherwise("m"),
    )


def first_stage(code: Column, stand: Column) -> Column:
    return (
        F.when(code == "hfm", "mosaic")
        .when(code == "hfo", "project")
        .when(stand == "horizontal", "calibration")
        .otherwise("capture")
    )


def sensitivity_threshold(sensitivity: Column) -> Column:
    return F.when(F.coalesce(sensitivity, F.lit("low")) == "low", 3.5).otherwise(3.8)


def sort_catalog(df: DataFrame, mode: str = "alpha", title: str = "title", created: str = "created_at", key: str = "id") -> DataFrame:
    """alpha, older or recent; ties by key."""
    first = {"alpha": F.asc(title), "older": F.asc(created), "recent": F.desc(created)}[mode]
    return df.orderBy(first, F.asc(key))


def sync_documents(catalog: DataFrame, documents: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Merged catalog with an ``action`` per row: insert, update, same or keep.

    A null document field means "not given" and keeps the stored value. Rows
    only in the catalog are kept.
    """
    old, new = catalog.alias("old"), documents.alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    merged = {f: F.coalesce(F.col(f"new.{f}"), F.col(f"old.{f}")) for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed = changed | (F.col(f"new.{f}").isNotNull() & ~F.col(f"new.{f}").eqNullSafe(F.col(f"old.{f}")))
    action = (
        F.when(F.col(f"old.{key}").isNull(), "insert")
        .when(F.col(f"new.{key}").isNull(), "keep")
        .when(changed, "update")
        .otherwise("same")
    )
    return both.select(
        F.coalesce(F.col(f"new.{key}"), F.col(f"old.{key}")).alias(key),
        *[c.alias(f) for f, c in merged.items()],
        action.alias("action"),
    )


def any_change(synced: DataFrame) -> DataFrame:
    """One row: did the sync insert or update anything."""
    return synced.agg(F.coalesce(F.bool_or(F.col("action").isin("insert", "update")), F.lit(False)).alias("changed"))


def without_document(catalog: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    return catalog.join(documents.select(key), key, "left_anti")


def split_by_title(incoming: DataFrame, catalog: DataFrame, title: str = "title") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): titles already in the catalog are rejected."""
    known = catalog.select(title)
    return incoming.join(known, title, "left_anti"), incoming.join(known, title, "left_semi")


def apply_updates(catalog: DataFrame, changes: DataFrame, deletes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Overwrite named fields where given, then drop deleted ids."""
    old, new = catalog.alias("old"), changes.alias("new")
    merged = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "left").select(
        F.col(f"old.{key}").alias(key),
        *[
            (F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")) if c in fields else F.col(f"old.{c}")).alias(c)
            for c in catalog.columns if c != key
        ],
    )
    return merged.join(deletes.select(key), key, "left_anti")


def bounded_history(log: DataFrame, keys: Sequence[str], version: Sequence[str], n: int = 10) -> DataFrame:
    """Last ``n`` versions per key. The rank filter is applied before the
    shuffle as well, so a hot key sends at most ``n`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    return log.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def normalised_lookup(rows: DataFrame, raw: str, tags: DataFrame, tag_key: str, tag_value: str, tag_order: str) -> DataFrame:
    """Equipment lookup on upper-case, space-free keys; the first tag (by
    ``tag_order``) wins; unmatched rows carry an error text."""
    def norm(c: str) -> Column:
        return F.upper(F.regexp_replace(F.trim(F.col(c)), r"\s", ""))

    first = tags.groupBy(norm(tag_key).alias("_n")).agg(F.min_by(tag_value, tag_order).alias("matched"))
    out = rows.withColumn("_n", norm(raw)).join(lookup(first), "_n", "left").drop("_n")
    return out.withColumn("error", F.when(F.col("matched").isNull(), F.concat(F.lit("not found: "), F.col(raw))))


# -- grid cells -----------------------------------------------------------------


def sort_cells(df: DataFrame, label: str) -> DataFrame:
    """Letter first, then the number as a number."""
    row, col = g.parse_cell(F.col(label))
    return df.orderBy(row, col)


def next_cell(cells: DataFrame, label: str) -> DataFrame:
    """Following label in letter-number order; the last one stays."""
    row, col = g.parse_cell(F.col(label))
    ranked = global_rank(cells.select(label, row.alias("_r"), col.alias("_c")).distinct(), ["_r", "_c"])
    follow = ranked.select((F.col("rank") - 1).alias("rank"), F.col(label).alias("_n"))
    return ranked.join(follow, "rank", "left").select(label, F.coalesce("_n", label).alias("next_label"))


def cell_ranks(cells: DataFrame, row: str, col: str) -> DataFrame:
    """0-based spiral and radial order of distinct cells around the centre."""
    cells = cells.select(F.col(row).alias("_r"), F.col(col).alias("_c")).distinct()
    size = cells.agg(F.struct((F.max("_r") + 1).alias("rows"), (F.max("_c") + 1).alias("cols")).alias("s")).scalar()
    keyed = cells.withColumn("_s", size)
    args = [F.col("_r"), F.col("_c"), F.col("_s.rows"), F.col("_s.cols")]
    keyed = keyed.select("_r", "_c", g.spiral_rank(*args).alias("_spiral"), g.radial_key(*args).alias("_radial"))
    ranked = global_rank(keyed, ["_spiral"], "spiral_rank")
    ranked = ranked.select("*", F.col("_radial.ring").alias("_ring"), F.col("_radial.dr").alias("_dr"), F.col("_radial.dc").alias("_dc"))
    ranked = global_rank(ranked, ["_ring", "_dr", "_dc"], "radial_rank")
    return ranked.select(
        F.col("_r").alias(row), F.col("_c").alias(col),
        (F.col("spiral_rank") - 1).alias("spiral_rank"), (F.col("radial_rank") - 1).alias("radial_rank"),
    )


def reverse_row_letters(cells: DataFrame, label: str, out: str) -> DataFrame:
    """First letter becomes last over the letters present (26 at most)."""
    letter = F.regexp_extract(label, g.CELL_PATTERN, 1)
    number = F.regexp_extract(label, g.CELL_PATTERN, 2)
    present = cells.select(letter.alias("_l")).distinct()
    ups = present.select("_l", F.row_number().over(Window.orderBy("_l")).alias("_i"))
    downs = present.select(F.col("_l").alias("_m"), F.row_number().over(Window.orderBy(F.desc("_l"))).alias("_i"))
    mapping = ups.join(downs, "_i").select("_l", "_m")
    return (
        cells.withColumn("_l", letter)
        .join(F.broadcast(mapping), "_l")
        .withColumn(out, F.concat("_m", number))
        .drop("_l", "_m")
    )


def grid_id(filename: Column) -> Column:
    """Cell id at the start of a .tif name, else null."""
    hit = F.regexp_extract(filename, r"(?i)^([A-Za-z]\d+).*\.tif$", 1)
    return F.when(hit != "", hit)


def shots_plan(projects: DataFrame, images: str, width: str, stepx: str, per_cell: int = 9, shot_width: int = 500) -> DataFrame:
    """Grid cells of each project: ``cell_no, row, col, label``.

    Nine shots make a cell; cells per row follow from the width covered.
    A project without a full cell gets A1.
    """
    cells = F.floor(F.col(images) / per_cell)
    covered = F.floor(F.col(width) / F.col(stepx)) * F.col(stepx) + shot_width / 2
    per_row = F.greatest(F.floor(covered / shot_width), F.lit(1))
    out = projects.withColumns({"_n": F.greatest(cells, F.lit(1)), "_w": per_row})
    out = out.withColumn("cell_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    row, col = F.floor(F.col("cell_no") / F.col("_w")), F.col("cell_no") % F.col("_w")
    label = F.when(row < 26, g.cell_label(row, col))
    return out.withColumns({"row": row, "col": col, "label": label}).drop("_n", "_w")


def remove_nearest(points: DataFrame, keys: Sequence[str], point_id: str, clicks: DataFrame) -> DataFrame:
    """Drop, per key, the point nearest to the click (cx, cy)."""
    d = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    hit = (
        points.join(lookup(clicks), list(keys))
        .groupBy(*keys)
        .agg(F.min(F.struct(d.alias("d"), F.col(point_id).alias("i"))).alias("m"))
        .select(*keys, F.col("m.i").alias(point_id))
    )
    return points.join(hit, [*keys, point_id], "left_anti")
