"""JSON documents: projects, sessions, correction parameters, charts, attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gesso.operators.catalog import TIMESTAMP_FORMAT, project_schema
from gesso.session import cut, spread

CORRUPT = "_corrupt_record"


def read_project_docs(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All JSON documents of a folder as catalog rows. Unknown keys are
    dropped; a document that cannot be parsed is a row with ``_corrupt_record``.

    The parsed rows are kept as a table, because Spark refuses queries that
    use nothing but the corrupt-record column of raw JSON.
    """
    schema = schema or project_schema()
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    docs = (
        spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("timestampFormat", TIMESTAMP_FORMAT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
        .withColumn("source_file", F.input_file_name())
    )
    return cut(docs)


def write_project_docs(df: DataFrame, folder: str, key: str = "id") -> None:
    """One document per project, below ``<key>=<value>``; the key stays inside.

    The many small files are written by all tasks, which also put them into
    their place, instead of the driver one after the other.
    """
    out = spread(df.withColumn("_k", F.col(key)), "_k").write.mode("overwrite").option("timestampFormat", TIMESTAMP_FORMAT)
    out.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("_k").json(folder)


def save_session(settings: DataFrame, folder: str, key: str = "key", value: str = "value") -> None:
    """Key-value settings as JSON rows; timestamps become text."""
    kind = settings.schema[value].dataType
    v = F.date_format(value, TIMESTAMP_FORMAT) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(value).cast("string")
    settings.select(F.to_json(F.struct(F.col(key).cast("string").alias("key"), v.alias("value"))).alias("value")).write.mode("overwrite").text(folder)


def load_session(spark: SparkSession, folder: str) -> DataFrame:
    """The saved settings; they replace whatever was current."""
    return spark.read.text(folder).select(F.from_json("value", "key string, value string").alias("s")).select("s.*")


# Parameter fields of each correction step.
PARAM_SCHEMAS = {
    "exposure_correction": "expected_minimum double, expected_range double, measured_range double, saturation_correction double, v_measured_black double",
    "white_balance_correction": "src_white_point array<double>, dst_white_point array<double>",
    "flat_fielding_correction_path": "string",
    "denoising": "string",
    "ccm": "ccm array<array<double>>, measured_values array<array<double>>",
    "ridge_ccm": "ccm array<array<double>>, measured_values array<array<double>>",
    "finlayson_ccm": "measured_values array<array<double>>",
    "wls_correction": "measured_values array<array<double>>",
    "polynomial_correction": "degree int, measured_values array<array<double>>",
}


def write_params(df: DataFrame, folder: str, custom: str = "custom") -> None:
    """One JSON document per row; custom keys are unpacked to the top level.

    ``custom`` is a map of JSON texts. Null steps are written as null.
    """
    known = [c for c in df.columns if c != custom]
    body = F.to_json(F.struct(*known), {"ignoreNullFields": "false"})
    extra = F.array_join(
        F.transform(F.map_entries(F.coalesce(F.col(custom), F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.lit(","), F.regexp_extract(F.to_json(F.array(e.key)), r"^\[(.*)\]$", 1), F.lit(":"), e.value)), ""
    )
    text = F.concat(F.expr("left({0}, length({0}) - 1)".format("_b")), extra, F.lit("}"))
    df.withColumn("_b", body).select(text.alias("value")).write.mode("overwrite").text(folder)


def read_params(spark: SparkSession, folder: str, key: str = "image_id") -> DataFrame:
    """Typed steps (null where absent) and a map of unknown keys as JSON text."""
    raw = spark.read.text(folder).select(F.from_json("value", "map<string,string>").alias("m"))
    typed = []
    for name, ddl in PARAM_SCHEMAS.items():
        v = F.try_element_at("m", F.lit(name))
        typed.append((v if ddl == "string" else F.from_json(v, ddl)).alias(name))
    known = [*PARAM_SCHEMAS, key]
    custom = F.map_filter("m", lambda k, v: ~k.isin(*known))
    return raw.select(F.try_element_at("m", F.lit(key)).alias(key), *typed, custom.alias("custom"))


def read_reference_chart(spark: SparkSession, path: str, space: str, root: Sequence[str] = ("CONFIG", "TARGET")) -> DataFrame:
    """Patch values of one colour space: patch_no, r0, r1, r2.

    The file holds, below ``root``, one map per space from patch number to
    three numbers.
    """
    schema = T.StructType([T.StructField(space, T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))])
    for name in reversed(root):
        schema = T.StructType([T.StructField(name, schema)])
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    at = ".".join([*root, space])
    return doc.select(F.explode(F.map_entries(F.col(at))).alias("e")).select(
        F.col("e.key").cast("int").alias("patch_no"), *[F.col("e.value")[i].alias(f"r{i}") for i in range(3)]
    )


def read_exif_rows(attributes: DataFrame, column: str = "attributes") -> DataFrame:
    """Attribute maps to typed make, model, lens, focal length, aperture,
    shutter and ISO; absent or unreadable ones are null."""
    get = lambda k: F.try_element_at(column, F.lit(k))
    number = lambda c, kind: c.try_cast(kind)
    shutter = get("EXIF:ExposureTime")
    fraction = F.try_divide(number(F.split_part(shutter, F.lit("/"), F.lit(1)), "double"), number(F.split_part(shutter, F.lit("/"), F.lit(2)), "double"))
    return attributes.select(
        *[c for c in attributes.columns if c != column],
        get("EXIF:Make").alias("camera_make"), get("EXIF:Model").alias("camera_model"), get("EXIF:LensMake").alias("lens_make"), get("EXIF:LensModel").alias("lens_model"),
        number(get("EXIF:FocalLength"), "double").alias("focal_length"), number(get("EXIF:FNumber"), "double").alias("aperture"),
        F.when(shutter.contains("/"), fraction).otherwise(number(shutter, "double")).alias("shutter_s"), number(get("EXIF:ISO"), "int").alias("iso"),
    )


# -- lights ---------------------------------------------------------------------


def read_lights(spark: SparkSession, path: str) -> DataFrame:
    """Light matrix text, 3 x M or M x 3: light_id (from 1), lx, ly, lz."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.filter(F.split("value", "\n"), lambda s: F.trim(s) != "")).alias("_r", "line"))
    cells = rows.select("_r", F.posexplode(F.transform(F.split(F.trim("line"), r"[\s,]+"), lambda s: s.try_cast("double"))).alias("_c", "v"))
    shape = cells.agg(F.struct((F.max("_r") + 1).alias("rows"), (F.max("_c") + 1).alias("cols")).alias("s")).scalar()
    wide = cells.withColumn("_s", shape)
    # three rows of M values, unless there are three columns only
    by_row = (F.col("_s.rows") == 3) | (F.col("_s.cols") != 3)
    light, axis = F.when(by_row, F.col("_c")).otherwise(F.col("_r")), F.when(by_row, F.col("_r")).otherwise(F.col("_c"))
    return wide.groupBy((light + 1).alias("light_id")).agg(*[F.max(F.when(axis == i, F.col("v"))).alias(a) for i, a in enumerate(("lx", "ly", "lz"))])


def write_lights(lights: DataFrame, path: str) -> None:
    """Three lines of M values with six digits (M = lamps of a stand)."""
    line = lambda a: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("light_id", F.col(a).alias("v")))), lambda s: F.format_string("%.6f", s.v)), " ")
    three = lights.agg(F.array(*[line(a) for a in ("lx", "ly", "lz")]).alias("l")).select(F.array_join("l", "\n").alias("value"))
    three.coalesce(1).write.mode("overwrite").text(path)


def import_lights(spark: SparkSession, path: str) -> DataFrame:
    """Light rows with on/off flags from JSON rows or ``x y z [on]`` lines."""
    if path.lower().endswith(".json"):
        df = spark.read.schema("light_id int, lx double, ly double, lz double, enabled boolean").json(path)
        return df.withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.filter(F.split("value", "\n"), lambda s: F.trim(s) != "")).alias("_r", "line"))
    part = F.split(F.trim("line"), r"\s+")
    at = lambda i: F.get(part, F.lit(i))
    return lines.select(
        (F.col("_r") + 1).alias("light_id"), *[at(i).try_cast("double").alias(a) for i, a in enumerate(("lx", "ly", "lz"))],
        F.coalesce(at(3).isin("1", "true", "True", "on"), F.lit(True)).alias("enabled"),
    )


def export_lights(lights: DataFrame, path: str) -> None:
    lights.select("light_id", "lx", "ly", "lz", "enabled").coalesce(1).write.mode("overwrite").json(path)
