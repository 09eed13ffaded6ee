"""Table sinks: parquet layouts, reports, manifests, append-if-absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gesso.functions import geometry as g
from gesso.session import path_exists

#: rows per file below a partition folder, so that a crowded cell is many files
ROWS_PER_FILE = 5_000_000


def write_by_cell(df: DataFrame, path: str) -> None:
    """Parquet below row=/col=. Rows of a crowded cell are spread over tasks."""
    spread = df.withColumn("_s", F.pmod(F.xxhash64(*[c for c in df.columns if c not in ("row", "col")][:1]), F.lit(32)))
    spread.repartition("row", "col", "_s").drop("_s").write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("row", "col").parquet(path)


def read_by_cell(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


write_keypoints = write_matches = write_by_cell
read_keypoints = read_matches = read_by_cell


def write_transforms(transforms: DataFrame, path: str, pano_width: int, pano_height: int) -> None:
    transforms.withColumns({"pano_width": F.lit(pano_width), "pano_height": F.lit(pano_height)}).write.mode("overwrite").parquet(path)


def transform_lines(transforms: DataFrame) -> DataFrame:
    """Readable text, one line per cell."""
    numbers = F.array_join(F.transform("h", lambda v: F.format_string("%.6f", v)), " ")
    return transforms.select(F.concat(g.cell_label(F.col("row"), F.col("col")), F.lit(": "), numbers).alias("value"))


def write_flat_field(plane: DataFrame, path: str) -> None:
    plane.select("y", "x", "plane").write.mode("overwrite").parquet(path)


def read_flat_field(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_comparison(errors: DataFrame, path: str, applied: str = "applied") -> None:
    """Nested report per image and step; a chart has 24 or 140 patches."""
    patch = F.struct("patch_no", "c0", "c1", "c2", "r0", "r1", "r2", "de00")
    report = errors.groupBy("image_id", "step").agg(
        F.bool_and(applied).alias("applied"), F.avg("de00").alias("mean"), F.stddev_pop("de00").alias("sd"), F.max("de00").alias("max"), F.min("de00").alias("min"),
        F.array_sort(F.collect_list(patch)).alias("patches"),
    )
    report.write.mode("overwrite").json(path)


def analytics_rows(errors: DataFrame, steps: Sequence[str]) -> DataFrame:
    """One row per image, one column per step = mean colour error."""
    return errors.groupBy("image_id").pivot("step", list(steps)).agg(F.avg("de00"))


def append_analytics(errors: DataFrame, steps: Sequence[str], path: str) -> None:
    analytics_rows(errors, steps).write.mode("append").parquet(path)


def checkpoint_costs(costs: DataFrame, labels: DataFrame, path: str) -> None:
    costs.write.mode("overwrite").parquet(f"{path}/costs")
    labels.write.mode("overwrite").parquet(f"{path}/labels")


def reuse_labels(spark: SparkSession, path: str, faces: int, views: int) -> DataFrame:
    """Saved labels after checking that there is one per face and all are in
    range."""
    labels = spark.read.parquet(f"{path}/labels")
    c = labels.agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if c["n"] != faces:
        raise ValueError(f"{c['n']} labels for {faces} faces")
    if c["n"] and (c["lo"] < 0 or c["hi"] > views):
        raise ValueError(f"labels {c['lo']}..{c['hi']} outside 0..{views}")
    return labels


# Camera constants of the manifest.
FOCAL = 2.355650009


def camera_manifest(boxes: DataFrame, pano_height: Column, focal: float = FOCAL) -> DataFrame:
    """Two text lines per cell from its box in the panorama (x0, y0, x1, y1
    inclusive): position and rotation, then the lens."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    num = lambda c: F.format_string("%.6f", c.cast("double"))
    place = F.concat_ws(" ", num(-(F.col("x0") + w / 2)), num(-(pano_height - F.col("y0") - h / 2)), num(w * focal), F.lit("1.0 0.0 0.0 0.0 1.0 0.0 0.0 0.0 -1.0"))
    lens = F.lit(f"{focal} 0.0 0.0 1.0 0.5 0.5")
    return boxes.select("name", F.concat(place, F.lit("\n"), lens).alias("value"))


def pixel_boxes(pixels: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Bounding box of the pixels whose channels are all above zero."""
    test = F.lit(True)
    for c in columns:
        test = test & (F.col(c) > 0)
    return pixels.where(test).groupBy(*keys).agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"))


def transform_report(meshes: DataFrame) -> DataFrame:
    """Matrix, translation and Euler angles of each cell as text (``m``: 16-array)."""
    m = F.col("m")
    roll, pitch, yaw = g.euler_zyx(m)
    row = lambda i: F.format_string("%10.6f\t%10.6f\t%10.6f\t%10.6f", *[m[4 * i + k] for k in range(4)])
    text = F.concat_ws(
        "\n", F.concat(F.lit("Cell "), g.cell_label(F.col("row"), F.col("col"))), *[row(i) for i in range(4)],
        F.format_string("Translation: %.6f %.6f %.6f", m[3], m[7], m[11]),
        F.format_string("Roll (X): %.2f", roll + 0.0), F.format_string("Pitch (Y): %.2f", pitch + 0.0), F.format_string("Yaw (Z): %.2f", yaw + 0.0),
    )
    return meshes.select("row", "col", text.alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_timings(timings: DataFrame, path: str) -> None:
    timings.write.mode("overwrite").option("header", True).csv(path)


def write_if_absent(df: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    """Append rows whose key is not in the target yet; returns them."""
    spark = df.sparkSession
    fresh = df
    if path_exists(spark, target):
        fresh = df.join(spark.read.parquet(target).select(*keys), list(keys), "left_anti")
    fresh.write.mode("append").parquet(target)
    return fresh
