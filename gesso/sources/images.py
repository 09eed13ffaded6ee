"""Image files and pixel stacks, grid folders, file naming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gesso.functions import geometry as g
from gesso.operators import grid as gr
from gesso.operators import quality as ql


def has_extension(path: Column, extension: str) -> Column:
    return F.lower(path).endswith("." + extension.lower())


def find_files(spark: SparkSession, folder: str, extension: str, recurse: bool = False) -> DataFrame:
    """Paths by case-insensitive extension. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recurse).load(folder)
    return files.select("path", "modificationTime", "length").where(has_extension(F.col("path"), extension))


def file_parts(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds folder (last one), name and stem of a path."""
    parts = F.split(path, "/")
    return files.withColumns({
        "folder": F.try_element_at(parts, F.lit(-2)), "name": F.element_at(parts, -1),
        "stem": F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""),
    })


def scan_grid(files: DataFrame) -> DataFrame:
    """Cells from folders named letter + digits: folder, row, col."""
    row, col = g.parse_cell(F.col("folder"))
    return files.select("folder", row.alias("row"), col.alias("col")).where("row IS NOT NULL").distinct()


def grid_size(cells: DataFrame) -> DataFrame:
    return cells.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def pick_cell_file(files: DataFrame, kind: str, extensions: Sequence[str] = (".tif", ".tiff", ".png", ".jpg", ".jpeg")) -> DataFrame:
    """Per cell the first name (alphabetically) ending in kind + extension."""
    fits = F.lit(False)
    for e in extensions:
        fits = fits | F.col("name").endswith(kind + e)
    row, col = g.parse_cell(F.col("folder"))
    hit = files.withColumns({"row": row, "col": col}).where(fits & F.col("row").isNotNull())
    return hit.groupBy("row", "col").agg(F.min("name").alias("name"), F.min_by("path", "name").alias("path"))


def pair_cameras_with_images(files: DataFrame) -> DataFrame:
    """Each camera file with the image of the same stem; unmatched ones stay
    with a null image."""
    is_cam = has_extension(F.col("name"), "cam")
    cams = files.where(is_cam & (F.col("stem") != "")).select("folder", "stem", F.col("name").alias("camera"))
    images = files.where(~is_cam).groupBy("folder", "stem").agg(F.min("name").alias("image"))
    return cams.join(images, ["folder", "stem"], "left").select("folder", "stem", "camera", "image")


def output_path(base: Column, kind: Column) -> Column:
    """File name of an output of one kind."""
    return F.when(kind.isin("obj", "ply", "stl"), F.concat(base, F.lit("."), kind)).otherwise(F.concat(base, F.lit("_"), kind, F.lit(".tif")))


def read_image_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images as pixel rows: path, y, x, c0, c1, c2 (red, green, blue).

    Uses Spark's image source: 8-bit PNG or JPEG. Deeper images come in as
    pixel tables. An image file is the unit of work; rows leave in batches.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                plane = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.nChannels)
                rgb = plane[:, :, :3][:, :, ::-1] if row.nChannels >= 3 else np.repeat(plane, 3, axis=2)
                step = max(1, 65536 // row.width)
                for y0 in range(0, row.height, step):
                    part = rgb[y0 : y0 + step].astype(float)
                    yy, xx = np.mgrid[y0 : y0 + part.shape[0], 0 : row.width]
                    yield pd.DataFrame({"path": row.origin, "y": yy.ravel(), "x": xx.ravel(), **{f"c{i}": part[:, :, i].ravel() for i in range(3)}})

    return images.mapInPandas(unfold, "path string, y int, x int, c0 double, c1 double, c2 double")


def load_image_stack(pixels: DataFrame, channel: int = 0, downsample: int = 1, percentile: float | None = None) -> DataFrame:
    """Observations of each light image: light_id, y, x, intensity.

    ``pixels``: light_id, y, x, c0, c1, c2. The stack is flipped upside down,
    one channel is taken, values are scaled by the depth of each image and,
    if asked for, divided by a percentile.
    """
    rows = pixels.select(F.col("light_id").alias("image_id"), "y", "x", *[f"c{i}" for i in range(3)])
    top = rows.groupBy("image_id").agg(F.max(F.greatest("c0", "c1", "c2")).alias("_top"))
    rows = gr.attach(rows, top, ["image_id"])
    rows = rows.select("image_id", "y", "x", (F.col(f"c{channel}") / ql.loader_divider(F.col("_top"))).alias("intensity"))
    if downsample > 1:
        rows = gr.decimate_smooth(rows, ["intensity"], downsample)
    rows = gr.flip_vertical(rows)
    if percentile is not None:
        rows = ql.percentile_normalise(rows, "intensity", ["image_id"], percentile)
    return rows.select(F.col("image_id").alias("light_id"), "y", "x", "intensity")
