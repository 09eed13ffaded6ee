import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gesso.plans.plugins import Registry
from gesso.sources import documents as d
from gesso.sources import images as im
from gesso.sources import tables as tb


def png(path: Path, rgb: np.ndarray) -> None:
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda k, v: struct.pack(">I", len(v)) + k + v + struct.pack(">I", zlib.crc32(k + v))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files_to_pixels(spark, tmp_path, rng):
    rgb = rng.integers(0, 256, (5, 4, 3), dtype=np.uint8)
    png(tmp_path / "a.png", rgb)
    rows = im.read_image_pixels(spark, str(tmp_path)).collect()
    assert len(rows) == 20
    for r in rows:
        assert [r["c0"], r["c1"], r["c2"]] == rgb[r["y"], r["x"]].tolist()


def test_find_files_is_case_insensitive_and_optionally_recursive(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.TIF", "b.tif", "c.png", "sub/d.tif"):
        (tmp_path / n).write_text("x")
    flat = im.find_files(spark, str(tmp_path), "tif").collect()
    deep = im.find_files(spark, str(tmp_path), "TIF", recurse=True).collect()
    assert len(flat) == 2 and len(deep) == 3


def test_broken_documents_are_reported(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"id": 1, "title": "A", "created_at": "2024-05-01 10:00:00", "unknown": 5}')
    (tmp_path / "2.json").write_text('{"id": 2, "title": ')
    rows = d.read_project_docs(spark, str(tmp_path)).collect()
    good = [r for r in rows if r["_corrupt_record"] is None]
    assert len(rows) == 2 and len(good) == 1 and good[0]["title"] == "A" and "unknown" not in good[0].asDict()


@pytest.mark.parametrize("text", ["0 0.5 1\n0 0.25 0.5\n1 0.75 0.5\n0.1 0.2 0.3\n", "0 0 1 0.1\n0.5 0.25 0.75 0.2\n1 0.5 0.5 0.3\n"])
def test_lights_in_either_orientation(spark, tmp_path, text):
    f = tmp_path / "l.txt"
    f.write_text(text)
    got = {r["light_id"]: (r["lx"], r["ly"], r["lz"]) for r in d.read_lights(spark, str(f)).collect()}
    assert got[4] == (0.1, 0.2, 0.3) and got[1] == (0.0, 0.5, 1.0)


def test_light_lines_with_flags(spark, tmp_path):
    f = tmp_path / "l.txt"
    f.write_text("0 0 1\n0.5 0 0.8 0\n0.5 0.1 0.8 1\n")
    assert [r["enabled"] for r in d.import_lights(spark, str(f)).orderBy("light_id").collect()] == [True, False, True]


def test_chart_file(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"CONFIG": {"TARGET": {"lab": {"1": [1, 2, 3], "2": [4, 5, 6]}, "other": {}}}}')
    assert sorted(map(tuple, d.read_reference_chart(spark, str(f), "lab").collect())) == [(1, 1.0, 2.0, 3.0), (2, 4.0, 5.0, 6.0)]


def test_saved_labels_are_checked(spark, tmp_path):
    costs = spark.createDataFrame([(0, 1, 0.5)], "face int, view int, cost double")
    labels = spark.createDataFrame([(0, 1), (1, 4)], "face int, label int")
    path = str(tmp_path / "c")
    tb.checkpoint_costs(costs, labels, path)
    assert tb.reuse_labels(spark, path, 2, 4).count() == 2
    with pytest.raises(ValueError):
        tb.reuse_labels(spark, path, 3, 4)
    with pytest.raises(ValueError):
        tb.reuse_labels(spark, path, 2, 3)


def test_write_if_absent_is_idempotent(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    for _ in range(2):
        tb.write_if_absent(df, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_plugins_check_their_parameters(spark):
    reg = Registry()

    @reg.register("scale", "development")
    def scale(df, factor, offset=0):
        return df.withColumn("v", F.col("id") * factor + offset)

    df = spark.range(3)
    assert [r["v"] for r in reg.run("scale", "development", df, {"factor": 2, "other": 1}).collect()] == [0, 2, 4]
    with pytest.raises(TypeError):
        reg.run("scale", "development", df, {"offset": 1})
    with pytest.raises(KeyError):
        reg.run("scale", "analysis", df, {"factor": 1})
    with pytest.raises(ValueError):
        reg.register("scale", "development")(scale)


def test_project_docs_are_written_by_all_tasks(spark, tmp_path):
    folder = tmp_path / "docs"
    d.write_project_docs(spark.range(60).select("id", F.lit("t").alias("title")), str(folder))
    files = list(folder.glob("_k=*/*.json"))
    assert len(files) == 60 and len({f.name.split("-")[1] for f in files}) > 1
    assert d.read_project_docs(spark, str(folder)).count() == 60
