"""Sensor, log and command streams.

The functions take streaming or batch tables unless they say otherwise, so a
batch run of the same function is the test oracle of the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gesso.functions import geometry as g
from gesso.operators import sessions
from gesso.session import cut

MOVES = {"w": (1, 0), "s": (-1, 0), "d": (0, 1), "a": (0, -1)}


def vibration_ok(
    samples: DataFrame, delta: str, threshold: float, settle_s: float = 2.0, watermark: str | None = None
) -> DataFrame:
    """Stability per device and window of length ``delta``.

    Samples of the first ``settle_s`` seconds do not count. A window is
    stable when the mean magnitude is not above ``threshold``; a window with
    no counted sample is stable.
    """
    rows = samples.withWatermark("ts", watermark) if watermark else samples
    size = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2)
    rows = rows.select("device", "ts", size.alias("size"), F.window("ts", delta).alias("w"))
    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))
    settled = since >= int(settle_s * 1_000_000)
    value = F.when(settled, F.col("size"))
    out = rows.groupBy("device", "w").agg(F.count(value).alias("samples"), F.avg(value).alias("mean"))
    return out.select(
        "device", F.col("w.start").alias("window_start"), "samples", "mean",
        F.coalesce(F.col("mean") <= threshold, F.lit(True)).alias("stable"),
    )


def read_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Session log files as parsed lines; ``job`` is the file name."""
    text = spark.readStream.text(folder).withColumnRenamed("value", "line")
    return sessions.parse_lines(text.withColumn("job", F.element_at(F.split(F.input_file_name(), "/"), -1)))


def progress_feed(lines: DataFrame, job: str, expected: int) -> DataFrame:
    """Running percentage per job and the latest colour error (update mode)."""
    return sessions.progress(lines, job, expected, ["message"])


def step_errors(lines: DataFrame, job: str, order: Sequence[str]) -> DataFrame:
    """Number of measured steps, best and latest error per job."""
    rows = sessions.step_events(lines).where(F.col("error").isNotNull())
    return rows.groupBy(job).agg(
        F.count("error").alias("steps"), F.min("error").alias("best"),
        F.max_by("error", F.struct("ts", *order)).alias("last_error"),
    )


def incoming_images(stream: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, keys: Sequence[str], checkpoint: str):
    """Process files as they arrive, skipping outputs that already exist."""
    from gesso.sources.tables import write_if_absent

    def one_batch(batch: DataFrame, _: int) -> None:
        write_if_absent(process(batch), target, keys)

    return stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).start()


# -- stand position ----------------------------------------------------------------


def _then(f: tuple, step: tuple) -> tuple:
    """Compose x -> clamp(x + a, lo, hi) with a following one of the same form."""
    a, lo, hi = f
    b, low, high = step
    return a + b, min(max(lo + b, low), high), min(max(hi + b, low), high)


def stand_positions(commands: DataFrame, order: Sequence[str], rows: int, cols: int, chunks: int | None = None) -> DataFrame:
    """Cell of each stand after every command (batch).

    Steps keep the stand inside 1..rows x 1..cols. A clamped step is a
    function clamp(x + a, lo, hi), and such functions compose, so a stand with
    any number of commands is cut into chunks: one pass composes each chunk,
    the chunk results are folded (at most two rows per chunk, whatever the
    data size), a second pass replays chunks from the right start.
    """
    n = chunks or int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = commands.repartitionByRange(n, *[F.col(c) for c in ["stand", *order]])
    ordered = cut(ranged.sortWithinPartitions("stand", *order).withColumn("_chunk", F.spark_partition_id()))
    limits = ((1, rows), (1, cols))

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stand, chunk, f = None, None, None
        for batch in batches:
            for s, c, action, way in zip(batch["stand"], batch["_chunk"], batch["action"], batch["direction"]):
                if s != stand:
                    if f is not None:
                        yield pd.DataFrame([[stand, chunk, *f[0], *f[1]]], columns=["stand", "_chunk", *"abcdef"])
                    stand, chunk, f = s, c, [(0, -(10**9), 10**9), (0, -(10**9), 10**9)]
                d = MOVES.get(way, (0, 0)) if action == "step" else (0, 0)
                f = [_then(f[k], (d[k], *limits[k])) for k in (0, 1)]
        if f is not None:
            yield pd.DataFrame([[stand, chunk, *f[0], *f[1]]], columns=["stand", "_chunk", *"abcdef"])

    kind = ordered.schema["stand"].dataType.simpleString()
    totals = ordered.select("stand", "_chunk", "action", "direction").mapInPandas(
        compose, f"stand {kind}, _chunk int, a long, b long, c long, d long, e long, f long"
    )
    several = totals.withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy("stand"))).where("_of > 1")
    starts, here = [], {}
    for r in sorted(several.collect(), key=lambda r: r["_chunk"]):
        x, y = here.get(r.stand, (1, 1))
        starts.append((r.stand, r._chunk, x, y))
        here[r.stand] = (min(max(x + r.a, r.b), r.c), min(max(y + r.d, r.e), r.f))
    begin = commands.sparkSession.createDataFrame(starts, f"stand {kind}, _chunk int, _r0 int, _c0 int")
    joined = ordered.join(F.broadcast(begin), ["stand", "_chunk"], "left").na.fill(1, ["_r0", "_c0"])
    out_columns = [c for c in commands.columns]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stand, at = None, [1, 1]
        for batch in batches:
            r_out, c_out = [], []
            for s, action, way, r0, c0 in zip(batch["stand"], batch["action"], batch["direction"], batch["_r0"], batch["_c0"]):
                if s != stand:
                    stand, at = s, [r0, c0]
                d = MOVES.get(way, (0, 0)) if action == "step" else (0, 0)
                at = [min(max(at[k] + d[k], limits[k][0]), limits[k][1]) for k in (0, 1)]
                r_out.append(at[0])
                c_out.append(at[1])
            yield batch[out_columns].assign(row=r_out, col=c_out)

    schema = T.StructType([*commands.schema.fields, T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())])
    placed = joined.select(*out_columns, "_r0", "_c0").mapInPandas(replay, schema)
    return placed.withColumn("label", g.cell_label(F.col("row") - 1, F.col("col") - 1))


def light_states(commands: DataFrame, order: Sequence[str]) -> DataFrame:
    """Latest on/off per stand and light; lights without a command are on."""
    return commands.groupBy("stand", "light_id").agg(F.max_by("state", F.struct(*order)).alias("lit"))


STATE = "row int, col int, moving boolean"


def stand_position_stream(commands: DataFrame, rows: int, cols: int) -> DataFrame:
    """Position and motion flag per stand, kept as streaming state.

    Commands of a micro-batch are applied by (ts, seq). A step beyond the
    limits changes nothing; free sets the motion flag, stop and steps clear it.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row, col, moving = state.get if state.exists else (1, 1, False)
        # a stand's commands may come in several Arrow batches; order holds over all of them
        every = pd.concat([b[["ts", "seq", "action", "direction"]] for b in batches]).sort_values(["ts", "seq"])
        for action, way in every[["action", "direction"]].itertuples(index=False):
            if action == "free":
                moving = True
            elif action == "stop":
                moving = False
            elif action == "step" and way in MOVES:
                r, c = row + MOVES[way][0], col + MOVES[way][1]
                if 1 <= r <= rows and 1 <= c <= cols:
                    row, col, moving = r, c, False
        state.update((int(row), int(col), bool(moving)))
        yield pd.DataFrame({"stand": [key[0]], "row": [row], "col": [col], "moving": [moving]})

    kind = commands.schema["stand"].dataType.simpleString()
    return commands.groupBy("stand").applyInPandasWithState(
        advance, f"stand {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout
    )
