"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows and bytes up to which a lookup side may be broadcast; always checked
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def local_session(cpus: str | int = "8", partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gesso")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("GESSO_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session
    without one gets a temporary folder; anywhere else that is an error,
    because other machines could not read it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="gesso-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/gesso-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there."""
    shared_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    kept._is_cut = True
    return kept


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


#: has Spark delete a query's shuffle files when it ends instead of when the driver next collects garbage
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str = "kept", tidy: bool = False) -> DataFrame:
    """Write ``df`` as parquet below the shared folder and read it back.

    Unlike a checkpoint the table is columnar, compressed and pruned when
    read; like one it cuts the lineage and outlives a lost executor. With
    ``tidy`` the shuffle files of the writing query go when it ends, and the
    table is packed tighter: for jobs whose stages each shuffle a good part
    of the input.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(TIDY, "false")
    try:
        if tidy:
            spark.conf.set(TIDY, "true")
        df.write.parquet(path, compression="zstd" if tidy else None)
    finally:
        if tidy:
            spark.conf.set(TIDY, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._is_cut = True
    kept._kept_at = path
    return kept


def forget(df: DataFrame) -> None:
    """Delete the files of a table written by ``keep``; it can't be read afterwards."""
    path = getattr(df, "_kept_at", None)
    if path is None:
        return
    jvm = df.sparkSession.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def lookup(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its rows and bytes prove small, else leave it.

    The table is written first so that measuring does not compute it twice.
    Bytes are those of the rows as text, which holds for arrays too. Without
    the hint the join is an ordinary shuffle join that adaptive execution may
    still split or convert.
    """
    kept = df if getattr(df, "_is_cut", None) is True else keep(df, "lookup")
    size = F.octet_length(F.to_json(F.struct("*")))
    seen = kept.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    small = seen["n"] <= max_rows and seen["bytes"] <= BROADCAST_BYTES
    return F.broadcast(kept) if small else kept


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows that will be unfolded over all shuffle partitions.

    A shuffle that names their number is left as it is by adaptive execution,
    which would put the few bytes of the folded rows into few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


#: rows that a task sorts or aggregates at once
TASK_ROWS = 1_000_000


def tasks_for(rows: int, spark: SparkSession) -> int:
    """Partitions for ``rows`` rows: as configured, and more where a task would hold over ``TASK_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def fence(df: DataFrame, *columns: str) -> DataFrame:
    """Keep the formulas of ``columns`` out of later filters.

    Predicate push-down copies a column's formula into the filter below it,
    and a chain of projections unfolds exponentially that way. A partition id
    in the formula marks it as not movable; its value is always true here.
    """
    here = F.spark_partition_id() >= 0
    return df.withColumns({c: F.when(here, F.col(c)) for c in columns})


def fixed(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small literal table (lights, parameters); broadcastable by size."""
    return F.broadcast(spark.createDataFrame(rows, schema))
