"""Token counts kept up by deltas.

A batch holds signed rows: an insert adds a document's count, a delete takes it
back, a revision does both. What a batch changes is summed to one row for each
source, language and tokenizer version, and written as one file set named
after the batch; totals are the sum over all committed batches, folded into a
snapshot now and then.

A commit is idempotent: a batch whose folder has its success mark is not
written again, and one left unfinished is overwritten. The mark is what Spark's
committer puts there last, so readers see a batch whole or not at all.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gesso.llm.words import word_count

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"



def tokenizers() -> dict[str, Column]:
    """Versions of the built-in counters: words, and words with digits and marks cut off."""
    return {
        "words-1": word_count(F.col("text")),
        "pieces-1": F.coalesce(F.regexp_count("text", F.lit(r"[A-Za-z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]")).cast("long"), F.lit(0).cast("long")),
    }


def counted(docs: DataFrame, counters: Mapping[str, Column], sign: int = 1) -> DataFrame:
    """Signed rows ``source, lang, tokenizer, documents, tokens`` of ``docs``, one for each counter; null counts are 0."""
    each = F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias("tokens")) for n, c in counters.items()])
    return docs.select("source", "lang", F.explode(each).alias("c")).select(
        "source", "lang", "c.tokenizer", F.lit(sign).cast("long").alias("documents"), (F.col("c.tokens") * sign).alias("tokens")
    )


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """The signed rows of a revision: ``before`` taken back, ``after`` added; both as ``counted`` gives them with sign 1."""
    return before.withColumns({c: -F.col(c) for c in ("documents", "tokens")}).unionByName(after)


def summed(rows: DataFrame) -> DataFrame:
    """One row a key; null sources and languages are keys of their own, zero rows go."""
    sums = [F.sum(c).alias(c) for c in ("documents", "tokens")]
    return rows.groupBy(*KEYS).agg(*sums).where((F.col("documents") != 0) | (F.col("tokens") != 0))


class Rollup:
    """A ledger of committed batches below ``path``, a folder all machines reach.

    Batches are folders ``batch=<name>``. ``fold`` writes a snapshot with the
    names it contains; totals are the last snapshot plus the batches after it.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, prefix: str) -> list[str]:
        found = self._fs.globStatus(self._at(f"{self.path}/{prefix}=*/_SUCCESS"))
        return sorted(f.getPath().getParent().getName().split("=", 1)[1] for f in (found or []))

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return self._done("batch")

    def commit(self, name: str, rows: DataFrame) -> bool:
        """Commit signed ``rows`` as batch ``name``; False, and nothing done, if that name is committed already."""
        if not name or any(c in name for c in "/=*{}[]?\\"):
            raise ValueError("batch names must be plain")
        if name in self.batches():
            return False
        summed(rows).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in DELTA.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/batch={name}")
        return True

    def fold(self) -> None:
        """Write a new snapshot of all committed batches; older ones and batches stay as they are."""
        names, number = self.batches(), len(self._done("snapshot"))
        base, left = self._snapshot()
        if not left:
            return
        folded = summed(self._read(base, left)).withColumn("batches", F.array(*[F.lit(n) for n in names]))
        marks = self.spark.createDataFrame([(None, None, None, None, None, names)], DELTA + ", batches array<string>")
        folded.unionByName(marks).write.mode("overwrite").parquet(f"{self.path}/snapshot={number:08d}")

    def _snapshot(self) -> tuple[str | None, list[str]]:
        """Folder of the last snapshot and the batches it lacks."""
        snapshots, names = self._done("snapshot"), self.batches()
        if not snapshots:
            return None, names
        last = f"{self.path}/snapshot={snapshots[-1]}"
        inside = self.spark.read.parquet(last).where("tokenizer is null and documents is null").select("batches").first()["batches"]
        return last, sorted(set(names) - set(inside))

    def _read(self, base: str | None, names: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([], DELTA)
        if names:
            rows = self.spark.read.schema(DELTA).parquet(*[f"{self.path}/batch={n}" for n in names])
        if base is not None:
            rows = rows.unionByName(self.spark.read.schema(DELTA).parquet(base).where("documents is not null"))
        return rows

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` over all committed batches."""
        return summed(self._read(*self._snapshot()))
