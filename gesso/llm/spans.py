"""Spans found in texts: their schema, digests and the per-batch runner."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
SPAN_DDL = "array<struct<kind:string,start:int,end:int>>"


#: characters of text that a task works on between two batches of output
CHARS_AT_ONCE = 4_000_000


def runs(batch: pa.RecordBatch, sizes: pa.Array, most: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``sizes`` sum up to about ``most``; a longer row is a run of its own."""
    start, total, last = 0, 0, len(sizes) - 1
    for i, size in enumerate(sizes.to_pylist()):
        total += size or 0
        if total >= most or i == last:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0


def map_texts(rows: DataFrame, text: str, schema: StructType, make: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """``rows`` without ``text`` and with the columns that ``make()`` computes from the texts of a batch.

    ``schema`` is that of the result. ``make`` runs once a task, what it
    returns on runs of about ``CHARS_AT_ONCE`` characters.
    """
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = batch.schema.names.index(text)
            for part in runs(batch, pa.compute.utf8_length(batch[at])):
                kept = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, *work(part[at].to_pylist())], names=names)

    return rows.mapInArrow(run, schema)


def overlaps(spans: Iterable[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """A test whether a range meets one of ``spans``, by search in their union."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def meets(start: int, end: int) -> bool:
        at = bisect_left(starts, end) - 1
        return at >= 0 and ends[at] > start

    return meets


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
