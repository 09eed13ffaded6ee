"""Byte strings that repeat across documents, by prefix doubling over sampled positions.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
in a document with a smaller id. Sorting every position of the texts at every
round would shuffle some 25 times the input a round, so positions are sampled
by content: of the names (hashes) of the ``SEED`` byte strings inside a window
of ``LENGTH`` bytes, the least, leftmost if equal, owns the window. Equal
windows have equal owners at equal places, and an owner's windows follow each
other, about one sampled position in seventeen stands for all.

1. Rank of the first ``SEED`` bytes: sampled positions are grouped by name,
   after each batch has merged its own. A name in one document only is unique
   and goes, with all windows it owns.
2. What is left comes as (name, the bytes its windows cover), sorted by name
   in buckets of about ``BUCKET`` rows. Equal byte rows become one, those that
   are alone with their name are unique and go. The others are ranked by
   prefix doubling: ranks of 8 bytes, then of pairs of ranks 8, 16 and 18 bytes
   apart, which makes 16, 32 and 50. Ranks are places in the sorted order, so
   nothing rests on a hash: names only decide which rows meet.
3. Each class of windows has its least document; windows of later ones are
   removed, merged into runs document by document.

A name in more than ``HOT`` places (a passage that half of all documents
share) isn't given to one bucket: its windows are grouped by their bytes in
Spark, summed before they are shuffled, and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gesso.llm.spans import runs
from gesso.session import forget, keep

LENGTH, SEED = 50, 18
#: rows of a bucket, and places of a name beyond which it is no bucket's
BUCKET, HOT = 1 << 15, 1 << 17
#: windows that are named at one time
_AT_ONCE = 1 << 20
_PLACE_BITS = np.uint64(31)
_LAST = (1 << 63) - 1


def _view(raw: np.ndarray, at: int, n: int) -> np.ndarray:
    """The 8 bytes from each of ``n`` positions on, as numbers."""
    return np.ndarray((n,), "<u8", raw, at, (1,))


def _names(raw: np.ndarray, n: int) -> np.ndarray:
    """Names of the ``SEED`` bytes from each of the first ``n`` positions on."""
    h = _view(raw, 0, n) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += _view(raw, 8, n)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += _view(raw, SEED - 8, n)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def _owners(raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The owner of each of the first ``n`` windows, as a position, and the names of all positions up to the last owner."""
    span = LENGTH - SEED + 1
    names = _names(raw, n + span - 1)
    low = names >> _PLACE_BITS << _PLACE_BITS
    low |= np.arange(len(low), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:n], low[span - width :][:n])
    return (low[:n] & np.uint64((1 << 31) - 1)).astype(np.int64), names


def sampled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, windows, name`` of the sampled positions: the run of windows from ``start`` on that each owns."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
    total, found = len(raw) - 64, []
    for base in range(0, max(0, total - LENGTH + 1), _AT_ONCE):
        n = min(_AT_ONCE, total - LENGTH + 1 - base)
        owner, names = _owners(raw[base:], n)
        here = np.arange(np.searchsorted(ends, base, "right"), np.searchsorted(ends, base + n - 1, "right") + 1)
        lengths = np.minimum(ends[here], base + n) - np.maximum(ends[here] - sizes[here], base)
        text = np.repeat(here, lengths)
        room = np.repeat(ends[here] - base - LENGTH, lengths)
        inside = np.flatnonzero(np.arange(n) <= room)
        if not len(inside):
            continue
        own = owner[inside]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        start = inside[first]
        count = np.diff(np.concatenate([first, [len(inside)]]))
        found.append((text[start], start + base - (ends - sizes)[text[start]], count, names[own[first]].view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _key() -> list[Column]:
    """The order of documents (those without id after all others) and a hash of id and text that tells rows apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("place"), F.xxhash64("doc_id", "text").alias("row")]


def _utf8(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]


def _first_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch, pa.compute.binary_length(batch["text"])):
            text, _, _, name = sampled(_utf8(part))
            if not len(name):
                continue
            place = part["place"].to_numpy()[text]
            order = np.argsort(name, kind="stable")
            name, place = name[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            columns = [name[first], np.minimum.reduceat(place, first), np.maximum.reduceat(place, first), np.diff(np.concatenate([first, [len(name)]]))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "low", "high", "n"])


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch, pa.compute.binary_length(batch["text"])):
            text, start, windows, name = sampled(_utf8(part))
            columns = [name, part["place"].to_numpy()[text], part["row"].to_numpy()[text], start << 8 | windows]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "place", "row", "at"])


def _covered(hot: int, bucket: int):
    """(name, bytes under its windows) of each position listed with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, pa.compute.binary_length(batch["text"])):
                lists = part["spots"]
                counts = np.diff(lists.offsets.to_numpy())
                if not counts.sum():
                    continue
                spots = lists.flatten()
                name, at, n = (spots.field(f).to_numpy() for f in ("name", "at", "n"))
                text = np.repeat(np.arange(len(part)), counts)
                raw = _utf8(part)
                start, windows = at >> 8, at & 255
                covered = [raw[t][s : s + w + LENGTH - 1] for t, s, w in zip(text.tolist(), start.tolist(), windows.tolist(), strict=True)]
                mixed = name.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(1)
                columns = [mixed.astype(np.int64) % bucket, name, part["place"].to_numpy()[text], part["row"].to_numpy()[text], start]
                arrays = [*map(pa.array, columns), pa.array(covered, pa.binary()), pa.array(n > hot)]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "name", "place", "row", "start", "covered", "hot"])

    return run


def _ranked(pair_a: np.ndarray, pair_b: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks: equal pairs get the same place in their sorted order."""
    return np.unique(pair_a.astype(np.uint64) << np.uint64(32) | pair_b.astype(np.uint64), return_inverse=True)[1]


def window_ranks(covered: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, offset, rank`` of every window of ``LENGTH`` bytes: windows are equal where ranks are, by prefix doubling."""
    sizes = np.array([len(c) for c in covered], np.int64)
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(covered) + bytes(64), np.uint8)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(covered)), windows)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[row] + offset
    n = len(raw) - 64
    rank = np.unique(_view(raw, 0, n), return_inverse=True)[1]  # 8 bytes; strings that leave their row are compared but never used
    length = 8
    while 2 * length <= LENGTH:
        far = np.concatenate([rank[length:], np.zeros(min(length, n), rank.dtype)])[:n]
        rank, length = _ranked(rank, far), 2 * length
    return row, offset, _ranked(rank[at], rank[at + LENGTH - length])


def _decide(table: pa.Table) -> pa.Table:
    """Byte runs of a bucket's rows that windows of earlier documents cover."""
    place, name = table["place"].to_numpy(), table["name"].to_numpy()
    bytes_code = table["covered"].combine_chunks().dictionary_encode()
    code = bytes_code.indices.to_numpy()
    order = np.lexsort((place, code, name))
    fresh = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (code[order][1:] != code[order][:-1])])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    head = order[fresh]  # the earliest row of each different (name, bytes)
    least = place[head]
    start, size = table["start"].to_numpy(), pa.compute.binary_length(table["covered"]).to_numpy().astype(np.int64)
    later = np.flatnonzero(place > least[group])
    outs = [(later, start[later], start[later] + size[later])]
    # several byte rows under one name
    names = name[head]
    alone = np.concatenate([[True], names[1:] != names[:-1]]) & np.concatenate([names[1:] != names[:-1], [True]])
    some = np.flatnonzero(~alone)
    if len(some):
        values = bytes_code.dictionary
        row, offset, rank = window_ranks([values[int(c)].as_py() for c in code[head[some]]])
        own = least[some][row]
        low = np.full(int(rank.max()) + 1, _LAST, np.int64)
        np.minimum.at(low, rank, own)
        gone = low[rank] < own
        row, offset = row[gone], offset[gone]
        if len(row):
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)])
            last = np.concatenate([first[1:], [True]])
            # every row of the earliest document with these bytes
            begin, end, which = offset[first], offset[last] + LENGTH, some[row[first]]
            members = np.flatnonzero(place == least[group])
            by = members[np.argsort(group[members], kind="stable")]
            lo, hi = np.searchsorted(group[by], which, "left"), np.searchsorted(group[by], which, "right")
            times = hi - lo
            pick = by[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            outs.append((pick, start[pick] + np.repeat(begin, times), start[pick] + np.repeat(end, times)))
    rows, begin, end = (np.concatenate(x) for x in zip(*outs, strict=True))
    return pa.table({"place": pa.array(place[rows]), "row": pa.array(table["row"].to_numpy()[rows]), "span": pa.array(begin << 32 | end)})


def _hot_spans(hot: DataFrame) -> DataFrame:
    """The same for names in very many places: windows grouped by their bytes, a row each."""
    every = hot.select("place", "row", "start", "covered", F.explode(F.sequence(F.lit(0), F.octet_length("covered") - LENGTH)).alias("i"))
    each = every.select("place", "row", (F.col("start") + F.col("i")).alias("start"), F.expr(f"substring(covered, i + 1, {LENGTH})").alias("window"))
    least = each.groupBy("window").agg(F.min("place").alias("low"))
    later = each.join(least, "window").where(F.col("low") < F.col("place"))
    return later.select("place", "row", (F.shiftleft("start", 32) + F.col("start") + LENGTH).alias("span"))


def repeated_spans(docs: DataFrame, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """``place, row, spans``: the byte runs to remove, as ``start << 32 | end``, by the keys of ``_key``; they may overlap."""
    texts = docs.select(*_key(), "text").where(F.octet_length("text") >= LENGTH)
    names = texts.select("place", "text").mapInArrow(_first_names, "name long, low long, high long, n long")
    counted = names.groupBy("name").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    shared = keep(counted.where(F.col("low") < F.col("high")).select("name", "n"), "names", tidy=True)
    total = shared.agg(F.sum("n")).first()[0] or 0
    buckets = -(-total // bucket) or 1
    spots = texts.mapInArrow(_positions, "name long, place long, row long, at long").join(shared, "name")
    listed = keep(spots.groupBy("place", "row").agg(F.collect_set(F.struct("name", "at", "n")).alias("spots")), "spots", tidy=True)
    forget(shared)
    fields = "bucket long, name long, place long, row long, start long, covered binary, hot boolean"
    covered = listed.join(texts, ["place", "row"]).mapInArrow(_covered(hot, buckets), fields)
    if total > hot:
        covered = keep(covered, "covered", tidy=True)
        forget(listed)
    decided = covered.where(~F.col("hot")).groupBy("bucket").applyInArrow(_decide, "place long, row long, span long")
    if total > hot:
        decided = decided.union(_hot_spans(covered.where("hot")))
    spans = keep(decided.groupBy("place", "row").agg(F.collect_set("span").alias("spans")), "spans", tidy=True)
    forget(covered)
    return spans


def _digest(text: bytes, spans: list[int] | None) -> tuple[int, int, int, str]:
    kept, at, removed, count = sha256(), 0, 0, 0
    for span in sorted(spans or ()):
        start, end = span >> 32, span & 0xFFFFFFFF
        if start > at or count == 0:
            kept.update(text[at:start])
            count += 1
            removed += end - start
            at = end
        elif end > at:
            removed += end - at
            at = end
    kept.update(text[at:])
    return len(text), removed, count, kept.hexdigest()


def remove_repeats(docs: DataFrame, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of ``docs(doc_id, text)``.

    Null texts are empty. Rows with the same id don't count against each
    other; those without id come after all others. Strings never cross
    documents and are judged on the texts as given. Other columns are left out.
    """
    spans = repeated_spans(docs.select("doc_id", "text"), bucket, hot)
    # texts and spans come together by the spans' own keys; the rest of the texts has none
    joined = docs.select("doc_id", "text", *_key()).join(spans, ["place", "row"], "left").select("doc_id", "text", "spans")
    schema = StructType([docs.schema["doc_id"], *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")], StructField("kept_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, pa.compute.binary_length(batch["text"])):
                rows = [_digest(t, s) for t, s in zip(_utf8(part), part["spans"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *[pa.array(c, f) for c, f in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]], names=schema.names)

    return joined.mapInArrow(run, schema)


def kept_text(docs: DataFrame, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """``docs`` with the column ``text`` less its repeats; bytes that no longer form a character become U+FFFD.

    All other columns stay. A column named like the two join keys is kept under its name.
    """
    spans = repeated_spans(docs.select("doc_id", "text"), bucket, hot)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), "doc_id", "text", *_key())
    joined = held.join(spans, ["place", "row"], "left").select("held", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                if text is None or not spans:
                    texts.append(text)
                    continue
                raw, at, out = text.encode(), 0, []
                for span in sorted(spans):
                    out.append(raw[at : max(at, span >> 32)])
                    at = max(at, span & 0xFFFFFFFF)
                texts.append(b"".join([*out, raw[at:]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch["held"], pa.array(texts, pa.string())], names=["held", "kept"])

    out = joined.mapInArrow(run, StructType([StructField("held", docs.schema), StructField("kept", StringType())]))
    return out.select(*[F.col("kept").alias(c) if c == "text" else F.col("held").getField(c).alias(c) for c in docs.columns])
