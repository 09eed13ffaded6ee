"""How the tokens of two tokenizers lie over the same bytes, by sparse incidence products.

A text's tokens of one tokenizer are a 0/1 matrix: a row a token, a column a
byte. With A and B in compressed rows (CSR), the row products A·Bᵀ (Gustavson)
hold the bytes that a token of A and one of B share: the overlap links. Where
tokens of both end at the same byte, a group ends; with the incidences GA and
GB of groups and tokens, GAᵀ·GB holds the pairs within a group. That product
is a full block a group, so only its number of entries is computed.

A is byte-level BPE over a blank and the text, B a sentencepiece model, which
adds the blank itself. Special tokens' strings are plain text for both. Texts
that are null or empty, or whose joined tokens aren't a blank and the text,
have no tokens.

Texts are worked on in runs of about ``CHARS_AT_ONCE`` characters. A run's
counts of linked ids are summed before they are shuffled; the corpus-wide
counts come back to the run by a join, so no task or driver holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gesso.llm import bpe
from gesso.llm.spans import runs
from gesso.session import keep

#: characters whose tokens are Python lists at one time
_LISTED = 1 << 19
_ID_BITS, _DOC_BITS = 24, 16
_MARKED = "run long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, at array<int>, n array<int>, pairs array<long>, totals array<long>"


@dataclass
class Csr:
    """A sparse matrix by rows: row ``i`` has ``values[k]`` in column ``columns[k]``, ``starts[i] <= k < starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def ones(cls, lengths: np.ndarray, columns: np.ndarray, width: int) -> Csr:
        return cls(np.concatenate([[0], np.cumsum(lengths)]), columns, np.ones(len(columns), np.int64), width)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        lengths = np.bincount(self.columns, minlength=self.width)
        return Csr(np.concatenate([[0], np.cumsum(lengths)]), self.row_of()[order], self.values[order], len(self.starts) - 1)

    def __matmul__(self, other: Csr) -> Csr:
        """Row products: each entry of a row picks a row of ``other``, scaled; those picked are added up."""
        lengths = np.diff(other.starts)[self.columns]
        ends = np.cumsum(lengths)
        picked = np.arange(ends[-1] if len(ends) else 0) + np.repeat(other.starts[self.columns] - ends + lengths, lengths)
        key = np.repeat(self.row_of(), lengths) * other.width + other.columns[picked]
        values = np.repeat(self.values, lengths) * other.values[picked]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key = key[first]
        rows, columns = np.divmod(key, max(other.width, 1))
        starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(self.starts) - 1))])
        return Csr(starts, columns, np.add.reduceat(values, first) if len(first) else values, other.width)


class Pair:
    """Both tokenizers of a process, with the bytes of every id."""

    def __init__(self, byte_path: str, piece_path: str, newer: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec = bpe.coder(byte_path, newer)
        plain = {token: i for token, i in spec.ids.items() if i not in spec.specials.values()}
        #: the same merges; for texts beyond U+0557 letter tables differ, and the library itself splits them
        self.fast = tiktoken.Encoding("plain", pat_str=bpe.PIECES, mergeable_ranks=plain, special_tokens={})
        self.high = spec.high
        self.library = Tokenizer.from_file(byte_path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_parts = spec.parts
        self.b_parts = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(p) for p in parts], np.int64) for parts in (self.a_parts, self.b_parts))

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def _a(self, text: str) -> list[int]:
        if self.high.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and by B of each text; none by either if the bytes don't agree."""
        none, at = (np.zeros(0, np.int32),) * 2, 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and (not some or size + len(texts[at] or "") <= _LISTED):
                some.append(texts[at])
                size += len(texts[at] or "")
                at += 1
            full = [t for t in some if t]
            found = iter(self.pieces.encode(full, num_threads=1) if full else [])
            for text in some:
                if not text:
                    yield none
                    continue
                b, raw = next(found), b" " + text.encode()
                a = self._a(" " + text)
                agree = b"".join(map(self.a_parts.__getitem__, a)) == raw and b"".join(map(self.b_parts.__getitem__, b)) == raw
                yield (np.array(a, np.int32), np.array(b, np.int32)) if agree else none


@lru_cache(maxsize=2)
def pair(byte_path: str, piece_path: str, newer: str) -> Pair:
    """One pair for each two files and Python process."""
    return Pair(byte_path, piece_path, newer)


def overlap(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[Csr, np.ndarray, np.ndarray]:
    """The links A·Bᵀ of two token rows over the same bytes (a value is the shared bytes), and each token's group."""
    total = int(a_sizes.sum())
    every = np.arange(total)
    a, b = Csr.ones(a_sizes, every, total), Csr.ones(b_sizes, every, total)
    # a byte column of B holds one token, so its transpose needs no sort
    b_turned = Csr(np.arange(total + 1), b.row_of(), b.values, len(b_sizes))
    a_ends, b_ends = a.starts[1:], b.starts[1:]
    both = np.zeros(total + 1, np.int8)
    both[a_ends] += 1
    both[b_ends] += 1
    groups = [np.concatenate([[0], np.cumsum(both[ends] == 2)[:-1]]) if len(ends) else np.zeros(0, np.int64) for ends in (a_ends, b_ends)]
    return a @ b_turned, groups[0], groups[1]


def group_links(a_group: np.ndarray, b_group: np.ndarray) -> np.ndarray:
    """Entries of GAᵀ·GB a group: tokens of A times tokens of B in it."""
    n = int(max(a_group.max(initial=-1), b_group.max(initial=-1))) + 1
    return np.bincount(a_group, minlength=n) * np.bincount(b_group, minlength=n)


def _written(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` as bytes, and where each token's end lies in it by group order (all of A's, then all of B's)."""
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    n = int(a_group[-1]) + 1
    a_count, b_count = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    place = np.concatenate([np.arange(len(a)) + (np.cumsum(b_count) - b_count)[a_group], np.arange(len(b)) + np.cumsum(a_count)[b_group]])
    ids, mark = np.empty(len(place), np.int64), np.empty(len(place), np.uint8)
    ids[place] = np.concatenate([a, b])
    last = [np.concatenate([g[1:] != g[:-1], [True]]) for g in (a_group, b_group)]
    mark[place] = np.concatenate([np.where(last[0], ord("|"), ord(",")), np.where(last[1], ord(";"), ord(","))])
    digits = np.ones(len(ids), np.int64)
    for power in range(1, 8):
        digits += ids >= 10**power
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1], np.uint8)
    out[ends - 1] = mark
    for power in range(8):
        some = np.flatnonzero(digits > power)
        if len(some):
            out[ends[some] - 2 - power] = 48 + ids[some] // 10**power % 10
    return out, ends[place]


def _marked(run: int, doc_ids: pa.Array, texts: list[str | None], both: Pair) -> pa.RecordBatch:
    """A row for each text of a run, and one with the run's link counts (its ``at`` is null)."""
    each = list(both.tokens(texts))
    n_a, n_b = (np.array([len(x[k]) for x in each], np.int64) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in each]) if each else np.zeros(0, np.int32) for k in (0, 1))
    links, a_group, b_group = overlap(both.a_sizes[a], both.b_sizes[b])
    docs = len(each)
    a_doc = np.repeat(np.arange(docs), n_a)
    a_at = np.concatenate([[0], np.cumsum(n_a)])
    left = links.row_of()
    ids = a[left].astype(np.uint64) << np.uint64(_ID_BITS) | b[links.columns].astype(np.uint64)
    key = np.sort(ids << np.uint64(_DOC_BITS) | a_doc[left].astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    doc, ids = (key & np.uint64((1 << _DOC_BITS) - 1)).astype(np.uint16), key >> np.uint64(_DOC_BITS)
    fresh = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    at = np.cumsum(fresh) - 1
    pairs, totals = ids[fresh].astype(np.int64), np.add.reduceat(count, np.flatnonzero(fresh)) if len(ids) else count
    order = np.argsort(doc, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))])
    written, ends = _written(a, b, a_group, b_group)
    text, b_ends = written.tobytes(), np.concatenate([[0], ends[len(a) :]])
    b_at = np.concatenate([[0], np.cumsum(n_b)])
    bounds = b_ends[b_at]
    hashes = [sha256(text[s : e - 1]).hexdigest() if n else "" for s, e, n in zip(bounds[:-1], bounds[1:], n_a, strict=True)]
    last = np.concatenate([a_group, [a_group[-1] + 1 if len(a_group) else 0]])[a_at]
    within = np.concatenate([[0], np.cumsum(group_links(a_group, b_group))])
    longs = [n_a, n_b, np.diff(last), np.diff(links.starts[a_at]), np.diff(within[last])]
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.append(cuts, cuts[-1]).astype(np.int32)), pa.array(values[order].astype(kind)), mask=pa.array([False] * docs + [True]))
    whole = lambda values: pa.array([None] * docs + [values], pa.list_(pa.int64()))
    columns = [pa.array([run] * (docs + 1), pa.int64()), pa.concat_arrays([doc_ids.cast(pa.int64()), pa.nulls(1, pa.int64())])]
    columns += [pa.array([*x.tolist(), None], pa.int64()) for x in longs]
    columns += [pa.array([*hashes, None], pa.string()), one(at, np.int32), one(count, np.int32), whole(pairs), whole(totals.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _MARKED.split(", ")])


def aligned_runs(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Tokens aligned run by run: text rows with their links as places in the run's list, one row a run with that list and its counts."""
    newer = bpe.newer_letters()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = pair(byte_path, piece_path, newer), TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in runs(batch, pa.compute.utf8_length(batch["text"])):
                for at in range(0, len(some), 1 << _DOC_BITS):
                    part = some.slice(at, 1 << _DOC_BITS)
                    yield _marked(n, part["doc_id"], part["text"].to_pylist(), both)
                    n += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _MARKED)


def pair_counts(marked: DataFrame) -> DataFrame:
    """``pair, a_id, b_id, n, best``: links of each id pair in the corpus, and whether no other pair of that B id has more."""
    each = marked.where(F.col("at").isNull()).select(F.explode(F.arrays_zip("pairs", "totals")).alias("x"))
    counts = keep(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.totals").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND((1 << _ID_BITS) - 1)
    most = counts.groupBy(b.alias("b_id")).agg(F.max("n").alias("most"))
    split = counts.select("pair", F.shiftright("pair", _ID_BITS).alias("a_id"), b.alias("b_id"), "n")
    return split.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def _sums(left: pa.Table, right: pa.Table) -> pa.Table:
    where = right["place"].to_numpy()
    n, best = (np.zeros(int(where.max(initial=-1)) + 1, np.int64) for _ in range(2))
    n[where], best[where] = right["n"].to_numpy(), right["best"].to_numpy().astype(np.int64)
    rows = [(c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()], np.diff(c.offsets.to_numpy())) for name in ("at", "n") for c in [left[name].combine_chunks()]]
    (at, sizes), (times, _) = rows
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    total = [np.concatenate([[0], np.cumsum(times * x[at])]) for x in (best, n)]
    out = left.drop_columns(["run", "at", "n"])
    for name, t in zip(("n_best", "count_sum"), total, strict=True):
        out = out.append_column(name, pa.array(t[cuts[1:]] - t[cuts[:-1]], pa.int64()))
    return out


def align_documents(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """How A's and B's tokens of each row of ``docs(doc_id, text)`` overlap.

    Per row: ``n_a, n_b, n_groups, n_links``; ``n_group_links``, the pairs of
    tokens in one group; ``groups_sha256`` of the groups written as
    ``a1,a2|b1;a3|b2,b3`` ('' without tokens); ``n_best``, the links whose id
    pair has the highest count of its B id in the corpus, ties included;
    ``count_sum``, the counts summed over the links. Null and repeated ids
    stay rows of their own; other columns are left out. Both files must be at
    their paths on every machine.
    """
    marked = keep(aligned_runs(docs, byte_path, piece_path), "aligned")
    counts = keep(pair_counts(marked).select("pair", "n", "best"), "counts")
    places = marked.where(F.col("at").isNull()).select("run", F.posexplode("pairs").alias("place", "pair"))
    back = places.join(counts, "pair").select(F.col("run").alias("of_run"), "place", "n", "best")
    rows = marked.where(F.col("at").isNotNull()).drop("pairs", "totals")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("run").cogroup(back.groupBy("of_run")).applyInArrow(_sums, schema)


def links(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``doc_id, a_at, b_at, a_id, b_id, n_bytes, group``: every overlap link, tokens counted from 0 within their text."""
    newer = bpe.newer_letters()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(byte_path, piece_path, newer)
        for batch in batches:
            for some in runs(batch, pa.compute.utf8_length(batch["text"])):
                for doc_id, (a, b) in zip(some["doc_id"].to_pylist(), both.tokens(some["text"].to_pylist()), strict=True):
                    if not len(a):
                        continue
                    found, group, _ = overlap(both.a_sizes[a], both.b_sizes[b])
                    row = found.row_of()
                    columns = [np.full(len(row), 0), row, found.columns, a[row], b[found.columns], found.values, group[row]]
                    arrays = [pa.array([doc_id] * len(row), pa.int64()), *[pa.array(c.astype(np.int64)) for c in columns[1:]]]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "a_at", "b_at", "a_id", "b_id", "n_bytes", "group"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, a_at long, b_at long, a_id long, b_id long, n_bytes long, `group` long")
