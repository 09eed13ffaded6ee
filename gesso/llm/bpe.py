"""Byte-level BPE with forced-boundary splitting, and its inverse.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can
never be merged across, by any order of merges. Such pairs are certain cuts:
each piece of the text (words and blanks as the vocabulary's pattern splits
them) falls into fragments that are encoded by themselves and then
concatenated. Fragments are short and repeat, so a task keeps the ids of those
it has met lately, up to a fixed number.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from gesso.llm.spans import runs

#: fixed pattern of byte-level BPE pieces
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: pieces whose ids a process keeps, half of them from before the last turnover
KEPT = 250_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Coder:
    """Encoder and decoder of one vocabulary file (JSON with vocab, merges and added tokens)."""

    def __init__(self, path: str, newer: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = [self.ids[raw(a) + raw(b)] for a, b in merges]
        self.ranks = {self.ids[raw(a)] << 20 | self.ids[raw(b)]: r for r, (a, b) in enumerate(merges)}
        self.never = len(merges)
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with white-space rules aren't supported")
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("only plain byte-level vocabularies are supported")
        self.parts = [b""] * (1 + max([*self.ids.values(), *self.specials.values()]))
        for t, i in self.ids.items():
            self.parts[i] = t
        for t, i in self.specials.items():
            self.parts[i] = t.encode()
        #: whether the vocabulary has a token in which the two bytes are neighbours
        self.inside = bytearray(1 << 16)
        for t in self.ids:
            for a, b in zip(t, t[1:], strict=False):
                self.inside[a << 8 | b] = 1
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pieces = regex.compile(PIECES)
        # most texts need no table beyond U+0558; for them the classes are spelled out, which is twice as fast
        self.high, self.low_pieces = re.compile("[\u0558-\U0010ffff]"), re.compile(_low_pieces())
        self.known: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}
        self.newer, self.library = regex.compile(newer) if newer else None, _splitter()

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; an added token's string in it is that token. Null is empty."""
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        ids, at = [], 0
        for m in self.special.finditer(text):
            ids += self._plain(text[at : m.start()])
            ids.append(self.specials[m[0]])
            at = m.end()
        return ids + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.high.search(text):
            found = self.low_pieces.findall(text)
        elif self.newer is not None and self.newer.search(text):
            found = [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        else:
            found = self.pieces.findall(text)
        known, out = self.known, []
        for piece in found:
            ids = known.get(piece)
            if ids is None:
                ids = self.before.get(piece) or self._piece(piece)
                if len(piece) < 64:
                    if len(known) >= KEPT // 2:
                        self.before, self.known = known, {}
                        known = self.known
                    known[piece] = ids
            out.extend(ids)
        return out

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        inside, at, ids = self.inside, 0, []
        for i in range(1, len(raw)):
            if not inside[raw[i - 1] << 8 | raw[i]]:
                ids += self._merge(raw[at:i])
                at = i
        return ids + self._merge(raw[at:])

    def _merge(self, raw: bytes) -> list[int]:
        """Ids of one fragment: the pair of lowest rank, leftmost first, merges until none is left."""
        ids = [self.byte_ids[b] for b in raw]
        if len(ids) > 40:
            return self._merge_long(ids)
        ranks, never = self.ranks, self.never
        found = [ranks.get(a << 20 | b, never) for a, b in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == never:
                break
            i = found.index(best)
            ids[i : i + 2] = [self.merged[best]]
            del found[i]
            if i:
                found[i - 1] = ranks.get(ids[i - 1] << 20 | ids[i], never)
            if i < len(found):
                found[i] = ranks.get(ids[i] << 20 | ids[i + 1], never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, n log n in the length."""
        n, ranks, none = len(ids), self.ranks, -1
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j] = self.merged[rank], none
            right[i] = k = right[j]
            if k < n:
                left[k] = i
            for x, y in ((i, k), (left[i], i)):
                if x >= 0 and y < n and (r := ranks.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i != none]

    def decode(self, ids: np.ndarray | list[int] | None) -> str:
        """The text of ``ids``, added tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join([self.parts[i] for i in ids]).decode("utf-8", "replace") if ids is not None else ""


def _low_pieces() -> str:
    """``PIECES`` with the classes of letters, digits and blanks listed up to U+0557."""
    letter, digit, blank = ("".join(f"\\u{c:04x}" for c in range(0x558) if kind.match(chr(c))) for kind in map(regex.compile, (r"\p{L}", r"\p{N}", r"\s")))
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{blank}{letter}{digit}]+|[{blank}]+(?![^{blank}])|[{blank}]+"


def _splitter():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


@lru_cache(maxsize=1)
def newer_letters() -> str:
    """A character class of letters and digits that the tokenizer library's own tables don't know; empty if there are none.

    Which letters a text's pieces hold depends on the Unicode version, and
    results must equal the library's. A text with such letters goes through
    the library's splitter. Found once on the driver and sent with the tasks.
    """
    library, mine, kind, odd = _splitter(), regex.compile(PIECES), regex.compile(r"[\p{L}\p{N}]"), []
    letters = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if kind.match(c)]

    def differ(some: list[str]) -> bool:
        line = "".join(f"a{c}1{c}!{c}\n" for c in some)
        return [span for _, span in library.pre_tokenize_str(line)] != [m.span() for m in mine.finditer(line)]

    for at in range(0, len(letters), 64):
        some = letters[at : at + 64]
        if differ(some):
            odd += [ord(c) for c in some if differ([c])]
    spans: list[list[int]] = []
    for c in odd:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]" if spans else ""


@lru_cache(maxsize=2)
def coder(path: str, newer: str) -> Coder:
    """One coder for each vocabulary and Python process."""
    return Coder(path, newer)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the array column ``ids``: the tokens of ``text`` by the vocabulary at ``path``.

    With ``decoded``, that column is what the tokens decode to, in the same
    pass: one Python process a core instead of two. The file must be at
    ``path`` on every machine. A null text has no tokens. Other columns stay,
    except those already called ``ids`` or ``decoded``, which are replaced.
    """
    docs, newer = docs.drop(ids, *([decoded] if decoded else [])), newer_letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, newer)
        for batch in batches:
            for part in runs(batch, pa.compute.utf8_length(batch[text])):
                each = [np.array(c.encode(t.as_py()), np.int32) for t in part[text]]
                ends = np.cumsum([0, *map(len, each)], dtype=np.int64)
                flat = np.concatenate(each) if each else np.zeros(0, np.int32)
                out = _with(part, ids, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)))
                yield _with(out, decoded, pa.array([c.decode(x.tolist()) for x in each], pa.string())) if decoded else out

    more = [StructField(decoded, StringType())] if decoded else []
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType())), *more]))


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the column ``text`` decoded from ``ids``; null ids give an empty text."""
    coded, newer = coded.drop(text), newer_letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, newer)
        for batch in batches:
            for part in runs(batch, pa.compute.list_value_length(batch[ids])):
                texts = [c.decode(x.values.to_numpy() if x.is_valid else None) for x in part[ids]]
                yield _with(part, text, pa.array(texts, pa.string()))

    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField(text, StringType())]))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` a row: tokens as little-endian 32-bit numbers, decoded text as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            raw = [sha256(x.values.to_numpy().astype("<u4").tobytes()).hexdigest() for x in batch["ids"]]
            lengths = pa.compute.list_value_length(batch["ids"]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lengths, pa.array(raw, pa.string()), batch["decoded_sha256"]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    coded = encode(docs.select("doc_id", "text"), path, decoded="decoded")
    hashed = coded.select("doc_id", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return hashed.mapInArrow(run, StructType([hashed.schema["doc_id"], *fields]))
