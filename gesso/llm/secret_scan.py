"""Secrets by dictionary-primed zstandard novelty.

Plain patterns (assignments, access keys, long hex) always count. Beyond them,
strings in a sensitive context are candidates: what follows a word like
"credential" or "bearer" within a short distance. A candidate is compressed
together with the text around it, primed with a dictionary of identifiers;
the bytes it adds beyond what its surroundings alone take are its novelty. A
name, a word or something said before adds little, random characters add
about as many bytes as they have. Incompressible candidates are reported,
whether they hold letters, digits or both.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from gesso.llm.spans import SPAN, SPAN_DDL, count_of, joined, map_texts, overlaps

BASE_KINDS = ("assign", "access", "hex")
#: kind of the spans that the method adds
NOVEL = "novel"
#: bytes added per character from which a candidate counts as incompressible
LEAST_NOVELTY = 0.7
#: characters of a candidate, at least; characters between it and its cue, at most; of context on either side
LEAST_LENGTH, REACH, CONTEXT = 16, 40, 256

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CUE = re.compile(r"password|passwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|authorization|client_id|passphrase|signing", re.I | re.A)
_CUES = ("pass", "secret", "token", "key", "credential", "bearer", "authorization", "client_id", "signing")
_RUN = re.compile(r"[A-Za-z0-9+/_.=~-]+", re.A)

#: fixed values: identifiers and settings that code is full of; a parameter of the scan
IDENTIFIERS = (
    "access_token refresh_token client_secret client_id api_key secret_key private_key public_key password username authorization bearer credentials "
    "config settings environment os.environ process.env getenv localhost example.com example-placeholder your_api_key_here changeme xxxxxxxxxxxxxxxx "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 function return const import export default class public static void "
    "string boolean integer request response headers content-type application/json session connection database table column index user account "
    "get_secret_value set_password generate_token validate_token token_type expires_in grant_type redirect_uri callback handler manager service controller"
).split()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind in the order of ``BASE_KINDS``."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


class Novelty:
    """Bytes that a candidate adds to its surroundings, under a dictionary of identifiers."""

    def __init__(self, identifiers: Sequence[str] = IDENTIFIERS):
        primer = zstandard.ZstdCompressionDict(" ".join(identifiers).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zip = zstandard.ZstdCompressor(level=6, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)

    def per_character(self, text: str, start: int, end: int) -> float:
        around = (text[max(0, start - CONTEXT) : start] + text[end : end + CONTEXT]).encode()
        found = text[start:end].encode()
        return (len(self.zip.compress(around + b"\n" + found)) - len(self.zip.compress(around + b"\n"))) / len(found)


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: Novelty, least: float = LEAST_NOVELTY) -> list[tuple[str, int, int]]:
    """Incompressible strings after a cue, outside the base spans, by start.

    A string is measured once, from the first cue that reaches it; cues inside
    it don't measure its rest again.
    """
    low = text.lower()
    if not any(c in low for c in _CUES):
        return []
    found, taken, done = [], overlaps(base), 0
    for cue in _CUE.finditer(text):
        if done > cue.end() + REACH:
            continue
        for run in _RUN.finditer(text, max(cue.end(), done)):
            if run.start() > cue.end() + REACH:
                break
            a, b = run.span()
            done = b
            while b > a and text[b - 1] in ".":
                b -= 1
            if b - a >= LEAST_LENGTH and not taken(a, b) and novelty.per_character(text, a, b) >= least:
                found.append((NOVEL, a, b))
    return found


def find_secrets(docs: DataFrame, identifiers: Sequence[str] = IDENTIFIERS, least: float = LEAST_NOVELTY) -> DataFrame:
    """``doc_id, base, spans`` for each row of ``docs(doc_id, text)``: the pattern spans, and these with the novel ones.

    Offsets count code points, ends are exclusive. Null and empty texts have no
    spans. Repeated rows are answered each. Other columns are not read.
    """
    rows = docs.select("doc_id", "text")

    def make():
        novelty = Novelty(identifiers)

        def work(texts: list[str | None]) -> list[pa.Array]:
            base = [base_spans(t or "") for t in texts]
            more = [sorted(b + novel_spans(t or "", b, novelty, least), key=lambda s: s[1]) for t, b in zip(texts, base, strict=True)]
            return [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in x], pa.list_(SPAN)) for x in (base, more)]

        return work

    schema = StructType([rows.schema["doc_id"], *[StructField(n, DataType.fromDDL(SPAN_DDL)) for n in ("base", "spans")]])
    return map_texts(rows, "text", schema, make)


def secret_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts by base kind, ``base_sha256`` and ``spans`` as text."""
    found = find_secrets(docs)
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
