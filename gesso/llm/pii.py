"""Personal data by weak supervision.

Plain patterns (e-mail, IP, card, phone) always count. Beyond them, broad
candidates (names, written-out addresses of mail, national phone and identity
numbers, street addresses) are voted on by labelers: patterns, gazetteers and
context cues, each for, against or silent. Candidates are counted by their
votes over the whole corpus; expectation-maximisation on these counts estimates
how reliable each labeler is, without any labelled row. Its posteriors then
train a logistic classifier on votes and shape, which decides on every span.

There are at most ``len(KINDS) * 3 ** 6 * 16`` different counts, however large
the corpus, so the model is fitted on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from gesso.llm.spans import SPAN, SPAN_DDL, count_of, joined, map_texts, overlaps, runs
from gesso.session import keep

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = ("name", "mailword", "number", "street")
LABELERS = 6
ACCEPT = 0.9

# fixed patterns of the base kinds; each is written so that a failing start costs no second look at its run
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:(\.[0-9]+)(\.[0-9]+)(\.[0-9]+))?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        host = _HOST.match(text, at)
        if host:
            start = at
            while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
                start -= 1
            if start < at:
                yield start, host.end()
                done = host.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind in the order of ``BASE_KINDS``, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if m[1] is not None and all(_small(p) for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


#: fixed values: frequent given names, street words, cues
GIVEN_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Anna Peter Hans Klaus Sabine Ursula Jean Pierre Marie Claire Luc Carlos Maria Juan Carmen Jose Ana Luis Sofia Elena Emma Paul Daniel Laura".split()
)
_STREET_WORDS = r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|St|Ave|Rd|Blvd)"
_MAIL_ENDS = frozenset("com org net edu gov de fr es io co info eu uk".split())
_PATTERNS = {
    "name": re.compile(r"(?<![^\W_])[A-Z][a-zà-ÿ]++(?: [A-Z][a-zà-ÿ]++){1,2}(?![^\W_])"),
    "mailword": re.compile(r"[A-Za-z0-9._-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}"),
    "number": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ .()/-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
    "street": re.compile(r"(?<![0-9])[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}" + _STREET_WORDS + r"(?![a-z])"),
}
_CUES = {
    "name": re.compile(r"(?:name|contact|mr|mrs|ms|dr|dear|regards|sincerely|signed|patient|client)\W*\Z", re.I | re.A),
    "mailword": re.compile(r"(?:mail|e-mail|contact|write|reach)\b.{0,20}\Z", re.I | re.A | re.S),
    "number": re.compile(r"(?:phone|tel|call|mobile|fax|ssn|social security|passport|iban|account|cell)\b.{0,20}\Z", re.I | re.A | re.S),
    "street": re.compile(r"(?:address|lives|live|ship|home|resid\w*|located)\b.{0,20}\Z", re.I | re.A | re.S),
}
_AGAINST = re.compile(r"(?:order|invoice|version|figure|page|section|chapter|item|table|total|lot|isbn|issn|sku|build|university|city|company)\b.{0,12}\Z", re.I | re.A | re.S)
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}\Z|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}\Z", re.A)
_CONTEXT = 48


def _votes(kind: str, text: str, start: int, end: int) -> list[int]:
    """For (1), against (-1) or silent (0), by labeler: two patterns, a gazetteer, two contexts, a label right before."""
    found, before = text[start:end], text[max(0, start - _CONTEXT) : start]
    cue, digits = bool(_CUES[kind].search(before)), [c for c in found if c.isdigit()]
    against = -1 if _AGAINST.search(before) else 0
    label = 1 if cue and before.rstrip(" \"'").endswith(":") else 0
    if kind == "name":
        first, sentence = found.split(" ")[0], before.rstrip()[-1:] in ("", ".", "!", "?", "\n")
        return [-1 if sentence else 0, 0, 1 if first in GIVEN_NAMES else -1, 1 if cue else 0, against, label]
    if kind == "mailword":
        end_word = re.split(r"\W+", found)[-1].lower()
        marked = "(at)" in found or "[at]" in found
        return [1 if marked else 0, 1 if re.search(r"[0-9._]", found.split()[0]) else 0, 1 if end_word in _MAIL_ENDS else -1, 1 if cue else 0, against, label]
    if kind == "number":
        plain = len(set(digits)) < 3 or found.isdigit()
        return [1 if _SSN.match(found) else 0, -1 if plain or re.match(r"(?:19|20)\d\d[./-]", found) else 0, 0, 1 if cue else -1, against, label]
    return [1 if re.match(r"[0-9]{1,4} ", found) else 0, 0, 1 if re.search(_STREET_WORDS, found) else -1, 1 if cue else 0, against, label]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """Kind, start, end and the code of votes and shape of each candidate outside the base spans."""
    out, low, taken = [], None, overlaps(base)
    for kind in KINDS:
        if kind == "mailword":
            low = low or text.lower()
            if " dot " not in low and "dot)" not in low and "dot]" not in low:
                continue
        elif kind != "name" and not _DIGIT.search(text):
            continue
        for m in _PATTERNS[kind].finditer(text):
            start, end = m.span()
            if taken(start, end):
                continue
            code = 0
            for v in _votes(kind, text, start, end):
                code = 3 * code + v + 1
            shape = min(3, (end - start) // 8) * 4 + min(3, 4 * sum(c.isdigit() for c in m[0]) // (end - start))
            out.append((kind, start, end, code * 16 + shape))
    return out


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities by kind, classifier weights by kind, and the codes accepted."""

    reliability: dict[str, list[tuple[float, float]]]
    weights: dict[str, list[float]]
    accepted: frozenset[tuple[str, int]]

    def accepts(self, kind: str, code: int) -> bool:
        return (kind, code) in self.accepted


def _unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    votes, rest = np.zeros((len(codes), LABELERS), int), codes // 16
    for j in range(LABELERS - 1, -1, -1):
        votes[:, j] = rest % 3 - 1
        rest = rest // 3
    return votes, codes % 16


#: reliability of a labeler before it has shown any
START = 0.8


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern and, by labeler, how often it votes for a true and against a false span.

    Silence says nothing. The start is the majority; two pseudo-counts on
    each side keep reliabilities off 0 and 1. A labeler that votes one way only
    can't be told from the share of true spans, so its reliability stays where
    it starts. Raises if the posterior still moves after ``rounds``.
    """
    for_, against = (votes == 1).astype(float), (votes == -1).astype(float)
    margin = votes.sum(1)
    post = np.where(margin >= 2, 0.9, np.where(margin == 1, 0.4, 0.05))
    hits = np.full((LABELERS, 2), START)
    one_way = ~(for_.any(0) & against.any(0))
    for _ in range(rounds):
        t, f = post * counts, (1 - post) * counts
        hits = np.stack([(t @ for_ + 4) / (t @ (for_ + against) + 5), (f @ against + 4) / (f @ (for_ + against) + 5)], 1)
        hits = np.clip(hits, 0.5, 0.99)  # a labeler is never taken for a liar
        hits[one_way] = START
        prior = np.clip((t.sum() + 1) / (counts.sum() + 10), 0.01, 0.5)
        true = np.log(prior) + for_ @ np.log(hits[:, 0]) + against @ np.log(1 - hits[:, 0])
        false = np.log(1 - prior) + for_ @ np.log(1 - hits[:, 1]) + against @ np.log(hits[:, 1])
        new = 1 / (1 + np.exp(np.clip(false - true, -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            return post, hits
        post = new
    raise RuntimeError(f"reliabilities still move after {rounds} rounds")


def _features(votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(votes)), votes == 1, votes == -1, np.eye(4)[shape // 4], np.eye(4)[shape % 4]]).astype(float)


def fit_logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 500) -> np.ndarray:
    """Newton steps on soft labels, weighted by counts."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (counts * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            return w
    raise RuntimeError(f"weights still move after {rounds} steps")


def fit(patterns: list[tuple[str, int, int]]) -> SpanModel:
    """The model from (kind, code, count) rows; an empty list accepts nothing."""
    reliability, weights, accepted = {}, {}, set()
    for kind in KINDS:
        own = sorted((code, n) for k, code, n in patterns if k == kind)
        if not own:
            continue
        codes, counts = np.array([c for c, _ in own]), np.array([n for _, n in own], float)
        votes, shape = _unpack(codes)
        post, hits = estimate(votes, counts)
        x = _features(votes, shape)
        w = fit_logistic(x, post, counts)
        score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        reliability[kind], weights[kind] = [tuple(map(float, h)) for h in hits], w.tolist()
        # a span that no labeler speaks for is not reported, whatever its shape
        accepted |= {(kind, int(c)) for c, s, v in zip(codes, score, votes, strict=True) if s >= ACCEPT and (v == 1).any()}
    return SpanModel(reliability, weights, frozenset(accepted))


_CANDIDATE = pa.struct([*SPAN, ("code", pa.int32())])


def _schema(rows: DataFrame, **columns: str) -> StructType:
    return StructType([*[f for f in rows.schema.fields if f.name != "text"], *[StructField(n, DataType.fromDDL(t)) for n, t in columns.items()]])


def extract(rows: DataFrame) -> DataFrame:
    """``rows`` without ``text``, with ``base`` spans and coded ``candidates``."""

    def make():
        def work(texts: list[str | None]) -> list[pa.Array]:
            base = [base_spans(t or "") for t in texts]
            more = [candidates(t or "", b) for t, b in zip(texts, base, strict=True)]
            tuples = lambda lists, names: [[dict(zip(names, s, strict=True)) for s in spans] for spans in lists]
            return [pa.array(tuples(base, ("kind", "start", "end")), pa.list_(SPAN)), pa.array(tuples(more, ("kind", "start", "end", "code")), pa.list_(_CANDIDATE))]

        return work

    return map_texts(rows, "text", _schema(rows, base=SPAN_DDL, candidates="array<struct<kind:string,start:int,end:int,code:int>>"), make)


def train(extracted: DataFrame) -> SpanModel:
    """Fit the model to all candidates; only counts by kind and code reach the driver, a bounded number."""
    counted = extracted.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.code").count().collect()
    return fit([(r["kind"], r["code"], r["count"]) for r in counted])


def decide(text: str, model: SpanModel) -> list[tuple[str, int, int]]:
    """All spans of one text by kind, then start."""
    base = base_spans(text)
    return base + [c[:3] for c in candidates(text, base) if model.accepts(c[0], c[3])]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` for each row of ``docs(doc_id, text)``: the pattern spans, and these with the accepted ones.

    Offsets count code points, ends are exclusive. A null or empty text has no
    spans. Repeated rows are answered each. Other columns are not read.
    """
    extracted = keep(extract(docs.select("doc_id", "text")), "extracted")
    accepted = sorted(train(extracted).accepted)
    known = F.array(*[F.lit(f"{k}:{c}") for k, c in accepted]) if accepted else F.array().cast("array<string>")
    good = F.filter("candidates", lambda c: F.array_contains(known, F.concat_ws(":", c["kind"], c["code"].cast("string"))))
    plain = F.transform(good, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return extracted.select("doc_id", "base", F.concat("base", plain).alias("spans"))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; all columns stay.

    Of spans that overlap, the one that starts first names the whole. Null
    texts stay null. ``n_chars``, if there is one, becomes the length of the new text.
    """
    model = train(extract(docs.select("text")))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, pa.compute.utf8_length(batch[at])):
                columns = list(part.columns)
                columns[at] = pa.array([t if not t else mask(t, decide(t, model)) for t in part[at].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def span_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts by base kind, ``base_sha256`` and ``spans`` as text."""
    found = find_personal_data(docs)
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
