"""Removed repeats against a dictionary of all 50-byte strings."""

import random
from hashlib import sha256

import numpy as np
import pytest

from gesso.llm import suffix_dedup

SCHEMA = "doc_id long, text string, place string, `a.b` int"


def plain(rows):
    first = {}
    for i, text in rows:
        raw, order = (text or "").encode(), (i is None, i or 0)
        for s in range(len(raw) - 49):
            first[raw[s : s + 50]] = min(first.get(raw[s : s + 50], order), order)
    out = []
    for i, text in rows:
        raw, order = (text or "").encode(), (i is None, i or 0)
        gone = bytearray(len(raw))
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < order:
                gone[s : s + 50] = b"\1" * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def check(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs, **how).collect()), key=str)
    assert got == sorted(plain(rows), key=str)
    return docs


def corpus(seed, n=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(rng.choice([12, 20, 60]))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40)))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 20)
            parts += [p[cut : len(p) - rng.randrange(0, 20)], word()]
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"bucket": 20}), (3, {"bucket": 20, "hot": 5}), (4, {"hot": 0})])
def test_equals_dictionary(spark, seed, how):
    rows = corpus(seed)
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [(7, rows[3][1]), (None, rows[0][1]), (None, rows[0][1]), (200, None), (201, ""), (-5, rows[1][1][:70])]
    check(spark, rows, **how)


def test_periodic_edges_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_AT_ONCE", 1000)
    rng = random.Random(9)
    shared = "".join(rng.choice("xyz ") for _ in range(4000))
    rows = [(1, "a" * 120), (2, "b" + "a" * 60), (3, "a" * 49), (4, "a" * 50), (5, "ab" * 100), (6, "ba" * 25), (7, shared), (8, "q" + shared[:2000] + "q" + shared[1990:]), (9, shared[100:149]), (10, shared[100:150])]
    rows += [(11, "🙂" * 40), (12, "x🙂" + "🙂" * 13)]
    check(spark, rows)


def test_kept_text_and_empty_table(spark):
    rows = [(1, "one " * 30), (2, "two words and " + "one " * 30 + "end"), (3, None)]
    docs = check(spark, rows)
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.kept_text(docs).collect()}
    assert kept[1] == "one " * 30 and kept[3] is None and kept[2].startswith("two words and") and kept[2].endswith("end") and "one" not in kept[2]
    assert suffix_dedup.kept_text(docs).columns == docs.columns
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_windows_have_equal_owners():
    rng = np.random.default_rng(3)
    core = rng.integers(97, 100, 400).astype(np.uint8).tobytes()
    text, start, windows, name = suffix_dedup.sampled([b"head" + core, core + b"tail", b"short"])
    assert set(text) == {0, 1} and windows.sum() == 2 * (len(core) + 4 - 49)
    place = {}
    for t, s, w, x in zip(text, start, windows, name, strict=True):
        for k in range(w):
            place[t, s + k] = x
    assert all(place[0, 4 + s] == place[1, s] for s in range(len(core) - 49))
    assert len(start) < (2 * len(core)) / 8


@pytest.mark.parametrize("seed", range(3))
def test_window_ranks_equal_strings(seed):
    rng = np.random.default_rng(seed)
    rows = [rng.integers(0, 2, 60).astype(np.uint8).tobytes() for _ in range(4)]
    rows += [rows[0][5:], rows[1][:50], rows[0]]
    row, offset, rank = suffix_dedup.window_ranks(rows)
    strings = [rows[r][o : o + 50] for r, o in zip(row, offset, strict=True)]
    assert all((a == b) == (x == y) for a, x in zip(strings, rank, strict=True) for b, y in zip(strings, rank, strict=True))
