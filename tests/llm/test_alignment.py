"""Token alignment against a plain byte-by-byte version."""

from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from gesso.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, run string, `at.x` int"
TEXTS = [
    "The quick brown fox, 3.14!", None, "", " ", "Straße naïve 12 rue de la Paix\n\n\tx", "日本語のテキスト🙂 mixed", "<|endoftext|> and </s> <0x41> are plain",
    "a▁b has a piece mark", "The quick brown fox, 3.14!", "aaaa" * 300, "tab\tand  two blanks ", "\x00 nul", "ﬁ ligature ﾊ",
]


def plain(texts):
    """Brute force: tokens from the libraries, links by comparing all byte ranges near each other."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    from gesso.llm.bpe import byte_letters

    letters, out, counts = byte_letters(), [], Counter()
    for text in texts:
        a, b = [], []
        if text:
            a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            for i in s.encode(text):
                p = s.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode()))
            raw = b" " + text.encode()
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a, b = [], []
        spans = []
        for side in (a, b):
            at, rows = 0, []
            for i, x in side:
                rows.append((i, at, at + len(x)))
                at += len(x)
            spans.append(rows)
        links = [(i, j) for i, s0, e0 in spans[0] for j, s1, e1 in spans[1] if s0 < e1 and s1 < e0]
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [tuple([i for i, s0, e0 in rows if lo <= s0 < hi] for rows in spans) for lo, hi in zip([0, *ends], ends, strict=False)]
        counts.update(links)
        out.append((spans, links, groups))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    rows = []
    for spans, links, groups in out:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(spans[0]), len(spans[1]), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), sha256(line.encode()).hexdigest() if line else "", sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links)))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256", "n_best", "count_sum"]


def test_equals_byte_by_byte_version(spark):
    rows = [(i if i != 4 else None, t, "clash", 1) for i, t in enumerate(TEXTS)]
    got = alignment.align_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B)
    want = plain(TEXTS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[c] for c in COLUMNS]) for r in got.collect()) == sorted((i == 4, i if i != 4 else 0, *w) for i, w in enumerate(want))


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(docs, A, B).collect()}
    assert got == dict(zip([i for i, _ in rows], plain([t for _, t in rows]), strict=True))


def test_long_text_and_runs(spark, monkeypatch):
    monkeypatch.setattr(alignment, "_LISTED", 50)
    texts = ["word " * 40_000, "x" * 30_000, *TEXTS]
    both = alignment.pair(A, B, "")
    got = alignment._marked(0, alignment.pa.array(range(len(texts))), texts, both).to_pylist()
    assert [r["n_a"] for r in got[:1]] == [80_000 // 2 + 1] or got[0]["n_a"] > 40_000
    assert sum(sum(r["n"]) for r in got[:-1]) == sum(got[-1]["totals"]) == sum(r["n_links"] for r in got[:-1])


def test_empty_table_and_links(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.align_documents(empty, A, B).count() == 0
    rows = alignment.links(spark.createDataFrame([(1, "unbelievable"), (2, None)], "doc_id long, text string"), A, B).collect()
    assert {r["doc_id"] for r in rows} == {1} and sum(r["n_bytes"] for r in rows) == len(" unbelievable")


@pytest.mark.parametrize("seed", range(5))
def test_products_equal_dense_ones(seed):
    rng = np.random.default_rng(seed)
    x, y = (rng.integers(0, 3, s) * rng.integers(0, 2, s) for s in ((7, 5), (5, 6)))

    def csr(m):
        rows, columns = np.nonzero(m)
        return alignment.Csr(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(m)))]), columns, m[rows, columns], m.shape[1])

    def dense(c):
        out = np.zeros((len(c.starts) - 1, c.width), int)
        out[c.row_of(), c.columns] = c.values
        return out

    assert (dense(csr(x) @ csr(y)) == x @ y).all() and (dense(csr(x).transposed()) == x.T).all()
