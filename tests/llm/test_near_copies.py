"""Near copies against exact similarity of all pairs."""

import random
from pathlib import Path

import corpus_pipeline
import pyarrow.parquet as pq
import pytest

from gesso.llm import near_copies, simhash
from gesso.session import shared_dir


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Smallest ids of the groups that pairs of 80 % similarity connect."""
    sets = [(i, brute_set(t)) for i, t in rows]
    up = {i: i for i, _ in sets}
    linked = 0
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                linked += 1
                lo, hi = sorted((up[i], up[j]))
                up = {k: lo if v == hi else v for k, v in up.items()} if lo != hi else up
    return set(up.values()), linked


def copies(rng, heart, n, changes):
    out = []
    for _ in range(n):
        w = heart.split()
        for _ in range(rng.randrange(1, changes + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("small", "block"), [(12, 1 << 18), (2, 2000), (0, 700)])
def test_near_copies(spark, small, block):
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [None, "", "  ", "one two", "One  TWO", "a b c d e f g"]
    for _ in range(25):
        heart = say(rng.randrange(60, 300))
        texts += [heart, *copies(rng, heart, 3, len(heart.split()) // 30)]
    texts += copies(rng, say(120), 40, 5)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want, linked = brute_kept(rows)
    assert linked > 100
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(4)
    got = near_copies.drop_near_copies(docs, small=small, block=block)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_stage_drops_copies_of_80_percent(spark):
    rng = random.Random(9)
    hearts = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(20)]
    texts = [" ".join(h) for h in hearts] + [" ".join("changed" if i in (40, 90, 140) else w for i, w in enumerate(h)) for h in hearts]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(range(20))


def test_stage_drops_near_fingerprints_too(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    while True:
        other = list(base)
        for i in rng.sample(range(200), 6):
            other[i] = f"x{rng.randrange(5000)}"
        a, b = (" ".join(t) for t in (base, other))
        x, y = (set(near_copies.shingle_set(t).tolist()) for t in (a, b))
        apart = ((simhash.fingerprint(a) ^ simhash.fingerprint(b)) % 2**64).bit_count()
        if apart <= 4 and 100 * len(x & y) < 80 * len(x | y):
            break
    docs = spark.createDataFrame([(3, a, "en", "s", 1), (2, b, "en", "s", 1), (7, "something else", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert near_copies.drop_near_copies(docs).count() == 3
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {2, 7}


def test_stage_leaves_one_copy_of_the_texts(spark):
    held = lambda: {p.parent for p in Path(shared_dir(spark).removeprefix("file:")).glob("gesso-*/*/*.parquet") if "text" in pq.read_schema(p).names}
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(50)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([*texts, *texts])], "doc_id long, text string, lang string, source string, n_chars long")
    before = held()
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 30
    assert len(held() - before) == 1
