"""The operators without user functions, and SimHash, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from gesso.llm import hash_tree, links, mixing, quality_table, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e f g h i j a b c d e k", "é è ü ß 你好 🙂 #tag *x* <y> | & $ %",
    "line\nline\n\nline \nother\n  \nother", "x " * 5000, "the cat sat on the mat and the dog lay by the door of the old house " * 3,
    "\xa0 word\x85x y", "A" * 20000, "q\r\nq\r\nz",
]


def rows(spark, texts=TEXTS, extra=True):
    data = [(i, t, "en", ["b", "a", None, ""][i % 4], -1, f"n{i}", i) for i, t in enumerate(texts)] + [(3, "one", "en", "b", -1, "n", 0), (3, "one", "en", "b", -1, "n", 0), (None, "no id", "en", "c", -1, "n", 0)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_words string, size int")


def judge(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_counts(spark):
    docs = rows(spark)
    got = quality_table.judge_documents(docs).collect()
    want = Counter((r["doc_id"], *judge(r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"] and not r["failed_rules"]) for r in got)
    kept = quality_table.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_table.judge_documents(docs.limit(0)).count() == 0


def brute_print(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(w)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(t) % 2**64 == brute_print(t)


@pytest.mark.parametrize(("small", "block"), [(12, 2048), (2, 16), (0, 7)])
def test_near_links(spark, rng, small, block):
    heart = int(rng.integers(0, 2**62))
    prints = {heart, 0, 1, 31, 63, -1, 2**62}
    for _ in range(150):
        x = heart
        for b in rng.choice(63, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints |= {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 100)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    brute = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 4]
    got = [tuple(r) for r in simhash.near_links(frame, small=small, block=block).collect()]
    assert {tuple(sorted(x)) for x in got} <= set(brute)
    assert roots(prints, got) == roots(prints, brute)


def test_simhash_rows(spark):
    docs = rows(spark)
    got = simhash.simhash_near_dups(docs).collect()
    data = docs.collect()
    fps = {r["text"]: brute_print(r["text"]) for r in data}
    prints = sorted(set(fps.values()))
    root = roots(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4])
    low = {}
    for r in data:
        if r["doc_id"] is not None:
            k = root[fps[r["text"]]]
            low[k] = min(low.get(k, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{fps[r['text']]:016x}", low.get(root[fps[r["text"]]])) for r in data)
    assert Counter(tuple(r) for r in got) == want
    kept = simhash.drop_near_dups(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root.values()))
    assert simhash.simhash_near_dups(docs.limit(0)).count() == 0
    assert simhash.drop_near_dups(docs.limit(0)).count() == 0


def test_components(spark, rng):
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (7, None)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    full = [(a, b) for a, b in pairs if b is not None and a != b]
    want = roots({x for p in full for x in p}, full)
    assert {r["node"]: r["root"] for r in links.components(frame).collect()} == want
    assert links.components(frame.limit(0)).count() == 0


def won(key, children, seed):
    def u(c):
        return (int(hashlib.md5(f"{seed}/{c}/{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    return min(children, key=lambda c: (-math.log(u(c)) / children[c], c))


def test_hash_tree(spark):
    tree = hash_tree.even_tree(8)
    docs = spark.createDataFrame([(i, f"text é {i}") for i in range(3000)] + [(None, None), (4, "text é 4"), (4, "")], "doc_id long, text string").repartition(5)
    got = hash_tree.shard_rows(docs, tree).collect()
    data = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == data
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        region = won(key, {"g0": 4.0, "g1": 4.0}, "tree")
        rack = won(key, {region + "k0": 2.0, region + "k1": 2.0}, "tree")
        own = {str(s.shard): 1.0 for s in tree if s.rack == rack}
        assert (r["region"], r["rack"], str(r["shard"])) == (region, rack, won(key, own, "tree"))
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert 200 < sum(r["grown_shard"] == 8 for r in got) < 480
    assert hash_tree.shard_rows(docs.limit(0), tree).count() == 0


def test_weights_confine_movement(spark):
    docs = spark.createDataFrame([(i, "") for i in range(4000)], "doc_id long, text string")
    tree = hash_tree.even_tree(8)
    heavy = [hash_tree.Shard(s.shard, s.region, s.rack, 3.0 if s.shard == 5 else s.weight) for s in tree]
    moved = [(r["shard"], r["grown_shard"]) for r in hash_tree.shard_rows(docs, tree, heavy).collect() if r["shard"] != r["grown_shard"]]
    assert moved and all(b in (4, 5, 6, 7) for _, b in moved)
    assert all(not (a in (6, 7) and b in (6, 7)) and not (a < 4 and b < 4) for a, b in moved)
    with pytest.raises(ValueError):
        hash_tree.even_tree(7)


def fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        share = {s: 3.0 * sizes[s] if s in stopped else rest * w[s] / sum(w[x] for x in names if x not in stopped) for s in names}
        above = {s for s in names if s not in stopped and share[s] > 3 * sizes[s]}
        if not above:
            return share
        stopped |= above


def test_mix(spark, rng):
    texts = ["w " * int(n) for n in rng.integers(0, 60, 600)]
    data = [(i, t, ["b", "a", None, "", "z", "é"][0 if i % 3 == 0 else min(5, int(rng.geometric(0.4)))]) for i, t in enumerate(texts)] + [(7, "r r", "b")] * 50 + [(None, None, "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(WORD.findall(t or ""))
    want = fill(sizes)
    for slice_rows in (2_000, 20):
        old, mixing.SLICE_ROWS = mixing.SLICE_ROWS, slice_rows
        got = mixing.mix_documents(docs).collect()
        mixing.SLICE_ROWS = old
        assert len(got) == len(data)
    by_size = {v: k for k, v in sizes.items()}
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[by_size[r["source_size"]]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source_size"]] += r["taken"]
    for s, size in sizes.items():
        assert abs(taken[size] - want[s]) <= 30
    again = mixing.mix_documents(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    out = Counter()
    for r in mixed.collect():
        out[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert {k: v for k, v in out.items() if v} == {s: taken[n] for s, n in sizes.items() if taken[n]}


def test_mix_edges(spark):
    docs = rows(spark)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == docs.count()
    assert mixing.mix_documents(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.mix_documents(empty).collect())
    assert mixing.mixed_rows(docs).columns == docs.columns
