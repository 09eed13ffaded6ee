"""The conversation trie against a plain dictionary of prefixes."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from gesso.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, `a.b` int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = []
    for p, who in members.items():
        sub = [q for q in members if q[: len(p)] == p]
        kids = lambda q: sum(len(x) == len(q) + 1 and x[: len(q)] == q for x in sub)
        ends = ",".join(map(str, sorted(c for c in who if len(paths[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in sub)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids(p), sum(kids(q) == 0 for q in sub), saved, sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4))
    assert got.columns == COLUMNS
    order = lambda rows: sorted(rows, key=lambda r: (r[1], r[0], r[7]))
    assert order(tuple(r) for r in got.collect()) == order(plain(rows))


@pytest.mark.parametrize("shard", [3, 4096])
def test_equals_dictionary_of_prefixes(spark, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    rng = random.Random(shard)
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["", None, "hé", "yes", "no way"])) for c in range(60) for t in range(rng.randrange(1, 12))]
    check(spark, rows)


def test_nulls_ties_copies_and_one_long_conversation(spark):
    rows = [(None, 1, "user", "x"), (7, 1, "a", "b"), (7, 1, "a", "b"), (7, 1, None, None), (10**15, 0, "a", "b"), (0, 0, "a", "b")]
    rows += [(c, t, "r", f"turn {t}") for c in range(100, 140) for t in range(4)]
    rows += [(500, t, "r", f"turn {t % 3}") for t in range(300)]
    rows += [(600, 0, "r", "long " * 50_000)]
    check(spark, rows)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
