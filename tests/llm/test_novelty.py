"""Novel strings of letters or digits alone; random digits carry 0.42 bytes each and may stay below the bound."""

import random
import string

import pytest

from gesso.llm import secret_scan


@pytest.mark.parametrize("length", [16, 24, 48])
def test_letters_alone_are_novel(length):
    rng = random.Random(3)
    n = secret_scan.Novelty()
    found = 0
    for _ in range(100):
        key = "".join(rng.choices(string.ascii_letters, k=length))
        text = f"they sent the bearer {key} to the others, and nothing more was said about it."
        found += [text[a:b] for _, a, b in secret_scan.novel_spans(text, [], n)] == [key]
    assert found >= 90


def test_digits_alone_are_measured():
    rng = random.Random(4)
    n = secret_scan.Novelty()
    around = ["".join(rng.choices(string.ascii_letters + " .,", k=300)) for _ in range(60)]
    hits = 0
    for a in around:
        key = "".join(rng.choices(string.digits, k=20))
        text = f"{a} bearer {key} {a[::-1]}"
        at = text.index(key)
        novel = n.per_character(text, at, at + 20) >= secret_scan.LEAST_NOVELTY
        hits += novel
        assert ([text[x:y] for _, x, y in secret_scan.novel_spans(text, [], n)].count(key) == 1) == novel
    assert hits


def test_said_before_or_known_is_not_novel():
    n = secret_scan.Novelty()
    for text in ("the signing of abcdefghijklmnopqrstuvwxyz", "credential ================ end", "bearer 0123456789 01234567890123456"):
        assert secret_scan.novel_spans(text, [], n) == []
