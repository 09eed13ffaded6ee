"""Quality rules: a threshold table compiled into Spark projections.

Every rule is a row of ``RULES``: a ratio of two counts, the side on which it
fails and the bound, and the number of words from which it holds. Counts and
rules are built-in expressions; there is no user function.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gesso.llm.words import free_prefix, words
from gesso.session import fence

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"

#: fixed values: frequent function words of English, French, German and Spanish
STOP_WORDS = tuple(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "als am auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nicht noch sich sie sind so und von vor war wie wird zu zum zur "
    "al como con del el ella en es esta este la las lo los más no para pero por que se sin sobre su sus un una y ya".split()
)


@dataclass(frozen=True)
class Rule:
    """Fails if ``100 * top`` is ``side`` ("above" or "below") ``percent * base``, from ``least_words`` words on."""

    name: str
    top: str
    base: str
    side: str
    percent: int
    least_words: int = 1
    by_language: bool = False  # only where ``lang`` names a language of ``LANGUAGES``


#: the languages whose function words are listed
LANGUAGES = ("en", "fr", "de", "es")
#: the method's verdict; bounds sit well outside what prose, lists and code reach
RULES = (
    Rule("long_words", "word_chars", "n_words", "above", 2000),
    Rule("short_words", "word_chars", "n_words", "below", 200),
    Rule("symbols", "n_symbols", "n_words", "above", 50),
    Rule("stop_words", "n_stop_words", "n_words", "below", 1, 200, True),
    Rule("repeated_lines", "n_dup_lines", "n_lines", "above", 50, 20),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _repeat_words(words_name: str, hashes_name: str, sorted_name: str) -> Column:
    """Words inside windows that occur twice or more, from the sorted (hash, place) pairs."""
    s = F.col(sorted_name)
    same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    twice = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])


def with_counts(docs: DataFrame, prefix: str) -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` as longs, their names prefixed.

    A null text counts like an empty one: no words, no lines. Windows are
    compared by a 64-bit hash of their words within one text.
    """
    t = lambda n: prefix + "_" + n
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumns({t("w"): words(F.col("text")), t("l"): F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    w = F.col(t("w"))
    window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    d = d.withColumn(t("h"), F.when(F.size(w) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)))
    h = F.col(t("h"))
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    d = d.withColumn(t("s"), F.when(F.size(h) > F.size(F.array_distinct(h)), F.array_sort(pairs)))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(F.col(t("l"))) - F.size(F.array_distinct(F.col(t("l")))),
        "n_repeat_words": F.when(F.col(t("s")).isNotNull(), _repeat_words(t("w"), t("h"), t("s"))).otherwise(0),
        "n_lines": F.size(F.col(t("l"))),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
    }
    d = d.withColumns({prefix + n: c.cast("long") for n, c in counts.items()})
    # a later filter must not unfold the counts, text to ratio, into itself
    return fence(d.drop(*[t(n) for n in "wlhs"]), *[prefix + n for n in counts])


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 10) | (100 * repeated > 20 * n)


def failed_rules(rules: Sequence[Rule] = RULES, prefix: str = "", lang: Column | None = None) -> Column:
    """The names of the rules that a row fails, in table order, comma-joined. Without ``lang`` rules by language don't apply."""
    tests = []
    listed = F.lit(False) if lang is None else F.coalesce(F.lower(F.substring(lang.cast("string"), 1, 2)).isin(*LANGUAGES), F.lit(False))
    for r in rules:
        left, right = 100 * F.col(prefix + r.top), r.percent * F.col(prefix + r.base)
        fails = (left > right if r.side == "above" else left < right) & (F.col(prefix + "n_words") >= r.least_words)
        fails = fails & listed if r.by_language else fails
        tests.append(F.when(fails, F.lit(r.name)))
    return F.concat_ws(",", *tests)


def judge_documents(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules`` a row of ``docs(doc_id, text)``.

    Null and empty texts have zero counts and fail. Repeated rows are judged
    each. Of other columns only ``lang`` is read, if there is one: stop words
    are asked of texts in the languages listed only.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    judged = with_counts(docs.select("doc_id", "text", lang.alias("lang")), "").drop("text")
    judged = judged.withColumns({"base_failed": base_failed(), "failed_rules": failed_rules(rules, lang=F.col("lang"))})
    kept = ~F.col("base_failed") & (F.col("failed_rules") == "")
    return judged.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "failed_rules")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass; all columns and their names stay."""
    prefix = free_prefix(docs.columns)
    good = ~base_failed(prefix) & (failed_rules(rules, prefix, F.col("lang") if "lang" in docs.columns else None) == "")
    return with_counts(docs, prefix).where(good).select(*[F.col(f"`{c}`") for c in docs.columns])
