"""Word and line expressions shared by the text operators.

A word is a run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return. A null text has no words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of ``text`` in order; an empty array if there are none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_RUN))


def word_count(text: Column) -> Column:
    """Number of words as long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit_draw(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone, alike in every run and engine (52 bits of MD5)."""
    name = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def free_prefix(columns: list[str], start: str = "gesso__") -> str:
    """A prefix that no column name begins with."""
    while any(c.lower().startswith(start) for c in columns):
        start += "_"
    return start
