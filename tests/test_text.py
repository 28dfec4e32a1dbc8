"""Text expressions against Python's Unicode functions, over all characters."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import functions as F

from docsift.functions.json_values import is_blank, is_object
from docsift.functions.text import WHITESPACE, canonical, casefold, needs_unicode_normalization, strip


def all_characters():
    return [chr(c) for c in range(1, sys.maxunicode + 1)
            if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]


def test_whitespace_is_what_python_strips():
    assert sorted(WHITESPACE) == sorted(char for char in map(chr, range(0x110000)) if char.isspace())


def test_casefold_and_stable_characters_on_all_characters(spark):
    chars = all_characters()
    frame = spark.createDataFrame([(c,) for c in chars], "c string").repartition(8)
    rows = frame.select(
        "c",
        casefold(F.col("c")).alias("folded"),
        casefold(F.concat(F.lit("aΣ"), "c")).alias("after"),
        strip(F.concat("c", F.lit("x"), "c")).alias("stripped"),
        needs_unicode_normalization(F.concat(F.lit("a"), "c", F.lit("b"))).alias("marked"),
        canonical(F.concat(F.lit("A "), "c", F.lit(" ẞ"))).alias("canonical"),
    ).collect()
    assert len(rows) == len(chars)
    assert [r.c for r in rows if r.folded != r.c.casefold() or r.after != "aσ" + r.c.casefold()] == []
    assert [r.c for r in rows if r.stripped != f"{r.c}x{r.c}".strip()] == []
    wrong = [
        r.c for r in rows
        if not r.marked and r.canonical != " ".join(unicodedata.normalize("NFKC", f"A {r.c} ẞ").split()).casefold()
    ]
    assert wrong == []
    assert sum(not r.marked for r in rows) > 30_000


def test_ends_and_runs_are_those_of_the_patterns_they_replace(spark):
    ends = ["", "a", "\u00e9", "\u4e2d", "\U0001f600", "\u2013", " ", "  ", "\n", "\r\n", " \x1c", "\u3000", "\x85", "\u2028", "{", "["]
    texts = sorted({a + b + c for a in ends for b in ("", "x", "x y", "x \n y", "\t", "{}") for c in ends})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", strip(F.col("t")).alias("stripped"), canonical(F.col("t")).alias("canonical"),
        is_blank(F.col("t")).alias("blank"), F.col("t").rlike(r"^[ \t\n\r\x0b\x0c]*+$").alias("blank_by_pattern"),
        is_object(F.col("t")).alias("object"), F.col("t").rlike(r"^[ \t\r\n]*\{").alias("object_by_pattern"),
    ).collect()
    assert [r.t for r in rows if r.stripped != r.t.strip()] == []
    assert [r.t for r in rows if r.canonical != " ".join(r.t.split()).casefold()] == []
    assert [r.t for r in rows if (r.blank, r.object) != (r.blank_by_pattern, r.object_by_pattern)] == []
