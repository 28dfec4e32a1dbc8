"""Benchmark decontamination as a prefix-filtered set join, in built-in functions only.

1. Each item is cut into windows of as many consecutive words as one asks for; an item with fewer words is one window.
   Equal windows of all items are one.
2. A window is the set of its shingles. To be contained in a document a window needs every one of them there, so any
   one alone is a sufficient prefix to join on. The documents' shingles that occur in some window are counted, and each
   window takes its rarest as its prefix; windows with a shingle that no document has are gone at once.
3. Documents' shingles meet the prefixes. The place of a shingle says where the window would begin; it must lie within
   the document (positional bound), which must be long enough (length bound).
4. What is left is verified word by word, in the same row, so no text is ever shuffled.

Windows are sent to the tasks in blocks of bounded size, one pass over the documents' words for each block: a stated set
of items against all rows. Hits are numbers; they meet by document, and documents with equal sets of windows look their
items up once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import whole_text
from docsift.operators.hot_join import join_lookup
from docsift.operators.numbering import number_rows
from docsift.session import Workspace

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
# Windows sent to every task at a time; each has at most so many words, and one row for each shingle length.
BLOCK_WINDOWS = 250_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# All of ASCII but letters and digits.
BETWEEN = "".join(chr(code) for code in range(128) if not chr(code).isalnum())


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text of which only A to Z are lower-cased.

    One pass turns everything between words into spaces, which is six times as fast as matching the pattern.
    """
    spaced = F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def shingle(words_column: str, start: Column, length: int) -> Column:
    """The 64-bit hash of ``length`` words from place ``start`` (from 0)."""
    return F.xxhash64(*[F.get(words_column, start + i) for i in range(length)])


def item_windows(items: DataFrame, window_words: int) -> DataFrame:
    """item_id and words of every window of every item."""
    split = items.select("item_id", words(whole_text()).alias("all_words")).where(F.size("all_words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all_words") - window_words, F.lit(0)))
    return split.select("item_id", "all_words", F.explode(starts).alias("start")).select(
        "item_id", F.slice("all_words", F.col("start") + 1, window_words).alias("words")
    )


def _window_shingles(windows: DataFrame, shingle_words: int) -> DataFrame:
    """block, window, n (its words), width (of its shingles), shingle and offset of every shingle of every window."""
    n = F.size("words")
    placed = windows.select(
        "block", "window", "words", n.alias("n"),
        F.explode(F.sequence(F.lit(0), F.greatest(n - shingle_words, F.lit(0)))).alias("offset"),
    )
    width = F.least(F.col("n"), F.lit(shingle_words))
    hashed = reduce(
        lambda other, k: F.when(width == k, shingle("words", F.col("offset"), k)).otherwise(other),
        range(1, shingle_words), shingle("words", F.col("offset"), shingle_words),
    )
    return placed.select("block", "window", "n", width.alias("width"), hashed.alias("shingle"), "offset")


def _positions(texts: DataFrame, width: int, *kept: str) -> DataFrame:
    """Every shingle of every document: row_id, shingle, place and the ``kept`` columns."""
    starts = F.sequence(F.lit(0), F.size("words") - width)
    return (
        texts.where(F.size("words") >= width).select("row_id", "words", F.explode(starts).alias("place"))
        .select("row_id", "place", shingle("words", F.col("place"), width).alias("shingle"), *kept)
    )


def _prefixes(texts: DataFrame, shingles: DataFrame, widths: dict[int, list[int]], workspace: Workspace) -> DataFrame:
    """Each window's rarest shingle among the documents' ones, if they have all of them."""
    counted = []
    for block, block_widths in widths.items():
        for width in block_widths:
            asked = shingles.where((F.col("block") == block) & (F.col("width") == width)).select("shingle").distinct()
            found = _positions(texts, width).join(F.broadcast(asked), "shingle").groupBy("shingle")
            counted.append(found.agg(F.count("*").alias("rarity")).withColumn("width", F.lit(width)))
    counts = workspace.write(reduce(DataFrame.unionByName, counted).distinct(), "rarity")
    ranked = shingles.join(counts, ["width", "shingle"], "left").groupBy("block", "window", "n", "width").agg(
        F.min(F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), "shingle", "offset")).alias("rarest")
    )
    return workspace.write(
        ranked.where("rarest.rarity > 0").select("block", "window", "n", "width", "rarest.shingle", "rarest.offset"),
        "prefixes",
    )


def _occurrences(texts: DataFrame, windows: DataFrame, prefixes: DataFrame, widths: dict[int, list[int]],
                 workspace: Workspace) -> DataFrame:
    """row_id, start, n and window of every occurrence of a window in a document."""
    found = []
    contents = prefixes.join(windows.select("window", F.col("words").alias("window_words")), "window")
    contents = workspace.write(contents, "asked")
    start = F.col("place") - F.col("offset")
    for block, block_widths in widths.items():
        for width in block_widths:
            asked = contents.where((F.col("block") == block) & (F.col("width") == width)).drop("block", "width")
            met = _positions(texts, width, "words").join(F.broadcast(asked), "shingle")
            inside = (F.size("words") >= F.col("n")) & (start >= 0) & (start + F.col("n") <= F.size("words"))
            same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("window_words")
            found.append(met.where(inside & same).select("row_id", start.alias("start"), "n", "window"))
    return workspace.write(reduce(DataFrame.unionByName, found), "occurrences")


def _hit_words(occurrences: DataFrame) -> DataFrame:
    """row_id, n_hit: the words inside at least one occurrence."""
    longest = occurrences.groupBy("row_id", "start").agg(F.max("n").alias("n"))
    before = Window.partitionBy("row_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    covered = F.coalesce(F.max(end).over(before), F.lit(0))
    fresh = longest.withColumn("fresh", F.greatest(end - F.greatest("start", covered), F.lit(0)))
    return fresh.groupBy("row_id").agg(F.sum("fresh").cast("long").alias("n_hit"))


def _found_items(occurrences: DataFrame, members: DataFrame, workspace: Workspace) -> DataFrame:
    """row_id, items: the sorted ids (as strings) of all items with a window in the document.

    Documents with the same windows share one look-up, so a passage that many documents and many items hold does not
    multiply the two.
    """
    held = occurrences.select("row_id", "window").distinct().groupBy("row_id").agg(
        F.array_sort(F.collect_list("window")).alias("windows")
    )
    held = workspace.write(held.withColumn("held", F.sha2(F.array_join("windows", ","), 256)), "held")
    kinds = held.groupBy("held").agg(F.first("windows").alias("windows"))
    listed = workspace.write(kinds.select("held", F.explode("windows").alias("window")), "windows-of-kinds")
    lookup = workspace.write(members.join(listed.select("window").distinct(), "window", "left_semi"), "members-held")
    of_kind = listed.join(lookup, "window").select("held", "item_id").distinct().groupBy("held").agg(
        F.array_sort(F.collect_list("item_id")).alias("items")
    )
    return join_lookup(held.select("row_id", "held"), workspace.write(of_kind, "items-of-kinds"), ["held"], "inner",
                       workspace).select("row_id", "items")


def find_contamination(documents: DataFrame, items: DataFrame, workspace: Workspace, window_words: int = WINDOW_WORDS,
                       shingle_words: int = SHINGLE_WORDS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """row_id, doc_id, n_words, n_hit, items of every row of ``documents``.

    A word is hit if it lies in an occurrence of a window of ``items`` (item_id, text); ``items`` lists their ids as
    sorted strings, each once (a null id is left out of the list, but its windows hit). Null and empty texts have no
    words and no windows; a text of any length is searched whole. Repeated rows of documents are answered each,
    repeated items count once. Other columns are ignored. Without documents there are no rows, without items no hits.
    """
    texts = documents.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", words(whole_text()).alias("words")
    )
    # The written table fixes the rows' numbers; all passes read it.
    texts = workspace.write(texts.withColumn("n_words", F.size("words").cast("long")), "words")
    cut = workspace.write(item_windows(items, window_words), "item-windows")
    distinct = number_rows(cut.select("words").distinct(), ["words"], "window", workspace)
    windows = workspace.write(
        distinct.withColumn("block", F.floor(F.col("window") / block_windows).cast("long")), "windows"
    )
    shingles = workspace.write(_window_shingles(windows, shingle_words), "window-shingles")
    # As many rows as there are blocks, times the shingle lengths in use.
    in_use = shingles.select("block", "width").distinct().orderBy("block", "width").collect()
    widths: dict[int, list[int]] = {}
    for row in in_use:
        widths.setdefault(row.block, []).append(row.width)
    rows = texts.select("row_id", "doc_id", "n_words")
    if not widths:
        return rows.select("*", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    prefixes = _prefixes(texts, shingles, widths, workspace)
    occurrences = _occurrences(texts, windows, prefixes, widths, workspace)
    members = cut.join(windows, "words").where("item_id IS NOT NULL").select(
        "window", F.col("item_id").cast("string").alias("item_id")
    ).distinct()
    found = _hit_words(occurrences).join(
        _found_items(occurrences, workspace.write(members, "members"), workspace), "row_id", "left"
    )
    return rows.join(found, "row_id", "left").select(
        "row_id", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
