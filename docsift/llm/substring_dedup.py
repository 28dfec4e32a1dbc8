"""Repeated passages by difference-cover anchors.

A window is 35 words in a row. Of the places modulo a period of 21, five form a difference cover: for any two places
there is a shift below the period that brings both into the cover. Hence two equal windows hold an anchor of 15 words
(35 - 21 + 1) that begins at a cover place in both. So

1. only anchors at cover places are hashed and shuffled; those that occur once are dropped,
2. anchors that occur again are extended to the windows around them, and only these windows are hashed and shuffled,
3. windows that occur again mark their words.

Rows are the same at any skew: what occurs again among the documents that a task reads together is settled there, and
one row of each such group goes on to meet the other tasks' rows. The rest of the group is dealt out evenly.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import row_key, words_of
from docsift.session import Workspace

WINDOW = 35
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1
# Documents of about so many characters are looked at together.
GROUP_CHARS = 8_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

PLACES = "key long, place int, first long, second int, known boolean"
PLACE_SCHEMA = pa.schema([
    ("key", pa.int64()), ("place", pa.int32()), ("first", pa.int64()), ("second", pa.int32()), ("known", pa.bool_()),
])


def mixed(values: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of every window of ``length`` words, from the words' hashes: polynomials modulo 2^64."""
    n = len(words)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers, dtype=np.uint64)])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - length, _INVERSE)]), dtype=np.uint64)
    return mixed((sums[length:] - sums[:-length]) * back)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, their hashes, and zeros for a second hash."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    places = np.arange(len(words) - ANCHOR + 1)
    places = places[np.isin(places % PERIOD, COVER)]
    return places, window_hashes(word_hashes(words), ANCHOR)[places], np.zeros(len(places), np.uint64)


def extended(words: list[bytes], repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the windows that hold a repeated anchor, and two independent hashes of each."""
    last = len(words) - WINDOW
    steps = np.zeros(last + 2, dtype=np.int64)
    np.add.at(steps, np.maximum(repeated - (WINDOW - ANCHOR), 0), 1)
    np.add.at(steps, np.minimum(repeated, last) + 1, -1)
    places = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
    hashes = word_hashes(words)
    return places, window_hashes(hashes, WINDOW)[places], window_hashes(mixed(hashes + _BASE), WINDOW)[places]


def _settle(keys: np.ndarray, places: np.ndarray, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle; ``known`` marks what occurs again right here.

    The first row of such a group keeps the group's hash, the others get hashes of their own.
    """
    second = (second >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((second, first))
    same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    later, known = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    later[order[1:]] = same
    known[order[1:]] |= same
    known[order[:-1]] |= same
    own = mixed(first + np.arange(1, len(first) + 1, dtype=np.uint64) * _BASE)
    own ^= mixed(keys.view(np.uint64) + places.astype(np.uint64))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys), pa.array(places.astype(np.int32)), pa.array(np.where(later, own, first).view(np.int64)),
            pa.array(second.view(np.int32)), pa.array(known),
        ],
        schema=PLACE_SCHEMA,
    )


def _hashed(rows: DataFrame, hashes: Callable) -> DataFrame:
    """Rows of ``hashes(words, *rest of the row)`` for all rows of (key, text, ...)."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            chars = 0
            for row in range(batch.num_rows):
                key, text, *more = (column[row].as_py() for column in batch.columns)
                found = hashes(words_of(text), *[np.array(value, dtype=np.int64) for value in more])
                held.append((np.full(len(found[0]), key, dtype=np.int64), *found))
                chars += len(text)
                if chars >= GROUP_CHARS:
                    yield _settle(*map(np.concatenate, zip(*held, strict=True)))
                    held, chars = [], 0
            if held:
                yield _settle(*map(np.concatenate, zip(*held, strict=True)))

    return rows.mapInArrow(computed, PLACES)


def _repeated(places: DataFrame, name: str) -> DataFrame:
    """key and an array of the places whose hashes occur again; its length is bounded by the document's."""
    times = F.count("*").over(Window.partitionBy("first", "second"))
    again = places.withColumn("times", times).where("known OR times > 1")
    # A set: rows repeated with their doc_id share a key, and their places are the same.
    return again.groupBy("key").agg(F.collect_set("place").alias(name))


def cut(text: str, removed: np.ndarray, layout: bool) -> str:
    """The text without the marked words: the others joined by one space, or with the text's own white space."""
    data = text.encode()
    if not layout:
        return b" ".join([word for word, gone in zip(data.split(), removed.tolist(), strict=True) if not gone]).decode()
    if not removed.any():
        return text
    starts = np.array([match.start() for match in _WORD.finditer(data)] + [len(data)])
    edges = np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))
    parts, at = [], 0
    for start, end in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        parts.append(data[at : starts[start]])
        at = starts[end]
    return b"".join([*parts, data[at:]]).decode()


def _without_repeats(layout: bool) -> Callable[[Column, Column], Column]:
    """n_words, n_removed and the kept text of (text, places of repeated windows or null)."""

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def kept(texts: pd.Series, windows: pd.Series) -> pd.DataFrame:
        rows = []
        for text, places in zip(texts, windows, strict=True):
            n = len(words_of(text))
            steps = np.zeros(n + 1, dtype=np.int64)
            if places is not None:
                starts = np.unique(np.asarray(places, dtype=np.int64))
                steps[starts] += 1
                np.add.at(steps, starts + WINDOW, -1)
            removed = np.cumsum(steps[:-1]) > 0
            rows.append((n, int(removed.sum()), cut(text, removed, layout)))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return kept


def remove_repeats(
    documents: DataFrame,
    workspace: Workspace,
    layout: bool = False,
    output: Callable[[Column], Column] = lambda kept: kept,
) -> DataFrame:
    """``row`` (all columns of ``documents`` but text), n_words, n_removed and ``kept`` of every row.

    A word goes if a window of 35 words covers it whose sequence of words also begins at another place, of any
    document; no copy stays. ``kept`` is the text of the other words, joined by one space or, with ``layout``, with
    the white space around them; ``output`` is applied to it at once, so that a digest is all that is stored.

    A null text has no words. Rows that are equal in doc_id and text share a key; each of their windows counts, so
    they are repeats of each other. Texts with fewer than 35 words and an empty table are returned as they are.
    """
    others = [F.col(f"`{name}`") for name in documents.columns if name != "text"]
    rows = documents.select(
        F.struct(*others).alias("row"), row_key("doc_id", "text").alias("key"),
        F.coalesce("text", F.lit("")).alias("whole"),
    )
    repeated_anchors = workspace.write(_repeated(_hashed(rows.select("key", "whole"), anchors), "anchors"), "anchors")
    met = rows.join(repeated_anchors, "key", "left")
    unique = F.col("anchors").isNull()
    clean = _without_repeats(layout)(F.when(unique, F.col("whole")).otherwise(""), F.lit(None).cast("array<int>"))
    # The texts are shuffled once, here; only those that hold a repeated anchor are stored and looked at again.
    split = workspace.write(
        met.withColumn("found", clean).select(
            "row", "key", "anchors", "found.n_words", F.when(unique, output(F.col("found.kept"))).alias("kept"),
            F.when(~unique, F.col("whole")).alias("whole"),
        ),
        "split",
    )
    suspects = split.where("anchors IS NOT NULL")
    windows = _hashed(suspects.select("key", "whole", "anchors"), extended)
    repeated_windows = workspace.write(_repeated(windows, "windows"), "windows")
    suspects = suspects.join(repeated_windows, "key", "left")
    judged = suspects.select(
        "row", _without_repeats(layout)(F.col("whole"), F.col("windows")).alias("found")
    ).select("row", "found.n_words", "found.n_removed", output(F.col("found.kept")).alias("kept"))
    return split.where("anchors IS NULL").select(
        "row", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept"
    ).unionByName(judged)


def remove_repeated_passages(documents: DataFrame, workspace: Workspace) -> DataFrame:
    """All rows and columns of ``documents``; repeated passages are cut from ``text``, ``n_chars`` follows.

    A null text stays null.
    """
    names = {name.lower() for name in documents.columns}
    flag = next(name for name in map("text_was_null_{}".format, count()) if name not in names)
    marked = documents.withColumn(flag, F.col("text").isNull())
    found = remove_repeats(marked, workspace, layout=True)
    text = F.when(~F.col(f"row.{flag}"), F.col("kept"))
    columns = {
        "text": text.alias("text"),
        "n_chars": F.length(text).cast("long").alias("n_chars"),
    }
    return found.select(*[columns.get(name, F.col(f"row.`{name}`").alias(name)) for name in documents.columns])
