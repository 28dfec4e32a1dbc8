"""Quality rules by compression bands.

Zstandard's ratio (compressed bytes to bytes) of a whole text, and of its chunks of fixed size, must lie within limits
that depend on the text's length: long texts compress better, as a compressor sees more to repeat. A text below its
band repeats itself, one above it is noise. Chunks find repetition or noise that the rest of a long text hides; they
cover a text to its last byte.

The limits allow for scripts: what an alphabet says in a letter takes one byte in Latin and two or three elsewhere, so
the lower limits are for compressed bytes per code point, and the upper ones rise with the bytes per code point, as
signs of scripts with thousands of them compress less.

The limits are parameters, set once below and above what real prose of some twenty languages gives; repeated words or
lines lie below, base64 and random characters above. Prose with symbols strewn in and tables compress as manuals do, so
shares of symbols tell them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import codes_of, free_kept, words_of

SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Symbols among the characters of words, and words that are nothing but symbols among the words.
MAX_SYMBOL_PERCENT = 10
MAX_SYMBOL_WORDS_PERCENT = 20


@dataclass(frozen=True)
class Bands:
    """Limits by length in bytes, in order of length.

    ``whole``: (from this length on, lowest bytes per code point, highest ratio of a script with one byte a code point).
    ``chunks``: (from this length on, bytes of a chunk, lowest and highest as above).
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.15, 1.60),
        (256, 0.40, 0.95),
        (512, 0.37, 0.86),
        (1024, 0.33, 0.76),
        (2048, 0.32, 0.70),
        (4096, 0.30, 0.66),
        (8192, 0.28, 0.63),
        (16384, 0.26, 0.61),
        (65536, 0.23, 0.60),
    )
    chunks: tuple[tuple[int, int, float, float], ...] = (
        (512, 512, 0.37, 0.80),
        (2048, 1024, 0.32, 0.72),
        (16384, 4096, 0.26, 0.62),
    )
    # The share of a text's chunks that may lie outside their limits: none of fewer than ten.
    outside_share: float = 0.1
    # What the highest ratio rises by with every further byte per code point.
    script_rise: float = 0.2
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        return next((low, high) for least, low, high in reversed(self.whole) if size >= least)

    def chunk(self, size: int) -> tuple[int, float, float] | None:
        return next((chunk for least, *chunk in reversed(self.chunks) if size >= least), None)


@dataclass
class BandJudge:
    bands: Bands
    compressor: zstandard.ZstdCompressor = field(init=False)

    def __post_init__(self) -> None:
        self.compressor = zstandard.ZstdCompressor(level=self.bands.level)

    def ratio(self, data: bytes | memoryview) -> float:
        return len(self.compressor.compress(data)) / len(data)

    def within(self, ratio: float, data: bytes | memoryview, low: float, high: float) -> bool:
        """Whether the ratio of the data, UTF-8 or a stretch of it, lies within limits for one byte a code point."""
        continued = np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)
        width = len(data) / max(1, len(data) - continued)
        return low <= ratio * width and ratio <= high * (1 + self.bands.script_rise * (width - 1))

    def __call__(self, data: bytes) -> tuple[float, float, bool]:
        """The whole ratio, the share of chunks outside their limits, and whether the text is within its band.

        The last chunk is the text's last bytes and may overlap the one before. An empty text has ratio 1 and no chunks,
        and is not rejected here; texts below the shortest chunk have none either.
        """
        if not data:
            return 1.0, 0.0, True
        whole, share = self.ratio(data), 0.0
        chunk = self.bands.chunk(len(data))
        if chunk is not None:
            size, low, high = chunk
            view, last = memoryview(data), len(data) - size
            parts = [view[at : at + size] for at in (*range(0, last, size), last)]
            share = sum(not self.within(self.ratio(part), part, low, high) for part in parts) / len(parts)
        return whole, share, self.within(whole, data, *self.bands.limits(len(data))) and share <= self.bands.outside_share


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, the first find included."""
    if len(words) < 4:
        return 0
    codes, distinct = codes_of(words)
    base = len(distinct)
    windows = codes[:-2] * base + codes[1:-1]
    if base > 2_000_000:  # so that the product below stays within 64 bits
        windows = np.unique(windows, return_inverse=True)[1]
    windows = windows * base + codes[2:]
    _, place, counts = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = counts[place] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(repeated)] |= repeated
    return int(covered.sum())


def text_figures(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [line for line in text.split("\n") if line.strip(SEPARATORS)]
    return (
        len(words),
        len(text) - sum(map(text.count, SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def mostly_symbols(words: list[bytes], word_chars: int, n_symbols: int) -> bool:
    """Symbol noise and tables, which compress like prose."""
    alone = sum(not word.strip(SYMBOLS.encode()) for word in words)
    return 100 * n_symbols > MAX_SYMBOL_PERCENT * word_chars or 100 * alone > MAX_SYMBOL_WORDS_PERCENT * len(words)


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT_SCHEMA = (
    ", ".join(f"{name} long" for name in FIGURES)
    + ", base_failed boolean, kept boolean, ratio double, chunks_outside double"
)


def verdict(bands: Bands = Bands()) -> Callable[[Column], Column]:
    """A function of a text column that gives a struct of figures and verdicts."""

    @F.pandas_udf(VERDICT_SCHEMA)
    def judged(texts: pd.Series) -> pd.DataFrame:
        free_kept()
        judge, rows = BandJudge(bands), []
        for text in texts:
            text = text or ""
            words = words_of(text)
            figures = text_figures(text, words)
            whole, outside, within = judge(text.encode())
            within = within and not mostly_symbols(words, figures[1], figures[2])
            failed = figures[0] < MIN_WORDS or 100 * figures[4] > MAX_REPEAT_PERCENT * figures[0]
            rows.append((*figures, failed, within and not failed, whole, outside))
        return pd.DataFrame(rows, columns=[*FIGURES, "base_failed", "kept", "ratio", "chunks_outside"])

    return judged


def judge_documents(documents: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id, the five figures, base_failed, kept, ratio, chunks_outside of every row.

    A null or empty text has no words, so it fails the base rule. Each row is judged by itself, so repeated rows get
    equal verdicts and a null doc_id changes nothing. Other columns are ignored. An empty table gives no rows. There
    is no shuffle; a task holds a batch of texts at a time.
    """
    return documents.select("doc_id", verdict(bands)(F.col("text")).alias("verdict")).select("doc_id", "verdict.*")


def keep_good(documents: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    judged = documents.select(F.struct("*").alias("row"), verdict(bands)(F.col("text")).alias("verdict"))
    return judged.where("verdict.kept").select("row.*")
