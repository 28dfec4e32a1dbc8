"""Secret scans through a trigram inverted index.

From every rule's regular expression a Boolean query of mandatory trigrams is derived. The index holds, for each
segment of the corpus (the documents a task reads together), the posting list of every trigram that some rule asks
for, as a bitmap over the segment's documents. A rule's posting lists are combined as its query says, and only the
candidates left are run through the regular expression. Rules without mandatory trigrams scan every document.

Segments are what lets the texts stay where they are: neither texts nor postings are shuffled, and no posting list
grows with the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import whole_text
from docsift.llm.trigram_query import ALL, Query, trigram_query


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap; matches whose ``group`` is shorter than ``least`` drop out."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base rules, in the order in which spans that start together are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    # Runs of 16 and more; asking for that length at once finds the same ones sooner.
    Rule("hex", r"[0-9a-f]{16,}", least=16),
)
# Forms of keys and tokens that public services document.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule(
        "private_key",
        # To the next END line, whatever stands between (headers, escaped line ends, short lines). If the next BEGIN line or
        # the text's end comes first: the headers and base64 that follow, and a short last line that looks like base64.
        r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
        r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
        r"|(?:(?:(?:\s|\\+[nrt])*(?:(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash): ?[^\r\n\\]*|[A-Za-z0-9+/=]{16,}))+"
        r"(?:(?:\s|\\+[nrt])+(?=[A-Za-z]*[0-9+/=])[A-Za-z0-9+/=]{1,15}(?![A-Za-z0-9+/=]))?)?)",
    ),
)
RULES = BASE_RULES + MORE_RULES
MASK = "[secret]"
# Bytes of text whose trigrams are looked up at a time.
SLICE_BYTES = 1 << 20


class Scanner:
    """The rules, ready to scan segments of texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.patterns = [re.compile(rule.pattern, re.ASCII) for rule in rules]
        self.queries: list[Query] = [trigram_query(rule.pattern) for rule in rules]
        grams = sorted(set().union(*(query.grams() for query in self.queries)))
        # Trigrams with characters beyond ASCII are never looked for, as texts are indexed by their bytes.
        self.grams = [gram for gram in grams if gram.isascii()]
        codes = [int.from_bytes(gram.encode(), "big") for gram in self.grams]
        self.place = np.full(1 << 24, -1, dtype=np.int16)
        self.place[codes] = np.arange(len(codes), dtype=np.int16)
        self.number = {gram: number for number, gram in enumerate(self.grams)}

    def index(self, texts: list[str]) -> np.ndarray:
        """The segment's inverted index: a row of the matrix is a trigram's posting list, a bitmap over the texts."""
        postings = np.zeros((len(self.grams), len(texts)), dtype=bool)
        start = 0
        while start < len(texts):
            end, size, parts = start, 0, []
            while end < len(texts) and (end == start or size < SLICE_BYTES):
                data = texts[end].encode()
                # The bytes between two texts are in no trigram.
                parts.append(data + b"\x00\x00")
                size += len(data) + 2
                end += 1
            joined = np.frombuffer(b"".join(parts), dtype=np.uint8)
            lower = np.where((joined >= 65) & (joined <= 90), joined + 32, joined).astype(np.uint32)
            grams = self.place[lower[:-2] << 16 | lower[1:-1] << 8 | lower[2:]]
            found = np.flatnonzero(grams >= 0)
            ends = np.cumsum([len(part) for part in parts])
            postings[grams[found], start + np.searchsorted(ends, found, side="right")] = True
            start = end
        return postings

    def candidates(self, postings: np.ndarray) -> list[np.ndarray]:
        """For each rule, a bitmap of the texts that may match it."""
        everything = np.ones(postings.shape[1], dtype=bool)
        nothing = np.zeros(postings.shape[1], dtype=bool)

        def posting(gram: str) -> np.ndarray:
            if not gram.isascii():
                return everything
            return postings[self.number[gram]] if gram in self.number else nothing

        return [query.matches(posting, everything) for query in self.queries]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """The verified spans of each text: (start, number of the rule, end), in order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, possible in enumerate(self.candidates(self.index(texts))):
            rule, pattern = self.rules[number], self.patterns[number]
            for place in np.flatnonzero(possible).tolist():
                found[place].extend(
                    (match.start(), number, match.end())
                    for match in pattern.finditer(texts[place])
                    if match.end(rule.group) - match.start(rule.group) >= rule.least
                )
        for spans in found:
            spans.sort()
        return found


@cache
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _shown(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[number].kind}:{start}:{end}" for start, number, end in spans)


SCAN_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(rules: tuple[Rule, ...] = RULES) -> Callable[[Column], Column]:
    """A function of a text column that gives the counts of the base kinds, their digest, and all spans."""

    @F.pandas_udf(SCAN_SCHEMA)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        scanner, base = scanner_of(rules), len(BASE_RULES)
        rows = []
        for spans in scanner.spans(texts.tolist()):
            of_base = [span for span in spans if span[1] < base]
            counts = [sum(span[1] == number for span in of_base) for number in range(base)]
            digest = hashlib.sha256(_shown(of_base, rules).encode()).hexdigest()
            rows.append((*counts, digest, _shown(spans, rules)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scanned


def scan_documents(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    ``rules`` begins with the base rules. Spans are ``kind:start:end`` in code points, end exclusive, by start and then
    by kind; those of different kinds may overlap. A null text is scanned as the empty one. Each row is scanned by
    itself: repeated rows get equal results, a null doc_id is carried along, other columns are ignored, an empty
    table gives no rows. There is no shuffle.
    """
    found = scan(rules)(whole_text()).alias("found")
    return documents.select("doc_id", found).select("doc_id", "found.*")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch covered by spans replaced by the mask."""
    parts, at, end = [], 0, -1
    for start, _, stop in spans:
        if start > end:
            parts += [text[at:start], MASK] if end < 0 else [text[end:start], MASK]
        end = max(end, stop)
    return "".join(parts) + text[end:] if end >= 0 else text


def redact_documents(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns; secrets in ``text`` are masked and ``n_chars``, if present, follows. Null stays null."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        given = [text or "" for text in texts]
        masked = [redacted(text, spans) for text, spans in zip(given, scanner_of(rules).spans(given), strict=True)]
        return pd.Series(masked, index=texts.index).where(texts.notna(), None)

    result = documents.withColumn("text", mask(F.col("text")))
    return result.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else result


def needs_full_scan(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The kinds of the rules without mandatory trigrams."""
    return [rule.kind for rule in rules if trigram_query(rule.pattern) == ALL]
