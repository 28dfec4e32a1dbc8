"""Unicode-aware text expressions: strip, case folding, canonical form."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The characters Unicode treats as whitespace, plus the four separators U+001C..U+001F.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Cherokee folds its small letters to capitals, against the general direction.
_CHEROKEE_SMALL = "".join(map(chr, [*range(0xAB70, 0xABC0), *range(0x13F8, 0x13FE)]))
_CHEROKEE_CAPITAL = "".join(map(chr, [*range(0x13A0, 0x13F0), *range(0x13F0, 0x13F6)]))

# Blocks that hold nearly all letters in use; within them stable_characters() picks what qualifies.
_BLOCKS = ((0x80, 0x233), (0x250, 0x2AF), (0x370, 0x3FF), (0x400, 0x52F), (0x1E00, 0x1EFF), (0x2000, 0x203A),
           (0x20A0, 0x20BF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
# Shorter runs beyond Latin-1 and punctuation are left out, to keep the pattern quick.
_SHORTEST_RUN = 5


def strip(text: Column) -> Column:
    """Without whitespace at both ends. Most texts have none there, which their first and last character tell.

    Those are looked for in three bytes at each end, as counting characters would read the whole text; four-byte
    characters may look like whitespace there, and are then left alone by the trim.
    """

    def is_space(end: int, char: int) -> Column:
        few = F.substring(text.cast("binary"), end, 3).cast("string")
        return F.contains(F.lit(WHITESPACE), F.substring(few, char, 1))

    at_an_end = is_space(1, 1) | is_space(-3, -1)
    return F.when(at_an_end, F.trim(text, F.lit(WHITESPACE))).otherwise(text)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def contains_nul(text: Column) -> Column:
    return F.contains(text, F.lit("\u0000"))


def _fold(text: Column) -> Column:
    """Capitals first, small letters second gives the full folding, once the capital sharp s and the final sigma
    are repaired, for all letters but Cherokee and the dotless i."""
    capitals = F.replace(F.upper(text), F.lit("ẞ"), F.lit("SS"))
    return F.replace(F.lower(capitals), F.lit("ς"), F.lit("σ"))


def casefold(text: Column) -> Column:
    """Full Unicode case folding with built-in functions."""

    def fold(part: Column) -> Column:
        cherokee = F.lower(part).rlike(r"[\u13a0-\u13ff\uab70-\uabbf]")
        return F.when(cherokee, F.translate(_fold(part), _CHEROKEE_SMALL, _CHEROKEE_CAPITAL)).otherwise(_fold(part))

    # The dotless i has no other form and stays as it is.
    around_dotless = F.array_join(F.transform(F.split(text, "ı", -1), fold), "ı")
    return (
        F.when(is_ascii(text), F.lower(text))
        .when(F.contains(text, F.lit("ı")), around_dotless)
        .otherwise(fold(text))
    )


def stable_characters() -> str:
    """Body of a regex class of non-ASCII characters that NFKC leaves alone, also next to each other.

    A character qualifies when it is its own NFKC form, is no combining mark and never is the second half
    of a composition. Whitespace qualifies too, because the canonical form turns it into a space anyway.
    The dotless i does not, because it needs its own way of case folding.
    """
    second_halves = {
        int(parts[1], 16)
        for code in range(0x80, 0x20000)
        if len(parts := unicodedata.decomposition(chr(code)).split()) == 2 and not parts[0].startswith("<")
    }

    def qualifies(code: int) -> bool:
        char = chr(code)
        if char in WHITESPACE:
            return True
        return (
            unicodedata.category(char) != "Cn"
            and unicodedata.is_normalized("NFKC", char)
            and unicodedata.combining(char) == 0
            and code not in second_halves
            and char != "ı"
        )

    ranges: list[list[int]] = []
    for low, high in _BLOCKS:
        for code in range(low, high + 1):
            if not qualifies(code):
                continue
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    # The last ranges are tried first, so the commonest letters go to the end.
    chosen = [
        (low, high)
        for low, high in reversed(ranges)
        if high - low + 1 >= _SHORTEST_RUN or low < 0x100 or 0x2000 <= low < 0x2100 or chr(low) in WHITESPACE
    ]
    return "".join(f"\\u{low:04x}-\\u{high:04x}" for low, high in chosen)


_STABLE_TEXT = rf"^[\x00-\x7f]*+(?:[{stable_characters()}]++[\x00-\x7f]*+)*+$"
# Runs of ASCII whitespace, but for a plain space between words, which stays as it is.
_ASCII_RUNS = r"[\t-\r\x1c-\x20]+(?<![^\t-\r\x1c-\x20] )"
_WIDE_WHITESPACE = [char for char in WHITESPACE if char > "\x7f"]
# Most of it begins with these two bytes, so one search for them often saves many.
_PUNCTUATION_BYTES = b"\xe2\x80"


def needs_unicode_normalization(text: Column) -> Column:
    """True when the text holds a character whose NFKC form cannot be taken for granted."""
    return F.coalesce(~is_ascii(text) & ~text.rlike(_STABLE_TEXT), F.lit(False))


def _narrow_whitespace(text: Column) -> Column:
    """Wide whitespace as plain spaces. Plain searches, as a pattern of this many characters is slow."""
    present, punctuation = F.lit(False), F.lit(False)
    replaced = text
    for char in _WIDE_WHITESPACE:
        found = F.contains(text, F.lit(char))
        if char.encode().startswith(_PUNCTUATION_BYTES):
            punctuation = punctuation | found
        else:
            present = present | found
        replaced = F.replace(replaced, F.lit(char), F.lit(" "))
    present = present | (F.contains(text, F.lit(_PUNCTUATION_BYTES).cast("string")) & punctuation)
    return F.when(~is_ascii(text) & present, replaced).otherwise(text)


def canonical(text: Column) -> Column:
    """Whitespace runs to one space, trimmed and case-folded; for texts of stable characters."""
    collapsed = F.trim(F.regexp_replace(_narrow_whitespace(text), _ASCII_RUNS, " "))

    def folded(value: Column) -> Column:
        return F.when(is_ascii(value), F.lower(value)).otherwise(_fold(value))

    # A transform over one element gives the collapsed text a name, so that it is computed once.
    return F.element_at(F.transform(F.array(collapsed), folded), 1)


def unicode_canonical():
    """Arrow function for the texts that do need NFKC; nested so that workers need not import this package."""

    @pandas_udf("string")
    def canonical_text(texts):
        import unicodedata as ucd

        return texts.map(lambda t: None if t is None else " ".join(ucd.normalize("NFKC", t).split()).casefold())

    return canonical_text


def unicode_canonical_list():
    @pandas_udf("array<string>")
    def canonical_texts(lists):
        import unicodedata as ucd

        return lists.map(
            lambda items: None
            if items is None
            else [" ".join(ucd.normalize("NFKC", t).split()).casefold() for t in items]
        )

    return canonical_texts
