"""Strict decoding of a JSON line and typed access to its fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stands behind the line inside an array. It is found there only if the line is exactly one JSON value,
# so text after a complete value cannot go unnoticed. Any text that no input holds by chance will do.
_END_MARK = "end-of-line-5f0c1c7e9ad84c0b"

# Escapes of half a surrogate pair: a high half without a low one behind it, a low half without a high one before it.
_HIGH_ALONE = r"(?<!\\)((?:\\\\)*+)\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F][0-9a-fA-F]{2})"
_LOW_ALONE = r"(?<!\\u[dD][89abAB][0-9a-fA-F]{2})(?<!\\)((?:\\\\)*+)\\u[dD][c-fC-F][0-9a-fA-F]{2}"

# What one VARIANT can hold.
VARIANT_BYTES = 128 * 1024 * 1024
# The parser's own limits on single values, lifted; the nesting counts the array around the line.
_PARSER = {
    "maxStringLen": str(2**31 - 1),
    "maxNumLen": str(2**31 - 1),
    "maxNestingDepth": "1001",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}
# The parser takes no property name above this length.
_NAME_LIMIT = 50_000
# A string: its first 1,000 pieces, then the rest of a name (dropped) or of anything else (kept). A piece is an escape or a
# run of at most 40 other characters, so what is kept of a name stays below the limit. Characters are matched in runs, as
# one at a time takes many times as long.
_PLAIN = r'[^"\\\x00-\x1f]'
_ESCAPE = r'\\u[0-9a-fA-F]{4}|\\["\\/bfnrt]'
_STRING = (
    rf'("(?:{_PLAIN}{{1,40}}+|{_ESCAPE}){{0,1000}}+)'
    rf'(?:(?:{_PLAIN}++|{_ESCAPE})*+(?="[ \t\r\n]*+:)|((?:[^"\\]++|\\.)*+))"'
)


def is_blank(raw: Column) -> Column:
    """Whether a line is ASCII whitespace, before a last line end of any kind. Only its beginning is looked at."""
    return F.ltrim(raw, F.lit(" \t\n\r\x0b\x0c")).isin("", "\x85", "\u2028", "\u2029")


def is_object(raw: Column) -> Column:
    """Whether a line known to be valid JSON holds an object."""
    return F.startswith(F.ltrim(raw, F.lit(" \t\r\n")), F.lit("{"))


def mark_lone_surrogates(raw: Column) -> Column:
    """Turn escapes of lone surrogates into NUL escapes, which the text rules refuse just the same."""
    repaired = F.regexp_replace(F.regexp_replace(raw, _HIGH_ALONE, r"$1\\u0000"), _LOW_ALONE, r"$1\\u0000")
    # A plain search comes first: a pattern takes many times as long on a long line.
    possible = F.contains(raw, F.lit("\\u"))
    return F.when(possible & raw.rlike(r"\\u[dD][89a-fA-F]"), repaired).otherwise(raw)


def shorten_names(line: Column, raw: Column) -> Column:
    """Cut property names to 1,000 pieces in lines that may hold one longer than the parser takes.

    No field has such a name. Every string of the line is matched from its opening quote, so the pattern stays in step;
    only a name whose whole rest is valid JSON is cut. The size is that of ``raw``, so that ``line`` is worked out once.
    """
    return F.when(F.octet_length(raw) > _NAME_LIMIT, F.regexp_replace(line, _STRING, '$1$2"')).otherwise(line)


def decode(raw: Column) -> Column:
    """The line as VARIANT, or null when it is not strict JSON in valid UTF-8 or nests deeper than 1,000 levels.

    A valid line that is too large for a VARIANT fails the job; a malformed one is null at any length.
    """
    marked = F.concat(F.lit("["), shorten_names(mark_lone_surrogates(raw), raw), F.lit(f',"{_END_MARK}"]'))
    parsed = F.from_json(marked, "variant", _PARSER)
    valid = F.from_json(marked, "array<string>", _PARSER)[1] == _END_MARK
    too_large = F.raise_error(F.lit(f"a line of valid JSON exceeds {VARIANT_BYTES} bytes")).cast("variant")
    # The length comes first, so that other lines are parsed once.
    lost = (F.octet_length(raw) > VARIANT_BYTES // 8) & parsed.isNull() & valid
    checked = F.when(lost, too_large).otherwise(parsed)
    return F.when(~is_blank(raw) & F.is_valid_utf8(raw), checked)


def decoded_value(decoded: Column) -> Column:
    return F.when(
        F.try_variant_get(decoded, "$[1]", "string") == _END_MARK, F.try_variant_get(decoded, "$[0]", "variant")
    )


def kind_of(value: Column) -> Column:
    """Type name of a VARIANT: STRING, BIGINT, BOOLEAN, VOID (JSON null), DECIMAL(p,s), DOUBLE, ARRAY<..>, OBJECT<..>."""
    return F.schema_of_variant(value)


def text_of(value: Column) -> Column:
    """The text of a VARIANT string; null for every other type."""
    return F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))
