"""Bounded previews of rejected values: JSON text in ASCII, at most 200 characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW_LENGTH = 200

# One separator of compact JSON text together with everything before it, strings skipped whole.
_UP_TO_SEPARATOR = r'\G((?:[^",:]++|"(?:[^"\\]++|\\.)*+")*+)([,:])'


def _escape_non_ascii(text: Column) -> Column:
    def escape(char: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(char, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(char.rlike("[^ -~]"), units).otherwise(char)

    escaped = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), escape), "")
    return F.when(text.rlike("[^ -~]"), escaped).otherwise(text)


def _bounded(json_text: Column) -> Column:
    # Escapes only make the text longer, so its first 200 characters never depend on more than these.
    return F.substring(_escape_non_ascii(F.substring(json_text, 1, PREVIEW_LENGTH)), 1, PREVIEW_LENGTH)


def preview(value: Column, kind: Column) -> Column:
    """Preview of a VARIANT whose type name is ``kind``; a missing field shows as null."""
    compact = F.to_json(value)
    spaced = F.regexp_replace(F.substring(compact, 1, PREVIEW_LENGTH), _UP_TO_SEPARATOR, "$1$2 ")
    whole_float = kind.startswith("DECIMAL") & ~F.contains(compact, F.lit(".")) & (F.length(compact) < 19)
    shown = (
        F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), spaced)
        .when(whole_float, F.concat(compact, F.lit(".0")))
        .otherwise(compact)
    )
    return F.coalesce(_bounded(shown), F.lit("null"))


def preview_text(text: Column) -> Column:
    """Preview of a plain string."""
    # {"v":"..."} without its first five and its last character; the cut keeps the quoted text's beginning.
    short = F.substring(text, 1, PREVIEW_LENGTH)
    wrapped = F.to_json(F.struct(short.alias("v")))
    return _bounded(wrapped.substr(F.lit(6), F.length(wrapped) - 6))


def preview_body(text: Column) -> Column:
    """A body never shows its content."""
    return F.concat(F.lit("<body string length="), F.length(text).cast("string"), F.lit(">"))
