"""Fingerprints: a hash of title and body, or of the whole record when there is neither body nor DOI."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is hashed first, so that the two kinds never meet.
CONTENT_PREFIX = b"content-v1\x00"
RECORD_PREFIX = b"record-v1\x00"

# Fields of the record fingerprint in the order of their names.
RECORD_FIELDS = (
    "abstract", "author_name", "body", "citation_count", "document_type", "doi", "external_id", "language",
    "open_access", "organization_name", "page_count", "peer_reviewed", "published_at", "region", "source_name",
    "status", "tags", "title", "updated_at", "url", "word_count",
)
TEXT_FIELDS = (
    "abstract", "author_name", "body", "document_type", "doi", "external_id", "language", "organization_name",
    "region", "source_name", "status", "title", "url",
)


def _sized(text: Column) -> Column:
    """Eight-byte length, then the bytes."""
    return F.concat(
        F.unhex(F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0")), F.encode(text, "UTF-8")
    )


def content_fingerprint(title: Column, body: Column) -> Column:
    """Of canonical title and body; null without a body."""
    return F.sha2(F.concat(F.lit(bytearray(CONTENT_PREFIX)), _sized(title), _sized(body)), 256)


def record_fingerprint(canonical: Callable[[str], Column]) -> Column:
    """Of the compact JSON of all source fields, each in the canonical form given by ``canonical(name)``."""
    record = F.struct(*[canonical(name).alias(name) for name in RECORD_FIELDS])
    text = F.to_json(record, {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(bytearray(RECORD_PREFIX)), F.encode(text, "UTF-8")), 256)
