"""Schemas of the stored tables."""

from __future__ import annotations

DOCUMENTS = (
    "id bigint, content_fingerprint string, external_id string, title string, abstract string, body string, "
    "published_at date, updated_at date, status string, document_type string, language string, region string, "
    "source_name string, url string, doi string, open_access boolean, peer_reviewed boolean, "
    "citation_count bigint, page_count bigint, word_count bigint, author_id bigint, organization_id bigint, "
    "completeness_score int, quality_tier string, run_id bigint"
)
NAMES = "id bigint, name string, run_id bigint"
DOCUMENT_TAGS = "document_id bigint, tag_id bigint, position int, run_id bigint"
RUNS = (
    "id bigint, status string, started_at timestamp, ended_at timestamp, processed bigint, inserted bigint, "
    "already_imported bigint, skipped bigint, warnings bigint, failure_reason string, source string, batch_key string"
)
ISSUES = (
    "id bigint, ingestion_run_id bigint, source_file string, source_line bigint, external_id string, "
    "field string, reason string, severity string, value_preview string"
)
# A document's DOI and fingerprint, one row each, with the other one; the first letter tells which is which.
DOCUMENT_KEYS = "key string, other_key string, id bigint"
# Sums over the documents of an import, to be added up.
STATISTICS = "metric string, key string, value bigint"
# How many documents of an import have a score, for each block of ids; to be added up.
SCORE_BLOCKS = "score int, block bigint, documents bigint"
TABLES = {
    "documents": DOCUMENTS,
    "authors": NAMES,
    "organizations": NAMES,
    "tags": NAMES,
    "document_tags": DOCUMENT_TAGS,
    "ingestion_issues": ISSUES,
    "document_keys": DOCUMENT_KEYS,
    "statistics": STATISTICS,
    "score_blocks": SCORE_BLOCKS,
    "ingestion_runs": RUNS,
}
# Tables that are looked up by a key: dealt by a prefix of its hash, and sorted by it.
DEALT = {"document_keys": "key", "authors": "name", "organizations": "name", "tags": "name"}
# Tables that are read by a range of ids: a folder for each block of ids that follow each other.
RANGED = {"documents": "id", "document_tags": "document_id"}
# Tables of sums, and what they are added up by.
SUMMED = {"statistics": (("metric", "key"), "value"), "score_blocks": (("score", "block"), "documents")}
# What files are ordered by.
ORDER = {
    "documents": ("id",), "document_tags": ("document_id", "position"), "ingestion_issues": ("id",),
    "ingestion_runs": ("id",),
}


def columns(table: str) -> dict[str, str]:
    """The names and types of a table's columns, in order."""
    return dict(field.split() for field in TABLES[table].split(", "))
# Longest text each bounded column may hold, per table.
MAX_LENGTHS = {
    "documents": {
        "content_fingerprint": 64, "external_id": 255, "status": 20, "document_type": 100, "language": 20,
        "region": 255, "source_name": 255, "doi": 255, "quality_tier": 10,
    },
    "authors": {"name": 255},
    "organizations": {"name": 255},
    "tags": {"name": 255},
    "ingestion_issues": {
        "source_file": 1024, "external_id": 255, "field": 100, "reason": 100, "severity": 20, "value_preview": 200,
    },
}
MAX_INTEGER = 2**31 - 1
