"""Lines to records: outcome, clean fields, score, issues and fingerprint, in one pass without a shuffle."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import fields as rules
from docsift.functions.fingerprint import RECORD_FIELDS, TEXT_FIELDS, content_fingerprint, record_fingerprint
from docsift.functions.json_values import decode, decoded_value, is_blank, is_object, text_of
from docsift.functions.text import (
    canonical, casefold, needs_unicode_normalization, strip, unicode_canonical, unicode_canonical_list,
)
from docsift.session import prepare

# Source fields in the order in which their issues are reported, with their rules.
FIELD_RULES = {
    "external_id": rules.optional_text,
    "abstract": rules.optional_text,
    "body": rules.optional_text,
    "region": rules.optional_text,
    "source_name": rules.optional_text,
    "author_name": rules.name_text,
    "organization_name": rules.name_text,
    "published_at": rules.calendar_date,
    "updated_at": rules.calendar_date,
    "open_access": rules.boolean,
    "peer_reviewed": rules.boolean,
    "tags": None,
    "status": rules.status,
    "document_type": rules.document_type,
    "language": rules.language,
    "url": rules.url,
    "doi": rules.doi,
    "citation_count": rules.count,
    "page_count": rules.count,
    "word_count": rules.count,
}
# Fields whose rules look at the case-folded text.
FOLDED = (
    "author_name", "organization_name", "open_access", "peer_reviewed", "status", "document_type", "language", "doi",
)
LINE_COLUMNS = ("source_file", "source_line", "line_order")
SOURCE_FIELDS = ("title", *FIELD_RULES)


def _field(name: str) -> rules.JsonField:
    """A field whose value, type name and text were put into columns by normalize_lines, in all its forms."""
    return rules.JsonField(name, *[F.col(f"{form}_{name}") for form in ("value", "kind", "text", "stripped", "folded")])


def _title_expressions() -> dict[str, dict[str, Column]]:
    raw, title = F.col("raw"), rules.JsonField.of("title", F.col("value_title"))
    outcome = (
        F.when(is_blank(raw), "blank_line")
        .when(F.col("record").isNull(), "invalid_json")
        .when(~is_object(raw), "record_is_not_object")
        .when(~_field("title").safe_text | (strip(F.col("text_title")) == ""), "missing_required_title")
        .otherwise("accepted")
    )
    return {
        "decoded": {"decoded": decode(raw)},
        "record": {"record": decoded_value(F.col("decoded"))},
        "title": {"value_title": F.when(is_object(raw), F.try_variant_get("record", "$.title", "variant"))},
        "typed_title": {"kind_title": title.kind, "text_title": title.text},
        "outcome": {"outcome": outcome},
    }


def _rejection(outcome: Column, raw: Column, record: Column) -> Column:
    """The single issue of a line that yields no document."""
    undecodable = F.when(F.is_valid_utf8(raw), "<malformed json>").otherwise("<invalid utf-8>")
    not_object = rules.raw_issue("record", "record_is_not_object", record, F.schema_of_variant(record))
    return (
        F.when(
            outcome == "blank_line", rules.raw_issue("record", "blank_line", None, None, F.lit("<blank line>"))
        )
        .when(outcome == "invalid_json", rules.raw_issue("record", "invalid_json", None, None, undecodable))
        .when(outcome == "record_is_not_object", not_object)
        .when(outcome == "missing_required_title", _field("title").issue("missing_required_title"))
    )


def _record_expressions() -> dict[str, dict[str, Column]]:
    raw, record, outcome = F.col("raw"), F.col("record"), F.col("outcome")
    accepted = outcome == "accepted"
    fields = {name: _field(name) for name in FIELD_RULES}
    applied = {name: rule(fields[name]) for name, rule in FIELD_RULES.items() if rule}
    applied["tags"] = rules.tag_list(fields["tags"], F.col("tag_items"))
    issues = [
        applied[name].issues(F.col(name)) if name == "tags" else F.array(applied[name].issues(F.col(name)))
        for name in FIELD_RULES
    ]
    disordered = F.when(
        F.col("updated_at") < F.col("published_at"), fields["updated_at"].issue("updated_before_published")
    )
    all_issues = F.when(accepted, F.concat(*issues, F.array(disordered))).otherwise(F.array("rejection"))
    logged_id = F.when(is_object(raw), F.try_variant_get(record, "$.external_id", "variant"))
    cut_id = F.nullif(F.substring(strip(text_of(F.col("logged_id"))), 1, 255), F.lit(""))
    score = rules.completeness_score({name: F.col(name) for name in SOURCE_FIELDS})
    return {
        "opened": {
            "rejection": F.when(~accepted, _rejection(outcome, raw, record)),
            "logged_id": F.when(~accepted, logged_id),
            **{
                f"value_{name}": F.when(accepted, F.try_variant_get(record, f"$.{name}", "variant"))
                for name in FIELD_RULES
            },
        },
        "kinds": {f"kind_{name}": F.schema_of_variant(f"value_{name}") for name in FIELD_RULES},
        "texts": {
            f"text_{name}": F.when(
                F.col(f"kind_{name}") == "STRING", F.try_variant_get(f"value_{name}", "$", "string")
            )
            for name in FIELD_RULES
        },
        "stripped": {
            "tag_items": rules.tag_items(fields["tags"]),
            **{f"stripped_{name}": strip(F.col(f"text_{name}")) for name in ("title", *FIELD_RULES) if name != "tags"},
        },
        "folded": {f"folded_{name}": casefold(F.col(f"stripped_{name}")) for name in FOLDED},
        "clean": {
            "title": F.when(accepted, F.col("stripped_title")),
            **{name: F.when(accepted, rule.value) for name, rule in applied.items()},
        },
        "summary": {
            "logged_external_id": F.when(accepted, F.col("external_id")).otherwise(cut_id),
            "completeness_score": F.when(accepted, score),
            "issues": rules.issue_list(all_issues),
        },
        "tier": {"quality_tier": F.when(accepted, rules.quality_tier(F.col("completeness_score")))},
    }


@cache
def _expressions(application: str) -> dict[str, dict[str, Column]]:
    """The named columns of each projection; they depend on no frame, so one set serves a whole application."""
    return _title_expressions() | _record_expressions() | _fingerprint_expressions()


def _projections(frame: DataFrame) -> dict[str, dict[str, Column]]:
    return _expressions(frame.sparkSession.sparkContext.applicationId)


def decode_lines(lines: DataFrame) -> DataFrame:
    """Add the decoded VARIANT and the outcome of each line, up to and including the title rule.

    ``lines`` holds source_file, source_line, line_order (import order over all files) and raw.
    """
    prepare(lines.sparkSession)
    columns = _projections(lines)
    decoded = lines.withColumns(columns["decoded"]).withColumns(columns["record"]).drop("decoded")
    for step in ("title", "typed_title", "outcome"):
        decoded = decoded.withColumns(columns[step])
    return decoded


def normalize_lines(lines: DataFrame) -> DataFrame:
    """One row per line: provenance (with ``run_id``, if there is one), outcome, the 21 clean source fields, score, tier and issues.

    A projection ends where its columns are used more than once, so that nothing is computed twice. Write the
    result before filtering on it: a filter would be pushed down through all projections.
    """
    columns = _projections(lines)
    records = decode_lines(lines).withColumns(columns["opened"]).drop("raw", "record")
    for step in ("kinds", "texts", "stripped", "folded", "clean", "summary", "tier"):
        records = records.withColumns(columns[step])
    run = [name for name in ("run_id",) if name in lines.columns]
    return records.select(
        *LINE_COLUMNS, *run, "outcome", "logged_external_id", *SOURCE_FIELDS, "completeness_score", "issues", "quality_tier"
    )


def _needs_unicode() -> Column:
    """Whether any text that enters the record's fingerprint needs NFKC."""
    content = needs_unicode_normalization(F.col("title")) | needs_unicode_normalization(F.col("body"))
    others = F.lit(False)
    for name in TEXT_FIELDS:
        if name not in ("title", "body"):
            others = others | needs_unicode_normalization(F.col(name))
    in_tags = F.exists("tags", needs_unicode_normalization)
    whole_record = F.col("body").isNull() & F.col("doi").isNull()
    return (F.col("outcome") == "accepted") & (content | (whole_record & (others | in_tags)))


def _fingerprint_steps(text_form, list_form, when: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Canonical title and body, then the fingerprint that counts: of the content if there is a body, of the
    whole record if there is no DOI either."""
    has_body = F.col("body").isNotNull()

    def canonical_field(name: str) -> Column:
        if name == "tags":
            return F.array_sort(list_form(F.col("tags")))
        return text_form(F.col(name)) if name in TEXT_FIELDS else F.col(name)

    forms = {
        f"canonical_{name}": F.when(has_body & when, text_form(F.col(name))) for name in ("title", "body")
    }
    fingerprint = F.when(
        has_body & when, content_fingerprint(F.col("canonical_title"), F.col("canonical_body"))
    ).when(~has_body & F.col("doi").isNull() & when, record_fingerprint(canonical_field))
    return forms, {"content_fingerprint": fingerprint}


def _fingerprint_expressions() -> dict[str, dict[str, Column]]:
    ready = (F.col("outcome") == "accepted") & ~F.col("needs_unicode")
    forms, fingerprint = _fingerprint_steps(canonical, lambda tags: F.transform(tags, canonical), ready)
    return {
        "marked": {"needs_unicode": F.coalesce(_needs_unicode(), F.lit(False))},
        "forms": forms,
        "fingerprint": fingerprint,
    }


def fingerprint_records(records: DataFrame) -> DataFrame:
    """Fingerprints by built-in functions; records that need NFKC are only marked ``needs_unicode``."""
    columns = _projections(records)
    for step in ("marked", "forms", "fingerprint"):
        records = records.withColumns(columns[step])
    return records.drop("canonical_title", "canonical_body")


def unicode_fingerprints(records: DataFrame, *others: str) -> DataFrame:
    """Fingerprints of the marked records only, through Arrow: line_order, other columns, doi, content_fingerprint."""
    marked = records.where("needs_unicode").select("line_order", *others, *RECORD_FIELDS)
    forms, fingerprint = _fingerprint_steps(unicode_canonical(), unicode_canonical_list(), F.lit(True))
    return marked.withColumns(forms).withColumns(fingerprint).select("line_order", *others, "doi", "content_fingerprint")


def record_keys(records: DataFrame, *others: str) -> DataFrame:
    """The narrow rows duplicates are found by: line_order, other columns that are asked for, doi, content_fingerprint.

    All accepted records are there, those that ``fingerprint_records`` only marked with the fingerprint it left out.
    """
    ready = records.where("outcome = 'accepted' AND NOT needs_unicode")
    ready = ready.select("line_order", *others, "doi", "content_fingerprint")
    return ready.unionByName(unicode_fingerprints(records, *others))
