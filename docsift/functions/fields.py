"""Per-field rules: each takes one JSON field and gives the clean value and, where due, an issue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions.json_values import kind_of, text_of
from docsift.functions.preview import preview, preview_body, preview_text
from docsift.functions.text import casefold, contains_nul, strip

# Fixed values of the intake rules.
PLACEHOLDERS = ("n/a", "na", "not applicable")
TRUE_WORDS = ("true", "yes", "1")
FALSE_WORDS = ("false", "no", "0")
STATUSES = ("published", "draft", "archived", "unknown")
DOI_PATTERN = r"^10\.\p{Nd}{4,9}/[^" + "\\s\\x0b\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000" + r"]+$"
# Characters whose compatibility form holds one of / ? # @ : and so would move the end of a host name.
URL_DELIMITER_LOOKALIKES = (
    "\u2047\u2048\u2049\u2100\u2101\u2105\u2106\u2a74\ufe13\ufe16"
    "\ufe55\ufe56\ufe5f\ufe6b\uff03\uff0f\uff1a\uff1f\uff20"
)


@dataclass(frozen=True)
class JsonField:
    """One field of the decoded record: its VARIANT value, its type name, its text if it is a string.

    ``stripped`` is the text without whitespace at its ends, ``folded`` that text case-folded. Rules use them many times, so
    they are best columns of an earlier projection.
    """

    name: str
    value: Column
    kind: Column
    text: Column
    stripped: Column
    folded: Column

    @classmethod
    def of(cls, name: str, value: Column) -> JsonField:
        stripped = strip(text_of(value))
        return cls(name, value, kind_of(value), text_of(value), stripped, casefold(stripped))

    @cached_property
    def absent(self) -> Column:
        return self.kind.isNull() | (self.kind == "VOID")

    @cached_property
    def is_text(self) -> Column:
        return F.coalesce(self.kind == "STRING", F.lit(False))

    @cached_property
    def blank(self) -> Column:
        return self.absent | (self.is_text & (self.stripped == ""))

    @cached_property
    def safe_text(self) -> Column:
        return self.is_text & ~F.coalesce(contains_nul(self.text), F.lit(False))

    def issue(self, reason: str) -> Column:
        shown = F.when(self.is_text, preview_body(self.text)) if self.name == "body" else None
        return raw_issue(self.name, reason, self.value, self.kind, shown)


@dataclass(frozen=True)
class Rule:
    """A field's clean value, and the issues to report given the column that holds that value.

    The two are apart so that the value is computed once, in one projection, and the issues in the next.
    """

    value: Column
    issues: Callable[[Column], Column]


def raw_issue(field: str, reason: str, value: Column | None, kind: Column | None, shown: Column | None = None) -> Column:
    """An issue with the value itself; rendered by issue_list, or given as text in ``shown``."""

    def typed(column: Column | None, type_name: str) -> Column:
        return F.lit(None).cast(type_name) if column is None else column

    return F.struct(
        F.lit(field).alias("field"), F.lit(reason).alias("reason"), typed(value, "variant").alias("value"),
        typed(kind, "string").alias("kind"), typed(shown, "string").alias("shown"),
    )


def issue_list(raw_issues: Column) -> Column:
    """The issues that are not null, each with its value as a bounded preview."""

    def render(issue: Column) -> Column:
        shown = F.coalesce(issue.shown, preview(issue.value, issue.kind))
        return F.struct(
            issue.field.alias("field"), issue.reason.alias("reason"), shown.alias("value_preview")
        )

    return F.transform(F.array_compact(raw_issues), render)


def optional_text(field: JsonField) -> Rule:
    return Rule(
        F.when(field.safe_text & (field.stripped != ""), field.stripped),
        lambda value: F.when(field.absent | value.isNotNull(), None)
        .when(~field.is_text, field.issue("invalid_text"))
        .when(~field.safe_text, field.issue("unsafe_text")),
    )


def name_text(field: JsonField) -> Rule:
    """Optional text that also refuses placeholders such as N/A."""
    plain = optional_text(field)
    placeholder = F.coalesce(field.folded.isin(*PLACEHOLDERS), F.lit(False))
    return Rule(
        F.when(~placeholder, plain.value),
        lambda value: F.when(value.isNull() & placeholder, field.issue("placeholder_text")).otherwise(
            plain.issues(value)
        ),
    )


# Years have four digits; months and days may lack the leading zero, and a day may have a space instead.
_MONTH, _DAY = r"(1[0-2]|0[1-9]|[1-9])", r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"
_DASHED, _COMPACT = rf"^(\d{{4}})-{_MONTH}-{_DAY}$", rf"^(\d{{4}}){_MONTH}{_DAY}$"


def calendar_date(field: JsonField) -> Rule:
    """A date as YYYY-MM-DD or YYYYMMDD text or integer. Unlike other fields, absence is an issue too."""
    integer = F.try_variant_get(field.value, "$", "bigint").cast("string")
    given = F.when(field.kind == "BIGINT", integer).when(field.is_text, field.stripped)

    def by(pattern: str) -> Column:
        parts = [F.trim(F.regexp_extract(given, pattern, group)) for group in (1, 2, 3)]
        return F.when(given.rlike(pattern) & (parts[0] != "0000"), F.concat_ws("-", *parts).try_cast("date"))

    value = F.coalesce(by(_DASHED), by(_COMPACT))
    return Rule(value, lambda value: F.when(value.isNull(), field.issue("invalid_date")))


def boolean(field: JsonField) -> Rule:
    word = field.folded
    integer = F.when(field.kind == "BIGINT", F.try_variant_get(field.value, "$", "bigint"))
    value = (
        F.when(field.kind == "BOOLEAN", F.try_variant_get(field.value, "$", "boolean"))
        .when((integer == 1) | word.isin(*TRUE_WORDS), F.lit(True))
        .when((integer == 0) | word.isin(*FALSE_WORDS), F.lit(False))
    )
    return Rule(value, lambda value: F.when(~field.absent & value.isNull(), field.issue("invalid_boolean")))


def tag_items(field: JsonField) -> Column:
    """The tag candidates as structs of type name, text, and VARIANT value (null for pieces of a string)."""

    def listed(item: Column) -> Column:
        return F.struct(
            F.coalesce(kind_of(item), F.lit("VOID")).alias("kind"),
            text_of(item).alias("text"),
            item.alias("value"),
        )

    def piece(text: Column) -> Column:
        return F.struct(
            F.lit("STRING").alias("kind"), text.alias("text"), F.lit(None).cast("variant").alias("value")
        )

    return F.when(
        field.kind.startswith("ARRAY"),
        F.transform(F.try_variant_get(field.value, "$", "array<variant>"), listed),
    ).when(field.is_text, F.transform(F.split(field.text, ",", -1), piece))


def tag_list(field: JsonField, items: Column) -> Rule:
    """Tags from a list of strings or a comma-separated string, folded, first occurrence kept."""

    def usable(item: Column) -> Column:
        return (item.kind == "STRING") & ~F.coalesce(contains_nul(item.text), F.lit(False))

    def clean(item: Column) -> Column:
        return F.when(usable(item), strip(item.text))

    def item_issue(item: Column) -> Column:
        shown = F.when(item.value.isNull() & (item.kind == "STRING"), preview_text(item.text))
        return F.when(~usable(item), raw_issue(field.name, "invalid_tag", item.value, item.kind, shown)).when(
            strip(item.text) == "", raw_issue(field.name, "empty_tag", item.value, item.kind, shown)
        )

    # Folded apart, as folding reads a text more than once.
    folded = F.transform(F.transform(items, clean), casefold)
    tags = F.array_distinct(F.filter(folded, lambda tag: tag != ""))
    return Rule(
        F.coalesce(tags, F.array().cast("array<string>")),
        lambda _: F.when(items.isNotNull(), F.transform(items, item_issue)).otherwise(
            F.array(F.when(~field.absent, field.issue("invalid_tags")))
        ),
    )


def count(field: JsonField) -> Rule:
    """A JSON integer of at least zero that fits 64 bits; larger ones have another type name."""
    integer = F.when(field.kind == "BIGINT", F.try_variant_get(field.value, "$", "bigint"))
    value = F.when(integer >= 0, integer)
    return Rule(value, lambda value: F.when(~field.absent & value.isNull(), field.issue("invalid_nonnegative_integer")))


def _folded(field: JsonField, accept: Callable[[Column], Column], reason: str, safe: bool = True) -> Rule:
    text = field.folded
    usable = field.safe_text if safe else field.is_text
    value = F.when(~field.blank & usable & accept(text), text)
    return Rule(value, lambda value: F.when(value.isNull() & ~field.blank, field.issue(reason)))


def status(field: JsonField) -> Rule:
    return _folded(field, lambda text: text.isin(*STATUSES), "invalid_status", safe=False)


def document_type(field: JsonField) -> Rule:
    return _folded(field, lambda text: F.lit(True), "invalid_document_type")


def doi(field: JsonField) -> Rule:
    return _folded(field, lambda text: text.rlike(DOI_PATTERN), "invalid_doi")


def language(field: JsonField) -> Rule:
    plain = _folded(field, lambda text: text != "xx", "invalid_language")
    unknown = field.safe_text & (field.folded == "xx")
    return Rule(
        F.when(plain.value == "english", "en").otherwise(plain.value),
        lambda value: F.when(value.isNull() & unknown, field.issue("unknown_language")).otherwise(
            plain.issues(value)
        ),
    )


def _ipv6_pattern() -> str:
    """The IPv6address rule of RFC 3986, with an optional zone."""
    group = "[0-9A-Fa-f]{1,4}"
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    last = rf"(?:{group}:{group}|(?:{octet}\.){{3}}{octet})"
    forms = [f"(?:{group}:){{6}}{last}", f"::(?:{group}:){{5}}{last}"]
    for before in range(1, 8):
        head = f"(?:(?:{group}:){{0,{before - 1}}}{group})?::"
        after = 5 - before
        tail = f"(?:{group}:){{{after}}}{last}" if after >= 0 else group if after == -1 else ""
        forms.append(head + tail)
    return "(?:" + "|".join(forms) + ")(?:%[^%]+)?"


_PORT = r"0*(?:\d{1,4}|[1-5]\d{4}|6[0-4]\d{3}|65[0-4]\d{2}|655[0-2]\d|6553[0-5])"
_HOST = (
    rf"(?:[^/?#@:\[\]{URL_DELIMITER_LOOKALIKES}]+"
    rf"|[^/?#@:\[\]]*\[(?:{_ipv6_pattern()}|v[0-9A-Fa-f]+\.[^\]/?#]+)\][^:/?#@\[\]]*)"
)
# Scheme, an optional user part that names no user, host, optional port, then the rest or the end.
URL_PATTERN = (
    r"^[\x01-\x08\x0e-\x1b]*(?i:https?)://"
    rf"(?:(?::[^/?#\[\]{URL_DELIMITER_LOOKALIKES}]*)?@)?{_HOST}(?::(?:{_PORT})?)?(?:[/?#]|$)"
)
_ANY_WHITESPACE = "[\\t-\\r\\x1c-\\x20\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def url(field: JsonField) -> Rule:
    """An http(s) URL with a host and without a user name, kept as written."""
    text = field.stripped
    valid = field.safe_text & ~text.rlike(_ANY_WHITESPACE) & text.rlike(URL_PATTERN)
    value = F.when(~field.blank & valid, text)
    return Rule(value, lambda value: F.when(value.isNull() & ~field.blank, field.issue("invalid_url")))


def completeness_score(doc: dict[str, Column]) -> Column:
    """Points for the metadata present; the title is always there."""

    def points(number: int, present: Column) -> Column:
        return F.when(present, number).otherwise(0)

    return (
        F.lit(25)
        + points(25, doc["body"].isNotNull())
        + points(10, doc["abstract"].isNotNull())
        + points(10, doc["published_at"].isNotNull())
        + points(10, F.size(doc["tags"]) > 0)
        + points(5, doc["author_name"].isNotNull())
        + points(5, doc["organization_name"].isNotNull())
        + points(10, doc["url"].isNotNull() | doc["doi"].isNotNull())
    )


def quality_tier(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 50, "medium").otherwise("low")
