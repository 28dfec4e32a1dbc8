"""Field rules, as one table of cases run as a single DataFrame."""

from __future__ import annotations

import datetime
import hashlib
import json
import unicodedata

import pytest

from docsift.operators.normalize import _projections, fingerprint_records, normalize_lines, record_keys

D = datetime.date
NUL, HIGH, LOW = "\x00before", "between \ud9ab words", "after\udc01"

TEXT_FIELDS = ("organization_name", "author_name", "source_name", "region", "external_id", "body", "abstract")
# What the rule for booleans takes.
BOOLEAN_WORDS = {True: ("1", "true", "yes"), False: ("0", "false", "no")}
BOOLEAN_VALUES = {True: ("true", "1"), False: ("false", "0"), None: ("null",)}
FORMS = (str, str.upper, str.capitalize, str.swapcase, lambda word: f"\u2003{word}\r\n")

# Field, given value, clean value, reason of the issue if any.
CASES = [
    *[(f, "\tOne tWo\n", "One tWo", None) for f in TEXT_FIELDS],
    *[("abstract", v, None, None) for v in ("", "   ", " 　\x1f", None)],
    *[("external_id", v, None, "invalid_text") for v in (31, True, [], {}, -0.25, [["deep"]])],
    *[(f, v, None, "placeholder_text") for f in ("author_name", "organization_name")
      for v in ("n/A\t", "\nNa", "NOT applicable")],
    ("region", "na", "na", None),
    *[(f, v, None, "unsafe_text") for f in TEXT_FIELDS for v in (NUL, HIGH, LOW)],
    ("abstract", "pair \U0001f600 ok", "pair \U0001f600 ok", None),
    ("published_at", "1999-12-31", D(1999, 12, 31), None),
    ("published_at", 19700101, D(1970, 1, 1), None),
    ("published_at", "\t20310704 ", D(2031, 7, 4), None),
    ("published_at", "2024-1-5", D(2024, 1, 5), None),
    ("published_at", "2024-01- 5", D(2024, 1, 5), None),
    ("published_at", "2024115", D(2024, 11, 5), None),
    ("published_at", "202411", D(2024, 1, 1), None),
    ("published_at", "2024110", D(2024, 1, 10), None),
    ("published_at", "2024-02-29", D(2024, 2, 29), None),
    *[("published_at", v, None, "invalid_date") for v in
      (None, "\t", "last May", "2022-00-10", 20220431, False, "2023-02-29", "0000-01-01", "2022-08-09T10:11", 2022.5,
       ["2022-08-09"], "2024-001-05", -20220809, "20241139", "24-01-01")],
    # Every word of the rule in every form, the JSON values it stands for, and none at all.
    *[("open_access", form(word), truth, None) for truth, words in BOOLEAN_WORDS.items() for word in words for form in FORMS],
    *[("peer_reviewed", json.loads(value), truth, None) for truth, values in BOOLEAN_VALUES.items() for value in values],
    *[("peer_reviewed", v, None, "invalid_boolean") for v in (10, "on", {}, 0.5, "", -1, 0.0)],
    *[(f, v, v, None) for f in ("citation_count", "page_count", "word_count") for v in (0, 407, None, 2**31, 2**63 - 1)],
    *[("page_count", v, None, "invalid_nonnegative_integer") for v in (-90, False, 0.75, "407", 2**64 + 1, 2**63, 3.0, [1])],
    ("status", "pubLISHED\t", "published", None), ("status", "Unknown", "unknown", None),
    ("status", "  ", None, None), ("status", None, None, None),
    *[("status", v, None, "invalid_status") for v in (True, "printed", 5, "draft.")],
    ("document_type", "\tField NOTES", "field notes", None), ("document_type", "Straße", "strasse", None),
    ("document_type", "ΣΊΣΥΦΟΣ", "σίσυφοσ", None), ("document_type", "Iı İ", "iı i̇", None),
    ("document_type", "", None, None), ("document_type", 3, None, "invalid_document_type"),
    ("document_type", NUL, None, "invalid_document_type"),
    ("language", "\tENGLish", "en", None), ("language", "FR", "fr", None), ("language", " ", None, None),
    ("language", "\nxX", None, "unknown_language"), ("language", "Elvish", "elvish", None),
    ("language", 5, None, "invalid_language"),
    *[("url", v, v.strip(), None) for v in
      ("https://reef.test/list?a=b", "HTTP://h", " http://exa_mple.org/x|y ", "http://:pw@host", "http://h:", "http://h:65535/",
       "http://h?q", "http://h#f", "https://[::1]:80/x", "http://[2001:db8::1%eth0]", "http://h:00080", "http://@h",
       "http://münchen.de/ä", "http://[1:2:3:4:5:6:7.8.9.10]")],
    *[("url", v, None, "invalid_url") for v in
      ("http://", "https://me:word@reef.test", "http://me@reef.test/x", "ftp://h", "h", "http:/h", "http://:80",
       "http://h:65536", "http://h:8x", "http://a b", "http://a b", "http://[::1", "http://[zz]", "http://[1.2.3.4]",
       "http://a@:x@h", "http://h：1/", 7, NUL, "http://[1::2::3]")],
    ("url", "", None, None),
    ("doi", "10.55555/Reef(3)_B", "10.55555/reef(3)_b", None), ("doi", " 10.123456789/X ", "10.123456789/x", None),
    *[("doi", v, None, "invalid_doi") for v in ("doi:10.5555/x", "11.5555/x", "10.123/x", "10.1234567890/x", "10.1234/", "10.1234/a b", 10.1)],
    ("doi", "10.1234/a b", None, "invalid_doi"),
    ("tags", [0.5, "REEF", None, "tide\t", "\nreef", " "], ["reef", "tide"], ["invalid_tag", "invalid_tag", "empty_tag"]),
    ("tags", "tide ,Deep Sea,TIDE", ["tide", "deep sea"], None),
    ("tags", "a,,b,", ["a", "b"], ["empty_tag", "empty_tag"]),
    ("tags", "", [], ["empty_tag"]),
    ("tags", None, [], None), ("tags", [], [], None),
    *[("tags", v, [], "invalid_tags") for v in (5, True, {"a": 1})],
    ("tags", ["Straße", "STRASSE", "b\x00", ["n"]], ["strasse"], ["invalid_tag", "invalid_tag"]),
]


@pytest.fixture(scope="module")
def case_results(spark):
    rows = []
    for place, (field, value, _, _) in enumerate(CASES):
        dates = {"published_at": "2024-01-01", "updated_at": "2024-01-01"}
        rows.append(("cases", place, place, json.dumps({**dates, "title": "Example", field: value, "version": 3})))
    lines = spark.createDataFrame(rows, "source_file string, source_line bigint, line_order bigint, raw string")
    return {row.source_line: row for row in normalize_lines(lines).collect()}


@pytest.mark.parametrize("place", range(len(CASES)), ids=lambda p: f"{CASES[p][0]}-{p}")
def test_field_rule(case_results, place):
    field, value, expected, reasons = CASES[place]
    row = case_results[place]
    assert row.outcome == "accepted"
    assert row[field] == expected
    reasons = [] if reasons is None else [reasons] if isinstance(reasons, str) else reasons
    assert [issue.reason for issue in row.issues if issue.field == field and issue.reason != "updated_before_published"] == reasons


LINES = [
    ("null", "record_is_not_object"), ("[{}]", "record_is_not_object"), ('"title"', "record_is_not_object"),
    ("-0.5", "record_is_not_object"), ("false", "record_is_not_object"), ("{}", "missing_required_title"),
    ('{"title":null}', "missing_required_title"), ('{"title":"\\n\\t"}', "missing_required_title"),
    ('{"title":["a"]}', "missing_required_title"), ('{"title":"a\\u0000"}', "missing_required_title"),
    ('{"title":"a\\ud800"}', "missing_required_title"), ('{"title":"a\\udfff"}', "missing_required_title"),
    ('{"title":"a\\ud83d\\ude00"}', "accepted"), ('{"title":"a\\\\ud800"}', "accepted"),
    ('{"title":"a\\ud800\\ud83d\\ude00"}', "missing_required_title"),
    ("", "blank_line"), (" \t\x0b\x0c\r", "blank_line"), (" ", "invalid_json"),
    ('{"title":"a",}', "invalid_json"), ('{"title":"a"} x', "invalid_json"), ('{"title":"a"}] x', "invalid_json"),
    ('{"title":"a"}} x', "invalid_json"), ('{"title":"a"} {"title":"b"}', "invalid_json"), ('{"title":"a"},1', "invalid_json"),
    ('{"title":"a","v":NaN}', "invalid_json"), ('{"title":"a","v":-Infinity}', "invalid_json"), ("{'title':'a'}", "invalid_json"),
    ('{"title":"a","v":01}', "invalid_json"), ('{"title":"a\x01"}', "invalid_json"), ('﻿{"title":"a"}', "invalid_json"),
    (' \t{"title":"a"} ', "accepted"), ('{"title":8,"title":"last wins"}', "accepted"),
    ('{"title":"a","v":1e400}', "accepted"), ('{"title":"a","v":123456789012345678901234567890123456789012}', "accepted"),
]


def test_line_outcomes(lines_of):
    rows = normalize_lines(lines_of(*[raw for raw, _ in LINES])).orderBy("source_line").collect()
    assert [(raw, row.outcome) for (raw, _), row in zip(LINES, rows, strict=True)] == LINES
    for row in rows:
        if row.outcome != "accepted":
            assert len(row.issues) == 1 and row.issues[0].reason == row.outcome
            assert row.title is None and row.completeness_score is None


def test_rejected_record_keeps_its_external_id(lines_of):
    rows = normalize_lines(lines_of({"external_id": "k/44\t", "title": []}, {"external_id": "y" * 256}, {"external_id": [3]}))
    assert [row.logged_external_id for row in rows.orderBy("source_line").collect()] == ["k/44", "y" * 255, None]


def test_previews_are_bounded_ascii_json_without_bodies(lines_of):
    nested = {"b": [1, "x,:y", 2.5], "a": 'é" ', "c": {"z": None}}
    records = [
        {"title": "t", "body": "\x00" + "not for others, " * 70, "external_id": {"long": "z" * 700}, "region": nested},
        {"title": "t", "region": [1, "\U0001f600", True], "source_name": 1.0, "status": "é\t" * 300, "url": "\x7f"},
    ]
    rows = normalize_lines(lines_of(*records)).orderBy("source_line").collect()
    shown = [{issue.field: issue.value_preview for issue in row.issues} for row in rows]

    def expected(value):
        return json.dumps(value, sort_keys=True)[:200]

    assert shown[0]["body"] == f"<body string length={len(records[0]['body'])}>"
    assert shown[0]["external_id"] == expected(records[0]["external_id"])
    assert shown[0]["region"] == expected(nested)
    for field in ("region", "source_name", "status", "url"):
        assert shown[1][field] == expected(records[1][field])
    assert all(len(text) <= 200 and text.isascii() for row in shown for text in row.values())


def test_issues_come_in_field_order(lines_of):
    record = {"title": "t", "word_count": -1, "tags": [1], "doi": "x", "author_name": 1, "published_at": "2024-01-02",
              "updated_at": "2024-01-01", "status": 1, "external_id": 1}
    row = normalize_lines(lines_of(record)).first()
    assert [(issue.field, issue.reason) for issue in row.issues] == [
        ("external_id", "invalid_text"), ("author_name", "invalid_text"), ("tags", "invalid_tag"),
        ("status", "invalid_status"), ("doi", "invalid_doi"), ("word_count", "invalid_nonnegative_integer"),
        ("updated_at", "updated_before_published"),
    ]


# What each field adds to the 25 points of the title; a URL and a DOI count once.
POINTS = {
    "body": ("b", 25), "abstract": ("a", 10), "published_at": ("2020-02-02", 10), "tags": ("t", 10), "author_name": ("n", 5),
    "organization_name": ("o", 5), "url": ("http://h", 10),
}
GIVEN = [
    *[(name,) for name in POINTS], (), tuple(POINTS), ("body", "abstract", "tags", "author_name"), ("body", "tags", "url", "published_at"),
    ("abstract", "published_at"), ("abstract", "published_at", "author_name"),
]


def tier_of(score):
    return "low" if score < 50 else "medium" if score < 80 else "high"


def test_completeness_scores(lines_of):
    records = [{"title": "t", **{name: POINTS[name][0] for name in names}} for names in GIVEN]
    scores = [25 + sum(POINTS[name][1] for name in names) for names in GIVEN]
    both = {"title": "t", "doi": "10.5555/x"}
    rows = normalize_lines(lines_of(*records, both, {**both, "url": "http://h"})).orderBy("source_line").collect()
    expected = [*scores, 35, 35]
    assert {50, 75, 80, 100} <= set(expected)
    assert [(row.completeness_score, row.quality_tier) for row in rows] == [(score, tier_of(score)) for score in expected]


def plain(text):
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


def hash_of_content(title, body):
    pieces = [plain(text).encode() for text in (title, body)]
    return hashlib.sha256(b"content-v1\0" + b"".join(len(p).to_bytes(8, "big") + p for p in pieces)).hexdigest()


FINGERPRINTED = [
    ("Low\u00a0Tide", "Crabs\t\n walk   sideways."), ("low TIDE", "crabs walk Sideways."),
    ("ﬁne Ⅷ", "ﬀ"), ("Straße", "STRASSE é́"), ("ΣΊΣΥΦΟΣ", "ς Σ"), ("İstanbul ı", "Ç ç"), ("한국어", "한"),
    ("日本語　テキスト", "ガ"), ("\x1f a \x1c b", "x y z"), ("Привет Мир", "Ёж й"), ("ᏣᎳᎩ ꭰ", "ẞ ſ K"),
    ("naïve Œuvre Ĳ", "½ µ ª"),
]


def test_content_fingerprints_follow_the_unicode_rules(lines_of, workspace):
    records = [{"title": title, "body": body} for title, body in FINGERPRINTED]
    written = workspace.write(fingerprint_records(normalize_lines(lines_of(*records))), "records")
    keys = {row.line_order: row.content_fingerprint for row in record_keys(written).collect()}
    assert [keys[place] for place in range(len(records))] == [
        hash_of_content(title.strip(), body.strip()) for title, body in FINGERPRINTED
    ]
    assert keys[0] == keys[1]
    # Most scripts go without the Arrow path.
    marked = {row.line_order for row in written.where("needs_unicode").collect()}
    assert marked and {0, 1, 9}.isdisjoint(marked)


def test_fingerprint_choice(lines_of, workspace):
    records = [
        {"external_id": "Reef 9", "title": "Low Tide", "status": "ARCHIVED", "tags": ["b", "a"]},
        {"external_id": "reef  9", "title": "\tlow  tide", "status": "archived", "tags": "A,b"},
        {"external_id": "reef 8", "title": "Low Tide", "status": "archived", "tags": ["a", "b"]},
        {"title": "T", "doi": "10.1234/x"},
        {"title": "ﬁ", "tags": ["ﬁ"], "open_access": True, "published_at": "2024-01-02", "page_count": 3},
    ]
    written = workspace.write(fingerprint_records(normalize_lines(lines_of(*records))), "records")
    keys = {row.line_order: row.content_fingerprint for row in record_keys(written).collect()}
    assert keys[0] == keys[1] != keys[2]
    assert keys[3] is None
    names = sorted(["external_id", "title", "abstract", "body", "published_at", "updated_at", "status", "document_type",
                    "language", "region", "source_name", "url", "doi", "open_access", "peer_reviewed", "citation_count",
                    "page_count", "word_count", "author_name", "organization_name", "tags"])
    whole = dict.fromkeys(names) | {"title": "fi", "tags": ["fi"], "open_access": True, "published_at": "2024-01-02", "page_count": 3}
    text = json.dumps(whole, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert keys[4] == hashlib.sha256(b"record-v1\0" + text.encode()).hexdigest()


def test_rules_take_stripped_and_folded_texts_from_columns(lines_of):
    """So a text is stripped and folded once, however often a rule looks at it; tags are texts of their own."""
    clean = {name: str(column) for name, column in _projections(lines_of("{}"))["clean"].items()}
    assert "trim(" in clean.pop("tags") and not [name for name, rule in clean.items() if "trim(text_" in rule]
    assert all(f"stripped_{name}" in clean[name] for name in ("title", "body", "url"))
    assert all(f"folded_{name}" in clean[name] for name in ("status", "doi", "open_access", "author_name"))
