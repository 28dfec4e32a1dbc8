"""Line files to stored tables: provenance, counters, idempotence, failure, streaming, reading back."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from docsift.operators.quality import constraint_report, violations
from docsift.plans import intake as intake_module
from docsift.plans.events import run_events, write_events
from docsift.plans.intake import intake, intake_lines
from docsift.plans.review import document_details, get_document, list_documents
from docsift.plans.stats import statistics, statistics_row
from docsift.sources.lines import input_files, read_lines
from docsift.streaming.landing import import_landing_folder, land_lines

# Lines 5 and 9 repeat line 2: by its words and by its DOI.
SAMPLE = [
    '{"title": "cut off',
    {"title": "Tidal lagoons", "body": "Walls hold the sea back.", "doi": "10.5555/Lagoon.7", "author_name": "Ines Duarte",
     "tags": ["coast", "Sea "], "published_at": "2021-06-30", "updated_at": "2021-07-02", "status": "archived"},
    "",
    ["a", "list"],
    {"title": "tidal  LAGOONS", "body": " walls hold the sea back.", "published_at": "2021-07-01", "updated_at": "2021-07-01"},
    {"title": "Peat", "organization_name": "Bog Trust", "tags": "coast, moor", "document_type": "Thesis",
     "published_at": 20200229, "updated_at": 20200301, "external_id": "p-6"},
    {"external_id": " q-7 ", "title": "   "},
    {"title": "Kelp 50%_off", "abstract": "Forests under water.", "body": "Kelp grows fast.", "author_name": "Ines Duarte",
     "organization_name": "n/a", "language": "FR", "status": "draft", "published_at": "2022-03-01", "updated_at": "2022-02-28",
     "page_count": -1},
    {"title": "Lagoon costs", "body": "Other words.", "doi": "10.5555/LAGOON.7", "published_at": "2021-08-01", "updated_at": "2021-08-01"},
    {"title": "Fog"},
]


def as_line(record):
    return record if isinstance(record, str) else json.dumps(record)


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    from docsift.sources.store import DocumentStore

    folder = tmp_path_factory.mktemp("sample")
    path = folder / "sample.jsonl"
    path.write_text("\n".join(map(as_line, SAMPLE)) + "\n", encoding="utf-8")
    store = DocumentStore(spark, str(folder / "store"))
    summary = intake(spark, str(path), store)
    return store, summary, path


def test_sample_summary_and_statistics(sample):
    store, summary, _ = sample
    assert (summary.processed, summary.inserted, summary.already_imported, summary.skipped, summary.warnings) == (10, 4, 2, 4, 11)
    row = statistics_row(store).first()
    assert (row.documents, row.authors, row.organizations, row.tags) == (4, 1, 1, 3)
    assert row.average_completeness_score == (85 + 50 + 75 + 25) / 4
    assert row.quality_tiers == {"low": 1, "medium": 2, "high": 1}
    assert row.statuses == {"archived": 1, "draft": 1, "unknown": 2}
    assert row.organizations_by_document == {"Bog Trust": 1}
    assert row.tags_by_document == {"coast": 2, "sea": 1, "moor": 1}


def test_sample_documents_and_issues(sample):
    store, _, _ = sample
    documents = store.table("documents").orderBy("id").collect()
    assert [(d.id, d.title, d.completeness_score, d.quality_tier) for d in documents] == [
        (1, "Tidal lagoons", 85, "high"), (2, "Peat", 50, "medium"), (3, "Kelp 50%_off", 75, "medium"), (4, "Fog", 25, "low")]
    assert documents[2].language == "fr" and documents[1].document_type == "thesis"
    issues = store.table("ingestion_issues").orderBy("id").collect()
    assert [(i.id, i.source_line, i.field, i.reason) for i in issues] == [(n + 1, *issue) for n, issue in enumerate([
        (1, "record", "invalid_json"), (3, "record", "blank_line"), (4, "record", "record_is_not_object"),
        (5, "document", "duplicate_document"), (7, "title", "missing_required_title"),
        (8, "organization_name", "placeholder_text"), (8, "page_count", "invalid_nonnegative_integer"),
        (8, "updated_at", "updated_before_published"), (9, "document", "duplicate_conflicting_content"),
        (10, "published_at", "invalid_date"), (10, "updated_at", "invalid_date")])]
    assert {issue.source_file for issue in issues} == {"sample.jsonl"}
    assert constraint_report(store.tables()).where("violations > 0").isEmpty()


def test_lists(sample):
    store, _, _ = sample

    def total(**conditions):
        return list_documents(store, **conditions).total

    assert total() == 4
    assert total(tag="Coast\t") == 2 and total(tag="\t") == 0 and total(tag="") == 4
    assert total(organization="Bog Trust") == 1 and total(organization="BOG TRUST") == 0
    assert total(status="DRAFT") == 1 and total(status="unknown") == 0
    assert total(date_from=date(2020, 3, 1), date_to=date(2021, 6, 30)) == 1
    assert total(date_from=date(2020, 2, 29), date_to=date(2021, 6, 30)) == 2
    assert total(q="50%_OFF") == 1 and total(q="_") == 1 and total(q="Sea Back") == 1
    # Abstracts are not searched.
    assert total(q="forests") == 0
    assert total(q="kelp", status="draft", date_to=date(2022, 3, 1)) == 1 and total(q="kelp", tag="coast") == 0
    page = list_documents(store, page=1, page_size=3, sort="score")
    assert [row.id for row in page.items.collect()] == [1, 3, 2] and page.total == 4
    assert [row.id for row in list_documents(store, page=2, page_size=3).items.collect()] == [4]
    assert list_documents(store, page=7).items.isEmpty()
    assert "document_tags" not in page.items._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("arguments", [
    {"page": 0}, {"page_size": 0}, {"page_size": 101}, {"sort": "title"}, {"date_from": date(2024, 2, 1), "date_to": date(2024, 1, 1)}])
def test_list_arguments_are_checked(sample, arguments):
    with pytest.raises(ValueError):
        list_documents(sample[0], **arguments)


def test_details(sample):
    store, _, _ = sample
    one = get_document(store, 1).first()
    assert (one.author_name, one.organization_name, one.tags) == ("Ines Duarte", None, ["coast", "sea"])
    assert get_document(store, 99).isEmpty()
    assert {row.id: row.tags for row in document_details(store).collect()} == {
        1: ["coast", "sea"], 2: ["coast", "moor"], 3: [], 4: []}


def test_events(sample, tmp_path):
    store, _, path = sample
    events = [json.loads(row.payload) for row in run_events(store).orderBy("run_id", "phase", "issue_id", "step").collect()]
    names = [event["event"] for event in events]
    assert names[0] == "ingestion_started" and names[-2:] == ["scoring_completed", "ingestion_completed"]
    assert events[0]["input_file"] == str(path)
    assert events[-1] == {"event": "ingestion_completed", "run_id": 1, "status": "completed", "processed": 10, "inserted": 4,
                          "already_imported": 2, "skipped": 4, "warnings": 11}
    assert names.count("record_skipped") == 2 and names.count("record_warning") == 7
    rejected = [event for event in events if event["event"] == "document_not_inserted"]
    assert [(event["line"], event["external_id"], event["reason"]) for event in rejected] == [
        (4, None, "record_is_not_object"), (7, "q-7", "missing_required_title")]
    assert all(event["file"] == "sample.jsonl" and event["title"] is None for event in rejected)
    write_events(store, str(tmp_path / "events"))
    written = [line for part in sorted((tmp_path / "events").glob("part-*")) for line in part.read_text().splitlines()]
    assert [json.loads(line) for line in written] == events


def test_second_import_adds_nothing_and_next_ids_follow(spark, store, lines_of):
    first = intake_lines(lines_of(*SAMPLE), store)
    second = intake_lines(lines_of(*SAMPLE), store)
    assert (second.inserted, second.already_imported, second.skipped) == (0, first.inserted + first.already_imported, 4)
    third = intake_lines(lines_of(
        {"title": "Peat again", "body": "Wet.", "author_name": "Ines Duarte", "organization_name": "Fen Society", "tags": ["fen", "moor"]},
        {"title": "KELP  50%_off", "body": "kelp grows FAST.", "doi": "10.5555/kelp"},
        {"title": "TIDAL lagoons", "body": "walls  hold the sea back.", "doi": "10.5555/other"}), store)
    assert (third.inserted, third.already_imported) == (1, 2)
    detail = get_document(store, 5).first()
    assert (detail.title, detail.author_name, detail.organization_name, detail.tags) == (
        "Peat again", "Ines Duarte", "Fen Society", ["fen", "moor"])
    assert store.table("authors").count() == 1 and store.table("organizations").count() == 2
    assert {row.name: row.id for row in store.table("tags").collect()} == {"coast": 1, "sea": 2, "moor": 3, "fen": 4}
    last = store.table("ingestion_issues").where("ingestion_run_id = 3 AND field = 'document'").orderBy("id").collect()
    assert [(i.reason, i.value_preview) for i in last] == [("duplicate_document", "3"), ("duplicate_conflicting_doi", "1")]
    ids = [row.id for row in store.table("ingestion_issues").orderBy("id").collect()]
    assert ids == list(range(1, len(ids) + 1))
    # A duplicate never enriches the stored document.
    assert get_document(store, 3).first().doi is None


def test_empty_store_and_empty_input(spark, store, lines_of):
    row = statistics_row(store).first()
    assert row.documents == 0 and row.average_completeness_score is None
    assert row.quality_tiers == {"low": 0, "medium": 0, "high": 0} and row.statuses == {}
    summary = intake_lines(lines_of("x").where("false"), store)
    assert summary.processed == summary.inserted == summary.warnings == 0
    assert statistics(store).where("metric = 'documents'").first().value == 0


def test_failed_run_shows_nothing_but_its_row(spark, store, lines_of, monkeypatch):
    with pytest.raises(RuntimeError, match="ingestion failed"):
        intake_lines(lines_of({"title": "First", "word_count": 2**31}, {"title": "Second"}), store)
    run = store.runs().first()
    assert (run.status, run.inserted, run.processed, run.failure_reason) == ("failed", 0, 2, "ConstraintViolation")
    assert store.table("documents").isEmpty() and store.table("ingestion_issues").isEmpty()

    def fail(*_):
        raise OSError("synthetic")

    with monkeypatch.context() as patch:
        patch.setattr(intake_module, "normalize_lines", fail)
        with pytest.raises(RuntimeError):
            intake_lines(lines_of({"title": "First"}), store)
    assert intake_lines(lines_of({"title": "First"}), store).inserted == 1
    assert [(r.id, r.status, r.failure_reason) for r in store.runs().orderBy("id").collect()] == [
        (1, "failed", "ConstraintViolation"), (2, "failed", "OSError"), (3, "completed", None)]
    assert get_document(store, 1).first().title == "First"
    events = [row.event for row in run_events(store).where("run_id = 2").orderBy("phase").collect()]
    assert events == ["ingestion_started", "ingestion_failed"]


def test_imports_at_once_take_different_ids_and_only_one_is_published(spark, store, lines_of, monkeypatch):
    lines = lines_of({"title": "Overlap"})
    load = intake_module._load

    def overtaken(*arguments):
        monkeypatch.setattr(intake_module, "_load", load)
        assert intake_lines(lines, store).run_id == 2
        return load(*arguments)

    monkeypatch.setattr(intake_module, "_load", overtaken)
    view = store.snapshot()
    with pytest.raises(RuntimeError, match="ingestion failed"):
        intake_lines(lines, store)
    runs = store.runs().orderBy("id").collect()
    assert [(run.id, run.status, run.failure_reason) for run in runs] == [
        (1, "failed", "ConcurrentImport"), (2, "completed", None)]
    assert (store.table("documents").count(), view.table("documents").count()) == (1, 0)


def test_constraint_violations_are_found(spark):
    documents = spark.createDataFrame(
        [(1, "10.1/a", "f", " ", -1, 50, "medium", 7), (2, "10.1/a", "f", "T" * 300, 2**31, 101, "top", None),
         (3, None, None, "t", None, 25, "low", 1)],
        "id long, doi string, content_fingerprint string, title string, page_count long, completeness_score int, "
        "quality_tier string, author_id long")
    for name in ("external_id", "status", "document_type", "language", "region", "source_name"):
        documents = documents.withColumn(name, F.lit("x" * 21))
    for name in ("citation_count", "word_count", "organization_id"):
        documents = documents.withColumn(name, F.lit(None).cast("long"))
    authors = spark.createDataFrame([(1, "Ann"), (2, "Ann")], "id long, name string")
    found = {(row.check_name, row.row_key) for row in violations({"documents": documents, "authors": authors}).collect()}
    expected = {
        ("documents_title_not_blank", "1"), ("documents_page_count_nonnegative", "1"), ("documents_page_count_fits_integer", "2"),
        ("documents_score_range", "2"), ("documents_quality_tier_valid", "2"), ("documents_doi_unique", "10.1/a"),
        ("documents_content_fingerprint_unique", "f"), ("authors_name_unique", "Ann"), ("documents_author_id_references", "7"),
        *{(f"documents_{name}_length", str(n)) for name in ("status", "language") for n in (1, 2, 3)},
    }
    assert found == expected


def test_lines_of_several_files_split_small(spark, workspace, tmp_path):
    contents = {
        "b.jsonl": b"".join(b'{"n":%d}\r\n' % n for n in range(3_000)),
        "A.NdJson": b"x\ry\n\n\xff\xfe\nlast",
        "empty.jsonl": b"",
        "ignored.txt": b"no\n",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, str(tmp_path), workspace, folder=True).orderBy("line_order").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [row.line_order for row in rows] == list(range(3_004))
    assert [(row.source_file, row.source_line) for row in rows[:4]] == [("A.NdJson", n) for n in (1, 2, 3, 4)]
    assert rows[0].raw == "x\ry" and rows[1].raw == "" and rows[3].raw == "last"
    assert [(row.source_line, row.raw) for row in rows[4:]] == [(n + 1, f'{{"n":{n}}}') for n in range(3_000)]


def test_input_must_be_a_line_file(spark, tmp_path, store):
    (tmp_path / "records.txt").write_text("{}\n")
    for path in (tmp_path, tmp_path / "records.txt", tmp_path / "missing.jsonl"):
        with pytest.raises(ValueError, match="file"):
            intake(spark, str(path), store)
    with pytest.raises(ValueError):
        input_files(spark, str(tmp_path), folder=True)
    assert store.runs().isEmpty()


def test_invalid_utf8_is_invalid_json(spark, tmp_path, store):
    (tmp_path / "bad.jsonl").write_bytes(b'{"title":"\xff\xfe"}\n{"title":"good"}\n')
    summary = intake(spark, str(tmp_path / "bad.jsonl"), store)
    assert (summary.inserted, summary.skipped) == (1, 1)
    issue = store.table("ingestion_issues").where("source_line = 1").first()
    assert (issue.reason, issue.value_preview) == ("invalid_json", "<invalid utf-8>")


def test_landing_folder_is_one_run_per_file_and_never_imports_twice(spark, tmp_path, store, lines_of):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    with pytest.raises(ValueError):
        land_lines(lines_of("{}"), landing, "records.txt")
    first = land_lines(lines_of({"title": "a", "body": "1"}, {"title": "b", "body": "2"}).coalesce(1), landing, "first.jsonl")
    land_lines(lines_of({"title": "A", "body": "1"}, "nope").coalesce(1), landing, "second.ndjson")
    assert len(first) == 1 and first[0].endswith("_first.jsonl")
    import_landing_folder(spark, landing, store, checkpoint).awaitTermination()
    runs = store.runs().orderBy("id").collect()
    assert [run.processed for run in runs] == [2, 2] and sum(run.inserted for run in runs) == 2
    land_lines(lines_of({"title": "c", "body": "3"}).coalesce(1), landing, "third.jsonl")
    import_landing_folder(spark, landing, store, checkpoint).awaitTermination()
    assert [run.inserted for run in store.runs().orderBy("id").collect()][2:] == [1]
    assert store.has_batch(f"{checkpoint}#1") and not store.has_batch(f"{checkpoint}#2")
