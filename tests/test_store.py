"""The store: publishing by a log, look-ups that read what they need, merging, many files in one pass."""

from __future__ import annotations

import json
import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from docsift.operators.quality import constraint_report
from docsift.operators.stored_keys import documents_of, key_table, stored_with_keys_of
from docsift.plans import intake as intake_module
from docsift.plans.intake import intake_lines
from docsift.plans.review import filter_documents, get_document, list_documents
from docsift.plans.stats import score_blocks, statistics, statistics_row
from docsift.session import Workspace, shared_folder
from docsift.sources import schema
from docsift.sources.log import CommitLog
from docsift.sources.store import DocumentStore, key_prefix, runs_of
from docsift.streaming.landing import import_landing_folder, land_lines

STORED = "id bigint, doi string, content_fingerprint string"


def files_of(frame):
    return [path.removeprefix("file://") for path in frame.inputFiles()]


def test_an_entry_has_one_writer(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.last() == (0, None)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda writer: log.append(1, {"writer": writer}), range(8)))
    assert won.count(True) == 1
    assert log.last() == (1, {"writer": won.index(True)})
    assert log.append(2, {"writer": 9}) and not log.append(2, {"writer": 10})
    (tmp_path / "log" / "_last").write_text("7")  # a note that cannot be true, one that is cut off, and none
    assert log.last()[0] == 2
    for note in ("", "1"):
        (tmp_path / "log" / "_last").write_text(note)
        assert log.last() == (2, {"writer": 9})
    first = [log.claim("claims", 1, many) for many in (3, 1, 2)]
    assert first == [1, 4, 5] and log.claim("claims", 4, 1) == 7


@pytest.mark.parametrize("point", ["settle", "settle_names", "_check", "publish"])
def test_two_imports_at_once_publish_one(spark, store, lines_of, monkeypatch, point):
    """The second import runs as a whole at some point of the first one, from its start to just before its entry."""
    intake_lines(lines_of({"title": "Stored", "body": "Before both."}), store)
    lines = lines_of({"title": "Overlap", "body": "Same words.", "tags": ["a"]}, {"title": "Stored", "body": "Before both."})
    inner = []

    def overtaken(function):
        def call(*arguments, **named):
            if not inner:
                inner.append(None)
                inner[0] = intake_lines(lines, store)
            return function(*arguments, **named)

        return call

    owner = intake_module.Import if point == "publish" else intake_module
    monkeypatch.setattr(owner, point, overtaken(getattr(owner, point)))
    view = store.snapshot()
    with pytest.raises(RuntimeError, match="ingestion failed"):
        intake_lines(lines, store)
    assert (inner[0].run_id, inner[0].inserted, inner[0].already_imported) == (3, 1, 1)
    assert [(r.id, r.status, r.failure_reason) for r in store.runs().orderBy("id").collect()] == [
        (1, "completed", None), (2, "failed", "ConcurrentImport"), (3, "completed", None)]
    assert sorted(r.id for r in store.table("documents").collect()) == [1, 2] and view.table("documents").count() == 1
    assert constraint_report(store.tables()).where("violations > 0").isEmpty()
    folders = {name: len(os.listdir(f"{store.path}/{name}")) for name in ("documents", "document_keys", "statistics")}
    assert folders == {"documents": 2, "document_keys": 2, "statistics": 2}


def test_a_failed_run_between_does_not_stop_an_import(spark, store, lines_of, monkeypatch):
    load, failed = intake_module._load, []

    def with_failure(*arguments):
        loaded = load(*arguments)
        if not failed:
            failed.append(True)
            with pytest.raises(RuntimeError):
                intake_lines(lines_of({"title": "Too long", "external_id": "x" * 300}), store)
        return loaded

    monkeypatch.setattr(intake_module, "_load", with_failure)
    assert intake_lines(lines_of({"title": "Goes on"}), store).inserted == 1
    assert [(r.id, r.status) for r in store.runs().orderBy("id").collect()] == [(1, "completed"), (2, "failed")]


@pytest.fixture(scope="module")
def many_runs(spark, tmp_path_factory):
    """A store of a hundred runs, each with 32 documents and dealt by two bits, that was never compacted."""
    store = DocumentStore(spark, str(tmp_path_factory.mktemp("many") / "store"), prefix_rows=16, merged_segments=100)
    for run in range(100):
        documents = spark.range(32 * run + 1, 32 * run + 33).select(
            "id", F.concat(F.lit("10.1/"), "id").alias("doi"), F.sha2(F.col("id").cast("string"), 256).alias("content_fingerprint")
        ).coalesce(1)
        segments = {"document_keys": store.write("document_keys", key_table(documents))}
        store.commit(segments, {"documents": 32}, run + 1, store.state())
    return store


def test_a_look_up_reads_the_asked_prefixes_only(spark, workspace, many_runs):
    segments = many_runs.segments("document_keys")
    assert len(segments) == 100 and {segment["bits"] for segment in segments} == {2}
    new = spark.createDataFrame(
        [("10.1/700", None), ("10.1/none", None), (None, None)], "doi string, content_fingerprint string"
    )
    found = stored_with_keys_of(new, many_runs, workspace)
    assert [row.id for row in found.collect()] == [700] and found.first().content_fingerprint is not None
    asked = workspace.write(spark.createDataFrame([("d10.1/700",), ("d10.1/none",)], "key string"), "asked")
    prefixes = {row.p for row in asked.select(key_prefix(F.col("key"), 2).alias("p")).collect()}
    probed = many_runs.probe("document_keys", asked, workspace)
    expected = {
        f"{many_runs.path}/{segment['path']}/prefix={prefix}"
        for segment in segments for prefix in segment["prefixes"] if prefix in prefixes
    }
    read = files_of(probed)
    assert {os.path.dirname(path) for path in read} == expected
    everything = files_of(many_runs.table("document_keys"))
    assert len(read) < 0.6 * len(everything)
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(key" in plan
    # Many keys are joined instead, and find the same.
    many = workspace.write(spark.range(1, 3201).select(F.concat(F.lit("d10.1/"), "id").alias("key")), "many")
    assert documents_of(many_runs.probe("document_keys", many, workspace)).count() == 3200


def test_merging_keeps_all_rows_and_old_views(spark, many_runs):
    before, rows = many_runs.snapshot(), sorted(many_runs.table("document_keys").collect())
    many_runs.prefix_rows = 1000
    assert many_runs.compact() == 100
    assert len(many_runs.segments("document_keys")) == 1
    assert len(files_of(many_runs.table("document_keys"))) < len(files_of(before.table("document_keys"))) / 10
    assert sorted(many_runs.table("document_keys").collect()) == rows == sorted(before.table("document_keys").collect())
    assert many_runs.state()["data_version"] == before.state()["data_version"]
    assert many_runs.compact() == 0


def test_imports_and_merging_by_turns(spark, tmp_path, lines_of, monkeypatch):
    """Four imports into a store that merges three segments at a time give what a store without merging has."""
    records = [
        [{"title": f"Note {n}", "body": f"Words of {n % 7} and {n // 2}", "author_name": f"A{n % 3}", "organization_name": f"O{n % 2}",
          "tags": [f"t{n % 4}", f"u{run}"], "status": "draft" if n % 2 else None, "doi": f"10.1000/{n}"} for n in range(3 * run, 3 * run + 5)]
        for run in range(4)
    ]
    plain = DocumentStore(spark, str(tmp_path / "plain"))
    merged = DocumentStore(spark, str(tmp_path / "merged"), prefix_rows=2, merged_segments=3)
    views = []
    for lines in records:
        summaries = [intake_lines(lines_of(*lines), store) for store in (plain, merged)]
        assert summaries[0] == summaries[1]
        views.append((merged.snapshot(), merged.table("documents").count()))
    assert len(merged.segments("documents")) == 2 and len(plain.segments("documents")) == 4
    for name in ("documents", "authors", "organizations", "tags", "document_tags", "ingestion_issues", "document_keys"):
        assert sorted(map(str, merged.table(name).collect())) == sorted(map(str, plain.table(name).collect()))
    assert [view.table("documents").count() for view, _ in views] == [count for _, count in views]
    page = list_documents(views[1][0], sort="score").items.collect()
    assert page == list_documents(views[1][0], sort="score").items.collect()
    assert get_document(merged, 5).first() == get_document(plain, 5).first()
    report = statistics(merged)
    assert all("/statistics/" in path for path in files_of(report))
    assert sorted(map(str, report.collect())) == sorted(map(str, statistics(plain).collect()))
    documents = merged.table("documents")
    row = statistics_row(merged).first()
    assert row.documents == documents.count() and row.tags == merged.table("tags").count()
    assert row.average_completeness_score == documents.agg(F.avg("completeness_score")).first()[0]
    assert row.statuses == {r[0]: r[1] for r in documents.groupBy(F.coalesce("status", F.lit("unknown"))).count().collect()}
    tagged = merged.table("document_tags").join(merged.table("tags").withColumnRenamed("id", "tag_id"), "tag_id")
    assert row.tags_by_document == {r["name"]: r["count"] for r in tagged.groupBy("name").count().collect()}


FILES = {
    "a.jsonl": [{"title": "One", "body": "Same."}, {"title": "Two", "doi": "10.2000/2", "tags": ["x"], "author_name": "Ann"}, "nope"],
    "b.jsonl": [{"title": "ONE", "body": "same."}, {"title": "Fits not", "external_id": "x" * 300}, {"title": "Three", "body": "Only if kept."}],
    "c.ndjson": [{"title": "three", "body": "only if KEPT."}, {"title": "Two again", "body": "Other.", "doi": "10.2000/2"}, ""],
    "d.jsonl": [{"title": "Four", "tags": ["y", "x"], "author_name": "Bea"}, {"title": "Too many", "word_count": 2**31}],
    "e.jsonl": [{"title": "Five", "author_name": "Bea"}, {"title": "THREE", "body": "only if kept."}],
}
RUN = ("id", "status", "processed", "inserted", "already_imported", "skipped", "warnings", "failure_reason")


def test_many_files_in_one_pass_equal_one_after_the_other(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    start = time.time() - 1000
    for place, (name, records) in enumerate(reversed(FILES.items())):
        # Names in order of landing backwards: files are taken in the order in which they landed.
        path = landing / f"{9 - place}-{name}"
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
        os.utime(path, (start - place, start - place))
    together, apart = DocumentStore(spark, str(tmp_path / "together")), DocumentStore(spark, str(tmp_path / "apart"))
    import_landing_folder(spark, str(landing), together, str(tmp_path / "s1")).awaitTermination()
    import_landing_folder(spark, str(landing), apart, str(tmp_path / "s2"), files_per_batch=1).awaitTermination()
    runs = [tuple(row) for row in together.runs().select(*RUN).orderBy("id").collect()]
    assert runs == [tuple(row) for row in apart.runs().select(*RUN).orderBy("id").collect()]
    assert [(run[1], run[3]) for run in runs] == [
        ("completed", 2), ("failed", 0), ("completed", 1), ("failed", 0), ("completed", 1)]
    for name in ("documents", "authors", "tags", "document_tags", "ingestion_issues", "document_keys"):
        assert sorted(map(str, together.table(name).collect())) == sorted(map(str, apart.table(name).collect()))
    assert sorted(map(str, statistics(together).collect())) == sorted(map(str, statistics(apart).collect()))
    assert (together.log.last()[0], apart.log.last()[0]) == (1, 5)


def test_jobs_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    written, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, frame, name, **options: (
        written.append(name), write(self, frame, name, **options))[1])
    counts = []
    for many in (2, 12):
        landing = tmp_path / f"landing-{many}"
        landing.mkdir()
        for n in range(many):
            (landing / f"{n:02d}.jsonl").write_text(json.dumps({"title": f"T{n}", "tags": [f"t{n}"], "doi": f"10.3000/{n}"}) + "\n")
        written.clear()
        store = DocumentStore(spark, str(tmp_path / f"store-{many}"))
        import_landing_folder(spark, str(landing), store, str(tmp_path / f"stream-{many}")).awaitTermination()
        assert [run.inserted for run in store.runs().collect()] == [1] * many
        counts.append(len(written))
    assert counts[0] == counts[1]


def test_tasks_do_not_grow_with_files(spark, tmp_path):
    """A hundred files are landed by a few tasks, in the order of their numbers, and no step of their import has a task a file."""
    many, tracker = 100, spark.sparkContext.statusTracker()
    landing, store = str(tmp_path / "landing"), DocumentStore(spark, str(tmp_path / "store"))

    def most_tasks(group):
        stages = [stage for job in tracker.getJobIdsForGroup(group) for stage in tracker.getJobInfo(job).stageIds]
        return max(info.numTasks for info in map(tracker.getStageInfo, stages) if info)

    lines = spark.range(0, 3 * many, 1, 8).select(
        "id", (F.col("id") % many).alias("file"), F.concat(F.lit('{"title":"T'), F.col("id"), F.lit('"}')).alias("raw"))
    spark.sparkContext.setJobGroup("landing", "")
    names = land_lines(lines.repartition(4, "file").sortWithinPartitions("file", "id"), landing, "feed.jsonl", by="file")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert most_tasks("landing") <= 8 and sorted(os.listdir(landing)) == sorted([*names, *(f".{n}.crc" for n in names)])
    for number, name in enumerate(names):
        found = (tmp_path / "landing" / name).read_text().splitlines()
        assert found == [f'{{"title":"T{n}"}}' for n in (number, number + many, number + 2 * many)]
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    query = import_landing_folder(spark, landing, store, str(tmp_path / "stream"))
    query.awaitTermination()
    assert most_tasks(str(query.runId)) < many
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    runs = store.runs().orderBy("id").collect()
    assert [run.source for run in runs] == names and {run.processed for run in runs} == {3}


@pytest.fixture(scope="module")
def paged(spark, tmp_path_factory):
    """Twelve documents of three scores in each of five segments, in blocks of eight ids; four segments were merged."""
    store = DocumentStore(spark, str(tmp_path_factory.mktemp("paged") / "store"), block_ids=8, merged_segments=4)
    for run in range(5):
        documents = spark.range(12 * run + 1, 12 * run + 13, 1, 2).select(
            "id", F.concat(F.lit("Title "), F.col("id") % 5).alias("title"), (F.hash("id") % 3 + 50).alias("completeness_score"),
            F.when(F.col("id") % 7 != 0, "draft").alias("status"), F.lit(None).cast("string").alias("body"),
        )
        missing = {name: F.lit(None).cast(kind) for name, kind in schema.columns("documents").items() if name not in documents.columns}
        documents = documents.withColumns(missing)
        links = documents.select(F.col("id").alias("document_id"), F.lit(1).alias("tag_id"), F.lit(0).alias("position"),
                                 F.lit(run + 1).alias("run_id")).where("document_id % 3 = 0")
        tables = {"documents": documents, "document_tags": links, "score_blocks": score_blocks(documents, store)}
        if run == 0:
            tables["tags"] = spark.createDataFrame([(1, "third", 1)], "id long, name string, run_id long")
        store.commit(store.write_all(tables), {"documents": 12}, run + 1, store.state())
        store.compact()
    return store


@pytest.mark.parametrize("sort", ["id", "score"])
@pytest.mark.parametrize("conditions", [{}, {"status": "draft"}, {"tag": "third", "q": "TITLE 1"}, {"q": "nowhere"}])
def test_pages_by_sorting_everything(paged, sort, conditions):
    rows = filter_documents(paged, **conditions).collect()
    rows.sort(key=lambda row: (-row.completeness_score if sort == "score" else 0, row.id))
    for page, size in ((2, 7), (3, 20), (60, 1), (10**9, 100)):
        found = list_documents(paged, page=page, page_size=size, sort=sort, **conditions)
        expected = [row.id for row in rows[(page - 1) * size : page * size]]
        assert [row.id for row in found.items.collect()] == expected and found.total == len(rows)


def test_a_page_and_a_document_read_their_blocks_only(spark, paged, monkeypatch):
    assert [segment["blocks"] for segment in paged.segments("documents")] == [[[0, 6]], [[6, 7]]]
    read, blocks = [], DocumentStore.blocks
    monkeypatch.setattr(DocumentStore, "blocks", lambda self, name, wanted: (
        read.append((name, sorted(wanted))), blocks(self, name, wanted))[1])
    monkeypatch.setattr(DocumentStore, "table", lambda self, name: self._read(name, [
        segment["path"] for segment in self.segments(name)]) if name != "documents" else pytest.fail("all documents read"))
    page = list_documents(paged, page=8, page_size=4)
    assert [row.id for row in page.items.collect()] == [29, 30, 31, 32]
    assert read == [("documents", [3, 4]), ("documents", [3, 4])]
    assert {os.path.basename(os.path.dirname(path)) for path in files_of(page.items)} == {"block=3", "block=4"}
    plan = page.items._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id" in plan
    read.clear()
    assert get_document(paged, 50).first().tags == [] and get_document(paged, 51).first().tags == ["third"]
    assert read == [("documents", [6]), ("document_tags", [6])] * 2
    assert len(files_of(paged.blocks("documents", {2}))) == 1 and paged.blocks("documents", {8}).isEmpty()
    assert get_document(paged, 61).isEmpty() and get_document(paged, -1).isEmpty()
    # A store keeps the size of blocks that it began with.
    assert DocumentStore(spark, paged.path).block_ids == 8


def test_numbers_in_runs():
    assert runs_of([]) == [] and runs_of([3]) == [[3, 3]] and runs_of([7, 1, 2, 9, 8]) == [[1, 2], [7, 9]]


def test_lists_leave_no_folder(spark, paged):
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    assert list_documents(paged, status="draft", sort="score").total
    assert set(os.listdir(folder)) == before
