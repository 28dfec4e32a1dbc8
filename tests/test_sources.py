"""Line files and the landing folder: no line and no file may be missing without a word."""

from __future__ import annotations

import json
import os
import time

import pytest

from docsift.plans.intake import intake
from docsift.sources import schema
from docsift.sources.lines import read_lines
from docsift.streaming.landing import import_landing_folder, land_lines

NAMES = "source_name_with_[brackets]*{and}?marks.jsonl"


def record(number):
    return json.dumps({"title": f"Survey of well {number}", "body": f"Depth {number} m, measured twice."}) + "\n"


def test_lines_do_not_depend_on_how_the_scan_is_split(spark, workspace, tmp_path):
    (tmp_path / "wells.jsonl").write_text("".join(record(n) for n in range(5_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        lines = read_lines(spark, str(tmp_path / "wells.jsonl"), workspace)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        numbers = sorted(row.source_line for row in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert numbers == list(range(1, 5_001))


def test_names_that_spark_reads_as_patterns(spark, tmp_path, store):
    (tmp_path / NAMES).write_text(record(1) + record(2))
    assert intake(spark, str(tmp_path / NAMES), store).inserted == 2


@pytest.mark.parametrize("name", ["_hidden.jsonl", ".hidden.ndjson"])
def test_hidden_files_are_refused(spark, tmp_path, store, name):
    (tmp_path / name).write_text(record(1))
    (tmp_path / "seen.jsonl").write_text(record(2))
    for path, folder in ((tmp_path / name, False), (tmp_path, True)):
        with pytest.raises(ValueError, match="hidden"):
            intake(spark, str(path), store, folder=folder)
    assert store.runs().isEmpty()


def test_files_with_old_time_stamps_are_imported(spark, tmp_path, store):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "first.jsonl").write_text(record(1))
    import_landing_folder(spark, str(folder), store, str(tmp_path / "stream")).awaitTermination()
    (folder / "late.jsonl").write_text(record(2))
    month_ago = time.time() - 30 * 86_400
    os.utime(folder / "late.jsonl", (month_ago, month_ago))
    import_landing_folder(spark, str(folder), store, str(tmp_path / "stream")).awaitTermination()
    assert store.table("documents").count() == 2


def test_many_small_files_are_one_batch(spark, tmp_path, store):
    lines = spark.range(1_100).selectExpr("id", "concat('{\"title\":\"Well ', id, '\"}') AS raw")
    landed = land_lines(lines.repartitionById(1_100, lines["id"].cast("int")), str(tmp_path / "landing"), "wells.jsonl")
    assert len(landed) == 1_100
    import_landing_folder(spark, str(tmp_path / "landing"), store, str(tmp_path / "stream")).awaitTermination()
    assert list(store.state()["batches"].values()) == [0]
    runs = store.runs().orderBy("id").select("processed", "source").collect()
    assert [(run.processed, run.source) for run in runs] == [(1, name) for name in landed]


def test_a_failed_run_leaves_no_rows_behind(spark, tmp_path, store):
    (tmp_path / "long.jsonl").write_text(json.dumps({"title": "Well 3", "external_id": "x" * 300}) + "\n")
    with pytest.raises(RuntimeError):
        intake(spark, str(tmp_path / "long.jsonl"), store)
    left = {name: os.listdir(f"{store.path}/{name}") for name in schema.TABLES if os.path.exists(f"{store.path}/{name}")}
    assert [name for name, segments in left.items() if segments] == ["ingestion_runs"]
    assert store.runs().first().status == "failed"


def test_a_refused_import_discards_what_was_written_beside_the_check(spark, tmp_path, store, monkeypatch):
    """Statistics are written while constraints are checked, so they may be there first."""
    from docsift.plans import intake as plan

    check = plan._check

    def late(new, known):
        if known:
            deadline = time.time() + 60
            while time.time() < deadline and not all(os.path.exists(f"{store.path}/{n}") for n in ("statistics", "score_blocks")):
                time.sleep(0.1)
        check(new, known)

    monkeypatch.setattr(plan, "_check", late)
    (tmp_path / "long.jsonl").write_text(json.dumps({"title": "Well 3", "external_id": "x" * 300}) + "\n")
    with pytest.raises(RuntimeError):
        intake(spark, str(tmp_path / "long.jsonl"), store)
    assert [name for name in ("statistics", "score_blocks", "documents") if os.listdir(f"{store.path}/{name}")] == []
