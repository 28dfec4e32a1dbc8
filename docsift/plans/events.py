"""The events of import runs, derived from their issues and run rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.sources.store import DocumentStore

SKIPPED_LINES = ("blank_line", "invalid_json")
NOT_INSERTED = ("record_is_not_object", "missing_required_title")


def run_events(store: DocumentStore) -> DataFrame:
    """(run_id, phase, issue_id, step, event, payload): sort by the first four for the order of a run's events.

    ``payload`` is the event as JSON. Duplicates have no event of their own. A failed run has only its start and
    its failure, because its issues were never published.
    """
    store = store.snapshot()
    keep_nulls = {"ignoreNullFields": "false"}
    issues = store.table("ingestion_issues").where("field <> 'document'")
    skipped_line = (F.col("field") == "record") & F.col("reason").isin(*SKIPPED_LINES)
    where = [F.col("source_file").alias("file"), F.col("source_line").alias("line")]

    def event(step: int, name: str, *fields):
        payload = F.to_json(F.struct(F.lit(name).alias("event"), *fields), keep_nulls)
        return F.struct(F.lit(step).alias("step"), F.lit(name).alias("event"), payload.alias("payload"))

    per_issue = F.array(
        F.when(skipped_line, event(0, "record_skipped", *where, F.col("reason"))).otherwise(
            event(0, "record_warning", *where, F.col("field"), F.col("reason"))
        ),
        F.when(
            F.col("reason").isin(*NOT_INSERTED),
            event(
                1, "document_not_inserted", *where, F.col("external_id"),
                F.lit(None).cast("string").alias("title"), F.col("reason"),
            ),
        ),
    )
    line_events = issues.select(
        F.col("ingestion_run_id").alias("run_id"), F.lit(1).alias("phase"), F.col("id").alias("issue_id"),
        F.inline(F.array_compact(per_issue)),
    )
    counters = [F.col(name) for name in ("status", "processed", "inserted", "already_imported", "skipped", "warnings")]
    run_id = F.col("id").alias("run_id")
    done = F.col("status") == "completed"
    per_run = F.array(
        F.struct(F.lit(0).alias("phase"), event(0, "ingestion_started", F.col("source").alias("input_file")).alias("e")),
        F.when(done, F.struct(
            F.lit(2).alias("phase"),
            event(0, "scoring_completed", run_id, F.col("inserted").alias("scored_documents")).alias("e"))),
        F.when(done, F.struct(
            F.lit(2).alias("phase"), event(1, "ingestion_completed", run_id, *counters).alias("e"))),
        F.when(~done, F.struct(
            F.lit(2).alias("phase"),
            event(0, "ingestion_failed", run_id, F.col("failure_reason").alias("reason")).alias("e"))),
    )
    run_rows = store.runs().select(run_id, F.inline(F.array_compact(per_run))).select(
        "run_id", "phase", F.lit(0).cast("bigint").alias("issue_id"), "e.*"
    )
    return line_events.unionByName(run_rows)


def write_events(store: DocumentStore, path: str) -> None:
    """The events as text files of JSON lines, in order within and across files."""
    ordered = run_events(store).orderBy("run_id", "phase", "issue_id", "step")
    ordered.select("payload").write.text(path)
