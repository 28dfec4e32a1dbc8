"""The import of line files into the store: one run for all lines or one for each file, published by one log entry."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields
from datetime import UTC, datetime
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.dedup import resolve_duplicates
from docsift.operators.entities import (
    ENTITY_TABLES, Entities, foreign_keys, mentioned_names, resolve_entities, tag_links,
)
from docsift.operators.hot_join import BROADCAST_BYTES, BROADCAST_ROWS, small_enough
from docsift.operators.normalize import fingerprint_records, normalize_lines, record_keys
from docsift.operators.numbering import number_rows
from docsift.operators.quality import violations
from docsift.operators.stored_keys import key_table, stored_with_keys_of
from docsift.plans.stats import partial_statistics, score_blocks
from docsift.session import Workspace, side_by_side
from docsift.sources.lines import read_lines
from docsift.sources.store import DocumentStore, Segment

# Fixed names: the counters of a run.
COUNTERS = ("processed", "inserted", "already_imported", "skipped", "warnings")


class ConstraintViolation(Exception):
    """New rows break a constraint of the stored tables. ``run_id`` is the first run with such a row, if it is known."""

    def __init__(self, message: str, run_id: int | None) -> None:
        super().__init__(message)
        self.run_id = run_id


@dataclass(frozen=True)
class RunSummary:
    run_id: int
    status: str
    processed: int
    inserted: int
    already_imported: int
    skipped: int
    warnings: int


@dataclass
class Loaded:
    """What an attempt has written: segments that nobody sees yet."""

    segments: dict[str, Segment]
    totals: dict[str, int]


def count_outcomes(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """run_id and the counters of every run that has lines."""
    decided = records.select("run_id", "line_order", "outcome", F.size("issues").alias("issues")).join(
        decisions.select("line_order", "id", "existing_id"), "line_order", "left"
    )
    return decided.groupBy("run_id").agg(
        F.count("*").alias("processed"),
        F.count("id").alias("inserted"),
        F.count("existing_id").alias("already_imported"),
        F.count_if(F.col("outcome") != "accepted").alias("skipped"),
        (F.sum("issues") + F.count("existing_id")).alias("warnings"),
    )


def issue_rows(records: DataFrame, decisions: DataFrame, last_id: int, workspace: Workspace) -> DataFrame:
    """Every issue with its provenance; a duplicate's issue comes after those of its fields."""
    duplicates = decisions.where("existing_id IS NOT NULL").select("line_order", "existing_id", "reason")
    counted = (
        records.select("line_order", F.size("issues").alias("field_issues"))
        .join(duplicates, "line_order", "left")
        .withColumn("issue_count", F.col("field_issues") + F.col("existing_id").isNotNull().cast("int"))
        .where("issue_count > 0")
        .select("line_order", "issue_count", "existing_id", "reason")
    )
    numbered = number_rows(counted, ["line_order"], "issues_before", workspace, weight="issue_count")
    duplicate = F.struct(
        F.lit("document").alias("field"), "reason", F.col("existing_id").cast("string").alias("value_preview")
    )
    all_issues = F.when(F.col("existing_id").isNotNull(), F.concat("issues", F.array(duplicate))).otherwise(
        F.col("issues")
    )
    return (
        records.select("run_id", "line_order", "source_file", "source_line", "logged_external_id", "issues")
        .join(numbered, "line_order")
        .select(
            "run_id", "issues_before", "source_file", "source_line", F.col("logged_external_id").alias("external_id"),
            F.posexplode(all_issues).alias("place", "issue"),
        )
        .select(
            (F.col("issues_before") + F.col("place") + 1 + last_id).alias("id"),
            F.col("run_id").alias("ingestion_run_id"),
            "source_file", "source_line", "external_id", "issue.field", "issue.reason",
            F.lit("warning").alias("severity"),
            "issue.value_preview",
        )
    )


def settle(records: DataFrame, store: DocumentStore, workspace: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The records' keys, the stored documents that share one, and the decision on each record: written tables."""
    keys = workspace.write(record_keys(records), "keys")
    stored = stored_with_keys_of(keys, store, workspace)
    decisions = resolve_duplicates(keys, stored, store.total("documents"), workspace)
    return keys, stored, workspace.write(decisions, "decisions")


def settle_names(records: DataFrame, kept: DataFrame, store: DocumentStore, workspace: Workspace) -> Entities:
    """The names that kept records mention, looked up in those files of the stored names that may hold them."""
    named = records.where("outcome = 'accepted'").select("line_order", "author_name", "organization_name", "tags")
    mentions, names = mentioned_names(named.join(kept, "line_order"), workspace)

    def known(kind: str, table: str) -> DataFrame:
        asked = workspace.write(names.where(F.col("kind") == kind).select("name"), f"asked-{table}", measure=True)
        return store.probe(table, asked, workspace).select(F.lit(kind).alias("kind"), "name", F.col("id").alias("entity_id"))

    stored = {kind: table for kind, table in ENTITY_TABLES.items() if store.total(table)}
    nothing = store.spark.createDataFrame([], "kind string, name string, entity_id bigint")
    found = reduce(DataFrame.unionByName, side_by_side([partial(known, *pair) for pair in stored.items()]), nothing)
    last_ids = {kind: store.total(table) for kind, table in ENTITY_TABLES.items()}
    return resolve_entities(mentions, names, found, last_ids, workspace)


def _load(records: DataFrame, store: DocumentStore, workspace: Workspace, found: Callable[[DataFrame], None],
          single_run: int | None) -> Loaded:
    """Write all tables of normalised records, then check them. ``found`` is told the counters as soon as they are known.

    The texts are read once more; everything is decided on narrow rows, and the texts are shuffled once, by their place in
    the import order, when their ids are attached. Of the stored tables only what shares a key with a new row is read.
    What does not depend on each other runs side by side.
    """
    keys, stored, decisions = settle(records, store, workspace)
    outcomes = workspace.write(count_outcomes(records, decisions), "outcomes")
    found(outcomes)
    counted = outcomes.agg(F.sum("inserted").alias("documents"), F.sum("warnings").alias("issues")).first()
    totals = {"documents": counted.documents or 0, "issues": counted.issues or 0}
    with ThreadPoolExecutor(1) as pool:
        issues = pool.submit(issue_rows, records, decisions, store.total("issues"), workspace)
        if totals["documents"]:
            written, entities, names = _kept_rows(records, keys, decisions, store, workspace, single_run)
        else:
            written, entities, names = {}, None, None
        written["ingestion_issues"] = issues.result()
    segments = store.write_all(written)
    try:
        new = {name: store.written(name, segment) for name, segment in segments.items()}
        if entities is None:
            _check(new, {})
            return Loaded(segments, totals)
        known = {
            table: entities.known_names.where(F.col("kind") == kind).withColumnRenamed("entity_id", "id")
            for kind, table in ENTITY_TABLES.items()
        }

        def add(table: str, rows: DataFrame) -> None:
            segments[table] = store.write(table, rows)

        # All of them have ended when one of them has failed, so what they wrote is among the segments to discard.
        *_, by_kind = side_by_side([
            lambda: _check(new, {**known, "documents": stored}),
            lambda: add("statistics", partial_statistics(new["documents"], entities)),
            lambda: add("score_blocks", score_blocks(new["documents"], store)),
            lambda: {row["kind"]: row["count"] for row in names.groupBy("kind").count().collect()},
        ])
    except Exception:
        store.discard(segments)
        raise
    totals |= {table: by_kind.get(kind, 0) for kind, table in ENTITY_TABLES.items()}
    return Loaded(segments, totals)


def _kept_rows(records: DataFrame, keys: DataFrame, decisions: DataFrame, store: DocumentStore, workspace: Workspace,
               single_run: int | None) -> tuple[dict[str, DataFrame], Entities, DataFrame]:
    """What kept records bring to the tables, the names they mention, and those of them that are new."""
    kept = decisions.where("id IS NOT NULL").select("line_order", "id")
    entities = settle_names(records, kept, store, workspace)
    attached = workspace.write(
        kept.join(keys.select("line_order", "content_fingerprint"), "line_order").join(
            foreign_keys(entities.links), "id", "left"
        ),
        "attached", measure=True,
    )
    # Few kept records find their texts without a shuffle.
    few = small_enough(attached, BROADCAST_ROWS, BROADCAST_BYTES, workspace)
    texts = records.where("outcome = 'accepted'").drop("content_fingerprint")
    by_line = texts.join(F.broadcast(attached), "line_order") if few else _in_parts(texts, store).join(
        _in_parts(attached, store), ["part", "line_order"]
    )
    runs = None
    if single_run is None:
        runs = records.select("line_order", "run_id").join(kept, "line_order").select("id", "run_id")
        runs = workspace.write(runs, "runs-of-documents")

    def with_run(rows: DataFrame, document: str) -> DataFrame:
        if runs is None:
            return rows.withColumn("run_id", F.lit(single_run))
        return rows.join(runs.withColumnRenamed("id", document), document)

    names = with_run(entities.new_names, "first_id").withColumnRenamed("entity_id", "id")
    written = {
        "documents": by_line,
        "document_tags": with_run(tag_links(entities.links), "document_id"),
        "document_keys": key_table(kept.join(keys, "line_order")),
    }
    written |= {table: names.where(F.col("kind") == kind) for kind, table in ENTITY_TABLES.items()}
    return written, entities, names


def _in_parts(rows: DataFrame, store: DocumentStore) -> DataFrame:
    """Rows shuffled by parts of the import order, so that documents of a block of ids meet in few tasks."""
    part = F.floor(F.col("line_order") / F.lit(store.block_ids)).cast("bigint")
    return rows.withColumn("part", part).repartition("part")


def _check(new: dict[str, DataFrame], known: dict[str, DataFrame]) -> None:
    """Constraints of the new rows among themselves and against the stored rows that share a key or name with them."""
    broken = violations({name: rows for name, rows in new.items() if name != "document_keys"}, known)
    first = broken.orderBy(F.asc_nulls_first("run_id"), "check_name").first()
    if first is not None:
        raise ConstraintViolation(f"{first.check_name}: {first.row_key}", first.run_id)


class Import:
    """An import at work: the runs it has claimed, and what is known of them."""

    def __init__(self, store: DocumentStore, workspace: Workspace, started_at: datetime, batch_key: str | None) -> None:
        self.store, self.workspace, self.started_at, self.batch_key = store, workspace, started_at, batch_key
        self.base = store.snapshot()
        self.failed: list[DataFrame] = []
        self.outcomes: DataFrame | None = None

    def run_rows(self, outcomes: DataFrame, status: str, reason: str | None = None) -> DataFrame:
        """Rows of ``ingestion_runs`` from run_id, source and counters."""
        return outcomes.select(
            F.col("run_id").alias("id"), F.lit(status).alias("status"), F.lit(self.started_at).alias("started_at"),
            F.lit(datetime.now(UTC)).alias("ended_at"), "processed",
            (F.col("inserted") if status == "completed" else F.lit(0).cast("bigint")).alias("inserted"),
            "already_imported", "skipped", "warnings", F.lit(reason).alias("failure_reason"), "source",
            F.lit(self.batch_key).alias("batch_key"),
        )

    def load(self, records: DataFrame, sources: DataFrame, single_run: int | None) -> Loaded:
        """Load the records, of a single run or of several.

        Of several, one whose rows break a constraint fails by itself, and the others are settled without it.
        As every run is settled after those before it, only the first one that breaks something is known to do so.
        """

        def found(outcomes: DataFrame) -> None:
            counted = sources.join(outcomes, "run_id", "left")
            self.outcomes = counted.na.fill(0, list(COUNTERS))

        while True:
            try:
                return _load(records, self.base, self.workspace, found, single_run)
            except ConstraintViolation as error:
                if error.run_id is None or single_run is not None:
                    raise
                broken = F.col("run_id") == error.run_id
                row = self.run_rows(self.outcomes.where(broken), "failed", type(error).__name__)
                self.failed.append(self.workspace.write(row, "failed-run"))
                sources, records = sources.where(~broken), records.where(~broken)

    def publish(self, loaded: Loaded, last_run: int) -> DataFrame:
        """One log entry for all runs; returns their rows."""
        rows = self.run_rows(self.outcomes, "completed")
        for failed in self.failed:
            rows = rows.unionByName(failed)
        runs = self.store.write("ingestion_runs", rows)
        self.store.commit(
            loaded.segments | {"ingestion_runs": runs}, loaded.totals, last_run, self.base.state(), self.batch_key
        )
        return self.store.written("ingestion_runs", runs)

    def record_failure(self, first_run: int, last_run: int, source: str | None, error: Exception) -> None:
        """One row for an import that failed as a whole, with the counters known so far; nothing else gets visible."""
        known = {name: 0 for name in COUNTERS}
        if self.outcomes is not None:
            known |= self.outcomes.agg(*[F.sum(name).alias(name) for name in COUNTERS]).first().asDict()
        schema = "run_id bigint, source string, " + ", ".join(f"{name} bigint" for name in COUNTERS)
        counted = self.store.spark.createDataFrame([(first_run, source, *known.values())], schema)
        row = self.run_rows(counted, "failed", type(error).__name__)
        self.store.commit({"ingestion_runs": self.store.write("ingestion_runs", row)}, {}, last_run, None)


def _run(open_lines: Callable[[Workspace], DataFrame], store: DocumentStore, source: str | None, per_file: bool = False,
         batch_key: str | None = None) -> DataFrame:
    """Import lines as one run, or as one for each file that has lines; returns the rows of ``ingestion_runs``.

    The number of jobs does not depend on the number of files, but for files that break a constraint.
    """
    started_at = datetime.now(UTC)
    with Workspace(store.spark) as workspace:
        # A refused path is the caller's mistake, not a failed run.
        lines = open_lines(workspace)
        many, files = 1, store.spark.createDataFrame([(0, source)], "file_number bigint, source string")
        if per_file:
            found = lines.select("file_number", F.col("source_file").alias("source")).distinct()
            found = workspace.write(found, "files", measure=True)
            if workspace.measured(found)[0]:
                many, files = workspace.measured(found)[0], found
        first_run = store.claim_runs(many)
        sources = files.select((first_run + F.col("file_number")).alias("run_id"), "source")
        work = Import(store, workspace, started_at, batch_key)
        try:
            number = F.col("file_number") if per_file else F.lit(0)
            records = fingerprint_records(normalize_lines(lines.withColumn("run_id", (first_run + number).cast("bigint"))))
            records = workspace.write(records, "records")
            loaded = work.load(records, sources, None if per_file else first_run)
            try:
                rows = work.publish(loaded, first_run + many - 1)
            except Exception:
                store.discard(loaded.segments)
                raise
        except Exception as error:
            work.record_failure(first_run, first_run + many - 1, source, error)
            raise RuntimeError("ingestion failed") from error
    store.compact()
    return rows


def _summary(rows: DataFrame) -> RunSummary:
    row = rows.withColumnRenamed("id", "run_id").first()
    return RunSummary(**{field.name: row[field.name] for field in fields(RunSummary)})


def intake_lines(
    lines: DataFrame, store: DocumentStore, source: str | None = None, batch_key: str | None = None
) -> RunSummary:
    """Import a frame of source_file, source_line, line_order and raw as one run."""
    return _summary(_run(lambda workspace: lines, store, source, batch_key=batch_key))


def intake(spark: SparkSession, path: str, store: DocumentStore, folder: bool = False) -> RunSummary:
    """Import one line file, or with ``folder=True`` all line files of a folder, as one run."""
    return _summary(_run(lambda workspace: read_lines(spark, path, workspace, folder), store, path))


def intake_files(
    open_lines: Callable[[Workspace], DataFrame], store: DocumentStore, batch_key: str | None = None
) -> DataFrame:
    """Import each file as a run of its own, all in one pass; returns their rows of ``ingestion_runs``.

    ``open_lines`` gives source_file, source_line, line_order, file_number (from 0, in the order of lines) and raw. The
    result equals that of importing one file after the other: records of earlier files come first, and a file
    that breaks a constraint fails alone. A file without lines has no run; without any lines there is one empty run.
    """
    return _run(open_lines, store, None, per_file=True, batch_key=batch_key)
