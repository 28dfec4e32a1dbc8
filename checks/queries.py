"""The driver queries: each operator over the whole noisy feed, or over the store the feed was imported into."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.feed import feed_lines, feed_records, quoted, spread, table
from docsift.functions import fields as rules
from docsift.functions.fingerprint import content_fingerprint
from docsift.functions.json_values import decode, decoded_value, text_of
from docsift.operators.dedup import resolve_duplicates
from docsift.operators.normalize import decode_lines, fingerprint_records, normalize_lines, record_keys
from docsift.operators.numbering import number_rows
from docsift.operators.quality import constraint_report
from docsift.plans.events import run_events
from docsift.plans.intake import intake_lines
from docsift.plans.review import document_details, filter_documents, list_documents, page_of
from docsift.plans.stats import statistics
from docsift.session import Workspace, prepare, shared_folder
from docsift.sources.lines import read_lines
from docsift.sources.store import DocumentStore
from docsift.streaming.landing import import_landing_folder, land_lines

Query = Callable[[SparkSession, str], DataFrame]
LINE = ("source_file", "source_line")
RUN = ("status", "processed", "inserted", "already_imported", "skipped", "warnings")
LISTS = {
    "list_by_date": {"date_from": date(2020, 3, 1), "date_to": date(2021, 6, 30)},
    "list_by_tag": {"tag": " EN "},
    "list_by_organization": {"organization": " src7 "},
    "list_by_status": {"status": "Published"},
    "list_by_text": {"q": "TION"},
}


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@cache
def _imported(application: str, sf_dir: str) -> DocumentStore:
    spark = SparkSession.active()
    store = DocumentStore(spark, fresh_folder(spark, "store"))
    intake_lines(feed_lines(spark, sf_dir), store, source="feed")
    return store


def imported(spark: SparkSession, sf_dir: str) -> DocumentStore:
    """The store after one import of the feed; later queries of the same session read the same store."""
    return _imported(spark.sparkContext.applicationId, sf_dir)


@cache
def _fingerprinted(application: str, sf_dir: str) -> DataFrame:
    spark = SparkSession.active()
    return Workspace(spark).write(fingerprint_records(normalize_lines(feed_lines(spark, sf_dir))), "records")


def fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised feed with fingerprints, as a written table."""
    return _fingerprinted(spark.sparkContext.applicationId, sf_dir)


def normalized(*columns: str, accepted_only: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if accepted_only:
            return fingerprinted(spark, sf_dir).where("outcome = 'accepted'").select(*LINE, *columns)
        return normalize_lines(feed_lines(spark, sf_dir)).select(*LINE, *columns)

    return query


def stored(name: str, *columns: str) -> Query:
    return lambda spark, sf_dir: imported(spark, sf_dir).table(name).select(*columns)


def as_text(*names: str) -> dict[str, F.Column]:
    return {name: F.col(name).cast("string") for name in names}


def shown_items(items: DataFrame) -> DataFrame:
    return items.withColumns(as_text("published_at"))


def line_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_lines(feed_lines(spark, sf_dir)).select(
        *LINE, "outcome", F.col("logged_external_id").alias("external_id")
    )


def landed_feed(spark: SparkSession, sf_dir: str) -> str:
    """The feed as line files in import order, several files if there are several partitions."""
    folder = fresh_folder(spark, "landing")
    ordered = feed_lines(spark, sf_dir).repartitionByRange("line_order").sortWithinPartitions("line_order")
    land_lines(ordered, folder, "feed.jsonl")
    return folder


def scan_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_lines(spark, landed_feed(spark, sf_dir), Workspace(spark), folder=True)
    return normalize_lines(lines).select(
        "line_order", "outcome", F.col("logged_external_id").alias("external_id")
    )


def norm_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized("published_at", "updated_at")(spark, sf_dir).withColumns(as_text("published_at", "updated_at"))


def norm_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized("tags", accepted_only=True)(spark, sf_dir).withColumn("tags", F.array_join("tags", "|"))


def props_json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed decoding and the count rule on the events' JSON properties."""
    prepare(spark)
    decoded = table(spark, sf_dir, "events").select("event_type", decode(F.col("props")).alias("decoded"))
    number = decoded.select(
        "event_type", F.try_variant_get(decoded_value(F.col("decoded")), "$.k", "variant").alias("number")
    )
    rule = rules.count(rules.JsonField.of("k", F.col("number")))
    checked = number.select("event_type", (F.schema_of_variant("number") == "BIGINT").alias("is_integer"),
                            rule.value.alias("value"))
    return checked.groupBy("event_type", "is_integer").agg(
        F.count("*").alias("events"), F.sum("value").alias("total")
    )


def long_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a line with a property name, a number and a nesting near or beyond the parser's usual limits."""
    prepare(spark)
    head = "".join(('{"', "k" * 51_000, '":1,"n":', "7" * 1_100, ',"deep":', "[" * 900, "]" * 900, ",", '"text":'))
    lines = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.concat(F.lit(head), quoted(F.coalesce("text", F.lit(""))), F.lit("}")).alias("raw")
    )
    # Columns of their own, so that a line is decoded once and its text taken once.
    decoded = lines.select("doc_id", decode(F.col("raw")).alias("decoded"))
    value = decoded.select("doc_id", F.try_variant_get(decoded_value(F.col("decoded")), "$.text", "variant").alias("value"))
    return value.select("doc_id", text_of(F.col("value")).alias("text")).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest")
    )


def dedup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one chain: each shares its content with one neighbour and its DOI with the other."""
    workspace = Workspace(spark)
    numbered = number_rows(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "n", workspace)
    records = workspace.write(
        numbered.select(
            "doc_id", F.col("n").alias("line_order"), F.expr("concat('c', (n + 1) div 2)").alias("doi"),
            F.expr("concat('g', n div 2)").alias("content_fingerprint"),
        ),
        "chain",
    )
    nothing_stored = spark.createDataFrame([], "id bigint, doi string, content_fingerprint string")
    decided = resolve_duplicates(records.drop("doc_id"), nothing_stored, 0, workspace)
    return records.select("doc_id", "line_order").join(decided, "line_order").select(
        "doc_id", F.col("id").isNotNull().alias("kept"), "existing_id", "reason"
    )


def page_url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL rule on every page; a kept URL is the given one."""
    prepare(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.to_json(F.struct("url")).alias("line"))
    valued = pages.withColumn("value", F.try_variant_get(F.try_parse_json("line"), "$.url", "variant"))
    rule = rules.url(rules.JsonField.of("url", F.col("value")))
    return valued.select("page_id", rule.value.alias("kept"), F.col("url").alias("given")).select(
        "page_id", F.col("kept").alias("url"), F.coalesce(F.col("kept") == F.col("given"), F.lit(True)).alias("same")
    )


def fingerprints_where(condition: str) -> Query:
    """The fingerprints of all accepted lines of a kind, also of those whose texts need NFKC."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = record_keys(fingerprinted(spark, sf_dir).where(condition), *LINE)
        return keys.select(*LINE, "content_fingerprint")

    return query


def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        record_keys(fingerprinted(spark, sf_dir))
        .where("content_fingerprint IS NOT NULL")
        .groupBy("content_fingerprint")
        .agg(F.count("*").alias("copies"))
        .where("copies > 1")
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every accepted line of the feed with the decision on it, against an empty store."""
    workspace = Workspace(spark)
    records = fingerprinted(spark, sf_dir)
    keys = workspace.write(record_keys(records), "keys")
    nothing = spark.createDataFrame([], "id bigint, doi string, content_fingerprint string")
    decided = workspace.write(resolve_duplicates(keys, nothing, 0, workspace), "decisions")
    return records.select("line_order", *LINE).join(decided, "line_order")


def dedup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).where("id IS NOT NULL").select("id", *LINE)


def dedup_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).where("id IS NULL").select(*LINE, "existing_id", "reason")


def date_order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = imported(spark, sf_dir).table("ingestion_issues")
    return issues.where("reason = 'updated_before_published'").select(*LINE, "value_preview")


def issues_by_field_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = imported(spark, sf_dir).table("ingestion_issues")
    return issues.groupBy("field", "reason").agg(F.count("*").alias("issues"))


def listed(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown_items(list_documents(imported(spark, sf_dir), **LISTS[name]).items)

    return query


def list_page_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = imported(spark, sf_dir).snapshot()
    return shown_items(
        page_of(store, lambda blocks: filter_documents(store, blocks=blocks).where("status IS NOT NULL"), 2, 20, "score").items
    )


def list_far_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of all documents, found by the sums that the imports have left."""
    return shown_items(list_documents(imported(spark, sf_dir), page=3, sort="score").items)


def list_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = imported(spark, sf_dir)
    filters = {
        "date": LISTS["list_by_date"], "tag": LISTS["list_by_tag"], "status": {"status": "unknown"},
        "literal": {"q": "100%_"}, "percent": {"q": "%"},
    }
    totals = [
        filter_documents(store, **conditions).agg(F.count("*").alias("total")).select(F.lit(name).alias("filter"), "total")
        for name, conditions in filters.items()
    ]
    return reduce(DataFrame.unionByName, totals)


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_details(imported(spark, sf_dir)).withColumns(
        {**as_text("published_at", "updated_at"), "tags": F.array_join("tags", "|")}
    )


def statistic(*metrics: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        report = statistics(imported(spark, sf_dir)).withColumn("value", F.round("value", 9))
        return report.where(F.col("metric").isin(*metrics)) if metrics else report

    return query


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_events(imported(spark, sf_dir)).drop("run_id")


def reimport_adds_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = DocumentStore(spark, fresh_folder(spark, "store"))
    lines = Workspace(spark).write(feed_lines(spark, sf_dir), "lines")  # made once, imported twice
    intake_lines(lines, store)
    second = intake_lines(lines, store)
    return store.runs().where(F.col("id") == second.run_id).select(*RUN[:-1])


def landing_stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed landed as many small files, of a hundred document numbers each, and imported in one pass: a run a file."""
    lines = feed_lines(spark, sf_dir)
    part = (F.col("source_line") / 100).cast("int")
    last = feed_records(spark, sf_dir).agg(F.max("doc_id").alias("line")).first().line
    per_file = last // 100 + 1
    order = F.array_position(F.array(*[F.lit(f"part-{n}") for n in (0, 1, 2, 9)]), F.col("source_file")) - 1
    numbered = lines.withColumn("file", (order * per_file + part).cast("int"))
    folder = fresh_folder(spark, "landing")
    land_lines(spread(numbered, "file").sortWithinPartitions("file", "line_order"), folder, "feed.jsonl", by="file")
    store = DocumentStore(spark, fresh_folder(spark, "store"))
    import_landing_folder(spark, folder, store, fresh_folder(spark, "stream")).awaitTermination()
    return store.runs().select(*RUN)


def broken_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over the imported tables with every kind of constraint broken on purpose, by arithmetic on the ids."""
    tables, far = imported(spark, sf_dir).tables(), 1_000_000

    def changed(name: str, column: str, divisor: int, rest: int, value, key: str = "id") -> None:
        new = F.when(F.col(key) % divisor == rest, value).otherwise(F.col(column))
        tables[name] = tables[name].withColumn(column, new)

    tags = tables["document_tags"]
    tables["document_tags"] = tags.unionByName(tags.where("document_id % 29 = 0"))
    for column, divisor, rest, value in (
        ("title", 7, 0, F.lit("  ")), ("citation_count", 11, 0, F.lit(-1)), ("page_count", 11, 1, F.lit(2**31)),
        ("completeness_score", 13, 0, F.lit(101)), ("quality_tier", 13, 1, F.lit("top")),
        ("doi", 17, 0, F.lit("10.1/same")), ("content_fingerprint", 17, 1, F.lit("same")),
        ("author_id", 19, 0, F.col("id") + far), ("organization_id", 19, 1, F.col("id") + far),
        ("region", 23, 0, F.lit("r" * 256)),
    ):
        changed("documents", column, divisor, rest, value)
    for name, divisor in (("authors", 5), ("organizations", 3), ("tags", 2)):
        changed(name, "name", divisor, 0, F.lit("Everyone"))
    changed("document_tags", "tag_id", 31, 0, F.col("tag_id") + far, "document_id")
    changed("document_tags", "document_id", 37, 0, F.col("document_id") + far, "document_id")
    changed("ingestion_issues", "ingestion_run_id", 41, 0, F.lit(99))
    changed("ingestion_issues", "reason", 43, 0, F.lit("r" * 101))
    return constraint_report(tables)


def odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for every document with what a decoder meets seldom: bytes that are no UTF-8, NUL and lone surrogates, text
    after the record, repeated names, numbers that JSON has not, short dates, forms that canonical text makes equal."""
    number = F.col("doc_id").cast("string")

    def line(*parts) -> F.Column:
        return F.concat(*[F.encode(part, "UTF-8") if not isinstance(part, bytes) else F.lit(part) for part in
                          (F.lit(p) if isinstance(p, str) else p for p in parts)])

    def record(rest: str, *more) -> F.Column:
        return line('{"title":"title ', number, '","updated_at":"2020-01-01","body":"Own ', number, '"', rest, *more, "}")

    dated = ',"published_at":"2023-4-5"'
    start = '{"title":"title '
    invalid = F.concat(F.encode(F.concat(F.lit(start), number), "UTF-8"), F.lit(b"\xff\xfe"), F.encode(F.lit('"}'), "UTF-8"))
    cases = [
        invalid,
        record(',"external_id":"\\u0000id"'),
        record(',"region":"x\\ud800y"'),
        F.concat(record(""), F.encode(F.lit(" tail"), "UTF-8")),
        line('{"title":"first","body":"Own ', number, '","title":"last ', number, '"}'),
        record(',"word_count":NaN'),
        record(dated),
        record(',"page_count":', (F.col("doc_id") % 1000).cast("string"), ',"peer_reviewed":"no"'),
        # Ligature, full-width digits, no-break spaces: the same content as its plain form.
        line('{"title":"title ', number, '","body":"\ufb01ve\u00a0\u00a0\uff15 ', number, '","peer_reviewed":1,"region":"o\ufb03ce ', number, '"}'),
    ]
    case = F
    for place, value in enumerate(cases):
        case = case.when(F.col("doc_id") % len(cases) == place, value)
    lines = table(spark, sf_dir, "documents").select(
        F.lit("odd").alias("source_file"), F.col("doc_id").alias("source_line"), F.col("doc_id").alias("line_order"),
        case.cast("string").alias("raw"),
    )
    workspace = Workspace(spark)
    records = workspace.write(fingerprint_records(normalize_lines(lines)), "records")
    keys = record_keys(records).select("line_order", F.col("content_fingerprint").alias("found"))
    plain = F.when(F.col("line_order") % 9 == 8, F.concat(F.lit("five 5 "), F.col("line_order").cast("string"))).otherwise(
        F.concat(F.lit("own "), F.col("line_order").cast("string")))
    wanted = content_fingerprint(F.lower("title"), plain)
    shown = F.array_join(F.transform(
        F.filter("issues", lambda x: ~x["reason"].isin("invalid_date", "updated_before_published")),
        lambda x: F.concat_ws(":", x["field"], x["reason"], x["value_preview"])), ";")
    content = F.when(F.col("found") == wanted, F.when(F.col("line_order") % 9 == 8, "plain").otherwise("own"))
    return records.drop("content_fingerprint").join(keys, "line_order", "left").select(
        F.col("line_order").alias("doc_id"), "outcome", "title",
        F.regexp_replace("region", "\ufb03", "ffi").alias("region"), F.col("published_at").cast("string").alias("published_at"),
        "page_count", "peer_reviewed", shown.alias("issues"), content.alias("content"),
    )


def failed_run_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with external ids too long for their column: the run fails and none of its rows is visible."""
    store = DocumentStore(spark, fresh_folder(spark, "store"))
    longer = F.replace("raw", F.lit('"external_id":"'), F.lit('"external_id":"' + "x" * 255))
    try:
        intake_lines(feed_lines(spark, sf_dir).withColumn("raw", longer), store)
    except RuntimeError:
        pass
    visible = store.table("documents").count()
    return store.runs().select(*RUN, "failure_reason", F.lit(visible).cast("bigint").alias("visible_documents"))


QUERIES: dict[str, Query] = {
    "quality_tiers": statistic("quality_tiers"),
    "line_outcomes": line_outcomes,
    "scan_line_numbers": scan_line_numbers,
    "norm_text": normalized("title", "external_id", "abstract", "body", accepted_only=True),
    "norm_placeholder": normalized("author_name", "organization_name"),
    "norm_dates": norm_dates,
    "norm_booleans": normalized("open_access", "peer_reviewed"),
    "norm_tags": norm_tags,
    "norm_counts": normalized("citation_count", "page_count", "word_count"),
    "norm_status_type_language": normalized("status", "document_type", "language"),
    "norm_url": normalized("url"),
    "norm_doi": normalized("doi"),
    "completeness_scores": normalized("completeness_score", "quality_tier"),
    "props_json_types": props_json_types,
    "long_values": long_values,
    "page_url_check": page_url_check,
    "content_fingerprints": fingerprints_where("body IS NOT NULL"),
    "record_fingerprints": fingerprints_where("body IS NULL AND doi IS NULL"),
    "content_duplicates": content_duplicates,
    "dedup_kept": dedup_kept,
    "dedup_reasons": dedup_reasons,
    "dedup_chain": dedup_chain,
    "date_order_issues": date_order_issues,
    "issues_by_field_reason": issues_by_field_reason,
    "issue_table": stored("ingestion_issues", "id", *LINE, "external_id", "field", "reason", "value_preview"),
    "document_ids": stored("documents", "id", "title", "doi", "content_fingerprint"),
    "dim_authors": stored("authors", "id", "name"),
    "dim_organizations": stored("organizations", "id", "name"),
    "dim_tags": stored("tags", "id", "name"),
    "document_tag_links": stored("document_tags", "document_id", "tag_id", "position"),
    "document_foreign_keys": stored("documents", "id", "author_id", "organization_id"),
    "constraint_report": lambda spark, sf_dir: constraint_report(imported(spark, sf_dir).tables()),
    "broken_constraints": broken_constraints,
    "odd_lines": odd_lines,
    **{name: listed(name) for name in LISTS},
    "list_page_by_score": list_page_by_score,
    "list_far_page": list_far_page,
    "list_totals": list_totals,
    "document_details": details,
    "stats_totals": statistic("documents", "authors", "organizations", "tags", "average_completeness_score"),
    "stats_status": statistic("statuses"),
    "stats_organizations": statistic("organizations_by_document"),
    "stats_tags": statistic("tags_by_document"),
    "stats_report": statistic(),
    "run_summary": lambda spark, sf_dir: imported(spark, sf_dir).runs().select(*RUN),
    "run_events": events,
    "reimport_adds_nothing": reimport_adds_nothing,
    "landing_stream_summary": landing_stream_summary,
    "failed_run_row": failed_run_row,
}
