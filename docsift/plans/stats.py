"""Aggregate statistics over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.entities import ENTITY_TABLES, Entities
from docsift.sources.store import DocumentStore

TIERS = ("low", "medium", "high")
COUNTED = ("documents", "authors", "organizations", "tags")


def document_measures(documents: DataFrame) -> DataFrame:
    """(metric, key, entity_id, value): all sums over documents from a single scan.

    Each document's few measures are summed on the map side, so no group is ever brought together.
    """
    documents = documents.select("status", "quality_tier", "organization_id", "completeness_score")
    combined = documents.groupBy("status", "quality_tier", "organization_id").agg(
        F.count("*").alias("documents"), F.sum("completeness_score").alias("score")
    )

    def measure(metric: str, key, entity, value):
        return F.struct(
            F.lit(metric).alias("metric"), key.alias("key"), entity.alias("entity_id"), value.alias("value")
        )

    no_key, no_entity = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    number = F.col("documents")
    measures = F.array(
        measure("documents", no_key, no_entity, number),
        measure("score", no_key, no_entity, F.col("score")),
        measure("quality_tiers", F.col("quality_tier"), no_entity, number),
        # A missing status and the literal one count together.
        measure("statuses", F.coalesce("status", F.lit("unknown")), no_entity, number),
        measure("organizations_by_document", no_key, F.col("organization_id"), number),
    )
    return (
        combined.select(F.inline(measures))
        .where("metric <> 'organizations_by_document' OR entity_id IS NOT NULL")
        .groupBy("metric", "key", "entity_id")
        .agg(F.sum("value").alias("value"))
    )


def score_blocks(documents: DataFrame, store: DocumentStore) -> DataFrame:
    """How many of an import's documents have each score, by blocks of ids: where a page of a sorted list begins."""
    block = store.block_of(F.col("id")).alias("block")
    return documents.groupBy(F.col("completeness_score").alias("score"), block).agg(F.count("*").alias("documents"))


def partial_statistics(documents: DataFrame, entities: Entities) -> DataFrame:
    """(metric, key, value): the sums of an import, from its documents and the names they mention.

    The sums of all imports add up to those of the store. Counted by id first, so a join is one row per name.
    """
    measures = document_measures(documents)

    def named(counts: DataFrame, kind: str, metric: str) -> DataFrame:
        names = entities.names.where(F.col("kind") == kind).select("entity_id", F.col("name").alias("key"))
        return counts.join(names, "entity_id").select(F.lit(metric).alias("metric"), "key", "value")

    links = entities.links.where("kind = 'tag'").groupBy("entity_id").agg(F.count("*").alias("value"))
    kinds = entities.new_names.groupBy("kind").agg(F.count("*").alias("value"))
    tables = F.create_map(*[F.lit(x) for pair in ENTITY_TABLES.items() for x in pair])
    organizations = measures.where("metric = 'organizations_by_document'").select("entity_id", "value")
    return (
        measures.where("entity_id IS NULL").select("metric", "key", "value")
        .unionByName(named(organizations, "organization", "organizations_by_document"))
        .unionByName(named(links, "tag", "tags_by_document"))
        .unionByName(kinds.select(tables[F.col("kind")].alias("metric"), F.lit(None).cast("string").alias("key"), "value"))
    )


def statistics(store: DocumentStore) -> DataFrame:
    """(metric, key, value): all statistics in long form; every tier is there, also with no documents.

    Sums that each import has left are added up; no document, link or name is read. The average score has no row value
    when there are no documents.
    """
    zeros = store.spark.createDataFrame(
        [*((metric, None) for metric in COUNTED), *(("quality_tiers", tier) for tier in TIERS)],
        "metric string, key string",
    ).withColumn("value", F.lit(0).cast("bigint"))
    sums = store.table("statistics").unionByName(zeros).groupBy("metric", "key").agg(F.sum("value").alias("value"))
    average = sums.where("metric IN ('documents', 'score')").agg(
        (
            F.sum(F.when(F.col("metric") == "score", F.col("value"))).cast("double")
            / F.nullif(F.sum(F.when(F.col("metric") == "documents", F.col("value"))), F.lit(0))
        ).alias("value"),
    )
    average = average.select(
        F.lit("average_completeness_score").alias("metric"), F.lit(None).cast("string").alias("key"), "value"
    )
    return sums.where("metric <> 'score'").select("metric", "key", F.col("value").cast("double").alias("value")).unionByName(
        average
    )


def statistics_row(store: DocumentStore) -> DataFrame:
    """The statistics as one row with four maps, for a reader who wants them whole."""
    rows = statistics(store)

    def single(metric: str, kind: str):
        return F.max(F.when(F.col("metric") == metric, F.col("value"))).cast(kind).alias(metric)

    def mapped(metric: str):
        entry = F.when(F.col("metric") == metric, F.struct("key", F.col("value").cast("bigint").alias("value")))
        # collect_list leaves nulls out; one entry per name.
        return F.map_from_entries(F.collect_list(entry)).alias(metric)

    return rows.agg(
        *[single(name, "bigint") for name in COUNTED],
        single("average_completeness_score", "double"),
        *[mapped(name) for name in
          ("quality_tiers", "statuses", "organizations_by_document", "tags_by_document")],
    )
