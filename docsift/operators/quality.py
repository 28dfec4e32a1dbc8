"""The stored tables' constraints as queries for the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.sources.schema import MAX_INTEGER, MAX_LENGTHS

COUNTS = ("citation_count", "page_count", "word_count")
UNIQUE = {
    "documents": (("doi",), ("content_fingerprint",)),
    "authors": (("name",),),
    "organizations": (("name",),),
    "tags": (("name",),),
    "document_tags": (("document_id", "tag_id"),),
}
# Child table and column, parent table.
REFERENCES = (
    ("documents", "author_id", "authors"),
    ("documents", "organization_id", "organizations"),
    ("document_tags", "document_id", "documents"),
    ("document_tags", "tag_id", "tags"),
    ("ingestion_issues", "ingestion_run_id", "ingestion_runs"),
)
Tables = dict[str, DataFrame]


def row_checks(table: str) -> dict[str, str]:
    """Check name and the SQL condition under which a row breaks it."""
    checks: dict[str, str] = {}
    if table == "documents":
        checks["documents_title_not_blank"] = "title IS NULL OR trim(title) = ''"
        for name in COUNTS:
            checks[f"documents_{name}_nonnegative"] = f"{name} < 0"
            checks[f"documents_{name}_fits_integer"] = f"{name} > {MAX_INTEGER}"
        checks["documents_score_range"] = "completeness_score IS NULL OR completeness_score NOT BETWEEN 0 AND 100"
        checks["documents_quality_tier_valid"] = "quality_tier IS NULL OR quality_tier NOT IN ('low', 'medium', 'high')"
    for name, longest in MAX_LENGTHS.get(table, {}).items():
        checks[f"{table}_{name}_length"] = f"length({name}) > {longest}"
    return checks


def broken_rows(table: str, rows: DataFrame) -> DataFrame:
    """(check_name, row_key, run_id): every row check of a table in one scan; the run is null where rows name none."""
    failed = F.array_compact(
        F.array(*[F.when(F.expr(broken), name) for name, broken in row_checks(table).items()])
    )
    run = next((F.col(name) for name in ("run_id", "ingestion_run_id") if name in rows.columns), F.lit(None))
    return rows.select(
        F.explode(failed).alias("check_name"), F.col("id").cast("string").alias("row_key"),
        run.cast("bigint").alias("run_id"),
    )


def repeated_keys(table: str, columns: tuple[str, ...], rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Keys that occur twice in ``rows``, or once there and once among ``stored``."""
    present = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    keys = rows.where(present).select(*columns)
    repeated = keys.groupBy(*columns).count().where("count > 1").select(*columns)
    if stored is not None:
        repeated = repeated.unionByName(stored.where(present).select(*columns).join(keys, list(columns), "left_semi"))
    row_key = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
    return repeated.select(
        F.lit(f"{table}_{'_'.join(columns)}_unique").alias("check_name"), row_key.alias("row_key"),
        F.lit(None).cast("bigint").alias("run_id"),
    )


def dangling_references(child: str, column: str, rows: DataFrame, parents: list[DataFrame]) -> DataFrame:
    """Referenced ids without a parent row; distinct first, so a popular parent costs nothing."""
    used = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("id")).distinct()
    missing = reduce(lambda left, parent: left.join(parent.select("id"), "id", "left_anti"), parents, used)
    return missing.select(
        F.lit(f"{child}_{column}_references").alias("check_name"), F.col("id").cast("string").alias("row_key"),
        F.lit(None).cast("bigint").alias("run_id"),
    )


def violations(tables: Tables, stored: Tables | None = None) -> DataFrame:
    """(check_name, row_key, run_id) of all broken constraints in ``tables``; the run is that of a row that breaks one.

    With ``stored``, ``tables`` holds only new rows: they are checked among themselves and against the
    stored ones, which are not checked again. Of those, the rows that share a key with a new one are enough.
    """
    stored = stored or {}
    found = [broken_rows(name, rows) for name, rows in tables.items() if row_checks(name)]
    for table, keys in UNIQUE.items():
        if table in tables:
            found += [repeated_keys(table, columns, tables[table], stored.get(table)) for columns in keys]
    for child, column, parent in REFERENCES:
        parents = [source[parent] for source in (tables, stored) if parent in source]
        if child in tables and parents:
            found.append(dangling_references(child, column, tables[child], parents))
    return reduce(DataFrame.unionByName, found)


def check_names() -> list[str]:
    tables = ("documents", "authors", "organizations", "tags", "ingestion_issues")
    names = [name for table in tables for name in row_checks(table)]
    names += [f"{table}_{'_'.join(columns)}_unique" for table, keys in UNIQUE.items() for columns in keys]
    return names + [f"{child}_{column}_references" for child, column, _ in REFERENCES]


def constraint_report(tables: Tables) -> DataFrame:
    """(check_name, violations) with a row for every check, also those nothing breaks."""
    counted = violations(tables).groupBy("check_name").agg(F.count("*").alias("violations"))
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(name,) for name in check_names()], "check_name string")
    return names.join(counted, "check_name", "left").select(
        "check_name", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations")
    )
