"""The keys of stored documents, looked up by what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.session import Workspace
from docsift.sources.store import DocumentStore


def _doi_key() -> Column:
    return F.concat(F.lit("d"), F.col("doi"))


def _content_key() -> Column:
    return F.concat(F.lit("f"), F.col("content_fingerprint"))


def key_table(documents: DataFrame) -> DataFrame:
    """(key, other_key, id): a row for each key of (id, doi, content_fingerprint)."""

    def row(key: Column, other: Column) -> Column:
        return F.when(key.isNotNull(), F.struct(key.alias("key"), other.alias("other_key"), F.col("id")))

    rows = F.array(row(_doi_key(), _content_key()), row(_content_key(), _doi_key()))
    return documents.select(F.inline(F.array_compact(rows)))


def documents_of(keys: DataFrame) -> DataFrame:
    """(id, doi, content_fingerprint) of the documents that rows of a key table name, each once."""

    def value(letter: str) -> Column:
        found = F.when(F.col("key").startswith(letter), F.col("key")).when(
            F.col("other_key").startswith(letter), F.col("other_key")
        )
        return F.substring(found, 2, 2**31 - 1)

    return keys.select("id", value("d").alias("doi"), value("f").alias("content_fingerprint")).distinct()


def stored_with_keys_of(records: DataFrame, store: DocumentStore, workspace: Workspace) -> DataFrame:
    """(id, doi, content_fingerprint) of the stored documents that share a key with a record: a written table.

    ``records`` has doi and content_fingerprint. Only files of the key table that may hold an asked key are read.
    """
    if not store.total("documents"):
        return store.spark.createDataFrame([], "id bigint, doi string, content_fingerprint string")
    asked = records.select(F.explode(F.array_compact(F.array(_doi_key(), _content_key()))).alias("key")).distinct()
    found = store.probe("document_keys", workspace.write(asked, "asked-keys"), workspace)
    return workspace.write(documents_of(found), "stored-documents")
