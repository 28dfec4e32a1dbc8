"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docsift.llm.best_fit import pack_documents
from docsift.llm.common import table
from docsift.llm.compression_rules import keep_good
from docsift.llm.secret_scan import redact_documents
from docsift.llm.simhash_dedup import keep_one_of_each
from docsift.llm.substring_dedup import remove_repeated_passages
from docsift.session import Workspace


# So many chunks of text a worker keeps while packing: the stages before leave it less memory than packing alone has.
KNOWN_CHUNKS = 50_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the compression bands reject go."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by fingerprints of four-word shingles that differ in at most 4 bits, one stays."""
    return keep_one_of_each(docs, Workspace(spark))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 and more words that occur again are cut; a document may be left empty."""
    return remove_repeated_passages(docs, Workspace(spark))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return redact_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), Workspace(spark), known=KNOWN_CHUNKS)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

# Compressors, fingerprints and tokenizers are not to be had in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    workspace, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = workspace.write(stage(spark, docs, sf_dir), name)
    return docs
