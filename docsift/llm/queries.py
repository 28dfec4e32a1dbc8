"""The queries of this subpackage: each operator over its whole table, with the columns that its contract asks for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from docsift.llm import byte_bpe
from docsift.llm.best_fit import pack_documents
from docsift.llm.common import settled, table
from docsift.llm.compression_rules import judge_documents
from docsift.llm.contamination import find_contamination
from docsift.llm.masked_lm import score_documents
from docsift.llm.neighbour_partitions import nearest
from docsift.llm.ranked_search import rank_documents
from docsift.llm.secret_scan import scan_documents
from docsift.llm.shards import shard_documents
from docsift.llm.simhash_dedup import near_duplicates
from docsift.llm.substring_dedup import remove_repeats
from docsift.llm.token_files import documents_of, write_token_files
from docsift.llm.whitening import whiten
from docsift.session import Workspace

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    return settled(spark, score_documents(documents(spark, sf_dir), workspace), workspace)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    return settled(spark, shard_documents(documents(spark, sf_dir), 8, workspace), workspace)


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(documents(spark, sf_dir))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    texts = documents(spark, sf_dir).select("doc_id", "text")
    found = remove_repeats(texts, workspace, output=lambda kept: F.sha2(kept, 256))
    result = found.select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
    return settled(spark, result, workspace)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return settled(spark, nearest(vectors, F.col("vec_id") % 20 == 0, 20, workspace), workspace)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return settled(spark, pack_documents(documents(spark, sf_dir), tokenizer, workspace), workspace)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    segments = write_token_files(documents(spark, sf_dir), workspace.folder("token-files"), tokenizer, end_id=2)
    return settled(spark, documents_of(segments), workspace)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    found = near_duplicates(documents(spark, sf_dir), workspace)
    result = found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
    return settled(spark, result, workspace)


def op11_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    found = find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), workspace)
    result = found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
    return settled(spark, result, workspace)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    found = rank_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), 20, workspace)
    return settled(spark, found, workspace)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return settled(spark, whiten(vectors, workspace), workspace)


QUERIES: dict[str, Query] = {
    "op1_masked_lm": op1_masked_lm,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_jump_shards": op3_jump_shards,
    "op4_compression_bands": op4_compression_bands,
    "op5_secret_scan": op5_secret_scan,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_neighbours": op7_neighbours,
    "op8_best_fit": op8_best_fit,
    "op9_token_files": op9_token_files,
    "op10_simhash": op10_simhash,
    "op11_contamination": op11_contamination,
    "op12_ranked_search": op12_ranked_search,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}

# A text's words, A to Z lower-cased.
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
# The other operators are tested against brute force, an exact round trip or held-out accuracy: their hashes,
# tokenizers, compressors and models are not to be had in SQL.
ORACLE_SQL: dict[str, str] = {
    "op6_repeated_passages": r"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ),
        windows AS (
            SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM split)
        ),
        again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS place FROM again),
        placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
            FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
        )
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
            sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (doc_id)
    """,
    "op11_contamination": rf"""
        WITH texts AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
        windows AS (
            SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(words), 10) AS n,
                array_to_string(words[i:i + 9], ' ') AS content
            FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i
                  FROM items WHERE len(words) > 0)
        ),
        places AS (
            SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS content
            FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
                  FROM texts, (SELECT DISTINCT n FROM windows))
        ),
        hits AS (SELECT doc_id, item, i, n FROM places JOIN windows USING (content, n)),
        hit_words AS (
            SELECT doc_id, count(DISTINCT place) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM hits))
            GROUP BY doc_id
        ),
        found AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM texts LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op12_ranked_search": rf"""
        WITH occurrences AS (
            SELECT nr, doc_id, term, count(*) AS tf
            FROM (SELECT row_number() OVER () AS nr, doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL
        ),
        lengths AS (SELECT nr, CAST(sum(tf) AS BIGINT) AS n FROM occurrences GROUP BY nr),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
        held AS (SELECT term, count(*) AS df FROM occurrences GROUP BY term),
        asked AS (
            SELECT item, item_id, term, count(*) AS repeats
            FROM (SELECT row_number() OVER () AS item, item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL
        ),
        scored AS (
            SELECT item, item_id, nr, doc_id, CAST(sum(
                repeats * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))
            ) AS BIGINT) AS score
            FROM asked JOIN occurrences USING (term) JOIN held USING (term) JOIN lengths USING (nr), totals GROUP BY ALL
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
            doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 20
    """,
}
