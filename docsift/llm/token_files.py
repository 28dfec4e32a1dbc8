"""Token ids written as Simple-8b segments in ascending doc_id order, and read back.

A token file is one partition of the written table: its segments in order, each a run of whole documents whose ids
are packed by ``simple8b``. A segment also lists its documents and their lengths, so it can be read alone. The table
is written by Spark, so it can lie in any store that Spark writes to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.llm.common import crc_of_ids, list_array, whole_text
from docsift.llm.simple8b import pack, unpack
from docsift.llm.tokens import word_end_encoder

# A segment is closed after the document with which it holds this many ids.
SEGMENT_IDS = 1 << 18
SEGMENTS = "part long, segment long, ids_before long, doc_ids array<long>, lengths array<long>, payload binary"
SEGMENT_SCHEMA = pa.schema([
    ("part", pa.int64()), ("segment", pa.int64()), ("ids_before", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int,
                      segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode every text, append ``end_id`` and write the segments to ``folder``; returns them as a table.

    ``documents`` has doc_id and text, other columns are ignored. A null text is the empty one, so only its end id is
    written. Documents are in ascending doc_id order over all partitions (null first, repeated ids next to each
    other). An empty table writes no segments. Texts are shuffled once, by range; a task holds one segment at a time.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_end_encoder(tokenizer)
        part = TaskContext.get().partitionId()
        doc_ids: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        held = before = number = 0

        end = np.array([end_id], dtype=np.uint32)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"part": part, "segment": number, "ids_before": before, "doc_ids": doc_ids, "lengths": lengths,
                  "payload": pack(np.concatenate(parts))}],
                schema=SEGMENT_SCHEMA,
            )

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for doc_id, ids in zip(keys, encoder.encode(batch.column(1).to_pylist()), strict=True):
                doc_ids.append(doc_id)
                parts += (ids, end)
                lengths.append(len(ids) + 1)
                held += len(ids) + 1
                if held >= segment_ids:
                    yield close()
                    before, number = before + held, number + 1
                    doc_ids, lengths, parts, held = [], [], [], 0
        if parts:
            yield close()

    ordered = documents.select("doc_id", whole_text().alias("whole")).repartitionByRange("doc_id")
    ordered.sortWithinPartitions("doc_id").mapInArrow(segments, SEGMENTS).write.parquet(folder)
    return read_token_files(documents.sparkSession, folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(folder)


def documents_of(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded segments.

    ``start`` counts the ids of all documents before it: those before it in its partition, which its segment knows,
    and the totals of earlier partitions, one number each.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                row = {name: batch.column(name)[place].as_py() for name in batch.schema.names}
                ids = unpack(row["payload"])
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(lengths), row["part"])),
                    pa.array(row["doc_ids"], type=pa.int64()),
                    pa.array(row["ids_before"] + ends - lengths),
                    pa.array(lengths),
                    pa.array([crc_of_ids(ids[end - n : end]) for end, n in zip(ends, lengths, strict=True)],
                             type=pa.int64()),
                ], names=["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])

    rows = segments.mapInArrow(decoded, "part long, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    in_segment = F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition that was written.
    offsets = segments.groupBy("part").agg(F.sum(in_segment).alias("ids")).select(
        "part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("ids_in_earlier_parts")
    )
    return rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("ids_in_earlier_parts") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )
