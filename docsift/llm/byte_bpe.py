"""Byte-level BPE by a global shuffle of distinct words.

1. Each task splits its documents into pre-tokens and turns a block of documents into its distinct words and, for
   every position, the number of the word there. Words are dealt to buckets by a hash.
2. The words of a bucket meet from all blocks; each distinct one is encoded once, and its ids go back to the blocks.
3. The ids of a block's words meet its positions again, and documents are put together in order of position.

A word travels once for each block that holds it, however often it occurs there, so the most frequent words do not
weigh on any task. The rows are shuffled in one line of stages: blocks are formed only once, so nothing depends on how
the input is split at another reading.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import packed, ragged_positions, unpacked, whole_text

# Parts of a row: words of a block in a bucket, or positions of a block.
ROWS = "block long, route long, words binary, doc_ids array<long>, doc_words array<long>, places binary"
ROW_SCHEMA = pa.schema([
    ("block", pa.int64()), ("route", pa.int64()), ("words", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int64())), ("places", pa.binary()),
])
BLOCK_CHARS = 32_000_000
# A bucket holds the distinct words of about so many bytes of text; there are at least so many buckets.
BUCKET_BYTES, LEAST_BUCKETS = 64_000_000, 1024
SEPARATOR = b"\xff"  # in no UTF-8 text
BLOCKS_OF_PART = 1 << 32


def read_ranks(spark: SparkSession | None, path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: token bytes in base 64, then the rank, on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(None, path), special_tokens={})


@cache
def token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(None, path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def decoded_bytes(ids: np.ndarray, path: str) -> bytes:
    """What ids stand for: each one's entry of the token-byte table, in a row."""
    table = token_bytes(path)
    return b"".join([table[i] for i in ids.tolist()])


def _row(block: int, route: int, words: bytes | None, doc_ids=None, doc_words=None, places=None) -> dict:
    return {"block": block, "route": route, "words": words, "doc_ids": doc_ids, "doc_words": doc_words,
            "places": places}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ROW_SCHEMA)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for place in range(batch.num_rows):
            yield {name: batch.column(name)[place].as_py() for name in batch.schema.names}


def _runs(rows: Iterator[dict], key: str) -> Iterator[Iterator[dict]]:
    """Rows with equal keys that follow each other, together."""
    held: list[dict] = []
    for row in rows:
        if held and held[0][key] != row[key]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def split_blocks(documents: DataFrame, pattern: str, buckets: int, block_chars: int) -> DataFrame:
    """Step 1. ``documents`` has doc_id and whole."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = regex.compile(pattern).findall
        packer = zstandard.ZstdCompressor(level=3)
        block = TaskContext.get().partitionId() * BLOCKS_OF_PART
        numbers: dict[str, int] = {}
        doc_ids: list = []
        coded: list[np.ndarray] = []
        chars = 0

        def close() -> Iterator[pa.RecordBatch]:
            words = [word.encode() for word in numbers]
            numbers.clear()
            lengths = [len(codes) for codes in coded]
            codes = np.concatenate(coded)
            coded.clear()
            counts = np.bincount(codes, minlength=len(words))
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(words), dtype=np.uint32)  # frequent words get small numbers
            place[order] = np.arange(len(words), dtype=np.uint32)
            bucket = np.fromiter((zlib.crc32(word) % buckets for word in words), dtype=np.int64, count=len(words))
            ranked = bucket[order]
            by_bucket = np.argsort(ranked, kind="stable")
            ends = np.cumsum(np.bincount(ranked, minlength=buckets)).tolist()
            start, rows = 0, []
            for number, end in enumerate(ends):
                if end > start:
                    joined = SEPARATOR.join([words[order[i]] for i in by_bucket[start:end].tolist()])
                    rows.append(_row(block, number, packer.compress(joined)))
                start = end
            yield _batch(rows)
            yield _batch([_row(block, buckets + block, None, doc_ids, lengths, packed(ranked, place[codes]))])

        for batch in batches:
            for doc_id, scalar in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = scalar.as_py()
                found = matches(text)
                doc_ids.append(doc_id)
                coded.append(np.array([numbers.setdefault(word, len(numbers)) for word in found], dtype=np.uint32))
                chars += len(text)
                if chars >= block_chars:
                    yield from close()
                    block, numbers, doc_ids, coded, chars = block + 1, {}, [], [], 0
        if doc_ids:
            yield from close()

    return documents.mapInArrow(split, ROWS)


def encode_words(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Step 2: in every row of words, the words are replaced by their ids; each word of a bucket is encoded once.

    The rows of a bucket follow each other; a task holds one of them, and the bucket's distinct words.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoding(path, pattern).encode_ordinary
        unpacker = zstandard.ZstdDecompressor()
        route, known = None, {}
        for row in _rows(batches):
            if row["route"] != route:
                route, known = row["route"], {}
            if row["words"] is not None:
                found = []
                for word in unpacker.decompress(row["words"]).split(SEPARATOR):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = ids_of(word.decode())
                    found.append(ids)
                lengths = np.fromiter(map(len, found), dtype=np.uint32, count=len(found))
                flat = np.fromiter((i for ids in found for i in ids), dtype=np.uint32, count=int(lengths.sum()))
                row["words"] = packed(lengths, flat)
            yield _batch([row])

    return rows.mapInArrow(encode, ROWS)


def join_blocks(rows: DataFrame, path: str, decoded: bool) -> DataFrame:
    """Step 3. The rows of a block follow each other, words in order of their buckets, positions last."""
    schema = IDS_SCHEMA.append(pa.field("decoded", pa.binary())) if decoded else IDS_SCHEMA

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(_rows(batches), "block"):
            *encoded, positions = run
            bucket_lengths, bucket_ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
            for row in encoded:
                lengths, ids = unpacked(row["words"])
                bucket_lengths.append(lengths)
                bucket_ids.append(ids)
            ranked, places = unpacked(positions["places"])
            by_bucket = np.argsort(ranked, kind="stable")
            in_order = np.concatenate(bucket_lengths).astype(np.int64)
            flat = np.concatenate(bucket_ids).astype("<u4")
            lengths, starts = np.empty_like(in_order), np.empty_like(in_order)
            lengths[by_bucket] = in_order
            starts[by_bucket] = np.cumsum(in_order) - in_order
            at, held, rows_out = 0, 0, []
            for doc_id, n in zip(positions["doc_ids"], positions["doc_words"], strict=True):
                words = places[at : at + n]
                at += n
                ids = flat[ragged_positions(starts[words], lengths[words])]
                row = {"doc_id": doc_id, "n_tokens": len(ids), "ids": ids.tobytes()}
                rows_out.append(row | {"decoded": decoded_bytes(ids, path)} if decoded else row)
                held += len(ids)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_pylist(rows_out, schema=schema)
                    held, rows_out = 0, []
            if rows_out:
                yield pa.RecordBatch.from_pylist(rows_out, schema=schema)

    return rows.mapInArrow(join, f"{IDS}, decoded binary" if decoded else IDS)


IDS = "doc_id long, n_tokens long, ids binary"
IDS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def encode_documents(documents: DataFrame, path: str, pattern: str, buckets: int | None = None,
                     block_chars: int = BLOCK_CHARS, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, unsigned, 32 bits each) of every row's whole text.

    With ``decoded`` also the bytes that the ids stand for, found by the task that has put them together.

    ``path`` is a rank file and ``pattern`` its pattern for pre-tokens. A null text is the empty one and has no ids. A
    very long text is a block of its own. Repeated rows are encoded each, a null doc_id is carried along, other
    columns are ignored, an empty table gives no rows. The number of ``buckets`` grows with the texts' bytes, which are
    added up first, so that the distinct words of one fit a task's memory.
    """
    whole = documents.select("doc_id", whole_text().alias("whole"))
    if buckets is None:
        size = whole.agg(F.sum(F.octet_length("whole").cast("long"))).first()[0] or 0
        buckets = max(size // BUCKET_BYTES, LEAST_BUCKETS)
    met = split_blocks(whole, pattern, buckets, block_chars).repartition("route").sortWithinPartitions("route")
    back = encode_words(met, path, pattern).repartition("block").sortWithinPartitions("block", "route")
    return join_blocks(back, path, decoded)


def decode(path: str) -> Callable[[Column], Column]:
    """A function of a column of ids that gives the bytes they stand for: each id's entry of the token-byte table."""

    @F.pandas_udf("binary")
    def bytes_of(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ids: decoded_bytes(np.frombuffer(ids, dtype="<u4"), path))

    return bytes_of
