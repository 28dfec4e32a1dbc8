"""What several operators of this subpackage share."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsift.session import Workspace, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What workers keep from task to task, each with how to give it back.
_KEPT: list[Callable[[], None]] = []


def keep_for_tasks(forget: Callable[[], None]) -> None:
    """Register what a worker keeps for later tasks; ``forget`` frees it."""
    _KEPT.append(forget)


def free_kept() -> None:
    """Free what a worker keeps for tasks of other work than this, as Spark uses workers again for whatever comes next."""
    for forget in _KEPT:
        forget()


def whole_text(column: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row that depends on nothing but its values; equal rows have equal keys."""
    return F.xxhash64(*[F.col(name) for name in columns])


def words_of(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8: what ``bytes.split`` splits at is that very set."""
    return text.encode().split()


def codes_of(items: Sequence) -> tuple[np.ndarray, list]:
    """Each item's code, and the distinct items in order of their codes."""
    numbers: dict = defaultdict()
    numbers.default_factory = numbers.__len__
    codes = np.fromiter(map(numbers.__getitem__, items), dtype=np.int64, count=len(items))
    numbers.default_factory = None  # which refers to the mapping itself
    return codes, list(numbers)


def ragged_positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], ..., starts[i] + lengths[i] - 1 of all i in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def crc_of_ids(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers, compressed byte by byte place."""
    packer = zstandard.ZstdCompressor(level=3)
    parts = []
    for array in arrays:
        planes = np.ascontiguousarray(array, dtype="<u4").view(np.uint8).reshape(-1, 4).T
        data = packer.compress(np.ascontiguousarray(planes).tobytes())
        parts += [np.array([len(array), len(data)], dtype="<u8").tobytes(), data]
    return b"".join(parts)


def unpacked(data: bytes) -> list[np.ndarray]:
    unpacker, arrays, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(data):
        n, size = np.frombuffer(data, dtype="<u8", count=2, offset=at).tolist()
        planes = np.frombuffer(unpacker.decompress(data[at + 16 : at + 16 + size]), dtype=np.uint8).reshape(4, n)
        arrays.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 16 + size
    return arrays


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(columns, schema, strict=True)], schema=schema
    )


def map_batches(
    frame: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str
) -> DataFrame:
    return frame.mapInArrow(function, schema)


def list_array(values: np.ndarray, lengths: np.ndarray, value_type: pa.DataType) -> pa.ListArray:
    """An Arrow list column from its values in a row and the lists' lengths."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=value_type))


def settled(spark: SparkSession, frame: DataFrame, workspace: Workspace) -> DataFrame:
    """The frame as a written table of its own; the workspace it was made from is deleted.

    Only the (narrow) result stays in the shared folder, for whoever reads it next.
    """
    own = Workspace(spark, base=shared_folder(spark))
    result = own.write(frame, "result")
    workspace.delete()
    return result
