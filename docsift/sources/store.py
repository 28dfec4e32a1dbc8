"""The document store: Parquet tables in one folder, visible by the entries of a commit log.

An import writes its rows as segments, a folder for each table, and publishes them all by one log entry. An entry is
created only if there is none of its number, and lists every visible segment, so reading the last one is all it takes
to see the store as of one moment. Ids and duplicates are settled against an entry; if data were published since, the
import fails. Nothing is updated in place: small segments are merged into new ones, and an entry swaps them in, while
those who hold an older entry go on reading the old ones.

Names and document keys are dealt by a prefix of their hash, so that a look-up reads the files of the asked prefixes
only. Documents and their links lie in folders for blocks of ids that follow each other, so that an id tells where to
read.
"""

from __future__ import annotations

import math
import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.hot_join import join_lookup
from docsift.session import IN_LIST, Workspace, delete_folder, prepare, side_by_side
from docsift.sources import schema
from docsift.sources.log import CommitLog

Segment = dict  # path, bytes, bits, prefixes, blocks
EMPTY = {"data_version": 0, "segments": {}, "totals": {}, "batches": {}}
# So many ids are a block. A store keeps the number that it began with.
BLOCK_IDS = 1 << 17
# A prefix of a dealt segment holds about so many rows, and a segment has at most 2^MAX_BITS prefixes.
PREFIX_ROWS = 1_000_000
MAX_BITS = 12
# So many segments of about one size are merged into one. Sizes are told apart by powers of it, from this size on.
MERGED_SEGMENTS = 16
LEAST_BYTES = 8 * 1024 * 1024


class ConcurrentImport(Exception):
    """Ids and duplicates were settled against a store that has changed since."""


def key_prefix(key: Column, bits: int) -> Column:
    """The first bits of a key's hash."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int") if bits else F.lit(0)


def runs_of(numbers: list[int]) -> list[list[int]]:
    """The first and the last of numbers that follow each other."""
    runs: list[list[int]] = []
    for number in sorted(numbers):
        if runs and runs[-1][1] + 1 == number:
            runs[-1][1] = number
        else:
            runs.append([number, number])
    return runs


class DocumentStore:
    """``prefix_rows``, ``merged_segments`` and ``block_ids`` change how the tables are laid out, not what is in them."""

    def __init__(self, spark: SparkSession, path: str, prefix_rows: int = PREFIX_ROWS,
                 merged_segments: int = MERGED_SEGMENTS, block_ids: int = BLOCK_IDS) -> None:
        self.spark = prepare(spark)
        self.path = path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/log")
        self.prefix_rows, self.merged_segments, self._block_ids = prefix_rows, merged_segments, block_ids
        self._fixed: dict | None = None

    def state(self) -> dict:
        return self._fixed if self._fixed is not None else self.log.last()[1] or EMPTY

    def snapshot(self) -> DocumentStore:
        """The store as of now: whatever is read from it belongs to the same log entry."""
        if self._fixed is not None:
            return self
        fixed = DocumentStore(self.spark, self.path, self.prefix_rows, self.merged_segments, self._block_ids)
        fixed._fixed = self.state()
        return fixed

    @property
    def block_ids(self) -> int:
        return self.state().get("block_ids", self._block_ids)

    def block_of(self, document_id: Column) -> Column:
        """The block that a document's id lies in."""
        return F.floor(document_id / F.lit(self.block_ids)).cast("bigint")

    def total(self, name: str) -> int:
        """How many rows of a kind are stored; as ids are dense, this is also the last id."""
        return self.state()["totals"].get(name, 0)

    def has_batch(self, batch_key: str) -> bool:
        """Whether a stream's batch ``<stream>#<number>`` was published."""
        stream, _, number = batch_key.rpartition("#")
        return self.state()["batches"].get(stream, -1) >= int(number)

    # Reading

    def segments(self, name: str) -> list[Segment]:
        return self.state()["segments"].get(name, [])

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema.TABLES[name])
        # Folders of prefixes are no partitions: their names say nothing that the rows do not.
        reader = self.spark.read.schema(schema.TABLES[name]).option("recursiveFileLookup", "true")
        return reader.parquet(*[f"{self.path}/{path}" for path in paths])

    def table(self, name: str) -> DataFrame:
        return self._read(name, [segment["path"] for segment in self.segments(name)])

    def blocks(self, name: str, wanted: set[int]) -> DataFrame:
        """The rows of some blocks of ids: only their folders are listed and read."""
        return self._read(name, [
            f"{segment['path']}/block={block}"
            for segment in self.segments(name) for block in sorted(wanted)
            if any(first <= block <= last for first, last in segment["blocks"])
        ])

    def runs(self) -> DataFrame:
        """All finished runs, completed or failed: one row each."""
        return self.table("ingestion_runs")

    def tables(self) -> dict[str, DataFrame]:
        """All tables as of the same moment."""
        fixed = self.snapshot()
        return {name: fixed.table(name) for name in schema.TABLES}

    def probe(self, name: str, asked: DataFrame, workspace: Workspace) -> DataFrame:
        """The rows of a dealt table whose key is among ``asked``: a written table of distinct keys in one column.

        Only files of prefixes that are asked for are read, and few keys are looked up in the files' Bloom filters. What
        is collected are prefixes, at most 2^MAX_BITS, and at most IN_LIST keys.
        """
        key, segments = schema.DEALT[name], self.segments(name)
        if not segments:
            return self._read(name, [])
        asked = asked.toDF(key)
        touched = {0: {0}}
        for bits in sorted({segment["bits"] for segment in segments} - {0}):
            prefixes = asked.select(key_prefix(F.col(key), bits).alias("prefix")).distinct().collect()
            touched[bits] = {row.prefix for row in prefixes}
        paths = [
            f"{segment['path']}/prefix={prefix}"
            for segment in segments for prefix in segment["prefixes"] if prefix in touched[segment["bits"]]
        ]
        rows = self._read(name, paths)
        few = [row[0] for row in asked.limit(IN_LIST + 1).collect()]
        if len(few) <= IN_LIST:
            return rows.where(F.col(key).isin(few))
        return join_lookup(rows, asked, [key], "left_semi", workspace)

    # Writing

    def _folder(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def write(self, name: str, rows: DataFrame) -> Segment:
        """Write rows of a table as a segment that nobody sees yet. Rows of a dealt table are counted first."""
        path = f"{name}/{uuid.uuid4().hex}"
        rows = rows.select(*[F.col(column).cast(kind).alias(column) for column, kind in schema.columns(name).items()])
        bits, prefixes, blocks = 0, [0], []
        if name in schema.DEALT:
            key = schema.DEALT[name]
            bits = min(max(math.ceil(math.log2(max(rows.count(), 1) / self.prefix_rows)), 0), MAX_BITS)
            dealt = rows.withColumn("prefix", key_prefix(F.col(key), bits))
            dealt = dealt.repartition("prefix") if bits else dealt.coalesce(1)
            writer = dealt.sortWithinPartitions("prefix", key).write.partitionBy("prefix")
            writer.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{self.path}/{path}")
        elif name in schema.RANGED:
            ranged = rows.withColumn("block", self.block_of(F.col(schema.RANGED[name])))
            if name != "documents":
                ranged = ranged.repartition("block")  # narrow; documents come in the order of their lines
            writer = ranged.sortWithinPartitions("block", *schema.ORDER[name]).write.partitionBy("block")
            writer.option(f"parquet.bloom.filter.enabled#{schema.RANGED[name]}", "true").parquet(f"{self.path}/{path}")
        else:
            rows.write.parquet(f"{self.path}/{path}")
        files, target = self._folder(path)
        names = [status.getPath().getName() for status in files.listStatus(target)]
        if name in schema.DEALT:
            prefixes = sorted(int(n.removeprefix("prefix=")) for n in names if n.startswith("prefix="))
        if name in schema.RANGED:
            blocks = runs_of([int(n.removeprefix("block=")) for n in names if n.startswith("block=")])
        return {
            "path": path, "bytes": files.getContentSummary(target).getLength(), "bits": bits, "prefixes": prefixes,
            "blocks": blocks,
        }

    def write_all(self, tables: dict[str, DataFrame]) -> dict[str, Segment]:
        """Write a segment of each table, side by side."""
        return dict(zip(tables, side_by_side([partial(self.write, *table) for table in tables.items()]), strict=True))

    def written(self, name: str, segment: Segment) -> DataFrame:
        """The rows of a segment, visible or not."""
        return self._read(name, [segment["path"]])

    def discard(self, segments: dict[str, Segment]) -> None:
        """Delete segments that nobody can see."""
        for segment in segments.values():
            delete_folder(self.spark, f"{self.path}/{segment['path']}")

    def claim_runs(self, many: int = 1) -> int:
        """The first of ``many`` run ids that no other import can take."""
        return self.log.claim("claims", self.total("last_run") + 1, many)

    def commit(self, added: dict[str, Segment], totals: dict[str, int], last_run: int, settled_against: dict | None,
               batch_key: str | None = None) -> None:
        """Publish segments. ``totals`` are added up.

        ``settled_against`` is the state that new data were settled against: with data published since, it is refused.
        Without it the segments depend on nothing, as a failed run's row.
        """
        while True:
            number, last = self.log.last()
            last = last or EMPTY
            if settled_against is not None and last["data_version"] != settled_against["data_version"]:
                raise ConcurrentImport("another import was published meanwhile")
            stream, _, batch = (batch_key or "").rpartition("#")
            names = {*last["segments"], *added}
            entry = {
                "data_version": last["data_version"] + (settled_against is not None),
                "segments": {
                    name: last["segments"].get(name, []) + ([added[name]] if name in added else []) for name in names
                },
                "totals": {name: last["totals"].get(name, 0) + totals.get(name, 0) for name in {*last["totals"], *totals}}
                | {"last_run": max(last_run, last["totals"].get("last_run", 0))},
                "batches": last["batches"] | ({stream: int(batch)} if batch_key else {}),
                "block_ids": last.get("block_ids", self._block_ids),
            }
            if self.log.append(number + 1, entry):
                return

    # Merging

    def _level(self, segment: Segment) -> int:
        return max(math.ceil(math.log(max(segment["bytes"], 1) / LEAST_BYTES, max(self.merged_segments, 2))), 0)

    def _merge(self, name: str, segments: list[Segment]) -> Segment:
        rows = self._read(name, [segment["path"] for segment in segments])
        if name in schema.SUMMED:
            keys, value = schema.SUMMED[name]
            rows = rows.groupBy(*keys).agg(F.sum(value).alias(value))
        elif name in schema.ORDER and name != "document_tags":
            # Ranges of ids in each file, so that the files' statistics tell where an id is.
            rows = rows.repartitionByRange(*schema.ORDER[name]).sortWithinPartitions(*schema.ORDER[name])
        return self.write(name, rows)

    def compact(self) -> int:
        """Merge segments wherever enough of about one size have come together; returns how many were replaced.

        Each row is rewritten once for every power of ``merged_segments`` that its table grows by, and the number of
        visible segments grows with the logarithm of the table. The old folders stay, for those who read them.
        """
        replaced = 0
        for name, segments in self.snapshot().state()["segments"].items():
            levels: dict[int, list[Segment]] = {}
            for segment in segments:
                levels.setdefault(self._level(segment), []).append(segment)
            for alike in levels.values():
                if len(alike) >= self.merged_segments:
                    merged = self._merge(name, alike)
                    if self._swap(name, alike, merged):
                        replaced += len(alike)
                    else:
                        self.discard({name: merged})
        return replaced

    def _swap(self, name: str, old: list[Segment], merged: Segment) -> bool:
        """Replace segments by their merger, unless another compaction has replaced them."""
        paths = {segment["path"] for segment in old}
        while True:
            number, last = self.log.last()
            kept = [segment for segment in last["segments"][name] if segment["path"] not in paths]
            if len(kept) + len(old) != len(last["segments"][name]):
                return False
            if self.log.append(number + 1, last | {"segments": last["segments"] | {name: [merged, *kept]}}):
                return True
