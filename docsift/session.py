"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# So many keys of a look-up are handed to the scan, which asks the files' statistics and Bloom filters for them.
IN_LIST = 200


def prepare(spark: SparkSession) -> SparkSession:
    """Set the run-time options the column expressions rely on."""
    # A repeated key keeps its last value instead of making the whole line invalid.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(IN_LIST))
    return spark


def session_with(spark: SparkSession, options: dict[str, str]) -> SparkSession:
    """A session like this one but for some run-time options."""
    own = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    for name, value in options.items():
        own.conf.set(name, value)
    return own


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session may do without it; a cluster must name a shared folder, because tables
    written to one machine's disk are lost with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    # One process only: local-cluster[...] starts executors of their own.
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="docsift-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def side_by_side(actions: list[Callable]) -> list:
    """The results of actions that do not depend on each other, whose jobs Spark may run at the same time."""
    with ThreadPoolExecutor(max(len(actions), 1)) as pool:
        return [future.result() for future in [pool.submit(action) for action in actions]]


def size_of(frame: DataFrame) -> list[Column]:
    """The number of a frame's rows, and the bytes of all its columns as text."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in frame.columns), F.lit(0))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")]


class Workspace:
    """Written intermediate tables of one job.

    A written table cuts the lineage, survives the loss of executors, lets every later step read only the
    columns it needs, and gives the planner a real size. Use as a context manager to delete it afterwards.
    """

    def __init__(self, spark: SparkSession, base: str | None = None) -> None:
        self.spark = prepare(spark)
        self.path = f"{base or shared_folder(spark)}/work-{uuid.uuid4().hex}"
        self._tables = count(1)
        self._measured: dict[DataFrame, tuple[int, int]] = {}

    def folder(self, name: str) -> str:
        return f"{self.path}/{next(self._tables):03d}-{name}"

    def write(self, frame: DataFrame, name: str, measure: bool = False) -> DataFrame:
        """The frame as a written table. With ``measure`` its rows and bytes are counted while it is written."""
        path = self.folder(name)
        seen = Observation()
        if measure:
            frame = frame.observe(seen, *size_of(frame))
        frame.write.parquet(path)
        table = self.spark.read.schema(frame.schema).parquet(path)
        if measure:
            self._measured[table] = seen.get["rows"], seen.get["bytes"]
        return table

    def measured(self, frame: DataFrame) -> tuple[int, int]:
        """The rows of a written table, and the bytes of all its columns as text."""
        if frame not in self._measured:
            self._measured[frame] = tuple(frame.agg(*size_of(frame)).first())
        return self._measured[frame]

    def same_size(self, view: DataFrame, table: DataFrame) -> None:
        """Take a view of a measured table, with no other rows and no wider columns, to be as large as the table."""
        self._measured[view] = self._measured[table]

    def delete(self) -> None:
        delete_folder(self.spark, self.path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.delete()
