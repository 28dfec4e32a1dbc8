"""Line files as rows: text, file name, line number and import order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.operators.hot_join import BROADCAST_BYTES, BROADCAST_ROWS, small_enough
from docsift.operators.numbering import number_rows
from docsift.session import Workspace

SUFFIXES = (".jsonl", ".ndjson")
# The same suffixes as a file name pattern, in any mix of upper and lower case.
NAME_PATTERN = "*.{[jJ][sS][oO][nN][lL],[nN][dD][jJ][sS][oO][nN]}"


def _as_pattern(path: str) -> str:
    """A path pattern that stands for just this path."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _refuse_hidden(name: str) -> None:
    """Spark passes over such files, so their lines would be missing without a word."""
    if name.startswith(("_", ".")):
        raise ValueError(f"{name}: Spark takes names that begin with _ or . for hidden files; rename it")


def input_files(spark: SparkSession, path: str, folder: bool = False) -> str:
    """Check ``path`` and return it as a pattern: a line file, or with ``folder=True`` a folder with some.

    Anything else, and line files that Spark would pass over, are refused with ValueError.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        raise ValueError(f"no such file or folder: {path}")
    if folder and files.getFileStatus(target).isDirectory():
        names = [status.getPath().getName() for status in files.listStatus(target) if status.isFile()]
        names = [name for name in names if name.lower().endswith(SUFFIXES)]
        if not names:
            raise ValueError(f"the folder has no line file ({', '.join(SUFFIXES)}): {path}")
        for name in names:
            _refuse_hidden(name)
        return _as_pattern(path)
    if not files.getFileStatus(target).isFile():
        raise ValueError(f"a folder is given where one file is asked for: {path}")
    if not target.getName().lower().endswith(SUFFIXES):
        raise ValueError(f"the name of a line file ends with one of {', '.join(SUFFIXES)}: {path}")
    _refuse_hidden(target.getName())
    return _as_pattern(path)


def read_text(reader, path: str) -> DataFrame:
    """Raw lines with their file and block; ``reader`` is ``spark.read`` or ``spark.readStream``."""
    lines = reader.option("lineSep", "\n").option("pathGlobFilter", NAME_PATTERN).text(path)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


BY_NAME = ("source_file", "file_path")
BY_LANDING = ("landed_at", "source_file", "file_path")


def number_lines(text: DataFrame, workspace: Workspace, order: tuple[str, ...] = BY_NAME) -> DataFrame:
    """source_file, source_line (from 1), line_order (over all files in the given order), file_number (from 0), raw.

    Rows of one block of a file are consecutive in their task, so a line's number is its place in its
    block plus the lines of the blocks before. The lines are scanned once, into a written table that fixes
    which line is where, however the input might be split at another scan; everything else reads that table.
    One narrow pass over it counts lines per block; the counts are broadcast, or with very many blocks joined
    by block, which is even because blocks are. Files are numbered over ranges of their order.
    """
    placed = workspace.write(text.withColumn("row_id", F.monotonically_increasing_id()), "lines")
    counted = placed.groupBy(*BY_LANDING, "block_start").agg(F.count("*").alias("lines"), F.min("row_id").alias("first_row"))
    counted = workspace.write(counted, "blocks")
    in_file = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    per_file = counted.groupBy(*BY_LANDING).agg(F.sum("lines").alias("file_lines"))
    files = number_rows(per_file, list(order), "lines_before_file", workspace, weight="file_lines", number="file_number")
    offsets = workspace.write(
        counted.withColumn("lines_before_block", F.coalesce(F.sum("lines").over(in_file), F.lit(0)))
        .join(files.select("file_path", "lines_before_file", "file_number"), "file_path")
        .select("file_path", "block_start", "first_row", "lines_before_block", "lines_before_file", "file_number"),
        "block-offsets", measure=True,
    )
    if small_enough(offsets, BROADCAST_ROWS, BROADCAST_BYTES, workspace):
        offsets = F.broadcast(offsets)
    line = F.col("lines_before_block") + F.col("row_id") - F.col("first_row")
    return placed.join(offsets, ["file_path", "block_start"]).select(
        "source_file",
        (line + 1).alias("source_line"),
        (F.col("lines_before_file") + line).alias("line_order"),
        "file_number",
        F.rtrim(F.col("value"), F.lit("\r\n")).alias("raw"),
    )


def read_lines(spark: SparkSession, path: str, workspace: Workspace, folder: bool = False) -> DataFrame:
    """Scan one line file, or all line files of a folder."""
    return number_lines(read_text(spark.read, input_files(spark, path, folder)), workspace)
