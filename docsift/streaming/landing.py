"""Files that land in a folder, imported as a stream, a run for each file."""

from __future__ import annotations

import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docsift.plans.intake import intake_files
from docsift.session import delete_folder, session_with, shared_folder
from docsift.sources.lines import BY_LANDING, SUFFIXES, number_lines, read_text
from docsift.sources.store import DocumentStore

ANY_AGE = "1000000d"
# A batch costs some sixty Spark jobs whatever is in it, so small files are taken together.
FILES_PER_BATCH = 50_000
# For many small files: a batch's files are listed by so many tasks, not by one each, and opening a file counts as reading
# so many bytes when files are dealt to tasks. Both change only which task does what.
SMALL_FILES = {
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.files.openCostInBytes": str(256 * 1024),
}
# So many files are renamed at a time.
RENAMES = 16


def land_lines(lines: DataFrame, folder: str, name: str, by: str | None = None) -> list[str]:
    """Write a frame with a text column ``raw`` as line files into the landing folder; returns the file names.

    The files are written elsewhere and then renamed into place under a unique name, so a stream never sees half a
    file. There is one file per partition, in partition order. With ``by``, a column of whole numbers by which each
    partition is sorted, a partition has a file for each number, and files are in the order of numbers: many small files
    need few tasks.
    """
    if not name.lower().endswith(SUFFIXES):
        raise ValueError(f"the name of a line file ends with one of {', '.join(SUFFIXES)}: {name}")
    spark = lines.sparkSession
    jvm = spark._jvm
    batch, landed_at = uuid.uuid4().hex, int(time.time() * 1000)
    staging = f"{shared_folder(spark)}/landing-{batch}"
    if by is None:
        lines.select("raw").write.option("lineSep", "\n").text(staging)
    else:
        lines.select("raw", by).write.option("lineSep", "\n").partitionBy(by).text(staging)
    path = jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    stem, suffix = name.rsplit(".", 1)
    found = files.globStatus(path(staging, "part-*" if by is None else f"{by}=*/part-*"))
    # All names in one text, as asking for each takes longer than renaming it.
    listed = jvm.scala.runtime.ScalaRunTime.stringOf(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))
    written = re.findall(rf"/landing-{batch}/([^,)]+)", listed)
    written.sort(key=lambda file: (int(file.split("/")[0].split("=")[1]) if by else 0, file))

    def land(place: int) -> str:
        target = f"{batch}_{stem}-{place:06d}.{suffix}" if len(written) > 1 else f"{batch}_{name}"
        source = path(f"{staging}/{written[place]}")
        # The files are imported in the order of landing, which their time stamps tell.
        files.setTimes(source, landed_at + place, -1)
        if not files.rename(source, path(f"{folder}/{target}")):
            raise OSError(f"unable to land {target}")
        return target

    with ThreadPoolExecutor(RENAMES) as pool:
        landed = list(pool.map(land, range(len(written))))
    delete_folder(spark, staging)
    return landed


def import_landing_folder(
    spark: SparkSession, folder: str, store: DocumentStore, checkpoint: str, files_per_batch: int = FILES_PER_BATCH
) -> StreamingQuery:
    """Import all files that have landed and not been imported yet, then stop.

    Each file is a run of its own, in the order of landing; the files of a batch are numbered, settled and counted
    together, and published by one entry of the store's log. Known documents live in the store, not in streaming state,
    so the state does not grow. A batch that is repeated after a failure finds itself published and does nothing.
    """
    # Without this, files more than a week older than the newest one would never be imported.
    reader = session_with(spark, SMALL_FILES).readStream.option("maxFilesPerTrigger", files_per_batch)
    reader = reader.option("maxFileAge", ANY_AGE)

    def import_batch(batch: DataFrame, batch_id: int) -> None:
        key = f"{checkpoint}#{batch_id}"
        if not store.has_batch(key):
            intake_files(lambda workspace: number_lines(batch, workspace, BY_LANDING), store, batch_key=key)

    return (
        read_text(reader, folder)
        .writeStream.foreachBatch(import_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
