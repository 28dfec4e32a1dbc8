"""Headline timings on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

The noisy feed of FIXTURES.md is derived from the tables and landed as line files before the clock starts.
Each entry: one warm-up, then the median of $BENCH_RUNS runs; of the two imports, a single run.
"""

from __future__ import annotations

import json
import os
import statistics as stats
import sys
import time
from datetime import date
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.feed import feed_lines  # noqa: E402
from checks.queries import fresh_folder, landed_feed  # noqa: E402
from docsift.operators.dedup import resolve_duplicates  # noqa: E402
from docsift.operators.normalize import fingerprint_records, normalize_lines, record_keys  # noqa: E402
from docsift.plans.intake import intake  # noqa: E402
from docsift.plans.review import document_details, list_documents  # noqa: E402
from docsift.plans.stats import statistics  # noqa: E402
from docsift.session import Workspace  # noqa: E402
from docsift.sources.lines import read_lines  # noqa: E402
from docsift.sources.store import DocumentStore  # noqa: E402

CPUS = os.environ.get("BENCH_CPUS", "8")
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def discard(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action, runs: int = RUNS) -> float:
    action()
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(stats.median(seconds), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("docsift-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = landed_feed(spark, SF_DIR)
    lines = feed_lines(spark, SF_DIR).count()
    store = DocumentStore(spark, fresh_folder(spark, "bench-store"))
    results: dict[str, float] = {}

    def import_new() -> None:
        nonlocal store
        store = DocumentStore(spark, fresh_folder(spark, "bench-store"))
        intake(spark, folder, store, folder=True)

    results["import_new"] = timed(import_new, runs=1)
    results["import_again"] = timed(lambda: intake(spark, folder, store, folder=True), runs=1)
    with Workspace(spark) as workspace:
        read = workspace.write(read_lines(spark, folder, workspace, folder=True), "lines")
        results["normalize_and_fingerprint"] = timed(lambda: discard(fingerprint_records(normalize_lines(read))))
        keys = workspace.write(record_keys(workspace.write(fingerprint_records(normalize_lines(read)), "r")), "keys")
        nothing = spark.createDataFrame([], "id bigint, doi string, content_fingerprint string")
        results["resolve_duplicates"] = timed(lambda: discard(resolve_duplicates(keys, nothing, 0, workspace)))
    results["scan_numbered_lines"] = timed(lambda: discard(read_lines(spark, folder, Workspace(spark), folder=True)))
    results["list_tag_and_text"] = timed(lambda: list_documents(store, tag="en", q="tion").items.collect())
    results["list_by_score"] = timed(
        lambda: list_documents(store, date_from=date(2020, 3, 1), sort="score", page=3).items.collect()
    )
    results["document_details"] = timed(lambda: discard(document_details(store)))
    results["stats_report"] = timed(lambda: statistics(store).collect())
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": float(Path(SF_DIR).name.removeprefix("sf") or 0),
                "lines": lines,
                "lines_per_second": {
                    name: round(lines / results[name]) for name in
                    ("import_new", "import_again", "normalize_and_fingerprint", "resolve_duplicates", "scan_numbered_lines")
                },
            }
        )
    )


if __name__ == "__main__":
    main()
