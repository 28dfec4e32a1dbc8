from __future__ import annotations

import json

import pytest
from pyspark.sql import SparkSession

from docsift.session import Workspace
from docsift.sources.store import DocumentStore


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("docsift-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def workspace(spark):
    with Workspace(spark) as workspace:
        yield workspace


@pytest.fixture
def store(spark, tmp_path):
    return DocumentStore(spark, str(tmp_path / "store"))


@pytest.fixture
def lines_of(spark):
    """A frame of lines from records (written as JSON) or ready-made strings."""

    def build(*records, file="records.jsonl"):
        raws = [record if isinstance(record, str) else json.dumps(record) for record in records]
        return spark.createDataFrame(
            [(file, place + 1, place, raw) for place, raw in enumerate(raws)],
            "source_file string, source_line bigint, line_order bigint, raw string",
        )

    return build
