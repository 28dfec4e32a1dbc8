"""Every driver query against its SQL counterpart in DuckDB, on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from checks.queries import QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def oracle(spark):
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    statements = driver.oracle_sql()
    assert set(statements) >= set(QUERIES)
    return lambda name: connection.execute(statements[name]).fetch_df()


def as_rows(frame):
    columns = sorted(frame.columns)

    def shown(value):
        return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)

    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(tuple(None if v is None else shown(v) for v in row) for row in values.map(
        lambda v: "" if v is None else v).values.tolist())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, oracle, name):
    ours = as_rows(driver.queries()[name](spark, str(SF_DIR)).toPandas())
    theirs = as_rows(oracle(name))
    assert ours == theirs


@pytest.mark.parametrize("name", ["long_values", "norm_url"])
def test_costly_rows_are_dealt_over_all_tasks(spark, name):
    """However few files and row groups hold them."""
    assert len(list((SF_DIR).glob("documents.parquet"))) == 1
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    query = driver.queries()[name](spark, str(SF_DIR))
    assert query.select(F.spark_partition_id()).distinct().count() == shuffle


def test_a_long_line_is_decoded_once(spark):
    plan = driver.queries()["long_values"](spark, str(SF_DIR))._jdf.queryExecution().optimizedPlan().toString()
    # The second reading is for lines beyond what a VARIANT holds.
    assert plan.count("from_json(") <= 3


def test_entry_runs(spark):
    assert driver.entry(spark).columns == ["metric", "key", "value"]


@pytest.mark.parametrize("name, numbers", [("record_fingerprints", (3, 25)), ("content_fingerprints", (4, 5))])
def test_fingerprints_of_texts_that_need_nfkc(spark, tmp_path, name, numbers):
    """A line has the fingerprint of its plain form, not none."""
    found = []
    for form, word in (("odd", "ﬁve Ⅷ"), ("plain", "five VIII")):
        folder = tmp_path / form
        documents = [(n, f"{word} {n}\nlast {word}", "en", "src1", 10) for n in numbers]
        columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        spark.createDataFrame(documents, columns).write.parquet(str(folder / "documents.parquet"))
        page = spark.createDataFrame([(0, "https://a.test/")], "page_id bigint, url string")
        page.write.parquet(str(folder / "pages.parquet"))
        rows = driver.queries()[name](spark, str(folder)).collect()
        # A repost of a line is another line.
        found.append({(row.source_file, row.source_line): row.content_fingerprint for row in rows})
    odd, plain = found
    assert {line for _, line in odd} == set(numbers)
    assert odd == plain and None not in odd.values()
