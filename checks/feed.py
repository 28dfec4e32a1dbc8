"""A noisy feed of JSON lines, derived from every row of ``documents`` and ``pages``.

The rules are those of FIXTURES.md section 5; checks/oracle.py states them again in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lines of later files come after all lines of earlier ones.
FILE_STEP = 2**40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt evenly over the session's shuffle partitions, however few files or row groups they come from.

    The work on a row is far more than moving it. The number is named, so that no partitions are put together.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def quoted(text: Column) -> Column:
    """The text as a JSON string."""
    # {"v":"..."} without its first five bytes and its last one; counting characters would read the text again.
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.substring(wrapped.cast("binary"), F.lit(6), F.octet_length(wrapped) - 6).cast("string")


def _first_of(number: Column, cases: dict[int, Column | str], otherwise: Column | None = None) -> Column:
    """The JSON of the first divisor in ``cases`` that divides ``number``."""
    chain = F
    for divisor, value in cases.items():
        chain = chain.when(number % divisor == 0, F.lit(value) if isinstance(value, str) else value)
    return chain.otherwise(otherwise) if otherwise is not None else chain


def _by_remainder(number: Column, values: list[Column | str | None]) -> Column:
    """The JSON at place ``number % len(values)``; None leaves the field out."""
    chain = F
    for place, value in enumerate(values):
        if value is not None:
            value = F.lit(value) if isinstance(value, str) else value
            chain = chain.when(number % len(values) == place, value)
    return chain


def feed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, whole (a line that is no record, or null), title and the other fields as JSON text."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"))
    page_count = pages.count()
    documents = spread(table(spark, sf_dir, "documents").withColumn("page_id", F.col("doc_id") % page_count), "page_id")
    i, text, lang, source = (F.col(name) for name in ("doc_id", "text", "lang", "source"))
    published = F.date_add(F.lit("2020-01-01").cast("date"), (i % 1500).cast("int"))
    updated = F.date_add(published, (i % 9 - 3).cast("int"))
    compact = F.date_format(published, "yyyyMMdd")
    iso = quoted(published.cast("string"))
    title = _first_of(i, {97: "null", 89: '"   "', 83: "8", 29: '"Untitled report"'},
                      quoted(F.concat(F.lit("  "), F.substring_index(text, "\n", 1), F.lit("  "))))
    languages, tagged = quoted(lang), quoted(F.concat(F.lit(" "), F.upper(source), F.lit(" ")))
    fields = {
        "external_id": quoted((i % 200).cast("string")),
        "abstract": _by_remainder(i, [quoted(F.substring_index(text, "\n", -1)), '""', None]),
        "body": F.when(i % 11 != 3, quoted(text)),
        "published_at": _by_remainder(
            i, [iso, compact, quoted(compact), '"soon"', "null", '"2021-02-30"', iso]
        ),
        "updated_at": quoted(updated.cast("string")),
        "status": _by_remainder(i, ['"PUBLISHED"', '" draft "', '"archived"', '"review"', "false", None]),
        "author_name": _first_of(i, {13: '" not Applicable "'}, quoted(F.concat(F.lit("Author "), (i % 50).cast("string")))),
        "organization_name": _first_of(i, {17: "[1907]"}, quoted(source)),
        "tags": _by_remainder(i, [
            F.concat(F.lit("["), languages, F.lit(","), tagged, F.lit(","), languages, F.lit("]")),
            quoted(F.concat(lang, F.lit(", "), source, F.lit(","), lang)),
            "null",
            F.concat(F.lit("["), languages, F.lit(',"",null,4]')),
        ]),
        "document_type": F.lit('" REPORT "'),
        "language": _first_of(i, {19: '"English"', 23: '"xx"'}, languages),
        "url": F.when(i % 5 == 1, '"https:///catalog"').when(i % 5 == 2, '"http://reader@library.test/"')
        .otherwise(quoted(F.col("page_url"))),
        "doi": F.when(i % 2 == 0, quoted(F.concat(F.lit("10.1234/DOC-"), (i % 400).cast("string"))))
        .when(i % 4 == 1, '"doi 10.77"'),
        "open_access": _by_remainder(i, ['"FALSE"', "true", '" 1"', "0", "false", '"Yes "', "1.0", '"maybe"']),
        "citation_count": _by_remainder(i, [i.cast("string"), "-1", '"12"', "1.5", "true"]),
        "word_count": F.col("n_chars").cast("string"),
    }
    return documents.join(pages, "page_id").select(
        i,
        _first_of(i, {101: '{"title": "torn off', 103: "[]", 107: ""}).alias("whole"),
        title.alias("title"),
        F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()]).alias("rest"),
    )


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, source_line, line_order, raw: every document as a line, some a second time as a repost."""
    records = feed_records(spark, sf_dir)
    i = F.col("doc_id")

    def line(file: Column, title: Column) -> Column:
        raw = F.coalesce("whole", F.concat(F.lit('{"title":'), title, F.lit(","), F.col("rest"), F.lit("}")))
        return F.struct(
            F.concat(F.lit("part-"), file.cast("string")).alias("source_file"),
            i.alias("source_line"),
            (file * FILE_STEP + i).alias("line_order"),
            raw.alias("raw"),
        )

    repost = F.when(
        F.col("whole").isNull() & (i % 22 == 3),
        line(F.lit(9), F.replace("title", F.lit(" "), F.lit("  "))),
    )
    return records.select(F.inline(F.array_compact(F.array(line(i % 3, F.col("title")), repost))))
