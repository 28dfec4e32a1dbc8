"""Strict JSON at any length: what is valid is decoded, what is malformed is null."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsift.functions.json_values import decode, decoded_value, text_of
from docsift.session import prepare

LONG = 20_000_001
VALID = {
    "a number of many digits": f'{{"n":{"4" * 1_200},"t":"x"}}',
    "a fraction of many digits": f'{{"n":0.{"4" * 1_200},"t":"x"}}',
    "a long name": f'{{"{"k" * 60_000}":1,"t":"x"}}',
    "a long name with escapes at the cut": f'{{"{"k" * 998}{chr(92)}u00e9{chr(92)}{chr(34)}{"k" * 60_000}" :1,"t":"x"}}',
    "a long value that reads like a name": f'{{"v":"{"k" * 60_000}{chr(92)}":1","t":"x"}}',
    "deep nesting": f'{{"n":{"[" * 990}{"]" * 990},"t":"x"}}',
    "a long name of runs and escapes": f'{{"{("k" * 45 + chr(92) + "u00e9") * 1_500}":1,"t":"x"}}',
    "a long name of letters beyond ASCII": f'{{"{"é" * 60_000}":1,"t":"x"}}',
    "a long line with a short escaped name": f'{{"v":"{"k" * 60_000}","{chr(92)}u0074":"x"}}',
    "a repeated name": '{"t":"first","t":"x"}',
}
MALFORMED = {
    "a long name with a bad escape": f'{{"{"k" * 60_000}{chr(92)}q":1,"t":"x"}}',
    "a long name with a control character": f'{{"{"k" * 60_000}\x01":1,"t":"x"}}',
    "a long text without an end": f'{{"t":"{"x" * 60_000}',
    "text behind the value": '{"t":"x"} y',
    "text behind the array": '{"t":"x"}] y',
    "two values": '{"t":"x"},{"t":"x"}',
    "no number": '{"t":"x","n":NaN}',
    "single quotes": "{'t':'x'}",
    "a comment": '{"t":"x"}//',
    "a leading zero": '{"t":"x","n":01}',
    "a comma at the end": '{"t":"x",}',
}


def decoded_text():
    return text_of(F.try_variant_get(decoded_value(decode(F.col("raw"))), "$.t", "variant")).alias("t")


@pytest.mark.parametrize(("cases", "expected"), [(VALID, "x"), (MALFORMED, None)])
def test_lines(spark, cases, expected):
    prepare(spark)
    frame = spark.createDataFrame(list(cases.items()), "name string, raw string")
    rows = frame.select("name", decoded_text()).collect()
    assert {row.name: row.t for row in rows} == dict.fromkeys(cases, expected)


def test_texts_beyond_the_usual_limit(spark):
    prepare(spark)
    text = F.repeat(F.lit("xyz"), LONG // 3 + 1)
    whole = spark.range(1).select(F.concat(F.lit('{"t":"'), text, F.lit('"}')).alias("raw"))
    assert whole.select(F.length(decoded_text())).first()[0] == (LONG // 3 + 1) * 3
    torn = spark.range(1).select(F.concat(F.lit('{"t":"'), text).alias("raw"))
    assert torn.select(decoded_text()).first().t is None
