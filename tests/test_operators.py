"""Numbering, joins on hot keys, and what must hold of settled duplicates."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docsift.operators.dedup import resolve_duplicates
from docsift.operators.hot_join import BROADCAST_ROWS, hot_keys, join_lookup
from docsift.operators.numbering import number_rows

KEYS = "line_order bigint, doi string, content_fingerprint string"
STORED = "id bigint, doi string, content_fingerprint string"


def test_number_rows_is_dense_over_many_partitions(spark, workspace):
    frame = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k"), (F.col("id") % 5).alias("w"))
    rows = number_rows(frame.repartition(13), ["k"], "n", workspace).orderBy("k").collect()
    assert [row.n for row in rows] == list(range(10_000))
    weighted = number_rows(frame, ["k"], "before", workspace, weight="w").orderBy("k").collect()
    total = 0
    for row in weighted:
        assert row.before == total
        total += row.w


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_join_lookup_with_one_key_on_a_third_of_the_rows(spark, workspace, monkeypatch, how, broadcast_rows):
    monkeypatch.setattr("docsift.operators.hot_join.HOT_KEYS", 10)
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 200).cast("string")))
    facts = workspace.write(spark.range(3_000).select("id", key.alias("key")), "facts")
    values = [("hot", 1), *((f"k{n}", n) for n in range(0, 150))]
    lookup = workspace.write(spark.createDataFrame(values, "key string, value long"), "lookup")
    assert [row.key for row in hot_keys(facts, ["key"]).collect()] == ["hot"]
    got = join_lookup(facts, lookup, ["key"], how, workspace, broadcast_rows=broadcast_rows)
    expected = facts.join(lookup, "key", how)
    assert sorted(map(str, got.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))


def assert_settled(stored, records, decided):
    """The properties that leave one outcome only: kept records are numbered in order and share no key with an earlier
    holder; a dropped one shares one; its reason follows from who holds its keys."""
    kept = [(order, decided[order][0], doi, fp) for order, doi, fp in records if decided[order][0] is not None]
    assert [row[1] for row in kept] == list(range(len(stored) + 1, len(stored) + len(kept) + 1))
    holders = [(-1, *row) for row in stored] + kept
    with_doi = {row[2]: row for row in holders if row[2] is not None}
    with_content = {row[3]: row for row in holders if row[3] is not None}
    # No key has two holders.
    assert len(with_doi) == sum(row[2] is not None for row in holders)
    assert len(with_content) == sum(row[3] is not None for row in holders)
    for order, doi, fp in records:
        number, existing, reason = decided[order]
        same_doi, same_content = [
            row if row is not None and row[0] < order else None for row in (with_doi.get(doi), with_content.get(fp))
        ]
        if number is not None:
            assert (existing, reason, same_doi, same_content) == (None, None, None, None)
            continue
        assert existing in [row[1] for row in [same_doi or same_content] if row]
        other_content = same_doi is not None and fp not in (None, same_doi[3])
        other_doi = same_doi is None and None not in (doi, same_content[2])
        expected = {(True, False): "duplicate_conflicting_content", (False, True): "duplicate_conflicting_doi"}
        assert reason == expected.get((other_content, other_doi), "duplicate_document")


def random_records(seed, count, keys):
    rng = random.Random(seed)
    records = []
    for order in range(count):
        doi = f"d{rng.randrange(keys)}" if rng.random() < 0.7 else None
        fp = f"f{rng.randrange(keys)}" if rng.random() < 0.8 or doi is None else None
        records.append((order * 3 + 1, doi, fp))
    return records


def random_store(seed, count, keys):
    """Stored documents, no two of which share a key."""
    rng = random.Random(seed)
    dois, contents = rng.sample(range(keys), count), rng.sample(range(keys), count)
    return [
        (place + 1, f"d{doi}" if place % 4 else None, f"f{content}" if place % 5 or not place % 4 else None)
        for place, (doi, content) in enumerate(zip(dois, contents, strict=True))
    ]


def decide(spark, workspace, stored, records):
    keys = workspace.write(spark.createDataFrame(records, KEYS).repartition(3), "keys")
    rows = resolve_duplicates(keys, spark.createDataFrame(stored, STORED), len(stored), workspace).collect()
    assert len(rows) == len(records)
    return {row.line_order: (row.id, row.existing_id, row.reason) for row in rows}


@pytest.mark.parametrize(
    ("count", "keys", "stored"),
    [(400, 60, 0), (600, 300, 200), (300, 25, 20)],
)
def test_random_records_are_settled_in_order(spark, workspace, count, keys, stored):
    before = random_store(count + 1, stored, keys)
    records = random_records(count, count, keys)
    assert_settled(before, records, decide(spark, workspace, before, records))


def test_a_dropped_record_claims_no_key(spark, workspace):
    records = [(1, "d1", "x"), (2, "d1", "y"), (3, "d2", "y")]
    assert decide(spark, workspace, [], records) == {
        1: (1, None, None), 2: (None, 1, "duplicate_conflicting_content"), 3: (2, None, None),
    }


def test_long_chain_and_hot_keys(spark, workspace, monkeypatch):
    """A chain that needs many rounds, a DOI on a third of the records, and copies of one record on another third."""
    monkeypatch.setattr("docsift.operators.hot_join.HOT_KEYS", 20)
    monkeypatch.setattr("docsift.operators.hot_join.BROADCAST_ROWS", 0)
    chain = [(f"c{(n + 1) // 2}", f"g{n // 2}") for n in range(14)]
    hot = [("hot", f"h{n}") for n in range(150)] + [("copy", "copy")] * 150
    random.Random(1).shuffle(hot)
    records = [(place, *keys) for place, keys in enumerate([*chain, *hot, (None, "h3"), ("new", "h149")])]
    assert_settled([], records, decide(spark, workspace, [], records))


def test_a_chain_of_any_length_takes_two_rounds(spark, workspace):
    """Each record shares its text with one neighbour and its DOI with the other."""
    written = []
    write = workspace.write
    workspace.write = lambda frame, name, **options: (written.append(name), write(frame, name, **options))[1]
    records = [(n, f"c{(n + 1) // 2}", f"g{n // 2}") for n in range(500)]
    decided = decide(spark, workspace, [], records)
    assert [order for order in sorted(decided) if decided[order][0] is not None] == list(range(0, 500, 2))
    assert written.count("first-on-key") == 2
    assert written.count("links") <= 12


def test_steps_of_a_chain_beyond_the_bound_are_not_broadcast(spark, workspace, monkeypatch):
    """The driver would be sent the links once a step, up to the bound of a single look-up each time."""
    monkeypatch.setattr("docsift.operators.dedup.STEP_ROWS", 10)
    asked = []

    def joined(facts, lookup, keys, how, used, *bounds):
        if keys == ["root"] and how == "left":
            asked.append((used.measured(lookup)[0], bounds[0] if bounds else BROADCAST_ROWS))
        return join_lookup(facts, lookup, keys, how, used, *bounds)

    monkeypatch.setattr("docsift.operators.dedup.join_lookup", joined)
    records = [(n, f"c{(n + 1) // 2}", f"g{n // 2}") for n in range(60)]
    decided = decide(spark, workspace, [], records)
    assert [order for order in sorted(decided) if decided[order][0] is not None] == list(range(0, 60, 2))
    assert asked and all(rows > bound for rows, bound in asked)


def test_missing_fingerprint_of_the_stored_record_is_a_conflict(spark, workspace):
    stored = [(1, "d1", None)]
    assert decide(spark, workspace, stored, [(5, "d1", "x"), (6, "d1", None)]) == {
        5: (None, 1, "duplicate_conflicting_content"), 6: (None, 1, "duplicate_document"),
    }
