"""Trained operators: recall against brute force, and likelihood on held-out documents."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash

from docsift.llm.masked_lm import (
    Network, Settings, classes_of, documents_of, encode, hashes_of, lowered_words, score_blocks, score_documents,
    surroundings, train,
)
from docsift.llm.neighbour_partitions import Settings as IndexSettings
from docsift.llm.neighbour_partitions import nearest
from pyspark.sql import functions as F


def test_neighbours_by_brute_force(spark, workspace):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, vector.tolist(), "x") for i, vector in enumerate(vectors)]
    common = rows[7][1]
    rows += [(2000 + i, common, "x") for i in range(300)]
    rows += [(5000, None, "x"), (5020, [0.0] * 16, "x"), (5040, [float("nan")] * 16, "x"), (5060, [None] * 16, "x"),
             (None, rows[3][1], "x"), rows[20], rows[20]]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<float>, part string").repartition(4)
    found = nearest(frame, F.col("vec_id") % 20 == 0, 20, workspace, IndexSettings(candidate_block=200, query_block=30)).collect()
    ids = np.array([r[0] for r in rows[:1800]])
    matrix = np.array([r[1] for r in rows[:1800]], dtype=np.float32).astype(np.float64)
    hits, queries = 0, sorted({int(i) for i in ids if i % 20 == 0})
    by_query = {}
    for row in found:
        by_query.setdefault(row.query_id, []).append(row)
    assert sorted(by_query) == queries
    for query in queries:
        mine = sorted(by_query[query], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and len({r.vec_id for r in mine}) == 20
        scores = (matrix * matrix[np.flatnonzero(ids == query)[0]]).sum(axis=1)
        order = [int(i) for i in ids[np.lexsort((ids, -scores))] if i != query][:20]
        hits += len(set(order) & {r.vec_id for r in mine})
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        place = {int(i): s for i, s in zip(ids, scores, strict=True)}
        assert all(abs(place[r.vec_id] - r.score) < 1e-12 for r in mine)
    assert hits / (20 * len(queries)) >= 0.9


def test_neighbours_of_few_and_none(spark, workspace):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, vector array<float>")
    found = nearest(frame, F.col("vec_id") % 20 == 0, 20, workspace).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [
        (0, 1, 20, 1.0), (0, 2, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 0.5)
    ]
    assert nearest(frame.limit(0), F.col("vec_id") % 20 == 0, 20, workspace).collect() == []


def sentences(rng, n):
    """The word in the middle follows from its neighbours."""
    subjects = [f"subject{i}" for i in range(6)]
    return [
        " ".join(f"{s} verb{s[7:]}{o[6:]} {o} ." for s, o in zip(rng.choice(subjects, 12), rng.choice(
            [f"object{i}" for i in range(6)], 12), strict=True)) for _ in range(n)
    ]


def test_network_beats_word_counts_on_held_out_documents(spark, workspace):
    rng = np.random.default_rng(4)
    settings = Settings(rounds=2, batch=512)
    frame = spark.createDataFrame(list(enumerate(sentences(rng, 1500))), "doc_id long, text string").repartition(3)
    blocks = workspace.write(encode(frame), "blocks")
    network = Network(settings, train(blocks, settings))
    found = blocks.toArrow().to_batches()
    seen = np.concatenate([
        classes for batch in found for place in range(batch.num_rows)
        for classes in documents_of({name: batch.column(name)[place] for name in batch.schema.names}, settings)
    ])
    held_out = [classes_of(hashes_of(lowered_words(text)), settings) for text in sentences(rng, 100)]
    around, held_out = surroundings(held_out, settings)
    counts = np.log((np.bincount(seen, minlength=settings.classes) + 1) / (len(seen) + settings.classes))
    assert network.log_chances(around, held_out).mean() > 0.5 * counts[held_out].mean()


def plain_chances(network, settings, around):
    """Every class's probability at one place, worked out in double precision, one class after the other."""
    hidden = sum(network.tables[side][number].astype(float) for side, number in enumerate(around)) + network.bias
    hidden = np.maximum(hidden, 0)
    upper = np.exp(hidden @ network.upper + network.upper_bias)
    result = []
    for number in range(settings.half):
        lower = np.exp(hidden @ network.lower[number] + network.lower_bias[number])
        result += [upper[number] / upper.sum() * share / lower.sum() for share in lower]
    return np.array(result)


def test_scores_by_a_plain_loop(spark, workspace):
    """Few classes, so that most hold many words; blocks of a few documents; some words occur once, some often."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"W{int(n)}" for n in rng.zipf(1.4, size=size) % 3000) for size in rng.integers(0, 60, size=90)]
    texts += [None, "", "\t \x0b", texts[3], texts[3], "Ünïcode w1\u00a0w1 \x1f w2", "often " * 900]
    rows = [(None if i == 4 else i, text, "x") for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    settings = Settings(half_bits=2, rounds=2, batch=64)
    blocks = workspace.write(encode(frame, 200), "blocks")
    weights = train(blocks, settings)
    network = Network(settings, weights)
    split = [[w for w in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
             for text in texts]
    counts = Counter(word for words in split for word in words)
    class_of = {word: xxhash.xxh64_intdigest(word.encode()) % settings.classes for word in counts}
    in_class = Counter()
    for word, n in counts.items():
        in_class[class_of[word]] += n
    found = score_blocks(blocks, weights, settings).collect()
    assert blocks.count() > 10 and len(found) == len(texts)
    found = {row.doc_id: row for row in found}
    for place, words in enumerate(split):
        beyond = [settings.classes] * 2
        numbers = beyond + [class_of[word] for word in words] + beyond
        total = 0.0
        for at, word in enumerate(words, 2):
            chances = plain_chances(network, settings, [numbers[at + side] for side in (-2, -1, 1, 2)])
            total += np.log(chances[class_of[word]] * counts[word] / in_class[class_of[word]])
        row = found[None if place == 4 else place]
        assert row.n_tokens == len(words)
        assert abs(row.log_likelihood - total) < 1e-4 * max(len(words), 1)
        assert (row.mean_log_likelihood is None) == (not words)
    # At any place the probabilities of all words sum to one.
    chances = plain_chances(network, settings, [0, 1, 2, settings.classes])
    all_words = sum(chances[class_of[word]] * n / in_class[class_of[word]] for word, n in counts.items())
    assert abs(all_words - sum(chances[c] for c in in_class)) < 1e-9
    assert abs(chances.sum() - 1) < 1e-9


def test_words_of_one_class_differ_in_their_counts(spark, workspace):
    """Two documents that differ by one word of the same class: the rarer word makes the document less likely."""
    settings = Settings(half_bits=1)
    alike = [f"w{n}" for n in range(200) if xxhash.xxh64_intdigest(f"w{n}".encode()) % settings.classes == 1][:2]
    texts = [f"a {alike[0]} b", f"a {alike[1]} b", *[alike[0]] * 50]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {row.doc_id: row.log_likelihood for row in score_documents(frame, workspace, settings).collect()}
    assert abs(found[0] - found[1] - np.log(51)) < 1e-4


def test_scores_of_odd_rows(spark, workspace):
    texts = [None, "", "one", "a b c d", "a b c d", "A B c d " * 3000]
    rows = [(i if i != 2 else None, text, 1.0) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double")
    found = {row.doc_id: row for row in score_documents(frame, workspace).collect()}
    assert len(found) == len(texts)
    assert found[0].n_tokens == 0 and found[0].log_likelihood == 0 and found[0].mean_log_likelihood is None
    assert found[3].n_tokens == 4 and abs(found[3].log_likelihood - found[4].log_likelihood) < 1e-4
    assert found[5].n_tokens == 12000 and found[5].mean_log_likelihood > found[3].mean_log_likelihood
    assert score_documents(frame.limit(0), workspace).collect() == []
