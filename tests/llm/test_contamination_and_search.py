"""Decontamination, ranked search and whitening against plain versions, with odd rows, ties, repeats and empty tables."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm.contamination import find_contamination
from docsift.llm.ranked_search import TASK_SEGMENTS, deal_segments, rank_documents
from docsift.llm.whitening import dqds, top_directions, whiten

PASSAGE = [f"p{i % 17}x{i * i % 23}" for i in range(40)]
FILLER = " ".join(f"filler{i % 31} of{i * 7 % 13}" for i in range(60))
DOCUMENTS = [
    (1, " ".join(PASSAGE)), (2, "Before, " + ", ".join(PASSAGE[5:20]).upper() + "; after."), (3, " ".join(PASSAGE[:9])),
    (4, None), (5, ""), (6, " \n.,"), (7, "ÉCOLE école Ecole one two"), (8, FILLER), (8, FILLER), (9, FILLER + " " + " ".join(PASSAGE[10:])),
    (9, "two texts of one id: " + " ".join(PASSAGE[2:14])), (None, " ".join(PASSAGE[20:32])), (10, " ".join(PASSAGE[:15] * 3)),
    (11, "solo"), (12, "École one"), (13, (FILLER + " ") * 200 + " ".join(PASSAGE[25:36])), (14, "a-b_c a.b.c A B C"),
]
ITEMS = [
    (100, " ".join(PASSAGE)), (7, " ".join(PASSAGE[8:22])), (70, "Solo"), (3, None), (4, "!?"), (5, "école one"),
    (6, " ".join(PASSAGE[8:22])), (None, " ".join(PASSAGE[12:30])), (7, " ".join(PASSAGE[8:22])), (8, "a b c"),
    (9, "not anywhere in these texts at all, not even in part"),
]
EXTRA = "shingle string, words long, item_id2 string, rank int"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


@pytest.fixture(scope="module")
def frames(spark):
    documents = [(i, t, "s", i, "x", 1) for i, t in DOCUMENTS]
    items = [(i, t, "s", i, "x", 1) for i, t in ITEMS]
    return (
        spark.createDataFrame(documents, f"doc_id long, text string, {EXTRA}").repartition(3),
        spark.createDataFrame(items, f"item_id long, text string, {EXTRA}").repartition(2),
    )


def plain_contamination(documents, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    rows = []
    for doc_id, text in documents:
        w, hit, found = words(text), set(), set()
        for n in {len(window) for window in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        rows.append((doc_id, len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None))))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block", [250_000, 7])
def test_contamination_by_brute_force(frames, workspace, block):
    documents, items = frames
    found = find_contamination(documents, items, workspace, block_windows=block).collect()
    rows = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found]
    assert sorted(rows, key=repr) == plain_contamination(DOCUMENTS, ITEMS)
    assert sum(hit > 0 for _, _, hit, _ in rows) >= 8


def test_contamination_of_and_by_nothing(frames, workspace):
    documents, items = frames
    assert find_contamination(documents.limit(0), items, workspace).isEmpty()
    clean = find_contamination(documents, items.limit(0), workspace)
    assert clean.count() == len(DOCUMENTS) and clean.where("n_hit > 0 OR size(items) > 0").isEmpty()


def plain_ranking(documents, items, k):
    texts = [(i, Counter(words(t))) for i, t in documents if words(t)]
    n_all, total = len(texts), sum(sum(c.values()) for _, c in texts)
    held = Counter(term for _, c in texts for term in c)
    answers = []
    for item, text in items:
        scored = []
        for doc_id, c in texts:
            m = 100 - 25 + (25 * sum(c.values()) * n_all) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in words(text) if c[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        answers += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], start=1)]
    return sorted(answers, key=repr)


@pytest.mark.parametrize(("k", "item_bytes"), [(20, 1 << 18), (3, 40)])
def test_ranking_by_brute_force(frames, workspace, k, item_bytes):
    documents, items = frames
    found = rank_documents(documents, items, k, workspace, item_bytes=item_bytes).collect()
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in found], key=repr) == plain_ranking(DOCUMENTS, ITEMS, k)
    assert rank_documents(documents.limit(0), items, k, workspace).isEmpty()
    assert rank_documents(documents, items.limit(0), k, workspace).isEmpty()


def test_segments_of_one_file_are_dealt_over_tasks(spark, workspace):
    index = workspace.write(spark.range(0, 200, 1, 1).selectExpr("array(id, id + 1) AS doc_ids"), "index")
    dealt = deal_segments(index).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(row["count"] for row in dealt) == 200
    assert len(dealt) > 40 and max(row["count"] for row in dealt) <= 4 * TASK_SEGMENTS


def test_ranking_skips_most_blocks_and_loses_nothing(spark, workspace, monkeypatch):
    """Many documents of skewed words in a few segments, a third of them copies of one."""
    monkeypatch.setattr("docsift.llm.ranked_search.BLOCK_DOCUMENTS", 4)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 400) for _ in range(400)]
    documents = list(enumerate(texts + [texts[7]] * 200))
    items = [(n, " ".join(texts[n].split()[:12])) for n in range(0, 40, 4)]
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = rank_documents(frame, asked, 20, workspace).collect()
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in found], key=repr) == plain_ranking(documents, items, 20)


def plain_whitening(vectors):
    rows = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in vectors
            if v and all(c is not None and np.isfinite(c) for c in v)]
    distinct = np.unique(np.array([x for _, x in rows]), axis=0)
    centred = distinct - distinct.mean(axis=0)
    covariance = centred.T @ centred / len(distinct)
    values, directions = np.linalg.eigh(covariance)
    top = [k for k in np.argsort(-values)[:4] if values[k] > 1e-9 * values.max()]
    sums = distinct.sum(axis=0)
    out = {}
    for i, x in rows:
        deviation = sum((len(distinct) * int(c) - int(s)) ** 2 for c, s in zip(x, sums, strict=True))
        white = (x - sums / len(distinct)) @ directions[:, top] / np.sqrt(values[top])
        out.setdefault(i, []).append((len(distinct), deviation, white, values[top] / np.trace(covariance)))
    return out


@pytest.mark.parametrize(("width", "rows"), [(6, 300), (3, 40), (1, 9), (8, 5)])
def test_whitening_by_eigenvectors(spark, workspace, width, rows):
    rng = np.random.default_rng(width)
    made = [(n, (rng.normal(size=width) * (1 + np.arange(width)) + 3).tolist()) for n in range(rows)]
    made += [(1000, None), (1001, []), (1002, [math.nan] * width), (1003, [math.inf] + [0.0] * (width - 1)), (1004, [None] * width)]
    made += [(2000 + n, made[0][1]) for n in range(50)] + [made[1], (None, made[2][1])]
    frame = spark.createDataFrame([(*row, "x", 0) for row in made], "vec_id long, vector array<double>, x string, n int").repartition(40)
    found = whiten(frame, workspace).collect()
    expected = plain_whitening(made)
    assert {r.vec_id for r in found} == set(expected)
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    first = next(iter(expected.values()))[0]
    signs = [np.sign(by_id[3][k + 1][0].whitened * white) for k, white in enumerate(expected[3][0][2])]
    for vec_id, wanted in expected.items():
        assert sorted(by_id[vec_id]) == list(range(1, len(first[2]) + 1))
        for k, got in by_id[vec_id].items():
            assert len(got) == len(wanted)
            for r in got:
                n, deviation, white, explained = wanted[0]
                assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
                assert abs(r.whitened - signs[k - 1] * white[k - 1]) < 1e-8 and abs(r.explained - explained[k - 1]) < 1e-10


def test_whitening_of_too_little(spark, workspace):
    schema = "vec_id long, vector array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whiten(spark.createDataFrame(rows, schema), workspace).isEmpty()
    with pytest.raises(ValueError, match="entries"):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema), workspace)
    # Two directions of equal spread, one of none, and numbers beyond what squares of longs hold.
    rows = [(n, [float(2**40) * x, float(2**40) * y, 7.0]) for n, (x, y) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    found = whiten(spark.createDataFrame(rows, "vec_id long, vector array<double>"), workspace).collect()
    assert sorted({(r.component, r.n, r.deviation) for r in found}) == [(1, 4, None), (2, 4, None)]
    assert all(r.identity_error < 1e-9 and abs(r.explained - 0.5) < 1e-12 for r in found)


@pytest.mark.parametrize("kind", ["plain", "graded", "repeated", "zeros"])
def test_solver_finds_the_singular_values(kind):
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(30, 12))
    if kind == "graded":
        matrix *= 10.0 ** -np.arange(12)
    if kind == "repeated":
        matrix = np.repeat(matrix[:, :6], 2, axis=1)
    if kind == "zeros":
        matrix[:, ::3] = 0
    values, directions = top_directions(np.linalg.qr(matrix, mode="r"), 12)
    expected = np.linalg.svd(matrix, compute_uv=False) ** 2
    assert np.allclose(values, expected[: len(values)], rtol=1e-9) and np.allclose(expected[len(values) :], 0, atol=1e-12)
    assert np.abs(directions.T @ directions - np.eye(len(values))).max() < 1e-8
    assert np.allclose(np.linalg.norm(matrix @ directions, axis=0) ** 2, values, rtol=1e-6)
    # The least one is found to its own precision: together they give the determinant.
    found = np.sort(np.sqrt(dqds(np.array([3.0, 1e-9, 2.0]), np.array([1.0, 1e-3]))))
    expected = np.linalg.svd(np.diag([3.0, 1e-9, 2.0]) + np.diag([1.0, 1e-3], 1), compute_uv=False)
    assert np.allclose(found[1:], np.sort(expected)[1:], rtol=1e-12) and math.isclose(math.prod(found), 6e-9, rel_tol=1e-12)
