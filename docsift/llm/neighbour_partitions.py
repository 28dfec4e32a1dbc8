"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample: the sample's neighbour graph is cut into balanced parts with few edges between them, and a
small network learns from each vector which parts hold its neighbours. Indexing: every vector goes to the part the
network thinks most probable. Searching: a query goes to its several most probable parts and is compared with all of
their vectors. Nearness is the inner product.

Equal vectors are indexed once, with as many of their smallest ids as an answer can hold, so a very common vector is one
row. Parts are cut into blocks of bounded size, and every block of candidates meets every block of its part's queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.session import Workspace

# Scores that differ by less are looked at as ties until they are computed exactly.
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds what the partition is fitted on; ``parts`` should grow with the table.

    ``probes`` is set for a recall of 0.9 and more on vectors without much structure, whose neighbours lie in all
    directions; where vectors form clusters, a few parts are enough.
    """

    sample: int = 8192
    graph_neighbours: int = 50
    parts: int = 16
    probes: int = 12
    hidden: int = 128
    epochs: int = 40
    candidate_block: int = 8192
    query_block: int = 2048
    seed: int = 7


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each vector (all, if there are fewer)."""
    k = min(k, len(vectors) - 1)
    near = np.zeros((len(vectors), k), dtype=np.int64)
    for at in range(0, len(vectors), 1024):
        scores = vectors[at : at + 1024] @ vectors.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        near[at : at + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return near


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """A part for each node: parts are grown along edges, then nodes move to where most of their neighbours are.

    No part gets more than a twentieth above its share.
    """
    n = len(near)
    limit = int(np.ceil(1.05 * n / parts))
    links: list[list[int]] = [list(row) for row in near.tolist()]
    for node, row in enumerate(near.tolist()):
        for other in row:
            links[other].append(node)
    part = np.full(n, -1)
    order = rng.permutation(n).tolist()
    share = -(-n // parts)
    number, size, frontier = 0, 0, []
    remaining = iter(order)
    for _ in range(n):  # grow one part after the other, breadth first
        node = next((x for x in iter(lambda: frontier.pop(0) if frontier else None, None) if part[x] < 0), None)
        if node is None:
            node = next(x for x in remaining if part[x] < 0)
        part[node] = number
        size += 1
        frontier += [x for x in links[node] if part[x] < 0]
        if size == share:
            number, size, frontier = min(number + 1, parts - 1), 0, []
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for node in rng.permutation(n).tolist():
            votes = np.bincount(part[links[node]], minlength=parts)
            votes[(sizes >= limit) & (np.arange(parts) != part[node])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[node]]:
                sizes[part[node]] -= 1
                sizes[best] += 1
                part[node] = best
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer: the probability that a part holds a vector's neighbours."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        hidden = np.maximum(vectors / lengths @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias

    def parts(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The most probable parts of each vector, best first."""
        return np.argsort(-self.logits(vectors), axis=1, kind="stable")[:, :probes]


def train_router(vectors: np.ndarray, targets: np.ndarray, settings: Settings) -> Router:
    """Cross entropy with the shares of a vector's neighbourhood in each part, by Adam."""
    rng = np.random.default_rng(settings.seed)
    inputs = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    n, width = inputs.shape
    parts = targets.shape[1]
    weights = [
        rng.normal(0, np.sqrt(2 / width), (width, settings.hidden)) * np.sqrt(width), np.zeros(settings.hidden),
        rng.normal(0, np.sqrt(1 / settings.hidden), (settings.hidden, parts)), np.zeros(parts),
    ]
    means, squares, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(settings.epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            batch = order[at : at + 256]
            x, goal = inputs[batch], targets[batch]
            hidden = np.maximum(x @ weights[0] + weights[1], 0)
            logits = hidden @ weights[2] + weights[3]
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (chance / chance.sum(axis=1, keepdims=True) - goal) / len(batch)
            below = (error @ weights[2].T) * (hidden > 0)
            step += 1
            for place, gradient in enumerate((x.T @ below, below.sum(0), hidden.T @ error, error.sum(0))):
                means[place] += 0.1 * (gradient - means[place])
                squares[place] += 0.001 * (gradient**2 - squares[place])
                size = (means[place] / (1 - 0.9**step)) / (np.sqrt(squares[place] / (1 - 0.999**step)) + 1e-8)
                weights[place] -= 0.003 * size
    return Router(*weights)


def fit_router(sample: np.ndarray, settings: Settings) -> Router:
    parts = max(1, min(settings.parts, len(sample) // 32))
    if parts == 1:
        width = sample.shape[1] if len(sample) else 1
        return Router(np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = neighbour_graph(sample, settings.graph_neighbours)
    part = balanced_parts(near, parts, np.random.default_rng(settings.seed))
    targets = np.zeros((len(sample), parts))
    for column in (np.arange(len(sample)), *near.T):
        targets[np.arange(len(sample)), part[column]] += 1
    return train_router(sample, targets / targets.sum(axis=1, keepdims=True), settings)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _routed(vectors: DataFrame, router: Router, probes: int) -> DataFrame:
    """One row for each of a vector's ``probes`` most probable parts."""

    @F.pandas_udf("array<int>")
    def parts(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        return pd.Series(list(router.parts(np.stack(rows.to_list()).astype(np.float64), probes).astype(np.int32)))

    return vectors.withColumn("part", F.explode(parts("vector")))


def _in_blocks(rows: DataFrame, own: DataFrame, own_name: str, other_name: str) -> DataFrame:
    """Deals a part's rows to its blocks, and each to all blocks of the other side. ``own`` has one row for a part."""
    mine = F.pmod(F.xxhash64("vector"), F.col(f"{own_name}s")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col(f"{other_name}s") - 1))
    return rows.join(F.broadcast(own), "part").withColumn(own_name, mine).withColumn(other_name, others)


def nearest(vectors: DataFrame, is_query: Column, k: int, workspace: Workspace,
            settings: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best found for every query, nearest first, ties to smaller ids.

    ``vectors`` has vec_id and vector (an array of floats, all of one length); ``is_query`` is a condition on vec_id.
    Every usable vector is indexed. A row is no neighbour of rows with its own vec_id; repeated rows count once; null
    ids take no part. With fewer than k candidates all that were found are returned. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    usable_rows = vectors.select("vec_id", F.col("vector").cast("array<float>").alias("vector")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vector"))
    )
    usable_rows = workspace.write(usable_rows, "usable")
    # An answer holds k ids, one of which may be the query's own. The rank is limited before the shuffle, too.
    smallest = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = workspace.write(
        usable_rows.withColumn("place", smallest).where(F.col("place") <= k + 1)
        .groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")),
        "distinct",
    )
    drawn = distinct.orderBy(F.xxhash64("vector"), F.element_at("ids", 1)).limit(settings.sample).select("vector")
    sample = np.array([row.vector for row in drawn.collect()], dtype=np.float64)
    router = fit_router(sample, settings)
    asked = usable_rows.where(is_query).select("vec_id", "vector").distinct()
    questions = workspace.write(
        asked.select("vector").distinct().withColumn("question", F.monotonically_increasing_id()), "questions"
    )
    candidates = workspace.write(_routed(distinct, router, 1), "indexed")
    routed = workspace.write(_routed(questions, router, settings.probes), "routed")

    def blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
        return rows.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}s"))

    # One row for each part.
    sizes = workspace.write(
        blocks(candidates, "candidate_block", settings.candidate_block).join(
            blocks(routed, "query_block", settings.query_block), "part"
        ),
        "blocks",
    )
    keys = ["part", "candidate_block", "query_block"]
    left = _in_blocks(candidates, sizes, "candidate_block", "query_block").select(*keys, "vector", "ids")
    right = _in_blocks(routed, sizes, "query_block", "candidate_block").select(*keys, "vector", "question")
    schema = pa.schema([("question", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        joined = column.combine_chunks()
        return joined.flatten().to_numpy().reshape(len(joined), -1).astype(np.float64)

    def compare(candidate_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        if not candidate_rows.num_rows or not query_rows.num_rows:
            return schema.empty_table()
        given, asking = matrix(candidate_rows["vector"]), matrix(query_rows["vector"])
        ids = candidate_rows["ids"].to_pylist()
        found: list[tuple[int, int, float]] = []
        top = min(k + 1, len(given))
        for question, query, scores in zip(
            query_rows["question"].to_pylist(), asking, _score_rows(asking, given), strict=True
        ):
            least = np.partition(scores, len(scores) - top)[len(scores) - top]
            places = np.flatnonzero(scores >= least - SLACK)
            exact = (given[places] * query).sum(axis=1)
            answers = [(-score, vec_id) for score, place in zip(exact.tolist(), places.tolist(), strict=True)
                       for vec_id in ids[place]]
            found += [(question, vec_id, -score) for score, vec_id in sorted(answers)[: k + 1]]
        return pa.Table.from_arrays(
            [pa.array(values, type=field.type) for values, field in zip(zip(*found, strict=True), schema, strict=True)],
            schema=schema,
        )

    compared = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        compare, "question long, vec_id long, score double"
    )
    best = Window.partitionBy("question").orderBy(F.desc("score"), "vec_id")
    answers = (
        compared.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
        .groupBy("question").agg(F.collect_list(F.struct("place", "score", "vec_id")).alias("answers"))
    )
    answered = workspace.write(questions.join(answers, "question").select("vector", "answers"), "answers")
    own = F.filter(F.array_sort("answers"), lambda answer: answer["vec_id"] != F.col("query_id"))
    return (
        asked.withColumnRenamed("vec_id", "query_id").join(answered, "vector")
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("place", "answer"))
        .select("query_id", (F.col("place") + 1).alias("rank"), "answer.vec_id", "answer.score")
    )


def _score_rows(queries: np.ndarray, given: np.ndarray) -> Iterator[np.ndarray]:
    """The approximate scores of each query, a few queries at a time."""
    for at in range(0, len(queries), 128):
        yield from queries[at : at + 128] @ given.T
