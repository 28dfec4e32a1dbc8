"""Whitening of embeddings by a bidiagonal qd solver.

1. Distinct vectors, centred, are reduced to triangular factors: each task folds its blocks of rows into one factor, and
   the factors are folded in a tree, so the rows that meet in one place never grow with the table.
2. The last factor R (as wide as a vector) is made bidiagonal by Householder reflections.
3. dqds finds the squares of the singular values of the bidiagonal matrix.
4. A twisted factorisation for each of the largest ones gives its right singular vector. Carried back through the
   reflections, these are the eigenvectors of the covariance matrix, which itself is never formed.
5. All rows are projected on them, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.session import Workspace

SCALE = 256
COMPONENTS = 4
# Rows folded into a factor at a time, and factors folded by one task.
BLOCK_ROWS = 4096
FAN_IN = 32
EPSILON = float(np.finfo(np.float64).eps)
MAX_STEPS = 200
RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


@dataclass(frozen=True)
class Fit:
    """What whitening needs of the fit list: all as wide as a vector, or single numbers."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance matrix, largest first
    directions: np.ndarray  # their unit eigenvectors, one in each column
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([total / self.n for total in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 of each row, exactly; null if it does not fit a long."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if len(self.sums) * largest**2 < 2**63:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [total if total < 2**63 else None for total in exact]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it has entries, all of them finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def householder(column: np.ndarray) -> tuple[np.ndarray, float]:
    """The unit vector whose reflection turns ``column`` into a multiple of the first axis, and that multiple."""
    length = float(np.linalg.norm(column))
    if length == 0.0:
        return np.zeros_like(column), 0.0
    target = -length if column[0] >= 0 else length
    normal = column.copy()
    normal[0] -= target
    return normal / np.linalg.norm(normal), target


def bidiagonalize(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B, and V, where matrix = U B V' with orthogonal U and V."""
    work = np.array(matrix, dtype=np.float64)
    width = work.shape[1]
    if len(work) < width:
        work = np.vstack([work, np.zeros((width - len(work), width))])
    right: list[tuple[int, np.ndarray]] = []
    diagonal, upper = np.zeros(width), np.zeros(max(width - 1, 0))
    for k in range(width):
        normal, diagonal[k] = householder(work[k:, k])
        work[k:, k:] -= 2 * np.outer(normal, normal @ work[k:, k:])
        if k + 1 < width:
            normal, upper[k] = householder(work[k, k + 1 :])
            work[k:, k + 1 :] -= 2 * np.outer(work[k:, k + 1 :] @ normal, normal)
            right.append((k + 1, normal))
    basis = np.eye(width)
    for start, normal in reversed(right):
        basis[start:] -= 2 * np.outer(normal, normal @ basis[start:])
    return diagonal, upper, basis


def _shifted(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None if the shift is not below the least eigenvalue."""
    new_q, new_e, d = [0.0] * len(q), [0.0] * len(e), q[0] - shift
    if d < 0:
        return None
    for k, off in enumerate(e):
        new_q[k] = d + off
        if off == 0.0:  # what follows is a matrix of its own
            d = q[k + 1] - shift
        else:
            ratio = q[k + 1] / new_q[k]
            new_e[k] = off * ratio
            d = d * ratio - shift
        if d < 0:
            return None
    new_q[-1] = d
    return new_q, new_e


def _trial_shifts(q: list[float], e: list[float]) -> Iterator[float]:
    """Guesses of the least eigenvalue from the last two rows, each lower than the one before; zero is always safe."""
    trace, product = q[-2] + e[-1] + q[-1], q[-2] * q[-1]
    larger = (trace + max(trace * trace - 4 * product, 0.0) ** 0.5) / 2
    guess = product / larger if larger else 0.0
    yield from (guess * share for share in (0.999, 0.75, 0.25, 0.0))


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The squared singular values of an unreduced bidiagonal matrix, in no order."""
    q, e = (diagonal**2).tolist(), (upper**2).tolist()
    found, total, steps = [], 0.0, 0
    small = (10 * EPSILON) ** 2
    floor = small * max(q + e, default=0.0)
    while q:
        if len(q) == 1 or e[-1] <= small * (total + q[-1]) or (steps > MAX_STEPS and e[-1] <= floor):
            found.append(total + q.pop())
            if e:
                e.pop()
            steps = 0
            continue
        steps += 1
        if steps > 100 * MAX_STEPS:
            raise ArithmeticError("dqds did not settle")
        for shift in _trial_shifts(q, e):
            moved = _shifted(q, e, shift)
            if moved is not None:
                (q, e), total = moved, total + shift
                break
    return np.array(found)


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """The unit right singular vector of a bidiagonal matrix for a squared singular value.

    B'B - value is factored from the top and from the bottom; where the two meet with the smallest remainder, the
    vector is largest, and both ways from there it follows by multiplications only.
    """
    q, e, off = diagonal**2, upper**2, diagonal[:-1] * upper
    n = len(q)
    tiny = EPSILON * EPSILON * max(float(q.max()), value, np.finfo(np.float64).tiny)

    def pivot(x: float) -> float:
        return x if abs(x) > tiny else tiny

    down, below = np.zeros(n), np.zeros(n)  # remainders from the top, from the bottom
    lower_ratio, upper_ratio = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    down[0] = -value
    for k in range(n - 1):
        from_top = pivot(down[k] + q[k])
        lower_ratio[k] = off[k] / from_top
        down[k + 1] = down[k] * (e[k] / from_top) - value
    below[n - 1] = q[n - 1] - value
    for k in range(n - 2, -1, -1):
        from_bottom = pivot(e[k] + below[k + 1])
        upper_ratio[k] = off[k] / from_bottom
        below[k] = below[k + 1] * (q[k] / from_bottom) - value
    twist = int(np.argmin(np.abs(down + below + value)))
    vector = np.zeros(n)
    vector[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        vector[k] = -lower_ratio[k] * vector[k + 1]
    for k in range(twist, n - 1):
        vector[k + 1] = -upper_ratio[k] * vector[k]
    return vector / np.linalg.norm(vector)


def _separate(vectors: np.ndarray, values: np.ndarray, diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Vectors of nearly equal values made orthogonal: inverse iteration, each kept apart from those before it."""
    if np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max(initial=0.0) < 1e-12:
        return vectors
    bidiagonal = np.diag(diagonal) + np.diag(upper, 1)
    gram = bidiagonal.T @ bidiagonal
    rng = np.random.default_rng(1)
    done = np.zeros((len(vectors), 0))
    for place, value in enumerate(values):
        vector = vectors[:, place] + 1e-3 * rng.normal(size=len(vectors)) / len(vectors) ** 0.5
        near = gram - (value + 4 * EPSILON * values[0]) * np.eye(len(gram))
        for _ in range(4):
            vector = vector - done @ (done.T @ vector)
            vector = np.linalg.solve(near, vector / np.linalg.norm(vector))
            vector = vector - done @ (done.T @ vector)
        done = np.column_stack([done, vector / np.linalg.norm(vector)])
    return done


def top_directions(factor: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of a matrix, and its right singular vectors for them in columns.

    Values that are zero to rounding have no direction, so there may be fewer than ``components``.
    """
    diagonal, upper, basis = bidiagonalize(factor)
    largest = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    cuts = (np.flatnonzero(np.abs(upper) <= EPSILON * largest) + 1).tolist()
    found: list[tuple[float, int, int]] = []
    for start, end in zip([0, *cuts], [*cuts, len(diagonal)], strict=True):
        found += [(value, start, end) for value in dqds(diagonal[start:end], upper[start : end - 1]).tolist()]
    found.sort(reverse=True)
    least = len(diagonal) * EPSILON * found[0][0]
    chosen = [one for one in found[:components] if one[0] > least]
    vectors = np.zeros((len(diagonal), len(chosen)))
    for place, (value, start, end) in enumerate(chosen):
        vectors[start:end, place] = twisted_vector(diagonal[start:end], upper[start : end - 1], value)
    values = np.array([value for value, _, _ in chosen])
    upper = np.where(np.abs(upper) <= EPSILON * largest, 0.0, upper)
    return values, basis @ _separate(vectors, values, diagonal, upper)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind, copy=False)


def _fold(rows: DataFrame, width: int, centre: np.ndarray | None) -> DataFrame:
    """The rows of one triangular factor for each task, of its rows less ``centre``."""
    schema = pa.schema([("row", pa.list_(pa.float64()))])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.zeros((0, width))
        for batch in batches:
            block = _matrix(batch.column(0), np.float64)
            for at in range(0, len(block), BLOCK_ROWS):
                part = block[at : at + BLOCK_ROWS]
                factor = np.linalg.qr(np.vstack([factor, part if centre is None else part - centre]), mode="r")
        if len(factor):
            yield pa.RecordBatch.from_arrays([pa.array(list(factor), type=schema.field(0).type)], schema=schema)

    return rows.mapInArrow(folded, "row array<double>")


def triangular_factor(distinct: DataFrame, width: int, centre: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of all centred rows (up to signs); what is collected is bounded by their width."""
    parts = distinct.rdd.getNumPartitions()
    factors = _fold(distinct.select("x"), width, centre)
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        factors = _fold(factors.repartition(parts), width, None)
    rows = [row.row for row in factors.collect()]
    return np.linalg.qr(np.array(rows, dtype=np.float64).reshape(len(rows), width), mode="r")


def fit(distinct: DataFrame, width: int, components: int) -> Fit | None:
    """Fit on a written table of distinct vectors ``x``; None if they do not differ."""
    totals = (
        distinct.select(F.posexplode("x").alias("place", "value")).groupBy("place")
        .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n")).orderBy("place").collect()
    )
    n, sums = totals[0].n, [int(row.total) for row in totals]
    factor = triangular_factor(distinct, width, np.array([total / n for total in sums]))
    values, directions = top_directions(factor, components)
    return Fit(n, sums, values / n, directions, float((factor**2).sum()) / n) if len(values) else None


def identity_error(distinct: DataFrame, fitted: Fit) -> float:
    """The largest entry, by amount, of the whitened fit list's covariance matrix less the identity."""
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("product", pa.float64())])
    m = len(fitted.values)
    # The last column of ones gives the sums.
    places = [(a, b) for a in range(m) for b in range(m + 1)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((m, m + 1))
        for batch in batches:
            white = fitted.whitened(_matrix(batch.column(0), np.int64))
            products += white.T @ np.column_stack([white, np.ones(len(white))])
        columns = [[a for a, _ in places], [b for _, b in places], products.ravel().tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, type=field.type) for values, field in zip(columns, schema, strict=True)], schema=schema
        )

    sums = distinct.select("x").mapInArrow(summed, "a int, b int, product double").groupBy("a", "b").agg(
        F.sum("product").alias("product")
    )
    products = np.zeros((m, m + 1))
    for row in sums.collect():  # one for each entry
        products[row.a, row.b] = row["product"]
    means = products[:, m] / fitted.n
    return float(np.abs(products[:, :m] / fitted.n - np.outer(means, means) - np.eye(m)).max())


def whiten(vectors: DataFrame, workspace: Workspace, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each row and component.

    ``vectors`` has vec_id and vector (an array of numbers, all of one length, else ValueError); other columns are
    ignored. Entries c are rounded down to x = floor(256 c). A vector that is null, empty or holds null or non-finite
    entries takes no part. Each distinct x counts once in the fit, every row is whitened; repeated rows and null ids
    are carried along. There are as many components as the covariance has eigenvalues above rounding, up to
    ``components``; so vectors that are all equal, or an empty table, give no rows. A deviation beyond 2^63 is null.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col("vector"), lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = workspace.write(
        vectors.where(usable(F.col("vector"))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x")),
        "rounded",
    )
    width = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if width.least != width.most:
        raise ValueError(f"vectors of {width.least} to {width.most} entries cannot be whitened together")
    nothing = spark.createDataFrame([], RESULT)
    if width.most is None:
        return nothing
    # Equal vectors meet after each task has counted its own once.
    distinct = workspace.write(rows.select("x").distinct(), "distinct")
    fitted = fit(distinct, width.most, components)
    if fitted is None:
        return nothing
    error = identity_error(distinct, fitted)
    m = len(fitted.values)
    explained = (fitted.values / fitted.trace).tolist()
    schema = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), np.int64)
            each = np.repeat(np.arange(len(x)), m)
            columns = [
                batch.column(0).take(pa.array(each)), np.tile(np.arange(1, m + 1), len(x)), np.full(len(each), fitted.n),
                pa.array(fitted.deviations(x), type=pa.int64()).take(pa.array(each)), fitted.whitened(x).ravel(),
                np.tile(explained, len(x)), np.full(len(each), error),
            ]
            yield pa.RecordBatch.from_arrays(
                [values if isinstance(values, pa.Array) else pa.array(values, type=field.type)
                 for values, field in zip(columns, schema, strict=True)],
                schema=schema,
            )

    return rows.mapInArrow(projected, RESULT)
