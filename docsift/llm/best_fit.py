"""Packing documents into sequences: Martello and Toth's dominance reduction, then best fit for what is left.

How pieces are packed depends on their lengths only, so the packing is worked out on how many pieces there are of each
length: at most ``capacity`` numbers, whatever the corpus. Every step of the reduction uses up a length, and best fit
handles sequences with equal contents together, so the plan does not grow with the corpus. It says which run of the
pieces of a length goes to which sequences; the pieces are then numbered by length, in many tasks, and look up their run.

Reduction. Let L be the longest length not yet settled. A set that contains a piece of length L dominates every other
one if what the other puts beside L fits piecewise into what it puts there itself. It is then safe to fix it:
nothing beside L if nothing fits; the longest k that fits if it fills the sequence exactly, if no two further pieces
fit, or if no three do and no pair beside L is longer than k. Longer pieces that were not settled count among what may
lie beside L. All lengths not settled are left for best fit.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import batch_of, crc_of_ids, whole_text
from docsift.llm.tokens import MAX_CHUNKS, byte_level_encoder
from docsift.operators.numbering import number_rows
from docsift.session import Workspace

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
])
PLAN = "length long, from_number long, to_number long, sequence long, together long, place long"
Pattern = tuple[tuple[int, int], ...]  # (length, how many) of one sequence


@dataclass
class Packing:
    """Sequences by their contents: a pattern of lengths, and how many sequences have it."""

    capacity: int
    patterns: list[tuple[Pattern, int]] = field(default_factory=list)
    fixed: int = 0  # how many of the sequences the reduction fixed
    steps: int = 0  # and how many of the patterns


class Stock:
    """Lengths that still have pieces, in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {length: n for length, n in counts.items() if n > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def longest_up_to(self, length: int) -> int | None:
        place = bisect_right(self.lengths, length)
        return self.lengths[place - 1] if place else None

    def shortest(self, n: int, beside: int) -> list[int]:
        """The n shortest pieces (fewer if there are no more), not counting one of length ``beside``."""
        found: list[int] = []
        for length in self.lengths:
            found += [length] * min(n - len(found), self.counts[length] - (length == beside))
            if len(found) == n:
                break
        return found

    def longest_pair(self, room: int, beside: int) -> int:
        """The largest sum of two pieces that does not exceed ``room``, not counting one of length ``beside``."""
        left = {x: n - (x == beside) for x, n in self.counts.items() if n > (x == beside)}
        lengths = sorted(left)
        most, high = 0, len(lengths) - 1
        for low, length in enumerate(lengths):
            if left[length] > 1 and 2 * length <= room:
                most = max(most, 2 * length)
            while high > low and length + lengths[high] > room:
                high -= 1
            if high > low:
                most = max(most, length + lengths[high])
        return most


def reduce_by_dominance(stock: Stock, packing: Packing) -> dict[int, int]:
    """Fix what is provably part of some best packing; returns the pieces by length that are left."""
    limit = packing.capacity
    while (length := stock.longest_up_to(limit)) is not None:
        n, room = stock.counts[length], packing.capacity - length
        beside = stock.shortest(3, length)
        if not beside or beside[0] > room:
            pattern, times = ((length, 1),), n  # a single one, if two of them would fit
        else:
            partner = stock.longest_up_to(room)
            if partner == length and n == 1:
                partner = stock.longest_up_to(min(length - 1, room))
            fits = [sum(beside[:k]) <= room and len(beside) >= k for k in (1, 2, 3)]
            dominates = partner == room or not fits[1] or (
                not fits[2] and stock.longest_pair(room, length) <= partner
            )
            if not dominates:
                limit = length - 1  # these stay, and shorter ones may still be put beside them
                continue
            # Holds for each of them in turn: taking pieces away lets no more fit and makes no pair longer, and the
            # partner stays the longest that fits while there is one.
            if partner == length:
                pattern, times = ((length, 2),), n // 2
            else:
                pattern, times = ((length, 1), (partner, 1)), min(n, stock.counts[partner])
        for size, many in pattern:
            stock.take(size, many * times)
        packing.patterns.append((pattern, times))
        packing.fixed += times
        packing.steps += 1
    return dict(stock.counts)


def best_fit(left: dict[int, int], packing: Packing) -> None:
    """Best fit, longest first: each piece goes to the sequence with the least room that still takes it.

    Sequences with equal contents are handled together. A sequence that took a piece is again the best for the next
    one of that length while it has room, so it takes as many as fit.
    """
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in open_:
            rooms.insert(bisect_left(rooms, room), room)
            open_[room] = []
        open_[room].append((pattern, times))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            place = bisect_left(rooms, length)
            if place < len(rooms):
                room = rooms[place]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[place]
            else:
                room, pattern, times = packing.capacity, (), n
            each = min(room // length, n)
            filled = min(times, n // each)
            if pattern and times > filled:
                put(room, pattern, times - filled)
            put(room - each * length, (*pattern, (length, each)), filled)
            n -= each * filled
    packing.patterns.extend(group for groups in open_.values() for group in groups)


def pack_lengths(counts: dict[int, int], capacity: int) -> Packing:
    packing = Packing(capacity)
    best_fit(reduce_by_dominance(Stock(counts), packing), packing)
    return packing


def plan_rows(packing: Packing, counts: dict[int, int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Runs of pieces, numbered by length over all: the run's first sequence, how many of it lie together, and where."""
    following, at = {}, 0
    for length in sorted(counts):
        following[length] = at
        at += counts[length]
    sequence = 0
    for pattern, times in packing.patterns:
        place = 0
        for length, many in pattern:
            start = following[length]
            following[length] = start + many * times
            yield length, start, start + many * times, sequence, many, place
            place += many * length
        sequence += times


def cut_documents(documents: DataFrame, tokenizer: str, end_id: int, capacity: int, known: int = MAX_CHUNKS) -> DataFrame:
    """Pieces of the documents' ids: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids, then ``end_id``; a null text is the empty one. Only documents longer than
    ``capacity`` are cut, into pieces of that length of which the first may be shorter. A worker forgets its chunks
    when it knows more than ``known``; fewer take less memory and more time, the ids are the same.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level_encoder(tokenizer)
        encoder.most_chunks = known
        for batch in batches:
            rows: list[tuple] = []
            keys = batch.column(0).to_pylist()
            for doc_id, ids in zip(keys, encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                if len(ids) <= capacity:
                    bounds = [0, len(ids)]
                for piece, (start, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((doc_id, piece, start, end - start, crc_of_ids(ids[start:end])))
            if rows:
                yield batch_of(PIECE_SCHEMA, zip(*rows, strict=True))

    return documents.select("doc_id", whole_text().alias("whole")).mapInArrow(pieces, PIECES)


def pack_documents(documents: DataFrame, tokenizer: str, workspace: Workspace, capacity: int = 2048,
                   end_id: int = 0, known: int = MAX_CHUNKS) -> DataFrame:
    """The pieces of every row, with their sequence and their place in it.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed each for itself,
    a null doc_id is carried along, other columns of ``documents`` are ignored, an empty table gives no rows. Texts
    are never shuffled; the pieces' narrow rows are, once, by length and doc_id.
    """
    pieces = workspace.write(cut_documents(documents, tokenizer, end_id, capacity, known), "pieces")
    # At most ``capacity`` rows.
    counts = {row.length: row["count"] for row in pieces.groupBy("length").count().collect()}
    rows = list(plan_rows(pack_lengths(counts, capacity), counts))
    plan = documents.sparkSession.createDataFrame(rows, PLAN)
    numbered = number_rows(pieces, ["length", "doc_id", "piece", "ids_crc32"], "number", workspace)
    # Bounded by the capacity: the lengths and the splits of their counts.
    placed = numbered.join(F.broadcast(plan), "length").where("number >= from_number AND number < to_number")
    rank = F.col("number") - F.col("from_number")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(rank / F.col("together"))).cast("long").alias("sequence_id"),
        (F.col("place") + rank % F.col("together") * F.col("length")).alias("offset"),
    )
