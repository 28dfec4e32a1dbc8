"""Ranked lexical search over posting lists cut into geometric blocks.

1. One pass counts, in every document, the terms that some item asks for. Document frequencies and lengths are summed
   over all documents; they fix each term's weight and each occurrence's part of a score.
2. Documents are gathered into segments. In a segment each term's posting list is clustered by how similar the documents
   are (inner products of random projections of their parts), and each cluster is cut into blocks. A block's summary
   holds, for every term that is asked together with the list's one, the maximum over its documents. Segments are
   written as a table.
3. A block's summary bounds the score of its documents for an item: a document is judged in the list of the rarest term
   that it shares with the item. A first pass scores, in each segment, the blocks with the highest bounds; the k-th best
   score found over all segments is one that the answer cannot fall below.
4. A second pass goes through each item's blocks from the highest bound on and stops at the first that is below that
   score, or below the k-th best of the segment. What it skips cannot be among the answers, so these are exact.

Items come in blocks of bounded size, each with its own vocabulary: a stated set of queries against all rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import list_array, ragged_positions, whole_text
from docsift.llm.contamination import words
from docsift.operators.numbering import number_rows
from docsift.session import Workspace

# Bytes of the items that are searched for at a time, beside the last one.
ITEM_BYTES = 1 << 18
# A segment's documents times the terms asked for.
SEGMENT_CELLS = 1 << 22
SEGMENT_DOCUMENTS = 2048
# So many segments are searched by a task, about: they may come to its worker in one batch.
TASK_SEGMENTS = 4
BLOCK_DOCUMENTS = 32
SKETCH_WIDTH = 32
# Summaries hold only what is asked together, unless that takes more numbers than this.
PAIRS = 1 << 22
# Letters and digits of ASCII and all other bytes are parts of terms; only A to Z are lower-cased.
_TERM_BYTES = bytes(
    code if code > 127 else ord(chr(code).lower()) if chr(code).isalnum() else 0x20 for code in range(256)
)
FORWARD = "doc_id long, n long, terms array<int>, counts array<int>"
_LISTS = (
    "doc_sizes", "doc_terms", "doc_values", "list_terms", "list_blocks", "block_sizes", "block_places",
    "summary_sizes", "summary_places", "summary_values",
)
INDEX = "doc_ids array<long>, " + ", ".join(f"{name} array<int>" for name in _LISTS)
INDEX_SCHEMA = pa.schema([("doc_ids", pa.list_(pa.int64())), *[(name, pa.list_(pa.int32())) for name in _LISTS]])
FOUND_SCHEMA = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    """The maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A to Z lower-cased, as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass(frozen=True)
class Queries:
    """A block of items: each one's number, and its terms (by number) with their repeats, one item after another."""

    items: np.ndarray
    sizes: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray
    weights: np.ndarray  # of each term of the vocabulary

    @property
    def vocabulary(self) -> int:
        return len(self.weights)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @cached_property
    def holders(self) -> list[np.ndarray]:
        """The places of the items that ask for each term."""
        of = np.repeat(np.arange(len(self.items)), self.sizes)
        order = np.argsort(self.terms, kind="stable")
        return np.split(of[order], np.cumsum(np.bincount(self.terms, minlength=self.vocabulary))[:-1])

    @cached_property
    def together(self) -> list[np.ndarray]:
        """For each term, in order, the terms not rarer than it that are asked together with it."""
        if sum(int(self.sizes[places].sum()) for places in self.holders) > PAIRS:
            return [np.arange(self.vocabulary)] * self.vocabulary
        asked = (np.unique(self.terms[self.entries(places)]) for places in self.holders)
        return [found[self.rarity[found] >= self.rarity[term]] for term, found in enumerate(asked)]

    @cached_property
    def rarity(self) -> np.ndarray:
        """The rank of each term by falling weight."""
        rank = np.empty(self.vocabulary, dtype=np.int64)
        rank[np.argsort(-self.weights, kind="stable")] = np.arange(self.vocabulary)
        return rank

    def entries(self, places: np.ndarray) -> np.ndarray:
        return ragged_positions(self.starts[places], self.sizes[places])


def count_terms(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and the number and count of each asked term, of every document with a term."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())),
    ])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            rows = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                held = Counter(map(number, found))
                held.pop(None, None)
                for column, value in zip(rows, (doc_id, len(found), list(held), list(held.values())), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, type=field.type) for values, field in zip(rows, schema, strict=True)], schema=schema
            )

    return documents.select(F.col("doc_id").cast("long"), whole_text().alias("whole")).mapInArrow(counted, FORWARD)


def score_parts(lengths: np.ndarray, counts: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What an occurrence adds to a score, per unit of its term's weight: ``lengths`` and ``counts`` go together."""
    kinds, place = np.unique(lengths, return_inverse=True)
    m = np.array([75 + 25 * n * documents // total for n in kinds.tolist()], dtype=np.int64)[place]
    return 1_000_000_000 * counts // (1000 * counts + 12 * m)


def cut_list(sketches: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """An order of a posting list's documents by cluster, and the sizes of its blocks in that order."""
    n = len(sketches)
    if n <= BLOCK_DOCUMENTS:
        return np.arange(n), np.array([n])
    centres = sketches[rng.choice(n, -(-n // BLOCK_DOCUMENTS), replace=False)]
    cluster = (sketches @ centres.T).argmax(axis=1)
    order = np.argsort(cluster, kind="stable")
    sizes = np.bincount(cluster)
    # A cluster larger than two blocks is cut; members of one cluster are alike.
    blocks = -(-sizes // (2 * BLOCK_DOCUMENTS))
    rest = sizes - (blocks - 1) * 2 * BLOCK_DOCUMENTS
    cut = np.full(int(blocks.sum()), 2 * BLOCK_DOCUMENTS)
    cut[np.cumsum(blocks)[blocks > 0] - 1] = rest[blocks > 0]
    return order, cut


def build_segment(doc_ids: list, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, queries: Queries) -> dict:
    """The index row of a segment: its documents' parts, and the blocks of every list with their summaries."""
    rng = np.random.default_rng(len(doc_ids))
    parts = np.zeros((len(doc_ids), queries.vocabulary), dtype=np.int32)
    holder = np.repeat(np.arange(len(doc_ids)), sizes)
    parts[holder, terms] = values
    projection = rng.choice(np.array([-1, 1], dtype=np.float32), (queries.vocabulary, SKETCH_WIDTH))
    sketches = (parts.astype(np.float32) * queries.weights.astype(np.float32)) @ projection
    sketches /= np.maximum(np.linalg.norm(sketches, axis=1, keepdims=True), 1)
    order = np.argsort(terms, kind="stable")
    ends = np.cumsum(np.bincount(terms, minlength=queries.vocabulary))
    lists = np.split(holder[order], ends[:-1])
    row: dict[str, list] = {name: [] for name in _LISTS}
    for term in np.unique(terms).tolist():
        held = lists[term]
        by_cluster, blocks = cut_list(sketches[held], rng)
        places = held[by_cluster]
        most = np.maximum.reduceat(parts[np.ix_(places, queries.together[term])], np.cumsum(blocks) - blocks, axis=0)
        block, coordinate = np.nonzero(most)
        row["list_terms"].append([term])
        row["list_blocks"].append([len(blocks)])
        row["block_sizes"].append(blocks)
        row["block_places"].append(places)
        row["summary_sizes"].append(np.bincount(block, minlength=len(blocks)))
        row["summary_places"].append(coordinate)
        row["summary_values"].append(most[block, coordinate])
    joined = {name: np.concatenate(values).astype(np.int32) for name, values in row.items() if values}
    return joined | {"doc_ids": doc_ids, "doc_sizes": sizes, "doc_terms": terms, "doc_values": values}


def build_index(forward: DataFrame, queries: Queries, documents: int, total: int) -> DataFrame:
    """The index rows of all segments. A task holds one segment at a time; documents without asked terms are in none."""
    most = max(min(SEGMENT_CELLS // max(queries.vocabulary, 1), SEGMENT_DOCUMENTS), 1)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list = []
        held: list[tuple[np.ndarray, ...]] = []

        def close() -> pa.RecordBatch:
            sizes, terms, values = (np.concatenate(column) for column in zip(*held, strict=True))
            row = build_segment(doc_ids, sizes, terms, values, queries)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([row["doc_ids"]], type=INDEX_SCHEMA.field(0).type),
                    *[list_array(row[name], np.array([len(row[name])]), pa.int32()) for name in _LISTS],
                ],
                schema=INDEX_SCHEMA,
            )

        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            terms = batch.column(2).flatten().to_numpy()
            counts = batch.column(3).flatten().to_numpy().astype(np.int64)
            values = score_parts(np.repeat(batch.column(1).to_numpy(), sizes), counts, documents, total)
            ids = batch.column(0).to_pylist()
            asked, ends = np.flatnonzero(sizes), np.cumsum(sizes)
            while len(asked):
                now, asked = asked[: most - len(doc_ids)], asked[most - len(doc_ids) :]
                entries = slice(ends[now[0]] - sizes[now[0]], ends[now[-1]])
                held.append((sizes[now], terms[entries], values[entries]))
                doc_ids += [ids[place] for place in now.tolist()]
                if len(doc_ids) == most:
                    yield close()
                    doc_ids, held = [], []
        if doc_ids:
            yield close()

    return forward.select("doc_id", "n", "terms", "counts").mapInArrow(built, INDEX)


class Segment:
    """A segment as it is searched."""

    def __init__(self, row: dict, queries: Queries) -> None:
        self.queries, self.doc_ids = queries, row["doc_ids"]
        self.parts = np.zeros((len(self.doc_ids), queries.vocabulary), dtype=np.int32)
        self.parts[np.repeat(np.arange(len(self.doc_ids)), row["doc_sizes"]), row["doc_terms"]] = row["doc_values"]
        self.block_sizes, self.block_places = row["block_sizes"], row["block_places"]
        self.block_starts = np.cumsum(self.block_sizes) - self.block_sizes
        self.order = self._ordered_ids()
        self._bound(row)

    def _ordered_ids(self) -> np.ndarray:
        """The rank of each document's id, nulls last: what ties are settled by."""
        order = sorted(range(len(self.doc_ids)), key=lambda place: (self.doc_ids[place] is None, self.doc_ids[place] or 0))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return rank

    def _bound(self, row: dict) -> None:
        """For every item the numbers of all blocks of its lists, and the most that a document in them can score.

        A document is bounded in the list of the rarest term that it shares with the item, so a block's bound counts
        the list's own term and more common ones only.
        """
        queries = self.queries
        blocks: list[list[np.ndarray]] = [[] for _ in queries.items]
        bounds: list[list[np.ndarray]] = [[] for _ in queries.items]
        first = summary = 0
        for term, n_blocks in zip(row["list_terms"].tolist(), row["list_blocks"].tolist(), strict=True):
            sizes = row["summary_sizes"][first : first + n_blocks]
            entries = slice(summary, summary + int(sizes.sum()))
            summary = entries.stop
            together, asking = queries.together[term], queries.holders[term]
            most = np.zeros((n_blocks, len(together)))
            most[np.repeat(np.arange(n_blocks), sizes), row["summary_places"][entries]] = row["summary_values"][entries]
            held = queries.entries(asking)
            share = np.zeros((len(together), len(asking)))
            # What holds a rarer term of the item is bounded in that one's list.
            here = queries.rarity[queries.terms[held]] >= queries.rarity[term]
            terms = queries.terms[held[here]]
            share[
                np.searchsorted(together, terms), np.repeat(np.arange(len(asking)), queries.sizes[asking])[here]
            ] = queries.repeats[held[here]] * queries.weights[terms]
            reach = most @ share
            numbers = np.arange(first, first + n_blocks)
            first += n_blocks
            for column, place in enumerate(asking.tolist()):
                blocks[place].append(numbers)
                bounds[place].append(reach[:, column])
        none = np.zeros(0)
        self.blocks = [np.concatenate(found) if found else none.astype(np.int64) for found in blocks]
        # Whole numbers up to 2^53 are exact; beyond, the bound is lifted by more than what rounding can take away.
        self.bounds = [
            np.where(bound < 2.0**50, bound, bound * (1 + 1e-9)) for bound in (np.concatenate(b) if b else none for b in bounds)
        ]

    def search(self, place: int, k: int, least: int, first_only: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of an item's best in this segment that reach ``least``, and how many blocks were scored.

        With ``first_only`` just the blocks with the highest bounds are scored, until they hold k documents.
        """
        queries = self.queries
        terms = queries.terms[queries.entries(np.array([place]))]
        factor = queries.repeats[queries.entries(np.array([place]))] * queries.weights[terms]
        order = np.argsort(-self.bounds[place], kind="stable")
        bounds, blocks = self.bounds[place][order], self.blocks[place][order]
        docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        seen = np.zeros(len(self.doc_ids), dtype=bool)
        at, batch = 0, k
        held = np.cumsum(self.block_sizes[blocks])
        while at < len(blocks) and bounds[at] >= least:
            # Ever more at a time, as the k-th best score rises less and less.
            reach = batch + (int(held[at - 1]) if at else 0)
            end = min(int(np.searchsorted(held, reach)) + 1, int(np.searchsorted(-bounds, -least, side="right")))
            now = blocks[at:end]
            at, batch = end, 2 * batch
            places = np.unique(self.block_places[ragged_positions(self.block_starts[now], self.block_sizes[now])])
            places = places[~seen[places]]
            seen[places] = True
            docs = np.concatenate([docs, places])
            scores = np.concatenate([scores, self.parts[np.ix_(places, terms)].astype(np.int64) @ factor])
            best = np.lexsort((self.order[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            if first_only and len(docs) >= k:
                break
            if len(docs) >= k:
                least = max(least, int(scores[-1]))
        fine = scores >= max(least, 1)
        return docs[fine], scores[fine], at


def deal_segments(index: DataFrame) -> DataFrame:
    """The index dealt out by segments, so that what a task holds does not grow with the size of files."""
    return index.repartition(max(index.count() // TASK_SEGMENTS, 1), F.xxhash64("doc_ids"))


def search_index(index: DataFrame, queries: Queries, k: int, least: np.ndarray, first_only: bool = False) -> DataFrame:
    """item (its number), doc_id and score of every segment's best documents for each item."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                row = {name: batch.column(name)[place].values.to_numpy() for name in _LISTS}
                segment = Segment(row | {"doc_ids": batch.column("doc_ids")[place].as_py()}, queries)
                items, doc_ids, scores = [], [], []
                for number in range(len(queries.items)):
                    docs, reached, _ = segment.search(number, k, int(least[number]), first_only)
                    items += [int(queries.items[number])] * len(docs)
                    doc_ids += [segment.doc_ids[doc] for doc in docs.tolist()]
                    scores += reached.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, type=pa.int64()) for values in (items, doc_ids, scores)], schema=FOUND_SCHEMA
                )

    return index.mapInArrow(found, "item long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _read_queries(items: DataFrame) -> tuple[Queries, dict[bytes, int]]:
    """A block of items (item, words) with its vocabulary, its terms not weighed yet. Bounded by the block's bytes."""
    rows = items.select("item", "words").orderBy("item").collect()
    vocabulary: dict[bytes, int] = {}
    sizes, terms, repeats = [], [], []
    for row in rows:
        held = Counter(word.encode() for word in row.words)
        sizes.append(len(held))
        terms += [vocabulary.setdefault(term, len(vocabulary)) for term in held]
        repeats += held.values()
    numbers = (np.array(values, dtype=np.int64) for values in ([row["item"] for row in rows], sizes, terms, repeats))
    return Queries(*numbers, np.ones(len(vocabulary), dtype=np.int64)), vocabulary


def _search_block(documents: DataFrame, queries: Queries, vocabulary: dict[bytes, int], k: int,
                  workspace: Workspace) -> DataFrame:
    forward = workspace.write(count_terms(documents, vocabulary), "forward")
    totals = forward.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
    holding = np.zeros(len(vocabulary), dtype=np.int64)
    # One row for each asked term at most.
    for row in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[row.term] = row["count"]
    weights = np.array([term_weight(totals.documents, df) for df in holding.tolist()], dtype=np.int64)
    queries = replace(queries, weights=weights)
    index = deal_segments(workspace.write(build_index(forward, queries, totals.documents, totals.total), "index"))
    least = np.ones(len(queries.items), dtype=np.int64)
    probed = _best(search_index(index, queries, k, least, first_only=True), k)
    place = {item: number for number, item in enumerate(queries.items.tolist())}
    # One row for each item of the block: the k-th best score, where there are k.
    for row in probed.where(F.col("rank") == k).select("item", "score").collect():
        least[place[row["item"]]] = max(row.score, 1)
    return workspace.write(_best(search_index(index, queries, k, least), k), "found")


def rank_documents(documents: DataFrame, items: DataFrame, k: int, workspace: Workspace,
                   item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents that score highest for each row of ``items``.

    ``documents`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Scores above 0 only; equal
    scores by ascending doc_id, null ids last. Texts of any length count whole; null and empty texts have no terms, so
    they are neither answers nor asked for. Repeated documents are ranked each, repeated items answered each. Without
    documents or items there are no rows.
    """
    split = items.select("item_id", words(whole_text()).alias("words")).where(F.size("words") > 0)
    asked = workspace.write(split.withColumn("item", F.monotonically_increasing_id()), "items")
    sized = asked.select("item", "words", F.octet_length(F.array_join("words", " ")).cast("long").alias("bytes"))
    placed = number_rows(sized, ["item"], "bytes_before", workspace, weight="bytes")
    placed = workspace.write(placed.withColumn("block", F.floor(F.col("bytes_before") / item_bytes)), "item-blocks")
    found = []
    for row in placed.select("block").distinct().orderBy("block").collect():
        queries, vocabulary = _read_queries(placed.where(F.col("block") == row.block))
        found.append(_search_block(documents, queries, vocabulary, k, workspace))
    if not found:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found).join(asked.select("item", "item_id"), "item").select(
        "item_id", "rank", "doc_id", "score"
    )
