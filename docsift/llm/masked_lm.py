"""Document scores by masked pseudo-likelihood.

A small network sees the two words before and the two words after a place and predicts the word there. The sum of the
log-probabilities it gives to all words of a document, each predicted from both sides, is the document's score.

Words are lower-cased, and every word of the corpus is in the vocabulary. The network predicts a word's class, a hash of
the word, in two steps: the upper half of its bits and then the lower half, which keeps the softmax short. Within its
class a word has the share of its occurrences in the corpus. So at every place the probabilities of all words of the
corpus sum to one. The counts of words grow with the corpus: blocks of documents send theirs to buckets, which are
ranges of the words' hashes, and the buckets send the sums back.

Training covers every word of the corpus. The documents are dealt to rounds; in a round, every task trains its own copy
of the network on its documents of that round, and the copies' weighted mean starts the next round. The network itself
is of fixed size.

A word is known by its 64-bit hash: unlike words that share one would be counted as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import codes_of, packed, unpacked, whole_text
from docsift.session import Workspace

_LOWER = bytes(code + 32 if 65 <= code <= 90 else code for code in range(256))
SIDES = (-2, -1, 1, 2)
# Words that are scored at once, and words that a task collects before it trains on them.
STEP_WORDS, HELD_WORDS = 1 << 12, 1 << 17
# A block is closed when it has so many words; a longer text is one block with what came before it.
BLOCK_WORDS = 1 << 19
BLOCKS_OF_PART = 1 << 32
# codes: each word's number within its block; hashes (64 bits) and counts of the block's n_distinct numbered words.
BLOCKS = (
    "block long, doc_ids array<long>, lengths array<long>, codes binary, hashes binary, counts binary, n_distinct long"
)
# Words of all blocks that a bucket has on average, and the least number of buckets.
BUCKET_WORDS, LEAST_BUCKETS = 1 << 20, 64


@dataclass(frozen=True)
class Settings:
    """``half_bits``: a class has twice as many bits. ``width``: of the hidden layer. ``rounds`` share the corpus."""

    half_bits: int = 5
    width: int = 24
    rounds: int = 2
    batch: int = 4096
    rate: float = 0.1
    seed: int = 11

    @property
    def half(self) -> int:
        return 1 << self.half_bits

    @property
    def classes(self) -> int:
        return self.half**2


def lowered_words(text: str) -> list[bytes]:
    """The words of a text (as ``words_of`` has them), A-Z in lower case."""
    return text.encode().translate(_LOWER).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def classes_of(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    """The class of every word: the lowest bits of its hash."""
    return (hashes % np.uint64(settings.classes)).astype(np.uint16)


class Network:
    """Weights: a table for each side (its last row stands beyond the text's ends), and the two output layers."""

    NAMES = ("tables", "bias", "upper", "upper_bias", "lower", "lower_bias")

    def __init__(self, settings: Settings, weights: np.ndarray | None = None) -> None:
        self.settings = settings
        half, width = settings.half, settings.width
        shapes = (
            (len(SIDES), settings.classes + 1, width), (width,), (width, half), (half,), (half, width, half),
            (half, half),
        )
        sizes = [int(np.prod(shape)) for shape in shapes]
        self.size = sum(sizes)
        if weights is None:
            rng = np.random.default_rng(settings.seed)
            spread = np.concatenate([
                np.full(size, 0.1 if len(shape) > 1 and shape != (half, half) else 0.0)
                for size, shape in zip(sizes, shapes, strict=True)
            ])
            weights = rng.normal(size=self.size) * spread
        self.weights = np.array(weights, dtype=np.float32)
        self.sums = np.full(self.size, 0.1, dtype=np.float32)  # of squared gradients
        ends = np.cumsum(sizes).tolist()
        for place, (name, shape) in enumerate(zip(self.NAMES, shapes, strict=True)):
            part = slice(ends[place] - sizes[place], ends[place])
            setattr(self, name, self.weights[part].reshape(shape))
            setattr(self, f"{name}_sums", self.sums[part].reshape(shape))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = np.take(self.tables[0], around[0], axis=0)
        for side in range(1, len(SIDES)):
            total += np.take(self.tables[side], around[side], axis=0)
        total += self.bias
        return np.maximum(total, 0, out=total)

    def chances(self, around: np.ndarray, words: np.ndarray):
        """Logarithms and shares that the two output steps give to all halves, the words grouped by their upper half."""
        upper = words >> self.settings.half_bits
        order = np.argsort(upper, kind="stable")
        upper, low = upper[order].astype(np.int64), (words[order] & (self.settings.half - 1)).astype(np.int64)
        hidden = self.hidden(around[:, order])
        upper_given = _softmax(hidden @ self.upper + self.upper_bias)
        bounds = np.searchsorted(upper, np.arange(self.settings.half + 1)).tolist()
        logits = np.empty((len(words), self.settings.half), dtype=np.float32)
        for number, (start, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if end > start:
                logits[start:end] = hidden[start:end] @ self.lower[number] + self.lower_bias[number]
        return order, hidden, upper, low, upper_given, _softmax(logits), bounds

    def log_chances(self, around: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The log-probability of every word's class, from both sides."""
        order, _, upper, low, (upper_log, _), (lower_log, _), _ = self.chances(around, words)
        rows = np.arange(len(words))
        result = np.empty(len(words), dtype=np.float64)
        result[order] = upper_log[rows, upper] + lower_log[rows, low]
        return result

    def learn(self, around: np.ndarray, words: np.ndarray) -> None:
        """One step of Adagrad on the mean log-probability."""
        order, hidden, upper, low, (_, upper_error), (_, lower_error), bounds = self.chances(around, words)
        rows = np.arange(len(words))
        upper_error[rows, upper] -= 1
        lower_error[rows, low] -= 1
        upper_error /= len(words)
        lower_error /= len(words)
        below = upper_error @ self.upper.T
        lower_step, lower_bias_step = np.zeros_like(self.lower), np.zeros_like(self.lower_bias)
        for number, (start, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if end > start:
                below[start:end] += lower_error[start:end] @ self.lower[number].T
                lower_step[number] = hidden[start:end].T @ lower_error[start:end]
                lower_bias_step[number] = lower_error[start:end].sum(axis=0)
        below *= hidden > 0
        self._step("upper", hidden.T @ upper_error)
        self._step("upper_bias", upper_error.sum(axis=0))
        self._step("lower", lower_step)
        self._step("lower_bias", lower_bias_step)
        self._step("bias", below.sum(axis=0))
        for side in range(len(SIDES)):
            seen = around[side][order]
            by_class = np.argsort(seen, kind="stable")
            known, firsts = np.unique(seen[by_class], return_index=True)
            self._step("tables", np.add.reduceat(below[by_class], firsts, axis=0), (side, known))

    def _step(self, name: str, gradient: np.ndarray, at=...) -> None:
        sums, weights = getattr(self, f"{name}_sums"), getattr(self, name)
        # A mean over many words is small; its usual size is brought to about one.
        gradient = gradient * np.float32(self.settings.batch**0.5)
        sums[at] += gradient**2
        weights[at] -= np.float32(self.settings.rate) * gradient / np.sqrt(sums[at])


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms and shares of every row; a row's length is a power of two."""
    top = logits
    while top.shape[1] > 1:
        middle = top.shape[1] // 2
        top = np.maximum(top[:, :middle], top[:, middle:])
    logits -= top
    shares = np.exp(logits)
    total = (shares @ np.ones(shares.shape[1], dtype=shares.dtype))[:, None]
    shares /= total
    logits -= np.log(total)
    return logits, shares


def surroundings(documents: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The classes on each side of every word of the documents, and the words themselves."""
    beyond = np.full(2, settings.classes, dtype=np.uint16)
    padded = np.concatenate([beyond, *[part for words in documents for part in (words, beyond)]])
    places = np.flatnonzero(padded != settings.classes)
    if len(places) != sum(map(len, documents)):
        raise ValueError("a word has a class beyond the last one")
    return np.stack([padded[places + side] for side in SIDES]), padded[places]


def encode(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The words of all rows as BLOCKS, in which each distinct word is hashed and counted once."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() * BLOCKS_OF_PART
        doc_ids, lengths, words = [], [], []

        def closed() -> pa.RecordBatch:
            codes, distinct = codes_of(words)
            counts = np.bincount(codes, minlength=len(distinct))
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(distinct), dtype=np.uint32)  # frequent words get small numbers
            place[order] = np.arange(len(distinct), dtype=np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                 pa.array([packed(place[codes])]), pa.array([hashes_of(distinct)[order].astype("<u8").tobytes()]),
                 pa.array([packed(counts[order])]), pa.array([len(distinct)])],
                names=["block", "doc_ids", "lengths", "codes", "hashes", "counts", "n_distinct"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = lowered_words(text.as_py())
                doc_ids.append(doc_id)
                lengths.append(len(found))
                words += found
                if len(words) >= block_words:
                    yield closed()
                    block, doc_ids, lengths, words = block + 1, [], [], []
        if doc_ids:
            yield closed()

    return documents.select("doc_id", whole_text().alias("whole")).mapInArrow(blocks, BLOCKS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for place in range(batch.num_rows):
            yield {name: batch.column(name)[place] for name in batch.schema.names}


def _hashes(row: dict) -> np.ndarray:
    return np.frombuffer(row["hashes"].as_py(), dtype="<u8")


def documents_of(row: dict, settings: Settings) -> list[np.ndarray]:
    """The classes of the words of each document of a block."""
    ends = np.cumsum(row["lengths"].values.to_numpy())
    return np.split(classes_of(_hashes(row), settings)[unpacked(row["codes"].as_py())[0]], ends[:-1])


def _chunks_of(weights: np.ndarray, words: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(weights))), pa.array(np.full(len(weights), words)),
         pa.array(weights.astype(np.float64) * words)],
        names=["place", "words", "weighted"],
    )


def train(blocks: DataFrame, settings: Settings) -> np.ndarray:
    """The network's weights, trained on all documents; those of a block are dealt to the rounds in turn."""
    weights = Network(settings).weights

    for number in range(settings.rounds):
        start = weights

        def trained(batches: Iterator[pa.RecordBatch], number=number, start=start) -> Iterator[pa.RecordBatch]:
            network, seen, held, size = Network(settings, start), 0, [], 0
            rng = np.random.default_rng(TaskContext.get().partitionId())

            def learn() -> None:
                around, words = surroundings(held, settings)
                order = rng.permutation(len(words))
                for at in range(0, len(order), settings.batch):
                    batch = order[at : at + settings.batch]
                    network.learn(around[:, batch], words[batch])

            for row in _rows(batches):
                for words in documents_of(row, settings)[number :: settings.rounds]:
                    held.append(words)
                    size += len(words)
                    if size >= HELD_WORDS:
                        learn()
                        seen, held, size = seen + size, [], 0
            if size:
                learn()
            if seen + size:
                yield _chunks_of(network.weights, seen + size)

        copies = blocks.select("lengths", "codes", "hashes").mapInArrow(
            trained, "place long, words long, weighted double"
        )
        # As many numbers as the network has weights.
        mean = copies.groupBy("place").agg((F.sum("weighted") / F.sum("words")).alias("weight")).toPandas()
        if len(mean):
            weights = mean.sort_values("place")["weight"].to_numpy(dtype=np.float32)
    return weights


def class_totals(blocks: DataFrame, settings: Settings) -> np.ndarray:
    """How often words of each class occur in all blocks; one for a class without words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(settings.classes, dtype=np.int64)
        for row in _rows(batches):
            np.add.at(totals, classes_of(_hashes(row), settings), unpacked(row["counts"].as_py())[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals))), pa.array(totals)], names=["class", "total"])

    rows = blocks.select("hashes", "counts").mapInArrow(counted, "class long, total long")
    totals = np.ones(settings.classes)
    for row in rows.groupBy("class").agg(F.sum("total").alias("total")).where("total > 0").collect():
        totals[row["class"]] = row["total"]
    return totals


def log_totals(blocks: DataFrame) -> DataFrame:
    """(block, bucket, logs): the logarithm of how often each word of a block occurs in all blocks.

    Buckets are equal ranges of hashes; ``logs`` (32-bit floats) follow the block's words in the order of their hashes.
    A word comes at most once from each block, and the number of buckets grows with what comes from all blocks, so a
    bucket's share of it stays of one size.
    """
    words = blocks.agg(F.sum("n_distinct")).first()[0] or 0
    bits = max(-(-words // BUCKET_WORDS), LEAST_BUCKETS).bit_length()
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes, counts = _hashes(row), unpacked(row["counts"].as_py())[0]
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order].astype("<u4")
            ends = [0, *np.searchsorted(hashes, bounds).tolist(), len(hashes)]
            parts = [(number, a, b) for number, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"].as_py()] * len(parts), pa.int64()),
                 pa.array([number for number, _, _ in parts], pa.int32()),
                 pa.array([hashes[a:b].tobytes() for _, a, b in parts], pa.binary()),
                 pa.array([counts[a:b].tobytes() for _, a, b in parts], pa.binary())],
                names=["block", "bucket", "hashes", "counts"],
            )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, run in groupby(_rows(batches), key=lambda row: row["bucket"].as_py()):
            blocks_of_run, hashes, counts = [], [], []
            for row in run:
                blocks_of_run.append(row["block"].as_py())
                hashes.append(_hashes(row))
                counts.append(np.frombuffer(row["counts"].as_py(), dtype="<u4"))
            _, word = np.unique(np.concatenate(hashes), return_inverse=True)
            logs = np.log(np.bincount(word, weights=np.concatenate(counts)))[word].astype("<f4")
            parts = np.split(logs, np.cumsum([len(part) for part in hashes])[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks_of_run, pa.int64()), pa.array([bucket] * len(parts), pa.int32()),
                 pa.array([part.tobytes() for part in parts], pa.binary())],
                names=["block", "bucket", "logs"],
            )

    met = blocks.select("block", "hashes", "counts").mapInArrow(
        dealt, "block long, bucket int, hashes binary, counts binary"
    )
    met = met.repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(summed, "block long, bucket int, logs binary")


def score_blocks(blocks: DataFrame, weights: np.ndarray, settings: Settings) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_likelihood of every document of the (written) blocks."""
    in_class = class_totals(blocks, settings)
    # One row for each bucket, at most one for each word of the block.
    gathered = log_totals(blocks).groupBy("block").agg(F.collect_list(F.struct("bucket", "logs")).alias("parts"))
    gathered = gathered.select("block", F.array_sort("parts")["logs"].alias("logs"))
    whole = blocks.drop("counts").join(gathered, "block", "left")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(settings, weights)
        for row in _rows(batches):
            hashes = _hashes(row)
            shares = -np.log(in_class[classes_of(hashes, settings)])
            shares[np.argsort(hashes)] += np.frombuffer(b"".join(row["logs"].as_py() or []), dtype="<f4")
            lengths = row["lengths"].values.to_numpy()
            around, words = surroundings(documents_of(row, settings), settings)
            chances = shares[unpacked(row["codes"].as_py())[0]]
            for at in range(0, len(words), STEP_WORDS):
                part = slice(at, at + STEP_WORDS)
                chances[part] += network.log_chances(around[:, part], words[part])
            owner = np.repeat(np.arange(len(lengths)), lengths)
            sums = np.bincount(owner, weights=chances, minlength=len(lengths)).astype(np.float64)
            means = pa.array(sums / np.maximum(lengths, 1), mask=lengths == 0)
            yield pa.RecordBatch.from_arrays(
                [row["doc_ids"].values, pa.array(lengths), pa.array(sums), means],
                names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"],
            )

    return whole.mapInArrow(
        scores, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double"
    )


def score_documents(documents: DataFrame, workspace: Workspace, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum over all words) and mean_log_likelihood of every row.

    The network is trained on the same documents, and the words are counted in them. A null or empty text has no words,
    the sum 0 and no mean (null). Repeated rows are trained on, counted and scored each; a null doc_id is carried along;
    other columns are ignored. A very long text is scored whole, in a block of its own. An empty table gives no rows.
    Texts are read once; training and scoring read the written blocks.
    """
    blocks = workspace.write(encode(documents), "blocks")
    return score_blocks(blocks, train(blocks, settings), settings)
