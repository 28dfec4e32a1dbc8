"""SimHash near-duplicates through sharded BK-trees.

1. Fingerprints of the documents, in one pass without a shuffle.
2. Equal fingerprints become one, with the smallest of their doc_ids: copies never meet again below.
3. The bits are cut into 6 blocks. Two fingerprints that differ in at most 4 bits agree in at least 2 of the blocks,
   so they meet in one of the 15 shards that pairs of blocks name. A shard's fingerprints form a BK-tree, which
   answers which of them hang together within the radius. Trees hold a share of the corpus and grow with it, so
   they are not broadcast: the shuffle brings each shard's queries to its tree.
4. A shard reports a star for each group it finds, not its pairs; components join the stars of all shards.

A shard with more than ``shard_limit`` fingerprints is split into smaller ones, of which every two meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.bk_tree import linked_groups
from docsift.llm.common import whole_text
from docsift.llm.components import connected_components
from docsift.operators.hot_join import join_lookup
from docsift.session import Workspace

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
SHARD_LIMIT = 20_000
# Shingles whose bits are counted at a time.
SLICE = 1 << 15
_LOWER = bytes(code + 32 if 65 <= code <= 90 else code for code in range(256))


def shingle_hashes(text: str, shingle_words: int) -> np.ndarray:
    """The hashes of a text's shingles in order; a shorter text is one shingle, one without words has none."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[start:end], SEED) for start, end in zip(starts, ends)), dtype="<u8", count=len(ends)
    )


def fingerprint(text: str) -> int:
    """The SimHash of a text's shingles: of each bit, whether more than half of the shingles' hashes have it."""
    hashes = shingle_hashes(text, SHINGLE_WORDS)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[at : at + SLICE].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(bit) for bit in np.flatnonzero(2 * counts > len(hashes))))


def text_hash() -> Column:
    """A 64-bit hash of a row's text, null being the empty one."""
    return F.xxhash64(whole_text())


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash and fingerprint (the 64 bits as a signed long) of every row; a null text is the empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fingerprint", pa.int64())])

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py()) for text in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(found.view(np.int64))], schema=schema
            )

    whole = documents.select("doc_id", text_hash().alias("text_hash"), whole_text().alias("whole"))
    return whole.mapInArrow(computed, "doc_id long, text_hash long, fingerprint long")


def _shards(distinct: DataFrame) -> DataFrame:
    """fingerprint, shard: a fingerprint's 15 shards, named by a pair of blocks and the bits there."""
    starts = np.cumsum((0, *BLOCK_BITS)).tolist()
    blocks = [
        F.shiftrightunsigned("fingerprint", start).bitwiseAND((1 << bits) - 1)
        for start, bits in zip(starts, BLOCK_BITS, strict=False)
    ]
    names = [
        F.shiftleft(F.lit(number).cast("long"), 24).bitwiseOR(F.shiftleft(blocks[a], 11)).bitwiseOR(blocks[b])
        for number, (a, b) in enumerate(combinations(range(len(blocks)), 2))
    ]
    return distinct.select("fingerprint", F.explode(F.array(*names)).alias("shard"))


def _split_large(members: DataFrame, limit: int, workspace: Workspace) -> DataFrame:
    """Adds ``part``: 0, or for a shard above the limit the number of a pair of its parts, all pairs being formed."""
    large = workspace.write(
        members.groupBy("shard").count().where(F.col("count") > limit)
        .select("shard", F.ceil(2 * F.col("count") / limit).cast("long").alias("parts")),
        "large-shards",
    )
    if large.isEmpty():
        return members.withColumn("part", F.lit(0).cast("long"))
    of_shard = members.join(large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts"))
    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    pair = F.transform(others, lambda other: F.least(own, other) * F.col("parts") + F.greatest(own, other))
    return of_shard.select("fingerprint", "shard", F.explode(pair).alias("part"))


def _stars(members: DataFrame, radius: int) -> DataFrame:
    """a, b: within each (shard, part), every linked fingerprint with the smallest of its group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_shard, held_part, held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def groups(shard: np.ndarray, part: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            bounds = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1
            bounds = np.concatenate([[0], bounds, [len(values)]])
            several = np.flatnonzero(np.diff(bounds) > 1).tolist()
            a: list[int] = []
            b: list[int] = []
            for place in several:
                members = values[bounds[place] : bounds[place + 1]].view(np.uint64).tolist()
                for group in linked_groups(members, radius):
                    least = min(group)
                    group.remove(least)
                    a += group
                    b += [least] * len(group)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(side, dtype=np.uint64).view(np.int64)) for side in (a, b)], schema=schema
            )

        for batch in batches:
            columns = [
                np.concatenate([kept, batch.column(name).to_numpy()])
                for name, kept in (("shard", held_shard), ("part", held_part), ("fingerprint", held))
            ]
            shard, part, values = columns
            # The last group of a batch may go on in the next one.
            last = (shard != shard[-1]) | (part != part[-1]) if len(values) else np.zeros(0, bool)
            end = int(last.sum())
            if end:
                yield groups(shard[:end], part[:end], values[:end])
            held_shard, held_part, held = shard[end:], part[end:], values[end:]
        if len(held):
            yield groups(held_shard, held_part, held)

    met = members.repartition("shard", "part").sortWithinPartitions("shard", "part")
    return met.mapInArrow(linked, "a long, b long")


def _grouped(documents: DataFrame, workspace: Workspace, radius: int, shard_limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows' ids, texts' hashes and fingerprints, and the component of each fingerprint: two written tables."""
    if not 0 <= radius <= 4:
        raise ValueError("the shards find links of at most 4 bits")
    rows = workspace.write(fingerprints(documents), "fingerprints")
    distinct = workspace.write(rows.select("fingerprint").distinct(), "distinct")
    members = _split_large(_shards(distinct), shard_limit, workspace)
    stars = workspace.write(_stars(members, radius).distinct(), "stars")
    linked = connected_components(stars, workspace)
    of_node = distinct.join(linked, distinct["fingerprint"] == linked["node"], "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component")
    )
    return rows, workspace.write(of_node, "components")


def near_duplicates(documents: DataFrame, workspace: Workspace, radius: int = RADIUS,
                    shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row.

    The component is the smallest doc_id that can be reached over links of at most ``radius`` (up to 4) differing bits.
    Texts without words have the fingerprint zero and are linked like all others. A null doc_id gets the component
    of its fingerprint but names none (null if nothing else is in it). Repeated rows are in the same component. Other
    columns are ignored; an empty table gives no rows.
    """
    rows, components = _grouped(documents, workspace, radius, shard_limit)
    least = workspace.write(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "least-ids")
    of_node = workspace.write(components.join(least, "fingerprint"), "of-node")
    named = of_node.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labelled = workspace.write(
        of_node.join(named, "component").select("fingerprint", "component_id"), "labelled"
    )
    # Rows with one fingerprint may be a third of all; they meet one row.
    return join_lookup(rows, labelled, ["fingerprint"], "inner", workspace).select(
        "doc_id", "fingerprint", "component_id"
    )


def keep_one_of_each(documents: DataFrame, workspace: Workspace, radius: int = RADIUS) -> DataFrame:
    """All columns of one row of each component: of its smallest doc_id. Rows with a null doc_id all stay.

    A row is known by its doc_id and its text's hash, so rows of one doc_id with texts of different components stay,
    one for each component; of rows equal in both one stays. Only narrow rows decide; texts are shuffled once, by
    that key, to meet the decision and each other.
    """
    rows, components = _grouped(documents.where("doc_id IS NOT NULL"), workspace, radius, SHARD_LIMIT)
    kinds = workspace.write(rows.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")), "kinds")
    keepers = kinds.join(components, "fingerprint").groupBy("component").agg(F.min("first").alias("first"))
    keepers = workspace.write(
        keepers.select(F.col("first.doc_id").alias("key"), F.col("first.text_hash").alias("text_hash")), "keepers"
    )
    keyed = documents.where("doc_id IS NOT NULL").select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), text_hash().alias("text_hash")
    )
    # The number of equal rows is limited in each task first, so they do not meet in one.
    once = F.row_number().over(Window.partitionBy("key", "text_hash").orderBy("key"))
    kept = keyed.withColumn("place", once).where("place = 1").join(keepers, ["key", "text_hash"], "left_semi")
    return kept.select("row.*").unionByName(documents.where("doc_id IS NULL"))
