"""Shards by jump consistent hashing (Lamping and Veach), in built-in functions only.

A key's shard among n is the last value below n of a rising chain of numbers that the key alone decides. With one
shard more, a row either stays or moves to the new shard; no table of ring positions is kept.

The chain comes from the 64-bit generator of the published algorithm. Spark's long arithmetic refuses to overflow, so
its state is held as two halves of 32 bits and multiplied in pieces of 16 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import whole_text
from docsift.operators.numbering import number_rows
from docsift.session import Workspace

# Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
LOW_16, LOW_32 = 2**16 - 1, 2**32 - 1
# The chain of a key rarely has more links than this (their mean number is the logarithm of the shard count).
USUAL_LINKS = 64


def key_halves(key: Column) -> tuple[Column, Column]:
    """The upper and lower 32 bits of the key's hash: of the first 16 digits of the MD5 of its text; null counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(digest, place, 8), 16, 10).cast("long") for place in (1, 9))


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """The halves of (state * MULTIPLIER + 1) modulo 2^64."""
    m0, m1, m2, m3 = (MULTIPLIER >> shift & LOW_16 for shift in (0, 16, 32, 48))
    first = low * m0 + 1
    second = low * m1 + F.shiftright(first, 16)
    new_low = F.shiftleft(second.bitwiseAND(LOW_16), 16) + first.bitwiseAND(LOW_16)

    def modulo(half: Column, lower: int, upper: int) -> Column:
        return half * lower + F.shiftleft((half * upper).bitwiseAND(LOW_16), 16)

    new_high = F.shiftright(second, 16) + modulo(high, m0, m1) + modulo(low, m2, m3)
    return new_high.bitwiseAND(LOW_32), new_low


def _follow(high: Column, low: Column, counts: list[int], links: int) -> Column:
    """The chain's last value below each of the counts, and the first one not below the largest if reached."""
    start = F.struct(
        high.alias("high"), low.alias("low"), F.lit(0).cast("long").alias("at"),
        *[F.lit(0).cast("long").alias(f"shard_{n}") for n in counts],
    )

    def link(state: Column, _: Column) -> Column:
        new_high, new_low = _next_state(state["high"], state["low"])
        share = F.lit(float(2**31)) / (F.shiftright(new_high, 1) + 1).cast("double")
        following = F.floor((state["at"] + 1).cast("double") * share).cast("long")
        ended = state["at"] >= max(counts)
        return F.struct(
            F.when(ended, state["high"]).otherwise(new_high).alias("high"),
            F.when(ended, state["low"]).otherwise(new_low).alias("low"),
            F.when(ended, state["at"]).otherwise(following).alias("at"),
            *[
                F.when(~ended & (following < n), following).otherwise(state[f"shard_{n}"]).alias(f"shard_{n}")
                for n in counts
            ],
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(links)), start, link)


def jump_shards(key: Column, counts: list[int]) -> Column:
    """A struct with ``shard_<n>``, the key's shard among n, for each of the counts.

    A chain has at most as many links as there are shards. The few keys whose chain is unusually long are followed
    to its end.
    """
    if min(counts) < 1:
        raise ValueError("there must be at least one shard")
    high, low = key_halves(key)
    usual = min(max(counts), USUAL_LINKS)
    found = _follow(high, low, counts, usual)
    if usual == max(counts):
        return found
    return F.when(found["at"] >= max(counts), found).otherwise(_follow(high, low, counts, max(counts)))


def shard_documents(documents: DataFrame, shards: int, workspace: Workspace) -> DataFrame:
    """Every row with its shard among ``shards``, its place there, and its shard if there were one more.

    ``documents`` has doc_id and text; other columns are ignored. Returns doc_id, size (UTF-8 bytes plus 1),
    text_crc32, law ('key'), shard, slot (gapless from 0 within the shard, by doc_id), grown_shard. A null text has no
    bytes and the CRC of none. A null doc_id is a key like any other. Repeated rows go to the same shard and take a
    slot each. An empty table gives no rows.

    Only narrow rows are shuffled: one range partitioning by shard and doc_id, in which a shard spans many partitions.
    """
    found = jump_shards(F.col("doc_id"), [shards, shards + 1])
    narrow = documents.select("doc_id", whole_text().alias("whole")).select(
        "doc_id",
        (F.octet_length("whole") + 1).cast("long").alias("size"),
        F.crc32(F.col("whole").cast("binary")).alias("text_crc32"),
        found.alias("found"),
    )
    placed = workspace.write(
        narrow.select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"),
            F.col(f"found.shard_{shards}").cast("int").alias("shard"),
            F.col(f"found.shard_{shards + 1}").cast("int").alias("grown_shard"),
        ),
        "sharded",
    )
    numbered = number_rows(placed, ["shard", "doc_id", "text_crc32", "size"], "number", workspace)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each shard.
    firsts = placed.groupBy("shard").agg(F.count("*").alias("rows")).select(
        "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first")
    )
    return numbered.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("number") - F.col("first")).alias("slot"), "grown_shard"
    )
