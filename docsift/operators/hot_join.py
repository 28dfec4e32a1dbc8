"""Joins of many rows with a table of unique keys, safe against keys that hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import Workspace

# A lookup table is broadcast only if it was measured to be within both bounds.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
# At most this many keys can each hold more than 1/HOT_KEYS of all rows.
HOT_KEYS = 10_000


def small_enough(lookup: DataFrame, rows: int, size: int, workspace: Workspace) -> bool:
    """Whether the lookup (a written table) is within both bounds: its rows, and the bytes of all its columns as text."""
    found_rows, found_size = workspace.measured(lookup)
    return found_rows <= rows and found_size <= size


def hot_keys(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that hold more than 1/HOT_KEYS of the rows: fewer than HOT_KEYS of them, whatever the data."""
    least = max(facts.count() // HOT_KEYS, 1)
    return facts.groupBy(*keys).count().where(F.col("count") > least).select(*keys)


def join_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str,
    workspace: Workspace,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``facts`` joined (inner, left or left_semi) with a written table ``lookup`` whose keys are unique.

    A lookup measured to be small is broadcast. Otherwise rows with hot keys are joined by broadcasting just
    the hot keys' lookup rows, which are few by arithmetic, and only the rest is shuffled by key.
    Keys must not be null.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type {how}")
    if small_enough(lookup, broadcast_rows, broadcast_bytes, workspace):
        return facts.join(F.broadcast(lookup), keys, how)
    hot = workspace.write(hot_keys(facts, keys), "hot-keys")
    if not small_enough(hot, HOT_KEYS, broadcast_bytes, workspace):
        return facts.join(lookup, keys, how)
    hot_lookup = workspace.write(lookup.join(F.broadcast(hot), keys, "left_semi"), "hot-lookup")
    if not small_enough(hot_lookup, broadcast_rows, broadcast_bytes, workspace):
        # Few keys, but too long to be sent to every task: Spark may still split the join's skewed partitions.
        return facts.join(lookup, keys, how)
    hot_rows = facts.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(hot_lookup), keys, how)
    other_rows = facts.join(F.broadcast(hot), keys, "left_anti").join(lookup, keys, how)
    return hot_rows.unionByName(other_rows)
