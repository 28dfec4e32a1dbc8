"""Dense numbers over an order, without ever sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.session import Workspace

# monotonically_increasing_id() puts the row's number within its partition into the low 33 bits.
_ROW_BITS = 33


def number_rows(
    frame: DataFrame, order: list[str], name: str, workspace: Workspace, weight: str | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add ``name``: how many rows (or how much ``weight``) come before each row in the given order.

    With a weight, ``number`` also adds how many rows come before. The rows are range-partitioned and sorted within
    partitions; the written result fixes which row is where. Only one total per partition is brought together, so the
    prefix sums are over as many rows as there are partitions, which also bounds what is broadcast.
    """
    placed = (
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("slot", F.spark_partition_id())
        .withColumn("row_in_slot", F.monotonically_increasing_id().bitwiseAND(2**_ROW_BITS - 1))
    )
    placed = workspace.write(placed, f"placed-{name}")
    before_slot = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    amounts = {name: F.count("*") if weight is None else F.sum(weight)} | ({number: F.count("*")} if number else {})
    totals = placed.groupBy("slot").agg(*[amount.alias(f"total_{added}") for added, amount in amounts.items()])
    offsets = totals.select(
        "slot", *[F.coalesce(F.sum(f"total_{added}").over(before_slot), F.lit(0)).alias(f"before_{added}") for added in amounts]
    )
    in_slot = {name: F.col("row_in_slot")} | ({number: F.col("row_in_slot")} if number else {})
    if weight is not None:
        before_row = Window.partitionBy("slot").orderBy("row_in_slot").rowsBetween(Window.unboundedPreceding, -1)
        in_slot[name] = F.coalesce(F.sum(weight).over(before_row), F.lit(0))
    return (
        placed.withColumns({f"within_{added}": value for added, value in in_slot.items()})
        .join(F.broadcast(offsets), "slot")
        .withColumns({added: F.col(f"before_{added}") + F.col(f"within_{added}") for added in amounts})
        .select(*frame.columns, *amounts)
    )
