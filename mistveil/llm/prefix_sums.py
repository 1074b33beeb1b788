"""Positions and running totals over a whole table in sorted order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Rows of a partition are numbered below this bit by monotonically_increasing_id, partitions from it on.
_PART_BIT = 33


def in_order(df: DataFrame, scratch: Scratch, name: str, order: list[Column], position: str = "pos", totals: dict[str, str] | None = None) -> DataFrame:
    """df sorted by `order`, written to scratch, with `position` (from 0) and, for each of totals, the sum of a column over all rows before.

    Rows are dealt by ranges and sorted there; what lies before a range comes from one row of sums for each range. Ranges are
    even as long as few rows are equal in all of `order`; equal rows are numbered in any order.
    """
    totals = totals or {}
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.cut(ranged, name).withColumn("_part", F.shiftright("_at", _PART_BIT))
    sums = rows.groupBy("_part").agg(F.count("*").alias("_rows"), *(F.sum(c).alias(f"_{t}") for t, c in totals.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    zero = F.lit(0).cast("long")
    starts = sums.select("_part", *(F.coalesce(F.sum(x).over(before), zero).alias(x) for x in ["_rows", *(f"_{t}" for t in totals)]))
    if totals:
        within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.select("*", *(F.coalesce(F.sum(c).over(within), zero).alias(t) for t, c in totals.items()))
    rows = rows.join(F.broadcast(starts), "_part").withColumn(position, F.col("_rows") + F.col("_at").bitwiseAND(F.lit((1 << _PART_BIT) - 1)))
    for t in totals:
        rows = rows.withColumn(t, F.col(t) + F.col(f"_{t}"))
    return rows.drop("_at", "_part", "_rows", *(f"_{t}" for t in totals))
