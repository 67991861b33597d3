"""Dense numbers and running totals over a total order, without a one-task window.

Rows are range-partitioned and sorted, the result is pinned (range bounds come from a sample and
must not be drawn twice), and each partition is shifted by the totals of those before it. The
shift table has one row per partition, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from revloom.session import pin

PART = "__part"
POS = "__pos"


def _partitions(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _offsets(per_part: DataFrame, amount: str, out: str) -> DataFrame:
    """Exclusive running total of ``amount`` over partition numbers: one row per partition."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(
        per_part.select(PART, F.coalesce(F.sum(amount).over(before), F.lit(0)).alias(out))
    )


def number_rows(
    df: DataFrame,
    order_by: Sequence[Column],
    out: str = "idx",
    start: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """Number rows ``start, start + 1, …`` in the given order, which should be a total one."""
    ranged = df.repartitionByRange(_partitions(df, partitions), *order_by).sortWithinPartitions(*order_by)
    row = F.monotonically_increasing_id()
    # The id holds the partition in its upper bits and the row's place in its lower 33.
    pinned = pin(
        ranged.withColumn(PART, F.spark_partition_id()).withColumn(
            POS, row - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
        )
    )
    per_part = pinned.groupBy(PART).agg(F.count(F.lit(1)).alias("__n"))
    return (
        pinned.join(_offsets(per_part, "__n", "__shift"), PART)
        .withColumn(out, (F.col("__shift") + F.col(POS) + start).cast("bigint"))
        .drop(PART, POS, "__shift")
    )


def running_total(
    df: DataFrame, order_by: Sequence[str], amount: str, out: str, partitions: int | None = None
) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows that come earlier (exclusive).

    Rows should be distinct in ``order_by``, so that the range partitions are even.
    """
    cols = [F.col(c) for c in order_by]
    pinned = pin(
        df.repartitionByRange(_partitions(df, partitions), *cols).withColumn(PART, F.spark_partition_id())
    )
    before = Window.partitionBy(PART).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    per_part = pinned.groupBy(PART).agg(F.sum(amount).alias("__n"))
    return (
        pinned.withColumn("__within", F.coalesce(F.sum(amount).over(before), F.lit(0)))
        .join(_offsets(per_part, "__n", "__shift"), PART)
        .withColumn(out, (F.col("__within") + F.col("__shift")).cast("bigint"))
        .drop(PART, "__within", "__shift")
    )
