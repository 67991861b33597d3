"""Train/test splits: by key hash, or by date over all rows or per user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DateType

from revloom.functions.hashing import bucket
from revloom.operators.ordering import running_total
from revloom.session import pin

# Dates whose ranks are sent to all workers: more than ten thousand years have none.
MAX_DATES = 4_000_000


def hash_split(df: DataFrame, keys: Sequence[str], train: float = 0.8, seed: int = 12345) -> DataFrame:
    """Add ``is_train`` from a hash of the row key: no shuffle, the same under any partitioning."""
    return df.withColumn("is_train", bucket(keys, seed, 10_000) < round(train * 10_000))


def percent_ranks(df: DataFrame, order_by: str, by: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row per distinct ``(by, order_by)`` with its exact ``percent_rank``.

    Rank minus one is the number of rows that come earlier, so rows are counted per distinct value
    first and the running sum sees only those. A date column has a bounded number of values, so a
    window over them (per group, too) is safe; other types go through range partitions.
    """
    keys = [by] if by else []
    counts = df.groupBy(*keys, order_by).agg(F.count(F.lit(1)).alias("__rows"))
    if isinstance(df.schema[order_by].dataType, DateType):
        group = Window.partitionBy(*keys)
        earlier = group.orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.select(
            *keys,
            order_by,
            F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
            F.sum("__rows").over(group).alias("__all"),
        )
    else:
        total = running_total(counts, [*keys, order_by], "__rows", "__before", partitions)
        if by:
            groups = total.groupBy(by).agg(F.min("__before").alias("__start"), F.sum("__rows").alias("__all"))
            ranked = total.join(groups, by).withColumn("__before", F.col("__before") - F.col("__start"))
        else:
            rows = total.agg(F.sum("__rows")).first()[0] or 0
            ranked = total.withColumn("__all", F.lit(rows))
    rank = F.when(F.col("__all") > 1, F.col("__before") / (F.col("__all") - 1)).otherwise(F.lit(0.0))
    return ranked.select(*keys, order_by, rank.alias("percent_rank"))


def chronological_split(
    df: DataFrame, order_by: str = "date", by: str | None = None, train: float = 0.8, partitions: int | None = None
) -> DataFrame:
    """Add ``percent_rank`` of ``order_by`` (within ``by`` if given) and ``is_train``.

    Rows without ``by`` or ``order_by`` drop out.
    """
    keys = [by, order_by] if by else [order_by]
    whole = df.na.drop(subset=keys)
    ranks = percent_ranks(whole, order_by, by, partitions)
    if by is None and isinstance(df.schema[order_by].dataType, DateType):
        # One row per date, so reviews need no shuffle; written first, so that the count costs no second pass.
        ranks = pin(ranks)
        if ranks.count() <= MAX_DATES:
            ranks = F.broadcast(ranks)
    return whole.join(ranks, keys).withColumn("is_train", F.col("percent_rank") <= train)
