"""String keys to dense numbers, and the use of a known dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revloom.operators.ordering import number_rows


def dense_index(df: DataFrame, key: str, out: str = "idx", partitions: int | None = None) -> DataFrame:
    """Dictionary ``(key, out, n)``: 0 for the most frequent key, ties in key order; no null key.

    The same numbers as Spark's ``StringIndexer``, but the labels never meet on the driver.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return number_rows(counts, [F.desc("n"), F.asc(key)], out, partitions=partitions).select(key, out, "n")


def apply_dictionary(
    df: DataFrame, dictionary: DataFrame, col: str, out: str, key: str, idx: str = "idx"
) -> DataFrame:
    """Add ``out``: the number of ``df[col]`` in ``dictionary(key, idx)``; unknown values are skipped."""
    lookup = dictionary.select(F.col(key).alias(col), F.col(idx).alias(out))
    return df.join(lookup, col)
