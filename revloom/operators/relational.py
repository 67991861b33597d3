"""Row filters shared by the preparation steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def not_empty(col: str) -> Column:
    """True for a non-empty string; false for the empty one, null for null."""
    return F.col(col) != ""


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in ``cols`` (default: in any column)."""
    return df.na.drop(subset=list(cols) if cols else None)


def rename(df: DataFrame, **new_to_old: str) -> DataFrame:
    """Keep only the named columns, under new names: ``rename(df, label="stars")``."""
    return df.select(*[F.col(old).alias(new) for new, old in new_to_old.items()])
