"""Sinks: Parquet tables, edge lists, summaries, metric rows, fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Parquet; settings such as ``k`` and ``c`` are partition columns, not parts of a path."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_edges(edges: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """``src dst`` lines separated by a space.

    One file per task by default. ``single_file`` is for a consumer that cannot read a folder and
    puts the whole list through one task.
    """
    out = edges.select("src", "dst")
    out = out.coalesce(1) if single_file else out
    out.write.mode(mode).option("sep", " ").csv(path)


def write_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small summary as CSV with a header line."""
    summary.write.mode(mode).option("header", True).csv(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add metric or parameter rows to a Parquet log."""
    metrics.write.mode("append").parquet(path)


def save_model(model: MLWritable, path: str, mode: str = "overwrite") -> None:
    """Save a fitted Spark ML model; ``mode="error"`` refuses to replace one."""
    if mode not in ("overwrite", "error"):
        raise ValueError(f"unknown mode {mode!r}")
    writer = model.write()
    (writer.overwrite() if mode == "overwrite" else writer).save(path)


def load_model(model_class: type[MLReadable], path: str):
    return model_class.load(path)
