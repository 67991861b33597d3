"""Scans: record files with an explicit schema, text lines, Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from revloom.operators.ordering import running_total
from revloom.session import pin
from revloom.sources import schemas

MALFORMED = "__malformed"


def read_json(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    multi_line: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """One record per line, or records spanning lines with ``multi_line``.

    ``partitions`` forces a shuffle on ingest; leave it out unless the files cannot be split.
    """
    df = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return df.repartition(partitions) if partitions else df


def read_reviews(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_json(spark, path, schemas.REVIEW, **options)


def read_businesses(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_json(spark, path, schemas.BUSINESS, **options)


def read_users(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_json(spark, path, schemas.USER, **options)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as one string column ``value``."""
    return spark.read.text(path)


def read_numbered_lines(spark: SparkSession, path: str, number: str = "line_id", start: int = 1) -> DataFrame:
    """``(value, number)``: text lines numbered in their order, over the files of a folder in the order of their paths.

    Lines are written once with the split (file and first byte) they were read in and their place there, so that numbers
    cannot change with how files are split; splits are numbered by a running total of their lines, one row each,
    which is what is broadcast. The text is neither sorted nor shuffled. Empty lines count.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__first"),
        F.monotonically_increasing_id().alias("__row"),
    )
    lines = pin(lines)
    splits = lines.groupBy("__file", "__first").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__least"))
    splits = running_total(splits, ["__file", "__first"], "__n", "__before")
    shift = splits.select("__file", "__first", (F.col("__before") - F.col("__least") + start).alias("__shift"))
    numbered = lines.join(F.broadcast(shift), ["__file", "__first"])
    return numbered.select("value", (F.col("__row") + F.col("__shift")).cast("bigint").alias(number))


def read_whole_records(
    spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Records with every field that any of them has, and the malformed ones as text in a column ``value``.

    A first pass finds the union of the fields, task by task; types of fields in ``schema`` are as given there. A
    record is malformed if it is no JSON object or a field does not fit its type. Empty lines are none.
    """
    reader = spark.read.option("multiLine", multi_line).option("columnNameOfCorruptRecord", MALFORMED)
    found = reader.json(path).schema
    given = StructType.fromDDL(schema) if isinstance(schema, str) else schema or StructType()
    fields = [*given, *[f for f in found if f.name not in given.names and f.name != MALFORMED]]
    whole = StructType([*fields, StructField(MALFORMED, StringType())])
    if multi_line:
        rows = pin(reader.schema(whole).json(path))
    else:
        text = spark.read.text(path).where(F.trim("value") != "")
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
        rows = text.select("value", F.from_json("value", whole, options).alias("r")).select("r.*")
    bad = F.col(MALFORMED).isNotNull()
    return rows.where(~bad).select(*[f"`{f.name}`" for f in fields]), rows.where(bad).select(F.col(MALFORMED).alias("value"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
