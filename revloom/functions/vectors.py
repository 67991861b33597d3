"""Arithmetic on ``array<double>`` columns of a known width ``k``.

Component-wise work uses higher-order functions, which keep the expression small. A scalar that all
components need (a norm, a sum) is repeated into an array first, so that it is computed once per
row and not once per component. Sums over groups are written out as ``k`` plain sums, which run in
the generated hash aggregation. Vector columns of Spark ML are converted at the edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StructType

# Above this width sums are packed: plain ones would leave generated code and make plans grow with it.
WIDE = 96
# A task hands its partial sums on when it holds this many numbers.
SUM_BUFFER = 4_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def components(vector: Column | str, k: int) -> list[Column]:
    """The ``k`` component columns; null where the vector is null or shorter."""
    return [F.get(_col(vector), F.lit(i)) for i in range(k)]


def to_vector(array: Column | str) -> Column:
    return array_to_vector(_col(array))


def arrays(df: DataFrame, *cols: str) -> DataFrame:
    """Turn Spark ML vector columns into ``array<double>``; other columns are cast to it.

    Rows with a null vector drop out (``vector_to_array`` fails on them).
    """
    for name in cols:
        if isinstance(df.schema[name].dataType, VectorUDT):
            df = df.where(F.col(name).isNotNull()).withColumn(name, vector_to_array(name))
        else:
            df = df.withColumn(name, F.col(name).cast("array<double>"))
    return df


def total(vector: Column | str) -> Column:
    return F.aggregate(_col(vector), F.lit(0.0), lambda acc, x: acc + x)


def hadamard(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x * y)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(hadamard(a, b))


def l2_norm(vector: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def scale(vector: Column | str, factor: Column) -> Column:
    v = _col(vector)
    return F.zip_with(v, F.array_repeat(factor, F.size(v)), lambda x, s: x * s)


def divide(vector: Column | str, divisor: Column) -> Column:
    v = _col(vector)
    return F.zip_with(v, F.array_repeat(divisor, F.size(v)), lambda x, s: x / s)


def l2_normalise(vector: Column | str) -> Column:
    """Divide by the Euclidean norm; a zero vector stays zero."""
    norm = F.nullif(l2_norm(vector), F.lit(0.0))
    return divide(vector, F.coalesce(norm, F.lit(1.0)))


def sum_normalise(
    df: DataFrame, vector: str, out: str, min_abs_sum: float = 0.0
) -> DataFrame:
    """Divide by the signed component sum.

    Rows whose sum is not finite, or not above ``min_abs_sum`` in size, have no normal form (the
    quotient would be NaN or infinite) and are dropped.
    """
    size = F.abs(total(vector))
    usable = (size > F.lit(float(min_abs_sum))) & (size < F.lit(float("inf")))
    return df.where(usable).withColumn(out, divide(vector, total(vector)))


def of_width(vector: Column | str, k: int, kind: DataType | str = "array<double>") -> Column:
    """The vector, of type ``kind``; one of another width than ``k`` ends the job, a null one stays null."""
    v = _col(vector)
    message = F.format_string("a vector has %d components, not %d", F.size(v), F.lit(k))
    return F.when(v.isNull() | (F.size(v) == k), v).otherwise(F.raise_error(message).cast(kind))


def is_finite(vector: Column | str, k: int) -> Column:
    """True for a vector of ``k`` finite numbers; false for a null one or one with a null or non-finite number.

    Another width is no bad row but a wrong ``k`` and ends the job.
    """
    v, most = of_width(vector, k), F.lit(float("inf"))
    # Without a lambda, which would be interpreted. Not found among nulls is null; NaN is above everything.
    whole = ~F.array_contains(v, most) & (F.array_max(v) < most) & (F.array_min(v) > -most)
    return F.coalesce(whole, F.lit(False))


def vector_sums(df: DataFrame, keys: list[str], vector: str, k: int) -> DataFrame:
    """Per-group vector sum and row count: ``(keys, vector, n)``.

    One partial and one final hash aggregation over ``k`` double buffers, so a hot group is
    combined before the shuffle. Null vectors are not counted; another width than ``k`` is an error.
    Above ``WIDE`` components sums are packed (``packed_sums``).
    """
    if k > WIDE:
        return packed_sums(df, keys, vector, k)
    sums = [F.sum(x).alias(f"__s{i}") for i, x in enumerate(components(vector, k))]
    grouped = df.withColumn(vector, of_width(vector, k)).groupBy(*keys).agg(F.count(vector).alias("n"), *sums)
    return grouped.select(*keys, F.array(*[F.col(f"__s{i}") for i in range(k)]).alias(vector), "n")


def packed_sums(df: DataFrame, keys: list[str], vector: str, k: int) -> DataFrame:
    """As ``vector_sums``, with a plan that is the same for every width.

    A task adds up the vectors of each key it meets and hands on one packed row per key whenever its buffer is full;
    Spark adds these rows up. A null component counts as 0. A group of null vectors only has null components.
    """
    keyed = df.select(F.struct(*[F.col(c) for c in keys]).alias("key"), of_width(vector, k).alias("v"))
    partial = keyed.mapInArrow(_partial_sums(k), StructType().add("key", keyed.schema["key"].dataType).add("s", ArrayType(DoubleType())).add("n", LongType()))
    sums = partial.groupBy("key").agg(Summarizer.sum(array_to_vector("s")).alias("s"), F.sum("n").alias("n"))
    names = [F.col("key").getField(c).alias(c) for c in keys]
    whole = F.transform(vector_to_array("s"), lambda x: F.when(F.col("n") > 0, x))
    return sums.select(*names, whole.alias(vector), "n")


def _partial_sums(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        kind = None

        def flush() -> pa.RecordBatch:
            found = list(sums.items())
            sums.clear()
            key = pa.array([dict(zip(names, values)) for values, _ in found], kind)
            flat = np.concatenate([s for _, (s, _) in found])
            ends = np.arange(len(found) + 1, dtype=np.int32) * k
            return pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(ends, flat), pa.array([n for _, (_, n) in found], pa.int64())], ["key", "s", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, v = batch.column("key"), batch.column("v")
            kind = key.type
            names = [kind.field(i).name for i in range(kind.num_fields)]
            whole = np.asarray(v.is_valid())
            x = pc.fill_null(v.flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, k)
            place: dict[tuple, int] = {}
            own = np.array([place.setdefault(values, len(place)) for values in zip(*(c.to_pylist() for c in key.flatten()))])
            # Rows of a key behind each other, so that each key is one sum.
            counts = np.bincount(own[whole], minlength=len(place))
            order = np.argsort(own[whole], kind="stable")
            met = np.flatnonzero(counts)
            part = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[met]) if len(met) else x
            at = dict(zip(met.tolist(), range(len(met))))
            for values, i in place.items():
                held = sums.setdefault(values, [np.zeros(k), 0])
                if i in at:
                    held[0] += part[at[i]]
                    held[1] += int(counts[i])
            if len(sums) * k > SUM_BUFFER:
                yield flush()
        if sums:
            yield flush()

    return run
