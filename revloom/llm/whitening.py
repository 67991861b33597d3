"""Whitening of embeddings by their weighted covariance.

Vectors are put on a grid of whole numbers. Equal grid vectors are one row with their count as weight
(one, where a vector stands alone), so what is multiplied and projected grows with the different
vectors, not with copies. The covariance is a weighted product of centred vectors, summed task by
task; only sums and one matrix of the vectors' width reach the driver. Every different vector is
whitened once and joined back to the rows that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revloom.session import pin

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
# Exact sums are refused beyond this, as 64 bits do not hold them.
LIMIT = 2.0**62
# An eigenvalue below this share of the largest one is rounding.
RANK = 1e-12
ROWS = 8192  # vectors multiplied at once


def on_grid(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """``(id, h, x)``: ``x = floor(scale * c) + shift`` for all finite vectors, ``h`` their hash."""
    c = F.col(vector_col).cast("array<double>")
    whole = F.forall(c, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).alias("id"), c.alias("c")).where(F.coalesce(whole, F.lit(False)))
    x = F.transform("c", lambda v: F.floor(v * F.lit(float(scale))).cast("bigint") + F.lit(shift))
    return rows.select("id", x.alias("x")).select("id", F.xxhash64("x").alias("h"), "x")


def _matrices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Weights and vectors (as rows of a matrix) of parts of the batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            vectors = part.column(column)
            width = len(vectors[0])
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            if np.any(np.diff(vectors.offsets.to_numpy()) != width):
                raise ValueError("vectors differ in width")
            yield part.column("weight").to_numpy(), flat.reshape(len(part), width), part


def _exact(values: np.ndarray) -> np.ndarray:
    """The same numbers; those that 64 bits may not hold end the job."""
    if values.size and np.abs(values.astype(np.float64)).max() > LIMIT:
        raise OverflowError("a sum of grid values does not fit into 64 bits")
    return values


def _fits(*bounds: float) -> None:
    if max(bounds) > LIMIT:
        raise OverflowError("a sum of grid values does not fit into 64 bits")


def _sums(column: str):
    """Per task: weighted sum of each component, and (at -1) the sum of the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for w, x, _ in _matrices(batches, column):
            if x.dtype == np.int64:
                _fits(float(np.abs(x.astype(np.float64)).max(initial=0)) * float(w.sum()))
            part = w.astype(x.dtype) @ x
            if total is not None and len(total) != len(part):
                raise ValueError("vectors differ in width")
            total = part if total is None else _exact(total + part)
            n += int(w.sum())
        if total is not None:
            kind = pa.int64() if total.dtype == np.int64 else pa.float64()
            pos, width = pa.array(range(-1, len(total)), pa.int32()), pa.array([len(total)] * (len(total) + 1), pa.int32())
            values = pa.array(np.concatenate([np.array([n], dtype=total.dtype), total]), kind)
            yield pa.RecordBatch.from_arrays([width, pos, values], ["width", "pos", "value"])

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``: exact for whole numbers."""
    if x.dtype == np.int64:
        _fits(float(np.abs(x.astype(np.float64)).max(initial=0)) * n + float(np.abs(sums.astype(np.float64)).max(initial=0)))
    return n * x - sums


def _products(column: str, n: int, sums: np.ndarray):
    """Per task: the upper half of the weighted product matrix of the centred vectors."""
    rows, cols = np.triu_indices(len(sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sums), len(sums)))
        for w, x, _ in _matrices(batches, column):
            z = _centred(x, n, sums) / n
            total += (z * w[:, None]).T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(total[rows, cols])], ["i", "j", "value"]
        )

    return run


def _weighted_sums(rows: DataFrame, column: str, kind: str) -> tuple[int, np.ndarray]:
    partial = rows.select("weight", column).mapInArrow(_sums(column), f"width int, pos int, value {kind}")
    # One row a component.
    cells = partial.groupBy("width", "pos").agg(F.sum("value").alias("value")).collect()
    if len({c["width"] for c in cells}) > 1:
        raise ValueError("vectors differ in width")
    found = {c["pos"]: c["value"] for c in cells}
    n = int(found.pop(-1, 0))
    return n, np.array([found[i] for i in range(len(found))], dtype=np.int64 if kind == "bigint" else np.float64)


def covariance(rows: DataFrame, column: str, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance (divisor ``n``) of the vectors in ``column``, each as often as its ``weight`` says."""
    k = len(sums)
    partial = rows.select("weight", column).mapInArrow(_products(column, n, sums), "i int, j int, value double")
    # One row a cell of the matrix.
    cells = partial.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    matrix = np.zeros((k, k))
    for i, j, value in cells:
        matrix[i, j] = matrix[j, i] = value / n
    return matrix


def _project(n: int, sums: np.ndarray, axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, x, part in _matrices(batches, "x"):
            d = _centred(x, n, sums)
            _fits(float((d.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
            white = (d / n) @ axes
            ends = np.arange(len(part) + 1, dtype=np.int32) * axes.shape[1]
            yield pa.RecordBatch.from_arrays(
                [part.column("h"), part.column("x"), part.column("weight"), pa.ListArray.from_arrays(ends, white.ravel()), pa.array((d * d).sum(axis=1))],
                ["h", "x", "weight", "white", "deviation"],
            )

    return run


@dataclass
class Whitening:
    """What was fitted, and the whitened different vectors as a table ``(h, x, weight, white, deviation)``."""

    n: int
    sums: np.ndarray
    variances: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # unit eigenvectors as columns
    explained: np.ndarray  # shares of the trace
    identity_error: float
    table: DataFrame


def fit(grid: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on ``grid (id, h, x)`` and whiten every different ``x``; None without rows.

    A component without variance (fewer different vectors than components, or a constant dimension)
    has whitened values 0, explains 0, and does not count in ``identity_error``.
    """
    different = pin(grid.groupBy("h", "x").agg(F.count(F.lit(1)).alias("weight")))
    n, sums = _weighted_sums(different, "x", "bigint")
    if n == 0:
        return None
    matrix = covariance(different, "x", n, sums)
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    live = values > RANK * max(values.max(initial=0.0), 0.0)
    scale = np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0)
    trace = float(np.trace(matrix))
    schema = "h bigint, x array<bigint>, weight bigint, white array<double>, deviation bigint"
    table = pin(different.mapInArrow(_project(n, sums, vectors * scale), schema))
    _, means = _weighted_sums(table, "white", "double")
    error = np.abs(covariance(table, "white", n, means) - np.eye(len(values)))[np.ix_(live, live)].max(initial=0.0)
    explained = np.where(live, values / trace, 0.0) if trace else np.zeros(len(values))
    return Whitening(n, sums, values, vectors, explained, float(error), table)


COLUMNS = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """One row per vector and component: ``(id, component, n, deviation, whitened, explained, identity_error)``.

    Rows whose vector is null or holds a null or non-finite number are left out. All others are fitted
    on and returned, each row by itself: repeated ids, null ids and copies too. Fewer dimensions than
    ``components`` give as many components as there are; vectors without dimensions give no rows. Vectors
    of different widths, and numbers so large that 64 bits do not hold their exact sums, end the job.
    Other columns are ignored; an empty table gives an empty one.
    """
    grid = on_grid(vectors, id_col, vector_col, scale, shift)
    fitted = fit(grid, components)
    if fitted is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {COLUMNS}")
    shares = F.array(*[F.lit(float(v)) for v in fitted.explained]).cast("array<double>")
    each = F.transform(
        "white",
        lambda w, i: F.struct((i + 1).cast("int").alias("component"), w.alias("whitened"), F.get(shares, i).alias("explained")),
    )
    # A vector that many rows hold is one row on the right; adaptive execution splits it on the left.
    rows = grid.join(fitted.table.select("h", "x", "white", "deviation"), ["h", "x"]).select("id", "deviation", F.explode(each).alias("c"))
    return rows.select(
        F.col("id").alias(id_col), "c.component", F.lit(fitted.n).cast("bigint").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(fitted.identity_error).alias("identity_error"),
    )
