"""Vectors looked up in a file of the shared checkpoint folder, which workers map into memory.

For tables that one machine holds easily, but that are too large to be built on the driver and sent, and whose join
would exchange wide rows. The workers of a machine share the mapped pages; the driver holds none of it.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegralType, StructType

from revloom.session import scratch_path

# Vectors of up to so many bytes are mapped.
MAPPED_BYTES = 1_000_000_000


def can_map(table: DataFrame, key: str, rows: int, k: int) -> bool:
    return isinstance(table.schema[key].dataType, IntegralType) and rows * 8 * (k + 1) <= MAPPED_BYTES


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    url = urlparse(path)
    return (fs.LocalFileSystem(), url.path) if url.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _write(path: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        system.create_dir(os.path.dirname(root))
        rows = 0
        with system.open_output_stream(f"{root}.keys") as keys, system.open_output_stream(f"{root}.vectors") as vectors:
            for batch in batches:
                keys.write(batch.column(0).to_numpy().astype(np.int64).tobytes())
                x = batch.column(1).flatten()
                if len(x) != k * batch.num_rows:
                    raise ValueError(f"a vector has another width than {k}")
                vectors.write(pc.fill_null(x, np.nan).to_numpy(zero_copy_only=False).tobytes())
                rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    return run


def write_vectors(table: DataFrame, key: str, vector: str, k: int) -> str:
    """Vectors by key, which no two rows share, as files sorted by it; rows without a key or vector are left out."""
    path = scratch_path(table.sparkSession, "vectors")
    rows = table.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), vector)
    rows.repartition(1).sortWithinPartitions(key).mapInArrow(_write(path, k), "rows bigint").collect()
    return path


@lru_cache(maxsize=4)
def _mapped(path: str, kind: type) -> np.ndarray:
    system, root = file_system(path)
    if not system.get_file_info(root).size:
        return np.zeros(0, dtype=kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(root, dtype=kind, mode="r")
    # From a store without paths a local copy, gone once it is mapped.
    with tempfile.NamedTemporaryFile() as local, system.open_input_stream(root) as f:
        shutil.copyfileobj(f, local)
        local.flush()
        return np.memmap(local.name, dtype=kind, mode="r")


def attach_mapped(rows: DataFrame, key: str, path: str, name: str, k: int) -> DataFrame:
    """``rows`` that have a vector by their ``key``, with it as ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vectors = _mapped(f"{path}.keys", np.int64), _mapped(f"{path}.vectors", np.float64).reshape(-1, k)
        for batch in batches:
            own = pc.fill_null(batch.column(key), 0).to_numpy(zero_copy_only=False)
            place = np.searchsorted(keys, own)
            found = np.asarray(batch.column(key).is_valid(), dtype=bool) & (place < len(keys))
            found[found] = keys[place[found]] == own[found]
            if not found.any():
                continue
            if not found.all():
                batch, place = batch.filter(pa.array(found)), place[found]
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * k
            values = pa.ListArray.from_arrays(ends, np.asarray(vectors[place]).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(name, ArrayType(DoubleType())))
