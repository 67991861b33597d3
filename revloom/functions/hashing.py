"""Hash of a row key, the same in Spark and in other SQL engines; hashes of numbers in NumPy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F


def bucket(keys: Sequence[str], seed: int = 12345, buckets: int = 100) -> Column:
    """A number in ``[0, buckets)`` that depends on the key and the seed only."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    head = F.substring(F.md5(text.cast("binary")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), F.lit(buckets)).cast("bigint")


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the finaliser of splitmix64; its constants are fixed values)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
