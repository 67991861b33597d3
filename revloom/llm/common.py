"""What the operators of this folder share: column helpers, held-out splits, words, scratch tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

# Words of the word-based operators: runs of bytes that are none of space, tab, \n, \v, \f, \r.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Rows of one Arrow batch that are worked on together; bounds what a task holds beside the batch.
SLICE_ROWS = 500
SLICE_BYTES = 4_000_000


def text_of(col: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def remainder(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m


def is_rest(id_col: str, m: int, r: int) -> Column:
    """True where ``remainder`` is ``r``; a null id counts as not ``r``."""
    return F.coalesce(remainder(id_col, m) == r, F.lit(False))


def lower_az(data: bytes) -> bytes:
    """Lower-case A-Z only (``bytes.lower`` touches nothing else)."""
    return data.lower()


def words_of(data: bytes) -> list[bytes]:
    return WORD.findall(data.lower())


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to at most ``SLICE_ROWS`` rows and, but for single rows, ``SLICE_BYTES`` of text."""
    for batch in batches:
        sizes = [len(v) if v is not None else 0 for v in _buffers(batch.column(batch.schema.get_field_index(text)))]
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > SLICE_BYTES or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


class _Sized:
    __slots__ = ("n",)

    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n


def _buffers(column: pa.Array) -> list[_Sized | None]:
    import pyarrow.compute as pc

    return [None if n is None else _Sized(n) for n in pc.binary_length(column).to_pylist()]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of a table of documents, whatever other columns it has."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))


def carried(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The caller's columns as one struct ``row``, so that no name of theirs meets one of ours."""
    return [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")] if columns else []


def with_row(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``ddl`` and, if ``df`` carries one, its ``row``."""
    schema = StructType.fromDDL(ddl)
    return schema.add(df.schema["row"]) if "row" in df.columns else schema
