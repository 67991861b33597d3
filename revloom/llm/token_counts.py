"""Token counts of documents: each distinct pre-token is tokenised once, documents only add up.

Two passes over the texts. The first counts pre-tokens per task and sums the counts by a shuffle;
the public library then gives the number of pieces of each distinct one. The second pass has the
pre-tokens of every document with their frequencies. Most of the mass is in few pre-tokens, so the
most frequent of them (short strings, ``common`` at most) are multiplied and added where the document
is read; all others leave as (document, pre-token, frequency) and meet their number
of pieces in a shuffle join. No ids are kept anywhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revloom.llm import pretokens
from revloom.llm.common import keyed, slices
from revloom.session import pin

COMMON = 1 << 18
COMMON_CHARS = 64  # longer pre-tokens are never sent to all workers
BANDS = 8  # of frequencies in each power of two
HELD = 150_000  # distinct pre-tokens that a task holds before it hands them on


class Cutter:
    """Pre-tokens of a text as the library cuts them, its added tokens first."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def cut(self, text: str) -> list[str]:
        if any(a in text for a in self.added) or not pretokens.is_near(text):
            return self._by_library(text)
        return pretokens.split(text)

    def _by_library(self, text: str) -> list[str]:
        """Offsets of the library's own pre-tokeniser, between added tokens."""
        parts, out = [text], []
        for a in self.added:
            parts = [y for x in parts for y in (_around(x, a) if x not in self.added else [x])]
        for part in parts:
            if part in self.added:
                out.append(part)
            else:
                spans = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
                out += [part[a:b] for a, b in spans]
        return out

    def sizes(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]


def _around(text: str, mark: str) -> list[str]:
    out: list[str] = []
    for i, part in enumerate(text.split(mark)):
        out += [mark] * (i > 0) + [part] * (part != "")
    return out


@lru_cache(maxsize=2)
def cutter(path: str) -> Cutter:
    return Cutter(path)


def _batch(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


FREQUENCY = pa.schema([("piece", pa.string()), ("n", pa.int64())])


def _frequencies(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = cutter(path).cut, Counter()
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                held.update(cut(text))
            if len(held) > HELD:
                yield _batch({"piece": list(held), "n": list(held.values())}, FREQUENCY)
                held.clear()
        if held:
            yield _batch({"piece": list(held), "n": list(held.values())}, FREQUENCY)

    return run


def _sized(path: str):
    schema = pa.schema([*FREQUENCY, ("pieces", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                sizes = pa.array(cutter(path).sizes(part.column("piece").to_pylist()), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, sizes], schema=schema)

    return run


def piece_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(piece, n, pieces)``: every distinct pre-token, how often it occurs, its number of tokens."""
    found = keyed(docs, id_col, text_col).mapInArrow(_frequencies(path), "piece string, n bigint")
    return found.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(
        _sized(path), "piece string, n bigint, pieces int"
    )


def _frequent(vocabulary: DataFrame, common: int) -> Column:
    """Whether a pre-token is in the most frequent bands that have ``common`` short ones at most, all together.

    Pre-tokens are counted per band of frequency first, so nothing is sorted and equal frequencies stay together.
    """
    band = F.floor(F.log2("n") * BANDS)
    short = F.length("piece") <= COMMON_CHARS
    sizes = vocabulary.where(short).groupBy(band.alias("band")).count().collect()  # a row per band
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["band"]):
        total += r["count"]
        if total > common:
            break
        least = r["band"]
    return F.lit(False) if least is None else short & (band >= least)


PER_DOCUMENT = "doc_id bigint, text_hash bigint, n_bytes bigint, tokens bigint, piece string, n bigint"


def _per_document(path: str, common):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("tokens", pa.int64()),
         ("piece", pa.string()), ("n", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = cutter(path).cut, common.value
        for part in slices(batches):
            rows: dict[str, list] = {f.name: [] for f in schema}
            ids, hashes, sizes = (part.column(c).to_pylist() for c in ("doc_id", "text_hash", "n_bytes"))
            for doc, text_hash, size, text in zip(ids, hashes, sizes, part.column("text").to_pylist()):
                total, rest = 0, Counter()
                for piece in cut(text):
                    n = known.get(piece)
                    if n is None:
                        rest[piece] += 1
                    else:
                        total += n
                count = len(rest)
                rows["doc_id"] += [doc] * (count + 1)
                rows["text_hash"] += [text_hash] * (count + 1)
                rows["n_bytes"] += [size] + [None] * count
                rows["tokens"] += [total] + [None] * count
                rows["piece"] += [f"\0{text_hash}", *rest]  # no pre-token, and spread over the tasks of the join
                rows["n"] += [None, *rest.values()]
            yield _batch(rows, schema)

    return run


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, common: int = COMMON
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row, without begin or end tokens.

    ``path`` is a file of the ``tokenizers`` library with byte-level pre-tokens and must exist on
    every executor. Strings of added tokens inside a text count as that token, as the library does
    by default. ``over_limit`` is ``n_tokens > limit``. A null text is empty and has no tokens.
    Repeated rows are counted once and given back as often as they occur; null ids are kept; other
    columns are ignored; an empty table gives an empty one. ``common`` bounds what is sent to the
    workers: at most that many pre-tokens of up to ``COMMON_CHARS`` characters; it changes no result.
    """
    spark = docs.sparkSession
    vocabulary = pin(piece_counts(docs, path, id_col, text_col))
    frequent = _frequent(vocabulary, common)
    top = vocabulary.where(frequent).select("piece", "pieces").toArrow()
    known = dict(zip(top.column("piece").to_pylist(), top.column("pieces").to_pylist()))
    texts = keyed(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.octet_length("text").cast("bigint").alias("n_bytes"), "text"
    )
    rest = vocabulary.where(~frequent).select("piece", "pieces")
    found = texts.mapInArrow(_per_document(path, spark.sparkContext.broadcast(known)), PER_DOCUMENT)
    tokens = F.coalesce("tokens", F.col("n") * F.col("pieces"), F.lit(0))
    counted = (
        found.join(rest, "piece", "left")
        .groupBy("doc_id", "text_hash")
        .agg(F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("all"), F.count("tokens").alias("rows"))
    )
    each = (F.col("all") / F.col("rows")).cast("bigint")
    return counted.select(
        "doc_id", "n_bytes", each.alias("n_tokens"), (each > limit).alias("over_limit"),
        F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("row"),
    ).drop("row")
