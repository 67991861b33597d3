"""Interpolated modified Kneser-Ney language model over words, and the scores of texts.

Word pairs are counted in Spark: a task counts those of its texts and hands on one packed, sorted
block per bucket of contexts; the blocks of a bucket are added up by one group, so a pair costs one
entry per task however frequent it is. A bucket becomes a file of sorted hash arrays in the shared
checkpoint folder: pairs with their counts, contexts with what back-off needs. From the buckets'
words come the files of words: counts and numbers of different contexts. Scoring workers map
these files into memory and look up the sorted hashes of their own batches; nothing of the model
but file names and discounts goes through the driver.

The model has order two: ``P(w | h) = max(c(hw) - D, 0) / c(h) + g(h) P(w)``, with modified discounts
``D`` for counts of one, two and more, and ``P(w)`` likewise from continuation counts, below which
all words and the unknown one are alike.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from revloom.llm.common import WORD, is_rest, keyed, slices
from revloom.llm.minhash import Words
from revloom.session import pin, scratch_path

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
START = np.uint64(xxhash.xxh3_64_intdigest(b"", seed=1))  # context of a text's first token
END = np.uint64(xxhash.xxh3_64_intdigest(b"", seed=2))  # the token after its last word
CHUNK_TOKENS = 6_000_000  # counted together by a task
BATCH_TOKENS = 1_000_000  # scored together
WORD_BITS = np.uint64(8)  # a word is the upper 56 bits of its hash
SMOOTH = 0.1  # of the base score


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(_mix(h * GOLDEN) + w)


def tokens(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and the number of tokens of each text, texts one after the other."""
    found = [WORD.findall(t.encode().lower()) for t in texts]
    sizes = np.array([len(f) + 1 for f in found], dtype=np.int64)
    total = int(sizes.sum())
    w = np.empty(total, dtype=np.uint64)
    ends = np.cumsum(sizes)
    is_end = np.zeros(total, dtype=bool)
    is_end[ends - 1] = True
    flat = [x for f in found for x in f]
    w[~is_end] = np.fromiter(map(words.__getitem__, flat), dtype=np.uint64, count=len(flat))
    w[is_end] = END
    h = np.empty(total, dtype=np.uint64)
    h[1:] = w[:-1]
    h[ends - sizes] = START
    return h, w >> WORD_BITS, sizes


def _sum_sorted(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys (last is the main one for sorting first) with sums of ``n``."""
    order = np.lexsort(keys[::-1])
    keys, n = tuple(k[order] for k in keys), n[order]
    first = np.ones(len(n), dtype=bool)
    first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    heads = np.flatnonzero(first)
    return (*(k[heads] for k in keys), np.add.reduceat(n, heads)) if len(heads) else (*keys, n)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, words without their empty upper byte."""
    parts = [struct.pack("<q", len(arrays[0]))]
    for a in arrays:
        parts.append(a.tobytes())
    return b"".join(parts)


def _narrow(w: np.ndarray) -> np.ndarray:
    return w.view(np.uint8).reshape(-1, 8)[:, :7].copy()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), dtype=np.uint8)
    out[:, :7] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 7)
    return out.reshape(-1).view(np.uint64)


def _unpack(data: bytes, words_first: bool) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<q", data)
    at = 8
    if words_first:  # words, sums, contexts
        w = _wide(data[at : at + 7 * n])
        at += 7 * n
        return [w, np.frombuffer(data, np.int64, n, at), np.frombuffer(data, np.int64, n, at + 8 * n)]
    h = np.frombuffer(data, np.uint64, n, at)
    return [h, _wide(data[at + 8 * n : at + 15 * n]), np.frombuffer(data, np.uint32, n, at + 15 * n).astype(np.int64)]


BLOCKS = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def _by_bucket(key: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted keys by their upper bits."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    for b in range(1 << bits):
        if edges[b] < edges[b + 1]:
            yield b, slice(int(edges[b]), int(edges[b + 1]))


def _count(bits: int):
    def blocks(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, w = (np.concatenate(x) for x in zip(*held))
        h, w, n = _sum_sorted((h, w), np.ones(len(h), dtype=np.int64))
        for b, part in _by_bucket(h, bits):
            data = _pack(h[part], _narrow(w[part]), n[part].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([data], pa.binary())], schema=BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), [], 0
        for part in slices(batches):
            h, w, _ = tokens(part.column("text").to_pylist(), words)
            held.append((h, w))
            size += len(h)
            if size > CHUNK_TOKENS:
                yield from blocks(held)
                held, size = [], 0
        if held:
            yield from blocks(held)

    return run


# Files of the shared folder: written under another name first, so a lost task leaves no half file.


def _store(folder: str, name: str, arrays: list[np.ndarray]) -> str:
    data = b"".join([struct.pack("<q", len(arrays[0])), *(a.tobytes() for a in arrays)])
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        path = os.path.join(url.path, f"{name}-{uuid.uuid4().hex}")
        os.makedirs(url.path, exist_ok=True)
        with open(f"{path}.part", "wb") as f:
            f.write(data)
        os.replace(f"{path}.part", path)
        return path
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    system.create_dir(root)
    with system.open_output_stream(path) as f:
        f.write(data)
    return f"{folder.rstrip('/')}/{os.path.basename(path)}"


@lru_cache(maxsize=4096)
def _mapped(path: str, types: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory; from a store without paths a local copy, gone once it is mapped."""
    if urlparse(path).scheme:
        import shutil
        import tempfile

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        with tempfile.NamedTemporaryFile() as local, system.open_input_stream(root) as f:
            shutil.copyfileobj(f, local)
            local.flush()
            whole = np.memmap(local.name, dtype=np.uint8, mode="r")
    else:
        whole = np.memmap(path, dtype=np.uint8, mode="r")
    (n,) = struct.unpack("<q", whole[:8].tobytes())
    out, at = [], 8
    for t in types:
        size = np.dtype(t).itemsize * n
        out.append(whole[at : at + size].view(t))
        at += size
    return out


PAIR_TYPES, CONTEXT_TYPES, WORD_TYPES = ("u8", "u4"), ("u8", "i8", "u4", "u4", "u4"), ("u8", "i8", "u4")
META = "kind string, bucket int, path string, stats array<bigint>, data binary"
META_SCHEMA = pa.schema(
    [("kind", pa.string()), ("bucket", pa.int32()), ("path", pa.string()), ("stats", pa.list_(pa.int64())), ("data", pa.binary())]
)


def _kinds(n: np.ndarray) -> list[int]:
    """How many are one, two, three, four, and three or more."""
    return [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n >= 3).sum())]


def _pairs(folder: str, bits: int):
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        h, w, n = (np.concatenate(x) for x in zip(*(_unpack(d.as_py(), False) for d in group.column("data"))))
        h, w, n = _sum_sorted((h, w), n)
        key = _pair_keys(h, w)
        order = np.argsort(key)
        rows = [("pairs", bucket, _store(folder, f"pairs-{bucket}", [key[order], n[order].astype(np.uint32)]), _kinds(n), None)]
        first = np.ones(len(h), dtype=bool)
        first[1:] = h[1:] != h[:-1]
        heads = np.flatnonzero(first)
        more = [np.add.reduceat((n == k).astype(np.uint32), heads) for k in (1, 2)] + [np.add.reduceat((n >= 3).astype(np.uint32), heads)]
        arrays = [h[heads], np.add.reduceat(n, heads), *(m.astype(np.uint32) for m in more)]
        rows.append(("contexts", bucket, _store(folder, f"contexts-{bucket}", arrays), [], None))
        w, total, different = _words_of(w, n, np.ones(len(n), dtype=np.int64))
        for b, part in _by_bucket(w << WORD_BITS, bits):
            rows.append(("partial", b, None, [], _pack(_narrow(w[part]), total[part], different[part])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), META_SCHEMA)], schema=META_SCHEMA)

    return run


def _words_of(w: np.ndarray, n: np.ndarray, different: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(w, kind="stable")
    w, n, different = w[order], n[order], different[order]
    first = np.ones(len(w), dtype=bool)
    first[1:] = w[1:] != w[:-1]
    heads = np.flatnonzero(first)
    return w[heads], np.add.reduceat(n, heads), np.add.reduceat(different, heads)


def _words(folder: str):
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        w, n, d = _words_of(*(np.concatenate(x) for x in zip(*(_unpack(x.as_py(), True) for x in group.column("data")))))
        path = _store(folder, f"words-{bucket}", [w, n, d.astype(np.uint32)])
        row = [["words"], [bucket], [path], [[len(w), int(n.sum()), int(d.sum()), *_kinds(d)]], [None]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(row, META_SCHEMA)], schema=META_SCHEMA)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; fixed ones where a count of counts is zero."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))  # type: ignore[return-value]


@dataclass
class Model:
    """File names by kind and bucket, discounts and totals; the counts are in the files."""

    bits: int
    paths: dict[tuple[str, int], str]
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    distinct: int  # V
    total: int  # N
    pairs: int  # different pairs
    unknown: float  # probability of a word without continuation counts

    def _find(self, kind: str, types: tuple[str, ...], key: np.ndarray, bucket_of: np.ndarray, of: list[int]) -> list[np.ndarray]:
        """Values ``of`` each key (0 where there is none); buckets are the upper bits of ``bucket_of``."""
        out = [np.zeros(len(key), dtype=np.float64) for _ in of]
        order = np.lexsort((key, bucket_of >> np.uint64(64 - self.bits)))
        for b, part in _by_bucket(bucket_of[order], self.bits):
            path = self.paths.get((kind, b))
            if path is None:
                continue
            arrays = _mapped(path, types)
            rows = order[part]
            at = np.minimum(np.searchsorted(arrays[0], key[rows]), len(arrays[0]) - 1)
            hit = arrays[0][at] == key[rows]
            for o, column in zip(out, of):
                o[rows[hit]] = arrays[column][at[hit]]
        return out

    def logs(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the model's probability, of the base probability, and the count, of each token."""
        word, word_of = np.unique(w, return_inverse=True)
        count, different = self._find("words", WORD_TYPES, word, word << WORD_BITS, [1, 2])
        d1, d2, d3 = self.word_discounts
        cut = np.select([different >= 3, different == 2, different == 1], [d3, d2, d1], 0.0)
        low = ((different - cut) / max(self.pairs, 1) + self.unknown)[word_of]
        base = np.log10((count + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))[word_of]
        context, context_of = np.unique(h, return_inverse=True)
        total, n1, n2, n3 = self._find("contexts", CONTEXT_TYPES, context, context, [1, 2, 3, 4])
        d1, d2, d3 = self.pair_discounts
        seen = total > 0
        weight = np.where(seen, (d1 * n1 + d2 * n2 + d3 * n3) / np.where(seen, total, 1), 1.0)[context_of]
        total = np.where(seen, total, 1)[context_of]
        pair, first, pair_of = np.unique(_pair_keys(h, w), return_index=True, return_inverse=True)
        (n,) = self._find("pairs", PAIR_TYPES, pair, h[first], [1])
        n = n[pair_of]
        cut = np.select([n >= 3, n == 2, n == 1], [d3, d2, d1], 0.0)
        return np.log10((n - cut) / total + weight * low), base, count[word_of]


def train(docs: DataFrame, where, text_col: str = "text", id_col: str = "doc_id", buckets: int | None = None) -> Model:
    """Count the texts of the rows of ``where``. ``buckets`` (a power of two) should grow with the corpus."""
    spark = docs.sparkSession
    wanted = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = max(1, math.ceil(math.log2(wanted)))
    folder = scratch_path(spark, "words")
    rows = keyed(docs.where(where), id_col, text_col).select("text")
    blocks = rows.mapInArrow(_count(bits), "bucket int, data binary")
    pairs = pin(blocks.groupBy("bucket").applyInArrow(_pairs(folder, bits), META))
    partial = pairs.where("kind = 'partial'").select("bucket", "data")
    words = pin(partial.groupBy("bucket").applyInArrow(_words(folder), META))
    files = pairs.where("kind <> 'partial'").unionByName(words).select("kind", "bucket", "path", "stats").collect()
    paths = {(r["kind"], r["bucket"]): r["path"] for r in files}
    pair_kinds = np.sum([r["stats"] for r in files if r["kind"] == "pairs"] or [[0] * 5], axis=0).tolist()
    distinct, total, different, *kinds = np.sum([r["stats"] for r in files if r["kind"] == "words"] or [[0] * 8], axis=0).tolist()
    d = discounts(*kinds[:4])
    freed = d[0] * kinds[0] + d[1] * kinds[1] + d[2] * kinds[4]
    unknown = (freed / different if different else 1.0) / (distinct + 1)
    return Model(bits, paths, discounts(*pair_kinds[:4]), d, distinct, total, different, unknown)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(model: Model):
    def scored(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        h, w, sizes = tokens(part.column("text").to_pylist(), words)
        starts = np.cumsum(sizes) - sizes
        out = np.zeros((3, len(h)))
        for a in range(0, len(h), BATCH_TOKENS):
            b = a + BATCH_TOKENS
            out[:, a:b] = model.logs(h[a:b], w[a:b])
        score, base, known = (np.add.reduceat(x, starts) for x in (out[0], out[1], (out[2] > 0).astype(np.float64)))
        arrays = [
            part.column("doc_id"), part.column("held_out"), pa.array(sizes), pa.array(known.astype(np.int64)),
            pa.array(np.full(len(sizes), model.total, dtype=np.int64)), pa.array(base), pa.array(score),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in slices(batches):
            yield scored(part, words)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, buckets: int | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    The model learns from rows whose crc32 of the id modulo ``folds`` is not 0 (a null id is one).
    Every text has an end token, so a null or empty one has one token. ``base_score`` is the text's
    log10 probability by smoothed word counts, ``score`` by the model; both are finite for any
    text, also without anything to learn from. Rows are treated one by one, other columns are
    ignored, an empty table gives an empty one.
    """
    held_out = is_rest(id_col, folds, 0)
    model = train(docs, ~held_out, text_col, id_col, buckets)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_score(model), SCORES)
