"""Byte-level BPE: texts to ids and back, by merging rows of padded matrices.

Pre-tokens that are new to a task are encoded together: those of like length form one matrix, a
row each, and in every round each row merges its leftmost pair of minimum rank. Pair ranks come
from an open-addressing hash table in numpy; rows without a pair left are taken out, so rounds get
smaller. Results are kept per pre-token in a table of bounded size, and texts are put together
from it. Pre-tokens longer than ``LONGEST_ROW`` bytes take a heap instead, which applies the same
rule in O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revloom.llm import pretokens
from revloom.llm.common import keyed, slices

NONE = np.int32(2**31 - 1)
WIDTHS = (8, 16, 32, 64, 128, 256)
LONGEST_ROW = WIDTHS[-1]
CELLS = 1_000_000  # of one matrix
KNOWN = 200_000  # pre-tokens that a task keeps
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks of a public vocabulary file, as lists and as a hash table of mergeable pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.texts = [str(i) for i in range(len(self.tokens))]
        self._hash_pairs()

    def _hash_pairs(self) -> None:
        ranks = self.ranks
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = dict(zip(zip(left, right), merged))
        bits = max(4, (2 * len(left)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        key = (np.array(left, dtype=np.int64) << 32) | np.array(right, dtype=np.int64)
        value, slot = np.array(merged, dtype=np.int32), self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            first = np.zeros(len(key), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            key, value, slot = key[~put], value[~put], (slot[~put] + ~(free & ~first)[~put]) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * MULTIPLIER) >> self.shift).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges to, else ``NONE``; ids below 0 merge with nothing."""
        key = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(key.shape, NONE, dtype=np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        slot = self._slot(key[todo])
        while len(todo):
            held = self.keys[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (held != -1)
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of every pre-token."""
        out: list[list[int]] = [[]] * len(pieces)
        rows: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > LONGEST_ROW:
                out[i] = self.merge_long(piece)
            elif piece:
                rows.setdefault(next(w for w in WIDTHS if w >= len(piece)), []).append(i)
        for width, found in rows.items():
            step = max(1, CELLS // width)
            for k in range(0, len(found), step):
                self._merge_rows(pieces, found[k : k + step], width, out)
        return out

    def _merge_rows(self, pieces: list[bytes], found: list[int], width: int, out: list[list[int]]) -> None:
        sizes = np.array([len(pieces[i]) for i in found])
        cols = np.arange(width)
        ids = np.full((len(found), width + 1), -1, dtype=np.int32)
        data = np.frombuffer(b"".join(pieces[i] for i in found), dtype=np.uint8)
        ids[:, :width][cols < sizes[:, None]] = self.byte_ids[data]
        row = np.array(found)
        ranks = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(found), width)
        while len(row):
            at = ranks.argmin(axis=1)
            here = np.arange(len(row))
            best = ranks[here, at]
            live = best != NONE
            if not live.all():
                for k in np.flatnonzero(~live):
                    out[row[k]] = ids[k, : sizes[k]].tolist()
                ids, ranks, row, sizes, at, best = (x[live] for x in (ids, ranks, row, sizes, at, best))
                here = np.arange(len(row))
                if not len(row):
                    return
            ids[here, at] = best
            # Take column at + 1 out of the ids and column at out of the ranks.
            moved = cols[None, :] > at[:, None]
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(moved[:, :-1] | (cols[:-1] == at[:, None]), ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            sizes -= 1
            ranks[here, at] = self.lookup(ids[here, at], ids[here, at + 1])
            before = here[at > 0]
            j = at[at > 0]
            ranks[before, j - 1] = self.lookup(ids[before, j - 1], ids[before, j])

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one long pre-token: the leftmost pair of minimum rank merges first, by a heap."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := self.pairs.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, once per worker."""
    return Vocabulary(path)


class Codec:
    """Texts to ids with a bounded table of known pre-tokens."""

    def __init__(self, vocab: Vocabulary, pattern: str = pretokens.PATTERN):
        self.vocab, self.pattern = vocab, pattern
        self.ids: dict[str, str] = {}
        self.bytes: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.ids]
        if len(self.ids) + len(new) > KNOWN:
            self.ids.clear()
            self.bytes.clear()
            new = list(pieces)
        texts, decode = self.vocab.texts, self.vocab.decode
        for piece, ids in zip(new, self.vocab.encode_pieces([p.encode() for p in new])):
            self.ids[piece] = " ".join([texts[i] for i in ids])
            self.bytes[piece] = decode(ids)

    def run(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Per text its decimal ids with one space between them and the bytes they decode to."""
        cut = [pretokens.split(t, self.pattern) for t in texts]
        self.learn(set().union(*cut))
        ids, back = self.ids, self.bytes
        for pieces in cut:
            yield " ".join([ids[p] for p in pieces]), b"".join([back[p] for p in pieces])


def _coded(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary(path), pattern)
        for part in slices(batches):
            rows = list(codec.run(part.column("text").to_pylist()))
            columns = {
                "n_tokens": pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in rows], pa.int64()),
                "ids_sha256": [hashlib.sha256(ids.encode()).hexdigest() for ids, _ in rows],
                "decoded_sha256": [hashlib.sha256(data).hexdigest() for _, data in rows],
            }
            if keep_ids:
                columns["ids"] = pa.array([[int(i) for i in ids.split()] for ids, _ in rows], pa.list_(pa.int32()))
                columns["decoded"] = pa.array([data.decode("utf-8", "replace") for _, data in rows], pa.string())
            arrays = [part.column("doc_id"), *columns.values()]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], ["doc_id", *columns])

    return run


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    pattern: str = pretokens.PATTERN, keep_ids: bool = True,
) -> DataFrame:
    """Encode every text with the ranks in ``path`` and decode the ids again, in one pass, no shuffle.

    Gives ``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` and, with ``keep_ids``, ``ids`` and
    ``decoded``. The round trip is exact for every text. A null text is empty: no ids, hashes of
    nothing. Rows are treated one by one, so repeated rows and null ids stay; other columns are
    ignored; an empty table gives an empty one. ``path`` must exist on every executor, as an
    installed package does.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if keep_ids else ""
    return keyed(docs, id_col, text_col).mapInArrow(_coded(path, pattern, keep_ids), schema)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            text = [vocab.decode(x or []).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from lists of ids; null lists are empty, bytes that are no UTF-8 become U+FFFD."""
    rows = encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoded(path), "doc_id bigint, text string")
