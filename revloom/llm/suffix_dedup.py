"""Repeated passages of a corpus by a run-compressed Burrows-Wheeler index of bounded context.

A passage counts as repeated where ``length`` bytes occur earlier, so the index needs no context
longer than that. It is built in two steps, neither of which holds the corpus in one place.

*Contexts.* Every ``length``-byte window is owned by its minimiser, the 32-byte string in it with
the smallest hash, so equal windows have equal owners. An occurrence of an owner with the bytes of
all windows it owns is one symbol; sorted by owner and context, the symbols of repetitive corpora
come in long runs of equal ones. A run keeps only its end, the earliest occurrence: all others
are repeats of it. Each task first compresses the runs of the texts it reads, so what is sorted is
one row per run and task, however often one passage occurs.

*Bytes.* Windows of unequal symbols with the same owner may still be equal (at the ends of copied
passages). Their bytes, one copy for each run, meet in small byte-level indexes: a suffix order of
bounded context, its transform as runs with the text positions sampled at the run ends, and
matching statistics streamed along the texts, which mark the windows that occur earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from revloom.llm.common import carried, slices, text_of, with_row
from revloom.session import pin

OWNER = 32
CHUNK = 32_000_000  # bytes whose runs a task compresses at once
INDEX = 400_000  # bytes of one byte-level index, but for a larger group
NO_ID = -(2**63)
PLACE = 1 << 16  # an occurrence: first window * PLACE + distance to the owner * 256 + windows
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64((1 << 24) - 1)  # places within a piece of text; hashes are compared above them
PIECE = 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _owner_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place on."""
    v = data.astype(np.uint64)
    for k in (1, 2, 4):
        v = v[:-k] | (v[k:] << np.uint64(8 * k))
    h = _mix(v[:-8]) * GOLDEN + v[8:]
    return _mix(_mix(h[:-16]) * GOLDEN + h[16:])


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def owned_windows(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner hash, its place, its first window and number of windows, for each run of windows."""
    parts = []
    for start in range(0, max(1, len(data) - length + 1), PIECE):
        piece = np.frombuffer(data, dtype=np.uint8)[start : start + PIECE + length - 1]
        if len(piece) < length:
            break
        h = _owner_hashes(piece)
        tagged = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        at = (_window_minima(tagged, length - OWNER + 1) & LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, len(at)))
        parts.append((h[at[first]], at[first] + start, first + start, count))
    if not parts:
        return tuple(np.empty(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64))  # type: ignore[return-value]
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


ROWS = pa.schema([("owner", pa.int64()), ("symbol", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int64())])
ROWS_SQL = "owner bigint, symbol bigint, doc bigint, text_hash bigint, at bigint"


def _arrow(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _is_first(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _compress(rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """One row per run of this chunk, and the windows that repeat another of it as intervals."""
    owner, symbol, doc, text_hash, at = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((at, text_hash, doc, symbol, owner))
    owner, symbol, doc, text_hash, at = (x[order] for x in (owner, symbol, doc, text_hash, at))
    first = _is_first(owner, symbol)
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = (doc != doc[head]) | (text_hash != text_hash[head]) | (at != at[head])
    yield _arrow(ROWS, *(x[first] for x in (owner, symbol, doc, text_hash, at)))
    doc, text_hash, at = doc[again], text_hash[again], at[again]
    if not len(doc):
        return
    order = np.lexsort((at, text_hash, doc))
    doc, text_hash, at = doc[order], text_hash[order], at[order]
    start, end = at // PLACE, at // PLACE + at % 256
    new = _is_first(doc, text_hash)
    new[1:] |= start[1:] > end[:-1]
    heads = np.flatnonzero(new)
    last = np.maximum.reduceat(end, heads)
    size = last - start[heads]
    yield _arrow(ROWS, text_hash[heads] ^ doc[heads], size, doc[heads], text_hash[heads], start[heads] * PLACE)


def _occurrences(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for part in slices(batches):
            keys = zip(part.column("doc").to_pylist(), part.column("text_hash").to_pylist(), part.column("text").to_pylist())
            for doc, text_hash, text in keys:
                data = text.encode()
                owner, place, first, count = owned_windows(data, length)
                if not len(owner):
                    continue
                ends = (first + count + length - 1).tolist()
                gap = place - first
                symbol = [xxhash.xxh3_64_intdigest(data[s:e], g) for s, e, g in zip(first.tolist(), ends, gap.tolist())]
                n = len(owner)
                at = first * PLACE + gap * 256 + count
                rows.append((owner.view(np.int64), np.array(symbol, dtype=np.uint64).view(np.int64), np.full(n, doc), np.full(n, text_hash), at))
                held += len(data)
                if held > CHUNK:
                    yield from _compress(rows, length)
                    rows, held = [], 0
        if rows:
            yield from _compress(rows, length)

    return run


MARKS = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
MARKS_SQL = "doc bigint, text_hash bigint, at bigint, n bigint"


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Join batches sorted by ``key`` to tables that end where a key ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1])
        end = int(cut[-1]) + 1 if len(cut) else 0
        if not end and held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if end:
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held = []
        held.append(batch.slice(end))
    if held:
        yield pa.Table.from_batches(held)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by owner, symbol and place: marks of repeats (``n`` windows) and questions (``n`` = 0)."""
    for table in _whole_groups(batches, "owner"):
        owner, symbol, doc, text_hash, at = (table.column(f.name).to_numpy() for f in ROWS)
        known = at % 256 == 0  # intervals that a task marked already; the symbol is their size
        if known.any():
            yield _arrow(MARKS, doc[known], text_hash[known], at[known], symbol[known])
            owner, symbol, doc, text_hash, at = (x[~known] for x in (owner, symbol, doc, text_hash, at))
        if not len(owner):
            continue
        first = _is_first(owner, symbol)
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        again = (doc != doc[head]) | (text_hash != text_hash[head]) | (at != at[head])
        if again.any():
            yield _arrow(MARKS, doc[again], text_hash[again], at[again] // PLACE * PLACE, at[again] % 256)
        # Owners with several runs: their bytes decide.
        group = np.cumsum(_is_first(owner)) - 1
        ask = first & (np.bincount(group, weights=first)[group] > 1)
        if ask.any():
            yield _arrow(MARKS, doc[ask], text_hash[ask], at[ask], np.zeros(int(ask.sum()), dtype=np.int64))


BYTES = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])
BYTES_SQL = "key bigint, doc bigint, text_hash bigint, at bigint, data binary"


def _asked_bytes(length: int):
    """Bytes of the asked windows, in two groups by what they surely share beside the owner.

    Windows that begin near the owner hold ``half`` bytes behind it, the others ``half`` bytes
    before it; these bytes are part of the key, so an owner that is common by itself is no hot key.
    """
    half = (length - OWNER) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc, text_hash, text, asked in zip(*(part.column(c).to_pylist() for c in ("doc", "text_hash", "text", "asked"))):
                data = text.encode()
                for at in asked:
                    first, gap, n = at // PLACE, at // 256 % 256, at % 256
                    owner = first + gap
                    near = max(first, owner - half)  # windows from here on begin near the owner
                    last = first + n
                    for a, b, lo, hi in ((first, min(near, last), owner - half - 1, owner + OWNER), (near, last, owner, owner + OWNER + half)):
                        if a < b:
                            key = xxhash.xxh3_64_intdigest(data[max(lo, 0) : hi], int(owner - a > half))
                            rows[0].append(key - (1 << 64) if key >> 63 else key)
                            rows[1].append(doc)
                            rows[2].append(text_hash)
                            rows[3].append(a * PLACE + b - a)
                            rows[4].append(data[a : b + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, BYTES)], schema=BYTES)

    return run


class RunLengthIndex:
    """Burrows-Wheeler transform of bounded context of some texts, as runs with sampled ends.

    The suffix order compares ``length`` bytes and then the place, so equal contexts are
    neighbours with the earliest place first. The transform (the byte before each place) is kept
    as runs, cut where a context ends, with the text places at both run ends; the places between
    follow from the samples and the order, and are never kept.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1].astype(np.int64)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(data)
        rank, k = data.astype(np.int64), 1
        while 2 * k <= length:
            rank = self._ranked(rank, rank, k)
            k *= 2
        if k < length:
            rank = self._ranked(rank, rank, length - k)
        # Windows that leave their text are none: the last length - 1 places of each.
        ends = np.append(self.starts[1:], n)
        inside = np.repeat(ends, ends - self.starts) - np.arange(n) >= length
        place = np.flatnonzero(inside)
        self.order = place[np.argsort(rank[place], kind="stable")]
        context = rank[self.order]
        before = np.where(self.order > 0, data[self.order - 1], 0)
        cut = _is_first(context, before)
        self.run_first = np.flatnonzero(cut)
        self.run_last = np.append(self.run_first[1:], len(self.order)) - 1
        self.symbol = before[self.run_first]
        self.sample_first, self.sample_last = self.order[self.run_first], self.order[self.run_last]
        self.context_first = _is_first(context)[self.run_first]

    @staticmethod
    def _ranked(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        """Ranks of (a, b ``shift`` places on); beyond the end there is nothing, which is smallest."""
        later = np.zeros_like(b)
        later[: len(b) - shift] = b[shift:] + 1
        return np.unique(a * (later.max() + 1) + later, return_inverse=True)[1].astype(np.int64)

    def earlier(self) -> np.ndarray:
        """Places whose matching statistic with an earlier place reaches ``length``, in order.

        Within a context all runs but the one with the earliest place consist of such places; that
        run's first sample is the only place of the context that is not one.
        """
        group = np.cumsum(self.context_first) - 1
        earliest = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(earliest, group, self.sample_first)
        of_place = np.repeat(group, self.run_last - self.run_first + 1)
        return np.sort(self.order[self.order != earliest[of_place]])


def _matches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(_whole_groups(batches, "key"), INDEX):
            # Rows that repeat an id and a text have asked the same; one of them is enough.
            table = table.filter(pa.array(_is_first(*(table.column(c).to_numpy() for c in ("key", "doc", "text_hash", "at")))))
            texts = table.column("data").to_pylist()
            index = RunLengthIndex(texts, length)
            hit = index.earlier()
            if not len(hit):
                continue
            owner = np.searchsorted(index.starts, hit, side="right") - 1
            new = _is_first(owner)
            new[1:] |= hit[1:] != hit[:-1] + 1
            heads = np.flatnonzero(new)
            size = np.diff(np.append(heads, len(hit)))
            owner, offset = owner[heads], hit[heads] - index.starts[owner[heads]]
            doc, text_hash, at = (table.column(c).to_numpy()[owner] for c in ("doc", "text_hash", "at"))
            yield _arrow(MARKS, doc, text_hash, (at // PLACE + offset) * PLACE, size)

    return run


def _gathered(tables: Iterator[pa.Table], size: int) -> Iterator[pa.Table]:
    """Tables of whole groups, cut or joined to about ``size`` bytes of data where keys allow."""
    for table in tables:
        key = table.column("key").to_numpy()
        lengths = np.cumsum([len(x.as_buffer()) for x in table.column("data")])
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        start, done = 0, 0
        for k, end in enumerate(ends):
            if lengths[end - 1] - done >= size or k == len(ends) - 1:
                yield table.slice(start, end - start)
                start, done = end, lengths[end - 1]


def _clean(length: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")}
            for text, marks in zip(part.column("text").to_pylist(), part.column("marks").to_pylist()):
                data = text.encode()
                spans: list[list[int]] = []
                for at, n in sorted((m["at"] // PLACE, m["n"]) for m in marks or ()):
                    if spans and at <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], at + n + length - 1)
                    else:
                        spans.append([at, at + n + length - 1])
                edges = [0, *(x for s in spans for x in s), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(rest))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                # A cut may fall into a character; what is left of it is dropped from the text.
                out["kept_text"].append(rest.decode("utf-8", "ignore"))
            types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            columns = [pa.array(v, t) for v, t in zip(out.values(), types)]
            names = list(out)
            if not keep:
                columns, names = columns[:4], names[:4]
            if "row" in part.schema.names:
                columns, names = [*columns, part.column("row")], [*names, "row"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier.

    Earlier means a smaller id, or the same document and a smaller place; strings may overlap, never
    cross documents, and are judged on the input. ``(doc_id, n_bytes, n_removed, n_spans,
    kept_sha256)`` for every row and, with ``keep``, the removed ``spans`` (byte places) and
    ``kept_text``, in which characters that were cut are dropped whole. ``carry`` names columns that
    come along as a struct ``row``.

    Null texts are empty. A null id comes before all others. Rows of one id are in the order of a
    hash of their text; rows that also have the same text are one document, whose result each of
    them gets. Other columns are ignored; an empty table gives an empty one. ``length`` is from
    ``OWNER`` + 2 to 250.
    """
    if not OWNER + 2 <= length <= 250:
        raise ValueError(f"length must be from {OWNER + 2} to 250")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"), *carried(docs, carry))
    texts = rows.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("text_hash", F.xxhash64("text"))
    rows = texts.select("doc", "text_hash", "text").mapInArrow(_occurrences(length), ROWS_SQL)
    order = ["owner", "symbol", "doc", "text_hash", "at"]
    found = pin(rows.repartition("owner").sortWithinPartitions(*order).mapInArrow(_runs, MARKS_SQL))
    asked = found.where("n = 0").groupBy("doc", "text_hash").agg(F.collect_list("at").alias("asked"))
    pieces = texts.join(asked, ["doc", "text_hash"]).select("doc", "text_hash", "text", "asked").mapInArrow(_asked_bytes(length), BYTES_SQL)
    more = pieces.repartition("key").sortWithinPartitions("key", "doc", "text_hash", "at").mapInArrow(_matches(length), MARKS_SQL)
    marks = found.where("n > 0").unionByName(more).groupBy("doc", "text_hash").agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    joined = texts.join(marks, ["doc", "text_hash"], "left").select("doc_id", "text", "marks", *(["row"] if carry else []))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    schema += ", spans array<struct<start:bigint,end:bigint>>, kept_text string" if keep else ""
    return joined.mapInArrow(_clean(length, keep), with_row(joined, schema))
