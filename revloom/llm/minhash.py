"""Near-duplicate documents by circulant MinHash, confirmed on the full shingle sets.

Two permutations give all coordinates of a signature: the first scatters the shingles over
``UNIVERSE`` places, the second is read once per place and coordinate, shifted by the coordinate's
number around a circle. Coordinates are cut into bands; documents that share a band are candidates.

Equal sets form one class before anything is paired. Within a bucket candidates are not paired with
each other: first all meet the smallest one, the links that hold are contracted to components, and
only members of still different components meet again (another pivot, then each other, in blocks
where a bucket has many). So a group of many near copies costs a few pairs for each member that
joins it early, and no link between components is left untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from revloom.llm.common import WORD, keyed, slices
from revloom.llm.graph import components
from revloom.session import pin

UNIVERSE_BITS = 20
ROWS, BANDS = 8, 28  # a pair of similarity 0.85 misses all bands with a chance of 1.4e-4
PLACES_AT_ONCE = 4096
SEED = 20
WORDS_HELD = 400_000
FEW, BLOCK = 16, 256  # members of a bucket that are paired as rows; members of a block in larger ones


class Words(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes, size: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; all words as one if there are fewer."""
    found = WORD.findall(data.lower())
    n = len(found)
    if not n:
        return np.empty(0, dtype=np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\x20".join(found), seed=n)], dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=n)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        total = _mix(total + h[k : n - size + 1 + k])
    return np.unique(total)


class Signer:
    """Circulant MinHash with bands."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        universe = 1 << UNIVERSE_BITS
        second = rng.permutation(universe).astype(np.uint32)
        self.rows, self.bands, k = rows, bands, rows * bands
        # Row p: the second permutation at p, p + 1, ... around the circle, one for each coordinate.
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: k - 1]]), k)
        self.first = np.uint64(rng.integers(1, 2**63)) * np.uint64(2) + np.uint64(1)
        self.weights = rng.integers(1, 2**63, size=rows).astype(np.uint64) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (_mix(shingles * self.first) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
        out = None
        for k in range(0, len(places), PLACES_AT_ONCE):
            low = self.shifted[places[k : k + PLACES_AT_ONCE]].min(axis=0)
            out = low if out is None else np.minimum(out, low)
        return out

    def buckets(self, shingles: np.ndarray) -> np.ndarray:
        """One number per band, different bands apart."""
        parts = self.signature(shingles).astype(np.uint64).reshape(self.bands, self.rows)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            h = _mix(h * self.weights[k] + parts[:, k])
        return h.view(np.int64)


FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("h", pa.int64()), ("buckets", pa.list_(pa.int64()))]
)


def _features(size: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, words = Signer(rows, bands), Words()
        for part in slices(batches):
            sets = [shingle_set(t.encode(), size, words) for t in part.column("text").to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            arrays = [
                part.column("doc_id"),
                part.column("text_hash"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([_key(d) if d else None for d in digests], pa.int64()),
                pa.array([signer.buckets(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=FEATURES)

    return run


def _sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in slices(batches):
            sets = [shingle_set(t.encode(), size, words) for t in part.column("text").to_pylist()]
            keys = [_key(xxhash.xxh3_128_digest(s.tobytes())) if len(s) else None for s in sets]
            arrays = [part.column("doc_id"), pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _confirmed(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                u, v = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                if 100 * min(len(u), len(v)) < threshold * max(len(u), len(v)):
                    good.append(False)
                    continue
                both = np.concatenate([u, v])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= threshold * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


NODE = "struct<id:bigint,h:bigint>"


def _links(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes whose sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    # The many ends first, so that a common pivot's set is added last and its rows can be split.
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return pin(both.mapInArrow(_confirmed(threshold), f"a {NODE}, b {NODE}"))


def _relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the roots that the links give; links are between roots so far."""
    roots = components(links)
    return members.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select(
        "bucket", "node", F.coalesce("root", "comp").alias("comp")
    )


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with the bucket's next pivot."""
    order = F.struct(F.xxhash64("node").alias("o"), F.col("node").alias("node"), F.col("comp").alias("comp"))
    pivots = members.groupBy("bucket").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(order).alias("pivot"), F.count(F.lit(1)).alias("m")
    )
    return members.join(pivots.where("low <> high").select("bucket", "pivot", "m"), "bucket")


def _in_blocks(left: DataFrame, sets: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Links ``(a, b)`` between components in buckets of many members, which are compared in blocks.

    A bucket's members are dealt to blocks of about ``BLOCK`` by a hash, and a group holds two
    blocks, so no group grows with the bucket and no pairs are written but links.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = left.select("bucket", "node", "comp", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("k"))
    dealt = dealt.select("bucket", "node", "comp", "k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = dealt.join(sets, "node").join(classes.select("node", "buckets"), "node")
    rows = rows.select(
        "bucket", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "k", "comp",
        F.xxhash64("comp").alias("root"), "items", "buckets",
    )
    return rows.groupBy("bucket", "i", "j").applyInArrow(_block_links(threshold), f"a {NODE}, b {NODE}").distinct()


def _block_links(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        bucket, i, j = (group.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        k, root = group.column("k").to_numpy(), group.column("root").to_numpy()
        bands = np.array(group.column("buckets").to_pylist(), dtype=np.int64)
        items = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group.column("items")]
        sizes = np.array([len(x) for x in items])
        xs, ys = [], []
        for x in np.flatnonzero(k == i):
            # Partners of another component and of like size, at the first bucket that both share.
            ok = (root != root[x]) & ((k == j) if i != j else (np.arange(len(k)) > x))
            ok &= 100 * np.minimum(sizes, sizes[x]) >= threshold * np.maximum(sizes, sizes[x])
            y = np.flatnonzero(ok)
            same = bands[y] == bands[x]
            y = y[bands[x][same.argmax(axis=1)] == bucket] if len(y) else y
            for z in y:
                both = np.concatenate([items[x], items[z]])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= threshold * (len(both) - shared):
                    xs.append(x)
                    ys.append(z)
        comp = group.column("comp").combine_chunks()
        a, b = (comp.take(pa.array(v, pa.int64())) for v in (xs, ys))
        return pa.table({"a": a, "b": b})

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ca", "cb")


def _round(pairs: DataFrame, sets: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Test pairs of different components and contract those that hold."""
    pairs = pin(_ordered(pairs).distinct())
    links = _links(pairs.select("a", "b"), sets, threshold)
    return pin(_relabel(members, pairs.join(links, ["a", "b"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b"))))


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, words: int = 5,
    rows: int = ROWS, bands: int = BANDS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, text_hash)`` for every row.

    Documents are linked where ``100 * intersection >= threshold * union`` of their distinct
    ``words``-word shingles (with fewer words, the whole sequence is the one shingle), A-Z being
    lower-cased. ``component_id`` is the smallest id reachable over links, ``kept`` marks it.

    Null and empty texts and those without words have no shingles and link with nothing. A row
    with a null id makes no links: it is kept, and its ``component_id`` is that of an equal text, or null. Rows that repeat an id are looked at one by one, each by
    its own text. Other columns are ignored; an empty table gives an empty one.
    ``rows`` and ``bands`` decide how likely a link is found, not which pairs are links.
    """
    texts = keyed(docs, id_col, text_col)
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    features = pin(hashed.mapInArrow(_features(words, rows, bands), "doc_id bigint, text_hash bigint, n_shingles bigint, cls binary, h bigint, buckets array<bigint>"))
    usable = features.where("doc_id is not null and n_shingles > 0")
    classes = pin(
        usable.groupBy("cls", "h").agg(F.min("doc_id").alias("id"), F.first("buckets").alias("buckets")).select(
            "cls", F.struct("id", "h").alias("node"), "buckets"
        )
    )
    spread = classes.select(F.explode("buckets").alias("bucket"), "node")
    first = spread.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = pin(spread.join(first, "bucket").select("bucket", "node", "pivot", F.col("node").alias("comp")))

    wanted = members.select(F.col("node.id").alias("doc_id"), F.col("node.h").alias("h")).distinct()
    ids = wanted.select("doc_id").distinct()
    sets = texts.join(ids, "doc_id", "left_semi").mapInArrow(_sets(words), "id bigint, h bigint, items binary")
    sets = sets.join(wanted.withColumnRenamed("doc_id", "id"), ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    sets = pin(sets.select(F.struct("id", "h").alias("node"), "items"))

    star = members.where("node <> pivot").select(
        F.col("pivot").alias("a"), F.col("node").alias("b"), F.col("pivot").alias("ca"), F.col("comp").alias("cb")
    )
    members = _round(star, sets, members.select("bucket", "node", "comp"), threshold)
    left = _open(members)
    star = left.where("comp <> pivot.comp").select(
        F.col("pivot.node").alias("a"), F.col("node").alias("b"), F.col("pivot.comp").alias("ca"), F.col("comp").alias("cb")
    )
    members = _round(star, sets, members, threshold)
    left = pin(_open(members).select("bucket", "node", "comp", "m"))
    few = left.where(F.col("m") <= FEW)
    other = few.select("bucket", F.col("node").alias("b"), F.col("comp").alias("cb"))
    rest = few.select("bucket", F.col("node").alias("a"), F.col("comp").alias("ca")).join(other, "bucket").where("ca < cb")
    pairs = pin(_ordered(rest.select("a", "b", "ca", "cb")).distinct())
    links = pairs.join(_links(pairs.select("a", "b"), sets, threshold), ["a", "b"], "left_semi")
    many = _in_blocks(left.where(F.col("m") > FEW), sets, classes, threshold)
    members = pin(_relabel(members, pin(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).unionByName(many))))

    roots = members.groupBy("node").agg(F.min("comp").alias("comp"))
    found = classes.join(roots, "node", "left").select("cls", F.coalesce("comp.id", "node.id").alias("component"))
    return features.join(found, "cls", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
        "text_hash",
    )
