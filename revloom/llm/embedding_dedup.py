"""Near-duplicate vectors by NN-descent.

Equal vectors are one class. Random hyperplanes put vectors into cells, in which each finds its
first neighbours; then every vector introduces its neighbours (and those that have it as one) to
each other, and lists keep the best of what they meet. All members of a cell or of an introduction
meet, large ones in blocks. What meets and reaches the threshold is linked for good: of the links of
a block as many are kept as join the same vectors. A list has places for neighbours of the vector's
own component and as many for others, so that a group of any size leaves room for what is beyond it.
All members of a component are compared in blocks, of which only counts are kept. A brute-force audit
of some vectors against all measures the recall; while it is too low, the search goes on from new
cells, and in the end the job fails.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from revloom.llm.graph import components
from revloom.session import pin

NEIGHBOURS = 12
TABLES, ROUNDS = 4, 2
CELL, BLOCK = 64, 512
AUDITED = 200  # vectors compared with all others
LINKED, DRAWS = 50, (1, 4, 16)  # vectors of small groups that an audit holds, unless its largest draw has fewer
PROBES = 256  # audited vectors of one product
RECALL, ATTEMPTS = 0.98, 4
OUTSIDE, INSIDE, LINK = 0, 1, 2  # neighbours of another component, of the own one, and links to be kept
EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("cos", pa.float64()), ("kind", pa.int8())])
EDGES_SQL = "src bigint, dst bigint, cos double, kind tinyint"


def _unit(data: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = np.stack([np.frombuffer(x.as_buffer(), dtype=np.float64) for x in data])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as packed doubles; null where a vector can link with nothing."""
    for batch in batches:
        out = []
        for v in batch.column("v"):
            x = None if not v.is_valid else v.values
            ok = x is not None and len(x) and not x.null_count
            x = x.to_numpy(zero_copy_only=False).astype(np.float64) if ok else None
            # Scaled by the largest component, so that neither squares nor sums overflow.
            ok = x is not None and np.isfinite(x).all() and np.abs(x).max() > 0
            out.append((x / np.abs(x).max()).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "data"])


def _cells(seed: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, TABLES), dtype=np.int64)
            widths = pc.binary_length(batch.column("data")).to_numpy()
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                x = _unit(batch.column("data").take(pa.array(rows)))
                planes = np.random.default_rng([seed, int(width)]).standard_normal((TABLES, bits, x.shape[1]))
                for t in range(TABLES):
                    sign = (x @ planes[t].T > 0).astype(np.int64)
                    cells[rows, t] = (sign << np.arange(bits)).sum(axis=1) * TABLES + t
            out = pa.array(cells.tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "cells"])

    return run


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join what the links ``near`` (rows by columns, numbered one after the other) join."""
    m = near.shape[0]
    first, other = [], []
    left = near.any(axis=1)
    while left.any():
        start = int(np.argmax(left))
        seen, across = np.zeros(m, dtype=bool), np.zeros(near.shape[1], dtype=bool)
        front = np.array([start])
        seen[start] = True
        while len(front):
            columns = near[front].any(axis=0) & ~across
            across |= columns
            front = np.flatnonzero(near[:, columns].any(axis=1) & ~seen)
            seen[front] = True
        left &= ~seen
        ends = np.concatenate([np.flatnonzero(seen), m + np.flatnonzero(across)])
        first.append(np.full(len(ends), start))
        other.append(ends)
    return (np.concatenate(first), np.concatenate(other)) if first else (np.empty(0, np.int64), np.empty(0, np.int64))


def _meet(neighbours: int, threshold: float):
    """Links of two blocks of a group, and each member's best neighbours in the other, as far as they are news."""

    def run(group: pa.Table) -> pa.Table:
        ids, root, k = (group.column(c).to_numpy() for c in ("id", "root", "k"))
        least = {INSIDE: group.column("least_in").to_numpy(), OUTSIDE: group.column("least_out").to_numpy()}
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        widths = pc.binary_length(group.column("data")).to_numpy()
        out = []

        def add(src: np.ndarray, dst: np.ndarray, cos: np.ndarray, kind: int) -> None:
            out.append((src, dst, cos, np.full(len(src), kind)))

        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            a, b = rows[k[rows] == i], rows[k[rows] == j]
            if not len(a) or not len(b) or len(rows) < 2:
                continue
            x = _unit(group.column("data").take(pa.array(a)))
            y = x if i == j else _unit(group.column("data").take(pa.array(b)))
            sim = x @ y.T
            if i == j:
                np.fill_diagonal(sim, -2.0)
            near = sim >= threshold
            same = near | (root[a][:, None] == root[b][None, :])
            both = np.concatenate([a, b])
            p, q = (both[e] for e in _forest(near))
            fresh = root[p] != root[q]
            add(ids[p][fresh], ids[q][fresh], np.ones(fresh.sum()), LINK)
            for one, two, cos, own in [(a, b, sim, same)] + ([(b, a, sim.T, same.T)] if i != j else []):
                n = min(neighbours, len(two))
                for kind, part in ((INSIDE, own), (OUTSIDE, ~own)):
                    some = np.flatnonzero(part.any(axis=1))
                    if not len(some):
                        continue
                    value = np.where(part[some], cos[some], -2.0)
                    best = np.argpartition(-value, n - 1, axis=1)[:, :n]
                    value = np.take_along_axis(value, best, axis=1)
                    news = value > least[kind][one[some]][:, None]
                    add(np.repeat(ids[one[some]], n)[news.ravel()], ids[two][best][news], value[news], kind)
        joined = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * 4
        return pa.table([pa.array(c.astype(t)) for c, t in zip(joined, (np.int64, np.int64, np.float64, np.int8))], schema=EDGES)

    return run


def _blocks_of(rows: DataFrame, key: str) -> DataFrame:
    """Rows of every pair of blocks ``(key, i, j, k, ...)`` of groups ``key``: a group of up to ``BLOCK`` rows is one block."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = rows.join(sizes, key).withColumn("blocks", blocks).withColumn("k", F.pmod(F.xxhash64("id", key), F.col("blocks")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("*", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j")).drop("m", "blocks", "other")


def _best(edges: DataFrame, neighbours: int) -> DataFrame:
    once = edges.where(F.col("kind") != LINK).groupBy("src", "dst").agg(F.max("cos").alias("cos"), F.max("kind").alias("kind"))
    place = F.row_number().over(Window.partitionBy("src", "kind").orderBy(F.desc("cos"), "dst"))
    return pin(once.withColumn("place", place).where(F.col("place") <= neighbours).drop("place"))


def _rooted(vectors: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``(id, data, root)``: the component as far as it is known, else the vector itself."""
    if roots is None:
        return vectors.withColumn("root", F.col("id"))
    known = vectors.join(roots.withColumnRenamed("node", "id"), "id", "left")
    return known.select("id", "data", F.coalesce("root", "id").alias("root"))


def _start(vectors: DataFrame, roots: DataFrame | None, n: int, seed: int, neighbours: int, threshold: float) -> DataFrame:
    """What is met in the cells of one set of hyperplanes."""
    bits = max(1, round(math.log2(max(2, n / CELL)))) if n > BLOCK else 0
    celled = vectors.mapInArrow(_cells(seed, bits), "id bigint, data binary, cells array<bigint>")
    rows = celled.select("id", F.explode("cells").alias("cell"))
    least = [F.lit(-2.0).alias(c) for c in ("least_in", "least_out")]
    groups = _blocks_of(rows, "cell").join(_rooted(vectors, roots).select("*", *least), "id").groupBy("cell", "i", "j")
    return pin(groups.applyInArrow(_meet(neighbours, threshold), EDGES_SQL))


def _placed(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Neighbours by the components as they are known now."""
    ends = edges.join(roots.select(F.col("node").alias("src"), F.col("root").alias("r")), "src", "left")
    ends = ends.join(roots.select(F.col("node").alias("dst"), F.col("root").alias("s")), "dst", "left")
    same = F.coalesce("r", "src") == F.coalesce("s", "dst")
    return ends.select("src", "dst", "cos", F.when(same, INSIDE).otherwise(OUTSIDE).cast("tinyint").alias("kind"))


def _descend(edges: DataFrame, vectors: DataFrame, roots: DataFrame, neighbours: int, threshold: float) -> DataFrame:
    """One round: what is met where all who share a neighbour meet."""
    there = edges.select(F.col("src").alias("hub"), F.col("dst").alias("id"))
    back = edges.select(F.col("dst").alias("hub"), F.col("src").alias("id"))
    own = edges.select(F.col("src").alias("hub"), F.col("src").alias("id"))
    met = there.unionByName(back).unionByName(own).distinct()

    def least(kind: int) -> Column:
        full = F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)) >= neighbours
        return F.when(full, F.min(F.when(F.col("kind") == kind, F.col("cos")))).otherwise(-2.0)

    worst = edges.groupBy(F.col("src").alias("id")).agg(least(INSIDE).alias("least_in"), least(OUTSIDE).alias("least_out"))
    rows = _blocks_of(met, "hub").join(_rooted(vectors, roots).join(worst, "id"), "id")
    return pin(rows.groupBy("hub", "i", "j").applyInArrow(_meet(neighbours, threshold), EDGES_SQL))


def _in_blocks(threshold: float):
    """Links of each member of one block with those of another: ``(id, n)``."""

    def run(group: pa.Table) -> pa.Table:
        k, n = group.column("k").to_numpy(), group.column("n").to_numpy()
        ids = group.column("id").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        widths = pc.binary_length(group.column("data")).to_numpy()
        links = np.zeros(len(ids), dtype=np.int64)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            x = _unit(group.column("data").take(pa.array(rows)))
            a, b = np.flatnonzero(k[rows] == i), np.flatnonzero(k[rows] == j)
            near = x[a] @ x[b].T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
                links[rows[a]] += near @ n[rows[b]]
            else:
                links[rows[a]] += near @ n[rows[b]]
                links[rows[b]] += near.T @ n[rows[a]]
        return pa.table({"id": ids, "n": links})

    return run


def _count_links(vectors: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """``(id, links)``: links of each class of a component with other classes, copies counted."""
    rows = _blocks_of(roots.withColumnRenamed("node", "id"), "root").join(vectors, "id")
    found = rows.groupBy("root", "i", "j").applyInArrow(_in_blocks(threshold), "id bigint, n bigint")
    return found.groupBy("id").agg(F.sum("n").alias("links"))


def _audit(vectors: DataFrame, roots: DataFrame, n: int, neighbours: int, threshold: float) -> float:
    """Mean share of a linked vector's true links that are in its component, of vectors drawn by a hash of the id.

    The lower one of vectors with up to ``neighbours`` links and of those with more, each vector
    with equal weight. Larger draws follow until ``LINKED`` vectors with few links are in.
    """
    known = _rooted(vectors, roots)
    recalls: dict[bool, tuple[int, float]] = {}
    for times in DRAWS:
        share = min(1.0, times * AUDITED / max(n, 1))
        got = known.where(F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(1_000_000)) < 1_000_000 * share).toArrow()
        if got.num_rows:
            true = known.mapInArrow(_true_links(vectors, got, threshold), "src bigint, n bigint, hit bigint")
            each = true.groupBy("src").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
            by_size = each.groupBy((F.col("n") > neighbours).alias("many"))
            found = by_size.agg(F.count(F.lit(1)).alias("m"), F.avg(F.col("hit") / F.col("n")).alias("recall"))
            recalls = {r["many"]: (r["m"], r["recall"]) for r in found.collect()}
        if share == 1.0 or recalls.get(False, (0, 0.0))[0] >= LINKED:
            break
    return min((recall for _, recall in recalls.values()), default=1.0)


def _true_links(vectors: DataFrame, drawn: pa.Table, threshold: float):
    """Per batch and drawn vector with a link: its links, and how many of them are in its component."""
    columns = drawn.column("id").to_numpy(), drawn.column("root").to_numpy(), drawn.column("data").to_pylist()
    probe = vectors.sparkSession.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, roots, raw = probe.value
        sizes = np.array([len(d) for d in raw])
        for batch in batches:
            all_ids, all_roots = batch.column("id").to_numpy(), batch.column("root").to_numpy()
            widths = pc.binary_length(batch.column("data")).to_numpy()
            for width in np.unique(widths):
                mine, rows = np.flatnonzero(sizes == width), np.flatnonzero(widths == width)
                x = _unit(batch.column("data").take(pa.array(rows)))
                for at in range(0, len(mine), PROBES):
                    own = mine[at : at + PROBES]
                    y = _unit(pa.array([raw[q] for q in own], pa.binary()))
                    near = (y @ x.T >= threshold) & (ids[own][:, None] != all_ids[rows][None, :])
                    n = near.sum(axis=1)
                    hit = (near & (roots[own][:, None] == all_roots[rows][None, :])).sum(axis=1)
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(c[some].astype(np.int64)) for c in (ids[own], n, hit)], ["src", "n", "hit"])

    return run


def deduplicate(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
    neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = 7,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Vectors of one width with a cosine of ``threshold`` or more, in double precision, are linked.
    Vectors that are null, empty or zero or hold a null or non-finite component link with nothing;
    so do rows with a null id, which are kept. ``component_id`` is the smallest id reachable over
    links, ``kept`` marks it. Rows that repeat an id count as vectors of their own. Other columns
    are ignored; an empty table gives an empty one. No link is below the threshold; links inside a
    component are counted without exception. The audit holds the mean share of a vector's links that
    are in its component at ``RECALL``; where ``ATTEMPTS`` starts do not reach it, the job fails.
    """
    raw = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = pin(raw.mapInArrow(_usable, "vec_id bigint, data binary"))
    usable = rows.where("vec_id is not null and data is not null")
    classes = usable.groupBy("data").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # An id that stands for several classes would join them: classes have numbers of their own.
    vectors = pin(classes.select(F.xxhash64("data").alias("id"), "first", "n", "data"))
    n = vectors.count()
    slim = vectors.select("id", "data")
    edges = links = roots = None
    for attempt in range(ATTEMPTS):
        for step in range(1 + rounds):
            if step == 0:
                met = _start(slim, roots, n, seed + attempt, neighbours, threshold)
            else:
                met = _descend(edges, slim, roots, neighbours, threshold)
            found = met.where(F.col("kind") == LINK).select(F.col("src").alias("a"), F.col("dst").alias("b"))
            links = pin((found if links is None else links.unionByName(found)).distinct())
            roots = components(links)
            edges = _best(_placed((met if edges is None else edges.unionByName(met)).where(F.col("kind") != LINK), roots), neighbours)
        recall = _audit(slim, roots, n, neighbours, threshold)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"after {ATTEMPTS} starts the search has found {recall:.3f} of a vector's links, less than {RECALL}")
    counts = _count_links(vectors.select("id", "n", "data"), roots, threshold)
    own = vectors.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "first", "n", "data")
    smallest = own.groupBy("root").agg(F.min("first").alias("component_id"))
    known = own.join(smallest, "root").join(counts, "id", "left").select(
        "data", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    found = F.col("vec_id").isNotNull()
    return rows.join(known, "data", "left").select(
        "vec_id",
        F.when(found, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"),
        F.when(found, F.coalesce("component_id", "vec_id")).alias("component_id"),
        F.when(found, F.coalesce("component_id", "vec_id") == F.col("vec_id")).otherwise(True).alias("kept"),
    )
