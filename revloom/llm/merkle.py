"""Merkle manifest of a dataset: one hash tree per group of rows, and one over the groups.

Rows are leaves in id order. While a level has several nodes, every ``FANOUT`` consecutive ones (the
last run may be shorter, also a single one) become the hash of their digests. The nodes of a tree are
logged in order of completion (postorder): a node stands right behind the last of its children. Trees
are written by builders that each take one aligned subtree of ``FANOUT ** HEIGHT`` leaves, hence an unbroken part
of the log; the roots of these are the leaves of the next round of builders, so no group of any size
is in one task. Where a node stands follows from the sizes of the subtrees before it
(``positions``): siblings of a proof are read by position, without search and without keys in the log.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from revloom.session import pin

FANOUT = 3
HEIGHT = 6  # levels of a builder
SIZE = 32  # bytes of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# A group is known by two columns, so that a null one comes first and joins like any other.
GROUP = ["known", "name"]
PROOF = "array<struct<left: string, right: string>>"


# --- hashes -------------------------------------------------------------------------------------


def leaf_digest(values: Sequence[Column]) -> Column:
    """Hash of a row: each value as its length in bytes, ``:`` and its text; ``-`` if null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def proof_digest(proof: Column | str) -> Column:
    """Hash of all siblings of a proof, leaf level first, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def fold(leaf: Column, proof: Column | str) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def _join(digests: Sequence[bytes]) -> bytes:
    """Hash of digests, which count as lower-case hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


# --- trees and their logs -----------------------------------------------------------------------


def height_of(n: int) -> int:
    """Levels above ``n`` leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


def positions(n: int, level: int, index: np.ndarray) -> np.ndarray:
    """Places in the log of nodes of one level of a tree (or aligned subtree) of ``n`` leaves.

    A node comes ``level`` places behind the last leaf below it. Before that leaf stand all earlier
    leaves, and of each level ``h`` those nodes whose ``FANOUT ** h`` leaves are all among them.
    """
    last = np.minimum((np.asarray(index, dtype=np.int64) + 1) * FANOUT**level, n) - 1
    place, whole = last + level, last // FANOUT
    while whole.any():
        place, whole = place + whole, whole // FANOUT
    return place


def append_log(leaves: Sequence[bytes], height: int) -> list[bytes]:
    """All nodes of a tree of the given height in order of completion."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(height + 1)]
    for i, node in enumerate(leaves):
        log.append(node)
        runs[0].append(node)
        level = 0
        while level < height and (len(runs[level]) == FANOUT or i == len(leaves) - 1):
            node = _join(runs[level])
            runs[level].clear()
            level += 1
            log.append(node)
            runs[level].append(node)
    return log


def paths(log: Sequence[str], n: int, height: int, above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """For every leaf its siblings, read from the log by position: ``(left, right)`` per level, then ``above``."""
    found = [above]
    for level in range(height - 1, -1, -1):
        count = -(-n // FANOUT**level)
        place = positions(n, level, np.arange(count)).tolist()
        below: list[list[tuple[str, str]]] = []
        for first in range(0, count, FANOUT):
            run = [log[p] for p in place[first : first + FANOUT]]
            upper = found[first // FANOUT]
            below += [[("".join(run[:i]), "".join(run[i + 1 :])), *upper] for i in range(len(run))]
        found = below
    return found


# --- builders -----------------------------------------------------------------------------------


def _write(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Log and root of every aligned subtree."""
        for batch in batches:
            logs = [
                append_log(leaves, min(height, height_of(n)))
                for n, leaves in zip(batch.column("n").to_pylist(), batch.column("nodes").to_pylist())
            ]
            ends = [pa.array([b"".join(log) for log in logs], pa.binary()), pa.array([log[-1] for log in logs], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *ends], [*batch.schema.names[:-1], "log", "root"])

    return run


def _segments(nodes: DataFrame, height: int) -> DataFrame:
    """``nodes (known, name, n, index, node, row)`` to one log segment per aligned subtree, written."""
    block = F.floor(F.col("index") / FANOUT**height).cast("bigint").alias("block")
    # At most FANOUT ** height rows a group.
    grouped = nodes.groupBy(*GROUP, block).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("index", "node", "row"))).alias("members")
    )
    row = grouped.schema["members"].dataType.elementType["row"].dataType.simpleString()
    ready = grouped.select(*GROUP, "block", "n", F.col("members.row").alias("rows"), F.col("members.node").alias("nodes"))
    schema = f"known boolean, name string, block bigint, n bigint, rows array<{row}>, log binary, root binary"
    return pin(ready.mapInArrow(_write(height), schema))


def _forest(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Segments of all trees, one table per round of builders."""
    span = FANOUT**height
    rounds = [_segments(nodes, height)]
    while True:
        more = rounds[-1].where(F.col("n") > span)
        if more.isEmpty():
            return rounds
        n = F.ceil(F.col("n") / span).cast("bigint").alias("n")
        roots = more.select(*GROUP, n, F.col("block").alias("index"), F.col("root").alias("node"), F.lit(None).cast("int").alias("row"))
        rounds.append(_segments(roots, height))


def _roots(rounds: list[DataFrame], height: int) -> DataFrame:
    """Root of every tree."""
    tops = [r.where(F.col("n") <= FANOUT**height).select(*GROUP, "root") for r in rounds]
    return reduce(DataFrame.unionByName, tops)


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``index``, the place of a row within its group, and ``n``, the size of the group.

    Rows are range-partitioned over all groups, so a large one is spread; a group's part in a
    partition is shifted by its parts in earlier ones (a row per group and partition).
    """
    by = [*GROUP, *[F.asc_nulls_first(c) for c in order]]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    part = F.spark_partition_id()
    sorted_rows = sorted_rows.withColumn("part", part).withColumn(
        "at", F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)
    )
    sorted_rows = pin(sorted_rows)  # bounds of ranges come from a sample and must not be drawn twice
    runs = sorted_rows.groupBy(*GROUP, "part").agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("first"))
    whole = Window.partitionBy(*GROUP)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first")
    runs = runs.select(*GROUP, "part", shift.alias("shift"), F.sum("m").over(whole).alias("n"))
    numbered = sorted_rows.join(runs, [*GROUP, "part"])
    return numbered.withColumn("index", F.col("at") + F.col("shift")).drop("part", "at", "shift")


# --- proofs -------------------------------------------------------------------------------------


def _hex(log: bytes) -> list[str]:
    text = log.hex()
    return [text[i : i + 2 * SIZE] for i in range(0, len(text), 2 * SIZE)]


def _proof_arrays(found: list[list[tuple[str, str]]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    flat = [p for path in found for p in path]
    sides = [pa.array([p[i] for p in flat], pa.string()) for i in (0, 1)]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(sides, ["left", "right"]))


def _read(height: int):
    span = FANOUT**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Proofs of the leaves of every segment, one batch a segment."""
        for batch in batches:
            for i in range(batch.num_rows):
                known, name, block, n, log, above, root = (
                    batch.column(c)[i].as_py() for c in (*GROUP, "block", "n", "log", "above", "subroot")
                )
                leaves, nodes = min(span, n - block * span), _hex(log)
                found = paths(nodes, leaves, min(height, height_of(n)), [(p["left"], p["right"]) for p in above])
                own = [nodes[p] for p in positions(leaves, 0, np.arange(leaves)).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([known] * leaves, pa.bool_()), pa.array([name] * leaves, pa.string()),
                        pa.array(np.arange(block * span, block * span + leaves)), pa.array(own, pa.string()),
                        batch.column("rows").slice(i, 1).flatten(), _proof_arrays(found), pa.array([root] * leaves, pa.string()),
                    ],
                    [*GROUP, "index", "leaf", "row", "proof", "subroot"],
                )

    return run


def _proofs(rounds: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """``(known, name, index, leaf, row, proof, subroot)`` for every leaf of the first round.

    ``above (known, name, above, subroot)`` continues the proof of each tree's root. Proofs go down
    round by round: a subtree gets that of its root once, however many leaves it has.
    """
    span, paths_of = FANOUT**height, None
    for segments in reversed(rounds):
        tops = above.select(*GROUP, F.lit(0).cast("bigint").alias("block"), "above", "subroot")
        held = segments.where(F.col("n") <= span).join(tops, [*GROUP, "block"])
        if paths_of is not None:
            lower = paths_of.select(*GROUP, F.col("index").alias("block"), F.col("proof").alias("above"), "subroot")
            held = held.unionByName(segments.where(F.col("n") > span).join(lower, [*GROUP, "block"]))
        row = segments.schema["rows"].dataType.elementType.simpleString()
        schema = f"known boolean, name string, index bigint, leaf string, row {row}, proof {PROOF}, subroot string"
        paths_of = held.mapInArrow(_read(height), schema)
    return paths_of


def _log_rows(level: int, height: int):
    span = FANOUT**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known, name, block, n, leaves, log = (batch.column(c)[i].as_py() for c in (*GROUP, "block", "n", "leaves", "log"))
                count, nodes = min(span, n - block * span), _hex(log)
                place, digests = [], []
                # Above the first round the lowest level is the roots of the round before.
                for h in range(1 if level else 0, min(height, height_of(n)) + 1):
                    own = np.arange(-(-count // FANOUT**h))
                    place += positions(leaves, level + h, own + block * FANOUT ** (height - h)).tolist()
                    digests += [nodes[p] for p in positions(count, h, own).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([known] * len(place)), pa.array([name] * len(place)), pa.array(place, pa.int64()), pa.array(digests)],
                    [*GROUP, "position", "node"],
                )

    return run


@dataclass
class Manifest:
    """Trees of the groups and the tree over them, as written; ``root`` is None without rows."""

    root: str | None
    groups: list[DataFrame]
    top: list[DataFrame]
    height: int

    def subroots(self) -> DataFrame:
        """``(known, name, subroot)``; ``known`` is false for the null group."""
        return _roots(self.groups, self.height).select(*GROUP, F.lower(F.hex("root")).alias("subroot"))

    def log(self) -> DataFrame:
        """``(known, name, position, node)``: every node of every group's tree at its place in the log."""
        sizes = self.groups[0].select(*GROUP, F.col("n").alias("leaves")).distinct()
        parts = [
            r.select(*GROUP, "block", "n", "log").join(sizes, GROUP).mapInArrow(_log_rows(i * self.height, self.height), "known boolean, name string, position bigint, node string")
            for i, r in enumerate(self.groups)
        ]
        return reduce(DataFrame.unionByName, parts)

    def proofs(self) -> DataFrame:
        """``(leaf, subroot, root, proof, row)`` for every row; ``row`` holds what was carried.

        ``proof`` lists for each level, from the leaf's to the one below the root, the hex digests
        left and right of the node on the way, as one text each.
        """
        none = self.top[0].select(*GROUP, F.array().cast(PROOF).alias("above"), F.lit(None).cast("string").alias("subroot")).distinct()
        of_group = _proofs(self.top, none, self.height).select(
            F.col("row.known"), F.col("row.name"), F.col("proof").alias("above"), F.col("leaf").alias("subroot")
        )
        return _proofs(self.groups, pin(of_group), self.height).select("leaf", "subroot", F.lit(self.root).alias("root"), "proof", "row")


def build(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "source", order_col: str = "doc_id", carry: Sequence[Column] = (),
    height: int = HEIGHT,
) -> Manifest:
    """Hash every row, build the groups' trees and the tree over them.

    Leaves of a group are in the order of ``order_col``, null first, and rows of the same id in that
    of their digests, so that the result does not depend on partitioning; equal rows are leaves of their
    own. Groups are in the order of their bytes, the null group first and other than an empty name.
    A null in any field hashes as ``-``, an empty text as ``0:``. ``carry`` is kept with every row and not
    hashed; columns not named are ignored, whatever their names. Without rows there is no root.
    ``height`` is the number of levels of a builder; it changes the number of rounds, not the result.
    """
    group, order = F.col(group_col).cast("string"), F.col(order_col)
    carried = F.struct(*carry) if carry else F.lit(None).cast("int")
    rows = docs.select(
        group.isNotNull().alias("known"), F.coalesce(group, F.lit("")).alias("name"), order.alias("order"),
        F.unhex(leaf_digest([F.col(f) for f in fields])).alias("node"), carried.alias("row"),
    )
    groups = _forest(_numbered(rows, ["order", "node"]).drop("order"), height)
    # The groups are the rows of one more tree.
    named = _roots(groups, height).select(
        F.lit(True).alias("known"), F.lit("").alias("name"), F.struct(*GROUP).alias("order"), F.col("root").alias("node"),
        F.struct(*GROUP).alias("row"),
    )
    top = _forest(_numbered(named, ["order"]).drop("order"), height)
    root = _roots(top, height).first()
    return Manifest(bytes(root["root"]).hex() if root else None, groups, top, height)


def verify(proofs: DataFrame, leaf: Column) -> DataFrame:
    """Add ``folded_root``, the root that ``leaf`` and the proof lead to, and whether it is the root."""
    folded = proofs.withColumn("folded_root", fold(leaf, "proof"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
