"""Manifest against trees built level by level from whole lists."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from revloom.llm import merkle, queries

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, known string, name int, node string, `index` int"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, i):
    sides = []
    for nodes in tree[:-1]:
        first = i - i % 3
        sides.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        i //= 3
    return sides


def brute(rows):
    """Rows as (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h(*map(field, r)), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out.append((x[3], x[2], trees[g][-1][0], top[-1][0], tuple(way(trees[g], i) + way(top, k))))
    return sorted(out, key=str)


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(partitions)


def proofs(spark, rows, height):
    found = merkle.build(frame(spark, rows), carry=[F.col("doc_id")], height=height).proofs()
    got = [(r.row.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in found.collect()]
    return sorted(got, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 82, 100])
def test_positions_are_those_of_completion(n):
    leaves = [bytes([i]) * 32 for i in range(n)]
    tree = levels([x.hex() for x in leaves])
    log = [x.hex() for x in merkle.append_log(leaves, merkle.height_of(n))]
    assert len(log) == sum(map(len, tree)) and merkle.height_of(n) == len(tree) - 1
    for level, nodes in enumerate(tree):
        assert [log[p] for p in merkle.positions(n, level, np.arange(len(nodes)))] == nodes
    assert merkle.paths(log, n, len(tree) - 1, []) == [way(tree, i) for i in range(n)]


def test_an_aligned_part_raises_a_short_end_to_its_full_height():
    log = merkle.append_log([b"a" * 32], 2)
    one = hashlib.sha256((b"a" * 32).hex().encode()).hexdigest()
    assert [x.hex() for x in log[1:]] == [one, h(one)]


ODD = [
    (1, None, "en", 3, "abc"), (2, "", None, None, None), (3, "b", "en", 0, ""), (3, "b", "en", 0, ""), (3, "b", "fr", 0, ""),
    (None, "b", None, None, "no id"), (None, None, None, None, None), (4, "é", "de", 9, "ü" * 300_000), (-5, "b", "en", 1, "\n"),
    (7, "z", "en", 1, "1:a"),
]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_odd_rows_and_ties(spark, height):
    assert proofs(spark, ODD, height) == brute(ODD)


@pytest.mark.parametrize("height", [1, 3])
def test_many_rounds_of_builders_and_many_groups(spark, height):
    rows = [(i * 7 % 1000, "hot" if i % 3 else f"s{i % 40}", "en", i, f"t{i}") for i in range(1000)]
    assert proofs(spark, rows, height) == brute(rows)


def test_the_log_holds_every_node_once_in_its_place(spark):
    rows = [(i, "hot", "en", i, f"t{i}") for i in range(200)] + [(1, None, "en", 1, "x")]
    made = merkle.build(frame(spark, rows), height=2)
    got = sorted((r.position, r.node) for r in made.log().where("known").collect())
    tree = levels([h(*map(field, r)) for r in rows[:-1]])
    want = sorted((p, x) for k, nodes in enumerate(tree) for p, x in zip(merkle.positions(200, k, np.arange(len(nodes))).tolist(), nodes))
    assert got == want and [p for p, _ in got] == list(range(len(got)))
    assert {(r.known, r.subroot) for r in made.subroots().collect()} == {(True, tree[-1][0]), (False, h(*map(field, rows[-1])))}


def test_empty_table(spark):
    made = merkle.build(frame(spark, []))
    assert made.root is None and made.proofs().count() == 0 and made.log().count() == 0


def test_changed_texts_are_found_out(spark, tmp_path):
    frame(spark, [*ODD[:4], *ODD[6:], (10, "b", "en", 3, "a\nb"), (12, "b", "en", 3, "a\nb"), (12, "c", "en", 3, None)]).write.parquet(
        str(tmp_path / "documents.parquet")
    )
    import zlib

    for r in queries.op11_merkle(spark, str(tmp_path)).collect():
        even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        line_feed = r.doc_id in (-5, 10) or (r.doc_id == 12 and r.leaf == h(*map(field, (12, "b", "en", 3, "a\nb"))))
        assert r.verified == (not (even and line_feed)) == (r.folded_root == r.root)
