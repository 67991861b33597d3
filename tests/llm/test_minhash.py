"""Near duplicates against all pairs of full shingle sets."""

import random
import re

import duckdb
import pytest

from revloom.llm import graph, minhash

SCHEMA = "doc_id bigint, text string, cls string, node int"


def shingles(text, k=5):
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, threshold):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def result(spark, docs, threshold, partitions=3):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], SCHEMA).repartition(partitions)
    found = minhash.deduplicate(df, threshold=threshold)
    return sorted(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "kept").collect())


def near_copies(n, words, edits, seed):
    """``n`` copies of one text with 1 to ``edits`` words changed: similar to it, less so to each other."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(words)] = f"z{r.randrange(10_000)}"
        out.append(" ".join(copy))
    return out


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 20)
    docs = list(enumerate(near_copies(150, 120, 6, 1) + near_copies(40, 60, 2, 2)))
    assert result(spark, docs, 85) == brute(docs, 85)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "One  TWO\n"), (6, "one two three"), (7, "É é"), (8, "é é")]
    docs += [(20 + i, t) for i, t in enumerate(near_copies(3, 5000, 1, 3))]
    assert result(spark, docs, 80) == brute(docs, 80)


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g"
    got = result(spark, [(3, text), (3, text), (1, text), (None, text), (2, "x y z u v w")][:3], 80)
    assert got == [(1, 3, 1, True), (3, 3, 1, False), (3, 3, 1, False)]
    df = spark.createDataFrame([(None, text, "", 0), (1, text, "", 0)], SCHEMA)
    rows = {r.doc_id: r for r in minhash.deduplicate(df).collect()}
    assert (rows[None].component_id, rows[None].kept, rows[1].kept) == (1, True, True)


def test_rows_carry_the_hash_of_their_text(spark):
    df = spark.createDataFrame([(1, "a b", "", 0), (2, None, "", 0), (3, "", "", 0)], SCHEMA)
    rows = {r.doc_id: r.text_hash for r in minhash.deduplicate(df).collect()}
    want = df.selectExpr("doc_id", "xxhash64(coalesce(text, '')) h").collect()
    assert rows == {r.doc_id: r.h for r in want} and rows[2] == rows[3] != rows[1]


def test_empty_table(spark):
    assert minhash.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents(spark):
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert result(spark, docs, 85) == brute(docs, 85)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(30)] + [(50, 49), (49, 48), (None, 3)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(df).collect()}
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
