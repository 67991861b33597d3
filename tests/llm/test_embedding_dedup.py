"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from revloom.llm import embedding_dedup

SCHEMA = "vec_id bigint, embedding array<float>, id int, data string"


def brute(rows, threshold=0.95):
    usable = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n = len(usable)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(a + 1, n):
            x, y = usable[a][1], usable[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(b)] = find(a)
    lowest = {}
    for k in range(n):
        lowest[find(k)] = min(lowest.get(find(k), math.inf), usable[k][0])
    found = sorted((i, links[k], lowest[find(k)], lowest[find(k)] == i) for k, (i, _) in enumerate(usable))
    used = [i for i, _ in usable]
    alone = [(i, 0, i, True) for i, v in rows if i is not None and i not in used]
    return sorted(found + alone)


def result(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in embedding_dedup.deduplicate(df.repartition(3)).collect() if r.vec_id is not None)


def test_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for size in [1] * 60 + [2, 3, 5, 100]:
        base = rng.standard_normal(16)
        for _ in range(size):
            rows.append((at, (base + rng.standard_normal(16) * 0.12 * np.linalg.norm(base) / 4).astype(np.float32).tolist()))
            at += 1
    rows += [(at + k, rows[5][1]) for k in range(30)]
    want = brute(rows)
    assert sum(n for _, n, *_ in want) > 1000
    assert result(spark, rows) == want


def directions(n, width, rng):
    x = rng.standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_groups_that_fill_all_places(spark):
    """Two groups of 100, cosine about .998 inside and .96 across, beside 600 others."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    second = 0.962 * q[0] + math.sqrt(1 - 0.962**2) * q[1]
    groups = [c + 0.0447 * directions(100, 64, rng) for c in (q[0], second)]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([*groups, directions(600, 64, rng)]))]
    want = brute(rows)
    assert sum(n for _, n, *_ in want) > 2 * (2 * 100 * 99 // 2 + 9000) and sum(kept for *_, kept in want) == 601
    assert result(spark, rows) == want


def test_pairs_in_a_dense_region(spark):
    """1500 vectors that share a cone, below the threshold to each other but for 60 planted pairs."""
    rng = np.random.default_rng(6)
    axis = directions(1, 64, rng)
    cone = axis + 0.9 * directions(1440, 64, rng)
    cone /= np.linalg.norm(cone, axis=1, keepdims=True)
    rows = np.concatenate([cone, cone[:60] + 0.25 * directions(60, 64, rng), directions(1500, 64, rng)])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    assert sorted(zip(a, b)) == [(k, 1440 + k) for k in range(60)]
    got = result(spark, [(i, v.tolist()) for i, v in enumerate(rows)])
    assert sum(n for _, n, *_ in got) == 2 * 60


def test_large_group_hides_no_pairs_from_the_audit(spark):
    """A group of 80 is found, 30 pairs are not: 99 per cent of the links, but none of the pairs."""
    rng = np.random.default_rng(9)
    pairs = np.repeat(directions(30, 64, rng), 2, axis=0) + 0.1 * directions(60, 64, rng)
    x = np.concatenate([directions(1, 64, rng) + 0.1 * directions(80, 64, rng), pairs])
    vectors = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id bigint, data binary")
    roots = spark.createDataFrame([(i, 0) for i in range(80)], "node bigint, root bigint")
    assert embedding_dedup._audit(vectors, roots, len(x), 12, 0.95) == 0.0


def test_search_that_falls_short_fails(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = directions(600, 16, rng)
    rows = np.concatenate([x, x + 0.2 * directions(600, 16, rng)])
    monkeypatch.setattr(embedding_dedup, "TABLES", 1)
    monkeypatch.setattr(embedding_dedup, "ATTEMPTS", 1)
    with pytest.raises(RuntimeError, match="search"):
        df = spark.createDataFrame([(i, [float(c) for c in v], 0, "x") for i, v in enumerate(rows)], SCHEMA)
        embedding_dedup.deduplicate(df, rounds=0).count()


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]),
            (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e38, 1e38]), (11, [1e-38, 1e-38]), (12, [-1.0, 0.0]), (7, [1.0, 0.0])]
    assert result(spark, rows) == brute(rows)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 0, ""), (3, [1.0, 0.0], 0, "")], SCHEMA)
    got = {r.vec_id: tuple(r)[1:] for r in embedding_dedup.deduplicate(df).collect()}
    assert got == {None: (0, None, True), 3: (0, 3, True)}
    assert embedding_dedup.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
