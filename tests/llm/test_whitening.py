"""Whitening against whole matrices and exact integers."""

import math

import numpy as np
import pytest

from revloom.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, x int, h string, weight string, white int, id string"
INF, NAN = float("inf"), float("nan")


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, 1, "a", "b", 2, "c") for i, v in rows], SCHEMA).repartition(partitions)


def brute(rows):
    """All by plain integers and one matrix: ``(n, deviations, x, covariance)`` of the rows that count."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n = len(kept)
    sums = [sum(x[d] for _, x in kept) for d in range(len(kept[0][1]))]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in kept]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for _, x in kept])
    return kept, n, deviation, z, z.T @ z / n


def vectors(seed=1, n=300, k=40):
    """A third of the rows are one vector, others come in small groups of copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, k)) * np.linspace(3, 0.2, k)
    rows = [(i, [float(c) for c in base[0 if i % 3 == 0 else i - i % 4]]) for i in range(n)]
    return rows


def test_equals_whole_matrices(spark):
    rows = [*vectors(), (900, None), (901, [None] * 40), (902, [INF] + [0.0] * 39), (903, [NAN] * 40), (5, vectors()[7][1]), (None, vectors()[8][1])]
    kept, n, deviation, z, cov = brute(rows)
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 32 * len(kept) and {r.n for r in got} == {n}
    assert got[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    values = np.linalg.eigvalsh(cov)[::-1]
    for r in got:
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), d) for (i, _), d in zip(kept, deviation))
    # The same up to the sign of each component, and with covariance 1 over all rows.
    e, u = np.linalg.eigh(cov)
    want = (z @ u[:, ::-1][:, :32]) / np.sqrt(e[::-1][:32])
    by_row = {}
    for r in got:
        by_row.setdefault((str(r.vec_id), r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    rows_of = np.array([[by_row[str(i), d][c][0] for c in range(1, 33)] for (i, _), d in zip(kept, deviation)])
    signs = np.sign((rows_of * want).sum(axis=0))
    assert np.abs(rows_of * signs - want).max() < 1e-8
    cov_white = (rows_of - rows_of.mean(axis=0)).T @ (rows_of - rows_of.mean(axis=0)) / n
    error = np.abs(cov_white - np.eye(32)).max()
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9 and error < 1e-9


def test_each_different_vector_is_whitened_once(spark):
    fitted = whitening.fit(whitening.on_grid(frame(spark, vectors()), "vec_id", "embedding", 64, 1_000_000))
    weights = [r.weight for r in fitted.table.collect()]
    assert sum(weights) == 300 and max(weights) > 99 and len(weights) < 100


def test_few_vectors_and_dimensions(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [])])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [
        (i, c, 2, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)
    ]
    # A constant dimension explains nothing.
    two = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0])])).collect()
    assert sorted((r.vec_id, abs(round(r.whitened, 9)), round(r.explained, 9)) for r in two if r.component == 1) == [(1, 1.0, 1.0), (2, 1.0, 1.0)]
    assert all(r.whitened == r.explained == 0.0 for r in two if r.component == 2)


def test_refused(spark):
    ragged = [(1, [1.0, 2.0]), (2, [1.0])]
    for rows, message, partitions in ((ragged, "width", 1), (ragged, "width", 2), ([(1, [1e14]), (2, [1.0])], "64 bits", 1), ([(1, [1e30])], "overflow", 1)):
        with pytest.raises(Exception, match=message):
            whitening.whiten(frame(spark, rows, partitions)).collect()


def test_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    kept, n, deviation, z, cov = brute(rows)
    got = queries.op12_whitening(spark, sf).collect()
    assert len(got) == 32 * n and {(r.vec_id, r.deviation) for r in got} == {(i, d) for (i, _), d in zip(kept, deviation)}
    assert got[0].identity_error < 1e-4
    e = np.linalg.eigvalsh(cov)[::-1]
    assert all(abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-6 for r in got)
