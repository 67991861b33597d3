"""Sparse affiliations against the same rule in NumPy, and against planted communities."""

import re

import numpy as np
import pytest

from revloom.operators import affiliation as aff
from tests.test_communities_skew import _communities, _planted


def numpy_rounds(pairs, start, c, chance, rounds):
    """The rule over whole matrices; gives the strengths and the likelihood before each round."""
    ids = sorted({i for p in pairs for i in p})
    place = {i: n for n, i in enumerate(ids)}
    f = np.zeros((len(ids), c))
    for (i, k), v in start.items():
        f[place[i], k] = v
    link = np.zeros((len(ids), len(ids)), dtype=bool)
    for a, b in pairs:
        link[place[a], place[b]] = True
    history = []
    for _ in range(rounds):
        q = f @ f.T + chance
        r = np.where(link, 1 / -np.expm1(-q), 0.0)
        history.append((np.log(-np.expm1(-q[link])) + q[link]).sum() - (f.sum(axis=0) ** 2).sum())
        g = r @ f
        whole = f.sum(axis=0)
        root = np.sqrt((f * g).sum(axis=0))
        new = np.divide(f * g, root, out=np.zeros_like(f), where=root > 0)
        new = np.where((f == 0) & (g > whole) & (whole > 0), aff.ENTRY, new)
        f = np.where(new >= aff.LEAST, new, 0.0)
    return {(i, k): f[place[i], k] for i in ids for k in range(c) if f[place[i], k]}, history


@pytest.mark.parametrize("rows_per_task", [1_000_000, 7])
def test_rounds_equal_whole_matrices(spark, rows_per_task):
    _, edges = _planted(spark, 1)
    sym = aff.undirected(edges)
    pairs = {tuple(r) for r in sym.collect()}
    degrees = sym.groupBy(sym.src.alias("id")).agg(aff.F.count(aff.F.lit(1)).alias("n"))
    start = aff._start(sym, degrees, aff._seeds(sym, degrees, 3))
    first = {(r.id, k): v for r in start.collect() for k, v in r.f.items()}
    got, density, history = aff.fit_affiliations(edges.repartition(5), 3, tolerance=-1.0, max_rounds=3, rows_per_task=rows_per_task)
    want, likelihood = numpy_rounds(pairs, first, 3, -aff.CHANCE * np.log(1 - density), 3)
    got = {(r.id, r.c): r.strength for r in got.collect()}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in got)
    assert np.allclose(history[:3], likelihood)


def test_planted_communities_are_found_and_the_likelihood_does_not_fall(spark):
    groups, edges = _planted(spark, 2)
    strengths, density, history = aff.fit_affiliations(edges, 3)
    # Entering strengths are small, not infinitely so.
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:])) and 5 < len(history) <= 51
    assert history[-1] - history[-2] < 1e-3 * abs(history[-1])
    found = _communities(aff.members(strengths, density))
    for g in groups:
        assert max(2 * len(g & f) / (len(g) + len(f)) for f in found.values()) > 0.85


def test_strengths_do_not_grow_with_the_number_of_communities(spark):
    """Separate cliques: a node has its own clique's community and no other, however many there are."""
    edges = [(10 * g + i, 10 * g + j) for g in range(30) for i in range(10) for j in range(i)]
    strengths, *_ = aff.fit_affiliations(spark.createDataFrame(edges, "src bigint, dst bigint"), 30, max_rounds=4)
    rows = strengths.collect()
    assert len(rows) == 300 and {(r.id // 10) for r in rows} == set(range(30))
    assert len({(r.id // 10, r.c) for r in rows}) == 30


def test_odd_graphs(spark):
    schema = "src bigint, dst bigint"
    with pytest.raises(ValueError):
        aff.detect_communities(spark.createDataFrame([(1, 1), (None, 2)], schema), 2)
    one = aff.detect_communities(spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (None, 1)], schema), 5, max_rounds=3).collect()
    assert {r.user_id for r in one} <= {1, 2}


@pytest.mark.parametrize("fits, rows_per_task", [(True, 1_000_000), (False, 1_000_000), (False, 7)])
def test_many_links_come_in_parts_of_bounded_size(spark, monkeypatch, fits, rows_per_task):
    """Whether nodes fit or not, and with nodes on several salts, parts change nothing but what a task holds."""
    _, edges = _planted(spark, 1)
    want, _, history = aff.fit_affiliations(edges, 3, tolerance=-1.0, max_rounds=2)
    plans, pin = [], aff.pin
    monkeypatch.setattr(aff, "pin", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or pin(df))
    monkeypatch.setattr(aff, "fits_workers", lambda *_: fits)
    got, _, again = aff.fit_affiliations(edges, 3, tolerance=-1.0, max_rounds=2, rows_per_task=rows_per_task, links_per_part=300)
    want, got = ({(r.id, r.c): r.strength for r in x.collect()} for x in (want, got))
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in got)
    assert np.allclose(history, again)
    parts = -(-2 * edges.count() // 300)
    exchanges = [re.findall(r"hashpartitioning\(([^()]*), (\d+)\)", p) for p in plans]
    assert parts > 4 and exchanges[1] and {int(n) for _, n in exchanges[1]} == {parts}  # pairs and their layout
    rounds = [e for p, e in zip(plans, exchanges) if "expm1" in p.lower()]
    assert len(rounds) == 3
    for e in rounds:
        # The links lie as they are if nodes come to them; else both joins are dealt, and sums are made where they end.
        assert all(int(n) == parts for _, n in e) and len(e) == (5 if rows_per_task == 7 else 4) if not fits else len(e) == 1


def test_seeds_have_more_friends_than_their_friends(spark):
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in rng.integers(-20, 20, (70, 2)) if a != b}
    sym = aff.undirected(spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"))
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rank = lambda i: (len(near[i]), -i)
    order = sorted(near, key=lambda i: (not all(rank(i) > rank(j) for j in near[i]), -len(near[i]), i))
    degrees = sym.groupBy(sym.src.alias("id")).agg(aff.F.count(aff.F.lit(1)).alias("n"))
    hot = degrees.where("n > 3").select("id", aff.F.lit(3).cast("bigint").alias(aff.SALTS))
    for options in ({}, {"parts": 6}, {"parts": 6, "hot": hot}, {"fits": True}):
        assert aff._seeds(sym, degrees, 12, **options) == order[:12]
