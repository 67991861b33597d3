"""How queries deal their rows: the same results, in parts that grow with the rows."""

from revloom.functions.vectors import l2_normalise
from revloom.operators import communities, regression
from revloom.plans import queries, roles
from revloom.session import parts_of

SF = "/root/testdata/sf0.001"


def test_pairs_are_summed_in_parts_of_bounded_size(spark, monkeypatch):
    want = sorted(queries.q25_combine_predictions(spark, SF).collect())
    monkeypatch.setattr(queries, "REVIEWS_PER_PART", 100)
    rows = queries.q25_combine_predictions(spark, SF)
    lines = roles.table(spark, SF, "lineitem").count()
    assert f"{-(-lines // 100)})" in rows._jdf.queryExecution().toString().split("RepartitionByExpression", 1)[-1] or lines <= 100
    assert len(want) > 0 and sorted(rows.collect()) == want


def test_reviews_are_joined_once_for_several_readers(spark):
    rows = roles.review_vectors(spark, SF, 2, keep=True)
    assert "l_orderkey" not in rows._jdf.queryExecution().toString()
    plain = roles.review_vectors(spark, SF, 2)
    assert sorted(rows.collect()) == sorted(plain.select(*rows.columns).collect())


def test_fit_without_keeping_rows(spark):
    rows = roles.review_vectors(spark, SF, 2, keep=True).withColumn("features", l2_normalise("features"))
    kept, made = (regression.fit(rows, regression.linear_regression(), 2, keep=keep) for keep in (True, False))
    assert all(abs(a - b) < 1e-9 for a, b in zip(kept.coefficients, made.coefficients))


def test_friend_links_come_in_parts_of_bounded_size(spark, monkeypatch):
    """Lines meet their orders in parts, and are not sorted for the dictionary; a name that comes twice counts twice."""
    users = roles.user_dictionary(spark, SF)
    users = users.unionByName(users.limit(5))
    want = sorted(roles.known_links(spark, SF, users).collect())
    monkeypatch.setattr(roles, "parts_of", lambda spark, rows: parts_of(spark, rows, 500))
    rows = roles.known_links(spark, SF, users)
    plan, parts = rows._jdf.queryExecution().executedPlan().toString(), -(-roles.table(spark, SF, "lineitem").count() // 500)
    assert parts > 4 and "ShuffledHashJoin" in plan and f"{parts})" in plan
    assert len(want) > 0 and sorted(rows.collect()) == want


def test_parts_follow_the_rows(spark):
    assert [parts_of(spark, n, 100) for n in (0, 400, 401, 10_000)] == [None, None, 5, 100]


def test_pairs_in_parts(spark):
    rows = [(1, 2), (2, 1), (1, 2), (3, 3), (None, 1), (4, None), (None, None), (7, 5), (-1, 7)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint")
    for parts in (None, 5):
        got = communities.undirected(edges, parts)
        assert got.columns == ["src", "dst"]
        assert sorted(map(tuple, got.collect())) == [(-1, 7), (1, 2), (2, 1), (5, 7), (7, -1), (7, 5)]
