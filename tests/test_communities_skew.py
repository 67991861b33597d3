import numpy as np
from pyspark.sql import functions as F

from revloom.operators import communities as com
from revloom.operators.skew import hot_keys, skew_join


def test_parse_communities(spark):
    lines = spark.createDataFrame([("3\t 1\t2.0\t",), ("",), ("1\tx\t7",)], "value string")
    rows = com.parse_communities(lines).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.community_id, set()).add(r.user_id)
    assert set(groups) == {1, 2} and sorted(map(sorted, groups.values())) == [[1, 2, 3], [1, 7]]
    again = com.parse_communities(lines.repartition(3)).collect()
    assert sorted(rows) == sorted(again)


def test_attach_communities(spark):
    member = spark.createDataFrame([(1, 5), (1, 2), (2, 5)], "user_id bigint, community_id bigint")
    reviews = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 9)], "review_id string, user_id bigint")
    long = com.attach_communities(reviews, member).collect()
    assert sorted((r.review_id, r.community_id) for r in long) == [("r1", 2), ("r1", 5), ("r2", 5)]
    users = spark.createDataFrame([(1, 4)], "user_id bigint, __salts bigint")
    hot = com.attach_communities(reviews, member, hot_users=users)
    assert sorted((r.review_id, r.community_id) for r in hot.collect()) == [("r1", 2), ("r1", 5), ("r2", 5)]
    arrays = com.attach_communities(reviews, member, as_array=True).collect()
    assert {r.review_id: r.community_id_arr for r in arrays} == {"r1": [2, 5], "r2": [5]}


def _planted(spark, seed):
    rng = np.random.default_rng(seed)
    groups = [set(range(0, 50)), set(range(40, 90)), set(range(80, 120))]
    pairs = {(i, j) for g in groups for i in g for j in g if i < j and rng.random() < 0.35}
    noise = rng.integers(0, 120, (60, 2))
    pairs |= {(int(min(a, b)), int(max(a, b))) for a, b in noise if a != b}
    return groups, spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")


def _communities(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.community_id, set()).add(r.user_id)
    return found


def test_planted_communities_are_found(spark):
    groups, edges = _planted(spark, 0)
    found = _communities(com.detect_communities(edges, 3, rounds=15))
    for g in groups:
        assert max(2 * len(g & f) / (len(g) + len(f)) for f in found.values()) > 0.85


def test_hot_nodes_do_not_change_the_communities(spark):
    """With a tiny task size every node is hot and both joins of a round are salted."""
    _, edges = _planted(spark, 1)
    plain, _ = com.affiliations(edges, 3, rounds=2)
    salted, _ = com.affiliations(edges.repartition(5), 3, rounds=2, rows_per_task=7)
    a = {r.id: r.f for r in plain.collect()}
    b = {r.id: r.f for r in salted.collect()}
    assert set(a) == set(b)
    assert all(np.allclose(a[i], b[i]) for i in a)


def test_likelihood_does_not_fall(spark):
    """Expectation maximisation raises the likelihood from round to round."""
    _, edges = _planted(spark, 2)
    pairs = {tuple(r) for r in com.undirected(edges).collect()}
    last = -np.inf
    for rounds in (1, 3, 6):
        f = {r.id: np.array(r.f) for r in com.affiliations(edges, 3, rounds=rounds)[0].collect()}
        m = np.stack([f[i] for i in sorted(f)])
        place = {i: n for n, i in enumerate(sorted(f))}
        x = m @ m.T
        link = np.zeros_like(x, dtype=bool)
        for a, b in pairs:
            link[place[a], place[b]] = True
        value = np.log(-np.expm1(-x[link])).sum() - x[~link].sum()
        assert value > last
        last = value


def test_undirected(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (1, None)], "src bigint, dst bigint")
    assert sorted(tuple(r) for r in com.undirected(edges).collect()) == [(1, 2), (2, 1)]


def test_skew_join_equals_join(spark):
    """A key holds a third of the rows, another a third as copies of one row."""
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 1).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("v"),
    )
    right = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = hot_keys(left, ["k"], rows_per_task=100)
    assert sorted(map(tuple, hot.collect())) == [(0, 10), (1, 10)]
    got = skew_join(left, right, ["k"], hot).select("k", "v", "w")
    want = left.join(right, "k").select("k", "v", "w")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.count() == want.count() > 2000


def test_no_hot_key_is_left_out(spark):
    df = spark.range(30_000).select((F.col("id") % 3000).alias("k"), "id")
    hot = hot_keys(df, ["k"], rows_per_task=4)
    assert hot.count() == 3000 and hot.select("__salts").distinct().collect() == [(3,)]
    assert skew_join(df, df.select("k").distinct(), ["k"], hot).count() == 30_000
    assert hot_keys(df, ["k"]).count() == 0


def test_members_of_any_size(spark):
    lines = spark.createDataFrame([("9007199254740993\tnan\t2.0\t1e3\tx\t",)], "value string")
    assert lines.select(com.members("value")).first()[0] == [9007199254740993, 2, 1000]


def test_rounds_leave_no_tables(spark):
    import os
    from urllib.parse import urlparse

    from revloom.session import checkpoint_dir

    _, edges = _planted(spark, 3)
    folder = urlparse(checkpoint_dir(spark)).path
    count = lambda rounds: (len(os.listdir(folder)), com.detect_communities(edges, 3, rounds=rounds), len(os.listdir(folder)))
    few, many = ((b - a) for a, _, b in (count(2), count(7)))
    assert few == many


def test_adaptive_execution_splits_a_hot_key(spark):
    """The setting the plain joins rely on, also where the join feeds an aggregation on its key."""
    changed = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("user_id"), "id"
        )
        member = spark.range(5000).select(F.col("id").alias("user_id"), (F.col("id") % 7).alias("community_id"))
        sums = com.attach_communities(left, member).groupBy("user_id").agg(F.sum("id").alias("n"))
        assert sums.agg(F.sum("n")).first()[0] == 60_000 * 59_999 // 2
        sums.collect()
        assert "skew=true" in sums._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
