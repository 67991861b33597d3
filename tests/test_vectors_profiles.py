import math

import numpy as np
import pytest
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from revloom.functions import vectors as v
from revloom.operators import profiles
from revloom.operators.skew import hot_keys

ROWS = [
    ("r1", 1, 10, [1.0, 2.0, 3.0]),
    ("r2", 1, 11, [-1.0, 0.5, 2.0]),
    ("r3", 2, 10, [4.0, 0.0, 1.0]),
    ("r4", 2, 11, [0.0, 0.0, 0.0]),
    ("r5", 3, 10, [1.0, -1.0, 0.0]),
    ("bad1", 1, 10, None),
    ("bad2", 1, 10, [1.0, float("nan"), 0.0]),
    ("bad4", 1, 10, [1.0, None, 2.0]),
]


@pytest.fixture(scope="module")
def reviews(spark):
    schema = "review_id string, user_id bigint, business_id bigint, features array<double>"
    return spark.createDataFrame(ROWS, schema)


def _good():
    return [r for r in ROWS if not r[0].startswith("bad")]


def _mean(vectors):
    return [sum(x) / len(vectors) for x in zip(*vectors)]


def _l2(x):
    n = math.sqrt(sum(a * a for a in x))
    return [a / n for a in x] if n else x


def _close(a, b):
    assert len(a) == len(b) and all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a, b)), (a, b)


def test_l2_normalise_equals_normalizer(spark, reviews):
    good = reviews.where(v.is_finite("features", 3))
    ml = Normalizer(inputCol="x", outputCol="y").transform(good.withColumn("x", array_to_vector("features")))
    rows = ml.select(vector_to_array("y").alias("want"), v.l2_normalise("features").alias("got")).collect()
    assert len(rows) == 5
    for r in rows:
        _close(r.got, r.want)


def test_sum_normalise_drops_what_has_no_sum(spark, reviews):
    good = reviews.where(v.is_finite("features", 3))
    got = {r.review_id: r.n for r in v.sum_normalise(good, "features", "n").collect()}
    assert set(got) == {"r1", "r2", "r3"}
    _close(got["r2"], [-1 / 1.5, 0.5 / 1.5, 2 / 1.5])


def test_scale_and_dot(spark):
    row = spark.range(1).select(
        v.scale(F.array(F.lit(1.0), F.lit(2.0)), F.lit(3.0)).alias("s"),
        v.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(5.0))).alias("d"),
    ).first()
    assert row.s == [3.0, 6.0] and row.d == 14.0


def test_ml_vectors_become_arrays(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),), (Vectors.sparse(2, {1: 3.0}),), (None,)], ["f"])
    assert sorted(r.f for r in v.arrays(df, "f").collect()) == [[0.0, 3.0], [1.0, 2.0]]


@pytest.mark.parametrize("mode", profiles.MODES)
def test_profiles(reviews, mode):
    got = {r.user_id: r.profile for r in profiles.entity_profiles(reviews, "user_id", mode, 3).collect()}
    by_user = {}
    for _, user, _, x in _good():
        by_user.setdefault(user, []).append(x)
    for user, xs in by_user.items():
        if mode == "l2sum":
            want = _l2([sum(c) for c in zip(*map(_l2, xs))])
        else:
            want = _mean(xs)
        if mode == "sumnorm":
            if sum(want) == 0:
                assert user not in got
                continue
            want = [a / sum(want) for a in want]
        _close(got[user], want)


def test_profiles_ignore_partitioning(reviews):
    a = profiles.entity_profiles(reviews.repartition(1), "user_id", "l2sum", 3).collect()
    b = profiles.entity_profiles(reviews.repartition(6), "user_id", "l2sum", 3).collect()
    for x, y in zip(sorted(a), sorted(b)):
        _close(x.profile, y.profile)


def test_blend_keeps_review_ids_and_is_per_pair(reviews):
    rows = {r.review_id: r for r in profiles.blend_reviews(reviews, "mean", 3).collect()}
    assert {"r1", "r2", "r3", "r4", "r5"} <= set(rows)
    users = {1: _mean([ROWS[0][3], ROWS[1][3]])}
    business = _mean([ROWS[0][3], ROWS[2][3], ROWS[4][3]])
    _close(rows["r1"].blended_features, _l2([a * b for a, b in zip(users[1], business)]))
    _close(rows["r1"].normFeatures, _l2(ROWS[0][3]))


def test_hot_keys_do_not_change_the_blend(reviews):
    users = profiles.entity_profiles(reviews, "user_id", "mean", 3)
    shops = profiles.entity_profiles(reviews, "business_id", "mean", 3)
    pairs = reviews.select("user_id", "business_id").distinct()
    hot_users, hot_shops = hot_keys(pairs, ["user_id"], 1), hot_keys(pairs, ["business_id"], 1)
    assert sorted(map(tuple, hot_users.collect())) == [(1, 2), (2, 2)] and hot_shops.count() == 2
    plain = profiles.blend(pairs, users, shops).collect()
    salted = profiles.blend(pairs, users, shops, hot_users=hot_users, hot_businesses=hot_shops).collect()
    key = lambda r: (r.user_id, r.business_id)
    assert len(plain) == 5
    for a, b in zip(sorted(plain, key=key), sorted(salted, key=key)):
        assert key(a) == key(b)
        _close(a.blended_features, b.blended_features)


def test_a_wrong_width_ends_the_job(reviews):
    for k in (2, 4):
        with pytest.raises(Exception, match="components, not"):
            profiles.entity_profiles(reviews, "user_id", "mean", k).collect()
        with pytest.raises(Exception, match="components, not"):
            v.vector_sums(reviews.where("review_id = 'r1'"), ["user_id"], "features", k).collect()


def test_unknown_mode(reviews):
    with pytest.raises(ValueError):
        profiles.entity_profiles(reviews, "user_id", "median", 3)


def test_packed_sums_equal_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i % 7) if i % 11 else None, "a" if i % 2 else "b", [float(x) for x in rng.normal(size=5)] if i % 5 else None) for i in range(200)]
    rows += [(9, "c", None), (8, "c", [1.0, float("nan"), float("inf"), 2.0, 3.0])]
    df = spark.createDataFrame(rows, "g int, h string, x array<double>").repartition(3)
    plain = {(r.g, r.h): (r.x, r.n) for r in v.vector_sums(df, ["g", "h"], "x", 5).collect()}
    monkeypatch.setattr(v, "WIDE", 4)
    packed = v.vector_sums(df, ["g", "h"], "x", 5)
    assert packed.columns == ["g", "h", "x", "n"]
    got = {(r.g, r.h): (r.x, r.n) for r in packed.collect()}
    assert set(got) == set(plain) and got[9, "c"] == ([None] * 5, 0)
    for key, (x, n) in plain.items():
        assert got[key][1] == n
        if n:
            assert np.allclose(got[key][0], x, equal_nan=True)
    assert v.packed_sums(df.limit(0), ["g"], "x", 5).count() == 0


def test_plans_do_not_grow_with_the_width(spark):
    def plan(k):
        df = spark.range(3).select("id", F.array_repeat(F.rand(1), k).alias("x"))
        return v.vector_sums(df, ["id"], "x", k)._jdf.queryExecution().executedPlan().toString()

    assert abs(len(plan(128)) - len(plan(1024))) < 50


@pytest.mark.parametrize("mode", profiles.MODES)
def test_bucketed_blends_equal_plain_ones(spark, mode):
    rng = np.random.default_rng(4)
    rows = [(f"r{i}", 0 if i % 3 == 0 else int(rng.integers(1, 9)), int(rng.integers(0, 5)), [float(x) for x in rng.normal(1, 1, 3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "review_id string, user_id bigint, business_id bigint, features array<double>")
    plain = profiles.blend_reviews(df, mode, 3, 1e-6)
    for rows_per_task in (1_000_000, 10):  # with ten rows a task every user is spread
        got = profiles.blend_bucketed_reviews(df, mode, 3, 1e-6, rows_per_task=rows_per_task)
        assert set(got.columns) == set(plain.columns)
        a, b = ({r.review_id: r for r in x.collect()} for x in (plain, got))
        assert set(a) == set(b)
        for key, row in a.items():
            for c in ("user_features", "business_features", "blended_features"):
                assert np.allclose(row[c], b[key][c])


def test_bucketed_reviews_are_exchanged_once_more_only(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([("r", 1, 2, [1.0, 2.0])], "review_id string, user_id bigint, business_id bigint, features array<double>")
        plan = profiles.blend_bucketed_reviews(df, "l2sum", 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    assert "Bucketed: true" in plan
    # Exchanges: reviews to businesses, and of each kind of profile its partial sums (and users to buckets).
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 4 and sum("business_id" in x for x in exchanges) == 2


@pytest.mark.parametrize("mode", profiles.MODES)
def test_vectors_attached_behind_the_exchange_give_the_same_blends(spark, mode):
    rng = np.random.default_rng(5)
    words = spark.createDataFrame([(i, [float(x) for x in rng.normal(1, 1, 3)]) for i in range(7)], "vec_id bigint, features array<double>")
    rows = [(f"r{i}", 0 if i % 3 == 0 else i % 7, i % 5, i % 8) for i in range(120)]  # number 7 has no vector
    keyed = spark.createDataFrame(rows, "review_id string, user_id bigint, business_id bigint, vec_id bigint")
    attach = lambda df: df.join(F.broadcast(words), "vec_id").drop("vec_id")
    want = {r.review_id: r for r in profiles.blend_reviews(attach(keyed), mode, 3, 1e-6).collect()}
    for rows_per_task in (1_000_000, 10):
        found = profiles.blend_bucketed_reviews(keyed, mode, 3, 1e-6, rows_per_task=rows_per_task, attach=attach)
        got = {r.review_id: r for r in found.collect()}
        assert set(got) == set(want) and set(found.columns) >= {"features", "user_features", "business_features"}
        assert all(np.allclose(row.blended_features, got[key].blended_features) for key, row in want.items())


def test_review_vectors_are_not_exchanged_wide(spark, tmp_path):
    """Embeddings come to the reviews of an entity: neither profile shuffles a row per review with its vector."""
    from revloom.plans import roles

    spark.createDataFrame([(i, [float(i + j) for j in range(64)]) for i in range(5)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(40).selectExpr("id as o_orderkey", "id % 6 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(200).selectExpr(
        "id % 40 as l_orderkey", "id as l_partkey", "id % 9 as l_suppkey", "cast(id as int) as l_linenumber", "1.0D as l_quantity", "current_timestamp() as l_shipdate"
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for by in ("user_id", "business_id"):
        rows = roles.review_vectors(spark, str(tmp_path), by=by)
        plan = profiles.entity_profiles(rows, by, "mean", 64)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("RebalancePartitions")
        assert "strategy=broadcast" in plan
        got = {r[by]: r for r in profiles.entity_profiles(rows, by, "mean", 64).collect()}
        assert len(got) == (6 if by == "user_id" else 9) and sum(r.n for r in got.values()) == 200


def test_packed_sums_of_interleaved_keys_and_nulls(spark):
    rows = [(i % 3, None if i % 5 == 0 else [float(i), None if i % 7 == 0 else 1.0]) for i in range(50)] + [(9, None)]
    df = spark.createDataFrame(rows, "g bigint, x array<double>").repartition(1)
    got = {r.g: (r.x, r.n) for r in v.packed_sums(df, ["g"], "x", 2).collect()}
    for g in (0, 1, 2):
        own = [x for h, x in rows if h == g and x is not None]
        assert got[g] == ([sum(x[0] for x in own), sum(x[1] or 0.0 for x in own)], len(own))
    assert got[9] == ([None, None], 0)


def test_is_finite(spark):
    inf, nan = math.inf, math.nan
    rows = [([1.0, -2.0], True), ([0.0, None], False), ([None, None], False), (None, False)]
    rows += [([x, y], False) for bad in (inf, -inf, nan) for x, y in ((bad, 1.0), (1.0, bad), (bad, None), (bad, bad), (bad, -bad))]
    df = spark.createDataFrame(rows, "x array<double>, want boolean").withColumn("got", v.is_finite("x", 2))
    assert df.where("got is null or got <> want").count() == 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
