import datetime

import pytest
from pyspark.sql import functions as F

from revloom.operators import geo, social
from revloom.operators.reviews import enrich_reviews
from revloom.sources.schemas import COMPLIMENTS


@pytest.fixture(scope="module")
def users(spark):
    rows = [
        ("a", 5, ["b", "c", "b", "nobody"], "2019-12-22", ["2018", "2019"], 1),
        ("b", 30, ["a"], "2019-01-01", [], 2),
        ("c", 40, [], "2019-01-01", None, 2),
        ("d", 50, ["nobody"], "2019-01-01", ["2019"], 9),
    ]
    df = spark.createDataFrame(
        rows, "user_id string, review_count bigint, friends array<string>, yelping_since string, elite array<string>, x bigint"
    )
    df = df.withColumns({c: F.col("x") for c in COMPLIMENTS}).withColumns(
        {"name": F.col("user_id"), "fans": F.lit(0).cast("bigint"), "average_stars": F.lit(3.0)}
    )
    return social.index_users(df)


def _ids(users):
    return {r.user_id: r.user_id_index for r in users.collect()}


def test_friend_edges_skip_unknown_and_keep_repeats(users):
    i = _ids(users)
    got = sorted(tuple(r) for r in social.friend_edges(users).collect())
    assert got == sorted([(i["a"], i["b"]), (i["a"], i["c"]), (i["a"], i["b"]), (i["b"], i["a"])])


def test_profiles_and_ranking(users):
    edges = social.friend_edges(users)
    rows = {r.user_id: r for r in social.user_profiles(users, edges, datetime.date(2020, 1, 1)).collect()}
    i = _ids(users)
    assert set(rows) == {"a", "b"}
    assert rows["a"].friends_index == sorted([i["b"], i["c"]])
    assert rows["a"].num_of_friends == 4 and rows["a"].yelping_since == 10 and rows["a"].elite == 2
    assert rows["a"].total_compliments == 11
    every = social.user_profiles(users, edges, "2020-01-01", keep_isolated=True, weights={"compliment_funny": 2})
    assert {r.user_id: r.total_compliments for r in every.collect()} == {"a": 12, "b": 24, "c": 24, "d": 108}
    assert [r.user_id for r in social.rank_users(every).collect()] == ["d", "c", "b", "a"]
    assert [r.user_id for r in social.rank_users(every, 2).collect()] == ["d", "c"]


def test_only_the_source_of_an_edge_must_be_active(users):
    rows = social.user_profiles(users, social.friend_edges(users), "2020-01-01")
    i = _ids(users)
    got = [tuple(r) for r in social.active_friend_edges(rows, 20).collect()]
    assert got == [(i["b"], i["a"])]


def test_geo_outliers_with_one_hot_group(spark):
    near = [(f"n{i}", "x", 10.0 + i % 2, 20.0) for i in range(60)]
    rows = near + [("far", "x", 80.0, 20.0), ("alone", "y", 1.0, 1.0), ("null", None, 1.0, 1.0), ("nolat", "y", None, 1.0)]
    df = spark.createDataFrame(rows, "business_id string, state string, latitude double, longitude double")
    got = {r.business_id for r in geo.geo_outlier_filter(df).collect()}
    assert got == {r[0] for r in near} | {"alone"}


def test_prepare_business(spark):
    rows = [
        ("b2", "n", "city", "s", 1.0, 1.0, 3.0, 5, 1, "c", {"k": "v"}),
        ("b1", "n", "", "s", 1.0, 1.0, 3.0, 5, 1, "c", {"k": "v"}),
        ("b0", "n", "city", "s", None, 1.0, 3.0, 5, 1, "c", {"k": "v"}),
        ("b3", "n", "city", "s", 1.0, 1.0, 3.0, 5, 1, "c", {"k": "v"}),
    ]
    schema = (
        "business_id string, name string, city string, state string, latitude double, longitude double, "
        "stars double, review_count bigint, is_open bigint, categories string, attributes map<string,string>"
    )
    got = geo.prepare_business(spark.createDataFrame(rows, schema))
    assert sorted((r.business_id, r.business_id_index) for r in got.collect()) == [("b2", 0), ("b3", 1)]


def test_enrich_reviews(spark):
    reviews = spark.createDataFrame(
        [
            ("r1", "u1", "b1", 4, "2020-01-01", "t", 1, 2, 3),
            ("r2", "u2", "b1", 4, "2020-01-01", "t", 1, 2, 3),
            ("r3", "u1", "b2", 4, "2020-01-01", "t", 1, 2, 3),
            ("r4", "ux", "b1", 4, "2020-01-01", "t", 1, 2, 3),
            ("r5", "u1", "b1", 2, "2020-01-01", "t", None, 2, 3),
        ],
        "review_id string, user_id string, business_id string, stars bigint, date string, text string, "
        "useful bigint, funny bigint, cool bigint",
    )
    users = spark.createDataFrame([("u1", 7, 101), ("u2", 8, 100)], "user_id string, user_id_index bigint, review_count bigint")
    shops = spark.createDataFrame([("b1", 1, 500), ("b2", 2, 9)], "business_id string, business_id_index bigint, review_count bigint")
    got = sorted((r.review_id, r.user_id, r.business_id, r.label, r.votes) for r in enrich_reviews(reviews, users, shops).collect())
    assert got == [("r1", 7, 1, 4, 6), ("r5", 7, 1, 2, None)]
