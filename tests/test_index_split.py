import datetime

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Window, functions as F

from revloom.operators.index import apply_dictionary, dense_index
from revloom.operators.ordering import running_total
from revloom.operators.split import chronological_split, hash_split


def _keys(spark):
    rows = [(f"k{i % 37 if i % 3 else 0}",) for i in range(500)] + [(None,)]
    return spark.createDataFrame(rows, "key string")


def test_dense_index_equals_string_indexer(spark):
    df = _keys(spark)
    labels = StringIndexer(inputCol="key", outputCol="i").fit(df.na.drop()).labels
    got = {r.key: r.idx for r in dense_index(df, "key", partitions=5).collect()}
    assert got == {k: i for i, k in enumerate(labels)}


def test_dense_index_ignores_partitioning(spark):
    df = _keys(spark)
    a = dense_index(df.repartition(1), "key", partitions=2).collect()
    b = dense_index(df.repartition(7), "key", partitions=6).collect()
    assert sorted(a) == sorted(b)


def test_unknown_keys_are_skipped(spark):
    d = spark.createDataFrame([("a", 0)], "key string, idx bigint")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [tuple(r) for r in apply_dictionary(df, d, "x", "i", "key").collect()] == [("a", 0)]


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 4 + 1) for i in range(100)], "k bigint, n bigint")
    got = {r.k: r.before for r in running_total(df, ["k"], "n", "before", 7).collect()}
    total = 0
    for i in range(100):
        assert got[i] == total
        total += i % 4 + 1


def test_hash_split_is_a_stable_partition_of_the_rows(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("review_id"))
    a = {r[0] for r in hash_split(df.repartition(1), ["review_id"]).where("is_train").collect()}
    b = {r[0] for r in hash_split(df.repartition(9), ["review_id"]).where("is_train").collect()}
    test = hash_split(df, ["review_id"]).where(~F.col("is_train")).count()
    assert a == b and len(a) + test == 5000
    assert 3850 < len(a) < 4150


def _reviews(spark, cast):
    start = datetime.datetime(2020, 1, 1)
    # One user holds most rows; one has a single row.
    rows = [(i, 1 if i % 3 else i % 5 + 2, start + datetime.timedelta(days=(i * 7) % 40)) for i in range(600)]
    rows += [(9999, 77, start)]
    return spark.createDataFrame(rows, "id bigint, user_id bigint, t timestamp").withColumn("t", F.col("t").cast(cast))


def test_chronological_split_equals_percent_rank(spark):
    for cast in ("date", "timestamp"):
        df = _reviews(spark, cast)
        for by in (None, "user_id"):
            window = Window.partitionBy(*([by] if by else [])).orderBy("t")
            want = {r[0]: r[1] for r in df.select("id", F.percent_rank().over(window)).collect()}
            got = chronological_split(df, "t", by, partitions=3).collect()
            assert {r.id: r.percent_rank for r in got} == want
            assert all(r.is_train == (r.percent_rank <= 0.8) for r in got)


def test_global_date_split_does_not_shuffle_the_rows(spark):
    """Ranks of dates are broadcast; only their counts are shuffled."""
    df = spark.range(1000).select(F.col("id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("date"))
    out = chronological_split(df, "date")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert out.where("is_train").count() == 800
