"""Driver tables in the roles of users, businesses, reviews, friends and texts.

user = customer, business = supplier, review = line item with its order. Every mapping is
row-local or a join on a key, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revloom.functions.vectors import of_width
from revloom.operators import social
from revloom.session import fits_workers, parts_of, pin
from revloom.sources.schemas import COMPLIMENTS

REVIEW_KEY = ["review_id"]
WIDTH = 64  # numbers of an embedding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_name(number: Column) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(number.cast("string"), 9, "0"))


def supplier_name(number: Column) -> Column:
    return F.concat(F.lit("Supplier#"), F.lpad(number.cast("string"), 9, "0"))


def _lines(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    # By the key of the join: a file that cannot be split is one task only up to here.
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.repartition(parts, "l_orderkey") if parts else lines.repartition("l_orderkey")
    orders = table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _review_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as in the record file: string ids, stars, text, vote counters."""
    return _lines(spark, sf_dir).select(
        _review_id().alias("review_id"),
        customer_name(F.col("o_custkey")).alias("user_id"),
        supplier_name(F.col("l_suppkey")).alias("business_id"),
        (F.lit(1) + F.col("l_quantity").cast("bigint") % 5).cast("bigint").alias("stars"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus", "o_orderpriority").alias("text"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("useful"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("funny"),
        F.col("l_linenumber").cast("bigint").alias("cool"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with numbers for ids; ``part_id`` is what the vector is looked up by."""
    return _lines(spark, sf_dir).select(
        _review_id().alias("review_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_suppkey").alias("business_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.lit(1) + F.col("l_quantity").cast("bigint") % 5).cast("bigint").alias("label"),
        F.col("l_partkey").alias("part_id"),
    )


def review_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with ``vec_id`` in place of the part: what ``attach_vectors`` takes."""
    size = table(spark, sf_dir, "embeddings").count()
    return reviews(spark, sf_dir).withColumn("vec_id", F.col("part_id") % F.lit(size)).drop("part_id")


def attach_vectors(keyed: DataFrame, sf_dir: str, k: int = 64) -> DataFrame:
    """``features`` in place of ``vec_id``. Embeddings are sent to the reviews, as they are stored, where they fit.

    All ``WIDTH`` numbers count: for a smaller ``k`` number ``j`` is the sum of those whose place is
    ``j`` modulo ``k``.
    """
    spark = keyed.sparkSession
    embeddings = table(spark, sf_dir, "embeddings")
    kind = embeddings.schema["embedding"].dataType
    wide = embeddings.select("vec_id", of_width("embedding", WIDTH, kind).alias("features"))
    if k < WIDTH:
        x = wide.select("vec_id", F.col("features").cast("array<double>").alias("x"))
        bins = [sum(F.get("x", F.lit(i)) for i in range(j, WIDTH, k)) for j in range(k)]
        wide = x.select("vec_id", F.array(*bins).alias("features"))
    if fits_workers(spark, embeddings.count(), 8 * k if k < WIDTH else 4 * k):
        wide = F.broadcast(wide)
    return keyed.join(wide, "vec_id").drop("vec_id").withColumn("features", F.col("features").cast("array<double>"))


def review_vectors(spark: SparkSession, sf_dir: str, k: int = 64, by: str = "user_id", keep: bool = False) -> DataFrame:
    """Reviews with ``features``: an embedding chosen by the part.

    Reviews are laid out by ``by`` while they are narrow, so that a task has all reviews of an entity (or a share of a
    large one's) and hands on few sums. ``keep`` writes them as they are laid out, without vectors, for readers that
    come more than once.
    """
    keyed = review_keys(spark, sf_dir).hint("rebalance", by)
    return attach_vectors(pin(keyed) if keep else keyed, sf_dir, k)


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers; the position is made of balance and key, the state is the nation."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("review_count"))
    return (
        table(spark, sf_dir, "supplier")
        .join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .select(
            F.col("s_name").alias("business_id"),
            F.col("s_suppkey").alias("business_id_index"),
            F.coalesce("review_count", F.lit(0)).alias("review_count"),
        )
    )


def business_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("business_id"),
        F.col("s_nationkey").cast("bigint").alias("state"),
        (F.col("s_acctbal") / 1000.0).alias("latitude"),
        (F.col("s_suppkey") % 90).cast("double").alias("longitude"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with counters over their orders and three friend ids, some of them unknown."""
    o = table(spark, sf_dir, "orders")
    counted = [
        F.col("o_orderpriority") == "1-URGENT",
        F.col("o_orderpriority") == "2-HIGH",
        F.col("o_orderpriority") == "3-MEDIUM",
        F.col("o_orderpriority") == "4-NOT SPECIFIED",
        F.col("o_orderpriority") == "5-LOW",
        F.col("o_orderstatus") == "F",
        F.col("o_orderstatus") == "O",
        F.col("o_orderstatus") == "P",
        F.col("o_totalprice") < 100000,
        F.col("o_totalprice") > 400000,
        F.col("o_orderkey") % 2 == 0,
    ]
    per_user = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.min("o_orderdate").cast("date").alias("yelping_since"),
        F.count_if(F.col("o_totalprice") > 250000).alias("fans"),
        F.array_sort(F.collect_set(F.year("o_orderdate"))).cast("array<string>").alias("elite"),
        F.array(
            *[
                customer_name(x)
                for x in (F.min("o_orderkey"), F.max("o_orderkey"), F.sum("o_orderkey") % 2000)
            ]
        ).alias("friends"),
        (F.sum(F.col("o_orderkey") % 5 + 1) / F.count(F.lit(1))).alias("average_stars"),
        *[F.count_if(cond).alias(name) for name, cond in zip(COMPLIMENTS, counted)],
    )
    return (
        table(spark, sf_dir, "customer")
        .join(per_user, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            F.col("c_name").alias("user_id"),
            F.col("c_custkey").alias("user_id_index"),
            F.col("c_name").alias("name"),
            *[c for c in per_user.columns if c != "o_custkey"],
        )
    )


def user_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("user_id"), F.col("c_custkey").alias("user_id_index")
    )


def friend_links(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """``(src, friend_id)``: the customer of each line and the customer numbered like its part.

    Parts beyond the last customer are friends nobody knows. Lines and orders are joined in ``parts`` parts.
    """
    return _lines(spark, sf_dir, parts).select(
        F.col("o_custkey").alias("src"), customer_name(F.col("l_partkey")).alias("friend_id")
    )


def known_links(spark: SparkSession, sf_dir: str, users: DataFrame) -> DataFrame:
    """``(src, dst)`` numbers of the friend links to ``users``."""
    parts = parts_of(spark, table(spark, sf_dir, "lineitem").count())
    return social.map_friends(friend_links(spark, sf_dir, parts), users, hashed=parts is not None)


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping communities per customer: nation, region of the nation, market segment."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    segment = F.instr(F.lit("ABFHM"), F.substring("c_mktsegment", 1, 1))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("c_custkey").alias("user_id"),
        F.explode(
            F.array(
                F.col("c_nationkey").cast("bigint"),
                (F.lit(25) + F.col("n_regionkey")).cast("bigint"),
                (F.lit(30) + segment).cast("bigint"),
            )
        ).alias("community_id"),
    )


def region_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One community per customer: the region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("c_custkey").alias("user_id"), F.col("n_regionkey").cast("bigint").alias("community_id")
    )


def community_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line_id, value)``: one short community per order, numbers split by tabs, a cell that is none, empty tail."""
    o = table(spark, sf_dir, "orders").repartition("o_orderkey")
    return o.select(
        F.col("o_orderkey").alias("line_id"),
        F.concat(
            F.col("o_custkey").cast("string"),
            F.lit("\t "),
            (F.col("o_orderkey") % 997).cast("string"),
            F.lit("\t"),
            F.year("o_orderdate").cast("string"),
            # A number that double cannot hold, and a cell that is none.
            F.lit(".0\t9007199254740993\tnan\t"),
        ).alias("value"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
