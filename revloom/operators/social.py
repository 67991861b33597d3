"""Users: friendship edges, profiles, ranking."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from revloom.operators.ordering import number_rows
from revloom.operators.index import apply_dictionary, dense_index
from revloom.sources.schemas import COMPLIMENTS


def index_users(users: DataFrame) -> DataFrame:
    """Add ``user_id_index``, the dense number of ``user_id``."""
    return apply_dictionary(users, dense_index(users, "user_id"), "user_id", "user_id_index", "user_id")


def friend_edges(users: DataFrame, friends: str = "friends") -> DataFrame:
    """``(src, dst)`` numbers from indexed users with an array of friend ids.

    Friends who are not users are skipped; a friend listed twice stays twice.
    """
    long = users.select(F.col("user_id_index").alias("src"), F.explode(friends).alias("friend_id"))
    return map_friends(long, users)


def map_friends(links: DataFrame, users: DataFrame, hashed: bool = False) -> DataFrame:
    """``(src, dst)`` from links ``(src, friend_id)`` whose far end is still a string id.

    ``hashed`` is for many links: they pass the tasks' shares of the users, held as tables, and are not sorted.
    """
    dictionary = users.select("user_id", "user_id_index")
    if hashed:
        dictionary = dictionary.hint("shuffle_hash")
    return apply_dictionary(links, dictionary, "friend_id", "dst", "user_id", "user_id_index").select(
        "src", "dst"
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """``(user_id_index, friends_index)``: the set of known friends, in number order.

    One array per user, no longer than the friend list on that user's own record.
    """
    return (
        edges.groupBy(F.col("src").alias("user_id_index"))
        .agg(F.collect_set("dst").alias("friends_index"))
        .withColumn("friends_index", F.sort_array("friends_index"))
    )


def known_friends(edges: DataFrame) -> DataFrame:
    """``(user_id_index, known_friends)``: how many different known friends, without the array."""
    return (
        edges.distinct()
        .groupBy(F.col("src").alias("user_id_index"))
        .agg(F.count(F.lit(1)).alias("known_friends"))
    )


def compliment_sum(weights: Mapping[str, int] | None = None) -> Column:
    """Weighted sum of the compliment counters, each once unless ``weights`` says otherwise."""
    weights = weights or {}
    return reduce(add, (F.col(c) * F.lit(int(weights.get(c, 1))) for c in COMPLIMENTS))


def user_profiles(
    users: DataFrame,
    edges: DataFrame,
    as_of: date | str,
    keep_isolated: bool = False,
    weights: Mapping[str, int] | None = None,
    with_adjacency: bool = True,
) -> DataFrame:
    """One row per user with tenure in days at ``as_of``, counts, total compliments and friends.

    ``with_adjacency`` gives the array ``friends_index``, otherwise the number ``known_friends``.
    Users without a known friend are left out unless ``keep_isolated``.
    """
    friends = adjacency(edges) if with_adjacency else known_friends(edges)
    last = "friends_index" if with_adjacency else "known_friends"
    joined = users.join(friends, "user_id_index", "left" if keep_isolated else "inner")
    return joined.select(
        "user_id",
        "user_id_index",
        "review_count",
        "name",
        "friends",
        F.size("friends").cast("bigint").alias("num_of_friends"),
        F.datediff(F.lit(str(as_of)).cast("date"), F.col("yelping_since").cast("date"))
        .cast("bigint")
        .alias("yelping_since"),
        "fans",
        F.size("elite").cast("bigint").alias("elite"),
        compliment_sum(weights).alias("total_compliments"),
        "average_stars",
        last,
    )


def rank_users(profiles: DataFrame, k: int | None = None) -> DataFrame:
    """Most complimented users first, then most reviews, then id; only the first ``k`` if given."""
    ranked = profiles.orderBy(F.desc("total_compliments"), F.desc("review_count"), "user_id")
    return ranked.limit(k) if k is not None else ranked


def number_users(profiles: DataFrame, out: str = "rank") -> DataFrame:
    """The users with their place in the order of ``rank_users``, from 1: an order that a table keeps."""
    order = [F.desc("total_compliments"), F.desc("review_count"), F.asc("user_id")]
    return number_rows(profiles, order, out, start=1)


def active_friend_edges(profiles: DataFrame, min_reviews: int) -> DataFrame:
    """Edges of users with more than ``min_reviews`` reviews; the far end is not filtered."""
    return profiles.where(F.col("review_count") > min_reviews).select(
        F.col("user_id_index").alias("src"), F.explode("friends_index").alias("dst")
    )
