"""Profile vectors per user or business, and their blend per (user, business) pair."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from revloom.functions.vectors import (
    divide,
    hadamard,
    is_finite,
    l2_normalise,
    sum_normalise,
    vector_sums,
)
from revloom.operators.mapped import attach_mapped, can_map, write_vectors
from revloom.operators.skew import SALT, SALTS, hot_keys, skew_join
from revloom.session import fits_workers, pin, scratch_path

MODES = ("sumnorm", "l2sum", "mean")
# How each mode normalises the blended vector.
BLEND_NORM = {"sumnorm": "sum", "l2sum": "l2", "mean": "l2"}
# Business profiles of up to so many bytes are sent to every worker: the driver holds them about three times over.
SENT_BYTES = 32_000_000


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")


def entity_profiles(
    vectors: DataFrame, key: str, mode: str, k: int, features: str = "features", min_abs_sum: float = 0.0
) -> DataFrame:
    """``(key, profile, n)``: one vector per entity from its review vectors.

    ``sumnorm``: mean divided by its component sum. ``l2sum``: reviews normalised to length 1,
    summed, normalised again. ``mean``: plain mean. Vectors that hold a null or non-finite number are
    left out; one of another width than ``k`` ends the job.
    """
    _check_mode(mode)
    narrow = vectors.where(is_finite(features, k)).select(key, F.col(features).alias("profile"))
    if mode == "l2sum":
        unit = narrow.withColumn("profile", l2_normalise("profile"))
        return vector_sums(unit, [key], "profile", k).withColumn("profile", l2_normalise("profile"))
    sums = vector_sums(narrow, [key], "profile", k)
    means = sums.withColumn("profile", divide("profile", F.col("n").cast("double")))
    return means if mode == "mean" else sum_normalise(means, "profile", "profile", min_abs_sum)


def blend(
    pairs: DataFrame,
    user_profiles: DataFrame,
    business_profiles: DataFrame,
    norm: str | None = "l2",
    min_abs_sum: float = 0.0,
    hot_users: DataFrame | None = None,
    hot_businesses: DataFrame | None = None,
) -> DataFrame:
    """Add ``user_features``, ``business_features`` and their normalised product to ``pairs``.

    Give distinct pairs where possible: the blend depends on the pair only, and narrow rows are
    what gets shuffled. Users or businesses with very many pairs may be named as hot keys
    (``skew.hot_keys``) to spread them over tasks without adaptive execution.
    """
    users = user_profiles.select("user_id", F.col("profile").alias("user_features"))
    businesses = business_profiles.select("business_id", F.col("profile").alias("business_features"))
    both = skew_join(pairs, users, ["user_id"], hot_users, salt_on=["business_id"])
    return _product(skew_join(both, businesses, ["business_id"], hot_businesses, salt_on=["user_id"]), norm, min_abs_sum)


def _product(both: DataFrame, norm: str | None, min_abs_sum: float) -> DataFrame:
    product = both.withColumn("blended_features", hadamard("user_features", "business_features"))
    if norm is None:
        return product
    if norm == "l2":
        return product.withColumn("blended_features", l2_normalise("blended_features"))
    if norm == "sum":
        return sum_normalise(product, "blended_features", "blended_features", min_abs_sum)
    raise ValueError(f"norm must be 'l2', 'sum' or None, not {norm!r}")


def _with_businesses(rows: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """``rows``, wide by now, with ``business_features``: sent to every worker where they fit, else looked up in a file
    that workers map, else joined by an exchange (also where the session forbids broadcasts)."""
    spark = rows.sparkSession
    if fits_workers(spark, 0, 0):
        profiles = pin(profiles)
    businesses = profiles.select("business_id", F.col("profile").alias("business_features"))
    if fits_workers(spark, 0, 0):
        n = profiles.count()
        if 8 * k * n <= SENT_BYTES:
            businesses = F.broadcast(businesses)
        elif can_map(profiles, "business_id", n, k):
            return attach_mapped(rows, "business_id", write_vectors(profiles, "business_id", "profile", k), "business_features", k)
    return rows.join(businesses, "business_id")


def blend_pairs(
    pairs: DataFrame,
    vectors: DataFrame,
    mode: str,
    k: int,
    min_abs_sum: float = 0.0,
    norm: str | None = "mode",
    by_business: DataFrame | None = None,
) -> DataFrame:
    """``blend`` with both profiles computed from ``vectors`` in the given mode.

    ``by_business`` may give the same rows laid out by business, which hand on fewer sums for business profiles.
    """
    _check_mode(mode)
    shops = vectors if by_business is None else by_business
    users = entity_profiles(vectors, "user_id", mode, k, min_abs_sum=min_abs_sum).select("user_id", F.col("profile").alias("user_features"))
    both = _with_businesses(pairs.join(users, "user_id"), entity_profiles(shops, "business_id", mode, k, min_abs_sum=min_abs_sum), k)
    return _product(both, BLEND_NORM[mode] if norm == "mode" else norm, min_abs_sum)


def blend_reviews(vectors: DataFrame, mode: str, k: int, min_abs_sum: float = 0.0) -> DataFrame:
    """Every review with the profiles and the blend of its pair.

    The L2 modes also give ``normFeatures``, the review vector at length 1.
    """
    pairs = vectors.select("user_id", "business_id").distinct()
    blended = blend_pairs(pairs, vectors, mode, k, min_abs_sum)
    if mode != "sumnorm":
        vectors = vectors.withColumn("normFeatures", l2_normalise("features"))
    return vectors.join(blended, ["user_id", "business_id"])


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, dealt to buckets by ``keys`` and sorted in them.

    Joins and groups by exactly these keys take it as it lies, without an exchange. Another name is taken each time.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    # One file a bucket: each task has one bucket's rows.
    dealt = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    dealt.option("path", scratch_path(spark, "bucketed")).saveAsTable(name, format="parquet")
    return spark.table(name)


def blend_bucketed_reviews(
    vectors: DataFrame,
    mode: str,
    k: int,
    min_abs_sum: float = 0.0,
    buckets: int | None = None,
    rows_per_task: int = 1_000_000,
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """As ``blend_reviews``, with two exchanges of reviews: to the buckets of their users, and to their businesses.

    Profiles are added up where the reviews lie; what is exchanged of them is one row per entity and task. Users with
    more than ``rows_per_task`` reviews are spread over as many buckets as they need. Where vectors are looked up,
    ``vectors`` may hold what they are looked up by and ``attach`` add ``features``: narrow rows are exchanged then.
    """
    _check_mode(mode)
    hot = hot_keys(vectors, ["user_id"], rows_per_task)
    spread = F.pmod(F.xxhash64("review_id"), F.coalesce(F.col(SALTS), F.lit(1)))
    salted = vectors.join(F.broadcast(hot), "user_id", "left").withColumn(SALT, spread.cast("bigint")).drop(SALTS)
    reviews = bucketed(salted, ["user_id", SALT], buckets)
    shops = reviews
    if attach is not None:
        reviews, shops = attach(reviews), attach(reviews.hint("rebalance", "business_id"))
    columns = [c for c in reviews.columns if c != SALT]
    users = entity_profiles(reviews, "user_id", mode, k, min_abs_sum=min_abs_sum).select("user_id", F.col("profile").alias("user_features"))
    salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(SALTS), F.lit(1)) - 1)
    users = users.join(F.broadcast(hot), "user_id", "left").withColumn(SALT, F.explode(salts)).drop(SALTS)
    businesses = entity_profiles(shops, "business_id", mode, k, min_abs_sum=min_abs_sum)
    both = _with_businesses(reviews.join(users, ["user_id", SALT]), businesses, k)
    both = both.withColumn("blended_features", hadamard("user_features", "business_features"))
    if mode == "sumnorm":
        both = sum_normalise(both, "blended_features", "blended_features", min_abs_sum)
        own = []
    else:
        both = both.withColumn("blended_features", l2_normalise("blended_features"))
        own = [l2_normalise("features").alias("normFeatures")]
    first = ["user_id", "business_id"]
    return both.select(*first, *[c for c in columns if c not in first], *own, "user_features", "business_features", "blended_features")
