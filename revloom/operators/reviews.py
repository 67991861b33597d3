"""Reviews joined with the activity of their user and business."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def enrich_reviews(
    reviews: DataFrame, users: DataFrame, businesses: DataFrame, min_user: int = 100, min_business: int = 100
) -> DataFrame:
    """Reviews of active users about active businesses, with string ids replaced by numbers.

    The activity filter goes into the dictionary before the join, so each side is joined once.
    """
    active_users = users.where(F.col("review_count") > min_user).select("user_id", "user_id_index")
    active_businesses = businesses.where(F.col("review_count") > min_business).select(
        "business_id", "business_id_index"
    )
    return (
        reviews.join(active_users, "user_id")
        .join(active_businesses, "business_id")
        .select(
            "review_id",
            F.col("user_id_index").alias("user_id"),
            F.col("business_id_index").alias("business_id"),
            "date",
            F.col("stars").alias("label"),
            "text",
            (F.col("useful") + F.col("funny") + F.col("cool")).alias("votes"),
        )
    )
