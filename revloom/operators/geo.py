"""Businesses: complete records, dense numbers, removal of geographic outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revloom.operators.index import apply_dictionary, dense_index
from revloom.operators.relational import complete_cases, not_empty


def centroid_distance(
    df: DataFrame, group: str = "state", lat: str = "latitude", lon: str = "longitude", out: str = "dist"
) -> DataFrame:
    """Add the distance in degrees to the group's average position; rows without a group drop out.

    The averages are combined before the shuffle and joined back. A window over the group would
    give the same numbers but put a whole group in one task.
    """
    centroids = df.groupBy(group).agg(F.avg(lat).alias("__lat"), F.avg(lon).alias("__lon"))
    dist = F.sqrt(F.pow(F.col(lat) - F.col("__lat"), 2) + F.pow(F.col(lon) - F.col("__lon"), 2))
    return df.join(centroids, group).withColumn(out, dist).drop("__lat", "__lon")


def geo_outlier_filter(
    df: DataFrame,
    group: str = "state",
    lat: str = "latitude",
    lon: str = "longitude",
    max_dist: float = 10.0,
) -> DataFrame:
    """Rows nearer than ``max_dist`` degrees to the centroid of their group."""
    near = centroid_distance(df, group, lat, lon, "__dist").where(F.col("__dist") < max_dist)
    return near.select(*df.columns)


def prepare_business(businesses: DataFrame, group: str = "state", max_dist: float = 10.0) -> DataFrame:
    """Complete records with a city, numbered by ``business_id_index``, without outliers.

    The number is given over all complete records, outliers included.
    """
    whole = complete_cases(businesses.where(not_empty("city")))
    dictionary = dense_index(whole, "business_id")
    indexed = apply_dictionary(whole, dictionary, "business_id", "business_id_index", "business_id")
    return geo_outlier_filter(indexed, group, "latitude", "longitude", max_dist).select(
        "business_id",
        "business_id_index",
        "name",
        "city",
        "state",
        "latitude",
        "longitude",
        "stars",
        "review_count",
        "is_open",
        "categories",
        "attributes",
    )
