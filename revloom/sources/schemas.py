"""Schemas of the raw record files, given explicitly so that no pass is spent on inference."""

from __future__ import annotations

# The compliment counters of a user record.
COMPLIMENTS = (
    "compliment_writer",
    "compliment_profile",
    "compliment_plain",
    "compliment_photos",
    "compliment_note",
    "compliment_more",
    "compliment_list",
    "compliment_hot",
    "compliment_funny",
    "compliment_cute",
    "compliment_cool",
)

REVIEW = (
    "review_id string, user_id string, business_id string, stars bigint, date string, "
    "text string, useful bigint, funny bigint, cool bigint"
)

BUSINESS = (
    "business_id string, name string, city string, state string, latitude double, "
    "longitude double, stars double, review_count bigint, is_open bigint, categories string, "
    "attributes map<string,string>"
)

USER = (
    "user_id string, name string, review_count bigint, friends array<string>, "
    "yelping_since string, fans bigint, elite array<string>, average_stars double, "
    + ", ".join(f"{c} bigint" for c in COMPLIMENTS)
)
