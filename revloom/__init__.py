"""Review-based recommendation analytics on Spark DataFrames."""

from revloom.operators.affiliation import detect_communities
from revloom.operators.communities import attach_communities, parse_communities
from revloom.operators.embed import embed_reviews, mean_word_vectors, tokenise_reviews
from revloom.operators.evaluate import combine_predictions, describe, evaluate, regression_metrics
from revloom.operators.geo import geo_outlier_filter, prepare_business
from revloom.operators.index import apply_dictionary, dense_index
from revloom.operators.profiles import blend, blend_pairs, blend_reviews, entity_profiles
from revloom.operators.regression import (
    fit_by_community,
    fit_estimator_by_community,
    fit_predict,
    fit_predict_by_community,
    model_report,
    tuned,
)
from revloom.operators.reviews import enrich_reviews
from revloom.operators.social import active_friend_edges, friend_edges, index_users, rank_users, user_profiles
from revloom.operators.split import chronological_split, hash_split
from revloom.plans.pipeline import Pipeline
from revloom.plans.sweep import sweep

__all__ = [
    "Pipeline",
    "active_friend_edges",
    "apply_dictionary",
    "attach_communities",
    "blend",
    "blend_pairs",
    "blend_reviews",
    "chronological_split",
    "combine_predictions",
    "dense_index",
    "describe",
    "detect_communities",
    "embed_reviews",
    "enrich_reviews",
    "entity_profiles",
    "evaluate",
    "fit_by_community",
    "fit_estimator_by_community",
    "fit_predict",
    "fit_predict_by_community",
    "friend_edges",
    "geo_outlier_filter",
    "hash_split",
    "index_users",
    "mean_word_vectors",
    "model_report",
    "parse_communities",
    "prepare_business",
    "rank_users",
    "regression_metrics",
    "sweep",
    "tokenise_reviews",
    "tuned",
    "user_profiles",
]
