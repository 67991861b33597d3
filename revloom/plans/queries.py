"""Registered queries over the driver tables. Each takes ``(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from revloom import sources
from revloom.functions.vectors import components, l2_norm, total
from revloom.operators import affiliation, communities, cooccurrence, embed, evaluate, forests, geo, index, linear, profiles, regression, social, split
from revloom.operators.relational import complete_cases, not_empty, rename
from revloom.operators.reviews import enrich_reviews
from revloom.plans import roles
from revloom.plans.sweep import RIDGE, sweep
from revloom.session import fits_workers, free_shuffles, pin, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

K = 64
AS_OF = "2020-01-01"
MIN_USER = 8
MIN_BUSINESS = 590
# Too close to zero to divide by: the quotient would be decided by rounding.
MIN_ABS_SUM = 1e-6
# So many reviews of pairs are summed in one task.
REVIEWS_PER_PART = 250_000
# Where the trees of one split may split.
CUTS = [-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0]
# Words the text queries leave out.
STOP_WORDS = "the and of in to is de la le et und der die das que los les".split()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _long(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("profile").alias("pos", "value")).select(
        key, F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


def _split_vectors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Split reviews with vectors; narrow rows are written first, as most models read them several times."""
    return split.hash_split(roles.review_vectors(spark, sf_dir, k, keep=True), roles.REVIEW_KEY)


def _split_layouts(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """Split reviews, written once without vectors: as they are, with vectors, and with vectors by user and by business."""
    keyed = split.hash_split(roles.review_keys(spark, sf_dir), roles.REVIEW_KEY)
    keyed = pin(keyed.select("review_id", "user_id", "business_id", "label", "vec_id", "is_train"), "zstd")
    free_shuffles(spark)
    by_user, by_business = (roles.attach_vectors(keyed.hint("rebalance", by), sf_dir, k) for by in ("user_id", "business_id"))
    return keyed, roles.attach_vectors(keyed, sf_dir, k), (by_user, by_business)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.reviews(spark, sf_dir).select("user_id", "business_id").distinct()


def _pair_sums(df: DataFrame) -> DataFrame:
    return df.select(
        "user_id", "business_id", "label", F.round("prediction", 6).alias("prediction"), "num_of_reviews"
    )


# --- preparation --------------------------------------------------------------------------------


@query
def q01_enriched_reviews(spark, sf_dir):
    return enrich_reviews(
        roles.raw_reviews(spark, sf_dir),
        roles.users(spark, sf_dir).select("user_id", "user_id_index", "review_count"),
        roles.businesses(spark, sf_dir),
        MIN_USER,
        MIN_BUSINESS,
    )


@query
def q02_pair_average(spark, sf_dir):
    sums = roles.reviews(spark, sf_dir).groupBy("user_id", "business_id").agg(
        F.sum("label").alias("label"), F.count(F.lit(1)).alias("num_of_reviews")
    )
    return sums.withColumn("avg_label", F.round(F.col("label") / F.col("num_of_reviews"), 6))


@query
def q03_geo_outliers(spark, sf_dir):
    return geo.geo_outlier_filter(roles.business_positions(spark, sf_dir)).select("business_id", "state")


@query
def q04_complete_cases(spark, sf_dir):
    orders = roles.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("city"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
    )
    return complete_cases(orders.where(not_empty("city")))


@query
def q05_dense_index(spark, sf_dir):
    keys = roles.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"))
    return index.dense_index(keys, "key")


@query
def q06_known_dictionary(spark, sf_dir):
    edges = roles.known_links(spark, sf_dir, roles.user_dictionary(spark, sf_dir))
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query
def q07_friend_edges(spark, sf_dir):
    users = roles.users(spark, sf_dir)
    edges = social.friend_edges(users)
    rows = social.user_profiles(users, edges, AS_OF)
    return social.active_friend_edges(rows, MIN_USER)


@query
def q08_user_profile(spark, sf_dir):
    users = roles.users(spark, sf_dir)
    edges = roles.known_links(spark, sf_dir, users)
    rows = social.user_profiles(users, edges, AS_OF, with_adjacency=False)
    return rows.drop("friends").withColumn("average_stars", F.round("average_stars", 6))


@query
def q09_top_users(spark, sf_dir):
    users = roles.users(spark, sf_dir)
    return social.rank_users(_user_totals(users), 100)


def _user_totals(users: DataFrame) -> DataFrame:
    return users.select("user_id", "review_count", social.compliment_sum().alias("total_compliments"))


# --- text ---------------------------------------------------------------------------------------


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, written once: cleaning costs more than reading them back."""
    docs = embed.tokenise_reviews(roles.documents(spark, sf_dir), "text", STOP_WORDS)
    tokens = pin(docs.select("doc_id", "words"))
    free_shuffles(spark)
    return tokens


@query
def q10_clean_text(spark, sf_dir):
    return embed.clean_column(roles.documents(spark, sf_dir), "text", STOP_WORDS).select("doc_id", "clean_text")


@query
def q11_token_counts(spark, sf_dir):
    return embed.token_counts(embed.tokenise_reviews(roles.documents(spark, sf_dir), "text", STOP_WORDS))


# --- profiles and blends ------------------------------------------------------------------------


@query
def q12_profile_sumnorm(spark, sf_dir):
    vectors = roles.review_vectors(spark, sf_dir)
    rows = profiles.entity_profiles(vectors, "user_id", "sumnorm", K, min_abs_sum=MIN_ABS_SUM)
    return _long(rows, "user_id")


@query
def q13_profile_l2sum(spark, sf_dir):
    return _long(
        profiles.entity_profiles(roles.review_vectors(spark, sf_dir), "user_id", "l2sum", K), "user_id"
    )


@query
def q14_profile_mean(spark, sf_dir):
    return _long(
        profiles.entity_profiles(roles.review_vectors(spark, sf_dir, by="business_id"), "business_id", "mean", K), "business_id"
    )


def _blend(spark: SparkSession, sf_dir: str, mode: str, min_abs_sum: float, digits: int) -> DataFrame:
    """One row per pair: first component and position-weighted sum of the blend."""
    vectors = roles.review_vectors(spark, sf_dir)
    by_business = roles.review_vectors(spark, sf_dir, by="business_id")
    rows = profiles.blend_pairs(_pairs(spark, sf_dir), vectors, mode, K, min_abs_sum, by_business=by_business)
    first = F.get("blended_features", F.lit(0))
    weighted = total(F.transform("blended_features", lambda x, i: x * (i + 1)))
    return rows.select(
        "user_id",
        "business_id",
        F.round(first, digits).alias("first"),
        F.round(weighted, digits).alias("weighted"),
    )


@query
def q15_blend_v1(spark, sf_dir):
    return _blend(spark, sf_dir, "sumnorm", MIN_ABS_SUM, 3)


@query
def q16_blend_v2(spark, sf_dir):
    return _blend(spark, sf_dir, "l2sum", 0.0, 6)


@query
def q17_blend_v3(spark, sf_dir):
    return _blend(spark, sf_dir, "mean", 0.0, 6)


# --- splits -------------------------------------------------------------------------------------


@query
def q18_hash_split(spark, sf_dir):
    rows = roles.reviews(spark, sf_dir)
    return split.hash_split(rows, roles.REVIEW_KEY).select("review_id", "is_train")


@query
def q19_date_split_global(spark, sf_dir):
    rows = split.chronological_split(roles.reviews(spark, sf_dir), "date")
    return _rounded(rows.select("review_id", "percent_rank", "is_train"), 9, "percent_rank")


@query
def q20_date_split_user(spark, sf_dir):
    rows = split.chronological_split(roles.reviews(spark, sf_dir), "date", by="user_id")
    return _rounded(rows.select("review_id", "percent_rank", "is_train"), 9, "percent_rank")


# --- communities --------------------------------------------------------------------------------


@query
def q21_parse_communities(spark, sf_dir):
    return communities.parse_communities(roles.community_lines(spark, sf_dir), "value", "line_id")


@query
def q22_attach_communities(spark, sf_dir):
    reviews = roles.reviews(spark, sf_dir).select("review_id", "user_id")
    return communities.attach_communities(reviews, roles.membership(spark, sf_dir))


# --- models -------------------------------------------------------------------------------------


@query
def q23_lr_predict(spark, sf_dir):
    scored, _ = regression.fit_predict(
        _split_vectors(spark, sf_dir, 1), regression.linear_regression(0.0), 1, "mean", norm=None
    )
    return _pair_sums(scored)


@query
def q24_lr_by_community(spark, sf_dir):
    scored, _ = regression.fit_predict_by_community(
        _split_vectors(spark, sf_dir, 1), roles.membership(spark, sf_dir), 1, 0.0, "mean", norm=None
    )
    return _rounded(evaluate.combine_predictions(scored), 6, "prediction", "avg_label", "avg_prediction")


@query
def q25_combine_predictions(spark, sf_dir):
    # Reviews are summed per pair before they are repeated per community; a pair stays in its part in all sums.
    reviews = roles.reviews(spark, sf_dir)
    parts = max(spark.sparkContext.defaultParallelism, -(-roles.table(spark, sf_dir, "lineitem").count() // REVIEWS_PER_PART))
    pairs = regression.test_pairs(reviews.repartition(parts, *evaluate.PAIR))
    shift = F.col("community_id") % 3 / 4.0
    membership = roles.membership(spark, sf_dir)
    if fits_workers(spark, 3 * roles.table(spark, sf_dir, "customer").count(), 32):
        membership = F.broadcast(membership)
    predicted = pairs.join(membership, "user_id").select(
        "user_id",
        "business_id",
        "community_id",
        "label",
        (F.col("label") + F.col("num_of_reviews") * shift).alias("prediction"),
        "num_of_reviews",
    )
    odd = evaluate.sum_pairs(predicted.where(F.col("community_id") % 2 == 1))
    even = evaluate.sum_pairs(predicted.where(F.col("community_id") % 2 == 0))
    return _rounded(evaluate.combine_predictions(odd, even), 6, "avg_label", "avg_prediction")


@query
def q26_metrics(spark, sf_dir):
    nation = roles.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("bigint").alias("nation")
    )
    rows = roles.reviews(spark, sf_dir).join(nation, "user_id")
    predicted = rows.withColumn("prediction", 1.0 + F.col("part_id") % 17 / 4.0)
    metrics = evaluate.regression_metrics(predicted, ["nation"], "label", "prediction")
    return _rounded(metrics, 6, "rmse", "r2", "mae")


@query
def q27_describe(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return _rounded(evaluate.describe(roles.table(spark, sf_dir, "lineitem"), cols), 4, "value")


@query
def q54_forest_report(spark, sf_dir):
    """What a forest's report adds up to: importances, tree weights, parameters."""
    train = _split_vectors(spark, sf_dir, K).where("is_train")
    model = regression.fit(train, regression.random_forest(5, 4), K, keep=False)
    rows = regression.model_report(spark, model, "rf")
    named = rows.where(F.col("parameter").isin("feature_importance", "tree_weight", "maxDepth", "numTrees", "impurity"))
    return named.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("text").alias("text")
    )


@query
def q55_partitioned_table(spark, sf_dir):
    """A table written by label and read back through its partitions, twice over the same folder."""
    path = scratch_path(spark, "by-label")
    reviews = roles.reviews(spark, sf_dir)
    sources.write_table(reviews, path, ["label"])
    sources.write_table(reviews, path, ["label"])
    rows = sources.read_table(spark, path).where(F.col("label") > 2)
    return rows.groupBy(F.col("label").cast("bigint").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("part_id").alias("parts")
    )


@query
def q56_ingest_partitions(spark, sf_dir):
    """Reviews spread on ingest: the same rows in as many parts as asked for."""
    path = scratch_path(spark, "reviews-json")
    roles.raw_reviews(spark, sf_dir).write.json(path)
    rows = sources.read_reviews(spark, path, partitions=7)
    parts = rows.groupBy(F.spark_partition_id().alias("part"), "stars").agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy("stars").agg(F.sum("n").alias("n"), F.countDistinct("part").alias("parts"))


@query
def q57_embed_reviews(spark, sf_dir):
    """The whole way from text to vectors."""
    docs = roles.documents(spark, sf_dir)
    embedded, model = embed.embed_reviews(docs, 16, "text", STOP_WORDS)
    embedded = pin(embedded.select("doc_id", "words", "features"))
    return _embedded(embedded, model, embedded, 16)


def _embedded(tokens: DataFrame, model, embedded: DataFrame, k: int) -> DataFrame:
    """What can be said of trained vectors beforehand.

    The number of words and of known words of each document, whether its vector is zero, and how far
    the model's own mean is from the mean of word vectors by join.
    """
    vectors = model.getVectors().select("word", vector_to_array("vector").alias("vector"))
    joined = embed.mean_word_vectors(tokens, "doc_id", vectors, k).select("doc_id", F.col("features").alias("mean"))
    counts = _known_counts(tokens, vectors)
    rows = embedded.select("doc_id", "features").join(joined, "doc_id").join(counts, "doc_id")
    gap = F.zip_with("features", "mean", lambda x, y: x - y)
    return rows.select(
        "doc_id", "n_words", "n_known", (l2_norm("features") == 0).alias("is_zero"), F.round(l2_norm(gap), 5).alias("gap")
    )


def _known_counts(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_known)``; the words that have vectors come to the documents where they fit."""
    known = vectors.select("word", F.lit(1).alias("known"))
    if fits_workers(tokens.sparkSession, known.count(), 64):
        known = F.broadcast(known)
    words = tokens.select("doc_id", F.explode_outer("words").alias("word")).join(known, "word", "left")
    return words.groupBy("doc_id").agg(F.count("word").alias("n_words"), F.count("known").alias("n_known"))


@query
def q28_word2vec(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    model = embed.fit_word2vec(tokens, embed.word2vec(20))
    return _embedded(tokens, model, embed.arrays(model.transform(tokens), "features"), 20)


def _forest_pairs(spark: SparkSession, sf_dir: str, membership: DataFrame | None = None) -> DataFrame:
    """Pair sums of a forest of 20 trees of depth 10, over all rows or per community.

    Reviews are written, and exchanged to users, businesses and communities, without their vectors.
    """
    keyed, vectors, layouts = _split_layouts(spark, sf_dir, K)
    dealt = None
    if membership is not None:
        members = membership.select("user_id", F.col("community_id").cast("bigint")).distinct()
        dealt = keyed.where("is_train").withColumn("h", F.xxhash64(*roles.REVIEW_KEY)).join(members, "user_id")
        dealt = dealt.select("community_id", "h", "label", "vec_id", "is_train").hint("rebalance", "community_id")
        dealt = regression.training_rows(roles.attach_vectors(dealt, sf_dir, K), "l2sum")
    nodes = forests.fit_forests(regression.training_rows(vectors, "l2sum"), K, forests.Forest(), dealt=dealt)
    return forests.score_forests(regression.blended_test(vectors, "l2sum", K, layouts=layouts, membership=membership), nodes)


@query
def q29_rf_predict(spark, sf_dir):
    return _forest_pairs(spark, sf_dir)


@query
def q30_lr_k(spark, sf_dir):
    _, vectors, layouts = _split_layouts(spark, sf_dir, K)
    blended = regression.blended_test(vectors, "l2sum", K, layouts=layouts)
    scored, _ = regression.fit_predict(vectors, regression.linear_regression(), K, blended=blended, keep=False)
    return scored


@query
def q31_tvs(spark, sf_dir):
    """Twelve points, judged on a validation part, from one pass over the train rows."""
    train = _split_vectors(spark, sf_dir, K).where("is_train")
    return linear.search(regression.training_rows(train, "l2sum"), K).report(spark, "tvs")


@query
def q32_sweep(spark, sf_dir):
    return sweep(
        lambda k: _split_vectors(spark, sf_dir, k),
        {None: None, 5: roles.region_membership(spark, sf_dir)},
        [4, 8],
        {"linear": RIDGE, "forest": forests.Forest()},
    )


@query
def q33_detect_communities(spark, sf_dir):
    edges = roles.known_links(spark, sf_dir, roles.user_dictionary(spark, sf_dir))
    return affiliation.detect_communities(edges, 5)


@query
def q34_doc_mean(spark, sf_dir):
    docs = _tokens(spark, sf_dir)
    embeddings = roles.table(spark, sf_dir, "embeddings")
    place = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 8), 16, 10).cast("bigint")
    # One slot more than there are vectors, so that some words have none.
    words = embed.token_counts(docs).withColumn("vec_id", place % F.lit(embeddings.count() + 1))
    vectors = words.join(embeddings, "vec_id").select("word", F.col("embedding").cast("array<double>").alias("vector"))
    rows = embed.mean_word_vectors(docs, "doc_id", vectors, K)
    return rows.select("doc_id", F.posexplode("features").alias("pos", "value")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


@query
def q35_model_report(spark, sf_dir):
    train = _split_vectors(spark, sf_dir, 1).where("is_train")
    model = regression.fit(train, regression.linear_regression(0.0), 1)
    rows = regression.model_report(spark, model, "lr").where(F.col("parameter").isin("coefficient", "intercept"))
    return _rounded(rows.select("parameter", "value"), 6, "value")


# --- further forms of the above -----------------------------------------------------------------


@query
def q36_time_split_user(spark, sf_dir):
    rows = roles.table(spark, sf_dir, "lineitem").join(
        roles.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    rows = rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("review_id"),
        F.col("o_custkey").alias("user_id"),
        "l_shipdate",
    )
    ranked = split.chronological_split(rows, "l_shipdate", by="user_id")
    return _rounded(ranked.select("review_id", "percent_rank", "is_train"), 9, "percent_rank")


@query
def q37_ridge_by_community(spark, sf_dir):
    train = _split_vectors(spark, sf_dir, 2).where("is_train")
    models = regression.fit_by_community(train, roles.membership(spark, sf_dir), 2, 0.01)
    return models.select(
        "community_id",
        *[F.round(x, 6).alias(f"w{i}") for i, x in enumerate(components("coefficients", 2))],
        F.round("intercept", 6).alias("intercept"),
        "n",
    )


@query
def q38_json_scan(spark, sf_dir):
    path = scratch_path(spark, "reviews-json")
    roles.raw_reviews(spark, sf_dir).write.json(path)
    return sources.read_reviews(spark, path)


@query
def q39_edge_list(spark, sf_dir):
    path = scratch_path(spark, "edges")
    users = roles.users(spark, sf_dir)
    sources.write_edges(social.friend_edges(users), path)
    pair = F.split("value", " ")
    rows = sources.read_lines(spark, path).select(
        pair[0].cast("bigint").alias("src"), pair[1].cast("bigint").alias("dst")
    )
    return rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("dst_sum"))


@query
def q40_model_round_trip(spark, sf_dir):
    path = scratch_path(spark, "model")
    vectors = _split_vectors(spark, sf_dir, 1)
    sources.save_model(
        regression.fit(regression.training_rows(vectors, "mean"), regression.linear_regression(0.0), 1), path
    )
    model = sources.load_model(LinearRegressionModel, path)
    blended = regression.blended_test(vectors, "mean", 1, profile_from="train", norm=None)
    return _pair_sums(regression.score_pairs(blended, model))


@query
def q41_metrics_log(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    rows = roles.reviews(spark, sf_dir)
    for k in (17, 19):
        predicted = rows.withColumn("prediction", 1.0 + F.col("part_id") % k / 4.0)
        metrics = evaluate.regression_metrics(predicted, (), "label", "prediction")
        sources.append_metrics(evaluate.metric_rows(metrics, "log", k, None, "rule"), path)
    return _rounded(sources.read_table(spark, path).select("run_id", "k", "model", "metric", "value"), 6, "value")


@query
def q42_summary_csv(spark, sf_dir):
    path = scratch_path(spark, "summary")
    cols = ["o_totalprice"]
    sources.write_summary(evaluate.describe(roles.table(spark, sf_dir, "orders"), cols), path)
    rows = spark.read.schema("column string, statistic string, value double").option("header", True).csv(path)
    return _rounded(rows, 4, "value")


@query
def q43_adjacency(spark, sf_dir):
    rows = social.adjacency(social.friend_edges(roles.users(spark, sf_dir)))
    return rows.select("user_id_index", F.array_join("friends_index", ",").alias("friends"))


@query
def q44_prepare_business(spark, sf_dir):
    rows = roles.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("business_id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") == 3, "").otherwise(F.col("s_nationkey").cast("string")).alias("city"),
        F.col("s_nationkey").cast("string").alias("state"),
        (F.col("s_acctbal") / 1000.0).alias("latitude"),
        F.when(F.col("s_suppkey") % 7 != 0, (F.col("s_suppkey") % 90).cast("double")).alias("longitude"),
        F.lit(3.0).alias("stars"),
        F.col("s_suppkey").alias("review_count"),
        F.lit(1).cast("bigint").alias("is_open"),
        F.lit("shop").alias("categories"),
        F.create_map(F.lit("parking"), F.lit("yes")).alias("attributes"),
    )
    return geo.prepare_business(rows, max_dist=20.0).select("business_id", "business_id_index", "state", "longitude")


@query
def q45_rank_users(spark, sf_dir):
    """Users with their rank, of which the sort alone would leave no trace in a table."""
    return social.number_users(_user_totals(roles.users(spark, sf_dir)))


@query
def q46_rename(spark, sf_dir):
    rows = roles.raw_reviews(spark, sf_dir)
    return rename(rows, review_id="review_id", label="stars")


@query
def q47_rf_by_community(spark, sf_dir):
    return evaluate.combine_predictions(_forest_pairs(spark, sf_dir, roles.region_membership(spark, sf_dir)))


@query
def q48_drop_from_array(spark, sf_dir):
    """Friends without the user, whom every third user's list names first."""
    users = roles.users(spark, sf_dir)
    named = F.when(F.col("user_id_index") % 3 == 0, F.array_prepend("friends", F.col("user_id"))).otherwise(F.col("friends"))
    return users.select(
        "user_id",
        F.size(named).cast("bigint").alias("named"),
        F.array_join(F.array_remove(named, F.col("user_id")), ",").alias("friends"),
    )


@query
def q49_community_arrays(spark, sf_dir):
    reviews = roles.reviews(spark, sf_dir).select("review_id", "user_id")
    rows = communities.attach_communities(reviews, roles.membership(spark, sf_dir), as_array=True)
    return rows.select("review_id", F.array_join("community_id_arr", ",").alias("communities"))


@query
def q50_blended_reviews(spark, sf_dir):
    rows = profiles.blend_bucketed_reviews(
        roles.review_keys(spark, sf_dir), "l2sum", K, attach=lambda keyed: roles.attach_vectors(keyed, sf_dir)
    )
    # Weighted by place, so that every component of both vectors counts.
    weighted = {
        name: F.round(total(F.transform(name, lambda x, i: x * (i + 1))), 5) for name in ("normFeatures", "blended_features")
    }
    return rows.select(
        "review_id", weighted["normFeatures"].alias("norm_weighted"), weighted["blended_features"].alias("blended_weighted")
    )


@query
def q51_dense_communities(spark, sf_dir):
    """Communities without ids, numbered by content."""
    rows = communities.parse_communities(roles.community_lines(spark, sf_dir))
    return rows.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"), F.sum("user_id").alias("members"))


@query
def q52_weighted_compliments(spark, sf_dir):
    """One counter counted twice, users without known friends kept."""
    users = roles.users(spark, sf_dir)
    rows = social.user_profiles(
        users,
        social.friend_edges(users),
        AS_OF,
        keep_isolated=True,
        weights={"compliment_funny": 2},
        with_adjacency=False,
    )
    return rows.select("user_id", "num_of_friends", "total_compliments", "known_friends")


@query
def q53_embedding_pipeline(spark, sf_dir):
    cleaned = embed.clean_column(roles.documents(spark, sf_dir), "text", STOP_WORDS)
    cleaned = pin(cleaned.select("doc_id", "clean_text"))
    model = embed.embedding_pipeline(K, "clean_text").fit(cleaned)
    embedded = pin(embed.arrays(model.transform(cleaned), "features").select("doc_id", "words", "features"))
    return _embedded(embedded, model.stages[-1], embedded, K)


@query
def q58_training_summary(spark, sf_dir):
    """Errors, t-values and fit of the linear model, over all rows and per community."""
    train = _split_vectors(spark, sf_dir, 2).where("is_train")
    return _rounded(linear.training_summary(train, 2, 0.0, roles.membership(spark, sf_dir)), 5, "value")


@query
def q59_grid_search(spark, sf_dir):
    """The whole grid at two features, where SQL can follow every point."""
    found = linear.search(_split_vectors(spark, sf_dir, 2).where("is_train"), 2)
    rows = [(*[p[n] for n in linear.GRID], v, i == found.best) for i, (p, v) in enumerate(zip(found.points, found.rmse))]
    points = spark.createDataFrame(rows, "reg_param double, fit_intercept boolean, elastic_net double, rmse double, is_best boolean")
    return _rounded(points, 6, "rmse")


@query
def q60_stumps(spark, sf_dir):
    """A tree of one split per community, whose nodes SQL can find as well."""
    train = _split_vectors(spark, sf_dir, 2).where("is_train")
    spec = forests.Forest(num_trees=1, max_depth=1, features="all", bootstrap=False)
    nodes = forests.fit_forests(train, 2, spec, roles.membership(spark, sf_dir), cuts=[CUTS, CUTS])
    kept = nodes.select("community_id", "node", F.col("feature").cast("bigint").alias("feature"), "threshold", "value", F.col("weight").cast("bigint").alias("n"), "gain")
    return _rounded(kept, 6, "value", "gain")


def _weighed_pairs(tokens: DataFrame) -> DataFrame:
    # Just above zero rounding would decide.
    return cooccurrence.positive_pmi(tokens, 5, 10).where(F.col("pmi") > 1e-9)


@query
def q61_pmi(spark, sf_dir):
    """Pairs of words within five places and their positive mutual information."""
    return _rounded(_weighed_pairs(_tokens(spark, sf_dir)), 6, "pmi")


@query
def q62_pmi_vectors(spark, sf_dir):
    """Documents as means of word vectors that no driver held: known words, and whether anything is left."""
    tokens = _tokens(spark, sf_dir)
    vectors, _ = cooccurrence.word_vectors(_weighed_pairs(tokens), 16)
    vectors = pin(vectors)
    counts = _known_counts(tokens, vectors)
    means = embed.mean_word_vectors(tokens, "doc_id", vectors, 16)
    return counts.join(means.select("doc_id", (l2_norm("features") == 0).alias("is_zero")), "doc_id")


@query
def q63_line_ids(spark, sf_dir):
    """Communities numbered by the line they are on, over a folder of files."""
    path = scratch_path(spark, "communities")
    roles.community_lines(spark, sf_dir).orderBy("line_id").select("value").write.text(path)
    lines = sources.read_numbered_lines(spark, path)
    return communities.parse_communities(lines, "value", "line_id")


@query
def q64_whole_records(spark, sf_dir):
    """Complete cases over fields that no schema names; lines that are no records are counted apart."""
    path = scratch_path(spark, "records")
    s = F.col("s_suppkey")
    record = F.to_json(
        F.struct(
            F.col("s_name").alias("business_id"),
            F.when(s % 5 != 0, F.col("s_name")).alias("name"),
            s.alias("review_count"),
            # Fields of some records only.
            F.when(s % 3 != 0, F.struct(F.when(s % 2 == 0, "yes").alias("wifi"))).alias("extra"),
            F.when(s % 7 != 0, s * 2).alias("visits"),
        )
    )
    text = F.when(s % 11 == 0, F.concat(F.substring(record, 1, 20), F.lit("..."))).when(s % 13 == 0, "").otherwise(record)
    roles.table(spark, sf_dir, "supplier").select(text.alias("value")).write.text(path)
    records, malformed = sources.read_whole_records(spark, path, "business_id string, name string, review_count bigint")
    kept = complete_cases(records).select("business_id", "review_count", F.col("visits").cast("bigint").alias("visits"), F.col("extra.wifi").alias("wifi"))
    bad = malformed.groupBy().agg(F.count("value").alias("visits")).select(
        F.lit("malformed").alias("business_id"), F.lit(None).cast("bigint").alias("review_count"), "visits", F.lit(None).cast("string").alias("wifi")
    )
    return kept.unionByName(bad)


@query
def q65_wide_mean(spark, sf_dir):
    """Profiles of 384 components: the vector six times over."""
    vectors = roles.review_vectors(spark, sf_dir, by="business_id").select("business_id", F.flatten(F.array_repeat("features", 6)).alias("features"))
    return _long(profiles.entity_profiles(vectors, "business_id", "mean", 6 * K), "business_id")


@query
def q66_sweep_ridge(spark, sf_dir):
    """A sweep whose models SQL can fit: one feature, over all rows and per community."""
    rows = sweep(
        lambda k: _split_vectors(spark, sf_dir, k), {None: None, 33: roles.membership(spark, sf_dir)}, [1], {"linear": RIDGE}, "mean", 0.0
    )
    return _rounded(rows.select("k", "c", "model", "metric", "value"), 6, "value")
