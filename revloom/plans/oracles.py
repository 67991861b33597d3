"""The registered queries as plain SQL over the same tables, written independently of Spark."""

from __future__ import annotations

from revloom.plans.queries import AS_OF, K, MIN_ABS_SUM, MIN_BUSINESS, MIN_USER

# Fixed values, spelt out here and not taken from the code that this SQL checks.
TAG = "<[^>]+>"
PUNCTUATION = r"[!-/:-@\[-\x60{-~]+"
DIGITS = "[0-9]+"
WHITESPACE = (
    r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
STOP_WORDS = "the and of in to is de la le et und der die das que los les".split()
COMPLIMENTS = [
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
]

LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
REVIEW_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
STARS = "CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS BIGINT)"

REV = f"""
rev AS (
  SELECT {REVIEW_ID} AS review_id, o_custkey AS user_id, l_suppkey AS business_id,
         CAST(l_shipdate AS DATE) AS date, {STARS} AS label, l_partkey AS part_id
  FROM {LINES})"""

IS_TRAIN = (
    "CAST('0x' || substr(md5(review_id || '|12345'), 1, 8) AS BIGINT) % 10000 < 8000"
)

# Reviews with the sums of a vector's numbers in even and in odd places.
TWO = f"""{REV},
two AS (
  SELECT review_id, user_id, rev.label AS y, {IS_TRAIN} AS is_train,
         list_sum(list_transform(embedding, lambda v, i: CASE WHEN i % 2 = 1 THEN CAST(v AS DOUBLE) ELSE 0 END)) AS x0,
         list_sum(list_transform(embedding, lambda v, i: CASE WHEN i % 2 = 0 THEN CAST(v AS DOUBLE) ELSE 0 END)) AS x1
  FROM rev JOIN embeddings ON vec_id = part_id % (SELECT count(*) FROM embeddings))"""

# One row per review and vector component x; norm is the length of the whole vector.
LONG = f"""{REV},
emb AS (
  SELECT vec_id, embedding,
         sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS norm
  FROM embeddings),
vec AS (
  SELECT user_id, business_id, review_id, norm,
         unnest(range({K})) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM rev JOIN emb ON vec_id = part_id % (SELECT count(*) FROM embeddings))"""

USERS = """
users AS (
  SELECT c_name AS user_id, c_custkey AS user_id_index, c_name AS name, o.*
  FROM customer JOIN (
    SELECT o_custkey, count(*) AS review_count, CAST(min(o_orderdate) AS DATE) AS yelping_since,
           count(*) FILTER (o_totalprice > 250000) AS fans,
           count(DISTINCT year(o_orderdate)) AS elite,
           [min(o_orderkey), max(o_orderkey), CAST(sum(o_orderkey) % 2000 AS BIGINT)] AS friends,
           CAST(sum(o_orderkey % 5 + 1) AS DOUBLE) / count(*) AS average_stars,
           """ + ",\n           ".join(
    f"count(*) FILTER ({cond}) AS {name}"
    for name, cond in zip(
        COMPLIMENTS,
        [
            "o_orderpriority = '1-URGENT'",
            "o_orderpriority = '2-HIGH'",
            "o_orderpriority = '3-MEDIUM'",
            "o_orderpriority = '4-NOT SPECIFIED'",
            "o_orderpriority = '5-LOW'",
            "o_orderstatus = 'F'",
            "o_orderstatus = 'O'",
            "o_orderstatus = 'P'",
            "o_totalprice < 100000",
            "o_totalprice > 400000",
            "o_orderkey % 2 = 0",
        ],
    )
) + """
    FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey),
edges AS (
  SELECT src, c_custkey AS dst
  FROM (SELECT user_id_index AS src, unnest(friends) AS friend FROM users)
  JOIN customer ON c_custkey = friend)"""

TOTAL = " + ".join(COMPLIMENTS)

MEMBERSHIP = """
membership AS (
  SELECT c_custkey AS user_id,
         CAST(unnest([c_nationkey, 25 + n_regionkey, 30 + strpos('ABFHM', substr(c_mktsegment, 1, 1))])
              AS BIGINT) AS community_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
CLEAN = (
    f"regexp_replace(regexp_replace(regexp_replace(lower(text), '{TAG}', '', 'g'), "
    f"'{PUNCTUATION}', ' ', 'g'), '{DIGITS}', '', 'g')"
)
WORDS = f"list_filter(string_split_regex({CLEAN}, '{WHITESPACE}'), lambda w: w <> '' AND w NOT IN ({STOP}))"

# Words of 10 or more occurrences are known; a vector is zero without one, and both means agree.
_EMBEDDED = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS words FROM documents),
occ AS (SELECT doc_id, unnest(words) AS word FROM docs),
known AS (SELECT word FROM occ GROUP BY word HAVING count(*) >= 10),
n AS (SELECT doc_id, count(*) AS n FROM occ JOIN known USING (word) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_known, coalesce(n, 0) = 0 AS is_zero,
       CAST(0 AS DOUBLE) AS gap
FROM docs LEFT JOIN n USING (doc_id)"""


def _profile(key: str, value: str) -> str:
    """Raw or L2 mean per entity and component."""
    return f"SELECT {key}, pos, avg({value}) AS m FROM vec GROUP BY {key}, pos"


def _blend(value: str, norm: str, digits: int) -> str:
    """All scale factors cancel in the last normalisation, so plain means are enough."""
    guard = f"WHERE abs(ub.s) > {MIN_ABS_SUM} AND abs(p.us) > {MIN_ABS_SUM} AND abs(p.bs) > {MIN_ABS_SUM}"
    final = "sum(v)" if norm == "sum" else "sqrt(sum(v * v))"
    return f"""WITH {LONG},
u AS ({_profile('user_id', value)}),
b AS ({_profile('business_id', value)}),
us AS (SELECT user_id, sum(m) AS us FROM u GROUP BY user_id),
bs AS (SELECT business_id, sum(m) AS bs FROM b GROUP BY business_id),
p AS (SELECT DISTINCT rev.user_id, rev.business_id, us, bs FROM rev JOIN us USING (user_id) JOIN bs USING (business_id)),
prod AS (
  SELECT p.user_id, p.business_id, p.us, p.bs, u.pos,
         {"u.m / p.us * (b.m / p.bs)" if norm == "sum" else "u.m * b.m"} AS v
  FROM p JOIN u ON u.user_id = p.user_id JOIN b ON b.business_id = p.business_id AND b.pos = u.pos),
ub AS (
  SELECT user_id, business_id, min(us) AS us, min(bs) AS bs, {final} AS s,
         sum(v) FILTER (pos = 0) AS v0, sum((pos + 1) * v) AS w
  FROM prod GROUP BY user_id, business_id)
SELECT ub.user_id, ub.business_id, round(v0 / s, {digits}) AS first, round(w / s, {digits}) AS weighted
FROM ub {guard.replace("p.us", "ub.us").replace("p.bs", "ub.bs") if norm == "sum" else ""}"""


# One-feature model inputs: x is the sum of all components, test pairs carry the product of raw means.
ONE = f"""{REV},
one AS (
  SELECT rev.*, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS x, {IS_TRAIN} AS is_train
  FROM rev JOIN embeddings ON vec_id = part_id % (SELECT count(*) FROM embeddings))"""


def _test(source: str) -> str:
    return f"""
um AS (SELECT user_id, avg(x) AS u FROM one {source} GROUP BY user_id),
bm AS (SELECT business_id, avg(x) AS b FROM one {source} GROUP BY business_id),
test AS (
  SELECT user_id, business_id, CAST(sum(label) AS BIGINT) AS label, count(*) AS n, min(u * b) AS f
  FROM one JOIN um USING (user_id) JOIN bm USING (business_id)
  WHERE NOT is_train GROUP BY user_id, business_id)"""


def _rank(order: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"percent_rank() OVER ({part}ORDER BY {order})"


def _describe(table: str, cols: list[str]) -> str:
    stats = {"count": "count", "mean": "avg", "stddev": "stddev_samp", "min": "min", "max": "max"}
    return " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", \'{s}\' AS statistic, round(CAST({f}({c}) AS DOUBLE), 4) AS value FROM {table}'
        for c in cols
        for s, f in stats.items()
    )


def _metrics(label: str, prediction: str) -> dict[str, str]:
    return {
        "rmse": f"round(sqrt(avg(({label} - {prediction}) ** 2)), 6)",
        "r2": f"round(1 - avg(({label} - {prediction}) ** 2) / var_pop({label}), 6)",
        "mae": f"round(avg(abs({label} - {prediction})), 6)",
    }


def _metric_log(k: int) -> str:
    return " UNION ALL ".join(
        f"SELECT 'log' AS run_id, CAST({k} AS BIGINT) AS k, 'rule' AS model, '{m}' AS metric, {e} AS value FROM rev"
        for m, e in _metrics("label", f"(1 + part_id % {k} / 4.0)").items()
    )


# Words within five places of each other, both frequent, and their mutual information.
PMI = f"""docs AS (SELECT doc_id, {WORDS} AS words FROM documents),
often AS (SELECT word FROM (SELECT unnest(words) AS word FROM docs) GROUP BY word HAVING count(*) >= 10),
places AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
near AS (
  SELECT least(words[i], words[i + d]) AS a, greatest(words[i], words[i + d]) AS b
  FROM places, (VALUES (1), (2), (3), (4), (5)) t(d) WHERE i + d <= len(words)),
pairs AS (
  SELECT a, b, count(*) AS n FROM near
  WHERE a IN (SELECT word FROM often) AND b IN (SELECT word FROM often) GROUP BY a, b),
margin AS (SELECT word, sum(n) AS m FROM (SELECT a AS word, n FROM pairs UNION ALL SELECT b, n FROM pairs) GROUP BY word),
pmi AS (
  SELECT a, b, n, ln(CAST(CASE WHEN a = b THEN 2 * n ELSE n END AS DOUBLE) * (SELECT sum(m) FROM margin) / x.m / y.m) AS pmi
  FROM pairs JOIN margin x ON x.word = a JOIN margin y ON y.word = b)"""


def oracle_sql() -> dict[str, str]:
    metrics = _metrics("label", "prediction")
    return {
        "q01_enriched_reviews": f"""
WITH au AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > {MIN_USER}),
ab AS (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(*) > {MIN_BUSINESS})
SELECT {REVIEW_ID} AS review_id, o_custkey AS user_id, l_suppkey AS business_id,
       CAST(l_shipdate AS DATE)::VARCHAR::DATE AS date, {STARS} AS label,
       l_returnflag || ' ' || l_linestatus || ' ' || o_orderpriority AS text,
       CAST(round(l_discount * 100) AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT) + l_linenumber AS votes
FROM {LINES}
WHERE o_custkey IN (SELECT o_custkey FROM au) AND l_suppkey IN (SELECT l_suppkey FROM ab)
  AND o_custkey IN (SELECT c_custkey FROM customer) AND l_suppkey IN (SELECT s_suppkey FROM supplier)""",
        "q02_pair_average": f"""
WITH {REV}
SELECT user_id, business_id, CAST(sum(label) AS BIGINT) AS label, count(*) AS num_of_reviews,
       round(CAST(sum(label) AS DOUBLE) / count(*), 6) AS avg_label
FROM rev GROUP BY user_id, business_id""",
        "q03_geo_outliers": """
WITH b AS (
  SELECT s_suppkey, s_nationkey, s_acctbal / 1000.0 AS lat, CAST(s_suppkey % 90 AS DOUBLE) AS lon FROM supplier),
g AS (SELECT s_nationkey, avg(lat) AS alat, avg(lon) AS alon FROM b GROUP BY s_nationkey)
SELECT s_suppkey AS business_id, CAST(b.s_nationkey AS BIGINT) AS state
FROM b JOIN g ON b.s_nationkey = g.s_nationkey
WHERE sqrt(pow(lat - alat, 2) + pow(lon - alon, 2)) < 10""",
        "q04_complete_cases": """
SELECT o_orderkey, o_orderpriority AS city, o_orderstatus AS status
FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'""",
        "q05_dense_index": """
SELECT key, row_number() OVER (ORDER BY n DESC, key) - 1 AS idx, n
FROM (SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS n FROM orders GROUP BY 1)""",
        "q06_known_dictionary": f"""
SELECT o_custkey AS src, l_partkey AS dst, count(*) AS n
FROM {LINES} WHERE l_partkey IN (SELECT c_custkey FROM customer) GROUP BY 1, 2""",
        "q07_friend_edges": f"""
WITH {USERS}
SELECT DISTINCT src, dst FROM edges JOIN users ON src = user_id_index WHERE review_count > {MIN_USER}""",
        "q08_user_profile": f"""
WITH {USERS},
known AS (
  SELECT o_custkey AS src, count(DISTINCT l_partkey) AS known_friends
  FROM {LINES} WHERE l_partkey IN (SELECT user_id_index FROM users) GROUP BY 1)
SELECT user_id, user_id_index, review_count, name, CAST(3 AS BIGINT) AS num_of_friends,
       CAST(date '{AS_OF}' - yelping_since AS BIGINT) AS yelping_since, fans, elite,
       {TOTAL} AS total_compliments, round(average_stars, 6) AS average_stars, known_friends
FROM users JOIN known ON src = user_id_index""",
        "q09_top_users": f"""
WITH {USERS}
SELECT user_id, review_count, {TOTAL} AS total_compliments
FROM users ORDER BY total_compliments DESC, review_count DESC, user_id LIMIT 100""",
        "q10_clean_text": f"SELECT doc_id, array_to_string({WORDS}, ' ') AS clean_text FROM documents",
        "q11_token_counts": f"""
SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word""",
        "q12_profile_sumnorm": f"""
WITH {LONG}, u AS ({_profile('user_id', 'x')}),
s AS (SELECT user_id, sum(m) AS s FROM u GROUP BY user_id)
SELECT user_id, pos, round(m / s, 6) AS value FROM u JOIN s USING (user_id) WHERE abs(s) > {MIN_ABS_SUM}""",
        "q13_profile_l2sum": f"""
WITH {LONG}, u AS ({_profile('user_id', 'x / norm')}),
s AS (SELECT user_id, sqrt(sum(m * m)) AS s FROM u GROUP BY user_id)
SELECT user_id, pos, round(m / s, 6) AS value FROM u JOIN s USING (user_id)""",
        "q14_profile_mean": f"""
WITH {LONG} SELECT business_id, pos, round(m, 6) AS value FROM ({_profile('business_id', 'x')})""",
        "q65_wide_mean": f"""
WITH {LONG} SELECT business_id, pos + {K} * r AS pos, round(m, 6) AS value
FROM ({_profile('business_id', 'x')}), range(6) t(r)""",
        "q15_blend_v1": _blend("x", "sum", 3),
        "q16_blend_v2": _blend("x / norm", "l2", 6),
        "q17_blend_v3": _blend("x", "l2", 6),
        "q18_hash_split": f"WITH {REV} SELECT review_id, {IS_TRAIN} AS is_train FROM rev",
        "q19_date_split_global": f"""
WITH {REV}, r AS (SELECT review_id, {_rank('date')} AS pr FROM rev)
SELECT review_id, round(pr, 9) AS percent_rank, pr <= 0.8 AS is_train FROM r""",
        "q20_date_split_user": f"""
WITH {REV}, r AS (SELECT review_id, {_rank('date', 'user_id')} AS pr FROM rev)
SELECT review_id, round(pr, 9) AS percent_rank, pr <= 0.8 AS is_train FROM r""",
        "q21_parse_communities": """
SELECT DISTINCT o_orderkey AS community_id,
       unnest([o_custkey, o_orderkey % 997, year(o_orderdate), 9007199254740993]) AS user_id
FROM orders""",
        "q22_attach_communities": f"""
WITH {REV}, {MEMBERSHIP}
SELECT user_id, review_id, community_id FROM rev JOIN membership USING (user_id)""",
        "q23_lr_predict": f"""
WITH {ONE}, {_test('')},
model AS (SELECT regr_slope(label, x) AS w, regr_intercept(label, x) AS b FROM one WHERE is_train)
SELECT user_id, business_id, label, round(n * (w * f + model.b), 6) AS prediction, n AS num_of_reviews
FROM test, model""",
        "q24_lr_by_community": f"""
WITH {ONE}, {MEMBERSHIP}, {_test('')},
model AS (
  SELECT community_id, regr_slope(label, x) AS w, regr_intercept(label, x) AS b
  FROM one JOIN membership USING (user_id) WHERE is_train GROUP BY community_id),
scored AS (
  SELECT user_id, business_id, CAST(sum(label) AS BIGINT) AS label, sum(n * (w * f + model.b)) AS p,
         CAST(sum(n) AS BIGINT) AS n
  FROM test JOIN membership USING (user_id) JOIN model USING (community_id)
  GROUP BY user_id, business_id)
SELECT user_id, business_id, label, round(p, 6) AS prediction, n AS num_of_reviews,
       round(CAST(label AS DOUBLE) / n, 6) AS avg_label, round(p / n, 6) AS avg_prediction
FROM scored""",
        "q25_combine_predictions": f"""
WITH {REV}, {MEMBERSHIP}
SELECT user_id, business_id, CAST(sum(label) AS BIGINT) AS label,
       sum(label + community_id % 3 / CAST(4 AS DOUBLE)) AS prediction, count(*) AS num_of_reviews,
       round(CAST(sum(label) AS DOUBLE) / count(*), 6) AS avg_label,
       round(avg(label + community_id % 3 / CAST(4 AS DOUBLE)), 6) AS avg_prediction
FROM rev JOIN membership USING (user_id) GROUP BY user_id, business_id""",
        "q26_metrics": f"""
WITH {REV}, p AS (
  SELECT CAST(c_nationkey AS BIGINT) AS nation, label, 1 + part_id % 17 / CAST(4 AS DOUBLE) AS prediction
  FROM rev JOIN customer ON c_custkey = user_id)
SELECT nation, count(*) AS n, {metrics['rmse']} AS rmse, {metrics['r2']} AS r2, {metrics['mae']} AS mae
FROM p GROUP BY nation""",
        "q27_describe": _describe("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]),
        "q28_word2vec": _EMBEDDED,
        "q53_embedding_pipeline": _EMBEDDED,
        "q57_embed_reviews": _EMBEDDED,
        "q54_forest_report": f"""
SELECT parameter, CAST(n AS BIGINT) AS n, CAST(total AS DOUBLE) AS total, text
FROM (VALUES ('feature_importance', {K}, 1, NULL), ('tree_weight', 5, 5, NULL), ('maxDepth', 1, 4, NULL),
             ('numTrees', 1, 5, NULL), ('impurity', 1, NULL, 'variance')) t(parameter, n, total, text)
WHERE EXISTS (SELECT 1 FROM lineitem)""",
        "q55_partitioned_table": f"""
WITH {REV} SELECT label, count(*) AS n, CAST(sum(part_id) AS BIGINT) AS parts FROM rev WHERE label > 2 GROUP BY label""",
        "q56_ingest_partitions": f"""
SELECT {STARS} AS stars, count(*) AS n, CAST(7 AS BIGINT) AS parts FROM {LINES} GROUP BY 1""",
        "q34_doc_mean": f"""
WITH docs AS (SELECT doc_id, {WORDS} AS words FROM documents),
occ AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(words) AS word FROM docs) GROUP BY 1, 2),
known AS (
  SELECT word, embedding
  FROM (SELECT word, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT)
                     % ((SELECT count(*) FROM embeddings) + 1) AS vec_id
        FROM (SELECT DISTINCT word FROM occ)) w JOIN embeddings USING (vec_id)),
parts AS (
  SELECT word, unnest(range({K})) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM known),
sums AS (
  SELECT doc_id, pos, sum(c * x) AS s FROM occ JOIN parts USING (word) GROUP BY doc_id, pos),
cells AS (SELECT doc_id, len(words) AS n, unnest(range({K})) AS pos FROM docs)
SELECT cells.doc_id, cells.pos, round(coalesce(s, 0) / greatest(n, 1), 6) AS value
FROM cells LEFT JOIN sums ON sums.doc_id = cells.doc_id AND sums.pos = cells.pos""",
        "q35_model_report": f"""
WITH {ONE}, model AS (SELECT regr_slope(label, x) AS w, regr_intercept(label, x) AS b FROM one WHERE is_train)
SELECT 'coefficient' AS parameter, round(w, 6) AS value FROM model
UNION ALL SELECT 'intercept', round(b, 6) FROM model""",
        "q36_time_split_user": f"""
WITH r AS (SELECT {REVIEW_ID} AS review_id, {_rank('l_shipdate', 'o_custkey')} AS pr FROM {LINES})
SELECT review_id, round(pr, 9) AS percent_rank, pr <= 0.8 AS is_train FROM r""",
        "q37_ridge_by_community": f"""
WITH {REV}, {MEMBERSHIP},
two AS (
  SELECT community_id, rev.label AS y,
         list_sum(list_transform(embedding, lambda v, i: CASE WHEN i % 2 = 1 THEN CAST(v AS DOUBLE) ELSE 0 END)) AS x0,
         list_sum(list_transform(embedding, lambda v, i: CASE WHEN i % 2 = 0 THEN CAST(v AS DOUBLE) ELSE 0 END)) AS x1
  FROM rev JOIN embeddings ON vec_id = part_id % (SELECT count(*) FROM embeddings)
  JOIN membership USING (user_id) WHERE {IS_TRAIN}),
m AS (
  SELECT community_id, count(*) AS n, avg(x0) AS m0, avg(x1) AS m1, avg(y) AS my,
         var_pop(x0) * (1 + 0.01 / stddev_pop(y)) AS a, covar_pop(x0, x1) AS b,
         var_pop(x1) * (1 + 0.01 / stddev_pop(y)) AS d, covar_pop(x0, y) AS p, covar_pop(x1, y) AS q
  FROM two GROUP BY community_id),
w AS (SELECT *, (p * d - b * q) / (a * d - b * b) AS w0, (a * q - b * p) / (a * d - b * b) AS w1 FROM m)
SELECT community_id, round(w0, 6) AS w0, round(w1, 6) AS w1, round(my - w0 * m0 - w1 * m1, 6) AS intercept, n
FROM w""",
        "q58_training_summary": f"""
WITH {TWO}, {MEMBERSHIP},
g AS (
  SELECT CAST(NULL AS BIGINT) AS c, x0, x1, y FROM two WHERE is_train
  UNION ALL SELECT community_id, x0, x1, y FROM two JOIN membership USING (user_id) WHERE is_train),
m AS (
  SELECT c, count(*) AS n, avg(x0) AS m0, avg(x1) AS m1, avg(y) AS my, var_pop(x0) AS a, covar_pop(x0, x1) AS b,
         var_pop(x1) AS d, covar_pop(x0, y) AS p, covar_pop(x1, y) AS q, var_pop(y) AS v FROM g GROUP BY c),
w AS (
  SELECT *, a * d - b * b AS det, n - 3 AS free, (p * d - b * q) / (a * d - b * b) AS w0,
         (a * q - b * p) / (a * d - b * b) AS w1 FROM m),
f AS (SELECT *, my - w0 * m0 - w1 * m1 AS w2, n * (v - w0 * p - w1 * q) AS sse FROM w),
e AS (
  SELECT *, sqrt(sse / free * d / (n * det)) AS e0, sqrt(sse / free * a / (n * det)) AS e1,
         sqrt(sse / free * (1 + (m0 * m0 * d - 2 * m0 * m1 * b + m1 * m1 * a) / det) / n) AS e2, 1 - sse / (n * v) AS r2 FROM f),
mae AS (
  SELECT g.c, avg(abs(y - w0 * x0 - w1 * x1 - w2)) AS mae FROM g JOIN f ON g.c IS NOT DISTINCT FROM f.c GROUP BY g.c),
r AS (
  SELECT e.c, unnest([
    {{'k': 'coefficient', 'i': 0, 'x': w0}}, {{'k': 'coefficient', 'i': 1, 'x': w1}},
    {{'k': 'std_error', 'i': 0, 'x': e0}}, {{'k': 'std_error', 'i': 1, 'x': e1}},
    {{'k': 't_value', 'i': 0, 'x': w0 / e0}}, {{'k': 't_value', 'i': 1, 'x': w1 / e1}},
    {{'k': 'intercept', 'i': NULL, 'x': w2}}, {{'k': 'intercept_std_error', 'i': NULL, 'x': e2}},
    {{'k': 'intercept_t_value', 'i': NULL, 'x': w2 / e2}}, {{'k': 'n', 'i': NULL, 'x': n}},
    {{'k': 'degrees_of_freedom', 'i': NULL, 'x': free}}, {{'k': 'rmse', 'i': NULL, 'x': sqrt(sse / n)}},
    {{'k': 'r2', 'i': NULL, 'x': r2}}, {{'k': 'r2_adjusted', 'i': NULL, 'x': 1 - (1 - r2) * (n - 1) / free}},
    {{'k': 'mae', 'i': NULL, 'x': mae}}]) AS s
  FROM e JOIN mae ON e.c IS NOT DISTINCT FROM mae.c)
SELECT c AS community_id, s.k AS parameter, CAST(s.i AS BIGINT) AS pos, round(CAST(s.x AS DOUBLE), 5) AS value FROM r""",
        "q59_grid_search": f"""
WITH RECURSIVE {TWO},
parts AS (SELECT *, {IS_TRAIN.replace('12345', '54321')} AS is_fit FROM two WHERE is_train),
m AS (
  SELECT avg(x0) AS m0, avg(x1) AS m1, avg(y) AS my, var_pop(x0) AS a, covar_pop(x0, x1) AS b, var_pop(x1) AS d,
         covar_pop(x0, y) AS p, covar_pop(x1, y) AS q, stddev_pop(x0) AS s0, stddev_pop(x1) AS s1, stddev_pop(y) AS sy
  FROM parts WHERE is_fit),
grid AS (
  SELECT CAST(r AS DOUBLE) AS r, f, CAST(e AS DOUBLE) AS e FROM (VALUES (0.1), (0.01)) t(r), (VALUES (false), (true)) u(f), (VALUES (0), (0.5), (1)) v(e)),
std AS (
  SELECT r, f, e, r / sy * e AS l1, r / sy * (1 - e) AS l2, CASE WHEN f THEN 0 ELSE 1 END AS z,
         (a + z * m0 * m0) / (s0 * s0) AS a00, (b + z * m0 * m1) / (s0 * s1) AS a01, (d + z * m1 * m1) / (s1 * s1) AS a11,
         (p + z * m0 * my) / (s0 * sy) AS b0, (q + z * m1 * my) / (s1 * sy) AS b1 FROM grid, m),
steps AS (
  SELECT r, f, e, 0 AS i, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1 FROM std
  UNION ALL
  SELECT r, f, e, i + 1, n0, sign(b1 - a01 * n0) * greatest(abs(b1 - a01 * n0) - l1, 0) / (a11 + l2)
  FROM (SELECT std.*, i, w1, sign(b0 - a01 * w1) * greatest(abs(b0 - a01 * w1) - l1, 0) / (a00 + l2) AS n0
        FROM steps JOIN std USING (r, f, e) WHERE i < 400)),
model AS (
  SELECT r, f, e, w0 * sy / s0 AS w0, w1 * sy / s1 AS w1,
         CASE WHEN f THEN my - w0 * sy / s0 * m0 - w1 * sy / s1 * m1 ELSE 0 END AS w2 FROM steps, m WHERE i = 400),
judged AS (
  SELECT r, f, e, sqrt(avg((y - w0 * x0 - w1 * x1 - w2) ** 2)) AS rmse FROM model, parts WHERE NOT is_fit GROUP BY r, f, e)
SELECT r AS reg_param, f AS fit_intercept, e AS elastic_net, round(rmse, 6) AS rmse,
       row_number() OVER (ORDER BY rmse, r DESC, f, e) = 1 AS is_best FROM judged""",
        "q60_stumps": f"""
WITH {TWO}, {MEMBERSHIP},
g AS (SELECT community_id, x0, x1, CAST(y AS DOUBLE) AS y FROM two JOIN membership USING (user_id) WHERE is_train),
c AS (SELECT CAST(c AS DOUBLE) AS c, f FROM (VALUES (-1), (-0.5), (-0.25), (0), (0.25), (0.5), (1)) t(c), (VALUES (0), (1)) u(f)),
l AS (
  SELECT community_id, f, c, count(*) AS n, sum(y) AS s FROM g, c WHERE CASE WHEN f = 0 THEN x0 ELSE x1 END <= c GROUP BY ALL),
w AS (SELECT community_id, count(*) AS n, sum(y) AS s FROM g GROUP BY community_id),
best AS (
  SELECT l.community_id, f, c, l.n AS ln, l.s AS ls, w.n AS wn, w.s AS ws,
         l.s * l.s / l.n + (w.s - l.s) * (w.s - l.s) / (w.n - l.n) - w.s * w.s / w.n AS gain
  FROM l JOIN w USING (community_id) WHERE l.n < w.n
  QUALIFY row_number() OVER (PARTITION BY l.community_id ORDER BY gain DESC, f, c) = 1)
SELECT community_id, CAST(1 AS BIGINT) AS node, CAST(f AS BIGINT) AS feature, c AS threshold, round(ws / wn, 6) AS value, wn AS n, round(gain, 6) AS gain FROM best
UNION ALL SELECT community_id, 2, -1, 0, round(ls / ln, 6), ln, 0 FROM best
UNION ALL SELECT community_id, 3, -1, 0, round((ws - ls) / (wn - ln), 6), wn - ln, 0 FROM best""",
        "q61_pmi": f"""
WITH {PMI} SELECT a, b, n, round(pmi, 6) AS pmi FROM pmi WHERE pmi > 1e-9""",
        "q62_pmi_vectors": f"""
WITH {PMI},
known AS (SELECT DISTINCT unnest([a, b]) AS word FROM pmi WHERE pmi > 1e-9),
long AS (SELECT doc_id, unnest(words) AS word FROM docs),
found AS (
  SELECT doc_id, count(*) AS n_words, count(known.word) AS n_known FROM long LEFT JOIN known USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_known, 0) AS n_known, coalesce(n_known, 0) = 0 AS is_zero
FROM docs LEFT JOIN found USING (doc_id)""",
        "q63_line_ids": """
WITH l AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS community_id, o_custkey, o_orderkey, o_orderdate FROM orders)
SELECT DISTINCT community_id, CAST(unnest([o_custkey, o_orderkey % 997, year(o_orderdate), 9007199254740993]) AS BIGINT) AS user_id FROM l""",
        "q64_whole_records": """
WITH s AS (SELECT *, s_suppkey AS k FROM supplier)
SELECT s_name AS business_id, k AS review_count, 2 * k AS visits, CASE WHEN k % 2 = 0 THEN 'yes' END AS wifi FROM s
WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 5 <> 0 AND k % 3 <> 0 AND k % 7 <> 0
UNION ALL SELECT 'malformed', NULL, count(*), NULL FROM s WHERE k % 11 = 0""",
        "q66_sweep_ridge": f"""
WITH {ONE}, {MEMBERSHIP}, {_test('')},
whole AS (SELECT regr_slope(label, x) AS w, regr_intercept(label, x) AS b FROM one WHERE is_train),
parts AS (
  SELECT community_id, regr_slope(label, x) AS w, regr_intercept(label, x) AS b
  FROM one JOIN membership USING (user_id) WHERE is_train GROUP BY community_id),
p AS (
  SELECT NULL AS c, CAST(label AS DOUBLE) / n AS l, w * sign(f) + b AS p FROM test, whole
  UNION ALL
  SELECT 33, CAST(min(label) AS DOUBLE) / min(n), avg(w * sign(f) + b)
  FROM test JOIN membership USING (user_id) JOIN parts USING (community_id) GROUP BY user_id, business_id)
{" UNION ALL ".join(f"SELECT CAST(1 AS BIGINT) AS k, CAST(c AS BIGINT) AS c, 'linear' AS model, '{m}' AS metric, {e} AS value FROM p GROUP BY c" for m, e in _metrics('l', 'p').items())}""",
        "q38_json_scan": f"""
SELECT {REVIEW_ID} AS review_id, c_name AS user_id, s_name AS business_id, {STARS} AS stars,
       CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date,
       l_returnflag || ' ' || l_linestatus || ' ' || o_orderpriority AS text,
       CAST(round(l_discount * 100) AS BIGINT) AS useful, CAST(round(l_tax * 100) AS BIGINT) AS funny,
       CAST(l_linenumber AS BIGINT) AS cool
FROM {LINES} JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey""",
        "q39_edge_list": f"""
WITH {USERS} SELECT src, count(*) AS n, CAST(sum(dst) AS BIGINT) AS dst_sum FROM edges GROUP BY src""",
        "q40_model_round_trip": f"""
WITH {ONE}, {_test('WHERE is_train')},
model AS (SELECT regr_slope(label, x) AS w, regr_intercept(label, x) AS b FROM one WHERE is_train)
SELECT user_id, business_id, label, round(n * (w * f + model.b), 6) AS prediction, n AS num_of_reviews
FROM test, model""",
        "q41_metrics_log": f"WITH {REV} {_metric_log(17)} UNION ALL {_metric_log(19)}",
        "q42_summary_csv": _describe("orders", ["o_totalprice"]),
        "q43_adjacency": f"""
WITH {USERS}
SELECT src AS user_id_index, array_to_string(list_sort(list(DISTINCT dst)), ',') AS friends
FROM edges GROUP BY src""",
        "q44_prepare_business": """
WITH b AS (
  SELECT s_name, CAST(s_nationkey AS VARCHAR) AS state, s_acctbal / 1000.0 AS lat,
         CAST(s_suppkey % 90 AS DOUBLE) AS lon, row_number() OVER (ORDER BY s_name) - 1 AS idx
  FROM supplier WHERE s_nationkey <> 3 AND s_suppkey % 7 <> 0),
g AS (SELECT state, avg(lat) AS alat, avg(lon) AS alon FROM b GROUP BY state)
SELECT s_name AS business_id, idx AS business_id_index, b.state, lon AS longitude
FROM b JOIN g ON b.state = g.state WHERE sqrt(pow(lat - alat, 2) + pow(lon - alon, 2)) < 20""",
        "q45_rank_users": f"""
WITH {USERS}, t AS (SELECT user_id, review_count, {TOTAL} AS total_compliments FROM users)
SELECT *, row_number() OVER (ORDER BY total_compliments DESC, review_count DESC, user_id) AS rank FROM t""",
        "q46_rename": f"SELECT {REVIEW_ID} AS review_id, {STARS} AS label FROM {LINES}",
        "q48_drop_from_array": f"""
WITH {USERS}
SELECT user_id, CAST(CASE WHEN user_id_index % 3 = 0 THEN 4 ELSE 3 END AS BIGINT) AS named,
       array_to_string(list_transform(list_filter(friends, lambda x: x <> user_id_index),
         lambda x: 'Customer#' || lpad(CAST(x AS VARCHAR), 9, '0')), ',') AS friends
FROM users""",
        "q49_community_arrays": f"""
WITH {REV}, {MEMBERSHIP},
a AS (SELECT user_id, array_to_string(list_sort(list(community_id)), ',') AS communities FROM membership GROUP BY 1)
SELECT review_id, communities FROM rev JOIN a USING (user_id)""",
        "q50_blended_reviews": f"""
WITH {LONG},
u AS ({_profile('user_id', 'x / norm')}), b AS ({_profile('business_id', 'x / norm')}),
p AS (SELECT DISTINCT user_id, business_id FROM rev),
prod AS (
  SELECT p.user_id, p.business_id, sum((u.pos + 1) * u.m * b.m) AS v, sqrt(sum((u.m * b.m) ** 2)) AS s
  FROM p JOIN u ON u.user_id = p.user_id JOIN b ON b.business_id = p.business_id AND b.pos = u.pos
  GROUP BY p.user_id, p.business_id)
SELECT review_id, round(list_sum(list_transform(embedding, lambda v, i: i * CAST(v AS DOUBLE))) / norm, 5) AS norm_weighted,
       round(v / s, 5) AS blended_weighted
FROM rev JOIN emb ON vec_id = part_id % (SELECT count(*) FROM embeddings)
JOIN prod ON rev.user_id = prod.user_id AND rev.business_id = prod.business_id""",
        "q51_dense_communities": """
WITH m AS (
  SELECT list_sort([o_custkey, o_orderkey % 997, year(o_orderdate), 9007199254740993]) AS m FROM orders),
c AS (SELECT m, row_number() OVER (ORDER BY md5(array_to_string(m, ','))) AS community_id FROM m)
SELECT community_id, CAST(len(list_distinct(m)) AS BIGINT) AS size, CAST(list_sum(list_distinct(m)) AS BIGINT) AS members
FROM c""",
        "q52_weighted_compliments": f"""
WITH {USERS},
known AS (SELECT src, count(DISTINCT dst) AS known_friends FROM edges GROUP BY src)
SELECT user_id, CAST(3 AS BIGINT) AS num_of_friends, {TOTAL} + compliment_funny AS total_compliments, known_friends
FROM users LEFT JOIN known ON src = user_id_index""",
    }
