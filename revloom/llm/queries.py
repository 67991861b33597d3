"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from revloom.llm import bpe, decontaminate, embedding_dedup, html_text, langid, merkle, minhash, ngram_lm, suffix_dedup, token_counts, toxicity, warc, whitening

JSON_VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str) -> str:
    """Place of an installed public vocabulary, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(JSON_VOCABULARY))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents of five-word shingles with a similarity of 0.85 or more."""
    return minhash.deduplicate(table(spark, sf_dir, "documents"), threshold=85).drop("text_hash")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors with a cosine of 0.95 or more."""
    return embedding_dedup.deduplicate(table(spark, sf_dir, "embeddings"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document; the list of ids as text."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join("item_ids", ","))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages of 100 bytes or more."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=False)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(RANKS), keep_ids=False)


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document."""
    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, checked with the document as it is or without its line feeds."""
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed &= F.contains("text", F.lit("\n"))
    without = merkle.leaf_digest([F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in merkle.FIELDS])
    found = merkle.build(docs, carry=[F.col("doc_id"), F.when(changed, F.unhex(without)).alias("changed")]).proofs()
    checked = merkle.verify(found, F.coalesce(F.lower(F.hex("row.changed")), "leaf"))
    return checked.select(
        F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest("proof").alias("proof_sha256"), "folded_root", "verified"
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector in 32 whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to web archives and read back through their index."""
    return warc.read_back(warc.archive(table(spark, sf_dir, "pages")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash": op2_minhash,
    "op3_html_text": op3_html_text,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_nn_descent": op6_nn_descent,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_ngram_lm": op10_ngram_lm,
    "op11_merkle": op11_merkle,
    "op12_whitening": op12_whitening,
    "op13_warc": op13_warc,
}

# Words and shingles as the operator has them; links by counting shared shingles; then reachability.
OP2_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
), items AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM sets
    UNION
    SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON s.doc_id = r.a
"""

# No masks: all places of a word in a document and an item, added up by alignment, then windows of aligned words.
OP7_SQL = r"""
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM benchmark
), doc_places AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM doc_words
), item_places AS (
    SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS q FROM item_words
), hits AS (
    SELECT doc_id, item_id, p - q AS d FROM doc_places JOIN item_places USING (word)
    GROUP BY doc_id, item_id, d, n HAVING 100 * count(*) >= 80 * least(20, n)
), aligned AS (
    SELECT h.doc_id, h.item_id, h.d, least(20, len(i.w)) AS width,
        list_transform(range(1, len(i.w) + 1), lambda j:
            CASE WHEN j + h.d >= 1 AND j + h.d <= len(x.w) AND x.w[j + h.d] = i.w[j] THEN 1 ELSE 0 END) AS e
    FROM hits h JOIN doc_words x USING (doc_id) JOIN item_words i USING (item_id)
), shares AS (
    SELECT doc_id, item_id, list_max(list_transform(range(1, len(e) - width + 2), lambda s:
        list_sum(e[s:s + width - 1]))) * 100 / width AS share
    FROM aligned
), found AS (
    SELECT doc_id, item_id, max(share) AS share FROM shares WHERE share >= 80 GROUP BY doc_id, item_id
), per_doc AS (
    SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids, max(share) AS share FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_items, coalesce(ids, '') AS item_ids,
    coalesce(share, 0.0)::DOUBLE AS share, n IS NOT NULL AS contaminated
FROM documents d LEFT JOIN per_doc USING (doc_id)
"""

# Cosine of all pairs; then reachability.
OP6_SQL = """
WITH RECURSIVE usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
        AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, e.b FROM reach r JOIN links e ON r.b = e.a
), component AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN degree USING (vec_id)
"""

# Levels of each source's tree as lists, then the tree over the sources, then every document's way up.
# No function of crc32: its eight steps a byte over the digits of the id.
OP11_SQL = r"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, sha256(concat(
            FIELD(doc_id), FIELD(source), FIELD(lang), FIELD(n_chars), FIELD(text))) AS leaf,
        sha256(concat(
            FIELD(doc_id), FIELD(source), FIELD(lang), FIELD(n_chars), FIELD(replace(text, chr(10), '')))) AS bare,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
            list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
            lambda c, d: list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM leaves
), levels AS (
    SELECT source, 0 AS lvl, list(leaf ORDER BY doc_id) AS nodes FROM leaves GROUP BY source
    UNION ALL
    SELECT source, lvl + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1:3 * k + 3], '')))
    FROM levels WHERE len(nodes) > 1
), subroots AS (
    SELECT source, nodes[1] AS subroot, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
    FROM levels WHERE len(nodes) = 1
), tops AS (
    SELECT 0 AS lvl, list(subroot ORDER BY place) AS nodes FROM subroots
    UNION ALL
    SELECT lvl + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1:3 * k + 3], '')))
    FROM tops WHERE len(nodes) > 1
), steps AS (
    SELECT p.doc_id, l.lvl, p.place // (3 ** l.lvl)::BIGINT AS i, l.nodes
    FROM placed p JOIN levels l ON p.source IS NOT DISTINCT FROM l.source WHERE len(l.nodes) > 1
    UNION ALL
    SELECT p.doc_id, s.height + t.lvl, s.place // (3 ** t.lvl)::BIGINT, t.nodes
    FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source CROSS JOIN tops t WHERE len(t.nodes) > 1
), sides AS (
    SELECT doc_id, lvl, array_to_string(nodes[i - i % 3 + 1:i], '') AS l, array_to_string(nodes[i + 2:i - i % 3 + 3], '') AS r FROM steps
), proofs AS (
    SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof_sha256, list(l ORDER BY lvl) AS ls, list(r ORDER BY lvl) AS rs
    FROM sides GROUP BY doc_id
), folded AS (
    SELECT p.doc_id, 1 AS k, CASE WHEN p.crc % 2 = 0 THEN p.bare ELSE p.leaf END AS node, ls, rs
    FROM placed p JOIN proofs USING (doc_id)
    UNION ALL
    SELECT doc_id, k + 1, sha256(ls[k] || node || rs[k]), ls, rs FROM folded WHERE k <= len(ls)
)
SELECT p.doc_id, p.leaf, s.subroot, t.nodes[1] AS root, q.proof_sha256, f.node AS folded_root, f.node = t.nodes[1] AS verified
FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN proofs q USING (doc_id)
JOIN folded f ON f.doc_id = p.doc_id AND f.k = len(f.ls) + 1 CROSS JOIN (SELECT nodes FROM tops WHERE len(nodes) = 1) t
"""
OP11_SQL = re.sub(
    r"FIELD\((\w+|replace\(.*?''\))\)", r"coalesce(strlen(\1::VARCHAR)::VARCHAR || ':' || \1::VARCHAR, '-')", OP11_SQL
)

OP13_SQL = """
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), shared AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM shared
"""

ORACLES: dict[str, str] = {"op13_warc": OP13_SQL, "op11_merkle": OP11_SQL, "op2_minhash": OP2_SQL, "op6_nn_descent": OP6_SQL, "op7_decontaminate": OP7_SQL}
