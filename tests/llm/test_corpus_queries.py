"""Registered queries of this folder and the pipeline on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from revloom.llm import queries
from tests.compare import compare, connect
from tests.llm.test_decontaminate import words
from tests.llm.test_minhash import brute as near, shingles
from tests.llm.test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    kept = dict(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = {r.doc_id: r for r in out.collect()}
        assert out.columns == columns
        texts = [(i, r.text) for i, r in kept.items()]
        if name == "language":
            assert set(got) == {i for i, t in texts if any(c.isalpha() for c in t or "")}
        elif name == "near_duplicates":
            assert set(got) == {i for i, _, _, keep in near(texts, 80) if keep}
        elif name == "repeated_passages":
            assert set(got) == set(kept)
            removed = {int(i): n for i, _, n, *_ in repeats(texts, 100)}
            assert all((got[i].text == kept[i].text) == (removed[i] == 0) and got[i].n_chars == len(got[i].text) for i in got)
        else:
            items = duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()
            whole = {i for i, t in texts if any(shingles(x) and shingles(x) <= shingles(t) for x, in items)}
            assert not whole & set(got) and len(kept) - len(got) < 0.1 * len(kept)
        kept = got
        docs = spark.createDataFrame(list(got.values()), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").collect()} == set(kept)


def test_odd_rows_pass_the_pipeline(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, doc string"
    text = "the same words again and again " * 8
    rows = [(1, text, "en", "s", 1, "x", "y"), (1, text, "en", "s", 1, "x", "y"), (2, text + "more", "en", None, None, None, None),
            (3, None, None, None, None, None, None), (None, "another text of a few words", "en", "s", 1, "x", "y"), (4, "", "en", "s", 0, "x", "y")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(words(__import__("random").Random(1), 20)))], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == [1, None]
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
