"""Language identification: exact code lengths, held-out accuracy, odd rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from revloom.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, score int, row string"


def model_of(texts):
    langs = sorted(texts)
    parts = [(k, *np.unique(langid._grams(langid.plain_bytes(texts[name])), return_counts=True)) for k, name in enumerate(langs)]
    lang = np.concatenate([np.full(len(g), k) for k, g, _ in parts])
    return langid.Model(langs, lang, np.concatenate([g for _, g, _ in parts]), np.concatenate([n for *_, n in parts]))


def plain_length(train, text):
    """Bits by walking the contexts of each byte one by one."""
    data = b"   " + langid.plain_bytes(train).tobytes()
    counts = {}
    for i in range(3, len(data)):
        for d in range(4):
            counts.setdefault(data[i - d : i], {}).setdefault(data[i], 0)
            counts[data[i - d : i]][data[i]] += 1
    data, bits = b"   " + langid.plain_bytes(text).tobytes(), 0.0
    for i in range(3, len(data)):
        d = 3
        while d >= 0:
            seen = counts.get(data[i - d : i])
            if seen:
                both = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    bits -= math.log2(seen[data[i]] / both)
                    break
                bits -= math.log2(len(seen) / both)
            d -= 1
        if d < 0:
            bits += 8.0
    return bits


def test_code_lengths_are_exact():
    texts = {"a": "the cat sat on the mat, the end", "b": "der hund und die katze äöü"}
    probes = ["the dog sat", "Die Katze!", "zzz", "", "x" * 50, "ä the 中文 und"]
    got = model_of(texts).code_lengths(probes)
    for i, p in enumerate(probes):
        for k, name in enumerate(sorted(texts)):
            assert got[i, k] == pytest.approx(plain_length(texts[name], p), rel=1e-5)


def test_texts_do_not_meet_in_a_chunk(monkeypatch):
    model = model_of({"a": "the cat sat on the mat", "b": "der hund und die katze"})
    probes = ["the cat " * 20, "", "und", "die katze " * 30]
    alone = np.concatenate([model.code_lengths([p]) for p in probes])
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert np.allclose(model.code_lengths(probes), alone)


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_predictions_do_not_depend_on_lang(spark):
    rows = [(i, t, lang, 0, "x") for i, (t, lang) in enumerate([("the cat sat", "en"), ("der hund und", "de")] * 20)]
    df = spark.createDataFrame(rows, SCHEMA)
    hidden = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(x).collect()} for x in (df, hidden))
    assert a == b


def test_odd_rows(spark):
    rows = [(1, "the cat", "en", 0, "x"), (2, "le chat", "fr", 0, "x"), (3, None, "fr", 0, "x"), (4, "", "fr", 0, "x"), (6, "12 !?", "en", 0, "x"),
            (7, "word", None, 0, "x"), (None, "the", "en", 0, "x"), (1, "the cat", "en", 0, "x"), (8, "a" * 300_000, "en", 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(df, carry=df.columns)
    assert got.count() == len(rows) and got.columns == ["doc_id", "held_out", "lang_pred", "score", "row"]
    assert got.select("row.*").columns == df.columns
    for r in got.collect():
        assert (r.lang_pred == "und") == (r.row.text is None or not any(c.isalpha() for c in r.row.text))
        assert r.lang_pred in ("en", "fr", "und")
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(rows)


def test_numerals_and_marks_are_no_letters():
    model = model_of({"a": "the cat sat on the mat", "b": "der hund und die katze"})
    texts = ["½", "²", "①", "12 + 3!", "_", "\u0301", "" , "½ a", "中", "ª"]
    assert [name == langid.UNKNOWN for name, _ in model.predict(texts)] == [not any(map(str.isalpha, t)) for t in texts] == [True] * 7 + [False] * 3
