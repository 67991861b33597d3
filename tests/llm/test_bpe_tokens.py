"""BPE and token counts against the public libraries."""

import base64
import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revloom.llm import bpe, pretokens, token_counts
from revloom.llm.queries import JSON_VOCABULARY, RANKS, vocabulary_path

SCHEMA = "doc_id bigint, text string, piece string, n int"


def odd_texts():
    r = random.Random(3)
    made = ["".join(r.choice("aeiouthn s\n'é1²_. \u0085’̀中") for _ in range(300)) for _ in range(60)]
    return made + [
        None, "", " ", "a" * 3000, "ab" * 700, "the" * 150, "中文 abc　x", "\x1c a\u0085b  c", "½²³ 1² _x_", "it's we'll'd",
        "  \n\n  x \t", "🙂🙂 ok", "x<|endoftext|> y<|endoftext|>", "same", "same", "x" * 200_000,
    ]


@pytest.fixture(scope="module")
def rows(spark):
    texts = odd_texts()
    data = [(i if i != 4 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(7, texts[7], "clash", 1)]
    return data, spark.createDataFrame(data, SCHEMA).repartition(3)


def test_ids_equal_the_library(spark, rows):
    data, df = rows
    path = vocabulary_path(RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pretokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    # The library takes time in the square of one long run of letters, so that row is compared by its round trip.
    want = sorted((str(i), library.encode_ordinary(t or ""), t or "") for i, t, *_ in data if len(t or "") < 100_000)
    got = bpe.encode(df, path)
    assert want == sorted((str(r.doc_id), r.ids, r.decoded) for r in got.collect() if len(r.decoded) < 100_000)
    for r in got.collect():
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    back = {str(r.doc_id): r.text for r in bpe.decode(got, path).collect()}
    assert back == {str(i): t or "" for i, t, *_ in data}


def test_bpe_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(empty, vocabulary_path(RANKS)).count() == 0


def test_long_pieces_take_the_same_merges():
    vocab = bpe.vocabulary(vocabulary_path(RANKS))
    r = random.Random(5)
    for n in (5, 50, 200):
        pieces = ["".join(r.choice("abthe ein") for _ in range(n)).encode() for _ in range(50)]
        pieces = [p for p in pieces if p not in vocab.ranks]
        assert vocab.encode_pieces(pieces) == [vocab.merge_long(p) for p in pieces]


@pytest.mark.parametrize("common", [1, 100, 1 << 18])
def test_counts_equal_the_library(rows, common):
    data, df = rows
    path = vocabulary_path(JSON_VOCABULARY)
    library = Tokenizer.from_file(path)
    want = []
    for i, t, *_ in data:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((str(i), len((t or "").encode()), n, n > 1024))
    got = token_counts.count_tokens(df, path, common=common)
    assert sorted(want) == sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect())
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_counts_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts.count_tokens(empty, vocabulary_path(JSON_VOCABULARY)).count() == 0


def test_frequent_pre_tokens_are_whole_bands(spark):
    """At most as many as asked for, equal frequencies together, long ones never."""
    counts = [("x" * 65, 9000, 3)] * 1 + [(f"a{k}", 1000, 1) for k in range(5)] + [(f"b{k}", 10, 1) for k in range(20)] + [("c", 1, 1)]
    vocabulary = spark.createDataFrame(counts, "piece string, n bigint, pieces int")
    for common, want in ((4, 0), (5, 5), (24, 5), (25, 25), (26, 26), (100, 26)):
        got = [r.piece for r in vocabulary.where(token_counts._frequent(vocabulary, common)).collect()]
        assert len(got) == want and "x" * 65 not in got


def test_long_pre_tokens_of_many_documents(spark):
    path = vocabulary_path(JSON_VOCABULARY)
    df = spark.createDataFrame([(k, "ab" * 50 + f" w{k % 3}", "x", 1) for k in range(200)], SCHEMA)
    one = len(Tokenizer.from_file(path).encode("ab" * 50 + " w1", add_special_tokens=False).ids)
    got = token_counts.count_tokens(df, path).collect()
    assert len(got) == 200 and {r.n_tokens for r in got if r.doc_id % 3 == 1} == {one}


def test_fast_pattern_equals_the_public_one():
    for cp in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]:
        for s in (chr(cp), f"a{chr(cp)}b", f" {chr(cp)}1", chr(cp) * 3 + " x"):
            if pretokens.is_near(s):
                assert pretokens._NEAR.findall(s) == pretokens._public(pretokens.PATTERN).findall(s), hex(cp)


def test_counts_grow_with_nothing_else(spark):
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("a b").alias("text"))
    assert token_counts.count_tokens(df, vocabulary_path(JSON_VOCABULARY)).first().n_tokens == 2
