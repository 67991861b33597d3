"""The language model against a dictionary version, and its probabilities summed up."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from revloom.llm import ngram_lm
from revloom.llm.common import words_of

SCHEMA = "doc_id bigint, text string, path string, n int"
TEXTS = ["a b c a b", "A b\td", None, "", "x y z " * 50, "a b c a b", "é É ñ", "b b b b", "q"] + [f"t{i % 7} a t{i % 3} b" for i in range(40)]


def plain(docs):
    """The same model with dictionaries."""
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    toks = lambda t: [*words_of((t or "").encode()), "END"]
    pairs = Counter(p for t in train for p in zip(["START", *toks(t)], toks(t)))
    count, cont, ctx = Counter(), Counter(), defaultdict(Counter)
    for (h, w), n in pairs.items():
        count[w] += n
        cont[w] += 1
        ctx[h][w] = n
    kinds = lambda c: [sum(1 for n in c.values() if n == k) for k in (1, 2, 3, 4)]
    dp, dw = ngram_lm.discounts(*kinds(pairs)), ngram_lm.discounts(*kinds(cont))
    cut = lambda d, n: d[min(n, 3) - 1] if n else 0.0
    v, total, n_pairs = len(count), sum(count.values()), len(pairs)
    free = sum(cut(dw, n) for n in cont.values()) / n_pairs

    def p(h, w):
        low = (cont[w] - cut(dw, cont[w])) / n_pairs + free / (v + 1)
        if h not in ctx:
            return low
        c = sum(ctx[h].values())
        return (ctx[h][w] - cut(dp, ctx[h][w])) / c + sum(cut(dp, n) for n in ctx[h].values()) / c * low

    out = {}
    for i, t in docs:
        ws = toks(t)
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ws)
        out[i] = (len(ws), sum(count[w] > 0 for w in ws), total, base, sum(math.log10(p(h, w)) for h, w in zip(["START", *ws], ws)))
    sums = [sum(p(h, w) for w in [*count, "?"]) for h in [*list(ctx)[:5], "unseen"]]
    return out, sums


def test_equals_dictionaries(spark):
    docs = list(enumerate(TEXTS))
    want, sums = plain(docs)
    assert sums == pytest.approx([1.0] * len(sums))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA).repartition(3)
    for r in ngram_lm.score(df, buckets=4).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:])


def test_odd_tables(spark):
    assert ngram_lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = ngram_lm.score(spark.createDataFrame([(held, "a b", "", 0)], SCHEMA)).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and math.isfinite(r.score) and math.isfinite(r.base_score)
    rows = ngram_lm.score(spark.createDataFrame([(None, "a b", "", 0)] * 2, SCHEMA)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known) for r in rows] == [(False, 3, 3)] * 2


def test_packing():
    w = np.array([1, 2**55, 7], dtype=np.uint64)
    assert ngram_lm._wide(ngram_lm._narrow(w).tobytes()).tolist() == w.tolist()
