"""Toxicity: held-out accuracy, shared backoff, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revloom.llm import toxicity

DOCS = "doc_id bigint, text string, toxic int, score string"
LABELS = "doc_id bigint, toxic int, text string"


def corpus(n, seed=1):
    """Ordinary words, and in toxic texts one of five bad ones somewhere."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{int(r.paretovariate(0.8)) % 3000}" for _ in range(r.randint(20, 300))]
        bad = r.random() < 0.2
        if bad:
            words[r.randrange(len(words))] = f"BAD{r.randrange(5)}!"
        docs.append((i, " ".join(words), 0, "x"))
        labels.append((i, int(bad), "x"))
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(900)
    got = toxicity.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    want = {i: t for i, t, _ in labels}
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == want[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(300, 2)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, x) for i, t, x in labels]
    df = spark.createDataFrame(docs, DOCS)
    a, b = (sorted(tuple(r) for r in toxicity.score(df, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert a == b


def test_words_seen_alike_say_nothing():
    t, o = np.array([50.0, 40, 0, 1, 2, 3]), np.array([50.0, 0, 60, 1, 2, 3])
    toxic, ordinary = toxicity.words_alone(t, o)
    ratios = toxic - ordinary
    assert ratios[1] > 2.0 and ratios[2] < -2.0
    assert all(abs(ratios[k]) < 0.5 for k in (0, 3, 4, 5, 6))


class Plain:
    """Both models with dictionaries, a word and a pair at a time."""

    def __init__(self, texts):
        once = set(texts)
        pairs = Counter()
        for toxic, text in once:
            words = ["", *(w.decode() for w in toxicity.expressions(text))]
            pairs.update((toxic, v, w) for v, w in set(zip(words, words[1:])))
        whole = Counter()
        for (_, v, w), n in pairs.items():
            whole[v, w] += n
        self.kept = {c: {(v, w): n for (k, v, w), n in pairs.items() if k == c and whole[v, w] >= 2} for c in (0, 1)}
        self.contexts = {c: Counter(w for k, _, w in pairs if k == c) for c in (0, 1)}
        self.classes = Counter(w for c in (0, 1) for w in self.contexts[c])
        self.both = Counter(p for c in (0, 1) for p in self.kept[c])

    @staticmethod
    def cut(counts):
        d = toxicity.discounts([sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)])
        return lambda n: d[min(n, 3) - 1] if n else 0.0

    def alone(self, c, w):
        def share(counts, w, below):
            cut, total = self.cut(counts), sum(counts.values())
            return (counts[w] - cut(counts[w]) + sum(map(cut, counts.values())) * below) / total

        return share(self.contexts[c], w, share(self.classes, w, 1 / (len(self.classes) + 1)))

    def after(self, c, v, w):
        def share(counts, below):
            cut = self.cut(counts)
            of_v = {p: n for p, n in counts.items() if p[0] == v}
            if not of_v:
                return below
            n = of_v.get((v, w), 0)
            return (n - cut(n) + sum(map(cut, of_v.values())) * below) / sum(of_v.values())

        return share(self.kept[c], share(self.both, self.alone(c, w)))


def texts_of(n, seed):
    r = random.Random(seed)
    out = [(r.randrange(2), " ".join(f"w{int(r.paretovariate(0.7)) % 40}" for _ in range(r.randint(1, 30)))) for _ in range(n)]
    return [(c, t + " x y" * (c and r.random() < 0.4)) for c, t in out]


@pytest.mark.parametrize("n,seed", [(60, 1), (200, 2), (4, 3)])
def test_models_equal_plain_ones(spark, n, seed):
    texts = texts_of(n, seed) + [(0, "z z z"), (1, "z w1")]
    texts += texts[:5]  # copies count once
    rows = spark.createDataFrame(texts, "toxic int, text string").distinct()
    pairs = rows.mapInArrow(toxicity._pairs, "before binary, word binary, toxic int").groupBy("before", "word")
    model = toxicity.model_of(pairs.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")))
    plain = Plain(texts)
    for text in [texts[0][1], texts[1][1], "w1 new x y z z", "new new w0", "x"]:
        words = ["", *text.split()]
        want = [[math.log(plain.after(c, v, w)) for v, w in zip(words, words[1:])] for c in (1, 0)]
        np.testing.assert_allclose(model.log_likelihoods(text), want, rtol=1e-4)


def test_probabilities_add_up(spark):
    plain = Plain(texts_of(100, 4))
    words = list(plain.classes)
    for c in (0, 1):
        assert sum(plain.alone(c, w) for w in [*words, "new"]) == pytest.approx(1.0)
        for v in ("", "x", "w1", "new"):
            assert sum(plain.after(c, v, w) for w in [*words, "new"]) == pytest.approx(1.0)


def area(scores, marks):
    """Area under the curve: the share of pairs of either mark in the right order."""
    pairs = [(s > t) + (s == t) / 2 for s, m in zip(scores, marks) if m for t, k in zip(scores, marks) if not k]
    return sum(pairs) / len(pairs)


def test_a_phrase_of_ordinary_words(spark):
    """All texts hold both words; only in toxic ones does one follow the other."""
    r = random.Random(5)
    docs, labels = [], []
    for i in range(800):
        words = [f"w{int(r.paretovariate(0.8)) % 500}" for _ in range(r.randint(30, 120))]
        bad = r.random() < 0.3
        places = sorted(r.sample(range(1, len(words)), 2), reverse=True)
        for place, extra in zip(places, (["take", "out"], []) if bad else (["take"], ["out"])):
            words[place:place] = extra
        docs.append((i, " ".join(words), 0, "x"))
        labels.append((i, int(bad), "x"))
    got = toxicity.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).where("held_out").collect()
    assert len(got) > 150
    assert area([x.score for x in got], [labels[x.doc_id][1] for x in got]) > 0.95


def test_scores_at_the_threshold_are_predicted(spark):
    docs, labels = corpus(200, 6)
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    some = toxicity.score(df, marks).first()
    again = toxicity.score(df, marks, threshold=some.score).where(f"doc_id = {some.doc_id}").first()
    assert again.score == some.score and again.predicted == 1


def test_odd_rows(spark):
    docs, labels = corpus(200, 3)
    docs += [(900, None, 0, "x"), (901, "", 0, "x"), (None, "w1", 0, "x"), (901, "", 0, "x"), (902, "BAD1 " * 50_000, 0, "x")]
    labels += [(1, None, "x"), (None, 1, "x"), (5, 7, "x")] + labels[:3]
    df = spark.createDataFrame(docs, DOCS)
    got = toxicity.score(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    empty = {r.score for r in got if r.doc_id in (900, 901)}
    assert len(empty) == 1 and empty.pop() < 0.3
    assert toxicity.score(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 0, "x"), (3, 0, "x")], [(1, 1, "x"), (3, 1, "x")]])
def test_without_labels_of_both_classes(spark, labels):
    df = spark.createDataFrame([(1, "a", 0, ""), (2, "b", 0, "")], DOCS)
    scores = {r.score for r in toxicity.score(df, spark.createDataFrame(labels, LABELS)).collect()}
    assert scores == {1.0 if labels and labels[0][1] else 0.0}
