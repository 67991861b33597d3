"""Toxicity by two class-conditional Kneser-Ney models of order two.

Toxic and ordinary training texts give one model each. A pair of words counts once per distinct
text that holds it, and pairs of fewer than ``LEAST_TEXTS`` texts are cut off; words count by the
distinct words they follow, so a copied text adds nothing. All counts take modified discounts, and
what is discounted goes to shared counts, which are continuation counts over the classes: in how many
of them, one or both, a word or pair occurs.

    P_c(w | v): pairs of the class, then shared pairs, then P_c(w)
    P_c(w):     contexts of the word in the class, then shared words

A rare expression so has much the same probability under both models and says little. A text is
judged by the length-normalised difference of its two log-likelihoods: those of its strongest windows
of one and of four words, so that neither the length of a text nor the number of its ordinary words
hides a toxic expression, and that of the whole text. A logistic curve of the three, fitted on
labelled texts that were not counted, gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revloom.llm.common import is_rest, remainder, slices, text_of, words_of

EDGES = b".,;:!?%&$#*|()[]{}\"'"
START = b""  # stands before the first word
LEAST_TEXTS = 2  # that hold a pair which is counted
WINDOWS = (1, 4)  # words
CALIBRATION = 3  # remainder of the id modulo the folds: rows that fit the curve and are not counted


def expressions(text: str) -> list[bytes]:
    """Lower-cased words without punctuation at their ends."""
    return [w for w in (x.strip(EDGES) for x in words_of(text.encode())) if w]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of words seen once to four times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.1), k + 0.9) for k, x in enumerate(d))  # type: ignore[return-value]


def _cut(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.select([count >= 3, count == 2, count == 1], [d[2], d[1], d[0]], 0.0)


@dataclass
class Model:
    """Log-probabilities under both models (row 0: toxic, row 1: ordinary) by numbers of words.

    The last number, ``len(words)``, is that of any word not seen. ``alone`` has the words, ``backoff``
    what a context weighs them with, ``pairs`` those pairs of words (``keys``, sorted) that were counted.
    """

    words: dict[bytes, int] = field(default_factory=dict)
    alone: np.ndarray | None = None
    backoff: np.ndarray | None = None
    keys: np.ndarray | None = None
    pairs: np.ndarray | None = None
    weights: tuple[float, ...] = ()
    base: float = 0.0  # score of a text if there is nothing to learn from

    def log_likelihoods(self, text: str) -> np.ndarray:
        """Both log-probabilities of each word of a text, given the word before it."""
        get, none = self.words.get, len(self.words)
        ids = np.array([get(START, none), *(get(w, none) for w in expressions(text))], np.int64)
        v, w = ids[:-1], ids[1:]
        out = self.backoff[:, v] + self.alone[:, w]
        if len(self.keys):
            key = v * (none + 1) + w
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            out[:, known] = self.pairs[:, at[known]]
        return out

    def evidence(self, text: str) -> tuple[float, ...]:
        """Differences per word of the strongest windows and of the whole text; 0 for no words."""
        toxic, ordinary = self.log_likelihoods(text)
        if not len(toxic):
            return (0.0,) * (len(WINDOWS) + 1)
        sums = np.concatenate([[0.0], np.cumsum(toxic - ordinary, dtype=np.float64)])
        sizes = [min(k, len(toxic)) for k in WINDOWS]
        strongest = [max(0.0, float((sums[k:] - sums[:-k]).max()) / k) for k in sizes]
        return *strongest, float(sums[-1]) / len(toxic)

    def score(self, text: str) -> float:
        if self.alone is None:
            return self.base
        x = float(np.dot(self.weights, (*self.evidence(text), 1.0)))
        return 1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0


PAIRS = pa.schema([("before", pa.binary()), ("word", pa.binary()), ("toxic", pa.int32())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair of adjacent words, once per text."""
    for part in slices(batches):
        rows: list[tuple[bytes, bytes, int]] = []
        for toxic, text in zip(part.column("toxic").to_pylist(), part.column("text").to_pylist()):
            words = expressions(text)
            rows += [(v, w, toxic) for v, w in set(zip([START, *words], words))]
        columns = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAIRS)], schema=PAIRS)


def _kinds(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _classes(t: np.ndarray, o: np.ndarray) -> np.ndarray:
    """In how many classes something occurs."""
    return (t > 0).astype(float) + (o > 0)


def words_alone(t: np.ndarray, o: np.ndarray) -> np.ndarray | None:
    """Log-probabilities of words from their numbers of contexts in toxic and ordinary texts; unseen words last."""
    if not t.sum() or not o.sum():
        return None
    classes = _classes(t, o)
    cut = [_cut(c, discounts(_kinds(c))) for c in (t, o, classes)]
    shared = (np.append(classes - cut[2], 0.0) + cut[2].sum() / (len(classes) + 1)) / classes.sum()
    return np.log([(np.append(c - x, 0.0) + x.sum() * shared) / c.sum() for c, x in zip((t, o), cut)])


def words_after(v: np.ndarray, w: np.ndarray, t: np.ndarray, o: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the given pairs of words, and the log-weights of what contexts leave to words alone."""
    n = alone.shape[1]

    def parts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted share of each pair in its context, and what each context leaves over."""
        cut = _cut(c, discounts(_kinds(c)))
        total, left = np.bincount(v, c, n), np.bincount(v, cut, n)
        seen = total > 0
        left = np.where(seen, left / np.where(seen, total, 1.0), 1.0)
        return (c - cut) / np.where(seen, total, 1.0)[v], left

    share, left = parts(_classes(t, o))
    pairs, backoff = [], []
    for c, p in zip((t, o), np.exp(alone)):
        own, over = parts(c)
        pairs.append(own + over[v] * (share + left[v] * p[w]))
        backoff.append(over * left)
    return np.log(pairs), np.log(backoff)


def model_of(counts: DataFrame) -> Model | None:
    """The two models from ``(before, word, t, o)``: distinct toxic and ordinary texts that hold a pair."""
    contexts = counts.groupBy("word").agg(*[F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).cast("double").alias(c) for c in "to"])
    got = contexts.orderBy("word").toArrow()
    words = {w: k for k, w in enumerate(got.column("word").to_pylist())}
    alone = words_alone(got.column("t").to_numpy(), got.column("o").to_numpy())
    if alone is None:
        return None
    if START not in words:  # follows nothing, and is never asked for as a word
        words[START] = len(words)
        alone = np.concatenate([alone, alone[:, -1:]], axis=1)
    often = counts.where(F.col("t") + F.col("o") >= LEAST_TEXTS).toArrow()
    v, w = (np.array([words[x] for x in often.column(c).to_pylist()], np.int64) for c in ("before", "word"))
    t, o = (often.column(c).to_numpy().astype(float) for c in "to")
    pairs, backoff = words_after(v, w, t, o, alone)
    keys = v * (len(words) + 1) + w
    order = np.argsort(keys)
    return Model(words, alone.astype(np.float32), backoff.astype(np.float32), keys[order], pairs[:, order].astype(np.float32))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns and of 1 by Newton's method, with a light penalty that keeps separable data finite."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    penalty = np.diag([1e-2] * x.shape[1] + [1e-4]) * max(1.0, len(x) / 100)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _evidence(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [model.value.evidence(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "evidence"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", per_class: int = 8000,
) -> Model:
    """Fit on about ``per_class`` labelled texts of either class outside the held-out remainder.

    The bound holds for all that reaches the driver or is broadcast: the drawn labels, the words
    and adjacent pairs of the drawn texts and the evidence of the rows that fit the curve. Rows are drawn by a hash
    of their id. A document with several labels has the largest; null labels teach nothing.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    rows = rows.where((remainder("id", folds) != held_out) & F.col("toxic").isin(0, 1)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model(base=1.0 if sizes.get(1) else 0.0)
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    texts = texts.join(F.broadcast(drawn), "id").select("toxic", (remainder("id", folds) == CALIBRATION).alias("fit"), "text")
    once = texts.where("not fit").select("toxic", "text").distinct()
    pairs = once.mapInArrow(_pairs, "before binary, word binary, toxic int").groupBy("before", "word")
    counts = pairs.agg(F.sum("toxic").cast("bigint").alias("t"), F.sum(1 - F.col("toxic")).cast("bigint").alias("o")).cache()
    model = model_of(counts)
    counts.unpersist()
    if model is None:
        return Model(base=sizes[1] / (sizes[0] + sizes[1]))
    seen = texts.where("fit").select("toxic", "text")
    got = seen.mapInArrow(_evidence(spark.sparkContext.broadcast(model)), "toxic int, evidence array<double>").toArrow()
    x = np.array(got.column("evidence").to_pylist(), float).reshape(-1, len(WINDOWS) + 1)
    y = got.column("toxic").to_numpy()
    odds = math.log(sizes[1] / sizes[0])
    if 0 < y.sum() < len(y):
        *slopes, b = _logistic(x, y)
        # The draw changed the share of the classes; put it back.
        model.weights = (*slopes, b + odds - math.log(min(sizes[1], per_class) / min(sizes[0], per_class)))
    else:
        model.weights = (*[1.0] * (len(WINDOWS) + 1), odds - 1.0)
    return model


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for part in slices(batches):
            scores = [m.score(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 4, held_out: int = 2, threshold: float = 0.3, per_class: int = 8000,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, by its whole text alone.

    Rows whose crc32 of the id modulo ``folds`` is ``held_out`` are never learnt from. Null and
    empty texts get the score of no evidence. Without labels of both classes every score is the
    share of toxic ones. Rows are treated one by one: repeated rows and null ids (never held out,
    never learnt from) stay, other columns are ignored, an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held_out, id_col, text_col, label_col, per_class))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), is_rest(id_col, folds, held_out).alias("held_out"), text_of(text_col).alias("text")
    )
    return rows.mapInArrow(_score(model, threshold), "doc_id bigint, held_out boolean, score double, predicted int")
