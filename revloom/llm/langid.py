"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts up to three bytes deep, with the bytes that followed
each. A byte is coded by the longest context its language knows: a byte that followed it costs
``-log2(c / (t + d))`` bits (``c`` times in ``t`` occurrences with ``d`` different followers), any
other costs an escape, ``-log2(d / (t + d))``, and then what the next shorter context asks; below
the empty context all 256 bytes are alike. The statistics are frozen after training, so the code
length of any (context, byte) is a constant: the trees of all languages are laid out as one table
of states and a text is scored by looking its bytes up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revloom.llm.common import carried, is_rest, slices, text_of, with_row

DEPTH = 3
UNKNOWN = "und"
# ASCII letters stay, other ASCII becomes a space; bytes of other characters stay.
PLAIN = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
CHUNK = 1_000_000


def plain_bytes(text: str) -> np.ndarray:
    """Lower-cased bytes; each run of what is not a letter is one space."""
    data = np.frombuffer(text.lower().encode().translate(PLAIN), dtype=np.uint8)
    space = data == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]
    return data[keep]


def _grams(data: np.ndarray) -> np.ndarray:
    """Each byte with the three before it as one number; before the text there are spaces."""
    padded = np.concatenate([np.full(DEPTH, 0x20, dtype=np.int64), data.astype(np.int64)])
    n = len(data)
    return (padded[:n] << 24) | (padded[1 : n + 1] << 16) | (padded[2 : n + 2] << 8) | padded[3:]


class Model:
    """Code lengths of all (state, byte, language), and the state after any three bytes."""

    def __init__(self, langs: Sequence[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = list(langs)
        seen = np.unique(np.concatenate([(gram >> s) & 255 for s in (0, 8, 16, 24)] + [np.array([0x20])]))
        self.size = size = len(seen) + 1  # symbol 0: a byte never seen in training
        self.symbol = np.zeros(256, dtype=np.int64)
        self.symbol[seen] = np.arange(1, size)
        b3, b2, b1, b0 = (self.symbol[(gram >> s) & 255] for s in (24, 16, 8, 0))
        cost = np.full((1, size, len(self.langs)), 8.0)
        contexts = [np.zeros(1, dtype=np.int64)]
        levels = []
        for depth in range(DEPTH + 1):
            code = [np.zeros_like(b0), b1, b2 * size + b1, (b3 * size + b2) * size + b1][depth]
            own = np.unique(code)
            if depth:
                cost = cost[np.searchsorted(contexts[-1], own % size ** (depth - 1))]
            contexts = [*contexts, own] if depth else [own]
            self._add(cost, own, code, b0, lang, n)
            levels.append(cost.astype(np.float32))
        self.table = np.concatenate(levels).reshape(-1, len(self.langs))
        first = np.cumsum([0] + [len(c) for c in contexts])
        every = np.arange(size**DEPTH)
        self.state = np.zeros(size**DEPTH, dtype=np.int32)
        for depth in range(1, DEPTH + 1):
            part = every % size**depth
            at = np.minimum(np.searchsorted(contexts[depth], part), len(contexts[depth]) - 1)
            known = contexts[depth][at] == part
            self.state[known] = (first[depth] + at[known]).astype(np.int32)

    def _add(self, cost, own, code, symbol, lang, n) -> None:
        """Put this depth's counts over the shorter contexts' costs, in place."""
        for k in range(len(self.langs)):
            mine = lang == k
            pair, where = np.unique(code[mine] * self.size + symbol[mine], return_inverse=True)
            count = np.bincount(where, weights=n[mine])
            context = np.searchsorted(own, pair // self.size)
            total = np.bincount(context, weights=count, minlength=len(own))
            distinct = np.bincount(context, minlength=len(own))
            known = total > 0
            both = total + distinct
            cost[known, :, k] += -np.log2(distinct[known] / both[known])[:, None]
            cost[context, pair % self.size, k] = -np.log2(count / both[context])

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of every text under every language."""
        parts = [plain_bytes(t) for t in texts]
        out = np.zeros((len(texts), len(self.langs)))
        k = 0
        while k < len(parts):
            end, held = k, 0
            while end < len(parts) and (end == k or held + len(parts[end]) <= CHUNK):
                held += len(parts[end])
                end += 1
            self._score(parts[k:end], out[k:end])
            k = end
        return out

    def _score(self, parts: list[np.ndarray], out: np.ndarray) -> None:
        pad = np.full(DEPTH, 0x20, dtype=np.uint8)
        s = self.symbol[np.concatenate([x for p in parts for x in (pad, p)])]
        ends = np.cumsum([len(p) + DEPTH for p in parts])
        # What follows three bytes that belong to this text and no other.
        for a in range(DEPTH, len(s), CHUNK):
            b = min(a + CHUNK, len(s))
            context = (s[a - 3 : b - 3] * self.size + s[a - 2 : b - 2]) * self.size + s[a - 1 : b - 1]
            bits = self.table[self.state[context] * np.int64(self.size) + s[a:b]]
            owner = np.searchsorted(ends, np.arange(a, b), side="right")
            start = ends[owner] - np.array([len(p) for p in parts])[owner]
            inside = np.arange(a, b) >= start
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(owner, weights=np.where(inside, bits[:, k], 0.0), minlength=len(parts))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Per text the language of shortest code (ties: first by name) and its posterior probability."""
        bits = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        odds = np.exp2(np.minimum(bits.min(axis=1)[:, None] - bits, 0.0)).sum(axis=1)
        return [
            (self.langs[b], float(1.0 / o)) if any(map(str.isalpha, t)) else (UNKNOWN, 0.0)
            for t, b, o in zip(texts, best, odds)
        ]


COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            found.setdefault(lang, []).append(_grams(plain_bytes(text)))
        for lang, grams in found.items():
            gram, n = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], schema=COUNTS
            )


def train(
    docs: DataFrame, where: Column, text_col: str = "text", lang_col: str = "lang", per_lang: int = 400
) -> Model | None:
    """Fit on about ``per_lang`` whole texts of each language among the rows of ``where``.

    ``per_lang`` bounds the sample (and so what the driver gets: the different four-byte strings
    of that many texts); rows are drawn by a hash of their text, so the sample is spread over the
    table and does not depend on its partitions. Rows without a language teach nothing; None if
    there is no row to learn from.
    """
    rows = docs.where(where).select(F.col(lang_col).alias("lang"), text_of(text_col).alias("text")).where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, v in sorted(sizes.items()) for x in (k, min(1.0, per_lang / v))])
    drawn = F.pmod(F.xxhash64("text", F.lit("draw")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    counts = rows.where(drawn).mapInArrow(_count, "lang string, gram bigint, n bigint")
    got = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return None
    place = {k: i for i, k in enumerate(langs)}
    lang = np.array([place[x] for x in got.column("lang").to_pylist()])
    return Model(langs, lang, got.column("gram").to_numpy(), got.column("n").to_numpy())


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = model.value.predict(part.column("text").to_pylist())
            found = {
                "doc_id": part.column("doc_id"),
                "held_out": part.column("held_out"),
                "lang_pred": pa.array([r[0] for r in rows], pa.string()),
                "score": pa.array([r[1] for r in rows], pa.float64()),
            }
            if "row" in part.schema.names:
                found["row"] = part.column("row")
            yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

    return run


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    folds: int = 5, per_lang: int = 400, carry: Sequence[str] = (),
) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row, and ``row``, a struct of the columns ``carry``.

    ``held_out`` rows (crc32 of the id modulo ``folds`` is 0) are never learnt from; only the text
    is looked at for a prediction. A text that is null or has no letter is ``und`` with score 0, as
    are all texts if there is nothing to learn from; others get a learned language. Ties go to the
    first name. Rows are treated one by one: repeated rows and null ids (never held out) stay,
    other columns are ignored, an empty table gives an empty one.
    """
    held_out = is_rest(id_col, folds, 0)
    model = train(docs, ~held_out, text_col, lang_col, per_lang)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), text_of(text_col).alias("text"), *carried(docs, carry))
    if model is None:
        unknown = rows.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
        return unknown.select("doc_id", "held_out", "lang_pred", "score", *(["row"] if carry else []))
    model = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(model), with_row(rows, "doc_id bigint, held_out boolean, lang_pred string, score double"))
