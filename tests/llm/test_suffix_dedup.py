"""Repeated passages against brute force over all windows."""

import hashlib
import random

import duckdb
import pytest

from revloom.llm import suffix_dedup

SCHEMA = "doc_id bigint, text string, doc string, spans int"


def brute(docs: list[tuple], length: int) -> list[tuple]:
    """Windows in order of (id, null first); repeated rows of one text are one document."""
    order = sorted({(-(2**63) if i is None else i, t or "") for i, t in docs})
    seen, result = set(), {}
    for i, t in order:
        data = t.encode()
        hit = bytearray(len(data))
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                hit[k : k + length] = b"\1" * length
            seen.add(window)
        rest = bytes(b for b, h in zip(data, hit) if not h)
        spans = sum(1 for k, h in enumerate(hit) if h and not (k and hit[k - 1]))
        result[i, t] = (len(data), sum(hit), spans, hashlib.sha256(rest).hexdigest())
    return sorted((str(i), *result[-(2**63) if i is None else i, t or ""]) for i, t in docs)


def found(spark, docs, length, partitions=3):
    rows = [(i, t, "clash", 0) for i, t in docs]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = suffix_dedup.remove_repeats(df, length=length).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), got


def made(seed: int, n: int, letters: str) -> list[tuple]:
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(50, 700))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(1, 4)):
            b = r.choice(base)
            a = r.randrange(len(b))
            piece = b[a : a + r.randint(1, 500)]
            if r.random() < 0.3 and piece:
                k = r.randrange(len(piece))
                piece = piece[:k] + r.choice(letters) + piece[k + 1 :]
            parts += [piece, "".join(r.choice(letters) for _ in range(r.randint(0, 60)))]
        docs.append((i, "".join(parts)))
    return docs


@pytest.mark.parametrize("seed,letters,length", [(1, "abcdefgh é", 100), (2, "ab", 60), (3, "xyz🙂ü ", 40)])
def test_equals_brute_force(spark, seed, letters, length):
    docs = made(seed, 40, letters)
    r = random.Random(seed)
    r.shuffle(docs)
    assert found(spark, docs, length)[0] == brute(docs, length)


def test_odd_rows(spark):
    passage = "The same passage of well over a hundred bytes, which is told in several of these texts and found again. " * 2
    docs = [
        (1, None), (2, ""), (3, "short"), (4, "a" * 5000), (5, passage), (5, passage), (10, "other " + passage),
        (None, passage[:150]), (6, "ab" * 400), (7, passage), (8, "a" * 100), (9, "\n" * 300),
    ]
    same, rows = found(spark, docs, 100)
    assert same == brute(docs, 100)
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_texts_of_one_id_are_ordered(spark):
    a, b = "x" + "pq" * 80, "other " + "x" + "pq" * 80
    same, _ = found(spark, [(5, a), (5, b)], 100)
    either = [brute([(1, x), (2, y)], 100) for x, y in ((a, b), (b, a))]
    assert sorted(r[1:] for r in same) in [sorted(r[1:] for r in e) for e in either]


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents(spark):
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    same, _ = found(spark, docs, 100)
    assert same == brute(docs, 100)


def test_index_marks_all_but_the_first_of_each_context():
    r = random.Random(7)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(5, 60))).encode() for _ in range(30)]
    index = suffix_dedup.RunLengthIndex(texts, 7)
    seen, want, at = set(), [], 0
    for t in texts:
        for k in range(len(t) - 6):
            if t[k : k + 7] in seen:
                want.append(at + k)
            seen.add(t[k : k + 7])
        at += len(t)
    assert index.earlier().tolist() == want
    assert len(index.run_first) < len(index.order)
