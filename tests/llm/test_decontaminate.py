"""Benchmark passages: planted, substituted, short and odd ones."""

import random
from itertools import combinations

import pytest

from revloom.llm import decontaminate

DOCS = "doc_id bigint, text string, item_id int, words string"
ITEMS = "item_id bigint, text string, doc_id string"


def words(r, n):
    return [f"v{r.randrange(5000)}" for _ in range(n)]


def found(spark, docs, items):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], DOCS).repartition(3)
    got = decontaminate.decontaminate(df, spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS))
    assert got.columns == ["doc_id", "n_items", "item_ids", "share", "contaminated"]
    rows = got.collect()
    assert all(r.n_items == len(r.item_ids) and r.contaminated == (r.n_items > 0) and (r.share >= 80) == r.contaminated for r in rows)
    return sorted(((r.doc_id, list(r.item_ids)) for r in rows), key=str)


def test_planted_passages(spark):
    r = random.Random(4)
    items = [(k, words(r, n)) for k, n in enumerate([5, 6, 7, 9, 15, 30, 60, 200])]
    docs, want = [], []
    for k, item in items:
        changed = list(item)
        for j in range(4, len(changed), 6):  # every sixth word is another
            changed[j] = "other"
        far = [w if j % 2 else "other" for j, w in enumerate(item)]
        for kind, body in (("same", item), ("changed", changed if len(item) >= 9 else item), ("far", far), ("none", words(r, 40))):
            text = " ".join(words(r, 50) + body + words(r, 30))
            docs.append((len(docs), text.upper() if kind == "same" else text))
            want.append((len(want), [k] if kind in ("same", "changed") else []))
    docs.append((len(docs), " ".join(items[5][1] + ["x"] + items[7][1][100:130])))
    want.append((len(want), [5, 7]))
    assert found(spark, docs, [(k, " ".join(i)) for k, i in items]) == sorted(want, key=str)


@pytest.mark.parametrize("n", range(1, 21))
def test_masks_leave_no_permitted_pattern_out(n):
    masks = [m for m, k in decontaminate._masks([n] if n <= decontaminate.SHORT else []) if k == (n if n <= decontaminate.SHORT else 0)]
    for changed in combinations(range(n), n // 5):
        hits = (not any(m[j] == "1" and i + j in changed for j in range(len(m))) for m in masks for i in range(n - len(m) + 1))
        assert any(hits), changed


def brute(docs, items):
    """Items by the rule alone, at every alignment."""
    out = []
    for i, text in docs:
        words, ids = (text or "").lower().split(), []
        for k, item in items:
            item, best = item.lower().split(), 0
            width = min(20, len(item))
            for d in range(-len(item), len(words) + 1):
                equal = [0 <= j + d < len(words) and words[j + d] == w for j, w in enumerate(item)]
                best = max(best, *(100 * sum(equal[s : s + width]) / width for s in range(len(item) - width + 1)))
            ids += [k] * (best >= 80)
        out.append((i, ids))
    return sorted(out, key=str)


def test_items_of_every_length_against_the_rule(spark):
    """Substituted, cut at either end of the document, or too far from the item."""
    r = random.Random(8)
    items = [(n, words(r, n)) for n in range(1, 24)]
    docs = [(1000, "the capital of france is here"), (1001, "capital of spain"), (1002, "v")]
    for n, item in items:
        for more in (0, 0, 1, 2):
            body = list(item)
            for j in r.sample(range(n), min(n, min(20, n) // 5 + more // 2)):
                body[j] = "other"
            cut = r.randrange(3)
            before, after = ([], words(r, 9)) if cut == 1 else (words(r, 9), [] if cut == 2 else words(r, 5))
            body = body[n // 5 :] if cut == 1 and more else body[: n - n // 5] if cut == 2 and more else body
            docs.append((len(docs), " ".join(before + body + after)))
    named = [(k, " ".join(i)) for k, i in items] + [(50, "Capital of France")]
    want = brute(docs, named)
    assert sum(map(len, (ids for _, ids in want))) > 46 and (1000, [50]) in want and (1001, []) in want
    assert found(spark, docs, named) == want


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, "a b"), (4, passage), (4, passage), (None, f"x {passage}"), (5, "w " * 50_000 + passage)]
    items = [(9, passage), (9, passage), (8, None), (7, ""), (6, "too short"), (None, passage), (2, passage)]
    want = [(1, []), (2, []), (3, []), (4, [2, 9]), (4, [2, 9]), (None, [2, 9]), (5, [2, 9])]
    assert found(spark, docs, items) == sorted(want, key=str)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c d e f g h")]) == []
    assert found(spark, [(1, "a b c d e f g h")], []) == [(1, [])]


def test_a_large_benchmark_is_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 3)
    passage = "one two three four five six seven eight nine ten"
    assert found(spark, [(1, passage), (2, "no")], [(3, passage)]) == [(1, [3]), (2, [])]


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", 0, "x")], DOCS)
    plan = decontaminate.decontaminate(docs, spark.createDataFrame([(1, "a b c d e f g h i j", "x")], ITEMS))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
