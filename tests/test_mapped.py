"""Business profiles beyond what the driver should hold: looked up in a file, the same rows."""

import pytest

from revloom.operators import mapped, profiles
from revloom.plans import queries

SF = "/root/testdata/sf0.001"


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lookup(spark):
    table = spark.createDataFrame([(7, [1.0, 2.0]), (-3, [3.0, 4.0]), (None, [0.0, 0.0]), (2**40, [5.0, 6.0]), (9, None)], "b bigint, v array<double>")
    path = mapped.write_vectors(table, "b", "v", 2)
    rows = spark.createDataFrame([("a", 7), ("b", None), ("c", 8), ("d", -3), ("e", 2**40), ("f", 2**41), ("g", -4), (None, 7)], "a string, b bigint")
    got = _sorted(mapped.attach_mapped(rows, "b", path, "w", 2))
    assert got == sorted([("a", 7, [1.0, 2.0]), ("d", -3, [3.0, 4.0]), ("e", 2**40, [5.0, 6.0]), (None, 7, [1.0, 2.0])], key=repr)
    empty = mapped.write_vectors(table.limit(0), "b", "v", 2)
    assert mapped.attach_mapped(rows, "b", empty, "w", 2).count() == 0
    assert not mapped.can_map(rows, "a", 1, 2) and mapped.can_map(rows, "b", 1, 2) and not mapped.can_map(rows, "b", 10**9, 2)


@pytest.mark.parametrize("name", ["q15_blend_v1", "q16_blend_v2", "q17_blend_v3", "q50_blended_reviews", "q30_lr_k"])
def test_large_profiles_do_not_pass_the_driver(spark, monkeypatch, name):
    key = ["review_id"] if name.startswith("q50") else ["user_id", "business_id"]
    want = queries.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    want = {tuple(r[c] for c in key): r for r in want.select(*columns).collect()}
    monkeypatch.setattr(profiles, "SENT_BYTES", 0)
    called, attach = [], profiles.attach_mapped
    monkeypatch.setattr(profiles, "attach_mapped", lambda *a: called.append(a) or attach(*a))
    got = {tuple(r[c] for c in key): r for r in queries.QUERIES[name](spark, SF).select(*columns).collect()}
    assert called and got.keys() == want.keys() and len(got) > 0
    assert all(abs(x - y) < 1e-4 for k, r in got.items() for x, y in zip(r, want[k]) if isinstance(x, float))


def test_other_keys_are_joined(spark, monkeypatch):
    monkeypatch.setattr(profiles, "SENT_BYTES", 0)
    vectors = spark.createDataFrame([(i % 3, f"b{i % 4}", [1.0, i / 9]) for i in range(20)], "user_id bigint, business_id string, features array<double>")
    pairs = vectors.select("user_id", "business_id").distinct()
    assert profiles.blend_pairs(pairs, vectors, "mean", 2).count() == 12
