"""From record files to metrics on a small made-up town."""

import json
import random

from pyspark.ml.regression import LinearRegressionModel

from revloom import Pipeline
from revloom.operators.regression import linear_regression, random_forest
from revloom.plans.sweep import RIDGE
from revloom.sources.schemas import COMPLIMENTS

WORDS = "soup bread good bad warm cold slow quick table waiter".split()


def _write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def _town(tmp_path):
    rng = random.Random(5)
    users = [
        {
            "user_id": f"u{i}",
            "name": f"n{i}",
            "review_count": 30 + i,
            "friends": [f"u{j}" for j in range(24) if j != i and (i % 2 == j % 2 or rng.random() < 0.05)],
            "yelping_since": "2015-05-05",
            "fans": i,
            "elite": ["2018"] * (i % 3),
            "average_stars": 3.0,
            **{c: i % 4 for c in COMPLIMENTS},
        }
        for i in range(24)
    ]
    shops = [
        {
            "business_id": f"b{i}",
            "name": "n",
            "city": "c",
            "state": "s",
            "latitude": 40.0 + (50 if i == 7 else 0),
            "longitude": 5.0,
            "stars": 3.0,
            "review_count": 200,
            "is_open": 1,
            "categories": "x",
            "attributes": {"a": "b"},
        }
        for i in range(8)
    ]
    reviews = [
        {
            "review_id": f"r{i}",
            "user_id": f"u{rng.randrange(24)}",
            "business_id": f"b{rng.randrange(8)}",
            "stars": rng.randrange(1, 6),
            "date": f"2019-0{1 + i % 9}-11",
            "text": " ".join(rng.choice(WORDS) for _ in range(12)) + " <br> The 3!",
            "useful": 1,
            "funny": 0,
            "cool": 2,
        }
        for i in range(600)
    ]
    return (
        _write(tmp_path / "user.json", users),
        _write(tmp_path / "business.json", shops),
        _write(tmp_path / "review.json", reviews),
    )


def test_pipeline(spark, tmp_path):
    user_file, business_file, review_file = _town(tmp_path)
    run = Pipeline(spark, str(tmp_path / "out"))
    run.users(user_file, "2020-01-01", edge_lists=(40,))
    assert run.table("users").count() == 24
    run.businesses(business_file)
    assert {r.business_id for r in run.table("businesses").collect()} == {f"b{i}" for i in range(7)}
    run.reviews(review_file, min_user=30, min_business=100)
    rows = run.table("reviews")
    assert 400 < rows.count() < 600 and rows.where("votes = 3").count() == rows.count()
    run.tokens()
    run.vectors([4], min_count=2)
    assert run.review_vectors(4).count() == rows.count()
    run.blends(4)
    assert run.table("blended").where("mode = 'l2sum' and k = 4").count() == rows.count()
    run.communities(2, min_reviews=0, rounds=5)
    (tmp_path / "lines.txt").write_text("0\t1\t2\t3\t4\t\n" + "\t".join(str(i) for i in range(24)) + "\n")
    run.communities(9, lines=str(tmp_path / "lines.txt"))
    assert run.membership(9).count() == 29 and run.membership(2).count() > 0
    metrics = run.experiment([4], [None, 9], {"linear": RIDGE}, by="user_date").collect()
    assert len(metrics) == 6 and run.table("metrics").count() == 6
    kept = run.table("predictions")
    assert {(r.run_id, r.k, r.c, r.model) for r in kept.select("run_id", "k", "c", "model").distinct().collect()} == {
        ("run", 4, 0, "linear"), ("run", 4, 9, "linear")
    }
    summary = spark.read.option("header", True).csv(str(tmp_path / "out/summaries/run_id=run/k=4/c=0/model=linear"))
    assert summary.count() == 15
    honest = run.experiment([4], [None], {"linear": RIDGE}, by="user_date", run_id="honest", profile_from="train").collect()
    assert len(honest) == 3 and run.table("metrics").count() == 9
    run.save_global(4, linear_regression(), "lr", by="user_date")
    scored = run.score_global(4, LinearRegressionModel, "lr", by="user_date")
    want = kept.where("run_id = 'run' and c = 0").select(*scored.columns)
    assert scored.count() == want.count() > 50
    both = scored.alias("a").join(want.alias("b"), ["user_id", "business_id"])
    assert both.where("abs(a.prediction - b.prediction) > 1e-6").isEmpty() and both.count() == want.count()
    assert run.table("model_reports").where("run_id = 'lr_k4' and parameter = 'coefficient'").count() == 4
    assert run.save_models(4, 9, random_forest(2, 2)) == [1, 2]
    assert run.table("model_reports").where("text = 'variance'").count() == 2


def test_records_that_span_lines(spark, tmp_path):
    user_file, business_file, _ = _town(tmp_path)
    for name, file in (("users", user_file), ("shops", business_file)):
        records = [json.loads(line) for line in open(file)]
        (tmp_path / f"{name}.json").write_text(json.dumps(records, indent=1))
    one, other = Pipeline(spark, str(tmp_path / "one")), Pipeline(spark, str(tmp_path / "other"))
    one.users(user_file, "2020-01-01", edge_lists=())
    one.businesses(business_file)
    other.users(str(tmp_path / "users.json"), "2020-01-01", edge_lists=(), multi_line=True)
    other.businesses(str(tmp_path / "shops.json"), multi_line=True)
    for name, key in (("users", "user_id"), ("businesses", "business_id")):
        a, b = (sorted((r.asDict() for r in p.table(name).collect()), key=lambda r: str(r[key])) for p in (one, other))
        assert a == b and a
