import json

from revloom import sources
from revloom.operators.relational import complete_cases, rename
from revloom.session import checkpoint_dir, pin, scratch_path

REVIEW = {
    "review_id": "r1",
    "user_id": "u1",
    "business_id": "b1",
    "stars": 3,
    "date": "2014-02-21",
    "text": "line\nbreak",
    "useful": 2,
    "funny": 0,
    "cool": 1,
}


def test_reviews_in_lines_and_over_lines(spark, tmp_path):
    (tmp_path / "lines.json").write_text(json.dumps(REVIEW) + "\n" + json.dumps({"review_id": "r2"}) + "\n")
    (tmp_path / "wide.json").write_text(json.dumps(REVIEW, indent=1))
    rows = sources.read_reviews(spark, str(tmp_path / "lines.json"), partitions=2).orderBy("review_id").collect()
    assert rows[0].asDict() == REVIEW and rows[1].stars is None
    wide = sources.read_reviews(spark, str(tmp_path / "wide.json"), multi_line=True)
    assert wide.first().asDict() == REVIEW


def test_users_and_businesses(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps({"user_id": "u", "friends": ["a", "b"], "compliment_cool": 2}))
    user = sources.read_users(spark, str(tmp_path / "u.json")).first()
    assert user.friends == ["a", "b"] and user.compliment_cool == 2 and user.elite is None
    (tmp_path / "b.json").write_text(json.dumps({"business_id": "b", "latitude": 1.5, "attributes": {"Parking": "x"}}))
    shop = sources.read_businesses(spark, str(tmp_path / "b.json")).first()
    assert shop.latitude == 1.5 and shop.attributes == {"Parking": "x"}


def test_edges_are_whole_numbers_split_by_a_space(spark, tmp_path):
    edges = spark.createDataFrame([(12, 3), (4, 5)], "src bigint, dst bigint").repartition(2)
    sources.write_edges(edges, str(tmp_path / "e"))
    assert sorted(r.value for r in sources.read_lines(spark, str(tmp_path / "e")).collect()) == ["12 3", "4 5"]
    sources.write_edges(edges, str(tmp_path / "one"), single_file=True)
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1


def test_settings_are_partition_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 20, 5), (2, 40, 5)], "x bigint, k int, c int")
    sources.write_table(df, path, ["k", "c"])
    assert [r.x for r in sources.read_table(spark, path).where("k = 40").collect()] == [2]
    assert (tmp_path / "t" / "k=20" / "c=5").is_dir()


def test_metrics_log_grows(spark, tmp_path):
    path = str(tmp_path / "m")
    row = spark.createDataFrame([("a", 1.0)], "metric string, value double")
    sources.append_metrics(row, path)
    sources.append_metrics(row, path)
    assert sources.read_table(spark, path).count() == 2


def test_pin_uses_the_checkpoint_folder(spark):
    df = pin(spark.range(10))
    assert all(checkpoint_dir(spark).split(":")[-1] in f for f in df.inputFiles())
    assert scratch_path(spark, "x") != scratch_path(spark, "x")



def test_rename_and_complete_cases(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "stars int, v string")
    assert rename(df, label="stars").columns == ["label"]
    assert [r.stars for r in complete_cases(df).collect()] == [2]
    assert complete_cases(df, ["stars"]).count() == 2


def _numbered(spark, path, **conf):
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return sorted((r.line_id, r.value) for r in sources.read_numbered_lines(spark, path).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lines_keep_their_numbers_however_files_are_split(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 70) for i in range(3000)]
    lines[5] = lines[2000] = ""
    for name, part in (("a", lines[:1000]), ("b", lines[1000:1001]), ("c", lines[1001:])):
        (tmp_path / f"{name}.txt").write_text("\n".join(part) + "\n")
    want = [(i + 1, x) for i, x in enumerate(lines)]
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    assert _numbered(spark, str(tmp_path)) == want
    small = {size: "10000", cost: "0"}
    assert _numbered(spark, str(tmp_path), **small) == want
    assert _numbered(spark, str(tmp_path / "c.txt"), **small) == [(i + 1, x) for i, x in enumerate(lines[1001:])]
    spark.conf.set(size, "10000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset(size)
    (tmp_path / "none").mkdir()
    assert _numbered(spark, str(tmp_path / "none")) == []


def test_whole_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "n": 2, "odd": null}\n{"id": "2", "n": 3, "odd": {"x": 1}}\n\n{"id": "3", "n"\n')
    (tmp_path / "b.json").write_text('{"id": "4", "n": "many", "odd": {"x": 2}}\n[1]\nnone\n{"id": "5", "n": 1, "odd": {"y": 2}, "late": 1}\n')
    records, malformed = sources.read_whole_records(spark, str(tmp_path), "id string, n bigint")
    assert records.columns == ["id", "n", "late", "odd"]
    assert sorted((r.id, r.n, r.late) for r in records.collect()) == [("1", 2, None), ("2", 3, None), ("5", 1, 1)]
    assert [r.id for r in complete_cases(records).collect()] == ["5"]
    assert malformed.count() == 4 and {r.value[:5] for r in malformed.collect()} == {'{"id"', "[1]", "none"}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "c.json").write_text('[{"id": "1",\n "n": 2, "odd": 1}, {"id": "2", "n": 3}]')
    (tmp_path / "m" / "d.json").write_text('{"id": "1",\n')
    records, malformed = sources.read_whole_records(spark, str(tmp_path / "m"), "id string, n bigint", multi_line=True)
    assert sorted((r.id, r.n, r.odd) for r in records.collect()) == [("1", 2, 1), ("2", 3, None)] and malformed.count() == 1
