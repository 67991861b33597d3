"""Archives against plain Python: written files read by gzip alone, index against a scan."""

import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from revloom.llm import queries, warc

SCHEMA = "page_id bigint, url string, html string, key string, digest string, file int, id string, size string"
BIG = "<p>shared passage</p>" * 60


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "k", "d", 1, "i", "s") for r in rows], SCHEMA).repartition(partitions)


def brute(rows):
    payloads = [(i, (t or "").encode()) for i, _, t in rows]
    out = []
    for i, p in payloads:
        ids = [j for j, q in payloads if q == p and j is not None]
        again = len(p) >= 1000 and ids and i != max(ids)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [
    (1, "http://a.example.com/x", BIG), (2, None, BIG), (3, "http://a.example.com/x", BIG + "!"), (4, "not a url\r\nX: y\t", None), (5, "", ""),
    (6, "https://user:pw@B.example.com:8080/q?a=1#top", "ü" * 400_000), (None, "http://c.example.com", BIG), (None, None, "null " * 300),
    (None, "http://d.example.com", "null " * 300), (2, None, BIG), (2, "http://e.example.com", BIG + "!"), (7, "http://a.example.com/x", "short"),
    (8, "http://é.example.com/ü?z=\"1\"", BIG), (8, "http://é.example.com/ü?z=\"1\"", BIG), (9, "http://f.example.com", "short"),
]


def test_odd_rows_and_ties(spark):
    assert got(warc.read_back(warc.archive(frame(spark, ODD)))) == brute(ODD)


def test_large_groups_of_copies_over_many_files_and_blocks(spark):
    rows = [(i, f"http://h{i % 7}.example.com/{i % 40}", BIG if i % 3 else f"{i % 50} " * 500) for i in range(600)]
    folder = warc.scratch_path(spark, "warc")
    captures = warc.write_archives(frame(spark, rows), folder, file_bytes=2000)
    index = warc.build_index(captures, folder, block_lines=7)
    assert got(warc.read_back(index)) == brute(rows)
    lines = [tuple(r) for r in captures.collect()]
    assert len({r[4] for r in lines}) > 20
    # The index holds the same lines, in order over its files.
    files = index.files
    assert files == sorted(files, key=warc._place) and len(files) > 1
    assert sorted(tuple(r) for r in index.captures().collect()) == sorted(lines)
    # By URL: as a scan finds them, whichever blocks they are in.
    wanted = ["com,example,h3)/3", "com,example,h0)/0", "com,example,h9)/1", "", "zz"]
    found = index.find(spark.createDataFrame([(k,) for k in wanted], "key string"), exact=False).collect()
    assert sorted(map(tuple, found)) == sorted(r for r in lines if r[0] in wanted) and len(found) > 1


def test_files_are_archives(spark):
    rows = ODD[:6]
    lines = warc.write_archives(frame(spark, rows, 1), warc.scratch_path(spark, "warc")).collect()
    payloads, kinds = {}, []
    for path in {r.file for r in lines}:
        data = gzip.open(re.sub("^file:/+", "/", path)).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            if kinds[-1] == "response":
                payloads[warc.page_of(fields["WARC-Record-ID"])] = rest[:n].partition(b"\r\n\r\n")[2].decode()
            data = rest[n + 4 :]
    assert kinds.count("response") == 5 and kinds.count("revisit") == 1 and kinds.count("warcinfo") == len({r.file for r in lines})
    assert payloads == {i: t or "" for i, _, t in rows if i != 1}


def test_records_with_payloads(spark):
    index = warc.archive(frame(spark, ODD[:6]))
    read = {r.page_id: r for r in warc.read_records(index.captures(), index.tasks()).collect()}
    assert read[6].payload.decode() == "ü" * 400_000 and read[1].payload is None and read[1].kind == "revisit" and read[1].refers_to == 2
    assert read[4].url == "not%20a%20url%0D%0AX:%20y%09" and read[2].url is None


def test_keys(spark):
    urls = {
        "http://Blog.Example.NET/en/9?b=2#top": "net,example,blog)/en/9?b=2", "https://example.org": "org,example)/",
        "http://example.org:80/": "org,example)/", "http://me@example.org:81?q": "org,example:81)/?q", "nothing": "nothing", None: "",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.key for r in df.select("url", warc.surt(F.col("url")).alias("key")).collect()} == urls


def test_damaged_records_end_the_job():
    good = warc.response(1, "http://a", hashlib.sha1(b"x").hexdigest(), b"x")
    assert warc.payload_of(warc.parse(good)[1]) == b"x"
    with pytest.raises(Exception):
        warc.parse(good[:-3])
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(gzip.decompress(good).replace(b"x\r\n\r\n", b"xy\r\n\r\n")))


def test_empty_table(spark):
    index = warc.archive(frame(spark, []))
    assert index.files == [] and warc.read_back(index).count() == 0
    assert index.find(spark.createDataFrame([("a",)], "key string"), exact=False).count() == 0


def test_pages(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert got(queries.op13_warc(spark, sf)) == brute(rows)
