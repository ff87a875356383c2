import os

import duckdb
import pytest
from pyspark.sql import functions as F

from matchloom.llm import queries, warc

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "id string, type string, url string, time long, status int, headers map<string,string>, digest string, payload string"


def resolve(spark, rows):
    records = spark.createDataFrame(rows, SCHEMA).withColumn("time", F.timestamp_seconds("time"))
    return records, {r.id: r for r in warc.resolve_revisits(records).collect()}


def test_canonical_url(spark):
    cases = {
        "HTTP://www.Example.com:80/A/b/?b=2&utm_source=x&a=1#top": "example.com/A/b?a=1&b=2",
        "https://m.example.com/A/b?a=1&b=2&gclid=9": "example.com/A/b?a=1&b=2",
        "https://user:pw@www2.example.com": "example.com",
        "http://example.com:8080/": "example.com:8080",
        "": "",
    }
    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "u string")
    got = {r.u: r.c for r in df.select("u", warc.canonical_url(F.col("u")).alias("c")).collect()}
    assert got == cases | {None: None}


def test_parse_records(spark):
    text = "WARC/1.1\r\nWARC-Type: revisit\r\nwarc-date: 2024-02-03T04:05:06Z\r\nWARC-Target-URI: http://a.b/c:d\r\n\r\nHTTP/1.1 304 Not Modified\r\nETag: \"x\"\r\nX: 1\r\nX: 2\r\n\r\n"
    full = "WARC/1.0\nWARC-Type: response\n\nHTTP/1.1 200 OK\nA: b\n\nbody\n\nmore"
    df = spark.createDataFrame([(1, text, "w"), (2, full, "w"), (3, None, "w"), (4, "", "w"), (5, "no record", "w"), (6, "WARC/1.1", "w")], "n int, record string, warc string")
    result = warc.parse_records(df, "record", "parsed")
    got = {r.n: r.parsed for r in result.collect()}
    assert got[1].type == "revisit" and got[1].url == "http://a.b/c:d" and got[1].status == 304 and got[1].payload == ""
    assert got[1].headers == {"etag": '"x"', "x": "1"} and got[1].time.isoformat().endswith("04:05:06")
    assert got[2].payload == "body\n\nmore" and got[2].headers == {"a": "b"}
    assert all(got[n].type is None and got[n].payload is None for n in (3, 4, 5, 6))


def test_revisits(spark):
    old = {"etag": '"1"', "content-length": "4", "date": "then"}
    rows = [
        ("a", "response", "http://x/p", 10, 200, old, None, "body"),
        ("b", "response", "http://x/p", 20, 200, {"etag": '"2"', "last-modified": "mon"}, "d2", "new"),
        ("c", "response", "http://x/p", 25, 206, {"etag": '"9"'}, None, "part"),
        ("early", "revisit", "http://x/p", 10, 304, {"etag": '"1"'}, None, None),
        ("one", "revisit", "https://www.x/p#f", 15, 304, {"etag": 'W/"1"', "date": "now", "content-length": "0", "vary": "a"}, None, None),
        ("two", "revisit", "http://x/p/", 30, 304, {"last-modified": "mon"}, "d2", None),
        ("bad", "revisit", "http://x/p", 31, 304, {"etag": '"2"', "last-modified": "tue"}, None, None),
        ("none", "revisit", "http://x/p", 32, 304, None, None, None),
        ("other", "revisit", "http://y/p", 32, 304, {"etag": '"2"'}, None, None),
        ("timeless", "revisit", "http://x/p", None, 304, None, None, None),
        ("nowhere", "revisit", None, 5, 304, None, None, None),
    ]
    records, got = resolve(spark, rows)
    outcome = {k: (r.refers_to, r.outcome, r.payload) for k, r in got.items()}
    assert outcome == {
        "early": ("a", "resolved", "body") if outcome["early"][0] else (None, "missing", None),
        "one": ("a", "resolved", "body"), "two": ("b", "resolved", "new"), "bad": ("b", "mismatch", None), "none": ("b", "unverified", "new"),
        "other": (None, "missing", None), "timeless": (None, "missing", None), "nowhere": (None, "missing", None),
    }
    assert got["one"].headers == {"etag": 'W/"1"', "date": "now", "content-length": "4", "vary": "a"}
    assert got["none"].headers == {"etag": '"2"', "last-modified": "mon"}
    assert warc.resolve_revisits(records.limit(0)).count() == 0


def test_hot_url_over_slices(spark):
    events = [("hot", t, t, t % 7 == 0) for t in range(3000)] + [("cold", t, 10_000 + t, t == 5) for t in range(10)]
    got = {r.uid: r.found for r in warc.latest_before(spark.createDataFrame(events, "url string, time long, uid long, full boolean")).collect()}
    assert len(got) == len(events)
    for _, t, uid, _ in events[:3000]:
        assert got[uid] == ((t - 1) // 7 * 7 if t else None)
    assert [got[10_000 + t] for t in range(10)] == [None] * 6 + [10_005] * 4


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not found")
def test_query_equals_sql(spark):
    twin = duckdb.connect()
    twin.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{FOLDER}/pages.parquet')")
    result = queries.QUERIES["op5_revisit_resolution"](spark, FOLDER)
    want = twin.execute(queries.ORACLES["op5_revisit_resolution"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(result.columns)
    assert sorted(map(str, (tuple(r) for r in result.select(*names).collect()))) == sorted(map(str, want.fetchall()))
