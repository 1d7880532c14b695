"""Revisits against a plain search, and their rules."""

import random

import oracle
import pytest
from pyspark.sql import functions as F

from leafmill.llm import warc

SCHEMA = "record_id long, kind string, url string, ts long, status int, headers map<string,string>"


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTP://www.Example.com:80/a/?utm_source=x#top", "example.com/a"),
        ("https://m.example.com/a?b=2&a=1&ref=z", "example.com/a?a=1&b=2"),
        ("http://user:pw@example.com:8080/", "example.com:8080"),
        ("https://example.com/A%20b//", "example.com/A%20b"),
        ("", ""),
        ("not a url", "not a url"),
        ("http://www3.example.com?x=1", "example.com?x=1"),
    ],
)
def test_canonical(spark, url, expected):
    assert spark.range(1).select(warc.canonical(F.lit(url)).alias("c")).first()["c"] == expected


def test_as_of_join_is_the_search(spark):
    random.seed(6)
    rows = []
    for i in range(600):
        url = random.choice(["http://hot.example/", "http://hot.example/", f"http://x{random.randint(0, 30)}.example/"])
        kind = random.choice(["response", "revisit"])
        headers = random.choice([{"ETag": str(random.randint(0, 2))}, {"Last-Modified": "d"}, {}, None])
        rows.append((i, kind, url, random.choice([None, *range(0, 4000, 7)]), 200 if kind == "revisit" or random.random() < 0.8 else 404, headers))
    expected = {}
    for i, kind, url, ts, _, headers in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[1] == "response" and r[4] == 200 and r[2] == url and ts is not None and r[3] is not None and r[3] < ts]
        best = max(before, key=lambda r: (r[3], r[0]), default=None)
        h, theirs = headers or {}, (best[5] or {}) if best else {}
        outcome = "no_earlier" if best is None else "unchecked" if not h else "resolved" if all(theirs.get(k) == v for k, v in h.items()) else "mismatch"
        expected[i] = (outcome, best and best[0])
    df = spark.createDataFrame(rows, SCHEMA)
    for slices in (1, 7, 256):
        got = {r["record_id"]: (r["outcome"], r["response_id"]) for r in warc.resolve(df, slices).collect()}
        assert got == expected
    far = df.union(spark.createDataFrame([(9000, "response", "http://far.example/", 10**15, 200, None), (9001, "response", "http://far.example/", -(10**15), 200, None)], SCHEMA))
    got = {r["record_id"]: (r["outcome"], r["response_id"]) for r in warc.resolve(far, 16).collect()}
    assert got == expected
    held = far.withColumn("slice", warc.slice_of(far, 16)).where("abs(ts) < 10000").groupBy("slice").count().collect()
    assert len(held) > 10 and max(r["count"] for r in held) < 120  # far-off times spoil no other slice


def test_headers_merge(spark):
    stored = {"ETag": '"a"', "Content-Length": "5", "Content-Type": "text/html", "Cache-Control": "old", "X-Keep": "1"}
    update = {"etag": 'W/"a"', "content-length": "0", "Cache-Control": "new", "Connection": "close, X-Gone", "X-Gone": "1", "Expires": "soon"}
    df = spark.createDataFrame([(1, "response", "http://a/", 1, 200, stored), (2, "revisit", "https://a", 2, 304, update)], SCHEMA)
    r = warc.resolve(df).first()
    assert r["outcome"] == "resolved"
    assert r["headers"] == {"etag": 'W/"a"', "content-length": "5", "content-type": "text/html", "cache-control": "new", "x-keep": "1", "expires": "soon"}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "response", None, 1, 200, None), (2, "revisit", None, 2, 304, {"etag": "x"}), (3, "revisit", "http://a/", None, 304, None), (3, "revisit", "http://a/", None, 304, None), (4, "response", "http://a/", 0, 200, {"A": "1", "a": "2"}), (5, "revisit", "http://a/", 9, 304, {"A": "1", "a": "2"})], SCHEMA).withColumn("outcome", F.lit(1))
    got = sorted((r["record_id"], r["outcome"], r["response_id"] or 0) for r in warc.resolve(df).collect())
    assert got == [(2, "no_earlier", 0), (3, "no_earlier", 0), (3, "no_earlier", 0), (5, "unchecked", 4)]
    assert warc.resolve(df.limit(0)).count() == 0


def test_query_equals_sql(spark, sf):
    assert oracle.by_spark(warc.query(spark, sf)) == oracle.by_sql(warc.SQL, sf)
    assert {r["outcome"] for r in warc.query(spark, sf).collect()} == {"resolved", "no_earlier", "mismatch"}
