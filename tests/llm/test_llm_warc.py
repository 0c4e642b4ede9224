"""Revisit resolution against brute force and SQL."""

import random

import pytest
from conftest import DATA, compare
from llm_cases import with_clashes
from pyspark.sql import functions as F

from convolens.llm import warc
from convolens.llm.queries import ORACLE_SQL, QUERIES

RECORDS = "record_id long, kind string, url string, time long, headers map<string,string>"


def expected(rows, canonical):
    out = []
    for rid, kind, url, time, headers in rows:
        if kind != "revisit":
            continue
        own = {k: v for k, v in (headers or {}).items()}
        earlier = [(t, i, h) for i, k, u, t, h in rows if k == "response" and None not in (u, t, url, time) and canonical[u] == canonical[url] and t < time]
        if not earlier:
            out.append((rid, "missing", None, None))
            continue
        _, found, stored = max(earlier, key=lambda x: x[:2])
        stored = stored or {}
        weak = lambda x: x.removeprefix("W/") if x is not None else None
        status = "unverified"
        for name in ("etag", "last-modified"):
            if own.get(name) is not None:
                status = "resolved" if weak(own[name]) == weak(stored.get(name)) else "mismatch"
                break
        if status == "mismatch":
            out.append((rid, status, None, None))
        else:
            merged = stored | {k: v for k, v in own.items() if k in warc.PERMITTED and v is not None}
            out.append((rid, status, found, "\n".join(sorted(f"{k}: {v}" for k, v in merged.items() if v is not None))))
    return out


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_against_brute_force(spark, buckets):
    rng = random.Random(11)
    urls = ["http://a.example/x", "https://WWW.a.example:443/x/#f", "http://a.example/x?utm_source=1", "http://b.example/?q=1&a=2", "http://b.example?a=2&q=1", "", None]
    rows = []
    for k in range(300):
        headers = {"etag": f'"{rng.randrange(3)}"', "age": "1"} if rng.random() < 0.6 else {"last-modified": f"d{rng.randrange(3)}", "x-own": "y"}
        if rng.random() < 0.2:
            headers["etag"] = 'W/"1"'
        rows.append((k, rng.choice(["response", "revisit", "other"]), rng.choice([*urls, urls[0], urls[0]]), rng.choice([None, *range(60)]), rng.choice([headers, headers, headers, {"date": "d", "etag": None}, None])))
    rows += [rows[3], rows[4]]
    rows.append((999, None, None, None, None))
    df = with_clashes(spark.createDataFrame(rows, RECORDS))
    canonical = {r["url"]: r["c"] for r in df.select("url", warc.canonical_url(F.col("url")).alias("c")).distinct().collect()}
    got = [(r["record_id"], r["status"], r["response_id"], r["headers"]) for r in warc.resolve(df, buckets).collect()]
    assert ordered(got) == ordered(expected(rows, canonical))


def test_canonical_urls(spark):
    same = ["http://a.example/p", "HTTPS://u:p@WWW.A.example:80/p/#x", "a.example/p?utm_medium=z&ref=1&fbclid"]
    df = spark.createDataFrame([(u,) for u in same], "u string").select(warc.canonical_url(F.col("u")).alias("c"))
    assert {r["c"] for r in df.collect()} == {"a.example/p"}


def test_empty_table(spark):
    assert warc.resolve(spark.createDataFrame([], RECORDS)).count() == 0


def test_query_against_sql(spark, duck):
    compare(QUERIES["op7_warc_revisits"](spark, DATA), duck, ORACLE_SQL["op7_warc_revisits"])
