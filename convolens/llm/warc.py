"""Not-modified revisits of a WARC collection: an as-of join by canonical URL.

A revisit record (a 304 answer) has no body. Its page is the latest earlier full response of the same
canonical URL, provided the validators agree; the answer's headers are the stored ones, overlaid with
those that a 304 may update.

The join is as-of and safe for one URL with a large part of all records: time is cut into ``BUCKETS``
ranges of about equal numbers of records. A window over (url, bucket) finds the latest earlier
response inside the bucket; for revisits without one, the last response of each earlier bucket, one row
for each url and bucket, is carried forward by a second, bounded window and joined.

Validators: an ETag of the revisit must equal the response's (weak comparison, W/ ignored); without
one, its Last-Modified must equal the response's; without either nothing can be checked.

Statuses: ``resolved``, ``unverified`` (no validator), ``mismatch`` (validators differ; no merge),
``missing`` (no earlier response). Defined cases: equal times are not earlier; of several responses at
one time the greatest record_id counts. Null headers are no headers. A record with a null url or time
resolves nothing, and is ``missing`` if it is a revisit. Repeated revisit records each get a row. Extra
columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolens.llm.common import parallelism

#: fixed values: headers of a 304 answer that replace the stored ones (lower case)
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "vary")
BUCKETS = 64


def canonical_url(url: Column) -> Column:
    """Scheme, user, www., default port, fragment, tracking parameters and a trailing slash dropped; the host lower-cased."""
    bare = F.regexp_replace(url, r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored headers with the permitted ones of the update."""
    empty = F.create_map().cast("map<string,string>")
    stored, update = F.coalesce(stored, empty), F.coalesce(update, empty)
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    rest = F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(rest, allowed)


def header_lines(headers: Column) -> Column:
    """Headers as sorted lines ``name: value``, joined by newlines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def resolve(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per revisit: record_id, url, canonical_url, time, status, response_id, headers.

    ``records`` has record_id, kind ('response' or 'revisit'), url, time (long) and headers (a map with
    lower-case names).
    """
    rows = records.select("record_id", "kind", "url", "time", "headers", canonical_url(F.col("url")).alias("canonical_url"))
    at = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    bounds = sorted(set(rows.agg(F.percentile_approx("time", at, F.lit(10_000)).alias("b")).first()["b"] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("time"))) if bounds else F.lit(0)
    usable = F.col("time").isNotNull() & F.col("canonical_url").isNotNull()
    response = F.when((F.col("kind") == "response") & usable, F.struct("time", "record_id", "headers"))
    rows = rows.withColumn("bucket", bucket).withColumn("response", response)
    placed = rows.where(usable)
    # at one time revisits stand before responses, so that only earlier ones precede them
    order = [F.col("time"), F.col("kind") == "response", "record_id"]
    before = Window.partitionBy("canonical_url", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("found", F.last("response", ignorenulls=True).over(before)).where("kind = 'revisit'")
    tops = placed.groupBy("canonical_url", "bucket").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("time", "record_id"))).alias("top"))
    earlier = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("canonical_url", "bucket", F.last("top", ignorenulls=True).over(earlier).alias("carried"))
    matched = near.join(carried, ["canonical_url", "bucket"], "left").withColumn("found", F.coalesce("found", "carried")).drop("carried")
    lost = rows.where((F.col("kind") == "revisit") & ~usable).withColumn("found", F.lit(None).cast(matched.schema["found"].dataType))
    every = matched.unionByName(lost.select(*matched.columns))
    etag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    modified = lambda h: F.element_at(h, "last-modified")
    own, stored = F.col("headers"), F.col("found.headers")
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(etag(own).isNotNull(), F.when(etag(own) == etag(stored), "resolved").otherwise("mismatch"))
        .when(modified(own).isNotNull(), F.when(modified(own) == modified(stored), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    good = F.col("status").isin("resolved", "unverified")
    return every.withColumn("status", status).select(
        "record_id",
        "url",
        "canonical_url",
        "time",
        "status",
        F.when(good, F.col("found.record_id")).alias("response_id"),
        F.when(good, header_lines(merge_headers(stored, own))).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl in page_id order: each page as a full response, and a later not-modified check of its URL.

    The check asks under another spelling of the URL (scheme, capitals, port, fragment, tracking
    parameter). By page_id it sends the right ETag, a weak one, a stale one, only Last-Modified, or none.
    """
    n = F.col("page_id")
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    modified = F.concat(F.lit("day "), (n % 365).cast("string"))
    response = pages.select(
        (n * 2).alias("record_id"),
        F.lit("response").alias("kind"),
        "url",
        (n * 10).alias("time"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("etag"), etag, F.lit("last-modified"), modified, F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    spelling = (
        F.when(n % 4 == 0, F.regexp_replace("url", "^https?://", "HTTP://WWW."))
        .when(n % 4 == 1, F.concat("url", F.lit("#part")))
        .when(n % 4 == 2, F.regexp_replace("url", "^https?://([^/?#]*)", "https://$1:443"))
        .otherwise(F.col("url"))
    )
    check = (
        F.when(n % 5 == 0, F.create_map(F.lit("etag"), etag))
        .when(n % 5 == 1, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), etag)))
        .when(n % 5 == 2, F.create_map(F.lit("etag"), F.lit('"stale"')))
        .when(n % 5 == 3, F.create_map(F.lit("last-modified"), modified))
        .otherwise(F.create_map(F.lit("date"), modified))
    )
    extra = F.create_map(F.lit("age"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=120"), F.lit("content-type"), F.lit("text/plain"))
    revisit = pages.select((n * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), spelling.alias("url"), (n * 10 + F.when(n % 3 == 0, -5).otherwise(1005)).alias("time"), F.map_concat(check, extra).alias("headers"))
    return response.unionByName(revisit)
