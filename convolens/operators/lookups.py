"""Lookups over business tables: two-stage and either-key matches, ids routed by prefix, maps and sampled bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_title_then_id(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(request, id, found_by): the document whose title is the request (the least id of several), else whose id is."""
    titles = documents.groupBy(F.col("title").alias("request")).agg(F.min("id").alias("_title_id"))
    ids = documents.select(F.col("id").cast("string").alias("request"), F.col("id").alias("_own_id")).distinct()
    joined = requests.join(titles, "request", "left").join(ids, "request", "left")
    found_by = F.when(F.col("_title_id").isNotNull(), "title").when(F.col("_own_id").isNotNull(), "id")
    return joined.select("request", F.coalesce("_title_id", "_own_id").alias("id"), found_by.alias("found_by"))


def by_prefix(requests: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Requests ``prefix + id`` matched in the table of their prefix; each table has id and label."""
    every = None
    for prefix, rows in tables.items():
        typed = rows.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("request"), F.lit(prefix).alias("kind"), "label")
        every = typed if every is None else every.unionByName(typed)
    return requests.join(every, "request")


def by_either(requests: DataFrame, rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(value, key): rows that have the value in any of ``columns``; a union of equi-joins, not a join on OR."""
    hits = None
    for column in columns:
        found = requests.join(rows.select(F.col(column).alias("value"), key), "value").select("value", key)
        hits = found if hits is None else hits.unionByName(found)
    return hits.distinct()


def through_ids(owners: DataFrame, ids: str, owned: DataFrame, key: str) -> DataFrame:
    """Owners joined to the rows whose ``key`` is in their array ``ids``."""
    return owners.withColumn(key, F.explode(ids)).drop(ids).join(owned, key)


def value_on(rows: DataFrame, owner: str, day: Column, value: Column, wanted: str) -> DataFrame:
    """(owner, value): of each owner's map from day to greatest value, the entry of one day; null without it.

    Only the wanted day's entry is kept on the way, so that the map is never built whole.
    """
    return rows.groupBy(owner).agg(F.max(F.when(day == wanted, value)).alias("value"))


def newest(rows: DataFrame, owner: str, at: Column, tie: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each owner; rows without a date come last, ties by ``tie``."""
    order = Window.partitionBy(owner).orderBy(at.desc_nulls_last(), tie)
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def stratified(rows: DataFrame, bin: str, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of each bin, chosen by the hash of their key: the same ones on every run."""
    order = Window.partitionBy(bin).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def cache_plan(documents: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """(key, plan): what an incremental cache of embeddings must do with each document.

    Both sides have ``key`` and ``digest``: hit (same digest), stale, new, or removed.
    """
    both = documents.select(key, F.col("digest").alias("_now")).join(cached.select(key, F.col("digest").alias("_old")), key, "full_outer")
    plan = F.when(F.col("_now").isNull(), "removed").when(F.col("_old").isNull(), "new").when(F.col("_now") == F.col("_old"), "hit").otherwise("stale")
    return both.select(key, plan.alias("plan"))
