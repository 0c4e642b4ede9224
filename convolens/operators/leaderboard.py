"""Leaderboards and reports: ranks, overall scores, frontiers, shares, pivots and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_per_model(entries: DataFrame) -> DataFrame:
    """One entry per model: the last by seq."""
    return entries.groupBy("model").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "model"]), "seq").alias("_e")).select("model", "_e.*")


def overall(scores: DataFrame, needed: int | None = None) -> DataFrame:
    """Mean of a model's domain scores, nulls skipped; null unless ``needed`` domains have one."""
    mean = F.avg("score")
    return scores.groupBy("model").agg((mean if needed is None else F.when(F.count("score") >= needed, mean)).alias("overall"))


def ranked(scores: DataFrame, score: str, tie: str, top: int | None = None, ascending: bool = False) -> DataFrame:
    """Rows with their ordinal rank, nulls last. With ``top`` a top-k sort bounds what is ranked."""
    order = [F.asc_nulls_last(score) if ascending else F.desc_nulls_last(score), F.asc(tie)]
    rows = scores if top is None else scores.orderBy(*order).limit(top)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def frontier(entries: DataFrame, group: str, date: str, score: str, tie: str) -> DataFrame:
    """Entries that beat every earlier one of their group."""
    before = Window.partitionBy(group).orderBy(date, tie).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(score).over(before)
    return entries.withColumn("_best", best).where(F.col("_best").isNull() | (F.col(score) > F.col("_best"))).drop("_best")


def shares(rows: DataFrame, key: str) -> DataFrame:
    """Counts of a column's values and their share of all rows."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def success_pivot(rows: DataFrame, name: str, mode: str, modes: list[str], success: Column) -> DataFrame:
    """Success rate of each name in one column per mode."""
    return rows.groupBy(name).pivot(mode, modes).agg(F.avg(success.cast("double")))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins; the last bin holds its right edge, values outside are left out."""
    width = (high - low) / bins
    kept = rows.where((F.col(value) >= low) & (F.col(value) <= high))
    number = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("long")
    return kept.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))


def spread_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, sample and population deviation by key."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_sample"), F.stddev_pop(value).alias("std_population"))


def consistency(first: Column, fourth: Column) -> Column:
    """pass^4 over pass^1."""
    return F.try_divide(fourth, first)


def supported(value: Column, n: Column, least: int = 10) -> Column:
    """A value only where enough events support it."""
    return F.when(n >= least, value)
