"""Sequences and intervals: islands, silences, streaks, as-of matches, overlaps and merges.

All work on windows or joins that are partitioned by a group (a simulation or a user), so that groups
are spread over the cluster; none needs a whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(rows: DataFrame, group: str, order: str, flag: Column | str, tolerance: int = 1) -> DataFrame:
    """Maximal runs of flagged rows: group, island (from 1), start, end (half-open), length in rows.

    Flagged rows whose ``order`` values differ by at most ``tolerance`` are one run.
    """
    held = rows.where(flag)
    window = Window.partitionBy(group).orderBy(order)
    starts = F.coalesce((F.col(order) - F.lag(order).over(window) > tolerance).cast("int"), F.lit(1))
    numbered = held.withColumn("_start", starts).withColumn("island", F.sum("_start").over(window))
    return numbered.groupBy(group, "island").agg(F.min(order).alias("start_tick"), (F.max(order) + 1).alias("end_tick"), F.count("*").alias("rows"))


def silences(rows: DataFrame, group: str, order: str, speaking: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` rows in which nobody speaks."""
    return islands(rows, group, order, ~speaking).where(F.col("rows") >= least)


def longest_streak(rows: DataFrame, group: str, order: str, flag: Column) -> DataFrame:
    """Per group the length of its longest run of flagged rows, 0 if none is flagged."""
    runs = islands(rows, group, order, flag)
    return rows.select(group).distinct().join(runs.groupBy(group).agg(F.max("rows").alias("streak")), group, "left").select(group, F.coalesce("streak", F.lit(0)).alias("streak"))


def next_at_or_after(left: DataFrame, right: DataFrame, group: str, at: str, other: str) -> DataFrame:
    """``left`` with ``next_at``: the least ``other`` of the same group that is not before ``at``.

    A forward as-of match without a range join: both sides are put in one order and the next right
    value is carried back.
    """
    both = left.select("*", F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(right.schema[other].dataType).alias("_v")).unionByName(
        right.select(group, F.col(other).alias("_t"), F.lit(1).alias("_side"), F.col(other).alias("_v")), allowMissingColumns=True
    )
    ahead = Window.partitionBy(group).orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("next_at", F.first("_v", ignorenulls=True).over(ahead)).where("_side = 0").drop("_t", "_side", "_v")


def overlaps(left: DataFrame, right: DataFrame, group: str, width: int) -> DataFrame:
    """Pairs of rows (id, start, end) of one group whose half-open intervals overlap; a null end is open.

    Intervals are spread over the time cells of ``width`` that they touch, and a pair is formed in the
    cell of its later start, so that a group with many intervals is split by time. An open interval is not
    spread: it meets, by group, the intervals that end after its start, and those it overlaps are its result.
    """
    side = lambda df, name: df.select(group, *[F.col(c).alias(f"{name}_{c}") for c in ("id", "start", "end")])
    a, b = side(left, "left"), side(right, "right")
    later, ends = F.greatest("left_start", "right_start"), F.least("left_end", "right_end")
    last = lambda name: F.floor((F.col(f"{name}_end") - 1) / width)
    first = lambda name: F.floor(F.col(f"{name}_start") / width)
    spread = lambda df, name: df.where(f"{name}_end is not null").withColumn("_cell", F.explode(F.sequence(first(name), F.greatest(first(name), last(name)))))
    meet = (F.col("left_start") < F.coalesce("right_end", F.lit(1 << 62))) & (F.col("right_start") < F.coalesce("left_end", F.lit(1 << 62)))
    closed = spread(a, "left").join(spread(b, "right"), [group, "_cell"]).where(meet & (F.floor(later / width) == F.col("_cell"))).drop("_cell")
    open_left = a.where("left_end is null").join(b, group).where(meet)
    open_right = a.where("left_end is not null").join(b.where("right_end is null"), group).where(meet)
    every = closed.unionByName(open_left).unionByName(open_right)
    return every.select(group, "left_id", "right_id", later.alias("start"), F.coalesce(ends, F.lit(1 << 40)).alias("end"))


def merged(rows: DataFrame, group: str, start: str, end: str, gap: int) -> DataFrame:
    """Intervals of a group merged where they overlap or are at most ``gap`` apart."""
    before = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_new", F.coalesce((F.col(start) > F.max(end).over(before) + gap).cast("int"), F.lit(1)))
    return marked.withColumn("_k", F.sum("_new").over(upto)).groupBy(group, "_k").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("parts")).drop("_k")


def first_silent_within(rows: DataFrame, group: str, order: str, speaking: str, width: int) -> Column:
    """The first row in [order, order + width) of the group that does not speak."""
    ahead = Window.partitionBy(group).orderBy(order).rangeBetween(0, width - 1)
    return F.min(F.when(~F.col(speaking), F.col(order))).over(ahead)
