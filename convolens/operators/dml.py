"""Keyed changes of tables as copy-on-write DataFrames, and the trimming of trajectories."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolens.functions.constraints import predicate


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table with the new rows, the rows that were inserted); rows whose key exists are not."""
    fresh = rows.join(table.select(key), key, "left_anti").select(*rows.columns)
    return table.unionByName(fresh, allowMissingColumns=True), fresh


def update_by_id(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the non-null values of ``changes`` (one row a key) laid over its rows."""
    fields = [c for c in changes.columns if c != key]
    joined = table.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields]), key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def delete_where(table: DataFrame, constraints: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows deleted) by field constraints."""
    gone = predicate(table, constraints)
    return table.where(~gone), table.where(gone)


def append_once(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and the fresh ones whose keys are new; the first of several fresh ones in ``seq``."""
    new = latest(fresh.join(stored.select(*keys), keys, "left_anti"), keys, F.col("seq").asc())
    return stored.unionByName(new)


def latest(rows: DataFrame, keys: list[str], order=None) -> DataFrame:
    """One row for each key: the latest by ``seq``, or the first in ``order``."""
    window = Window.partitionBy(*keys).orderBy(order if order is not None else F.col("seq").desc())
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def table_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or modified rows, by content."""
    fields = [c for c in left.columns if c != key]
    digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256).alias("digest"))
    joined = digest(left).withColumnRenamed("digest", "old").join(digest(right).withColumnRenamed("digest", "new"), key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return joined.select(key, change.alias("change")).where("change is not null")


def truncated(text, head: int = 500, tail: int = 200):
    """A long text's beginning and end with a marker between; short texts unchanged."""
    cut = F.concat(F.substring(text, 1, head), F.lit(" ... [truncated] ... "), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > head + tail + 21, cut).otherwise(text)


def trim_to_budget(messages: DataFrame, budget: int, head: int = 500, tail: int = 200) -> DataFrame:
    """Truncate contents, tool messages and longest ones first, until each simulation meets its budget.

    ``messages`` has simulation_id, pos, role, content. A message is truncated while what the ones
    before it saved does not yet bring the simulation below ``budget`` characters.
    """
    short = truncated(F.col("content"), head, tail)
    size = F.coalesce(F.length("content"), F.lit(0))
    rows = messages.withColumn("_saved", size - F.coalesce(F.length(short), F.lit(0)))
    whole = Window.partitionBy("simulation_id")
    order = whole.orderBy(F.when(F.col("role") == "tool", 0).otherwise(1), size.desc(), "pos").rowsBetween(Window.unboundedPreceding, -1)
    need = F.sum(size).over(whole) - budget
    before = F.coalesce(F.sum("_saved").over(order), F.lit(0))
    return rows.withColumn("content", F.when((before < need) & (F.col("_saved") > 0), short).otherwise(F.col("content"))).drop("_saved")
