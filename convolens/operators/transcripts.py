"""Transcripts and tool results: as-of pairing, proportional slices, merged scripts, utterance groups."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_at_or_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """``left`` with ``name``: the ``value`` of the latest right row of the same keys that is not after ``at``.

    Both sides are put in one order and the last value is carried forward, so that no range join is needed.
    """
    rows = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    given = right.select(*keys, at, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    before = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(given, allowMissingColumns=True).withColumn(name, F.last("_v", ignorenulls=True).over(before))
    return both.where("_side = 1").drop("_side", "_v")


def pair_results(calls: DataFrame, results: DataFrame, group: str = "simulation_id") -> DataFrame:
    """Results (group, result, call_id, at) with the call they answer: the one of their id, else the nearest earlier one."""
    by_id = latest_at_or_before(results, calls, [group, "call_id"], "at", "call", "_own")
    both = latest_at_or_before(by_id, calls, [group], "at", "call", "_near")
    how = F.when(F.col("_own").isNotNull(), "id").when(F.col("_near").isNotNull(), "nearest")
    return both.select(group, "result", F.coalesce("_own", "_near").alias("call"), how.alias("how"))


def slices(text: Column, weights: list[int]) -> Column:
    """A text cut in proportion to ``weights``; cuts lie at the rounded-up shares of its length."""
    total, parts, upto = sum(weights), [], 0
    cut = lambda w: F.ceil(F.length(text) * w / total).cast("int")
    for weight in weights:
        low, high = cut(upto), cut(upto + weight)
        parts.append(F.substring(text, low + 1, high - low))
        upto += weight
    return F.array(*parts)


def merged_scripts(chunks: DataFrame, uuid: str, part: str) -> DataFrame:
    """Chunks of one script as one row: its distinct parts in order, and their number."""
    return chunks.groupBy(uuid).agg(F.array_join(F.array_sort(F.collect_set(part)), ",").alias("parts"), F.count("*").alias("chunks"))


def item_transcripts(events: DataFrame, keys: list[str], start: Column, stop: Column, text: Column) -> DataFrame:
    """Provider events of an utterance as one row: when it started and stopped, and its last text."""
    return events.groupBy(*keys).agg(F.min(start).alias("started"), F.max(stop).alias("stopped"), F.max_by(text, F.when(text.isNotNull(), F.col("pos"))).alias("text"))


def utterance_groups(chunks: DataFrame, group: str = "simulation_id") -> DataFrame:
    """(group, pos, part): consecutive chunks whose ids overlap those gathered so far are one part.

    Sequential by nature: a simulation's rows stream through a task in order, and only the ids gathered
    for the current part are held.
    """
    kinds = dict(chunks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, part = object(), set(), 0
        for batch in batches:
            parts = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                own = set(ids or ())
                if key != now:
                    now, gathered, part = key, set(), 0
                elif gathered and not gathered & own:
                    part, gathered = part + 1, set()
                gathered |= own
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.int64())], names=[group, "pos", "part"])

    ordered = chunks.select(group, "pos", "ids").repartition(group).sortWithinPartitions(group, "pos")
    return ordered.mapInArrow(run, f"{group} {kinds[group]}, pos {kinds['pos']}, part long")


def cut_lengths(length: int, weights: list[int]) -> list[int]:
    """How long the slices of a text of ``length`` characters are."""
    cuts = [ceil(length * sum(weights[:k]) / sum(weights)) for k in range(len(weights) + 1)]
    return [b - a for a, b in zip(cuts, cuts[1:])]
