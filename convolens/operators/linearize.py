"""Linear order of full-duplex ticks: tick by tick, overlaps gathered, and segments split where one contains another.

Ticks are numbered without gaps in a group (a simulation). One side is one's own (``own``), the other is heard.
All three orders are windows within a simulation and its segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolens.operators.intervals import silences

#: fixed values: order of what has the same tick: silence, the other's speech, one's own, tool calls, what is left of a split segment
SILENCE, OTHER, OWN, TOOL, REST = -1, 0, 1, 2, 3


def speech(ticks: DataFrame, group: str, *columns: str) -> DataFrame:
    """A row for each tick and side that speaks on it."""
    sides = F.array_compact(F.array(*[F.when(F.col(f"{side}_speaks"), F.lit(side)) for side in ("agent", "user")]))
    return ticks.select(group, "tick", *columns, F.explode(sides).alias("speaker"))


def numbered(rows: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """``rows`` with their position in the group, from 0."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def simple(ticks: DataFrame, group: str = "simulation_id", own: str = "agent", own_first: bool = True) -> DataFrame:
    """Utterances tick by tick, one's own before or after the other's, with their position."""
    first = (F.col("speaker") == own) == F.lit(own_first)
    rows = numbered(speech(ticks, group, "event_id"), group, "tick", F.when(first, 0).otherwise(1))
    return rows.select(group, "position", "tick", "speaker", "event_id")


def gathered(ticks: DataFrame, group: str = "simulation_id", own: str = "agent", patience: int = 1) -> DataFrame:
    """Utterances in tick order, but what the other says in an overlap comes before all one's own of it.

    An overlap begins where both speak and ends before the tick on which one's own side has been silent
    for ``patience`` ticks.
    """
    mine = F.col(f"{own}_speaks")
    order = Window.partitionBy(group).orderBy("tick")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spoken = F.when(mine, F.col("tick"))
    fresh = mine & F.coalesce(F.col("tick") - F.max(spoken).over(before) > patience, F.lit(True))
    rows = ticks.withColumn("_last", F.max(spoken).over(order)).withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(order))
    rows = rows.withColumn("_both", F.min(F.when(F.col("agent_speaks") & F.col("user_speaks"), F.col("tick"))).over(Window.partitionBy(group, "_run")))
    inside = (F.col("tick") >= F.col("_both")) & (F.col("tick") - F.col("_last") < patience)
    rows = rows.withColumn("_at", F.when(inside, F.col("_both")).otherwise(F.col("tick")))
    said = numbered(speech(rows, group, "_at"), group, "_at", F.when(F.col("speaker") == own, OWN).otherwise(OTHER), "tick")
    return said.select(group, "position", "tick", "speaker")


def speech_segments(ticks: DataFrame, group: str, own: str, patience: int) -> tuple[DataFrame, DataFrame]:
    """Speaking ticks with the number of their segment, and the segments with the one of the other side they lie in.

    Segments of one side are apart, so only the last one that starts no later can contain a segment. Of two
    equal segments one's own lies in the other's.
    """
    order = Window.partitionBy(group, "speaker").orderBy("tick")
    fresh = F.coalesce((F.col("tick") - F.lag("tick").over(order) > patience).cast("int"), F.lit(1))
    said = speech(ticks, group).withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order)).drop("_fresh")
    runs = said.groupBy(group, "speaker", "_run").agg(F.min("tick").alias("_from"), F.max("tick").alias("_to"))
    started = Window.partitionBy(group).orderBy("_from").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_own = F.col("speaker") == own
    last_own = F.max(F.when(is_own, F.struct("_from", "_to"))).over(started)
    last_other = F.max(F.when(~is_own, F.struct("_from", "_to"))).over(started)
    runs = runs.withColumn("_outer", F.when(is_own, last_other).otherwise(last_own))
    equal = (F.col("_outer._from") == F.col("_from")) & (F.col("_outer._to") == F.col("_to"))
    lies_in = F.coalesce((F.col("_outer._to") >= F.col("_to")) & (is_own | ~equal), F.lit(False))
    return said, runs.withColumn("_inner", lies_in)


def containment(ticks: DataFrame, group: str = "simulation_id", own: str = "agent", patience: int = 1, silent: int | None = None, calls: DataFrame | None = None) -> DataFrame:
    """Pieces of speech in order: a segment that lies in one of the other side is put where it ends.

    The outer segment is split there. All others stand at their start, the other side's first. Pauses of
    fewer than ``patience`` silent ticks do not end a segment. ``silent``: silences of at least so many ticks are rows
    of ``system``; ``calls`` (group, tick): tool calls are rows of ``tool``.
    """
    said, runs = speech_segments(ticks, group, own, patience)
    other = {"agent": "user", "user": "agent"}
    swapped = F.when(F.col("speaker") == "agent", other["agent"]).otherwise(other["user"])
    cuts = runs.where("_inner").select(group, swapped.alias("speaker"), F.col("_outer._from").alias("_from"), F.col("_to").alias("tick"), F.col("_to").alias("_cut"))
    rows = said.join(runs.drop("_outer"), [group, "speaker", "_run"]).drop("_run").unionByName(cuts, allowMissingColumns=True)
    segment = Window.partitionBy(group, "speaker", "_from")
    rows = rows.withColumn("_last", F.max("_cut").over(segment)).withColumn("_next", F.min("_cut").over(segment.orderBy("tick").rangeBetween(0, Window.unboundedFollowing)))
    mine = F.col("speaker") == own
    at = F.when(F.col("_inner"), F.col("_to")).otherwise(F.coalesce("_next", F.col("_last") + 1, "_from"))
    late = F.col("_inner") | (F.col("_next").isNull() & F.col("_last").isNotNull())
    priority = F.when(mine, OWN).when(late, REST).otherwise(OTHER)
    keyed = rows.where("_inner is not null").select(group, "speaker", "tick", at.alias("_at"), priority.alias("_priority"))
    pieces = keyed.groupBy(group, "speaker", "_at", "_priority").agg(F.min("tick").alias("start_tick"), (F.max("tick") + 1).alias("end_tick"))
    if silent is not None:
        quiet = silences(ticks, group, "tick", F.col("agent_speaks") | F.col("user_speaks"), silent)
        pieces = pieces.unionByName(quiet.select(group, F.lit("system").alias("speaker"), F.col("start_tick").alias("_at"), F.lit(SILENCE).alias("_priority"), "start_tick", "end_tick"))
    if calls is not None:
        pieces = pieces.unionByName(calls.select(group, F.lit("tool").alias("speaker"), F.col("tick").alias("_at"), F.lit(TOOL).alias("_priority"), F.col("tick").alias("start_tick"), (F.col("tick") + 1).alias("end_tick")))
    return numbered(pieces, group, "_at", "_priority").select(group, "position", "speaker", "start_tick", "end_tick")
