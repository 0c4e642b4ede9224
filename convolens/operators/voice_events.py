"""Events of full-duplex speech beyond turns: effect segments, typed overlaps, answers to asides, yields to effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolens.operators.intervals import first_silent_within, next_at_or_after

#: fixed values: kinds of user speech over the agent's, the first that applies counts
OVERLAP_KINDS = ("backchannel", "vocal_tic", "non_directed_speech")


def effect_segments(effects: DataFrame, effect: str, group: str = "simulation_id", order: str = "tick") -> DataFrame:
    """Runs of consecutive ticks on which one effect is active, for each effect of a group."""
    held = effects.where(F.col(effect).isNotNull())
    window = Window.partitionBy(group, effect).orderBy(order)
    fresh = F.coalesce((F.col(order) - F.lag(order).over(window) > 1).cast("int"), F.lit(1))
    numbered = held.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(window))
    return numbered.groupBy(group, effect, "_run").agg(F.min(order).alias("start_tick"), (F.max(order) + 1).alias("end_tick"), F.count("*").alias("rows")).drop("_run")


def flagged_segments(ticks: DataFrame, speaker: str, flags: dict[str, Column], group: str = "simulation_id") -> DataFrame:
    """Speech segments, whether any of their ticks bears each flag, and whether the other side speaks at the start."""
    other = {"user": "agent", "agent": "user"}[speaker]
    held = ticks.where(F.col(f"{speaker}_speaks"))
    window = Window.partitionBy(group).orderBy("tick")
    fresh = F.coalesce((F.col("tick") - F.lag("tick").over(window) > 1).cast("int"), F.lit(1))
    numbered = held.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(window))
    marks = [F.bool_or(flag).alias(name) for name, flag in flags.items()]
    return numbered.groupBy(group, "_run").agg(F.min("tick").alias("start_tick"), (F.max("tick") + 1).alias("end_tick"), F.min_by(f"{other}_speaks", "tick").alias("over_speech"), *marks).drop("_run")


def overlap_kinds(segments: DataFrame, group: str = "simulation_id") -> DataFrame:
    """Segments that start over the other side's speech, as events of the first kind that applies."""
    kind = F.when(F.col(OVERLAP_KINDS[0]), OVERLAP_KINDS[0])
    for name in OVERLAP_KINDS[1:]:
        kind = kind.when(F.col(name), name)
    return segments.where("over_speech").select(group, F.col("start_tick").alias("tick"), kind.otherwise("user_interrupts_agent").alias("event"))


def answers(asides: DataFrame, agent: DataFrame, width: int, group: str = "simulation_id") -> DataFrame:
    """Whether the agent starts to speak from an aside's start to ``width`` ticks after its end."""
    found = next_at_or_after(asides.select(group, "start_tick", "end_tick"), agent.select(group, F.col("start_tick").alias("agent_start")), group, "start_tick", "agent_start")
    event = F.when(F.col("next_at") <= F.col("end_tick") + width, "agent_responds").otherwise("silent_correct")
    return found.select(group, F.col("start_tick").alias("tick"), event.alias("event"))


def yields_to_effects(ticks: DataFrame, effect: Column, width: int, group: str = "simulation_id") -> DataFrame:
    """Effects on ticks with agent speech that make the agent stop within ``width`` ticks; others give no event."""
    quiet = first_silent_within(ticks, group, "tick", "agent_speaks", width)
    return ticks.withColumn("stopped_at", quiet).where(effect & F.col("agent_speaks") & F.col("stopped_at").isNotNull()).select(group, "tick", "stopped_at")


def category_rates(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each event by ``keys``, and their share within the keys."""
    counted = events.groupBy(*keys, "event").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
