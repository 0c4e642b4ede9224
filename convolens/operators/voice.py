"""Voice interaction analytics over fixed-length ticks: segments, turn transitions, interruptions, rates.

Ticks have a group (simulation), ``tick``, ``user_speaks`` and ``agent_speaks``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolens.operators.intervals import first_silent_within, islands, next_at_or_after


@dataclass(frozen=True)
class VoiceConfig:
    """Length of a tick and the windows, in seconds; a window has the whole ticks that fit in it."""

    tick_seconds: float = 0.2
    yield_seconds: float = 2.0
    no_yield_seconds: float = 2.0

    def ticks(self, seconds: float) -> int:
        return int(seconds / self.tick_seconds)


def drop_final_tick(ticks: DataFrame, group: str = "simulation_id") -> DataFrame:
    """Ticks without a last one that starts a user segment of its own."""
    order = Window.partitionBy(group).orderBy("tick")
    lone = F.lead("tick").over(order).isNull() & F.col("user_speaks") & ~F.coalesce(F.lag("user_speaks").over(order), F.lit(False))
    return ticks.withColumn("_lone", lone).where("not _lone").drop("_lone")


def segments(ticks: DataFrame, speaker: str, group: str = "simulation_id") -> DataFrame:
    """Speech segments of one side, with whether the other side speaks when the segment starts."""
    other = {"user": "agent", "agent": "user"}[speaker]
    found = islands(ticks, group, "tick", F.col(f"{speaker}_speaks"))
    at_start = ticks.select(group, F.col("tick").alias("start_tick"), F.col(f"{other}_speaks").alias("other_speaks_at_start"))
    at_end = ticks.select(group, (F.col("tick") + 1).alias("end_tick"), F.col(f"{other}_speaks").alias("other_speaks_at_end"))
    return found.join(at_start, [group, "start_tick"]).join(at_end, [group, "end_tick"]).select(group, "island", "start_tick", "end_tick", "rows", "other_speaks_at_start", "other_speaks_at_end")


def transitions(ticks: DataFrame, group: str = "simulation_id", config: VoiceConfig = VoiceConfig()) -> DataFrame:
    """User segments that end in agent silence, as response (with latency) or no_response.

    The next agent start decides against the next user start; a tie is a response. A segment that
    neither follows is dropped, and so is one that is a backchannel, if ``ticks`` has a column ``backchannel``.
    """
    user, agent = segments(ticks, "user", group), segments(ticks, "agent", group)
    if "backchannel" in ticks.columns:
        aside = ticks.where("backchannel").select(group, F.col("tick").alias("start_tick"))
        user = user.join(aside, [group, "start_tick"], "left_anti")
    turns = user.where(~F.col("other_speaks_at_end"))
    order = Window.partitionBy(group).orderBy("start_tick")
    turns = turns.withColumn("next_user", F.lead("start_tick").over(order))
    matched = next_at_or_after(turns, agent.select(group, F.col("start_tick").alias("agent_start")), group, "end_tick", "agent_start")
    responds = F.col("next_at").isNotNull() & (F.col("next_user").isNull() | (F.col("next_at") <= F.col("next_user")))
    event = F.when(responds, "response").when(F.col("next_user").isNotNull(), "no_response")
    latency = F.when(responds, (F.col("next_at") - F.col("end_tick")) * config.tick_seconds)
    return matched.select(group, F.col("end_tick").alias("tick"), event.alias("event"), latency.alias("latency_seconds")).where("event is not null")


def interruptions(ticks: DataFrame, group: str = "simulation_id", config: VoiceConfig = VoiceConfig()) -> DataFrame:
    """Segments that start while the other side speaks, and whether that side yields in time; kinds with windows of their own are in ``voice_quality``."""
    out = None
    for speaker, seconds in (("user", config.yield_seconds), ("agent", config.no_yield_seconds)):
        other = {"user": "agent", "agent": "user"}[speaker]
        width = config.ticks(seconds)
        quiet = ticks.withColumn("quiet", first_silent_within(ticks, group, "tick", f"{other}_speaks", width)).select(group, F.col("tick").alias("start_tick"), "quiet")
        own = segments(ticks, speaker, group).where("other_speaks_at_start").join(quiet, [group, "start_tick"])
        events = own.select(
            group,
            F.col("start_tick").alias("tick"),
            F.lit(f"{speaker}_interrupts_{other}").alias("event"),
            F.col("quiet").isNotNull().alias("yielded"),
            ((F.col("quiet") - F.col("start_tick")) * config.tick_seconds).alias("yield_seconds"),
        )
        out = events if out is None else out.unionByName(events)
    return out


def panel(ticks: DataFrame, group: str = "simulation_id", config: VoiceConfig = VoiceConfig()) -> DataFrame:
    """One row: counts and rates of responses and interruptions over all groups (null without any)."""
    ticks = drop_final_tick(ticks, group)
    turn = transitions(ticks, group, config).agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("event") == "response").alias("responses"),
        F.avg("latency_seconds").alias("latency_mean"),
        F.stddev_samp("latency_seconds").alias("latency_std"),
    )
    cut = interruptions(ticks, group, config).agg(
        F.count_if(F.col("event") == "user_interrupts_agent").alias("user_interruptions"),
        F.count_if((F.col("event") == "user_interrupts_agent") & F.col("yielded")).alias("yielded"),
        F.avg(F.when(F.col("event") == "user_interrupts_agent", F.col("yield_seconds"))).alias("yield_mean"),
        F.count_if(F.col("event") == "agent_interrupts_user").alias("agent_interruptions"),
    )
    both = turn.crossJoin(cut)  # one row each
    return both.withColumns({"response_rate": F.try_divide("responses", "turns"), "yield_rate": F.try_divide("yielded", "user_interruptions"), "agent_interruption_rate": F.try_divide("agent_interruptions", "turns")})
