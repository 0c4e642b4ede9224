"""Voice quality: every event of full-duplex speech in one typed table, and the panels made of it.

Ticks are (simulation_id, tick, user_speaks, agent_speaks) and, if they are there, ``backchannel`` (of the
tick on which user speech starts), ``vocal_tic`` and ``non_directed`` (the effect's text while it is heard, else
null), ``user_text`` and ``agent_text``. One set of windows over a simulation's ticks tells all a tick must
know: where its stretch of speech begins, when either side is next quiet, when the agent starts next. What
follows groups those rows by stretch, so that ticks are shuffled once for the windows.

Kinds of events, each with a window of its own:

* a turn is answered (``response``) or not (``no_response``);
* user speech over the agent's makes the agent stop (``yield``) or not (``no_yield``); a backchannel, a vocal
  tic or speech to others should not (``..._error`` if it does in time, else ``..._correct``);
* a vocal tic or speech to others while the agent is silent should not be answered;
* the same outside of user speech. Over agent speech only an agent that stops in time is an event.

Defined cases: null flags are false; a last tick on which user speech only starts is dropped; simulations
without ticks have no events; rates without events are null; equal ticks of a simulation are not allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolens.sources.scratch import stored

#: fixed values: the columns of the table of events, and the metrics of the panel
COLUMNS = ("event_category", "event_type", "is_error", "latency_sec", "llm", "domain", "speech_complexity", "provider", "simulation_id", "task_id", "event_time_sec", "event_tick", "transcript")
GROUPS = ("llm", "domain", "speech_complexity", "provider")
PANEL = ("response_latency_mean", "yield_latency_mean", "response_rate", "yield_rate", "agent_interruption_rate", "selectivity_backchannel", "selectivity_vocal_tic", "selectivity_non_directed")
TOTALS = ("response_total", "yield_total", "backchannel_total", "vocal_tic_total", "non_directed_total")
ASIDES = ("vocal_tic", "non_directed")


@dataclass(frozen=True)
class Windows:
    """Length of a tick and the window of each kind of event, in seconds; a window has the whole ticks of the plain quotient."""

    tick_seconds: float = 0.2
    no_yield: float = 2.0
    backchannel_yield: float = 1.0
    vocal_tic_yield: float = 1.0
    non_directed_yield: float = 1.0
    vocal_tic_response: float = 2.0
    non_directed_response: float = 2.0

    def ticks(self, seconds: float) -> int:
        return int(seconds / self.tick_seconds)


def observed(ticks: DataFrame) -> DataFrame:
    """Every kept tick with what the windows tell: starts and numbers of stretches, next starts and next quiet ticks."""
    there = set(ticks.columns)
    flag = lambda name: F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in there else F.lit(False)
    text = lambda name: F.col(name).cast("string") if name in there else F.lit(None).cast("string")
    rows = ticks.select(
        "simulation_id", "tick", flag("user_speaks").alias("user"), flag("agent_speaks").alias("agent"), flag("backchannel").alias("backchannel"), *[text(c).alias(c) for c in (*ASIDES, "user_text", "agent_text")]
    )
    forward = Window.partitionBy("simulation_id").orderBy("tick")
    backward = Window.partitionBy("simulation_id").orderBy(F.col("tick").desc())
    before = lambda c: F.lag(c).over(forward)
    fresh = lambda side: F.col(side) & ~F.coalesce(before(side), F.lit(False))
    lone = (F.row_number().over(backward) == 1) & fresh("user") & before("user").isNotNull()
    rows = rows.withColumn("lone", lone).where("not lone").drop("lone")
    # an effect outside of user speech starts where the tick before had none, another one, or user speech
    begins = {a: F.col(a).isNotNull() & ~F.col("user") & ~F.coalesce(F.col(a).eqNullSafe(before(a)) & ~before("user"), F.lit(False)) for a in ASIDES}
    rows = rows.withColumns({"user_start": fresh("user"), "agent_start": fresh("agent"), **{f"{a}_start": c for a, c in begins.items()}})
    number = lambda c: F.sum(F.col(c).cast("long")).over(forward)
    upto = backward.rowsBetween(Window.unboundedPreceding, 0)
    later = backward.rowsBetween(Window.unboundedPreceding, -1)
    first = lambda condition, frame: F.min(F.when(condition, F.col("tick"))).over(frame)
    return rows.withColumns(
        {
            "user_number": number("user_start"),
            "agent_number": number("agent_start"),
            **{f"{a}_number": number(f"{a}_start") for a in ASIDES},
            "last_tick": F.max("tick").over(Window.partitionBy("simulation_id")),
            "agent_from": first(F.col("agent_start"), upto),
            "agent_after": first(F.col("agent_start"), later),
            "agent_quiet": first(~F.col("agent"), upto),
        }
    )


def _joined(text: str) -> Column:
    """The texts of a group's ticks in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tick", text))), lambda x: x[text]), "")


def user_stretches(rows: DataFrame) -> DataFrame:
    """One row per stretch of user speech."""
    held = rows.where("user").groupBy("simulation_id", "user_number")
    at = lambda c, pick: pick(c, "tick").alias(c)
    return held.agg(
        F.min("tick").alias("start"),
        (F.max("tick") + 1).alias("end"),
        F.min_by("agent", "tick").alias("over_agent"),
        F.max_by("agent", "tick").alias("agent_at_end"),
        at("backchannel", F.min_by),
        *[F.bool_or(F.col(a).isNotNull()).alias(a) for a in ASIDES],
        at("agent_from", F.min_by),
        at("agent_after", F.max_by),
        at("agent_quiet", F.min_by),
        _joined("user_text").alias("transcript"),
    )


def effects_between(rows: DataFrame, aside: str) -> DataFrame:
    """One row per effect that is heard outside of user speech."""
    held = rows.where(F.col(aside).isNotNull() & ~F.col("user")).groupBy("simulation_id", f"{aside}_number")
    first = lambda c: F.min_by(c, "tick").alias(c)
    return held.agg(F.min("tick").alias("start"), (F.max("tick") + 1).alias("end"), first("agent"), first("agent_from"), first("agent_quiet"), F.max("last_tick").alias("last_tick"), F.min_by(aside, "tick").alias("transcript"))


def _event(category: str, kind: Column | str, error: Column | bool, tick: Column, windows: Windows, latency: Column | None = None, transcript: Column | None = None, agent_start: Column | None = None) -> list[Column]:
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        F.col("simulation_id"),
        F.lit(category).alias("event_category"),
        value(kind).alias("event_type"),
        value(error).alias("is_error"),
        (F.lit(None) if latency is None else latency).cast("double").alias("latency_sec"),
        (tick * windows.tick_seconds).alias("event_time_sec"),
        tick.alias("event_tick"),
        (F.col("transcript") if transcript is None else transcript).alias("transcript"),
        (F.lit(None) if agent_start is None else agent_start).cast("long").alias("_agent_start"),
    ]


def _turns(stretches: DataFrame, w: Windows) -> DataFrame:
    turns = stretches.where("not backchannel and not agent_at_end")
    next_user = F.lead("start").over(Window.partitionBy("simulation_id").orderBy("start"))
    turns = turns.withColumn("next_user", next_user).where("agent_after is not null or next_user is not null")
    answered = F.col("agent_after").isNotNull() & (F.col("next_user").isNull() | (F.col("agent_after") <= F.col("next_user")))
    latency = F.when(answered, F.col("agent_after") * w.tick_seconds - F.col("end") * w.tick_seconds)
    return turns.select(*_event("response", F.when(answered, "response").otherwise("no_response"), ~answered, F.col("end"), w, latency))


def _over_agent(stretches: DataFrame, w: Windows) -> DataFrame:
    """User speech that starts over the agent's: its kind is the first that applies."""
    rows, out = stretches.where("over_agent"), []
    wait = F.col("agent_quiet") - F.col("start")
    kinds = [("backchannel", F.col("backchannel"), w.backchannel_yield), ("vocal_tic", F.col("vocal_tic"), w.vocal_tic_yield), ("non_directed", F.col("non_directed"), w.non_directed_yield)]
    free = F.lit(True)
    for name, applies, seconds in kinds:
        stopped = F.coalesce(wait < w.ticks(seconds), F.lit(False))
        out.append(rows.where(free & applies).select(*_event(name, F.when(stopped, f"{name}_error").otherwise(f"{name}_correct"), stopped, F.col("start"), w)))
        free = free & ~applies
    stopped = F.coalesce(wait < w.ticks(w.no_yield), F.lit(False))
    out.append(rows.where(free).select(*_event("yield", F.when(stopped, "yield").otherwise("no_yield"), ~stopped, F.col("start"), w, F.when(stopped, wait * w.tick_seconds))))
    return _union(out)


def _aside(rows: DataFrame, name: str, seconds: float, w: Windows) -> DataFrame:
    """What is said aside while the agent is silent: an answer in time is an error, told at the agent's start."""
    answered = F.coalesce(F.col("agent_from") <= F.col("end") + w.ticks(seconds), F.lit(False))
    at = F.when(answered, F.col("agent_from")).otherwise(F.col("start"))
    return rows.select(*_event(name, F.when(answered, f"{name}_error").otherwise(f"{name}_correct"), answered, at, w, agent_start=F.when(answered, F.col("agent_from"))))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def quality_events(ticks: DataFrame, simulations: DataFrame | None = None, windows: Windows = Windows()) -> DataFrame:
    """All events, in ``COLUMNS``. ``simulations`` (simulation_id, task_id, llm, domain, speech_complexity, provider) gives
    the metadata, of which any may be missing; without it they are the empty text."""
    w = windows
    rows = stored(observed(ticks), "observed")  # four kinds of stretches are made of it
    stretches = stored(user_stretches(rows), "stretches")
    silent = stretches.where("not over_agent")
    parts = [_turns(stretches, w), _over_agent(stretches, w), _aside(silent.where("vocal_tic"), "vocal_tic", w.vocal_tic_response, w), _aside(silent.where("non_directed and not vocal_tic"), "non_directed", w.non_directed_response, w)]
    for name, stop, answer in (("vocal_tic", w.vocal_tic_yield, w.vocal_tic_response), ("non_directed", w.non_directed_yield, w.non_directed_response)):
        effects = effects_between(rows, name)
        parts.append(_aside(effects.where("not agent"), name, answer, w))
        after = (F.coalesce("agent_quiet", F.col("last_tick") + 1) - F.col("start")) * w.tick_seconds
        parts.append(effects.where(F.col("agent") & (after <= stop)).select(*_event(name, f"{name}_error", True, F.col("start"), w)))
    spoken = rows.where("agent").groupBy("simulation_id", "agent_number").agg(F.min("tick").alias("_agent_start"), _joined("agent_text").alias("_agent_text")).drop("agent_number")
    events = _union(parts).join(spoken, ["simulation_id", "_agent_start"], "left")
    events = events.withColumn("transcript", F.coalesce("_agent_text", "transcript", F.lit("")))
    keys = ("task_id", *GROUPS)
    if simulations is not None:
        known = [c for c in keys if c in simulations.columns]
        events = events.join(simulations.select("simulation_id", *known), "simulation_id", "left")
    return events.select(*[F.col(c) if c in events.columns else F.lit("").alias(c) for c in COLUMNS])


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def quality_metrics(events: DataFrame, keys: tuple[str, ...] = GROUPS) -> DataFrame:
    """Counts, totals, rates, mean and sample deviation of latencies by ``keys``; rates of nothing are null."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    counts, shares = {}, {}
    for name, good, bad in (("response", "response", "no_response"), ("yield", "yield", "no_yield")):
        latency = F.when(F.col("event_type") == good, F.col("latency_sec"))
        counts |= {f"{good}_count": n(good), f"{bad}_count": n(bad), f"{name}_total": n(good) + n(bad), f"{name}_latency_mean": F.avg(latency), f"{name}_latency_std": F.stddev_samp(latency)}
        shares[f"{name}_rate"] = _share(F.col(f"{good}_count"), F.col(f"{name}_total"))
    for name in ("backchannel", *ASIDES):
        counts |= {f"{name}_{k}_count": n(f"{name}_{k}") for k in ("correct", "error")} | {f"{name}_total": n(f"{name}_correct") + n(f"{name}_error")}
        shares[f"{name}_error_rate"] = _share(F.col(f"{name}_error_count"), F.col(f"{name}_total"))
    return events.groupBy(*keys).agg(*[c.alias(name) for name, c in counts.items()]).withColumns(shares)


def agent_interruptions(ticks: DataFrame) -> DataFrame:
    """(simulation_id, interruptions): stretches of agent speech that start over the user's; every simulation has a row."""
    return observed(ticks).groupBy("simulation_id").agg(F.count_if(F.col("agent_start") & F.col("user")).alias("interruptions"))


def panel(ticks: DataFrame, simulations: DataFrame, experiment: tuple[str, ...] = ("llm", "domain"), windows: Windows = Windows()) -> DataFrame:
    """The eight metrics and the counts of each experiment: one row per combination of the columns ``experiment``."""
    events = quality_events(ticks, simulations, windows)
    metrics = quality_metrics(events, experiment)
    placed = agent_interruptions(ticks).join(simulations.select("simulation_id", *experiment), "simulation_id")
    cut = placed.groupBy(*experiment).agg(F.count("*").alias("n_simulations"), F.sum("interruptions").alias("agent_interrupts_count"))
    joined = cut.join(metrics, list(experiment), "left")
    correct = {f"selectivity_{name}": 1 - F.col(f"{name}_error_rate") for name in ("backchannel", *ASIDES)}
    rated = joined.withColumns({"agent_interruption_rate": _share(F.col("agent_interrupts_count"), F.col("response_total")), **correct})
    return rated.select(*experiment, *PANEL, "n_simulations", *[F.coalesce(c, F.lit(0)).alias(c) for c in TOTALS], "agent_interrupts_count")


def over_domains(panels: DataFrame, keys: tuple[str, ...] = ("llm",), least: int = 0) -> DataFrame:
    """Unweighted means of the metrics over the domains of each key, and sums of the counts.

    A metric that a domain lacks is left out of its mean. With ``least``, a domain of fewer simulations gives counts alone.
    """
    counts = ("n_simulations", *TOTALS, "agent_interrupts_count")
    supported = F.col("n_simulations") >= least
    return panels.groupBy(*keys).agg(F.count("*").alias("domains"), *[F.avg(F.when(supported, F.col(m))).alias(m) for m in PANEL], *[F.sum(c).alias(c) for c in counts])
