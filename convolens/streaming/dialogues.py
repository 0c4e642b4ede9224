"""Who holds the floor of a conversation: a state machine for each conversation, as a stream and as a batch.

Events are (simulation_id, event_id, ts, kind) with the kinds user_start, user_stop, agent_start and agent_stop. The
machine's state follows from the two sides: idle, user, agent, both, and waiting (the user stopped last and nobody
speaks). Rows put out are (simulation_id, ts, event_id, before, after). A wait that lasts ``patience`` seconds gives a row of
its own from waiting to idle, without an event_id, at the moment when patience ends.

The stream keeps events in state until the watermark has passed them, so that shuffled and late input (within the
watermark) is taken in the order of (ts, event_id); an event_id that comes again is taken once. Events behind the watermark
are left out, as Spark does. The batch form gives the same rows by windows. Other kinds and rows with a null
in any of the columns are left out; a kind that changes nothing (the user starts twice) gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

KINDS = ("user_start", "user_stop", "agent_start", "agent_stop")
PATIENCE = 10
OUTPUT = "simulation_id long, ts timestamp, event_id long, before string, after string"


def state_of(user: bool, agent: bool, asked: bool) -> str:
    """The state's name; ``asked``: the user was the last to stop."""
    return {(True, True): "both", (True, False): "user", (False, True): "agent"}.get((user, agent), "waiting" if asked else "idle")


def _usable(events: DataFrame) -> DataFrame:
    return events.select("simulation_id", "event_id", "ts", "kind").where(F.col("kind").isin(*KINDS)).dropna()


class FloorMachine(StatefulProcessor):
    """Holds a conversation's events until the watermark, then moves the machine in their order."""

    def __init__(self, patience: int):
        self.patience = patience * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        key = StructType([StructField("at", LongType()), StructField("event_id", LongType())])
        self.held = handle.getMapState("held", key, StructType([StructField("kind", StringType())]))
        self.machine = handle.getValueState("machine", StructType([StructField("user", BooleanType()), StructField("agent", BooleanType()), StructField("asked", BooleanType()), StructField("since", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, event_id, kind in zip((frame["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist(), frame["event_id"].tolist(), frame["kind"].tolist()):
                if not self.held.containsKey((at, event_id)):
                    self.held.updateValue((at, event_id), (kind,))
                    self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        user, agent, asked, since = self.machine.get() if self.machine.exists() else (False, False, False, None)
        held = sorted((place, value[0]) for place, value in self.held.iterator())
        due = [x for x in held if x[0][0] <= until]
        coming = held[len(due)][0][0] if len(held) > len(due) else None
        out = []
        for (at, event_id), kind in [*due, ((until, None), None)]:
            before = state_of(user, agent, asked)
            if before == "waiting" and at >= since + self.patience:
                out.append((since + self.patience, None, "waiting", "idle"))
                asked, before = False, "idle"
            if kind is None:
                continue
            self.held.removeKey((at, event_id))
            side, starts = kind.split("_")
            if side == "user":
                asked = starts != "start" and (user or asked)
                user = starts == "start"
            else:
                agent = starts == "start"
                asked = asked and not agent
            after = state_of(user, agent, asked)
            if after != before:
                out.append((at, event_id, before, after))
            if after == "waiting" and before != "waiting":
                since = at
                self.handle.registerTimer(at + self.patience)
        # a timer that is due already would fire only with the next batch
        if state_of(user, agent, asked) == "waiting" and since + self.patience <= timerValues.getCurrentWatermarkInMs() and (coming is None or coming >= since + self.patience):
            out.append((since + self.patience, None, "waiting", "idle"))
            asked = False
        self.machine.update((user, agent, asked, since))
        if out:
            at, ids, before, after = zip(*out)
            yield pd.DataFrame({"simulation_id": key[0], "ts": pd.to_datetime(list(at), unit="ms"), "event_id": pd.array(list(ids), "Int64"), "before": before, "after": after})

    def close(self) -> None:
        pass


def floor_states(events: DataFrame, late: str = "1 minute", patience: int = PATIENCE) -> DataFrame:
    """The machine's rows of a stream of events; needs the RocksDB state store."""
    rows = _usable(events).withWatermark("ts", late).groupBy("simulation_id")
    return rows.transformWithStateInPandas(FloorMachine(patience), OUTPUT, "Append", "EventTime")


def floor_states_batch(events: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """The same rows by windows over all events.

    Both sides are the last that each was told to do; whether the user stopped last follows from when each side last moved.
    """
    once = _usable(events).groupBy("simulation_id", "event_id").agg(F.min(F.struct("ts", "kind")).alias("e")).select("simulation_id", "event_id", "e.ts", "e.kind")
    order = Window.partitionBy("simulation_id").orderBy("ts", "event_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    told = lambda side: F.coalesce(F.last(F.when(F.col("kind") == f"{side}_start", True).when(F.col("kind") == f"{side}_stop", False), ignorenulls=True).over(upto), F.lit(False))
    rows = once.withColumns({"user": told("user"), "agent": told("agent"), "n": F.row_number().over(order)})
    was = lambda c: F.coalesce(F.lag(c).over(order), F.lit(False))
    # the user's real stops (not the repeated ones) ask; any start answers
    rows = rows.withColumn("stops", (F.col("kind") == "user_stop") & was("user"))
    asks = F.max(F.when(F.col("stops"), F.col("n"))).over(upto)
    answers = F.max(F.when(F.col("kind").isin("user_start", "agent_start"), F.col("n"))).over(upto)
    rows = rows.withColumn("asked", asks.isNotNull() & (asks > F.coalesce(answers, F.lit(0))))
    raw = F.when(F.col("user") & F.col("agent"), "both").when(F.col("user"), "user").when(F.col("agent"), "agent").when(F.col("asked"), "waiting").otherwise("idle")
    rows = rows.withColumn("raw", raw)
    # a wait begins where the state before was another one; once patience is over, what is still called waiting is idle
    begins = (F.col("raw") == "waiting") & ~F.coalesce(F.lag("raw").over(order) == "waiting", F.lit(False))
    rows = rows.withColumn("since", F.when(F.col("raw") == "waiting", F.last(F.when(begins, F.col("ts")), ignorenulls=True).over(upto)))
    ends = F.col("since") + F.make_dt_interval(secs=F.lit(patience))
    rows = rows.withColumn("after", F.when((F.col("raw") == "waiting") & (F.col("ts") >= ends), "idle").otherwise(F.col("raw")))
    seen = F.lag(F.struct("raw", "since")).over(order)
    gone = (seen["raw"] == "waiting") & (F.col("ts") >= seen["since"] + F.make_dt_interval(secs=F.lit(patience)))
    rows = rows.withColumn("before", F.coalesce(F.when(gone, "idle").otherwise(seen["raw"]), F.lit("idle")))
    moves = rows.where("before <> after").select("simulation_id", "ts", "event_id", "before", "after")
    following = F.lead("ts").over(order)
    leaves = F.lead("raw").over(order)
    waits = rows.withColumn("next_ts", following).withColumn("next_raw", leaves).where("raw = 'waiting'").withColumn("ends", ends)
    # the row at which patience ends within a wait: the next event is later or there is none
    over = waits.where((F.col("ts") < F.col("ends")) & (F.col("next_ts").isNull() | (F.col("next_ts") >= F.col("ends"))))
    lapsed = over.select("simulation_id", F.col("ends").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit("waiting").alias("before"), F.lit("idle").alias("after"))
    return moves.unionByName(lapsed)
