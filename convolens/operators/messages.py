"""Messages of a conversation: from ticks, merged from chunks, and calls paired with results by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: fixed value: what a merged message says where no chunk has a turn-taking action
NO_ACTIONS = "No turn-taking actions in merged chunks."


def from_ticks(ticks: DataFrame, group: str = "simulation_id") -> DataFrame:
    """(group, turn_idx, tick_id, role, content, contains_speech, tool_calls, result_id, timestamp) of typed ticks.

    In a tick the agent comes first; each side's message, made where it has a chunk or a call, is followed by its
    tool results. Messages are in order of their time, those of one time in tick order; a message without a
    time of its own has its tick's, and one without any comes first.
    """
    calls_type = ticks.schema["agent_tool_calls"].dataType.simpleString()

    def message(who: str, role: str, slot: int) -> list[Column]:
        chunk, calls = F.col(f"{who}_chunk"), F.col(f"{who}_tool_calls")
        there = chunk.isNotNull() | (F.coalesce(F.size(calls), F.lit(0)) > 0)
        said = F.struct(
            F.lit(slot).alias("slot"),
            F.lit(0).alias("nth"),
            F.lit(role).alias("role"),
            chunk["content"].alias("content"),
            F.coalesce(chunk["contains_speech"], F.lit(False)).alias("contains_speech"),
            F.when(F.coalesce(F.size(calls), F.lit(0)) > 0, calls).alias("tool_calls"),
            F.lit(None).cast("string").alias("result_id"),
            F.when(chunk.isNotNull(), chunk["timestamp"]).otherwise(F.col("timestamp")).alias("timestamp"),
        )
        results = F.transform(
            F.coalesce(F.col(f"{who}_tool_results"), F.array().cast(ticks.schema[f"{who}_tool_results"].dataType)),
            lambda r, i: F.struct(F.lit(slot + 1).alias("slot"), i.alias("nth"), F.lit("tool").alias("role"), r["content"].alias("content"), F.lit(False).alias("contains_speech"), F.lit(None).cast(calls_type).alias("tool_calls"), r["id"].alias("result_id"), F.coalesce(r["timestamp"], F.col("timestamp")).alias("timestamp")),
        )
        return [F.when(there, F.array(said)).otherwise(F.array().cast(f"array<{_kind(calls_type)}>")), results]

    listed = F.concat(*message("agent", "assistant", 0), *message("user", "user", 2))
    rows = ticks.select(group, "tick_id", F.explode(listed).alias("m"))
    order = Window.partitionBy(group).orderBy(F.col("m.timestamp").asc_nulls_first(), "tick_id", "m.slot", "m.nth")
    return rows.select(group, (F.row_number().over(order) - 1).alias("turn_idx"), "tick_id", "m.role", "m.content", "m.contains_speech", "m.tool_calls", "m.result_id", "m.timestamp")


def _kind(calls: str) -> str:
    return f"struct<slot:int,nth:int,role:string,content:string,contains_speech:boolean,tool_calls:{calls},result_id:string,timestamp:string>"


def of_simulations(simulations: DataFrame) -> DataFrame:
    """(simulation_id, turn_idx, role, content): stored messages, or those of the ticks where none are stored."""
    stored = simulations.where("messages is not null").select(F.col("id").alias("simulation_id"), F.posexplode("messages").alias("turn_idx", "m")).select("simulation_id", "turn_idx", "m.role", "m.content")
    ticks = simulations.where("messages is null").select(F.col("id").alias("simulation_id"), F.explode("ticks").alias("t")).select("simulation_id", "t.*")
    return stored.unionByName(from_ticks(ticks).select("simulation_id", "turn_idx", "role", "content"))


def merge_chunks(chunks: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Chunks (keys, pos, content, utterance_ids, action, info) as one message by ``keys``: content, utterance_ids, action_info, chunks.

    A chunk's text is joined with a space if it and the last chunk with a text name utterances and share none.
    Chunks without text are passed over; the ids are those of all chunks, once each, in order. Equal positions are
    taken by content. What is folded is the message itself, in the order of one sorted array.
    """
    own = F.struct(F.col(pos).alias("pos"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("utterance_ids", F.array().cast("array<string>")).alias("ids"), F.when(F.col("action").isNotNull(), F.concat_ws(": ", "action", F.nullif("info", F.lit("")))).alias("act"))
    gathered = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(own)).alias("c"))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("ids"), F.lit(False).alias("some"))

    def step(state: Column, chunk: Column) -> Column:
        apart = state["some"] & (F.size(chunk["ids"]) > 0) & (F.size(state["ids"]) > 0) & ~F.arrays_overlap(chunk["ids"], state["ids"])
        joined = F.concat(state["text"], F.when(apart, " ").otherwise(""), chunk["content"])
        return F.when(chunk["content"] == "", state).otherwise(F.struct(joined.alias("text"), chunk["ids"].alias("ids"), F.lit(True).alias("some")))

    acts = F.array_join(F.array_compact(F.transform("c", lambda x: x["act"])), "\n")
    has_acts = F.exists("c", lambda x: x["act"].isNotNull())
    return gathered.select(
        *keys,
        F.aggregate("c", start, step)["text"].alias("content"),
        F.array_distinct(F.flatten(F.transform("c", lambda x: x["ids"]))).alias("utterance_ids"),
        F.when(has_acts, acts).otherwise(NO_ACTIONS).alias("action_info"),
        F.size("c").alias("chunks"),
    )


def pair_by_position(messages: DataFrame, group: str = "simulation_id") -> tuple[DataFrame, DataFrame]:
    """Calls with the results that must follow them, and every violation of that order.

    Messages are (group, pos, role, call_ids, id) with positions from 0 without gaps; the k-th call of a message
    belongs to the k-th message after it. Pairs are (group, pos, call, call_id, result_pos). Violations are (group, pos, call,
    violation): ``no result`` (the history ends), ``not a result`` (another role stands there), ``other id``, and
    ``result without call`` for a tool message that no call reaches (call is null).
    """
    calls = messages.select(group, "pos", F.posexplode("call_ids").alias("call", "call_id")).withColumn("result_pos", F.col("pos") + 1 + F.col("call"))
    there = messages.select(group, F.col("pos").alias("result_pos"), F.col("role").alias("_role"), F.col("id").alias("_id"))
    joined = calls.join(there, [group, "result_pos"], "left")
    wrong = F.when(F.col("_role").isNull(), "no result").when(F.col("_role") != "tool", "not a result").when(~F.col("call_id").eqNullSafe(F.col("_id")), "other id")
    judged = joined.withColumn("violation", wrong)
    pairs = judged.where("violation is null").select(group, "pos", "call", "call_id", "result_pos")
    alone = there.where("_role = 'tool'").join(calls.select(group, "result_pos").distinct(), [group, "result_pos"], "left_anti")
    lone = alone.select(group, F.col("result_pos").alias("pos"), F.lit(None).cast("int").alias("call"), F.lit("result without call").alias("violation"))
    return pairs, judged.where("violation is not null").select(group, "pos", "call", "violation").unionByName(lone)
