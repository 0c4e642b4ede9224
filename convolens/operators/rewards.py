"""Reward evaluation: gold actions against calls, information said, and the combination of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from convolens.functions.text import said
from convolens.functions.variants import argument_map


def arguments_match(gold: Column, predicted: Column, compared: Column) -> Column:
    """Whether the arguments agree on the compared keys; null ``compared`` means the call's own keys.

    Both are maps of texts. A key must be on both sides with one value, or on neither. No keys always match.
    """
    keys = F.coalesce(compared, F.map_keys(predicted))
    same = lambda key: (F.map_contains_key(gold, key) == F.map_contains_key(predicted, key)) & F.try_element_at(gold, key).eqNullSafe(F.try_element_at(predicted, key))
    return F.forall(keys, same)


def _argument_texts(rows: DataFrame) -> DataFrame:
    """``rows`` with arguments as maps of texts: typed ones (VARIANT) as the texts that equal values share."""
    return rows.withColumn("arguments", argument_map(F.col("arguments"))) if isinstance(rows.schema["arguments"].dataType, VariantType) else rows


#: Gold actions and calls of one task; actions and calls of one simulation and name stay together.
ROWS_OF_A_TASK = 250_000


def match_actions(gold: DataFrame, calls: DataFrame) -> DataFrame:
    """Gold actions (simulation_id, action_id, name, arguments, compare_args) with ``matched``.

    A mark join: an action is matched if any call of its simulation has its name and arguments. Arguments
    are VARIANT objects, compared by typed values, or maps of texts. Calls that no action names go first.
    Both sides are counted and dealt once, by simulation and name, into parts of about ``ROWS_OF_A_TASK`` rows, so that a
    task's sorts and hash tables do not grow with the tables; equal calls are told by their sorted entries.
    """
    keys = ["simulation_id", "name"]
    parts = max(gold.sparkSession.sparkContext.defaultParallelism, -(-(gold.count() + calls.count()) // ROWS_OF_A_TASK))
    wanted = gold.select(*keys, "action_id", "arguments", "compare_args").repartition(parts, *keys)
    asked = calls.select(*keys, "arguments").repartition(parts, *keys).join(wanted.select(*keys), keys, "left_semi")
    made = _argument_texts(asked).select(*keys, F.array_sort(F.map_entries("arguments")).alias("_made")).distinct()
    joined = _argument_texts(wanted).join(made, keys, "left")
    hit = F.col("_made").isNotNull() & arguments_match(F.col("arguments"), F.map_from_entries("_made"), F.col("compare_args"))
    return joined.groupBy("simulation_id", "action_id", "name").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("matched"))


def action_reward(matches: DataFrame) -> DataFrame:
    """Per simulation 1 if all gold actions are matched, else 0."""
    return matches.groupBy("simulation_id").agg(F.bool_and("matched").cast("double").alias("action_reward"))


def match_information(information: DataFrame, messages: DataFrame) -> DataFrame:
    """(simulation_id, info, met): whether any assistant message of the simulation says it.

    Messages meet the information one by one, so that a simulation's messages are never one list.
    """
    spoken = messages.where("role = 'assistant'").select("simulation_id", F.col("content").alias("_content"))
    joined = information.select("simulation_id", "info").distinct().join(spoken, "simulation_id", "left")
    met = F.bool_or(F.coalesce(said(F.col("_content"), F.col("info")), F.lit(False)))
    found = joined.groupBy(F.col("simulation_id").alias("_of"), F.col("info").alias("_info")).agg(met.alias("met"))
    same = F.col("simulation_id").eqNullSafe(F.col("_of")) & F.col("info").eqNullSafe(F.col("_info"))
    return information.select("simulation_id", "info").join(found, same).select("simulation_id", "info", "met")


def combine(basis: Column, components: dict[str, Column]) -> Column:
    """The product of the components named in ``basis``; a named one that is null counts as 0."""
    out = F.lit(1.0)
    for name, value in components.items():
        out = out * F.when(F.array_contains(basis, name), F.coalesce(value.cast("double"), F.lit(0.0))).otherwise(1.0)
    return out


def final_reward(termination: Column, has_criteria: Column, combined: Column, normal: tuple[str, ...] = ("agent_stop", "user_stop")) -> Column:
    """0 after a premature end, 1 without criteria, else the combined reward."""
    return F.when(~termination.isin(*normal), 0.0).when(~has_criteria, 1.0).otherwise(combined)


def partial_action_reward(checks: DataFrame) -> DataFrame:
    """Per simulation matched and all checks by tool type (read, write)."""
    of = lambda kind: F.col("tool_type") == kind
    return checks.groupBy("simulation_id").agg(
        F.count_if(of("read")).alias("reads"),
        F.count_if(of("read") & F.col("action_match")).alias("reads_met"),
        F.count_if(of("write")).alias("writes"),
        F.count_if(of("write") & F.col("action_match")).alias("writes_met"),
    )
