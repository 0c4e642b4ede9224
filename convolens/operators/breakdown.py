"""Breakdowns of runs: rewards by component, outcome counts, task labels, costs that an unknown cost makes unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reward_breakdown(basis: Column, components: dict[str, Column]) -> list[Column]:
    """One column per component: its reward where the basis names it, else null."""
    return [F.when(F.array_contains(basis, name), value.cast("double")).alias(f"{name.lower()}_reward") for name, value in components.items()]


def outcome_counts(simulations: DataFrame) -> DataFrame:
    """One row: database matches, authentication results and terminations by bucket.

    Terminations that belong to no bucket (such as a timeout) are in none of the last three counts.
    """
    end = F.col("termination_reason")
    return simulations.agg(
        F.count_if("db_match").alias("db_matches"),
        F.count_if(~F.col("db_match")).alias("db_mismatches"),
        F.count_if(F.col("db_match").isNull()).alias("db_unchecked"),
        *[F.count_if(F.col("auth_status") == s).alias(f"auth_{s}") for s in ("succeeded", "failed", "not_needed")],
        F.count_if(end.isin("agent_stop", "user_stop")).alias("stopped"),
        F.count_if(end == "max_steps").alias("out_of_steps"),
        F.count_if(end.isin("too_many_errors", "agent_error", "user_error")).alias("failed"),
    )


def task_labels(trials: DataFrame, task: str = "task_id", success: str = "success") -> DataFrame:
    """(label, tasks): tasks that always pass, never pass, pass in half of the trials or more, or in fewer."""
    rate = F.avg(F.col(success).cast("double"))
    label = F.when(F.col("_rate") == 1, "always").when(F.col("_rate") == 0, "never").when(F.col("_rate") >= 0.5, "mostly").otherwise("seldom")
    return trials.groupBy(task).agg(rate.alias("_rate")).groupBy(label.alias("label")).agg(F.count("*").alias("tasks"))


def never_passed(trials: DataFrame, task: str = "task_id", success: str = "success") -> DataFrame:
    """The trials of tasks that no trial passes."""
    return trials.join(trials.where(success).select(task).distinct(), task, "left_anti")


def message_costs(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Cost and tokens by ``keys``: the cost is null if any message's is, tokens skip nulls."""
    cost = F.when(F.bool_or(F.col("cost").isNull()), None).otherwise(F.sum("cost"))
    return messages.groupBy(*keys).agg(cost.alias("cost"), F.sum("tokens").alias("tokens"))


def recombined(checks: DataFrame, premature: Column) -> DataFrame:
    """Rewards of simulations again from their stored checks: the product of all, 0 after a premature end."""
    rows = checks.groupBy("simulation_id").agg(F.product(F.col("reward").cast("double")).alias("_product"), F.bool_or(premature).alias("_premature"))
    return rows.select("simulation_id", F.when(F.col("_premature"), 0.0).otherwise(F.col("_product")).alias("reward"))


def mode_difference(rows: DataFrame, name: str, mode: str, first: str, second: str, value: Column) -> DataFrame:
    """Mean of a value in two modes, one column each, and the second less the first."""
    mean = lambda m: F.avg(F.when(F.col(mode) == m, value.cast("double")))
    return rows.groupBy(name).agg(mean(first).alias("first_mean"), mean(second).alias("second_mean")).withColumn("difference", F.col("second_mean") - F.col("first_mean"))


def homogeneous(rows: DataFrame, key: str, *settings: str) -> DataFrame:
    """Keys that occur more than once, and whether their settings are all equal."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), (F.count_distinct(F.struct(*settings)) == 1).alias("same_settings")).where("n > 1")
