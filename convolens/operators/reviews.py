"""Error counts of reviewed simulations, for reviews of both sides and of the user alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: severities that are critical for each side
CRITICAL = {"agent": ("critical",), "user": ("critical_helped", "critical_hindered")}


def reviewed_errors(simulations: DataFrame, errors: DataFrame) -> DataFrame:
    """The errors of reviewed simulations with ``side``: their source; in a review of the user alone, the user.

    Errors of other sources have no side. Simulations are (simulation_id, review), ``review`` being full,
    user_only or null (not reviewed).
    """
    side = F.when(F.col("review") == "user_only", "user").when(F.col("source").isin("agent", "user"), F.col("source"))
    kept = simulations.where("review in ('full', 'user_only')").select("simulation_id", "review")
    return errors.join(kept, "simulation_id").withColumn("side", side).withColumn("severity", F.coalesce("severity", F.lit("unknown")))


def _greatest(side: str) -> Column:
    """The greatest severity of a side: the last critical one, else minor, else the first other one; null without errors."""
    severity = F.col("severity")
    rank = F.when(severity.isin(*CRITICAL[side]), 3).when(severity == "minor", 2).otherwise(1)
    place = F.when(rank == 3, F.col("pos")).otherwise(-F.col("pos"))
    return F.max_by("severity", F.when(F.col("side") == side, F.struct(rank, place)))


def review_outcomes(simulations: DataFrame, errors: DataFrame) -> DataFrame:
    """Per reviewed simulation its greatest severities and the source of its first critical error; ``none`` without.

    Errors are in order of ``tick_start``, else ``turn_idx``, those without a place last, then ``pos``.
    """
    at = F.coalesce(F.col("tick_start").cast("double"), F.col("turn_idx").cast("double"), F.lit(float("inf")))
    critical = F.col("side").isNotNull() & F.when(F.col("side") == "agent", F.col("severity").isin(*CRITICAL["agent"])).otherwise(F.col("severity").isin(*CRITICAL["user"]))
    found = reviewed_errors(simulations, errors).groupBy("simulation_id").agg(
        _greatest("agent").alias("max_agent_severity"),
        _greatest("user").alias("max_user_severity"),
        F.min_by("side", F.when(critical, F.struct(at, "pos"))).alias("first_critical_source"),
    )
    names = ("max_agent_severity", "max_user_severity", "first_critical_source")
    kept = simulations.where("review in ('full', 'user_only')").select("simulation_id", "review").join(found, "simulation_id", "left")
    return kept.select("simulation_id", "review", *[F.coalesce(c, F.lit("none")).alias(c) for c in names])


def review_metrics(simulations: DataFrame, errors: DataFrame) -> DataFrame:
    """(metric, key, tag, n): errors of each side by severity and by tag, simulations by their outcomes; tag is null but for tags."""
    sided = reviewed_errors(simulations, errors).where("side is not null")
    no_tag = F.lit(None).cast("string").alias("tag")
    by_severity = sided.groupBy(F.concat("side", F.lit("_errors")).alias("metric"), F.col("severity").alias("key"), no_tag)
    by_tag = sided.select("side", "severity", F.explode("error_tags").alias("tag")).groupBy(F.concat("side", F.lit("_tags")).alias("metric"), F.col("severity").alias("key"), "tag")
    outcomes = review_outcomes(simulations, errors).unpivot("simulation_id", ["max_agent_severity", "max_user_severity", "first_critical_source"], "metric", "key")
    by_outcome = outcomes.groupBy("metric", "key", no_tag)
    return reduce(DataFrame.union, [g.agg(F.count("*").alias("n")).select("metric", "key", "tag", "n") for g in (by_severity, by_tag, by_outcome)])
