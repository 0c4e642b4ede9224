"""Agent metrics over simulations: success, pass^k, costs, terminations and review errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: fixed values: severity ranks for the greatest severity of a simulation
SEVERITY_RANK = {"critical": 3, "critical_helped": 3, "critical_hindered": 3, "minor": 2}
INFRASTRUCTURE_ERROR = "infrastructure_error"


def successful(reward: Column) -> Column:
    """Whether a reward is 1 within a millionth."""
    return F.coalesce(reward.between(1 - 1e-6, 1 + 1e-6), F.lit(False))


def hat_k(successes: Column, trials: Column, k: int) -> Column:
    """C(successes, k) / C(trials, k) as a product; null where there are fewer than k trials."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * F.greatest(successes - i, F.lit(0)) / F.nullif(trials - i, F.lit(0))
    return F.when(trials >= k, out)


def task_pass(trials: DataFrame, ks: list[int], task: str = "task_id", success: str = "success") -> DataFrame:
    """Per task: trials, successes and pass^k for each k. Null tasks are left out."""
    counted = trials.where(F.col(task).isNotNull()).groupBy(task).agg(F.count("*").alias("trials"), F.count_if(F.col(success)).alias("successes"))
    return counted.select(task, "trials", "successes", *[hat_k(F.col("successes"), F.col("trials"), k).alias(f"pass_hat_{k}") for k in ks])


def pass_hat(trials: DataFrame, ks: list[int], task: str = "task_id", success: str = "success") -> DataFrame:
    """One row a k: the mean of pass^k over tasks."""
    tasks = task_pass(trials, ks, task, success)
    means = tasks.agg(*[F.avg(f"pass_hat_{k}").alias(f"k{k}") for k in ks])
    stack = ", ".join(f"{k}, k{k}" for k in ks)
    return means.select(F.expr(f"stack({len(ks)}, {stack}) as (k, pass_hat_k)"))


def max_k(trials: DataFrame, declared: int, task: str = "task_id") -> int:
    """The greatest usable k: the declared trials, or the trials of the task that has fewest."""
    fewest = trials.where(F.col(task).isNotNull()).groupBy(task).count().agg(F.min("count")).first()[0]
    return min(declared, fewest or 0)


def agent_metrics(simulations: DataFrame) -> DataFrame:
    """One row of metrics over simulations (task_id, reward, agent_cost, user_cost, termination_reason).

    Infrastructure errors are left out. Reasons outside the three buckets count in none.
    """
    kept = simulations.where(F.coalesce(F.col("termination_reason") != INFRASTRUCTURE_ERROR, F.lit(True)))
    reason = F.col("termination_reason")
    return kept.agg(
        F.count("*").alias("simulations"),
        F.countDistinct("task_id").alias("tasks"),
        F.avg("reward").alias("avg_reward"),
        F.avg(successful(F.col("reward")).cast("double")).alias("success_rate"),
        F.avg("agent_cost").alias("avg_agent_cost"),
        F.avg("user_cost").alias("avg_user_cost"),
        F.count_if(reason.isin("agent_stop", "user_stop")).alias("normal_stops"),
        F.count_if(reason == "max_steps").alias("max_steps"),
        F.count_if(reason == "too_many_errors").alias("error_stops"),
    )


def errors_by_severity(errors: DataFrame) -> DataFrame:
    """Counts of (source, severity); a null severity is ``unknown``."""
    return errors.groupBy("source", F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(F.count("*").alias("errors"))


def tag_counts(errors: DataFrame) -> DataFrame:
    """Counts of (tag, severity) over the tags of each error."""
    return errors.select(F.explode("error_tags").alias("tag"), F.coalesce("severity", F.lit("unknown")).alias("severity")).groupBy("tag", "severity").agg(F.count("*").alias("errors"))


def greatest_severity(errors: DataFrame, simulation: str = "simulation_id") -> DataFrame:
    """Per simulation the greatest severity; of critical ones the last, of unranked ones the first in ``pos``."""
    rank = F.lit(1)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(F.col("severity") == name, value).otherwise(rank)
    place = F.when(rank == 1, -F.col("pos")).otherwise(F.col("pos"))
    return errors.groupBy(simulation).agg(F.max_by("severity", F.struct(rank, place)).alias("max_severity"))


def first_critical(errors: DataFrame, simulation: str = "simulation_id") -> DataFrame:
    """Per simulation the source of its earliest critical error, by ``at`` (null last), then ``pos``."""
    critical = errors.where(F.col("severity").startswith("critical"))
    order = F.struct(F.coalesce(F.col("at").cast("double"), F.lit(float("inf"))), F.col("pos"))
    return critical.groupBy(simulation).agg(F.min_by("source", order).alias("first_critical_source"))


def reward_per_task(simulations: DataFrame) -> DataFrame:
    """(task_id, reward): the reward of the last trial in ``seq``."""
    return simulations.groupBy("task_id").agg(F.max_by("reward", "seq").alias("reward"))


def poisoned_sum(value: Column) -> Column:
    """A sum that is null if any value is."""
    return F.when(F.bool_or(value.isNull()), None).otherwise(F.sum(value))


def leading_streak(rows: DataFrame, group: str, order: Column, flag: str) -> DataFrame:
    """Per group how many rows from the start hold ``flag`` without a break."""
    window = Window.partitionBy(group).orderBy(order)
    unbroken = F.min(F.col(flag).cast("int")).over(window)
    return rows.withColumn("_ok", unbroken).groupBy(group).agg(F.sum("_ok").alias("streak"))
