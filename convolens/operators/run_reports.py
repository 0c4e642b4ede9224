"""Reports over runs: the full metrics record, action rows, submissions, domain rankings and trimmed trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from convolens.functions.text import call_format, not_nan
from convolens.operators.metrics import INFRASTRUCTURE_ERROR, task_pass


def metrics_record(simulations: DataFrame, ks: list[int], success: Column) -> DataFrame:
    """One flat row: mean reward and agent cost, simulations, tasks, infrastructure errors and ``pass_hat_k``.

    Infrastructure errors are counted and otherwise left out.
    """
    failed = F.coalesce(F.col("termination_reason") == INFRASTRUCTURE_ERROR, F.lit(False))
    kept = simulations.where(~failed)
    plain = kept.agg(F.avg("reward").alias("avg_reward"), F.avg("agent_cost").alias("avg_agent_cost"), F.count("*").alias("total_simulations"), F.count_distinct("task_id").alias("total_tasks"))
    errors = simulations.agg(F.count_if(failed).alias("infra_error_count"))
    hats = task_pass(kept.withColumn("success", success), ks).agg(*[F.avg(f"pass_hat_{k}").alias(f"pass_hat_{k}") for k in ks])
    return plain.crossJoin(errors).crossJoin(hats)  # one row each


def responsiveness(simulations: DataFrame, flag: str) -> DataFrame:
    """One row: simulations that say whether they were unresponsive, and those that were."""
    return simulations.agg(F.count(flag).alias("with_information"), F.count_if(F.col(flag)).alias("unresponsive"))


def derived_totals(errors: DataFrame) -> DataFrame:
    """One row: errors of each source, simulations with any, and with critical ones (source, severity, simulation_id)."""
    of = lambda who: F.col("source") == who
    critical = {"agent": F.col("severity") == "critical", "user": F.col("severity").isin("critical_helped", "critical_hindered")}
    some = lambda test: F.count_distinct(F.when(test, F.col("simulation_id")))
    columns = [F.count_if(of(w)).alias(f"total_{w}_errors") for w in critical]
    columns += [some(of(w)).alias(f"sims_with_{w}_errors") for w in critical]
    columns += [some(of(w) & test).alias(f"sims_with_critical_{w}_errors") for w, test in critical.items()]
    return errors.agg(*columns)


def action_rows(simulations: DataFrame) -> DataFrame:
    """One row per checked action, in call form; simulations without reward or checks have none."""
    rows = simulations.select("task_id", "trial", F.explode("reward_info.action_checks").alias("c"))
    return rows.select("task_id", "trial", F.col("c.action.requestor").alias("requestor"), F.col("c.action.name").alias("action_name"), call_format(F.col("c.action.name"), F.col("c.action.arguments")).alias("action"), F.col("c.action_match").alias("action_match"))


def write_tools(tools: DataFrame, requestor: str) -> DataFrame:
    """The names of one side's tools that write, of (requestor, name, kind)."""
    return tools.where((F.col("requestor") == requestor) & (F.col("kind") == "write")).select("name").distinct()


def mean_by_count(rows: DataFrame, count: str, value: str, most: int) -> DataFrame:
    """Mean of a value by a count from 0 to ``most``; counts that do not occur have 0."""
    every = rows.sparkSession.range(most + 1).select(F.col("id").alias(count))
    means = rows.groupBy(F.col(count).cast("long").alias(count)).agg(F.avg(value).alias("mean"))
    return every.join(means, count, "left").fillna(0.0, ["mean"])


def failure_shares(rows: DataFrame, key: str, success: Column) -> DataFrame:
    """Share of failed rows by key."""
    return rows.groupBy(key).agg((F.count_if(~success) / F.count("*")).alias("failure_share"))


def mean_reward(rows: DataFrame, key: str, reward: str) -> DataFrame:
    """Mean reward by key, a missing reward counting as 0."""
    return rows.groupBy(key).agg(F.avg(F.coalesce(F.col(reward), F.lit(0.0))).alias("mean_reward"))


def submission_metrics(results: DataFrame, ks: list[int]) -> DataFrame:
    """pass^k in percent, and a cost that is no number as null."""
    return results.select("model", "domain", *[(F.col(f"pass_{k}") * 100).alias(f"pass_{k}") for k in ks], not_nan(F.col("cost")).alias("cost"))


def submission_differences(stored: DataFrame, computed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, metric, stored, computed) where the stored and the computed value are not exactly equal."""
    side = lambda df, name: df.select(*keys, F.explode(F.create_map(*[x for v in values for x in (F.lit(v), F.col(v).cast("double"))])).alias("metric", name))
    both = side(stored, "stored").join(side(computed, "computed"), [*keys, "metric"], "full_outer")
    return both.where(~F.col("stored").eqNullSafe(F.col("computed")))


def best_per_model(rows: DataFrame, model: str, score: str, tie: str) -> DataFrame:
    """The row of each model with the greatest score, then the least ``tie``."""
    order = Window.partitionBy(model).orderBy(F.desc_nulls_last(score), tie)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def domain_top(rows: DataFrame, domain: str, score: str, tie: str, top: int) -> DataFrame:
    """The ``top`` rows of each domain by score, with their rank."""
    order = Window.partitionBy(domain).orderBy(F.desc_nulls_last(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def frequent(rows: DataFrame, key: str, least_share: float, top: int) -> DataFrame:
    """The most frequent values with more than ``least_share`` of all rows, ``top`` at most."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_total"))
    return counted.crossJoin(F.broadcast(total)).where(F.col("n") > least_share * F.col("_total")).drop("_total").orderBy(F.desc("n"), key).limit(top)  # one row


def of_organization(entries: DataFrame, organization: str) -> DataFrame:
    """Entries of an organization, its name in any case."""
    return entries.where(F.lower("organization") == organization.lower())


def contaminated_overall(scores: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Mean of the parts (key, score, n) by key, hidden where a part that has a score rests on fewer than ``least`` events.

    Parts without a score say nothing. ``reason`` is ok, low_n (hidden) or undefined (no part has a score).
    """
    weak = F.bool_or(F.col("score").isNotNull() & (F.coalesce("n", F.lit(0)) < least))
    judged = scores.groupBy(key).agg(F.avg("score").alias("_mean"), weak.alias("_weak"))
    reason = F.when(F.col("_weak"), "low_n").when(F.col("_mean").isNull(), "undefined").otherwise("ok")
    return judged.select(key, F.when(~F.col("_weak"), F.col("_mean")).alias("overall"), reason.alias("reason"))


def merged_document(stored: Column, partial: Column, kind: StructType) -> Column:
    """A struct with the values of a partial one laid over it, field by field at every depth; nulls change nothing."""
    fields = []
    for field in kind.fields:
        old, new = stored.getField(field.name), partial.getField(field.name)
        deep = isinstance(field.dataType, StructType)
        fields.append((F.when(old.isNull(), new).when(new.isNull(), old).otherwise(merged_document(old, new, field.dataType)) if deep else F.coalesce(new, old)).alias(field.name))
    return F.struct(*fields)


def without_message_fields(simulations: DataFrame, fields: list[str]) -> DataFrame:
    """Simulations whose messages lack the given fields."""
    return simulations.withColumn("messages", F.transform("messages", lambda m: m.dropFields(*fields)))


def missing_ids(expected: Column, found: Column) -> Column:
    """The ids expected that are not found, once each, in their order."""
    return F.array_except(expected, found)


def disjoint(left: Column, right: Column) -> Column:
    """Whether two lists share nothing."""
    return ~F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def covers_basis(basis: Column, checked: Column) -> Column:
    """Whether every part of a reward's basis was checked."""
    return F.size(F.array_except(basis, checked)) == 0
