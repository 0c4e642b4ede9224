"""Grading stored runs again: component rewards from checks, rewards by evaluation type, breakdowns over a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.operators.metrics import successful

#: fixed values: names of the components, and of the evaluation types
COMPONENTS = ("DB", "ENV_ASSERTION", "ACTION", "COMMUNICATE", "NL_ASSERTION")
EVALUATION_TYPES = ("env", "communicate", "action", "nl_assertions", "all", "all_with_nl_assertions", "all_ignore_basis", "all_with_nl_assertions_ignore_basis")
NORMAL_ENDS = ("agent_stop", "user_stop")
_SINGLE = {"communicate": "COMMUNICATE", "action": "ACTION", "nl_assertions": "NL_ASSERTION"}


def component_rewards(checks: DataFrame) -> DataFrame:
    """Per simulation one column per component: the product of its checks (simulation_id, component, met), null without one.

    A check whose result is null is not met.
    """
    met = F.coalesce("met", F.lit(False))
    product = lambda name: F.bool_and(F.when(F.col("component") == name, met)).cast("double").alias(name)
    return checks.groupBy("simulation_id").agg(*map(product, COMPONENTS))


def regrade(simulations: DataFrame, rewards: DataFrame, evaluation_type: str = "all") -> DataFrame:
    """``simulations`` with ``reward``, ``reward_breakdown`` (a map), ``graded_basis`` and ``ungraded``.

    Simulations bring simulation_id, termination_reason, has_criteria and reward_basis; ``rewards`` comes from
    ``component_rewards``, and a component without checks counts 1. A premature end gives 0, no criteria 1, both
    without a breakdown. ``env`` takes DB and ENV_ASSERTION as far as the basis names them; a single component
    counts whatever the basis is; ``all`` takes what the basis names; the types that ignore the basis take
    actions and information always, natural-language assertions if the type says so, and the environment by
    the basis. A basis that names something unknown is not graded under ``all``: its reward is null and
    ``ungraded`` lists the names.
    """
    if evaluation_type not in EVALUATION_TYPES:
        raise ValueError(f"unknown evaluation type {evaluation_type!r}")
    names = F.coalesce("reward_basis", F.array().cast("array<string>"))
    always = lambda name: F.lit(True)
    by_basis = lambda name: F.array_contains(names, name)
    environment = {"DB": by_basis, "ENV_ASSERTION": by_basis}
    if evaluation_type in _SINGLE:
        taken = {_SINGLE[evaluation_type]: always}
    elif evaluation_type == "env":
        taken = environment
    elif evaluation_type.endswith("ignore_basis"):
        taken = environment | {"ACTION": always, "COMMUNICATE": always} | ({"NL_ASSERTION": always} if "nl" in evaluation_type else {})
    else:
        taken = dict.fromkeys(COMPONENTS, by_basis)
    rows = simulations.join(rewards.select("simulation_id", *[F.col(c).alias(f"_{c}") for c in COMPONENTS]), "simulation_id", "left")
    value = lambda name: F.coalesce(f"_{name}", F.lit(1.0))
    product = F.lit(1.0)
    for name, counts in taken.items():
        product = product * F.when(counts(name), value(name)).otherwise(1.0)
    entries = F.array_compact(F.array(*[F.when(counts(name), F.struct(F.lit(name).alias("key"), value(name).alias("value"))) for name, counts in taken.items()]))
    graded = F.coalesce(F.col("termination_reason").isin(*NORMAL_ENDS), F.lit(False)) & F.col("has_criteria")
    unknown = F.array_except(names, F.array(*map(F.lit, COMPONENTS))) if evaluation_type in ("all", "all_with_nl_assertions") else F.array().cast("array<string>")
    bad = graded & (F.size(unknown) > 0)
    ignored = F.array(*map(F.lit, COMPONENTS if "nl" in evaluation_type else COMPONENTS[:-1]))
    return rows.withColumns({
        "reward": F.when(bad, None).when(graded, product).when(~F.coalesce(F.col("termination_reason").isin(*NORMAL_ENDS), F.lit(False)), 0.0).otherwise(1.0),
        "reward_breakdown": F.when(graded & ~bad, F.map_from_entries(entries)),
        "graded_basis": F.when(graded, ignored if evaluation_type.endswith("ignore_basis") else names),
        "ungraded": F.when(bad, unknown),
    }).drop(*[f"_{c}" for c in COMPONENTS])


def run_breakdown(simulations: DataFrame, checks: DataFrame, write_tools: DataFrame) -> DataFrame:
    """Per simulation: task_id, trial, success, communication, environment, database, and write actions met and all.

    A component that the basis does not name is null; without any breakdown it is not successful. Checks are
    (simulation_id, requestor, name, action_match), write tools (requestor, name); a requestor other than
    the assistant is the user.
    """
    side = F.when(F.col("requestor") == "assistant", "assistant").otherwise("user")
    tools = write_tools.select(side.alias("_side"), F.col("name").alias("_name")).distinct()
    writes = checks.join(tools, (side == F.col("_side")) & (F.col("name") == F.col("_name")), "left_semi")
    counts = writes.groupBy("simulation_id").agg(F.count_if("action_match").alias("num_correct_write_action"), F.count("*").alias("num_write_action"))

    def component(name: str, alias: str) -> Column:
        met = F.when(F.col("reward_breakdown").isNull(), False).otherwise(successful(F.try_element_at("reward_breakdown", F.lit(name))))
        return F.when(F.array_contains("reward_basis", name), met).alias(alias)

    return simulations.join(counts, "simulation_id", "left").select(
        "simulation_id",
        "task_id",
        "trial",
        successful(F.col("reward")).alias("success"),
        component("COMMUNICATE", "communication"),
        component("ENV_ASSERTION", "environment"),
        component("DB", "database"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("num_correct_write_action", "num_write_action")],
    )
