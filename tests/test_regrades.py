"""Re-grading, reviews and marked scripts on small cases worked out by hand."""

import pytest

from convolens.operators import regrading, reviews, scripts

SIMULATIONS = "simulation_id int, termination_reason string, has_criteria boolean, reward_basis array<string>"


def grades(spark, rows, checks, kind):
    made = regrading.component_rewards(spark.createDataFrame(checks, "simulation_id int, component string, met boolean"))
    return {r["simulation_id"]: r for r in regrading.regrade(spark.createDataFrame(rows, SIMULATIONS), made, kind).collect()}


def test_types_of_evaluation(spark):
    rows = [(1, "user_stop", True, ["DB"]), (2, "timeout", True, ["DB"]), (3, "agent_stop", False, None), (4, "agent_stop", True, ["DB", "TASTE"]), (5, None, True, ["DB"]), (6, "agent_stop", True, None)]
    checks = [(1, "DB", True), (1, "ENV_ASSERTION", True), (1, "ENV_ASSERTION", False), (1, "ACTION", False), (1, "NL_ASSERTION", None)]
    got = {kind: grades(spark, rows, checks, kind) for kind in regrading.EVALUATION_TYPES}
    assert {kind: g[1]["reward"] for kind, g in got.items()} == {"env": 1, "communicate": 1, "action": 0, "nl_assertions": 0, "all": 1, "all_with_nl_assertions": 1, "all_ignore_basis": 0, "all_with_nl_assertions_ignore_basis": 0}
    assert got["all"][1]["reward_breakdown"] == {"DB": 1.0} and got["all_ignore_basis"][1]["reward_breakdown"] == {"DB": 1.0, "ACTION": 0.0, "COMMUNICATE": 1.0}
    for g in got.values():
        assert [g[k]["reward"] for k in (2, 3, 5)] == [0, 1, 0] and g[2]["reward_breakdown"] is None
    assert got["all"][4]["reward"] is None and got["all"][4]["ungraded"] == ["TASTE"] and got["env"][4]["reward"] == 1
    assert got["all"][6]["reward"] == 1 and got["all"][6]["reward_breakdown"] == {}
    with pytest.raises(ValueError):
        regrading.regrade(spark.createDataFrame(rows, SIMULATIONS), None, "taste")


def test_reviews_of_both_sides_and_of_the_user_alone(spark):
    simulations = spark.createDataFrame([(1, "full"), (2, "user_only"), (3, "full"), (4, None), (5, "user_only")], "simulation_id int, review string")
    errors = spark.createDataFrame(
        [
            (1, 0, "agent", None, None, None, ["a"]),
            (1, 1, "agent", "critical", None, 9, ["a", "b"]),
            (1, 2, "user", "critical_helped", 4, 99, []),
            (1, 3, "user", "critical_hindered", None, None, None),
            (1, 4, "agent", "critical_helped", 0, None, []),
            (2, 0, "agent", "minor", 1, None, []),
            (2, 1, "user", "odd", 1, None, []),
            (4, 0, "user", "critical_helped", 1, None, []),
        ],
        "simulation_id int, pos int, source string, severity string, tick_start int, turn_idx int, error_tags array<string>",
    )
    got = {r[0]: tuple(r)[2:] for r in reviews.review_outcomes(simulations, errors).collect()}
    assert got == {1: ("critical", "critical_hindered", "user"), 2: ("none", "minor", "none"), 3: ("none",) * 3, 5: ("none",) * 3}
    counted = {(r["metric"], r["key"], r["tag"]): r["n"] for r in reviews.review_metrics(simulations, errors).collect()}
    assert counted[("agent_errors", "unknown", None)] == 1 and counted[("user_errors", "minor", None)] == 1
    assert counted[("agent_tags", "critical", "b")] == 1 and counted[("max_user_severity", "none", None)] == 2
    assert reviews.review_metrics(simulations.limit(0), errors).count() == 0


def test_scripts_are_merged_by_message(spark):
    template = '<message uuid="{}" active="{}"><chunk id=0>A\n</chunk><chunk id=10>B</chunk></message>'
    rows = [(1, 0, template.format("x", "10")), (1, 1, template.format("y", "0,")), (1, 2, template.format("x", "0,0").replace("A", "Z")), (1, 3, None), (1, 4, "no message"), (2, 0, ""), (3, 0, '<message uuid="z">t</message>')]
    df = spark.createDataFrame(rows, "g int, pos int, script string")
    got = {r["g"]: r["script"] for r in scripts.merge_scripts(df, "g", "pos", "script").collect()}
    assert got == {1: template.format("x", "0,10") + template.format("y", "0"), 2: None, 3: '<message uuid="z">t</message>'}
    row = df.where("g = 1 and pos = 1").select(scripts.missing_ids(df["script"]).alias("m"), scripts.plain_text(df["script"]).alias("t"), scripts.chunk_texts(df["script"]).alias("c")).first()
    assert row["m"] == [10] and row["t"] == "A\nB" and [tuple(c) for c in row["c"]] == [(0, "A\n"), (10, "B")]
