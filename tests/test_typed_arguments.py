"""Typed arguments: a comparison of values, not of their texts, and runs read without a schema."""

import itertools
import json

from pyspark.sql import functions as F

from convolens.functions import variants
from convolens.operators import rewards
from convolens.sources import runs

VALUES = [1, "1", 1.0, 1.5, True, False, 0, -0.0, None, "null", "", "a\"1.0", [1, 2.0], [1.0, 2], ["1", 2], {"b": 1, "a": [True]}, {"a": [1.0], "b": 1.0}, {"a": [1]}, 10**20, 1e20, 12345678901234567890, "é", "é", 0.1, -7, -7.0, [], {}, [[]], [None], "1.0"]


def matches(action, call):
    """The comparison of an expected action with a call, over Python values."""
    keys = call["arguments"].keys() if action["compare_args"] is None else action["compare_args"]
    pick = lambda arguments: {k: v for k, v in arguments.items() if k in keys}
    return action["name"] == call["name"] and (not keys or pick(action["arguments"]) == pick(call["arguments"]))


def test_equal_values_share_a_text(spark):
    rows = [(k, json.dumps(v)) for k, v in enumerate(VALUES)]
    texts = dict(spark.createDataFrame(rows, "k int, j string").select("k", variants.canonical_variant(F.parse_json("j"))).collect())
    for a, b in itertools.product(range(len(VALUES)), repeat=2):
        assert (texts[a] == texts[b]) == (VALUES[a] == VALUES[b]), (VALUES[a], VALUES[b], texts[a], texts[b])


def run_of(calls, actions):
    message = {"role": "assistant", "tool_calls": [{"id": str(k), **c, "requestor": "assistant"} for k, c in enumerate(calls)]}
    return {"timestamp": "t", "info": {"agent_info": {"llm_args": {"temperature": 0.0}}}, "tasks": [{"id": "t1", "evaluation_criteria": {"actions": actions}}], "simulations": [{"id": "s1", "task_id": "t1", "messages": [message], "extra": {"deep": [1, {"x": "y"}]}}], "simulation_index": []}


def test_actions_of_a_run_match_by_value(spark, tmp_path):
    calls = [{"name": "f", "arguments": {"k": v}} for v in (1, "2", {"n": [1, None]}, None)] + [{"name": "g", "arguments": {}}, {"name": "h", "arguments": {"a": 1, "b": 2}}]
    wanted = [({"k": 1.0}, None), ({"k": "1"}, None), ({"k": 2}, None), ({"k": {"n": [1.0, None]}}, None), ({"k": {"n": [1]}}, None), ({"k": None}, None), ({}, None), ({}, ["k"]), ({"k": "2", "z": 1}, ["k"])]
    actions = [{"action_id": str(n), "name": "f", "arguments": a, "compare_args": c} for n, (a, c) in enumerate(wanted)]
    actions += [{"action_id": "g", "name": "g", "arguments": {"any": 1}, "compare_args": None}, {"action_id": "h", "name": "h", "arguments": {"a": 1, "b": "2"}, "compare_args": ["a"]}, {"action_id": "h2", "name": "h", "arguments": {"a": 1, "b": "2"}, "compare_args": None}, {"action_id": "i", "name": "nobody", "arguments": {}, "compare_args": []}]
    (tmp_path / "run.json").write_text(json.dumps(run_of(calls, actions)))
    run = runs.read_run(spark, str(tmp_path / "run.json"))
    got = {r["action_id"]: r["matched"] for r in rewards.match_actions(runs.gold_actions(run), runs.tool_calls(run.simulations)).collect()}
    assert got == {a["action_id"]: any(matches(a, c) for c in calls) for a in actions}


def test_runs_without_a_schema(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps(run_of([{"name": "f", "arguments": {"k": 1}}], [])))
    head, simulations = runs.read_untyped(spark, str(tmp_path / "run.json"))
    assert variants.shredded(head, "doc", {"t": ("$.timestamp", "string"), "none": ("$.no.such", "int")}).collect()[0][:] == ("t", None)
    got = variants.shredded(simulations, "value", {"id": ("$.id", "string"), "deep": ("$.extra.deep[1].x", "string"), "bad": ("$.extra", "int")}, "pos").collect()
    assert [r[:] for r in got] == [(0, "s1", "y", None)]
    assert [r["pos"] for r in variants.items(simulations, "value", "$.messages").collect()] == [0]
    run = runs.read_run(spark, str(tmp_path / "run.json"))
    runs.write_run(run, str(tmp_path / "dir"), "dir")
    _, again = runs.read_untyped(spark, str(tmp_path / "dir"), "dir")
    assert variants.shredded(again, "value", {"k": ("$.messages[0].tool_calls[0].arguments.k", "int")}).collect()[0]["k"] == 1


def test_a_missing_key_is_not_a_null_one(spark):
    df = spark.sql("select map('a', cast(null as string)) as null_a, map('b', '1') as b, map() as none")
    same = lambda x, y, keys: df.select(rewards.arguments_match(F.col(x).cast("map<string,string>"), F.col(y).cast("map<string,string>"), F.array(*map(F.lit, keys)))).first()[0]
    assert not same("null_a", "none", ["a"]) and same("null_a", "null_a", ["a"]) and same("b", "none", ["a"])
