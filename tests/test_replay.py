"""State replay by patches against a fold of the calls in order."""

import json
import random
from decimal import Decimal

import pytest

from convolens.operators import replay

CALLS = "simulation_id long, pos long, name string, key string, value string"


def folded(rows, initial):
    """The state after each call in turn."""
    states = {}
    for sim, key, value in initial:
        states.setdefault(sim, {})[key] = json.loads(value)
    for sim, _, name, key, value in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[4] is not None, r[4] or "")):
        state = states.setdefault(sim, {})
        given = None if value is None else json.loads(value)
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        if name == "set":
            state[key] = given
        elif name == "delete":
            for k in [k for k in state if k == key or k.startswith(key + "/")]:
                del state[k]
        elif name == "add" and number(state.get(key)) and number(given):
            state[key] += given
        elif name == "append" and isinstance(state.get(key), list) and value is not None:
            state[key] = [*state[key], given]
    out = []
    for sim, state in states.items():
        for key, v in state.items():
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                out.append((sim, key, "number", float(v), None, None))
            else:
                out.append((sim, key, "list", None, v, None) if isinstance(v, list) else (sim, key, "other", None, None, v))
    return sorted(out, key=str)


def plain(df):
    rows = [(r.simulation_id, r.key, r.kind, None if r.number is None else float(r.number), None if r.items is None else [json.loads(x) for x in r.items], None if r.value is None else json.loads(r.value)) for r in df.collect()]
    return sorted(rows, key=str)


def random_calls(seed, n):
    rng = random.Random(seed)
    value = {"set": lambda: rng.choice(("1", "2.5", "-3", '"t"', "[]", '["a",1]', "null", "true", '{"x":1}')), "add": lambda: rng.choice(("1", "0.25", '"1"', "[1]")), "append": lambda: rng.choice(("7", '"z"', "[2]", None)), "delete": lambda: None, "look": lambda: "1"}
    rows = []
    for pos in range(n):
        name = rng.choices(list(value), (2, 6, 6, 1, 1))[0]
        rows.append((rng.randrange(3), pos, name, rng.choice(("a", "a/x", "a/x/y", "b", "ab", "ab/x")), value[name]()))
    return rows


@pytest.mark.parametrize("block", [1, 7, replay.BLOCK])
def test_patches_equal_a_fold(spark, block):
    rows = random_calls(block, 400)
    initial = [(0, "a", "1"), (0, "a/x", "[5]"), (1, "b", '"s"'), (4, "untouched/k", "2"), (4, "l", "[1,[2]]")]
    got = replay.replay(spark.createDataFrame(rows, CALLS), spark.createDataFrame(initial, "simulation_id long, key string, value string"), block)
    assert plain(got) == folded(rows, initial)
    assert plain(replay.replay(spark.createDataFrame(rows, CALLS), block=block)) == folded(rows, [])


def test_composition_is_associative(spark):
    rows = spark.createDataFrame(random_calls(9, 300), CALLS)
    parts = replay.patches(rows, 10).cache()
    show = lambda df: sorted(map(str, df.collect()))
    whole = show(replay.compose(parts))
    for cut in (5, 11, 29):
        left, right = (replay.compose(parts.where(f"stretch {op} {cut}")) for op in ("<", ">="))
        assert show(replay.compose(left.unionByName(right))) == whole


def test_no_simulation_is_one_group(spark):
    plan = replay.replay(spark.createDataFrame([], CALLS))._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
    assert replay.replay(spark.createDataFrame([], CALLS)).count() == 0


def test_unknown_and_failing_calls_change_nothing(spark):
    calls = spark.createDataFrame([(1, 0, "add", "x", "2"), (1, 1, "what", "x", "9"), (1, 2, "add", "gone", "1"), (1, 3, "add", "x", "3.5")], CALLS)
    state = replay.replay(calls, spark.createDataFrame([(1, "x", "0")], "simulation_id long, key string, value string"))
    assert [r[:4] for r in state.collect()] == [(1, "x", "number", Decimal("5.500000"))]
    assert [r[:] for r in replay.same_state(state, state).collect()] == [(1, True)]
    assert [r[:] for r in replay.same_state(state, state.withColumn("number", state["number"] + 1)).collect()] == [(1, False)]
