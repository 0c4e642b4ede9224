import json

import pytest
from pyspark.sql import functions as F

from convolens.functions.variants import argument_map
from convolens.operators import dml, intervals, leaderboard, linearize, metrics, retrieval, rewards, run_reports, usage, voice, work
from convolens.sources import runs, schemas
from convolens.streaming import events


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_pass_hat_with_unequal_trials_and_null_tasks(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("a", False), ("b", True), (None, True)], "task_id string, success boolean")
    assert rows(metrics.task_pass(df, [1, 2]), "task_id") == [("a", 3, 2, pytest.approx(2 / 3), pytest.approx(1 / 3)), ("b", 1, 1, 1.0, None)]
    assert metrics.max_k(df, 4) == 1


def test_success_leaves_out_null_rewards(spark):
    df = spark.sql("select explode(array(1.0D, 0.9999999D, 0.99D, null)) as r")
    assert [r[0] for r in df.select(metrics.successful(F.col("r"))).collect()] == [True, True, False, False]


def test_severity_rules(spark):
    df = spark.createDataFrame([(1, "critical_helped", 1), (1, "critical_hindered", 2), (2, "odd", 1), (2, "other", 2), (3, "minor", 1), (3, None, 2)], "simulation_id int, severity string, pos int")
    assert rows(metrics.greatest_severity(df), "simulation_id") == [(1, "critical_hindered"), (2, "odd"), (3, "minor")]


def test_actions_compare_the_calls_own_keys(spark):
    kind = "simulation_id int, action_id string, name string, arguments map<string,string>, compare_args array<string>"
    gold = spark.createDataFrame([(1, "a", "f", {"x": "1", "y": "2"}, None), (1, "b", "f", {"x": "1"}, ["x"]), (1, "c", "f", {"x": "9"}, []), (1, "d", "g", {}, None)], kind)
    calls = spark.createDataFrame([(1, "f", {"x": "1"}), (1, "f", {"x": "1"})], "simulation_id int, name string, arguments map<string,string>")
    assert [r[3] for r in rows(rewards.match_actions(gold, calls), "action_id")] == [True, True, True, False]
    extra = spark.createDataFrame([(1, "f", {"x": "1", "z": "3"})], "simulation_id int, name string, arguments map<string,string>")
    assert [r[3] for r in rows(rewards.match_actions(gold, extra), "action_id")] == [False, True, True, False]
    empty = spark.createDataFrame([(1, "g", {})], "simulation_id int, name string, arguments map<string,string>")
    assert [r[3] for r in rows(rewards.match_actions(gold, empty), "action_id")] == [False, False, False, True]


def tick_rows(spark, *patterns):
    """Ticks of one simulation from (who, count) with u, a, b (both) or - (silence)."""
    out = "".join(who * n for who, n in patterns)
    return spark.createDataFrame([(1, k, c in "ub", c in "ab") for k, c in enumerate(out)], "simulation_id int, tick int, user_speaks boolean, agent_speaks boolean")


def test_voice_response_after_a_second(spark):
    got = rows(voice.transitions(tick_rows(spark, ("u", 5), ("-", 5), ("a", 5), ("-", 5))), "tick")
    assert got == [(1, 5, "response", pytest.approx(1.0))]


def test_voice_no_response_then_response(spark):
    got = rows(voice.transitions(tick_rows(spark, ("u", 5), ("-", 10), ("u", 5), ("-", 5), ("a", 3), ("-", 3))), "tick")
    assert [g[2] for g in got] == ["no_response", "response"]


def test_voice_rates_are_null_without_events(spark):
    row = voice.panel(tick_rows(spark, ("-", 4), ("u", 1))).first()
    assert row["turns"] == 0 and row["response_rate"] is None and row["yield_rate"] is None


def test_single_last_user_tick_is_dropped(spark):
    assert voice.drop_final_tick(tick_rows(spark, ("a", 2), ("u", 1))).count() == 2
    assert voice.drop_final_tick(tick_rows(spark, ("a", 2), ("u", 2))).count() == 4


def test_interruption_yields_within_the_window(spark):
    got = rows(voice.interruptions(tick_rows(spark, ("a", 3), ("b", 4), ("u", 3))), "event", "tick")
    assert got == [(1, 3, "user_interrupts_agent", True, pytest.approx(0.8))]


def test_overlap_with_open_ends(spark):
    kind = "g int, id int, start long, end long"
    left = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 50, None)], kind)
    right = spark.createDataFrame([(1, 7, 9, 12), (1, 8, 10, 11), (1, 9, 60, None), (2, 5, 0, 99)], kind)
    assert rows(intervals.overlaps(left, right, "g", 4).select("left_id", "right_id", "start"), "left_id", "right_id") == [(1, 7, 9), (2, 9, 60)]


def random_ticks(spark, n=40, length=60):
    import random

    draw = random.Random(7)
    flags = [[(draw.random() < 0.6, draw.random() < 0.5) for _ in range(length)] for _ in range(n)]
    df = spark.createDataFrame([(k, t, a, u) for k, ticks in enumerate(flags) for t, (a, u) in enumerate(ticks)], "simulation_id long, tick long, agent_speaks boolean, user_speaks boolean")
    return flags, df


def runs_of(said, patience):
    out = []
    for t in said:
        if out and t - out[-1][-1] <= patience:
            out[-1].append(t)
        else:
            out.append([t])
    return out


def contained_order(flags, patience):
    """The pieces of one simulation, segment by segment."""
    own, other = (runs_of([t for t, f in enumerate(flags) if f[side]], patience) for side in (0, 1))

    def split(outer, inner, before, put, rest):
        done, out = outer[0] - 1, []
        for part in sorted(inner, key=lambda p: p[-1]):
            out.append((part[-1], before, [t for t in outer if done < t <= part[-1]]))
            out.append((part[-1], put, part))
            done = part[-1]
        return out + [(done + 1, rest, [t for t in outer if t > done])]

    lies = lambda i, o: o[0] <= i[0] and i[-1] <= o[-1]
    pieces, used = [], []
    for o in other:
        if inner := [i for i in own if lies(i, o)]:
            pieces += [(at, p, ts, "user" if p != 1 else "agent") for at, p, ts in split(o, inner, 0, 1, 3)]
            used += [("u", o[0])] + [("a", i[0]) for i in inner]
    for o in own:
        inner = [i for i in other if lies(i, o) and (i[0], i[-1]) != (o[0], o[-1])]
        if inner and ("a", o[0]) not in used:
            pieces += [(at, p, ts, "user" if p == 3 else "agent") for at, p, ts in split(o, inner, 1, 3, 1)]
            used += [("a", o[0])] + [("u", i[0]) for i in inner]
    pieces += [(o[0], 1, o, "agent") for o in own if ("a", o[0]) not in used] + [(o[0], 0, o, "user") for o in other if ("u", o[0]) not in used]
    return [(who, ts[0], ts[-1] + 1) for _, _, ts, who in sorted((p for p in pieces if p[2]), key=lambda p: p[:2])]


@pytest.mark.parametrize("patience", [1, 3])
def test_containment_against_segment_by_segment(spark, patience):
    flags, df = random_ticks(spark)
    got = {}
    for r in linearize.containment(df, patience=patience).orderBy("simulation_id", "position").collect():
        got.setdefault(r["simulation_id"], []).append((r["speaker"], r["start_tick"], r["end_tick"]))
    assert got == {k: contained_order(f, patience) for k, f in enumerate(flags)}


def test_containment_with_silences_and_calls(spark):
    calls = spark.createDataFrame([(1, 3)], "simulation_id long, tick long")
    got = linearize.containment(tick_rows(spark, ("a", 2), ("s", 4), ("u", 2)), silent=3, calls=calls).orderBy("position").collect()
    assert [(r["speaker"], r["start_tick"], r["end_tick"]) for r in got] == [("agent", 0, 2), ("system", 2, 6), ("tool", 3, 4), ("user", 6, 8)]


def gathered_order(flags, patience):
    """The utterances of one simulation, tick after tick."""
    out, t = [], 0
    while t < len(flags):
        if all(flags[t]):
            heard, said, quiet = [], [], 0
            while t < len(flags):
                quiet = 0 if flags[t][0] else quiet + 1
                if quiet >= patience:
                    break
                heard += [(t, "user")] * flags[t][1]
                said += [(t, "agent")] * flags[t][0]
                t += 1
            out += heard + said
        else:
            out += [(t, "user")] * flags[t][1] + [(t, "agent")] * flags[t][0]
            t += 1
    return out


@pytest.mark.parametrize("patience", [1, 3])
def test_overlaps_are_gathered(spark, patience):
    flags, df = random_ticks(spark)
    got = {}
    for r in linearize.gathered(df, patience=patience).orderBy("simulation_id", "position").collect():
        got.setdefault(r["simulation_id"], []).append((r["tick"], r["speaker"]))
    assert got == {k: gathered_order(f, patience) for k, f in enumerate(flags)}


def test_bm25_fills_with_zero_and_breaks_ties_by_id(spark):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish"), (3, "")], "doc_id int, text string")
    found = retrieval.Bm25Index.build(docs).search(spark.createDataFrame([(1, "green")], "query_id int, query string"))
    assert found.count() == 0
    assert rows(retrieval.filled_top_k(found.select("doc_id", "score"), docs, 2), "doc_id") == [(1, 0.0), (2, 0.0)]


def test_grep_quotes_a_bad_pattern(spark):
    docs = spark.createDataFrame([(1, "a(b a(b"), (2, "ab")], "doc_id int, text string")
    assert rows(retrieval.grep(docs, "a(b"), "doc_id") == [(1, 2.0)]


def test_ledger_keeps_nulls_and_last_cumulatives(spark):
    df = spark.createDataFrame([("m", 1, "delta", "s", 1, None), ("m", 2, "cumulative", "s", 5, None), ("m", 3, "cumulative", "s", 7, None)], "model string, seq int, semantics string, scope_id string, a long, b long")
    assert rows(usage.ledger(df, ["model"], ("a", "b")), "model") == [("m", 8, None)]
    costs = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0)], "session int, cost double")
    assert rows(usage.session_cost(costs, "session"), "session") == [(1, None), (2, 2.0)]


def test_keyed_changes(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "id int, s string, n int")
    new, fresh = dml.insert_if_absent(table, spark.createDataFrame([(2, "x", 9), (3, "c", 3)], "id int, s string, n int"), "id")
    assert new.count() == 3 and rows(fresh, "id") == [(3, "c", 3)]
    assert rows(dml.update_by_id(table, spark.createDataFrame([(2, "b")], "id int, s string"), "id"), "id") == [(1, "a", 1), (2, "b", 2)]
    kept, gone = dml.delete_where(table, {"s__ne": "a"})
    assert rows(kept, "id") == [(1, "a", 1)] and rows(gone, "id") == [(2, None, 2)]
    stored = spark.createDataFrame([("t", 0, 1)], "task string, trial int, seq int")
    more = spark.createDataFrame([("t", 0, 2), ("t", 1, 3), ("t", 1, 4)], "task string, trial int, seq int")
    assert rows(dml.append_once(stored, more, ["task", "trial"]), "seq") == [("t", 0, 1), ("t", 1, 3)]


def test_trim_takes_tool_messages_first(spark):
    df = spark.createDataFrame([(1, 0, "user", "u" * 2000), (1, 1, "tool", "t" * 1500), (1, 2, "tool", "short")], "simulation_id int, pos int, role string, content string")
    sizes = [len(r["content"]) for r in dml.trim_to_budget(df, 3000).orderBy("pos").collect()]
    assert sizes[0] == 2000 and sizes[1] < 800 and sizes[2] == 5


def test_ranks_put_nulls_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 1.0)], "model string, score double")
    assert rows(leaderboard.ranked(df, "score", "model").select("model", "rank"), "rank") == [("a", 1), ("c", 2), ("b", 3)]
    assert leaderboard.overall(df, needed=1).where("model = 'b'").first()["overall"] is None


def test_histogram_closes_its_last_bin(spark):
    df = spark.sql("select explode(array(0.0D, 0.5D, 1.0D, 1.1D)) as v")
    assert rows(leaderboard.histogram(df, "v", 0.0, 1.0, 2), "bin") == [(0, 1), (1, 2)]


def test_tasks_by_id_raise_on_missing_ones(spark):
    df = spark.createDataFrame([("1",), ("x",), ("0",)], "task_id string")
    with pytest.raises(ValueError, match="nope"):
        work.select_tasks(df, ids=["1", "nope"])
    assert rows(work.select_tasks(df, first=2), "task_id") == [("0",), ("1",)]
    items = [spark.createDataFrame([(x,) for x in s], "item string") for s in ("ab", "c")]
    assert work.composed(items).count() == 6


def run_file(simulations):
    return {"timestamp": "2024", "info": {"num_trials": 2, "environment_info": {"domain_name": "d"}}, "tasks": [{"id": "t1", "evaluation_criteria": {"actions": [{"name": "f", "arguments": {"x": "1"}}]}}], "simulations": simulations, "simulation_index": [{"id": s["id"], "task_id": s["task_id"]} for s in simulations]}


SIM = {"id": "s1", "task_id": "t1", "trial": 0, "reward_info": {"reward": 1.0}, "messages": [{"role": "assistant", "content": "hi", "tool_calls": [{"name": "f", "arguments": {"x": "1"}}]}], "ticks": [{"tick_id": 0, "user_chunk": {"contains_speech": True}}]}


def test_run_file_in_both_layouts(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps(run_file([SIM])))
    run = runs.read_run(spark, str(tmp_path / "run.json"))
    flat = runs.flatten(run).first()
    assert (flat["reward"], flat["num_actions"], flat["num_messages"]) == (1.0, 1, 1)
    assert runs.tool_calls(run.simulations).select(argument_map(F.col("arguments"))).first()[0] == {"x": '"1"'}
    assert tuple(runs.ticks(run.simulations).first()) == ("s1", 0, True, False)
    folder = tmp_path / "dir"
    (folder / "simulations").mkdir(parents=True)
    (folder / "results.json").write_text(json.dumps(run_file([SIM]) | {"simulations": []}))
    (folder / "simulations" / "s1.json").write_text(json.dumps(SIM))
    assert runs.read_run(spark, str(folder), layout="dir").simulations.count() == 1
    (folder / "simulations" / "s2.json").write_text(json.dumps(SIM | {"id": "s2"}))
    with pytest.raises(ValueError, match="s2"):
        runs.read_run(spark, str(folder), layout="dir")
    assert runs.read_metadata(spark, str(tmp_path / "run.json")).index.count() == 1


def test_missing_task_raises_only_when_strict(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps(run_file([SIM | {"task_id": "gone"}])))
    run = runs.read_run(spark, str(tmp_path / "run.json"))
    with pytest.raises(KeyError):
        runs.flatten(run)
    assert runs.flatten(run, strict=False).first()["num_actions"] is None


def test_schemas_parse():
    assert "simulations" in schemas.run_schema().fieldNames()


def test_stream_equals_batch(spark, tmp_path):
    spark.sql("select id as event_id, id % 3 as user_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,cast(id as int)*7) as ts, 'view' as event_type from range(200)").write.parquet(str(tmp_path / "in"))
    stream = events.tumbling_counts(events.read_events(spark, str(tmp_path / "in")), late="10 days")
    job = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    job.awaitTermination(120)
    batch = events.tumbling_counts(spark.read.parquet(str(tmp_path / "in")))
    assert rows(spark.table("counts"), "start") == rows(batch, "start")


def test_written_runs_are_read_again(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps(run_file([SIM, SIM | {"id": "s2"}])))
    run = runs.read_run(spark, str(tmp_path / "run.json"))
    runs.write_run(run, str(tmp_path / "again"), "json")
    runs.convert_run(spark, str(tmp_path / "again"), str(tmp_path / "folder"), "dir")
    for path, layout in (("again", "json"), ("folder", "dir")):
        got = runs.read_run(spark, str(tmp_path / path), layout)
        assert rows(got.simulations.select("id", "reward_info.reward", F.size("messages")), "id") == [("s1", 1.0, 1), ("s2", 1.0, 1)]
        assert got.tasks.count() == 1 and got.index.count() == 2 and got.info.first()["num_trials"] == 2
    changed = runs.read_run(spark, str(tmp_path / "folder"), "dir")
    changed.info = changed.info.withColumn("num_trials", F.lit(7))
    runs.write_metadata(changed, str(tmp_path / "folder"))
    got = runs.read_run(spark, str(tmp_path / "folder"), "dir")
    assert got.info.first()["num_trials"] == 7 and got.index.count() == 2 and got.simulations.count() == 2


def test_transfer_only_tasks_and_settings(spark, tmp_path):
    run = run_file([SIM])
    run["tasks"] = [{"id": "t1", "evaluation_criteria": {"actions": [{"name": "Transfer_to_human_agents"}]}}]
    (tmp_path / "run.json").write_text(json.dumps(run))
    flat = runs.flatten(runs.read_run(spark, str(tmp_path / "run.json"))).first()
    assert (flat["num_actions"], flat["num_agent_actions"], flat["info_domain"], flat["info_num_trials"]) == (-1, 1, "d", 2)


def test_action_rows_merges_and_lists(spark, tmp_path):
    check = {"action": {"name": "f", "requestor": "user", "arguments": {"b": "2", "a": "1"}}, "action_match": True}
    (tmp_path / "run.json").write_text(json.dumps(run_file([SIM | {"reward_info": {"reward": 0.0, "action_checks": [check]}}, SIM | {"id": "s2", "reward_info": None}])))
    run = runs.read_run(spark, str(tmp_path / "run.json"))
    assert rows(run_reports.action_rows(run.simulations), "task_id") == [("t1", 0, "user", "f", "f(b=2, a=1)", True)]
    assert "tool_calls" not in run_reports.without_message_fields(run.simulations, ["tool_calls"]).schema["messages"].dataType.elementType.names
    df = spark.sql("select struct(1 as a, struct(2 as b, 3 as c) as d) as old, struct(cast(null as int) as a, struct(5 as b, cast(null as int) as c) as d) as new")
    assert df.select(run_reports.merged_document(F.col("old"), F.col("new"), df.schema["old"].dataType).alias("m")).first()["m"].asDict(True) == {"a": 1, "d": {"b": 5, "c": 3}}
    lists = spark.sql("select array('a', 'b', 'b') as x, array('b') as y, array('c') as z")
    assert lists.select(run_reports.missing_ids(F.col("x"), F.col("y")), run_reports.disjoint(F.col("x"), F.col("z")), run_reports.covers_basis(F.col("y"), F.col("x"))).first()[:] == (["a"], True, True)


def test_files_logs_and_names(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text("12:01 WARN slow\n12:02 INFO fine\nnoise\n")
    (tmp_path / "a" / "y.txt").write_text("z")
    assert runs.file_list(spark, [str(tmp_path / "a"), str(tmp_path / "a" / "x.log")], ".log").count() == 1
    assert [r[1:] for r in rows(runs.log_lines(spark, str(tmp_path / "a" / "x.log"), r"^(\S+) (WARN|INFO)", ["at", "level"]), "at")] == [("12:01", "WARN"), ("12:02", "INFO")]
    df = spark.createDataFrame([("runs/gpt-4_1_air_line_base_user-x_4trials_10tasks.json",), ("m_retail_solo_u_1trials.json.bak",), ("runs/none.json",)], "p string")
    assert [r[:] for r in df.select(*runs.named_parameters(F.col("p"))).collect()] == [("gpt-4_1_air", "line", "base", "user-x", 4, 10), ("m", "retail", "solo", "u", 1, None), (None,) * 6]


def test_windows_are_whole_ticks_and_open_intervals_meet_later_ones(spark):
    assert voice.VoiceConfig().ticks(0.35) == 1 and voice.VoiceConfig().ticks(0.6) == 2
    left = spark.createDataFrame([(1, 1, 0, None), (1, 2, 5, 6)], "g int, id int, start long, end long")
    right = spark.createDataFrame([(1, 7, 10**9, 10**9 + 5), (1, 8, 5, None)], "g int, id int, start long, end long")
    assert rows(intervals.overlaps(left, right, "g", 10).select("left_id", "right_id"), "left_id", "right_id") == [(1, 7), (1, 8), (2, 8)]


def test_actions_are_dealt_by_their_number(spark, monkeypatch):
    """A task's share of actions and calls is bounded, and nothing is sorted to tell equal calls."""
    monkeypatch.setattr(rewards, "ROWS_OF_A_TASK", 10)
    gold = spark.range(100).selectExpr("id AS simulation_id", "id AS action_id", "'f' AS name", "map('a', string(id % 3), 'b', null) AS arguments", "cast(null AS array<string>) AS compare_args")
    calls = spark.range(400).selectExpr("id % 100 AS simulation_id", "'f' AS name", "CASE WHEN id % 7 > 0 THEN map('b', null, 'a', string(id % 2)) END AS arguments")
    got = rewards.match_actions(gold, calls)
    wanted = {s: any((s + 100 * j) % 7 and str((s + 100 * j) % 2) == str(s % 3) for j in range(4)) for s in range(100)}
    assert {r["simulation_id"]: r["matched"] for r in got.collect()} == wanted and {True, False} == set(wanted.values())
    plan = got._jdf.queryExecution().toString()
    assert "(simulation_id" in plan and ", 50)" in plan and "SortAggregate" not in plan
