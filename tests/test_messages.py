"""Messages from ticks, merged chunks, pairs by position, answers of judges and spread transcripts, each against plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from convolens.operators import judgments, messages, transcript_slices
from convolens.sources import schemas


def test_ticks_become_messages_with_calls_and_results(spark):
    call = {"id": "c1", "name": "f", "requestor": "assistant"}
    ticks = [
        {"tick_id": 0, "timestamp": "2024-01-01T00:00:02", "agent_chunk": {"content": "hi", "contains_speech": True, "timestamp": "2024-01-01T00:00:02"}, "user_chunk": {"content": None, "timestamp": "2024-01-01T00:00:02"}},
        {"tick_id": 1, "timestamp": "2024-01-01T00:00:01", "agent_tool_calls": [call], "agent_tool_results": [{"id": "c1", "content": "r1"}, {"id": "c2", "content": "r2"}], "user_chunk": {"content": "yo", "contains_speech": True, "timestamp": "2024-01-01T00:00:03"}},
        {"tick_id": 2, "timestamp": "2024-01-01T00:00:09", "user_tool_results": [{"id": "u", "content": "late"}]},
    ]
    sims = [{"id": "a", "ticks": ticks}, {"id": "b", "messages": [{"role": "user", "content": "kept"}], "ticks": ticks}, {"id": "c"}]
    df = spark.read.schema(schemas.struct(schemas.SIMULATION)).json(spark.sparkContext.parallelize([json.dumps(s) for s in sims]))
    got = sorted((r.simulation_id, r.turn_idx, r.role, r.content) for r in messages.of_simulations(df).collect())
    assert got == [("a", 0, "assistant", None), ("a", 1, "tool", "r1"), ("a", 2, "tool", "r2"), ("a", 3, "assistant", "hi"), ("a", 4, "user", None), ("a", 5, "user", "yo"), ("a", 6, "tool", "late"), ("b", 0, "user", "kept")]
    first = messages.from_ticks(df.select(F.col("id").alias("simulation_id"), F.explode("ticks").alias("t")).where("simulation_id = 'a'").select("simulation_id", "t.*")).orderBy("turn_idx").collect()
    assert [len(r.tool_calls or []) for r in first] == [1, 0, 0, 0, 0, 0, 0] and first[1].result_id == "c1" and [r.contains_speech for r in first][3:6] == [True, False, True]


def merged(chunks):
    """The rules of merging over a list of chunks."""
    text, last, some, ids, acts = "", set(), False, [], []
    for content, own, action, info in chunks:
        if content:
            own_set = set(own or [])
            text += (" " if some and own_set and last and own_set.isdisjoint(last) else "") + content
            last, some = own_set, True
    for _, own, action, info in chunks:
        ids += [x for x in own or [] if x not in ids]
        if action is not None:
            acts.append(f"{action}: {info}" if info else action)
    return text, ids, "\n".join(acts) or messages.NO_ACTIONS, len(chunks)


def test_chunks_merge_in_order(spark):
    rng, rows, wanted = random.Random(2), [], {}
    for key in range(40):
        own = [(rng.choice((None, "", "a", "bc", " d")), rng.choice((None, [], ["u1"], ["u1", "u2"], ["u2"], ["u3"])), rng.choice((None, None, "yield", "talk")), rng.choice((None, "", "why"))) for _ in range(rng.randrange(1, 9))]
        wanted[key] = merged(own)
        rows += [(key, pos, *c) for pos, c in enumerate(own)]
    rng.shuffle(rows)
    got = messages.merge_chunks(spark.createDataFrame(rows, "k int, pos int, content string, utterance_ids array<string>, action string, info string"), ["k"])
    assert {r.k: (r.content, r.utterance_ids, r.action_info, r.chunks) for r in got.collect()} == wanted


def test_pairs_and_violations(spark):
    rows = [(1, 0, "assistant", ["a", "b"], None), (1, 1, "tool", None, "a"), (1, 2, "tool", None, "b"), (1, 3, "tool", None, "z"), (1, 4, "user", ["c"], None), (1, 5, "assistant", ["d"], None), (1, 6, "tool", None, "x"), (1, 7, "user", ["e"], None), (2, 0, "user", [], None), (2, 1, "assistant", None, None)]
    pairs, wrong = messages.pair_by_position(spark.createDataFrame(rows, "simulation_id int, pos int, role string, call_ids array<string>, id string"))
    assert sorted(r[:] for r in pairs.collect()) == [(1, 0, 0, "a", 1), (1, 0, 1, "b", 2)]
    assert sorted((r[:] for r in wrong.collect()), key=str) == [(1, 3, None, "result without call"), (1, 4, 0, "not a result"), (1, 5, 0, "other id"), (1, 7, 0, "no result")]


ANSWERS = [
    (1, 'Sure:\n```json\n{"summary": "s", "errors": [{"source": "Agent", "severity": "critical", "error_tags": "t", "turn_idx": 3}]}\n```'),
    (2, 'text {"errors": [{"source": "user", "severity": "critical_helped", "error_tags": ["a", "b"]}, {"source": "agent", "severity": "critical_helped"}, {"source": "judge"}, 7]} more'),
    (3, '{"errors": [{"source": "user", '),
    (4, "nothing here"),
    (5, None),
    (6, "[1, 2]"),
    (7, "{}"),
    (8, '```\n{"summary": "x", "errors": "none"}\n```'),
    (9, '{"a": 1, "a": 2}'),
]


def test_reviews_are_read_or_kept_with_a_reason(spark):
    answers = spark.createDataFrame(ANSWERS, "id int, answer string")
    got = {r.id: r for r in judgments.read_reviews(answers).collect()}
    assert set(got) == {1, 2, 7, 8}
    assert (got[1].summary, got[1].agent_error, got[1].user_error, got[1].critical_user_error) == ("s", True, False, False)
    assert [e.asDict() for e in got[1].errors] == [{"source": "agent", "error_type": None, "error_tags": ["t"], "severity": "critical", "turn_idx": 3, "tick_start": None, "tick_end": None, "reasoning": "", "correct_behavior": None}]
    assert [(e.source, e.severity, e.error_tags) for e in got[2].errors] == [("user", "critical_helped", ["a", "b"]), ("agent", None, []), ("unknown", None, [])]
    assert got[2].critical_user_error and not got[7].has_errors and got[8].errors == []
    dead = {r.id: (r.reason, r.answer) for r in judgments.dead_letters(answers).collect()}
    assert dead == {3: ("broken json", ANSWERS[2][1]), 4: ("no json", ANSWERS[3][1]), 5: ("no answer", None), 6: ("no object", ANSWERS[5][1]), 9: ("broken json", ANSWERS[8][1])}


def test_authentications_and_hallucinations(spark):
    answers = spark.createDataFrame([(1, 'so {"status": "failed", "reasoning": "r"} {"status": "succeeded"}'), (2, '{"status": "maybe"}'), (3, "no"), (4, '{"a": {"status": "failed"}}'), (5, "{status: failed}"), (6, None)], "id int, answer string")
    got = {r.id: (r.status, r.reasoning) for r in judgments.read_authentications(answers).collect()}
    assert got == {1: ("failed", "r"), 2: ("not_needed", ""), 3: ("not_needed", judgments.UNREADABLE), 4: ("failed", ""), 5: ("not_needed", judgments.UNREADABLE), 6: ("not_needed", judgments.UNREADABLE)}
    checks = spark.createDataFrame([(1, '{"reasoning": "r", "hallucinations": [{"user_message": "m"}]}'), (2, "broken {")], "id int, answer string")
    got = {r.id: (r.reasoning, r.hallucination_found, [h.user_message for h in r.hallucinations]) for r in judgments.read_hallucinations(checks).collect()}
    assert got == {1: ("r", True, ["m"]), 2: ("unreadable: broken json", False, [])}


def spread(ticks, transcripts, gap=500):
    """The rules of spreading over lists of one simulation."""
    order, done = sorted(transcripts), []
    for s, e, text in order:
        if done and s <= done[-1][1] + gap:
            done[-1] = (done[-1][0], max(done[-1][1], e), done[-1][2] + " " + text)
        else:
            done.append((s, e, text))
    segments, last = [], None
    for k, spoken, s, e in ticks:
        if not spoken:
            last = None
            continue
        if last is None:
            segments.append([])
        last = k
        if s is not None:
            segments[-1].append((k, s, e))
    segments = [x for x in segments if x]
    shown = {k: [] for seg in segments for k, _, _ in seg}
    if segments:
        owner = {}
        for n, seg in enumerate(segments):
            s0, s1 = seg[0][1], seg[-1][2]
            for t, (s, e, _) in enumerate(done):
                if t not in owner and (e <= s0 or not (e <= s0 or s >= s1)):
                    owner[t] = n
        for n, seg in enumerate(segments):
            mine = [t for t in range(len(done)) if owner.get(t, len(segments) - 1) == n]
            at = dict.fromkeys(mine, 0)
            for k, s, e in seg:
                for t in mine:
                    a, b, text = done[t]
                    if at[t] >= len(text):
                        continue
                    if k == seg[0][0] and b <= seg[0][1] or (not (e <= a or s >= b) and b <= a):
                        new = len(text)
                    elif e <= a or s >= b:
                        continue
                    else:
                        new = max(at[t], math.ceil(min(1.0, (min(e, b) - a) / (b - a)) * len(text)))
                    if text[at[t] : new]:
                        shown[k].append(text[at[t] : new])
                    at[t] = new
            shown[seg[-1][0]] += [done[t][2][at[t] :] for t in mine if at[t] < len(done[t][2])]
    return {k: " ".join(v) or None for k, v in shown.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_transcripts_are_spread_over_ticks(spark, seed):
    rng, ticks, texts, wanted = random.Random(seed), [], [], {}
    for sim in range(25):
        own, at, spoken = [], 0, False
        for k in range(rng.randrange(1, 60)):
            spoken ^= rng.random() < 0.25
            own.append((k, spoken, *((None, None) if rng.random() < 0.05 else (at, at + 200))))
            at += 200
        heard = []
        for _ in range(rng.randrange(6)):
            s = rng.randrange(0, at + 500)
            heard.append((s, s + rng.choice((150, 700, 2500)), "".join(rng.choices("abc de", k=rng.randrange(0, 30)))))
        wanted |= {(sim, k): v for k, v in spread(own, heard).items()}
        ticks += [(sim, *t) for t in own]
        texts += [(sim, *t) for t in heard]
    got = transcript_slices.distribute(spark.createDataFrame(ticks, "simulation_id int, tick int, spoken boolean, start_ms long, end_ms long"), spark.createDataFrame(texts, "simulation_id int, start_ms long, end_ms long, text string"))
    assert {(r.simulation_id, r.tick): r.user_transcript for r in got.collect()} == wanted
