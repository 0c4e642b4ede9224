"""Registered queries of messages, judges' answers and transcripts, on the driver's tables, with their SQL.

Simulations are users and ticks their events; message histories are conversations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens.operators import judgments, messages, transcript_slices
from convolens.plans.proxies import TICKS, _t, query, ticks
from convolens.streaming import dialogues

# --- messages ----------------------------------------------------------------------------------


@query(f"""WITH {TICKS}, t AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN greatest(tick - 5, 0) ELSE tick END AS said FROM ticks),
m AS (
  SELECT simulation_id, tick, 0 AS slot, 0 AS nth, 'assistant' AS role, CASE WHEN agent_speaks THEN event_type END AS content, CASE WHEN agent_speaks OR event_id % 4 = 0 THEN said ELSE tick END AS moment, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS calls FROM t WHERE agent_speaks OR event_id % 4 = 0 OR event_id % 5 = 0
  UNION ALL SELECT simulation_id, tick, 1, 0, 'tool', 'ok', tick, 0 FROM t WHERE event_id % 5 = 0
  UNION ALL SELECT simulation_id, tick, 2, 0, 'user', event_type, said, 0 FROM t WHERE user_speaks
  UNION ALL SELECT simulation_id, tick, 3, n, 'tool', ['x', 'y'][n + 1], tick, 0 FROM t, (VALUES (0), (1)) v(n) WHERE event_id % 11 = 0)
SELECT simulation_id, row_number() OVER (PARTITION BY simulation_id ORDER BY moment, tick, slot, nth) - 1 AS turn_idx, tick AS tick_id, role, content, calls FROM m""")
def tick_messages(spark, sf_dir):
    """Every fourth tick has an agent chunk without text, every fifth a call, every thirteenth chunks that were said earlier."""
    event, tick = F.col("event_id"), F.col("tick")
    stamp = lambda c: F.lpad(c.cast("string"), 12, "0")
    said = stamp(F.when(event % 13 == 0, F.greatest(tick - 5, F.lit(0))).otherwise(tick))
    text = lambda who: F.when(F.col(f"{who}_speaks"), F.col("event_type"))
    chunk = lambda who: F.struct(text(who).alias("content"), said.alias("timestamp"), F.col(f"{who}_speaks").alias("contains_speech"))
    result = lambda text_: F.struct(F.lit("r").alias("id"), F.lit(text_).alias("content"), F.lit(None).cast("string").alias("timestamp"))
    call = F.array(F.struct(F.lit("r").alias("id"), F.lit("f").alias("name")))
    typed = ticks(spark, sf_dir).select(
        "simulation_id",
        tick.alias("tick_id"),
        stamp(tick).alias("timestamp"),
        F.when(F.col("agent_speaks") | (event % 4 == 0), chunk("agent")).alias("agent_chunk"),
        F.when(F.col("user_speaks"), chunk("user")).alias("user_chunk"),
        F.when(event % 5 == 0, call).alias("agent_tool_calls"),
        F.when(event < 0, call).alias("user_tool_calls"),
        F.when(event % 5 == 0, F.array(result("ok"))).alias("agent_tool_results"),
        F.when(event % 11 == 0, F.array(result("x"), result("y"))).alias("user_tool_results"),
    )
    return messages.from_ticks(typed).select("simulation_id", "turn_idx", "tick_id", "role", "content", F.coalesce(F.size("tool_calls"), F.lit(0)).alias("calls"))


@query("""WITH c AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN '' ELSE event_type END AS content, ['u' || event_id // 400, 'w' || event_id % 2][1:event_id % 3] AS ids, CASE WHEN event_id % 50 = 0 THEN 'yield' || CASE WHEN event_id % 100 = 0 THEN ': ' || event_type ELSE '' END END AS act FROM events),
s AS (SELECT *, lag(ids) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM c WHERE content <> ''),
texts AS (SELECT user_id, string_agg(CASE WHEN len(ids) > 0 AND len(last) > 0 AND NOT list_has_any(ids, last) THEN ' ' ELSE '' END || content, '' ORDER BY event_id) AS content FROM s GROUP BY user_id),
firsts AS (SELECT user_id, id, min(event_id * 4 + k) AS place FROM (SELECT user_id, event_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS k FROM c) GROUP BY ALL),
named AS (SELECT user_id, string_agg(id, ' ' ORDER BY place) AS utterance_ids FROM firsts GROUP BY user_id)
SELECT c.user_id, coalesce(any_value(t.content), '') AS content, coalesce(any_value(n.utterance_ids), '') AS utterance_ids, coalesce(string_agg(act, chr(10) ORDER BY event_id), 'No turn-taking actions in merged chunks.') AS action_info, CAST(count(*) AS INTEGER) AS chunks
FROM c LEFT JOIN texts t USING (user_id) LEFT JOIN named n USING (user_id) GROUP BY c.user_id""")
def merged_chunks(spark, sf_dir):
    event = F.col("event_id")
    ids = F.slice(F.array(F.concat(F.lit("u"), F.floor(event / 400).cast("string")), F.concat(F.lit("w"), (event % 2).cast("string"))), 1, (event % 3).cast("int"))
    rows = _t(spark, sf_dir, "events").select("user_id", event.alias("pos"), F.when(event % 4 == 0, "").otherwise(F.col("event_type")).alias("content"), ids.alias("utterance_ids"), F.when(event % 50 == 0, "yield").alias("action"), F.when(event % 100 == 0, F.col("event_type")).alias("info"))
    return messages.merge_chunks(rows, ["user_id"]).withColumn("utterance_ids", F.array_join("utterance_ids", " "))


#: assistant messages call once or twice; system messages are results, the id of some of which is another
HISTORY = """h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN role = 'system' OR turn % 3 = 2 THEN 'tool' ELSE role END AS role, turn, length(text) AS n FROM conversations),
c AS (SELECT conv_id, pos, k AS call, pos + 1 + k AS result_pos, concat('c', pos, '.', k) AS call_id FROM h, (VALUES (0), (1)) v(k) WHERE role = 'assistant' AND k <= n % 2),
r AS (SELECT conv_id, pos, role, concat('c', CASE WHEN n % 5 = 0 THEN 0 ELSE pos - 1 END, '.0') AS id FROM h)"""


def _history(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = _t(spark, sf_dir, "conversations")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    role = F.when((F.col("role") == "system") | (F.col("turn") % 3 == 2), "tool").otherwise(F.col("role"))
    n = F.length("text")
    placed = rows.select(F.col("conv_id").alias("simulation_id"), pos.alias("pos"), role.alias("role"), n.alias("n"))
    named = lambda p, k: F.concat(F.lit("c"), p.cast("string"), F.lit(f".{k}"))
    calls = F.when(F.col("role") == "assistant", F.when(F.col("n") % 2 == 1, F.array(named(F.col("pos"), 0), named(F.col("pos"), 1))).otherwise(F.array(named(F.col("pos"), 0))))
    return placed.select("simulation_id", "pos", "role", calls.alias("call_ids"), named(F.when(F.col("n") % 5 == 0, F.lit(0)).otherwise(F.col("pos") - 1), 0).alias("id"))


@query(f"""WITH {HISTORY} SELECT c.conv_id AS simulation_id, c.pos, c.call, c.call_id, c.result_pos FROM c JOIN r ON r.conv_id = c.conv_id AND r.pos = c.result_pos WHERE r.role = 'tool' AND r.id = c.call_id""")
def position_pairs(spark, sf_dir):
    return messages.pair_by_position(_history(spark, sf_dir))[0]


@query(f"""WITH {HISTORY} SELECT c.conv_id AS simulation_id, c.pos, c.call, CASE WHEN r.role IS NULL THEN 'no result' WHEN r.role <> 'tool' THEN 'not a result' ELSE 'other id' END AS violation
FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.pos = c.result_pos WHERE NOT coalesce(r.role = 'tool' AND r.id = c.call_id, false)
UNION ALL SELECT conv_id, pos, NULL, 'result without call' FROM r WHERE role = 'tool' AND NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.result_pos = r.pos)""")
def position_violations(spark, sf_dir):
    return messages.pair_by_position(_history(spark, sf_dir))[1]


# --- answers of judges -------------------------------------------------------------------------

#: texts around a review of an event: fenced, bare, with text around, without fields, broken, of another kind, no JSON
_ANSWERS = (
    'Here it is:\n```json\n{"summary": "#", "errors": [{"source": "Agent", "severity": "critical", "error_tags": "late"}]}\n```\nDone.',
    'I think {"errors": [{"source": "user", "severity": "critical_helped", "error_tags": ["a", "b"]}, {"source": "agent", "severity": "critical_helped"}]} is right',
    '{"summary": "#"}',
    '```\n{"errors": [{"source": "nobody"}, {"source": "user", "severity": "minor"}], "summary": "#"}\n```',
    '{"summary": "#", "errors": [',
    "[#, 1]",
    "no review of #",
)
_ANSWER_SQL = "replace([" + ", ".join("'" + a.replace("\n", "' || chr(10) || '") + "'" for a in _ANSWERS) + "][event_id % 7 + 1], '#', event_type)"
ANSWERS = f"""a AS (SELECT event_id, {_ANSWER_SQL} AS answer FROM events WHERE event_id % 8 <> 7 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 8 = 7),
x AS (SELECT *, CASE WHEN contains(answer, '```') THEN trim(regexp_extract(answer, '```(?:json)?\\s*([\\s\\S]*?)```', 1), ' ' || chr(10)) WHEN regexp_matches(answer, '\\{{[\\s\\S]*\\}}') THEN regexp_extract(answer, '(\\{{[\\s\\S]*\\}})', 1) ELSE answer END AS j FROM a),
p AS (SELECT *, CASE WHEN answer IS NULL THEN 'no answer' WHEN json_valid(j) AND json_type(j) = 'OBJECT' THEN NULL WHEN json_valid(j) THEN 'no object' WHEN contains(j, '{{') THEN 'broken json' ELSE 'no json' END AS reason FROM x)"""


def _answers(spark, sf_dir):
    event = F.col("event_id")
    form = F.element_at(F.array(*map(F.lit, _ANSWERS)), (event % 7 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", F.when(event % 8 != 7, F.replace(form, F.lit("#"), F.col("event_type"))).alias("answer"))


@query(f"""WITH {ANSWERS}, good AS (SELECT event_id, j FROM p WHERE reason IS NULL),
e AS (SELECT event_id, i, lower(json_extract_string(j, '$.errors[' || i || '].source')) AS source, json_extract_string(j, '$.errors[' || i || '].severity') AS severity
  FROM good, range(0, 3) r(i) WHERE i < coalesce(json_array_length(j, '$.errors'), 0)),
t AS (SELECT event_id, i, CASE WHEN source IN ('user', 'agent') THEN source ELSE 'unknown' END AS source,
  CASE WHEN source = 'user' AND severity IN ('minor', 'critical_helped', 'critical_hindered') OR source = 'agent' AND severity IN ('minor', 'critical') THEN severity END AS severity FROM e)
SELECT g.event_id, coalesce(json_extract_string(g.j, '$.summary'), '') AS summary, count(t.i) > 0 AS has_errors, coalesce(bool_or(t.source = 'agent'), false) AS agent_error, coalesce(bool_or(t.source = 'user'), false) AS user_error,
  coalesce(bool_or(t.source = 'user' AND t.severity IN ('critical_helped', 'critical_hindered')), false) AS critical_user_error, coalesce(string_agg(t.source || ':' || coalesce(t.severity, '-'), ' ' ORDER BY t.i), '') AS listed
FROM good g LEFT JOIN t USING (event_id) GROUP BY g.event_id, g.j""")
def review_answers(spark, sf_dir):
    rows = judgments.read_reviews(_answers(spark, sf_dir))
    listed = F.array_join(F.transform("errors", lambda e: F.concat(e["source"], F.lit(":"), F.coalesce(e["severity"], F.lit("-")))), " ")
    return rows.select("event_id", "summary", "has_errors", "agent_error", "user_error", "critical_user_error", listed.alias("listed"))


@query(f"WITH {ANSWERS} SELECT event_id, answer, reason FROM p WHERE reason IS NOT NULL")
def unread_answers(spark, sf_dir):
    return judgments.dead_letters(_answers(spark, sf_dir))


# --- transcripts -------------------------------------------------------------------------------


@query(f"""WITH {TICKS}, spoken AS (SELECT simulation_id, tick, tick - row_number() OVER (PARTITION BY simulation_id ORDER BY tick) AS g FROM ticks WHERE event_type <> 'error'),
p AS (SELECT simulation_id, tick, dense_rank() OVER (PARTITION BY simulation_id ORDER BY g) - 1 AS seg, tick * 200 AS s, tick * 200 + 200 AS e FROM spoken),
seg AS (SELECT simulation_id, seg, min(s) AS s0, max(e) AS s1, min(tick) AS t0, max(tick) AS t1, max(max(seg)) OVER (PARTITION BY simulation_id) AS last_seg FROM p GROUP BY simulation_id, seg),
said AS (SELECT simulation_id, tick * 200 - (event_id % 9) * 90 AS s, tick * 200 + (event_id % 6) * 330 AS e, event_type || ' ' || event_id AS text FROM ticks WHERE event_id % 10 = 0),
marked AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY simulation_id ORDER BY s, e, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 500 THEN 1 ELSE 0 END AS fresh FROM said),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY simulation_id ORDER BY s, e, text ROWS UNBOUNDED PRECEDING) AS t FROM marked),
d AS (SELECT simulation_id, t, min(s) AS s, max(e) AS e, string_agg(text, ' ' ORDER BY s, e, text) AS text FROM numbered GROUP BY ALL),
own AS (SELECT d.*, coalesce(min(seg.seg) FILTER (WHERE d.e <= seg.s0 OR d.s < seg.s1), max(seg.last_seg)) AS seg FROM d JOIN seg USING (simulation_id) GROUP BY ALL),
cur AS (SELECT o.simulation_id, o.t, p.tick, max(CASE WHEN o.e <= o.s THEN length(o.text) ELSE CAST(ceil(least(1.0, (least(p.e, o.e) - o.s) / (o.e - o.s)) * length(o.text)) AS BIGINT) END) AS upto FROM own o JOIN p ON p.simulation_id = o.simulation_id AND p.seg = o.seg AND p.s < o.e AND p.e > o.s GROUP BY ALL
  UNION ALL SELECT o.simulation_id, o.t, seg.t0, length(o.text) FROM own o JOIN seg USING (simulation_id, seg) WHERE o.e <= seg.s0),
reached AS (SELECT *, max(upto) OVER (PARTITION BY simulation_id, t ORDER BY tick ROWS UNBOUNDED PRECEDING) AS now FROM (SELECT simulation_id, t, tick, max(upto) AS upto FROM cur GROUP BY ALL)),
was AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY simulation_id, t ORDER BY tick), 0) AS before FROM reached),
parts AS (SELECT w.simulation_id, w.tick, 0 AS rest, w.t, substr(o.text, w.before + 1, w.now - w.before) AS piece FROM was w JOIN own o USING (simulation_id, t)
  UNION ALL SELECT o.simulation_id, seg.t1, 1, o.t, substr(o.text, coalesce((SELECT max(now) FROM reached r WHERE r.simulation_id = o.simulation_id AND r.t = o.t), 0) + 1) FROM own o JOIN seg USING (simulation_id, seg))
SELECT p.simulation_id, p.tick, string_agg(piece, ' ' ORDER BY rest, t) FILTER (WHERE piece <> '') AS user_transcript FROM p LEFT JOIN parts USING (simulation_id, tick) GROUP BY p.simulation_id, p.tick""")
def spread_transcripts(spark, sf_dir):
    """Ticks of 200 ms; all but errors carry user text, every tenth event has a transcript that began earlier or ends later."""
    rows, event = ticks(spark, sf_dir), F.col("event_id")
    start = F.col("tick") * 200
    timed = rows.select("simulation_id", "tick", (F.col("event_type") != "error").alias("spoken"), start.alias("start_ms"), (start + 200).alias("end_ms"))
    said = rows.where(event % 10 == 0).select("simulation_id", (start - event % 9 * 90).alias("start_ms"), (start + event % 6 * 330).alias("end_ms"), F.concat_ws(" ", "event_type", event.cast("string")).alias("text"))
    return transcript_slices.distribute(timed, said)


# --- who holds the floor -----------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'user_start' WHEN 'view' THEN 'user_stop' WHEN 'purchase' THEN 'agent_start' ELSE 'agent_stop' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'signup'),
m AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, false AS u, false AS a, false AS w, NULL::TIMESTAMP AS since, 'idle' AS before, 'idle' AS after, NULL::TIMESTAMP AS lapsed FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, n, event_id, ts, u, a, w, CASE WHEN after = 'waiting' THEN CASE WHEN before = 'waiting' THEN since ELSE ts END END, before, after, lapsed FROM (
    SELECT *, CASE WHEN u AND a THEN 'both' WHEN u THEN 'user' WHEN a THEN 'agent' WHEN w THEN 'waiting' ELSE 'idle' END AS after FROM (
      SELECT e.user_id, e.n, e.event_id, e.ts, m.since, CASE WHEN e.kind = 'user_start' THEN true WHEN e.kind = 'user_stop' THEN false ELSE m.u END AS u, CASE WHEN e.kind = 'agent_start' THEN true WHEN e.kind = 'agent_stop' THEN false ELSE m.a END AS a,
        CASE WHEN e.kind IN ('user_start', 'agent_start') THEN false WHEN e.kind = 'user_stop' AND m.u THEN true ELSE m.w AND NOT gone END AS w,
        CASE WHEN gone THEN 'idle' ELSE m.after END AS before, CASE WHEN gone THEN m.since + INTERVAL 30 MINUTE END AS lapsed
      FROM (SELECT *, since IS NOT NULL AS waits FROM m) m JOIN e ON e.user_id = m.user_id AND e.n = m.n + 1 CROSS JOIN LATERAL (SELECT m.waits AND e.ts >= m.since + INTERVAL 30 MINUTE AS gone))))
SELECT user_id AS simulation_id, ts, event_id, before, after FROM m WHERE before <> after
UNION ALL SELECT user_id, lapsed, NULL, 'waiting', 'idle' FROM m WHERE lapsed IS NOT NULL
UNION ALL SELECT user_id, since + INTERVAL 30 MINUTE, NULL, 'waiting', 'idle' FROM m WHERE since IS NOT NULL AND n = (SELECT max(n) FROM e WHERE e.user_id = m.user_id)""")
def floor_states(spark, sf_dir):
    """Clicks start and views end the user's speech, purchases start and errors end the agent's; patience is half an hour."""
    kind = F.create_map(*[F.lit(x) for pair in (("click", "user_start"), ("view", "user_stop"), ("purchase", "agent_start"), ("error", "agent_stop")) for x in pair])
    events = _t(spark, sf_dir, "events").select(F.col("user_id").alias("simulation_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.try_element_at(kind, F.col("event_type")).alias("kind"))
    return dialogues.floor_states_batch(events, 1800).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
