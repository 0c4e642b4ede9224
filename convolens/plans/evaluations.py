"""Registered queries of typed arguments, state replay and voice quality, on the driver's tables, with their SQL.

Simulations are users, ticks and calls their events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens.operators import replay, rewards, voice_quality
from convolens.plans.proxies import TICKS, _rounded, _t, query, ticks

# --- typed arguments ---------------------------------------------------------------------------

#: JSON of one number in several types: {"k": 3}, {"k": 3.0}, {"k": "3"}, {"k": {"v": [3, true]}}, ...
_GOLD = ('{"k": #}', '{"k": #.0}', '{"k": "#"}', '{"k": {"v": [#, true]}}')
_CALLS = ('{"k": #}', '{"k": "#"}', '{"k": {"v": [#.0, 1]}}', '{"k": #, "z": null}', "{}")


def _written(forms: tuple[str, ...]):
    """The JSON text of an event's number in the form that its id names."""
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % len(forms) + 1).cast("int"))
    return F.replace(form, F.lit("#"), F.get_json_object("props", "$.k"))


def _written_sql(forms: tuple[str, ...]) -> str:
    return f"replace([{', '.join(chr(39) + f + chr(39) for f in forms)}][event_id % {len(forms)} + 1], '#', json_extract_string(props, '$.k'))"


_VALUE = """CASE json_type({0}, '$.k') WHEN 'VARCHAR' THEN 's' || json_extract_string({0}, '$.k')
    WHEN 'OBJECT' THEN 'o' || CAST(json_extract({0}, '$.k.v[0]') AS DOUBLE) || '/' || CASE json_type({0}, '$.k.v[1]') WHEN 'BOOLEAN' THEN CAST(CAST(json_extract({0}, '$.k.v[1]') AS BOOLEAN) AS INTEGER) ELSE CAST(json_extract({0}, '$.k.v[1]') AS INTEGER) END
    ELSE 'n' || CAST(json_extract({0}, '$.k') AS DOUBLE) END"""


@query(f"""WITH g AS (SELECT user_id, event_type, event_id, {_written_sql(_GOLD)} AS j FROM events WHERE event_id % 3 = 0),
c AS (SELECT user_id, event_type, {_written_sql(_CALLS)} AS j FROM events WHERE event_id % 3 = 1),
gv AS (SELECT *, {_VALUE.format('j')} AS v FROM g), cv AS (SELECT *, len(json_keys(j)) AS n, CASE WHEN json_exists(j, '$.k') THEN {_VALUE.format('j')} END AS v FROM c)
SELECT gv.user_id AS simulation_id, gv.event_id AS action_id, gv.event_type AS name,
  coalesce(bool_or(CASE WHEN cv.n = 0 THEN gv.event_id % 2 = 0 WHEN gv.event_id % 2 = 0 AND cv.n > 1 THEN false ELSE gv.v = cv.v END), false) AS matched
FROM gv LEFT JOIN cv ON gv.user_id = cv.user_id AND gv.event_type = cv.event_type GROUP BY ALL""")
def typed_action_match(spark, sf_dir):
    """Arguments parsed as VARIANT; even actions compare the call's own keys, odd ones the key k."""
    events = _t(spark, sf_dir, "events")
    keys = F.when(F.col("event_id") % 2 == 1, F.array(F.lit("k")))
    gold = events.where("event_id % 3 = 0").select(F.col("user_id").alias("simulation_id"), F.col("event_id").alias("action_id"), F.col("event_type").alias("name"), F.parse_json(_written(_GOLD)).alias("arguments"), keys.alias("compare_args"))
    calls = events.where("event_id % 3 = 1").select(F.col("user_id").alias("simulation_id"), F.col("event_type").alias("name"), F.parse_json(_written(_CALLS)).alias("arguments"))
    return rewards.match_actions(gold, calls)


# --- state replay ------------------------------------------------------------------------------

CALLS = """c AS (SELECT user_id AS simulation_id, event_id AS pos, CASE event_type WHEN 'click' THEN 'add' WHEN 'signup' THEN 'append' WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'delete' ELSE 'look' END AS name,
  ['a', 'a/x', 'b'][event_id % 3 + 1] AS key, event_id % 2 = 0 AS even, event_id % 7 = 0 AS odd_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
r AS (SELECT k.simulation_id, k.key, c.pos, c.name, c.even, c.cents FROM (SELECT DISTINCT simulation_id, key FROM c) k JOIN c ON c.simulation_id = k.simulation_id AND ((c.name IN ('set', 'delete') AND c.key = k.key) OR (c.name = 'delete' AND c.key = 'a' AND k.key = 'a/x'))),
l AS (SELECT simulation_id, key, max(pos) AS at, arg_max(name, pos) AS last, arg_max(even, pos) AS even, arg_max(cents, pos) AS cents FROM r GROUP BY ALL HAVING arg_max(name, pos) = 'set')
SELECT l.simulation_id, l.key, CASE WHEN l.even THEN 'number' ELSE 'list' END AS kind,
  CASE WHEN l.even THEN CAST(l.cents + coalesce(sum(c.cents) FILTER (WHERE c.name = 'add' AND NOT c.odd_type), 0) AS DOUBLE) END AS number,
  CASE WHEN NOT l.even THEN coalesce(string_agg('"' || c.pos || '"', ' ' ORDER BY c.pos) FILTER (WHERE c.name = 'append'), '') END AS items
FROM l LEFT JOIN c ON c.simulation_id = l.simulation_id AND c.key = l.key AND c.pos > l.at GROUP BY l.simulation_id, l.key, l.even, l.cents"""


@query(f"WITH {CALLS}")
def state_patches(spark, sf_dir):
    """Set, add, append and delete over all events: purchases store a number or an empty list, clicks add, signups append, errors delete."""
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    quoted = F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"'))
    kind = F.col("event_type")
    name = F.when(kind == "click", "add").when(kind == "signup", "append").when(kind == "purchase", "set").when(kind == "error", "delete").otherwise("look")
    value = F.when(kind == "purchase", F.when(F.col("event_id") % 2 == 0, cents).otherwise("[]")).when(kind == "click", F.when(F.col("event_id") % 7 == 0, quoted).otherwise(cents)).when(kind == "signup", quoted)
    key = F.element_at(F.array(F.lit("a"), F.lit("a/x"), F.lit("b")), (F.col("event_id") % 3 + 1).cast("int"))
    calls = _t(spark, sf_dir, "events").select(F.col("user_id").alias("simulation_id"), F.col("event_id").alias("pos"), name.alias("name"), key.alias("key"), value.alias("value"))
    state = replay.replay(calls, block=1000)
    return state.select("simulation_id", "key", "kind", F.col("number").cast("double").alias("number"), F.when(F.col("kind") == "list", F.array_join("items", " ")).alias("items"))


# --- voice quality -----------------------------------------------------------------------------

WINDOWS = voice_quality.Windows(0.5, no_yield=2.0, backchannel_yield=1.0, vocal_tic_yield=0.5, non_directed_yield=1.0, vocal_tic_response=2.0, non_directed_response=1.0)
#: the events by range joins over stretches of ticks; windows in ticks: 4 to yield, 2 (backchannel), 1 (tic), 2 (aside), answers 4 and 2
EVENTS = f"""{TICKS},
x AS (SELECT simulation_id, tick, user_speaks AS u, agent_speaks AS a, event_id % 7 = 0 AS bc, CASE WHEN event_id % 5 = 0 THEN concat('tic', event_id % 2) END AS vt, CASE WHEN event_id % 6 = 0 THEN 'hold' END AS nd, event_type AS txt FROM ticks),
marked AS (SELECT *, max(tick) OVER (PARTITION BY simulation_id) AS lt, lag(u) OVER (PARTITION BY simulation_id ORDER BY tick) AS pu FROM x),
k AS (SELECT * FROM marked WHERE NOT coalesce(tick = lt AND u AND NOT pu, false)),
us AS (SELECT simulation_id, min(tick) AS s, max(tick) + 1 AS e, arg_min(a, tick) AS oa, arg_max(a, tick) AS ae, arg_min(bc, tick) AS bc, bool_or(vt IS NOT NULL) AS vt, bool_or(nd IS NOT NULL) AS nd, string_agg(txt, '' ORDER BY tick) AS tx
  FROM (SELECT *, tick - row_number() OVER (PARTITION BY simulation_id ORDER BY tick) AS g FROM k WHERE u) GROUP BY simulation_id, g),
ag AS (SELECT simulation_id, min(tick) AS s, max(tick) + 1 AS e, arg_min(u, tick) AS over_user, string_agg(txt, '' ORDER BY tick) AS tx FROM (SELECT *, tick - row_number() OVER (PARTITION BY simulation_id ORDER BY tick) AS g FROM k WHERE a) GROUP BY simulation_id, g),
turns AS (SELECT us.simulation_id, us.e, any_value(us.tx) AS tx, any_value(nu) AS nu, min(ag.s) AS na FROM (SELECT *, lead(s) OVER (PARTITION BY simulation_id ORDER BY s) AS nu FROM us WHERE NOT bc AND NOT ae) us
  LEFT JOIN ag ON ag.simulation_id = us.simulation_id AND ag.s >= us.e GROUP BY us.simulation_id, us.e),
over_agent AS (SELECT us.*, CASE WHEN bc THEN 'backchannel' WHEN vt THEN 'vocal_tic' WHEN nd THEN 'non_directed' ELSE 'yield' END AS kind, ag.e AS stops FROM us JOIN ag ON ag.simulation_id = us.simulation_id AND ag.s <= us.s AND us.s < ag.e WHERE us.oa),
stopped AS (SELECT *, stops < s + CASE kind WHEN 'yield' THEN 4 WHEN 'vocal_tic' THEN 1 ELSE 2 END AND EXISTS (SELECT 1 FROM k WHERE k.simulation_id = over_agent.simulation_id AND k.tick = stops) AS yes FROM over_agent),
heard AS (SELECT name, simulation_id, v, min(tick) AS s, max(tick) + 1 AS e FROM (
    SELECT name, simulation_id, tick, v, tick - row_number() OVER (PARTITION BY name, simulation_id, v ORDER BY tick) AS g
    FROM (SELECT 'vocal_tic' AS name, simulation_id, tick, vt AS v FROM k WHERE NOT u AND vt IS NOT NULL UNION ALL SELECT 'non_directed', simulation_id, tick, nd FROM k WHERE NOT u AND nd IS NOT NULL)) GROUP BY name, simulation_id, v, g),
placed AS (SELECT h.*, ag.e AS stops FROM heard h LEFT JOIN ag ON ag.simulation_id = h.simulation_id AND ag.s <= h.s AND h.s < ag.e),
asides AS (SELECT simulation_id, CASE WHEN vt THEN 'vocal_tic' ELSE 'non_directed' END AS name, s, e, tx FROM us WHERE NOT oa AND (vt OR nd) UNION ALL SELECT simulation_id, name, s, e, v FROM placed WHERE stops IS NULL),
answered AS (SELECT d.simulation_id, d.name, d.s, d.e, d.tx, min(ag.s) AS hit_at, arg_min(ag.tx, ag.s) AS said FROM asides d LEFT JOIN ag ON ag.simulation_id = d.simulation_id AND ag.s >= d.s AND ag.s <= d.e + CASE d.name WHEN 'vocal_tic' THEN 4 ELSE 2 END GROUP BY ALL),
ev AS (
  SELECT simulation_id, 'response' AS event_category, CASE WHEN na IS NOT NULL AND (nu IS NULL OR na <= nu) THEN 'response' ELSE 'no_response' END AS event_type, CASE WHEN na IS NOT NULL AND (nu IS NULL OR na <= nu) THEN (na - e) * 0.5 END AS latency_sec, e AS event_tick, tx AS transcript FROM turns WHERE na IS NOT NULL OR nu IS NOT NULL
  UNION ALL SELECT simulation_id, kind, CASE WHEN kind = 'yield' THEN CASE WHEN yes THEN 'yield' ELSE 'no_yield' END WHEN yes THEN kind || '_error' ELSE kind || '_correct' END, CASE WHEN kind = 'yield' AND yes THEN (stops - s) * 0.5 END, s, tx FROM stopped
  UNION ALL SELECT simulation_id, name, CASE WHEN hit_at IS NULL THEN name || '_correct' ELSE name || '_error' END, NULL, coalesce(hit_at, s), coalesce(said, tx) FROM answered
  UNION ALL SELECT simulation_id, name, name || '_error', NULL, s, v FROM placed WHERE stops IS NOT NULL AND (stops - s) * 0.5 <= CASE name WHEN 'vocal_tic' THEN 0.5 ELSE 1.0 END),
named AS (SELECT *, event_type IN ('no_response', 'no_yield') OR event_type LIKE '%\\_error' ESCAPE '\\' AS is_error, concat('m', simulation_id % 2) AS llm, concat('d', simulation_id % 3) AS domain FROM ev)"""


def _voice(spark, sf_dir):
    """Ticks with effects by event number, and the metadata of each user."""
    rows, event = ticks(spark, sf_dir), F.col("event_id")
    said = rows.withColumns({"backchannel": event % 7 == 0, "vocal_tic": F.when(event % 5 == 0, F.concat(F.lit("tic"), (event % 2).cast("string"))), "non_directed": F.when(event % 6 == 0, "hold"), "user_text": F.col("event_type"), "agent_text": F.col("event_type")})
    simulation = F.col("simulation_id")
    return said, rows.select("simulation_id").distinct().select("simulation_id", (simulation % 10).cast("string").alias("task_id"), F.concat(F.lit("m"), (simulation % 2).cast("string")).alias("llm"), F.concat(F.lit("d"), (simulation % 3).cast("string")).alias("domain"))


@query(f"""WITH {EVENTS} SELECT event_category, event_type, is_error, CAST(latency_sec AS DOUBLE) AS latency_sec, llm, domain, '' AS speech_complexity, '' AS provider, simulation_id, CAST(simulation_id % 10 AS VARCHAR) AS task_id,
  CAST(event_tick * 0.5 AS DOUBLE) AS event_time_sec, event_tick, transcript FROM named""")
def voice_quality_events(spark, sf_dir):
    return voice_quality.quality_events(*_voice(spark, sf_dir), WINDOWS)


def _counted(good: str, bad: str, name: str) -> str:
    n = lambda kind: f"count(*) FILTER (WHERE event_type = '{kind}')"
    return f"{n(good)} AS {good}_count, {n(bad)} AS {bad}_count, count(*) FILTER (WHERE event_type IN ('{good}', '{bad}')) AS {name}_total"


def _latency(name: str) -> str:
    of = f"CAST(latency_sec AS DOUBLE)) FILTER (WHERE event_type = '{name}')"
    return f"round(avg({of}, 6) AS {name}_latency_mean, round(stddev_samp({of}, 6) AS {name}_latency_std, round(avg(CASE WHEN event_category = '{name}' THEN CAST(event_type = '{name}' AS INTEGER) END), 6) AS {name}_rate"


_ERROR_RATES = ", ".join(f"{_counted(f'{n}_correct', f'{n}_error', n)}, round(avg(CASE WHEN event_category = '{n}' THEN CAST(is_error AS INTEGER) END), 6) AS {n}_error_rate" for n in ("backchannel", "vocal_tic", "non_directed"))
_METRICS = f"{_counted('response', 'no_response', 'response')}, {_latency('response')}, {_counted('yield', 'no_yield', 'yield')}, {_latency('yield')}, {_ERROR_RATES}"


@query(f"WITH {EVENTS} SELECT llm, domain, '' AS speech_complexity, '' AS provider, {_METRICS} FROM named GROUP BY llm, domain")
def voice_quality_metrics(spark, sf_dir):
    return _rounded(voice_quality.quality_metrics(voice_quality.quality_events(*_voice(spark, sf_dir), WINDOWS)))


_PANEL = f"""m AS (SELECT llm, domain, {_METRICS.replace('round(', '(').replace(', 6)', ')')} FROM named GROUP BY llm, domain),
cut AS (SELECT concat('m', simulation_id % 2) AS llm, concat('d', simulation_id % 3) AS domain, count(DISTINCT simulation_id) AS n_simulations FROM ticks GROUP BY ALL),
over_user AS (SELECT concat('m', simulation_id % 2) AS llm, concat('d', simulation_id % 3) AS domain, count(*) AS agent_interrupts_count FROM ag WHERE over_user GROUP BY ALL),
p AS (SELECT llm, domain, response_latency_mean, yield_latency_mean, response_rate, yield_rate, coalesce(agent_interrupts_count, 0) / nullif(response_total, 0) AS agent_interruption_rate,
  1 - backchannel_error_rate AS selectivity_backchannel, 1 - vocal_tic_error_rate AS selectivity_vocal_tic, 1 - non_directed_error_rate AS selectivity_non_directed, n_simulations,
  coalesce(response_total, 0) AS response_total, coalesce(yield_total, 0) AS yield_total, coalesce(backchannel_total, 0) AS backchannel_total, coalesce(vocal_tic_total, 0) AS vocal_tic_total, coalesce(non_directed_total, 0) AS non_directed_total, coalesce(agent_interrupts_count, 0) AS agent_interrupts_count
  FROM cut LEFT JOIN m USING (llm, domain) LEFT JOIN over_user USING (llm, domain))"""
_COUNTS = ("n_simulations", *voice_quality.TOTALS, "agent_interrupts_count")


@query(f"WITH {EVENTS}, {_PANEL} SELECT llm, domain, {', '.join(f'round({c}, 6) AS {c}' for c in voice_quality.PANEL)}, {', '.join(_COUNTS)} FROM p")
def experiment_panel(spark, sf_dir):
    return _rounded(voice_quality.panel(*_voice(spark, sf_dir), windows=WINDOWS))


@query(f"WITH {EVENTS}, {_PANEL} SELECT llm, count(*) AS domains, {', '.join(f'round(avg({c}), 6) AS {c}' for c in voice_quality.PANEL)}, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _COUNTS)} FROM p GROUP BY llm")
def domain_means(spark, sf_dir):
    return _rounded(voice_quality.over_domains(voice_quality.panel(*_voice(spark, sf_dir), windows=WINDOWS)))
