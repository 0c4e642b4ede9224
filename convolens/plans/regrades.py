"""Registered queries of re-grading, reviews and marked scripts, on the driver's tables, with their SQL.

Simulations are orders and their checks line items; reviewed simulations and scripts are users and their events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.operators import regrading, reviews, scripts
from convolens.plans.proxies import _t, query

# --- re-grading --------------------------------------------------------------------------------

_BASIS = {"1": ("DB",), "2": ("ACTION", "COMMUNICATE"), "3": ("DB", "ENV_ASSERTION", "NL_ASSERTION"), "4": ("ACTION",), "5": ("DB",)}


def _simulations(spark, sf_dir):
    level = F.substring("o_orderpriority", 1, 1)
    basis = reduce(lambda c, item: c.when(level == item[0], F.array(*map(F.lit, item[1]))), _BASIS.items(), F.when(F.lit(False), F.array(F.lit(""))))
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("simulation_id"),
        F.col("o_custkey").alias("task_id"),
        (F.col("o_orderkey") % 4).alias("trial"),
        F.when(level == "5", "max_steps").otherwise("user_stop").alias("termination_reason"),
        (level != "4").alias("has_criteria"),
        basis.alias("reward_basis"),
    )


def _checks(spark, sf_dir):
    component = F.element_at(F.array(*map(F.lit, regrading.COMPONENTS)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("simulation_id"), component.alias("component"), (F.col("l_returnflag") != "R").alias("met"))


_C = "c AS (SELECT l_orderkey, " + ", ".join(f"CAST(bool_and(l_returnflag <> 'R') FILTER (WHERE l_linenumber % 5 = {k}) AS INTEGER) AS {n}" for k, n in enumerate(("db", "env", "act", "com", "nl"))) + " FROM lineitem GROUP BY 1)"
_O = f"""{_C}, o AS (SELECT o_orderkey AS simulation_id, o_custkey AS task_id, o_orderkey % 4 AS trial, o_orderpriority[1] AS p, coalesce(db, 1) AS db, coalesce(env, 1) AS env, coalesce(act, 1) AS act, coalesce(com, 1) AS com, coalesce(nl, 1) AS nl
  FROM orders LEFT JOIN c ON l_orderkey = o_orderkey),
e AS (SELECT *, CASE p WHEN '1' THEN db WHEN '3' THEN db * env ELSE 1 END AS er, CASE p WHEN '1' THEN 'DB' WHEN '3' THEN 'DB,ENV_ASSERTION' ELSE '' END AS ep FROM o)"""


@query(f"""WITH {_O} SELECT simulation_id, t AS evaluation_type,
  CAST(CASE WHEN p = '5' THEN 0 WHEN p = '4' THEN 1 WHEN t = 'env' THEN er WHEN t = 'communicate' THEN com WHEN t = 'action' THEN act WHEN t = 'nl_assertions' THEN nl
    WHEN t IN ('all', 'all_with_nl_assertions') THEN CASE p WHEN '1' THEN db WHEN '2' THEN act * com ELSE db * env * nl END
    WHEN t = 'all_ignore_basis' THEN er * act * com ELSE er * act * com * nl END AS DOUBLE) AS reward,
  CASE WHEN p IN ('4', '5') THEN NULL WHEN t = 'env' THEN ep WHEN t = 'communicate' THEN 'COMMUNICATE' WHEN t = 'action' THEN 'ACTION' WHEN t = 'nl_assertions' THEN 'NL_ASSERTION'
    WHEN t IN ('all', 'all_with_nl_assertions') THEN CASE p WHEN '1' THEN 'DB' WHEN '2' THEN 'ACTION,COMMUNICATE' ELSE 'DB,ENV_ASSERTION,NL_ASSERTION' END
    ELSE 'ACTION,COMMUNICATE' || CASE WHEN ep = '' THEN '' ELSE ',' || ep END || CASE WHEN t = 'all_ignore_basis' THEN '' ELSE ',NL_ASSERTION' END END AS components
FROM e, (VALUES ('env'), ('communicate'), ('action'), ('nl_assertions'), ('all'), ('all_with_nl_assertions'), ('all_ignore_basis'), ('all_with_nl_assertions_ignore_basis')) v(t)""")
def regraded_rewards(spark, sf_dir):
    rewards, simulations = regrading.component_rewards(_checks(spark, sf_dir)), _simulations(spark, sf_dir)
    graded = [regrading.regrade(simulations, rewards, t).withColumn("evaluation_type", F.lit(t)) for t in regrading.EVALUATION_TYPES]
    components = F.array_join(F.array_sort(F.map_keys("reward_breakdown")), ",").alias("components")
    return reduce(DataFrame.union, graded).select("simulation_id", "evaluation_type", "reward", components)


@query(f"""WITH {_O}, w AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS met FROM lineitem WHERE (l_linestatus = 'F' AND l_returnflag = 'R') OR (l_linestatus <> 'F' AND l_returnflag = 'N') GROUP BY 1)
SELECT simulation_id, task_id, trial, CASE p WHEN '5' THEN false WHEN '4' THEN true WHEN '1' THEN db = 1 WHEN '2' THEN act * com = 1 ELSE db * env * nl = 1 END AS success,
  CASE p WHEN '2' THEN com = 1 END AS communication, CASE p WHEN '3' THEN env = 1 END AS environment, CASE p WHEN '1' THEN db = 1 WHEN '3' THEN db = 1 WHEN '5' THEN false END AS database,
  coalesce(met, 0) AS num_correct_write_action, coalesce(n, 0) AS num_write_action FROM o LEFT JOIN w ON l_orderkey = simulation_id""")
def run_breakdown(spark, sf_dir):
    graded = regrading.regrade(_simulations(spark, sf_dir), regrading.component_rewards(_checks(spark, sf_dir)))
    requestor = F.when(F.col("l_linestatus") == "F", "assistant").otherwise("user")
    checks = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("simulation_id"), requestor.alias("requestor"), F.col("l_returnflag").alias("name"), (F.col("l_quantity") > 25).alias("action_match"))
    tools = checks.where("(requestor = 'assistant' and name = 'R') or (requestor = 'user' and name = 'N')").select("requestor", "name")
    return regrading.run_breakdown(graded, checks, tools)


# --- reviews -----------------------------------------------------------------------------------


def _reviews(spark, sf_dir):
    """Every third user is reviewed as a user alone, every third not at all."""
    kind, event = F.col("event_type"), F.col("event_id")
    severity = F.when(kind == "purchase", "critical_helped").when(kind == "click", "minor").when(kind == "view", "critical").when(kind == "scroll", None).when(kind == "error", "critical_hindered").otherwise("odd")
    source = F.when(event % 5 == 0, "tool").when(event % 2 == 0, "agent").otherwise("user")
    rows = _t(spark, sf_dir, "events").where("event_id % 4 > 0")
    errors = rows.select(F.col("user_id").alias("simulation_id"), event.alias("pos"), source.alias("source"), severity.alias("severity"), F.when(event % 3 == 0, event % 50).alias("tick_start"), F.when(event % 7 > 0, event % 40).alias("turn_idx"), F.array(kind, F.lit("any")).alias("error_tags"))
    simulations = _t(spark, sf_dir, "events").select(F.col("user_id").alias("simulation_id")).distinct()
    return simulations.withColumn("review", F.when(F.col("simulation_id") % 3 == 0, "full").when(F.col("simulation_id") % 3 == 1, "user_only")), errors


_REVIEWS = """s AS (SELECT DISTINCT user_id AS simulation_id, CASE user_id % 3 WHEN 0 THEN 'full' ELSE 'user_only' END AS review FROM events WHERE user_id % 3 < 2),
e AS (SELECT user_id AS simulation_id, event_id AS pos, event_type,
    CASE WHEN user_id % 3 = 1 THEN 'user' WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'agent' ELSE 'user' END AS side,
    CASE event_type WHEN 'purchase' THEN 'critical_helped' WHEN 'click' THEN 'minor' WHEN 'view' THEN 'critical' WHEN 'scroll' THEN 'unknown' WHEN 'error' THEN 'critical_hindered' ELSE 'odd' END AS severity,
    coalesce(CASE WHEN event_id % 3 = 0 THEN event_id % 50 END, CASE WHEN event_id % 7 > 0 THEN event_id % 40 END, 1e9) AS place
  FROM events WHERE event_id % 4 > 0 AND user_id % 3 < 2),
r AS (SELECT *, CASE WHEN (side = 'agent' AND severity = 'critical') OR (side = 'user' AND severity LIKE 'critical/_%' ESCAPE '/') THEN 3 WHEN severity = 'minor' THEN 2 ELSE 1 END AS rank FROM e WHERE side IS NOT NULL),
g AS (SELECT simulation_id, side, severity FROM r QUALIFY row_number() OVER (PARTITION BY simulation_id, side ORDER BY rank DESC, CASE WHEN rank = 3 THEN -pos ELSE pos END) = 1),
f AS (SELECT simulation_id, side FROM r WHERE rank = 3 QUALIFY row_number() OVER (PARTITION BY simulation_id ORDER BY place, pos) = 1),
outcomes AS (SELECT s.simulation_id, review, coalesce(a.severity, 'none') AS max_agent_severity, coalesce(u.severity, 'none') AS max_user_severity, coalesce(f.side, 'none') AS first_critical_source
  FROM s LEFT JOIN g a ON a.simulation_id = s.simulation_id AND a.side = 'agent' LEFT JOIN g u ON u.simulation_id = s.simulation_id AND u.side = 'user' LEFT JOIN f ON f.simulation_id = s.simulation_id)"""


@query(f"WITH {_REVIEWS} SELECT * FROM outcomes")
def review_outcomes(spark, sf_dir):
    return reviews.review_outcomes(*_reviews(spark, sf_dir))


@query(f"""WITH {_REVIEWS} SELECT side || '_errors' AS metric, severity AS key, NULL AS tag, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT side || '_tags', severity, tag, count(*) FROM (SELECT side, severity, unnest([event_type, 'any']) AS tag FROM r) GROUP BY ALL
UNION ALL SELECT metric, key, NULL, count(*) FROM (UNPIVOT outcomes ON max_agent_severity, max_user_severity, first_critical_source INTO NAME metric VALUE key) GROUP BY ALL""")
def review_metrics(spark, sf_dir):
    return reviews.review_metrics(*_reviews(spark, sf_dir))


# --- marked scripts ----------------------------------------------------------------------------


def _scripts(spark, sf_dir):
    """Every 13th event has no script, every 11th a message that does not say what was received."""
    event, key = F.col("event_id"), F.get_json_object("props", "$.k")
    received = F.concat_ws(",", (event % 5).cast("string"), F.when(event % 3 == 0, (event % 7).cast("string")))
    head = F.when(event % 11 == 0, F.concat(F.lit('<message uuid="'), key, F.lit('">'))).otherwise(F.concat(F.lit('<message uuid="'), key, F.lit('" active="'), received, F.lit('">')))
    script = F.concat(head, F.lit("<chunk id=0>"), "event_type", F.lit(" </chunk><chunk id=3>\n"), F.col("user_id").cast("string"), F.lit("</chunk></message>"))
    return _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("dialogue"), F.when(event % 13 > 0, script).alias("script"))


_SCRIPTS = """x AS (SELECT event_id, user_id % 40 AS dialogue, CASE WHEN event_id % 13 > 0 THEN
  '<message uuid="' || json_extract_string(props, '$.k') || CASE WHEN event_id % 11 = 0 THEN '">' ELSE '" active="' || event_id % 5 || CASE WHEN event_id % 3 = 0 THEN ',' || event_id % 7 ELSE '' END || '">' END
  || '<chunk id=0>' || event_type || ' </chunk><chunk id=3>' || chr(10) || user_id || '</chunk></message>' END AS script FROM events),
y AS (SELECT *, nullif(regexp_extract(script, '<message uuid="([^"]+)"', 1), '') AS uuid,
  list_sort(list_distinct(list_transform(list_filter(string_split(regexp_extract(script, 'active="([^"]+)"', 1), ','), lambda i: i <> ''), lambda i: CAST(i AS BIGINT)))) AS active,
  list_sort(list_distinct(list_transform(regexp_extract_all(script, '<chunk id=([0-9]+)>', 1), lambda i: CAST(i AS BIGINT)))) AS chunks FROM x)"""


@query(f"""WITH {_SCRIPTS} SELECT event_id, uuid, array_to_string(active, ',') AS received, array_to_string(list_sort(list_filter(chunks, lambda i: NOT list_contains(active, i))), ',') AS missing,
  regexp_replace(script, '</?(message|chunk)[^>]*>', '', 'g') AS said, array_to_string(regexp_extract_all(script, '<chunk id=[0-9]+>([^<]*)</chunk>', 1), '|') AS texts FROM y WHERE script IS NOT NULL""")
def marked_scripts(spark, sf_dir):
    script = F.col("script")
    listed = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    texts = F.array_join(F.transform(scripts.chunk_texts(script), lambda c: c["text"]), "|")
    rows = _scripts(spark, sf_dir).where("script is not null")
    return rows.select("event_id", scripts.message_uuid(script).alias("uuid"), listed(scripts.active_ids(script)).alias("received"), listed(scripts.missing_ids(script)).alias("missing"), scripts.plain_text(script).alias("said"), texts.alias("texts"))


@query(f"""WITH {_SCRIPTS}, m AS (SELECT dialogue, uuid, min(event_id) AS first, arg_min(script, event_id) AS template FROM y WHERE uuid IS NOT NULL GROUP BY 1, 2),
a AS (SELECT dialogue, uuid, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (SELECT dialogue, uuid, unnest(active) AS id FROM y) GROUP BY 1, 2),
j AS (SELECT m.dialogue, first, CASE WHEN template LIKE '%" active="%' THEN '<message uuid="' || uuid || '" active="' || ids || '">' || substring(template, strpos(template, '<chunk')) ELSE template END AS part FROM m LEFT JOIN a USING (dialogue, uuid))
SELECT dialogue, string_agg(part, '' ORDER BY first) AS script FROM j GROUP BY 1""")
def merged_markup(spark, sf_dir):
    return scripts.merge_scripts(_scripts(spark, sf_dir), "dialogue", "event_id", "script")
