"""Registered queries of the run reports, on the driver's tables, with their SQL.

Simulations are orders, tasks customers, domains order priorities; errors are events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens.functions import text
from convolens.operators import run_reports
from convolens.plans.proxies import _rounded, _t, query

#: orders as simulations
SIMS = """sims AS (SELECT o_orderkey AS simulation_id, o_custkey AS task_id, o_orderpriority AS domain, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END AS reward,
  o_totalprice AS agent_cost, CASE WHEN o_orderkey % 11 = 0 THEN 'infrastructure_error' ELSE 'user_stop' END AS termination_reason FROM orders)"""
ERRORS = """errors AS (SELECT user_id AS simulation_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'agent' ELSE 'user' END AS source,
  CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'critical_helped' WHEN 2 THEN 'critical_hindered' ELSE 'minor' END AS severity FROM events)"""


def simulations(spark, sf_dir):
    reward = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)
    end = F.when(F.col("o_orderkey") % 11 == 0, "infrastructure_error").otherwise("user_stop")
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("simulation_id"), F.col("o_custkey").alias("task_id"), F.col("o_orderpriority").alias("domain"), reward.alias("reward"), F.col("o_totalprice").alias("agent_cost"), end.alias("termination_reason"))


@query(f"""WITH {SIMS}, kept AS (SELECT * FROM sims WHERE termination_reason <> 'infrastructure_error'),
t AS (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE reward = 1) AS c FROM kept GROUP BY task_id)
SELECT round(avg(reward), 6) AS avg_reward, round(avg(agent_cost), 6) AS avg_agent_cost, count(*) AS total_simulations, count(DISTINCT task_id) AS total_tasks,
  (SELECT count(*) FROM sims WHERE termination_reason = 'infrastructure_error') AS infra_error_count, (SELECT round(avg(c / n), 6) FROM t) AS pass_hat_1,
  (SELECT round(avg(CASE WHEN n >= 2 THEN c * (c - 1) / (n * (n - 1)) END), 6) FROM t) AS pass_hat_2 FROM kept""")
def metrics_record(spark, sf_dir):
    return _rounded(run_reports.metrics_record(simulations(spark, sf_dir), [1, 2], F.coalesce(F.col("reward") == 1, F.lit(False))))


@query(f"""WITH {ERRORS} SELECT count(*) FILTER (WHERE source = 'agent') AS total_agent_errors, count(*) FILTER (WHERE source = 'user') AS total_user_errors,
  count(DISTINCT simulation_id) FILTER (WHERE source = 'agent') AS sims_with_agent_errors, count(DISTINCT simulation_id) FILTER (WHERE source = 'user') AS sims_with_user_errors,
  count(DISTINCT simulation_id) FILTER (WHERE source = 'agent' AND severity = 'critical') AS sims_with_critical_agent_errors,
  count(DISTINCT simulation_id) FILTER (WHERE source = 'user' AND severity IN ('critical_helped', 'critical_hindered')) AS sims_with_critical_user_errors FROM errors""")
def derived_totals(spark, sf_dir):
    severity = F.element_at(F.array(*map(F.lit, ("critical", "critical_helped", "critical_hindered", "minor"))), (F.col("event_id") % 4 + 1).cast("int"))
    source = F.when(F.col("event_type").isin("click", "view"), "agent").otherwise("user")
    return run_reports.derived_totals(_t(spark, sf_dir, "events").select(F.col("user_id").alias("simulation_id"), source.alias("source"), severity.alias("severity")))


@query("SELECT count(CASE WHEN event_id % 5 > 0 THEN true END) AS with_information, count(*) FILTER (WHERE event_id % 5 = 2) AS unresponsive FROM events")
def responsiveness(spark, sf_dir):
    return run_reports.responsiveness(_t(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 5 == 2).alias("had_unresponsive_period")), "had_unresponsive_period")


@query("SELECT r.range AS n_parts, coalesce(m.mean, 0.0) AS mean FROM range(0, 13) r LEFT JOIN (SELECT n, round(avg(v), 6) AS mean FROM (SELECT l_orderkey, count(*) AS n, avg(l_discount) AS v FROM lineitem GROUP BY l_orderkey) GROUP BY n) m ON m.n = r.range")
def mean_by_count(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_parts"), F.avg("l_discount").alias("v"))
    return _rounded(run_reports.mean_by_count(rows, "n_parts", "v", 12))


@query(f"WITH {SIMS} SELECT domain, round(count(*) FILTER (WHERE NOT coalesce(reward = 1, false)) / count(*), 6) AS failure_share FROM sims GROUP BY domain")
def failure_shares(spark, sf_dir):
    return _rounded(run_reports.failure_shares(simulations(spark, sf_dir), "domain", F.coalesce(F.col("reward") == 1, F.lit(False))))


@query(f"WITH {SIMS} SELECT task_id, round(avg(coalesce(reward, 0.0)), 6) AS mean_reward FROM sims GROUP BY task_id")
def mean_reward(spark, sf_dir):
    return _rounded(run_reports.mean_reward(simulations(spark, sf_dir), "task_id", "reward"))


@query("SELECT s_name AS model, CAST(s_nationkey AS VARCHAR) AS domain, round(s_acctbal * 100, 6) AS pass_1, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS cost FROM supplier")
def submission_metrics(spark, sf_dir):
    cost = F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("model"), F.col("s_nationkey").cast("string").alias("domain"), F.col("s_acctbal").alias("pass_1"), cost.alias("cost"))
    return _rounded(run_reports.submission_metrics(rows, [1]))


@query("""WITH s AS (SELECT c_custkey AS k, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer), c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS a, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS b FROM customer)
SELECT k, 'a' AS metric, s.a AS stored, c.a AS computed FROM s JOIN c USING (k) WHERE s.a IS DISTINCT FROM c.a UNION ALL SELECT k, 'b', s.b, c.b FROM s JOIN c USING (k) WHERE s.b IS DISTINCT FROM c.b""")
def submission_differences(spark, sf_dir):
    stored = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b"))
    computed = stored.select("k", F.when(F.col("k") % 7 == 0, F.col("a") + 1).otherwise(F.col("a")).alias("a"), F.when(F.col("k") % 9 != 0, F.col("b")).alias("b"))
    return run_reports.submission_differences(stored, computed, ["k"], ["a", "b"])


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1")
def best_per_model(spark, sf_dir):
    return run_reports.best_per_model(_t(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), "s_nationkey", "s_acctbal", "s_suppkey")


@query("SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 3")
def domain_top(spark, sf_dir):
    return run_reports.domain_top(_t(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_mktsegment", "c_acctbal", "c_custkey", 3)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING n > 0.03 * (SELECT count(*) FROM part) ORDER BY n DESC, p_brand LIMIT 10")
def frequent_values(spark, sf_dir):
    return run_reports.frequent(_t(spark, sf_dir, "part"), "p_brand", 0.03, 10)


@query("SELECT c_custkey, c_mktsegment AS organization FROM customer WHERE lower(c_mktsegment) = 'building'")
def organization_filter(spark, sf_dir):
    return run_reports.of_organization(_t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("organization")), "Building")


@query("""WITH p AS (SELECT c_nationkey, c_mktsegment, CASE WHEN c_nationkey % 5 > 0 OR c_mktsegment < 'C' THEN avg(c_acctbal) END AS score, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY c_nationkey, c_mktsegment
  UNION ALL SELECT 3, 'none', NULL, 0)
SELECT c_nationkey, CASE WHEN count(*) FILTER (WHERE score IS NOT NULL AND n < 10) = 0 THEN round(avg(score), 6) END AS overall,
  CASE WHEN count(*) FILTER (WHERE score IS NOT NULL AND n < 10) > 0 THEN 'low_n' WHEN count(score) = 0 THEN 'undefined' ELSE 'ok' END AS reason FROM p GROUP BY c_nationkey""")
def contaminated_overall(spark, sf_dir):
    """Nations as entries, segments as domains; the mean rests on each domain's number of customers."""
    score = F.when((F.col("c_nationkey") % 5 > 0) | (F.col("c_mktsegment") < "C"), F.col("mean"))
    parts = _t(spark, sf_dir, "customer").where("c_nationkey <> 3").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("mean"), F.count("*").alias("n"))
    none = _t(spark, sf_dir, "customer").limit(1).select(F.lit(3).alias("c_nationkey"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("n"))
    return _rounded(run_reports.contaminated_overall(parts.select("c_nationkey", score.alias("score"), "n").unionByName(none), "c_nationkey"))


_NAMES = ("..x", "/\u00e9 y", "\\\\..", "...\u00df\u00bd?")


@query(f"""WITH n AS (SELECT *, concat(p_name, [{', '.join(f"'{n}'" for n in _NAMES)}][p_partkey % 4 + 1]) AS name FROM part)
SELECT p_partkey, regexp_replace(replace(name, '..', '_'), '[^\\p{{L}}\\p{{N}}._-]', '_', 'g')[:255] AS file, lower(p_type) = lower(p_brand) AS same FROM n""")
def safe_names(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.safe_filename(F.concat("p_name", tail)).alias("file"), text.same_name(F.col("p_type"), F.col("p_brand")).alias("same"))


@query(r"""WITH t AS (SELECT o_orderkey, concat('[', replace(o_orderpriority, '-', '_'), ']x', repeat('|x', CAST(o_orderkey % 4 AS INTEGER)), '[PERSONA:', ['None', 'Easy_one', 'P3', 'a-b', ''][o_custkey % 5 + 1], ']') AS id FROM orders)
SELECT o_orderkey, regexp_extract(id, '^\[([a-zA-Z_]+)\]', 1) AS intent_text, CAST(len(string_split(id, '|')) AS INTEGER) AS issues, nullif(regexp_extract(id, '\[PERSONA:([a-zA-Z_]+)\]', 1), '') AS persona FROM t""".replace("\\\\", "\\"))
def task_id_parts(spark, sf_dir):
    bars = F.repeat(F.lit("|x"), (F.col("o_orderkey") % 4).cast("int"))
    persona = F.element_at(F.array(*map(F.lit, ("None", "Easy_one", "P3", "a-b", ""))), (F.col("o_custkey") % 5 + 1).cast("int"))
    name = F.concat(F.lit("["), F.regexp_replace("o_orderpriority", "-", "_"), F.lit("]x"), bars, F.lit("[PERSONA:"), persona, F.lit("]"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", name.alias("id"))
    return rows.select("o_orderkey", F.coalesce(text.task_intent(F.col("id")), F.lit("")).alias("intent_text"), text.task_issues(F.col("id")).alias("issues"), text.task_persona(F.col("id")).alias("persona"))


#: an output and what was recorded: whole and broken number, number and its text, other spacing, no JSON, one side quoted
_OUTPUTS = (('{"k": #}', '{ "k" : #.0 }'), ("#", '"#"'), ("# and", "# and"), ("item #", '"item #"'), ('[#, "a"]', '["a", #]'), ("{'#'", '{"#": 1}'), ("true", "1"))


@query("""WITH o AS (SELECT event_id, replace({}[event_id % 7 + 1], '#', json_extract_string(props, '$.k')) AS a, replace({}[event_id % 7 + 1], '#', json_extract_string(props, '$.k')) AS b FROM events),
v AS (SELECT *, json_valid(a) AS ja, json_valid(b) AS jb FROM o)
SELECT event_id, CASE WHEN ja AND jb THEN
    CASE WHEN json_type(a) = 'OBJECT' AND json_type(b) = 'OBJECT' THEN CAST(json_extract(a, '$.k') AS DOUBLE) IS NOT DISTINCT FROM CAST(json_extract(b, '$.k') AS DOUBLE)
      WHEN json_type(a) = 'BOOLEAN' AND json_type(b) <> 'VARCHAR' THEN CAST(CAST(a AS BOOLEAN) AS INTEGER) = CAST(b AS INTEGER) ELSE json_type(a) = json_type(b) AND a = b END
  WHEN ja THEN json_type(a) = 'VARCHAR' AND json_extract_string(a, '$') = b WHEN jb THEN json_type(b) = 'VARCHAR' AND json_extract_string(b, '$') = a ELSE a = b END AS same FROM v""".format(*["[" + ", ".join("'" + p[side].replace("'", "''") + "'" for p in _OUTPUTS) + "]" for side in (0, 1)]))
def json_equality(spark, sf_dir):
    number = F.get_json_object("props", "$.k")
    side = lambda k: F.replace(F.element_at(F.array(*[F.lit(p[k]) for p in _OUTPUTS]), (F.col("event_id") % 7 + 1).cast("int")), F.lit("#"), number)
    return _t(spark, sf_dir, "events").select("event_id", text.same_output(side(0), side(1)).alias("same"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS arrival FROM orders")
def arrival_dates(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.arrival_date(F.col("o_orderdate"), F.when(F.col("o_orderkey") % 3 == 0, "08:15:00+1").otherwise("08:15:00")).alias("arrival"))
