"""The registered queries: every operator on the driver's tables that stand for conversation data.

Tasks are parts and trials their line items; simulations are orders; ticks are a user's events in
time order, the user speaking in clicks and purchases, the agent in views and purchases.

Names of statuses, severities, domains, modes and operators in these queries are fixed values: they are those of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolens.functions import constraints, text
from convolens.operators import dml, intervals, leaderboard, linearize, metrics, replay, retrieval, rewards, usage, voice, work
from convolens.streaming import events as events_stream


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def wrap(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLE_SQL[key] = sql
        return function

    return wrap


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("task_id"), (F.col("l_returnflag") == "R").alias("success"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    return _t(spark, sf_dir, "events").select(
        F.col("user_id").alias("simulation_id"),
        (F.row_number().over(order) - 1).alias("tick"),
        kind.isin("click", "purchase").alias("user_speaks"),
        kind.isin("view", "purchase").alias("agent_speaks"),
        "event_id",
        "event_type",
        "value",
    )


TICKS = """ticks AS (
  SELECT user_id AS simulation_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick,
    event_type IN ('click', 'purchase') AS user_speaks, event_type IN ('view', 'purchase') AS agent_speaks, event_id, event_type, value FROM events)"""


# --- metrics -----------------------------------------------------------------------------------


@query("""
WITH per AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY 1)
SELECT 1 AS k, round(avg(c / n), 6) AS pass_hat_k FROM per
UNION ALL SELECT 2, round(avg(CASE WHEN n >= 2 THEN greatest(c, 0) / n * greatest(c - 1, 0) / nullif(n - 1, 0) END), 6) FROM per
UNION ALL SELECT 3, round(avg(CASE WHEN n >= 3 THEN greatest(c, 0) / n * greatest(c - 1, 0) / nullif(n - 1, 0) * greatest(c - 2, 0) / nullif(n - 2, 0) END), 6) FROM per
UNION ALL SELECT 4, round(avg(CASE WHEN n >= 4 THEN greatest(c, 0) / n * greatest(c - 1, 0) / nullif(n - 1, 0) * greatest(c - 2, 0) / nullif(n - 2, 0) * greatest(c - 3, 0) / nullif(n - 3, 0) END), 6) FROM per
""")
def pass_hat_k(spark, sf_dir):
    return _rounded(metrics.pass_hat(trials(spark, sf_dir), [1, 2, 3, 4]))


@query("SELECT l_partkey AS task_id, count(*) AS trials, count(*) FILTER (WHERE l_returnflag = 'R') AS successes, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS pass_hat_1 FROM lineitem GROUP BY 1")
def task_pass(spark, sf_dir):
    return _rounded(metrics.task_pass(trials(spark, sf_dir), [1]))


def simulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("o_orderstatus") == "F", "agent_stop").when(F.col("o_orderstatus") == "O", "user_stop").otherwise("infrastructure_error")
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("simulation_id"),
        F.col("o_custkey").alias("task_id"),
        F.when(F.col("o_orderpriority").startswith("1"), 1.0).when(F.col("o_orderpriority").startswith("5"), None).otherwise(0.5).alias("reward"),
        (F.col("o_totalprice") / 1000).alias("agent_cost"),
        (F.col("o_totalprice") / 2000).alias("user_cost"),
        F.when(F.col("o_orderpriority").startswith("3"), "max_steps").otherwise(reason).alias("termination_reason"),
    )


SIMULATIONS = """simulations AS (
  SELECT o_orderkey AS simulation_id, o_custkey AS task_id, CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 WHEN o_orderpriority LIKE '5%' THEN NULL ELSE 0.5 END AS reward,
    o_totalprice / 1000 AS agent_cost, o_totalprice / 2000 AS user_cost,
    CASE WHEN o_orderpriority LIKE '3%' THEN 'max_steps' WHEN o_orderstatus = 'F' THEN 'agent_stop' WHEN o_orderstatus = 'O' THEN 'user_stop' ELSE 'infrastructure_error' END AS termination_reason FROM orders)"""


@query(f"""WITH {SIMULATIONS}
SELECT count(*) AS simulations, count(DISTINCT task_id) AS tasks, round(avg(reward), 6) AS avg_reward, round(avg(CASE WHEN reward = 1 THEN 1.0 ELSE 0 END), 6) AS success_rate,
  round(avg(agent_cost), 6) AS avg_agent_cost, round(avg(user_cost), 6) AS avg_user_cost, count(*) FILTER (WHERE termination_reason IN ('agent_stop', 'user_stop')) AS normal_stops,
  count(*) FILTER (WHERE termination_reason = 'max_steps') AS max_steps, count(*) FILTER (WHERE termination_reason = 'too_many_errors') AS error_stops
FROM simulations WHERE termination_reason <> 'infrastructure_error'""")
def agent_metrics(spark, sf_dir):
    return _rounded(metrics.agent_metrics(simulations(spark, sf_dir)))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    severity = F.when(kind == "purchase", "critical_helped").when(kind == "click", "minor").when(kind == "view", "odd").when(kind == "scroll", None).otherwise("critical_hindered")
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("simulation_id"), severity.alias("severity"), F.when(F.col("value") > 50, "agent").otherwise("user").alias("source"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 50).alias("at"), F.array(F.col("event_type"), F.lit("any")).alias("error_tags"))


ERRORS = """errors AS (
  SELECT user_id AS simulation_id, CASE event_type WHEN 'purchase' THEN 'critical_helped' WHEN 'click' THEN 'minor' WHEN 'view' THEN 'odd' WHEN 'scroll' THEN NULL ELSE 'critical_hindered' END AS severity,
    CASE WHEN value > 50 THEN 'agent' ELSE 'user' END AS source, event_id AS pos, CASE WHEN event_id % 3 > 0 THEN event_id % 50 END AS "at", event_type FROM events)"""


@query(f"WITH {ERRORS} SELECT source, coalesce(severity, 'unknown') AS severity, count(*) AS errors FROM errors GROUP BY 1, 2")
def errors_by_severity(spark, sf_dir):
    return metrics.errors_by_severity(errors(spark, sf_dir))


@query(f"WITH {ERRORS} SELECT tag, coalesce(severity, 'unknown') AS severity, count(*) AS errors FROM (SELECT severity, unnest([event_type, 'any']) AS tag FROM errors) GROUP BY 1, 2")
def tag_counts(spark, sf_dir):
    return metrics.tag_counts(errors(spark, sf_dir))


@query(f"""WITH {ERRORS}, r AS (SELECT *, CASE WHEN severity LIKE 'critical%' THEN 3 WHEN severity = 'minor' THEN 2 ELSE 1 END AS rank FROM errors)
SELECT simulation_id, severity AS max_severity FROM (SELECT *, row_number() OVER (PARTITION BY simulation_id ORDER BY rank DESC, CASE WHEN rank = 1 THEN -pos ELSE pos END DESC) AS n FROM r) WHERE n = 1""")
def max_severity(spark, sf_dir):
    return metrics.greatest_severity(errors(spark, sf_dir))


@query(f"""WITH {ERRORS} SELECT simulation_id, source AS first_critical_source FROM (
  SELECT *, row_number() OVER (PARTITION BY simulation_id ORDER BY "at" ASC NULLS LAST, pos) AS n FROM errors WHERE severity LIKE 'critical%') WHERE n = 1""")
def first_critical(spark, sf_dir):
    return metrics.first_critical(errors(spark, sf_dir))


@query("SELECT o_custkey AS task_id, arg_max(o_totalprice, o_orderkey) AS reward FROM orders GROUP BY 1")
def reward_per_task(spark, sf_dir):
    return metrics.reward_per_task(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_totalprice").alias("reward"), F.col("o_orderkey").alias("seq")))


@query("""WITH f AS (SELECT l_suppkey, min(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) OVER w AS ok FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS i FROM lineitem) WINDOW w AS (PARTITION BY l_suppkey ORDER BY i))
SELECT l_suppkey, CAST(sum(ok) AS BIGINT) AS streak FROM f GROUP BY 1""")
def on_time_streak(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_returnflag") != "R").alias("on_time"))
    return metrics.leading_streak(rows, "l_suppkey", F.struct(-F.col("l_shipdate").cast("timestamp").cast("long"), "l_orderkey", "l_linenumber"), "on_time")


@query("SELECT r_regionkey, CASE WHEN bool_or(c_acctbal < -990) THEN NULL ELSE round(sum(c_acctbal), 6) END AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def poisoned_cost(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    cost = F.when(F.col("c_acctbal") >= -990, F.col("c_acctbal"))
    return _rounded(rows.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(metrics.poisoned_sum(cost).alias("total")))


# --- constraints and changes -------------------------------------------------------------------

_CONSTRAINTS = {
    "eq": ("customer", {"c_mktsegment": "BUILDING"}, "c_mktsegment = 'BUILDING'"),
    "ne": ("customer", {"c_mktsegment__ne": "BUILDING"}, "c_mktsegment IS DISTINCT FROM 'BUILDING'"),
    "gt": ("customer", {"c_acctbal__gt": 5000}, "c_acctbal > 5000"),
    "gte": ("customer", {"c_custkey__gte": 700}, "c_custkey >= 700"),
    "lt": ("orders", {"o_totalprice__lt": 20000.0}, "o_totalprice < 20000"),
    "lte": ("orders", {"o_orderkey__lte": 99}, "o_orderkey <= 99"),
    "contains": ("documents", {"text__contains": "tion the"}, "contains(text, 'tion the')"),
    "startswith": ("documents", {"doc_id__startswith": "1"}, "CAST(doc_id AS VARCHAR) LIKE '1%'"),
    "endswith": ("documents", {"source__endswith": "9"}, "source LIKE '%9'"),
    "in": ("orders", {"o_orderstatus__in": ["F", "P"]}, "o_orderstatus IN ('F', 'P')"),
    "nin": ("orders", {"o_orderstatus__nin": ["F", "P"], "o_totalprice__gt": 100000}, "o_orderstatus NOT IN ('F', 'P') AND o_totalprice > 100000"),
    "unknown": ("customer", {"c_mktsegment__like": "BUILDING", "missing_field": None}, "c_mktsegment = 'BUILDING'"),
    "mismatch": ("customer", {"c_acctbal__gt": "text"}, "false"),
}


def _constraint(name: str, rule: dict):
    return lambda spark, sf_dir: constraints.query(_t(spark, sf_dir, name), rule)


for _op, (_name, _rule, _where) in _CONSTRAINTS.items():
    query(f"SELECT * FROM {_name} WHERE {_where}", f"constraint_query_{_op}")(_constraint(_name, _rule))


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 5")
def constraint_limit(spark, sf_dir):
    return constraints.query(_t(spark, sf_dir, "customer"), '{"c_mktsegment": "BUILDING"}', limit=5, order="c_custkey")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier
UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0""")
def upsert(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier")
    changes = rows.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("renamed").alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
    fresh = rows.where("s_suppkey % 2 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000)
    return dml.insert_if_absent(dml.update_by_id(rows, changes, "s_suppkey"), fresh.unionByName(rows), "s_suppkey")[0]


@query("SELECT *, 'deleted' AS part FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT *, 'kept' FROM supplier WHERE NOT s_acctbal < 0")
def delete_returning(spark, sf_dir):
    kept, gone = dml.delete_where(_t(spark, sf_dir, "supplier"), {"s_acctbal__lt": 0})
    return gone.withColumn("part", F.lit("deleted")).unionByName(kept.withColumn("part", F.lit("kept")))


@query("SELECT l_partkey, l_suppkey, arg_max(l_quantity, l_orderkey * 100 + l_linenumber) AS l_quantity FROM lineitem GROUP BY 1, 2")
def checkpoint_replace(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return dml.latest(rows, ["l_partkey", "l_suppkey"]).drop("seq")


@query("""SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.s_suppkey IS NULL THEN 'added' WHEN b.s_suppkey IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM (SELECT * FROM supplier WHERE s_suppkey % 5 > 0) a FULL JOIN (SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 4 > 0) b ON a.s_suppkey = b.s_suppkey
WHERE a.s_suppkey IS NULL OR b.s_suppkey IS NULL OR a.s_acctbal <> b.s_acctbal""")
def table_difference(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier")
    changed = rows.where("s_suppkey % 4 > 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 7 == 0, 0.0).otherwise(F.col("s_acctbal")))
    return dml.table_difference(rows.where("s_suppkey % 5 > 0"), changed, "s_suppkey")


# --- joins -------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS simulation_id, o_custkey AS task_id, o_totalprice AS reward, c_name AS task, c_mktsegment AS domain FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def sim_task_flatten(spark, sf_dir):
    sims = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("simulation_id"), F.col("o_custkey").alias("task_id"), F.col("o_totalprice").alias("reward"))
    tasks = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("task"), F.col("c_mktsegment").alias("domain"))
    return sims.join(tasks, "task_id", "left").select("simulation_id", "task_id", "reward", "task", "domain")


@query("""SELECT o_orderkey AS simulation_id, o_orderkey AS action_id, 'ship' AS name, EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = o_orderstatus AND l_quantity > 25) AS matched FROM orders""")
def action_match(spark, sf_dir):
    gold = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("simulation_id"), F.col("o_orderkey").alias("action_id"), F.lit("ship").alias("name"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("large"), F.lit("true")).alias("arguments"), F.lit(None).cast("array<string>").alias("compare_args"))
    calls = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("simulation_id"), F.lit("ship").alias("name"), F.create_map(F.lit("status"), "l_linestatus", F.lit("large"), (F.col("l_quantity") > 25).cast("string")).alias("arguments"))
    return rewards.match_actions(gold, calls)


@query("""WITH info AS (SELECT conv_id, role AS info FROM conversations UNION SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'THE' ELSE 'nothing like it' END FROM conversations)
SELECT conv_id AS simulation_id, info, EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = info.conv_id AND c.role = 'assistant' AND contains(replace(lower(c.text), ',', ''), lower(info))) AS met FROM info""")
def communicate_match(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations")
    info = rows.select("conv_id", F.col("role").alias("info")).unionByName(rows.select("conv_id", F.when(F.col("conv_id") % 2 == 0, "THE").otherwise("nothing like it").alias("info"))).distinct()
    return rewards.match_information(info.withColumnRenamed("conv_id", "simulation_id"), rows.select(F.col("conv_id").alias("simulation_id"), "role", F.col("text").alias("content")))


@query("""WITH c AS (SELECT l_orderkey AS s, bool_and(l_returnflag <> 'R') AS act, bool_or(l_linestatus = 'F') AS db FROM lineitem GROUP BY 1)
SELECT s AS simulation_id, CASE WHEN o_orderpriority LIKE '5%' THEN 0 WHEN o_orderpriority LIKE '4%' THEN 1 WHEN o_orderpriority LIKE '3%' THEN CAST(act AS INT) ELSE CAST(act AND db AS INT) END + 0.0 AS reward FROM c JOIN orders ON s = o_orderkey""")
def combine_rewards(spark, sf_dir):
    parts = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("simulation_id")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("act"), F.bool_or(F.col("l_linestatus") == "F").alias("db"))
    rows = parts.join(_t(spark, sf_dir, "orders"), F.col("simulation_id") == F.col("o_orderkey"))
    level = F.substring("o_orderpriority", 1, 1)
    basis = F.when(level == "3", F.array(F.lit("ACTION"))).otherwise(F.array(F.lit("ACTION"), F.lit("DB")))
    reward = rewards.final_reward(F.when(level == "5", "max_steps").otherwise("user_stop"), level != "4", rewards.combine(basis, {"ACTION": F.col("act"), "DB": F.col("db")}))
    return rows.select("simulation_id", reward.alias("reward"))


@query("""SELECT l_orderkey AS simulation_id, count(*) FILTER (WHERE l_linestatus = 'O') AS reads, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'N') AS reads_met,
  count(*) FILTER (WHERE l_linestatus <> 'O') AS writes, count(*) FILTER (WHERE l_linestatus <> 'O' AND l_returnflag = 'N') AS writes_met FROM lineitem GROUP BY 1""")
def partial_action_reward(spark, sf_dir):
    checks = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("simulation_id"), F.when(F.col("l_linestatus") == "O", "read").otherwise("write").alias("tool_type"), (F.col("l_returnflag") == "N").alias("action_match"))
    return rewards.partial_action_reward(checks)


@query("""SELECT a.s_suppkey AS first_leg, b.s_suppkey AS second_leg, n.n_name AS via FROM supplier a JOIN nation n ON a.s_nationkey = n.n_nationkey JOIN supplier b ON b.s_nationkey = a.s_nationkey AND b.s_acctbal >= a.s_acctbal AND b.s_suppkey <> a.s_suppkey""")
def onestop_self_join(spark, sf_dir):
    legs = _t(spark, sf_dir, "supplier")
    a, b = (legs.select("s_nationkey", F.col("s_suppkey").alias(k), F.col("s_acctbal").alias(f"{k}_at")) for k in ("first_leg", "second_leg"))
    both = a.join(b, "s_nationkey").where("second_leg_at >= first_leg_at and first_leg <> second_leg")
    return both.join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("first_leg", "second_leg", F.col("n_name").alias("via"))


@query("""SELECT e.event_id, (SELECT min(n.ts) FROM events n WHERE n.user_id = e.user_id AND n.event_type = 'purchase' AND n.ts >= e.ts) AS next_at FROM events e WHERE e.event_type = 'click'""")
def asof_next_event(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    found = intervals.next_at_or_after(rows.where("event_type = 'click'").select("event_id", "user_id", "ts"), rows.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought")), "user_id", "ts", "bought")
    return found.select("event_id", "next_at")


_SPANS = "SELECT user_id, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CASE WHEN event_type <> 'view' OR event_id % 9 > 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + 3600 * (1 + event_id % 5) END AS \"end\", event_type FROM events"


def spans(spark, sf_dir):
    start = F.col("ts").cast("timestamp").cast("long")
    long = (F.col("event_type") != "view") | (F.col("event_id") % 9 > 0)
    return _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), start.alias("start"), F.when(long, start + 3600 * (1 + F.col("event_id") % 5)).alias("end"), "event_type")


@query(f"""WITH s AS ({_SPANS}) SELECT a.user_id, a.id AS left_id, b.id AS right_id, greatest(a.start, b.start) AS start, least(coalesce(a."end", 1099511627776), coalesce(b."end", 1099511627776)) AS "end"
FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND a.start < coalesce(b."end", 1099511627776) AND b.start < coalesce(a."end", 1099511627776)""")
def interval_overlap(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return intervals.overlaps(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), "user_id", 6 * 3600)


@query(f"""WITH s AS (SELECT * FROM ({_SPANS}) WHERE "end" IS NOT NULL),
m AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 500 THEN 1 ELSE 0 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS parts FROM g GROUP BY user_id, k""")
def interval_merge(spark, sf_dir):
    return intervals.merged(spans(spark, sf_dir).where("end is not null"), "user_id", "start", "end", 500)


# --- ticks -------------------------------------------------------------------------------------

_ISLANDS = """SELECT simulation_id, row_number() OVER (PARTITION BY simulation_id ORDER BY min(tick)) AS island, min(tick) AS start_tick, max(tick) + 1 AS end_tick, count(*) AS "rows"
FROM (SELECT *, tick - row_number() OVER (PARTITION BY simulation_id ORDER BY tick) AS g FROM ticks WHERE {flag}) GROUP BY simulation_id, g"""


@query(f"WITH {TICKS} " + _ISLANDS.format(flag="user_speaks"))
def segments_islands(spark, sf_dir):
    return intervals.islands(ticks(spark, sf_dir), "simulation_id", "tick", F.col("user_speaks"))


@query(f"WITH {TICKS}, i AS (" + _ISLANDS.format(flag="NOT (user_speaks OR agent_speaks)") + ') SELECT * FROM i WHERE "rows" >= 2')
def silence_periods(spark, sf_dir):
    return intervals.silences(ticks(spark, sf_dir), "simulation_id", "tick", F.col("user_speaks") | F.col("agent_speaks"), 2)


@query(f"WITH {TICKS}, i AS (" + _ISLANDS.format(flag="NOT agent_speaks") + ') SELECT simulation_id, coalesce(max("rows"), 0) AS streak FROM (SELECT DISTINCT simulation_id FROM ticks) LEFT JOIN i USING (simulation_id) GROUP BY 1')
def streak_max(spark, sf_dir):
    return intervals.longest_streak(ticks(spark, sf_dir), "simulation_id", "tick", ~F.col("agent_speaks"))


_VOICE = f"""WITH all_{TICKS},
ticks AS (SELECT * EXCLUDE (lone) FROM (SELECT *, lead(tick) OVER w IS NULL AND user_speaks AND NOT coalesce(lag(user_speaks) OVER w, false) AS lone FROM all_ticks WINDOW w AS (PARTITION BY simulation_id ORDER BY tick)) WHERE NOT lone),
u AS ({_ISLANDS.format(flag="user_speaks")}), a AS ({_ISLANDS.format(flag="agent_speaks")}),
turns AS (SELECT u.*, lead(u.start_tick) OVER (PARTITION BY u.simulation_id ORDER BY u.start_tick) AS next_user
  FROM u JOIN ticks t ON t.simulation_id = u.simulation_id AND t.tick = u.end_tick - 1 WHERE NOT t.agent_speaks),
answered AS (SELECT t.*, (SELECT min(a.start_tick) FROM a WHERE a.simulation_id = t.simulation_id AND a.start_tick >= t.end_tick) AS next_at FROM turns t),
events_ AS (SELECT simulation_id, end_tick AS tick, CASE WHEN next_at IS NOT NULL AND (next_user IS NULL OR next_at <= next_user) THEN 'response' WHEN next_user IS NOT NULL THEN 'no_response' END AS event,
  CASE WHEN next_at IS NOT NULL AND (next_user IS NULL OR next_at <= next_user) THEN (next_at - end_tick) * 0.2 END AS latency_seconds FROM answered),
cuts AS (
  SELECT u.simulation_id, u.start_tick AS tick, 'user_interrupts_agent' AS event, (SELECT min(q.tick) FROM ticks q WHERE q.simulation_id = u.simulation_id AND q.tick >= u.start_tick AND q.tick < u.start_tick + 10 AND NOT q.agent_speaks) AS quiet
  FROM u JOIN ticks t ON t.simulation_id = u.simulation_id AND t.tick = u.start_tick WHERE t.agent_speaks
  UNION ALL
  SELECT a.simulation_id, a.start_tick, 'agent_interrupts_user', (SELECT min(q.tick) FROM ticks q WHERE q.simulation_id = a.simulation_id AND q.tick >= a.start_tick AND q.tick < a.start_tick + 10 AND NOT q.user_speaks)
  FROM a JOIN ticks t ON t.simulation_id = a.simulation_id AND t.tick = a.start_tick WHERE t.user_speaks)"""


@query(_VOICE + " SELECT simulation_id, tick, event, round(CAST(latency_seconds AS DOUBLE), 6) AS latency_seconds FROM events_ WHERE event IS NOT NULL")
def turn_transitions(spark, sf_dir):
    return _rounded(voice.transitions(voice.drop_final_tick(ticks(spark, sf_dir))))


@query(_VOICE + " SELECT simulation_id, tick, event, quiet IS NOT NULL AS yielded, round(CAST((quiet - tick) * 0.2 AS DOUBLE), 6) AS yield_seconds FROM cuts")
def interruptions(spark, sf_dir):
    return _rounded(voice.interruptions(voice.drop_final_tick(ticks(spark, sf_dir))))


@query(_VOICE + """, p AS (SELECT count(*) AS turns, count(*) FILTER (WHERE event = 'response') AS responses, avg(CAST(latency_seconds AS DOUBLE)) AS latency_mean, stddev_samp(CAST(latency_seconds AS DOUBLE)) AS latency_std FROM events_ WHERE event IS NOT NULL),
c AS (SELECT count(*) FILTER (WHERE event = 'user_interrupts_agent') AS user_interruptions, count(*) FILTER (WHERE event = 'user_interrupts_agent' AND quiet IS NOT NULL) AS yielded,
  avg(CASE WHEN event = 'user_interrupts_agent' THEN CAST((quiet - tick) * 0.2 AS DOUBLE) END) AS yield_mean, count(*) FILTER (WHERE event = 'agent_interrupts_user') AS agent_interruptions FROM cuts)
SELECT turns, responses, round(latency_mean, 6) AS latency_mean, round(latency_std, 6) AS latency_std, user_interruptions, yielded, round(yield_mean, 6) AS yield_mean, agent_interruptions,
  round(responses / turns, 6) AS response_rate, round(yielded / user_interruptions, 6) AS yield_rate, round(agent_interruptions / turns, 6) AS agent_interruption_rate FROM p, c""")
def voice_panel(spark, sf_dir):
    return _rounded(voice.panel(ticks(spark, sf_dir)))


# --- retrieval ---------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)t[io]on')) AS DOUBLE) AS score FROM documents WHERE regexp_matches(text, '(?i)t[io]on')")
def grep_search(spark, sf_dir):
    return retrieval.grep(_t(spark, sf_dir, "documents"), "t[io]on")


_BM25 = """tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS token FROM documents),
post AS (SELECT token, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
dl AS (SELECT doc_id, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS l FROM documents),
idf0 AS (SELECT token, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post GROUP BY 1),
idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
q AS (SELECT token, count(*) AS times FROM (SELECT unnest(['the', 'that', 'der', 'the']) AS token) GROUP BY 1),
bm AS (SELECT doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / (SELECT avg(l) FROM dl)))) AS score FROM q JOIN idf USING (token) JOIN post USING (token) JOIN dl USING (doc_id) GROUP BY 1)"""


def _bm25(spark, sf_dir):
    asked = spark.createDataFrame([(1, "The that  der the")], "query_id int, query string")
    return retrieval.Bm25Index.build(_t(spark, sf_dir, "documents")).search(asked)


@query(f"WITH {_BM25} SELECT 1 AS query_id, doc_id, round(score, 6) AS score FROM bm")
def bm25_search(spark, sf_dir):
    return _rounded(_bm25(spark, sf_dir))


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings")
def cosine_search(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").first()["embedding"]
    return _rounded(retrieval.cosine_search(vectors, [float(x) for x in asked]))


@query(f"""WITH {_BM25}, g AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)t[io]on')) AS score FROM documents WHERE regexp_matches(text, '(?i)t[io]on')),
f AS (SELECT doc_id, max(score) AS score FROM (SELECT doc_id, score FROM bm UNION ALL SELECT doc_id, score FROM g) GROUP BY 1)
SELECT doc_id, round(score, 6) AS score FROM f ORDER BY f.score DESC, doc_id LIMIT 10""")
def fused_search(spark, sf_dir):
    fused = retrieval.fuse(_bm25(spark, sf_dir), retrieval.grep(_t(spark, sf_dir, "documents"), "t[io]on"))
    return _rounded(retrieval.top_k(fused, 10))


# --- usage, tasks, reports ---------------------------------------------------------------------


@query("""WITH u AS (SELECT event_type AS model, event_id AS seq, user_id % 10 AS scope_id, CASE WHEN event_id % 3 = 0 THEN 'cumulative' ELSE 'delta' END AS semantics, CAST(floor(value) AS BIGINT) AS input_tokens, CASE WHEN event_id % 4 > 0 THEN event_id % 100 END AS output_tokens FROM events),
l AS (SELECT model, input_tokens, output_tokens FROM u WHERE semantics = 'delta'
  UNION ALL SELECT model, input_tokens, output_tokens FROM (SELECT *, row_number() OVER (PARTITION BY model, scope_id ORDER BY seq DESC) AS n FROM u WHERE semantics = 'cumulative') WHERE n = 1)
SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM l GROUP BY 1""")
def usage_ledger(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("scope_id"), F.when(F.col("event_id") % 3 == 0, "cumulative").otherwise("delta").alias("semantics"), F.floor("value").alias("input_tokens"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 100).alias("output_tokens"))
    return usage.ledger(rows, ["model"], ("input_tokens", "output_tokens"))


_RATES = [("Brand", 0.5, 1.0), ("Brand#1", 2.0, None), ("Brand#12", 3.0, 4.0), ("Brand#33", 1.5, 2.5)]


@query("""WITH rates AS (SELECT * FROM (VALUES ('Brand', 0.5, 1.0), ('Brand#1', 2.0, NULL), ('Brand#12', 3.0, 4.0), ('Brand#33', 1.5, 2.5)) r(prefix, input_price, output_price)),
m AS (SELECT p_partkey, p_brand AS model, prefix, input_price, output_price, p_size, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS n FROM part LEFT JOIN rates ON starts_with(p_brand, prefix))
SELECT p_partkey, model, prefix AS rate_prefix, CASE WHEN p_size % 5 = 0 THEN 0.0 WHEN input_price IS NULL OR (output_price IS NULL AND p_size % 2 > 0) THEN NULL ELSE round(p_size * input_price + p_size % 2 * coalesce(output_price, 0), 6) END AS cost FROM m WHERE n = 1""")
def prefix_price(spark, sf_dir):
    rates = spark.createDataFrame(_RATES, "prefix string, input_price double, output_price double")
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("model"), F.col("p_size").alias("input_tokens"), (F.col("p_size") % 2).alias("output_tokens"))
    priced = usage.with_rate(rows, rates)
    cost = usage.record_cost({"input_tokens": "input_price", "output_tokens": "output_price"}, F.col("input_tokens") % 5 != 0)
    return _rounded(priced.select("p_partkey", "model", "rate_prefix", cost.alias("cost")))


@query("SELECT p_partkey AS task_id, CAST(t AS INT) AS trial, CAST(300 + t AS INT) AS seed FROM part, range(4) r(t) WHERE NOT (p_partkey % 2 = 0 AND t < 2)")
def task_work_units(spark, sf_dir):
    tasks = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"))
    done = tasks.where("task_id % 2 = 0").withColumn("trial", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("seed", F.lit(300) + F.col("trial"))
    return work.work_units(tasks, 4, 300, done)


@query("SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM orders) WHERE best IS NULL OR o_totalprice > best")
def frontier_running_max(spark, sf_dir):
    return leaderboard.frontier(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")


@query("""WITH s AS (SELECT c_custkey AS model, c_mktsegment AS domain, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score FROM customer),
o AS (SELECT model, avg(score) AS overall FROM s GROUP BY 1)
SELECT model, overall, rank FROM (SELECT *, row_number() OVER (ORDER BY overall DESC NULLS LAST, model) AS rank FROM o) WHERE rank <= 25""")
def leaderboard_rank(spark, sf_dir):
    scores = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("score"))
    return leaderboard.ranked(leaderboard.overall(scores), "overall", "model", top=25)


@query("SELECT l_suppkey AS name, round(avg(CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END END), 6) AS F, round(avg(CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END END), 6) AS O FROM lineitem GROUP BY 1")
def action_success_pivot(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "name")
    return _rounded(leaderboard.success_pivot(rows, "name", "l_linestatus", ["F", "O"], F.col("l_returnflag") == "R"))


@query("SELECT CAST(least(floor((l_quantity - 1) / 4.9), 9) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 1 AND l_quantity <= 50 GROUP BY 1")
def histogram(spark, sf_dir):
    return leaderboard.histogram(_t(spark, sf_dir, "lineitem"), "l_quantity", 1.0, 50.0, 10)


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def value_shares(spark, sf_dir):
    return _rounded(leaderboard.shares(_t(spark, sf_dir, "events"), "event_type"))


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std_sample, round(stddev_pop(c_acctbal), 6) AS std_population FROM customer GROUP BY 1")
def spread_by_segment(spark, sf_dir):
    return _rounded(leaderboard.spread_by(_t(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal"))


@query("SELECT user_id, event_id, concat('act(k=', json_extract_string(props, '$.k'), ', type=', event_type, ')') AS call, concat('call_', substring(sha256(concat(user_id, '_', event_id)), 1, 16)) AS call_id FROM events")
def functional_calls(spark, sf_dir):
    arguments = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"))
    return _t(spark, sf_dir, "events").select("user_id", "event_id", text.call_format(F.lit("act"), arguments).alias("call"), text.deterministic_id("call_", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("call_id"))


@query(f"""WITH {TICKS}, e AS (SELECT simulation_id, tick, 0 AS priority, 'agent' AS speaker, event_id FROM ticks WHERE agent_speaks UNION ALL SELECT simulation_id, tick, 1, 'user', event_id FROM ticks WHERE user_speaks)
SELECT simulation_id, row_number() OVER (PARTITION BY simulation_id ORDER BY tick, priority) - 1 AS position, tick, speaker, event_id FROM e""")
def linearize_simple(spark, sf_dir):
    return linearize.simple(ticks(spark, sf_dir))


@query(f"""WITH {TICKS}, e AS (SELECT simulation_id, tick, 1 AS priority, 'agent' AS speaker, event_id FROM ticks WHERE agent_speaks UNION ALL SELECT simulation_id, tick, 0, 'user', event_id FROM ticks WHERE user_speaks)
SELECT simulation_id, row_number() OVER (PARTITION BY simulation_id ORDER BY tick, priority) - 1 AS position, tick, speaker, event_id FROM e""")
def linearize_other_first(spark, sf_dir):
    return linearize.simple(ticks(spark, sf_dir), own_first=False)


@query(f"""WITH {TICKS}, b AS (SELECT *, max(CASE WHEN agent_speaks THEN tick END) OVER (PARTITION BY simulation_id ORDER BY tick) AS last,
  max(CASE WHEN agent_speaks THEN tick END) OVER (PARTITION BY simulation_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM ticks),
r AS (SELECT *, sum(CASE WHEN agent_speaks AND coalesce(tick - prior > 2, true) THEN 1 ELSE 0 END) OVER (PARTITION BY simulation_id ORDER BY tick) AS run FROM b),
o AS (SELECT simulation_id, run, min(tick) AS begin FROM r WHERE agent_speaks AND user_speaks GROUP BY ALL),
k AS (SELECT r.*, CASE WHEN tick >= begin AND tick - last < 2 THEN begin ELSE tick END AS put_at FROM r LEFT JOIN o USING (simulation_id, run)),
e AS (SELECT simulation_id, tick, put_at, 1 AS priority, 'agent' AS speaker FROM k WHERE agent_speaks UNION ALL SELECT simulation_id, tick, put_at, 0, 'user' FROM k WHERE user_speaks)
SELECT simulation_id, row_number() OVER (PARTITION BY simulation_id ORDER BY put_at, priority, tick) - 1 AS position, tick, speaker FROM e""")
def linearize_overlap(spark, sf_dir):
    return linearize.gathered(ticks(spark, sf_dir), patience=2)


@query(f"""WITH {TICKS}, said AS (SELECT simulation_id, tick, 'agent' AS speaker FROM ticks WHERE agent_speaks UNION ALL SELECT simulation_id, tick, 'user' FROM ticks WHERE user_speaks),
g AS (SELECT *, tick - row_number() OVER (PARTITION BY simulation_id, speaker ORDER BY tick) AS run FROM said),
seg AS (SELECT simulation_id, speaker, run, min(tick) AS s, max(tick) AS e FROM g GROUP BY ALL),
held AS (SELECT o.simulation_id, o.speaker, o.run, i.speaker AS inner_speaker, i.run AS inner_run, i.e FROM seg o JOIN seg i ON o.simulation_id = i.simulation_id AND o.speaker <> i.speaker AND i.s >= o.s AND i.e <= o.e
  WHERE i.speaker = 'agent' OR i.s > o.s OR i.e < o.e),
t AS (SELECT g.simulation_id, g.speaker, g.run, g.tick, min(h.e) FILTER (WHERE h.e >= g.tick) AS cut, max(h.e) AS last FROM g LEFT JOIN held h USING (simulation_id, speaker, run) GROUP BY ALL),
k AS (SELECT t.*, CASE WHEN h.e IS NOT NULL THEN h.e WHEN cut IS NOT NULL THEN cut WHEN last IS NOT NULL THEN last + 1 ELSE seg.s END AS put_at,
    CASE WHEN t.speaker = 'agent' THEN 1 WHEN h.e IS NOT NULL OR (cut IS NULL AND last IS NOT NULL) THEN 3 ELSE 0 END AS priority
  FROM t JOIN seg USING (simulation_id, speaker, run) LEFT JOIN held h ON h.simulation_id = t.simulation_id AND h.inner_speaker = t.speaker AND h.inner_run = t.run),
p AS (SELECT simulation_id, speaker, put_at, priority, min(tick) AS start_tick, max(tick) + 1 AS end_tick FROM k GROUP BY ALL)
SELECT simulation_id, row_number() OVER (PARTITION BY simulation_id ORDER BY put_at, priority) - 1 AS position, speaker, start_tick, end_tick FROM p""")
def linearize_containment(spark, sf_dir):
    return linearize.containment(ticks(spark, sf_dir))


@query(f"""WITH {TICKS}, s AS (SELECT simulation_id, event_type AS key, value, tick, row_number() OVER (PARTITION BY simulation_id, event_type ORDER BY tick DESC) AS n FROM ticks WHERE event_type <> 'view')
SELECT simulation_id, key, value FROM s WHERE n = 1""")
def state_replay(spark, sf_dir):
    calls = ticks(spark, sf_dir).select("simulation_id", F.col("tick").alias("pos"), F.when(F.col("event_type") == "view", "look").otherwise("set").alias("name"), F.col("event_type").alias("key"), "value")
    return replay.replay_sets(calls)


@query(f"""WITH {TICKS}, c AS (SELECT simulation_id, event_type AS key, value, tick FROM ticks WHERE event_type <> 'view'),
e AS (SELECT simulation_id, key, arg_max(value, tick) AS value FROM c GROUP BY ALL), f AS (SELECT simulation_id, key, arg_max(value, tick) AS value FROM c WHERE tick % 7 <> 3 GROUP BY ALL)
SELECT e.simulation_id, bool_and(f.key IS NOT NULL AND e.value IS NOT DISTINCT FROM f.value) AS db_match FROM e LEFT JOIN f ON e.simulation_id = f.simulation_id AND e.key = f.key GROUP BY 1""")
def state_match(spark, sf_dir):
    calls = ticks(spark, sf_dir).select("simulation_id", F.col("tick").alias("pos"), F.when(F.col("event_type") == "view", "look").otherwise("set").alias("name"), F.col("event_type").alias("key"), "value")
    return replay.same_state(replay.replay_sets(calls), replay.replay_sets(calls.where("pos % 7 <> 3")))


# --- streaming definitions, as batches ---------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    rows = events_stream.tumbling_counts(_t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    rows = events_stream.sessions(_t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
