"""Further registered queries: speech events, transcripts, lookups, breakdowns and reports on the driver's tables.

Names of statuses, severities, domains, modes and operators in these queries are fixed values: they are those of the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolens.functions import arithmetic, dates, text
from convolens.operators import breakdown, dml, leaderboard, lookups, metrics, retrieval, transcripts, voice, voice_events
from convolens.operators.vector_index import VectorIndex
from convolens.plans.proxies import _BM25, _ISLANDS, TICKS, _rounded, _t, query, ticks, trials

# --- speech events -----------------------------------------------------------------------------


@query(f"""WITH {TICKS} SELECT simulation_id, event_type AS effect, min(tick) AS start_tick, max(tick) + 1 AS end_tick, count(*) AS "rows"
FROM (SELECT *, tick - row_number() OVER (PARTITION BY simulation_id, event_type ORDER BY tick) AS g FROM ticks WHERE event_type IN ('error', 'signup')) GROUP BY simulation_id, event_type, g""")
def effect_segments(spark, sf_dir):
    effect = F.when(F.col("event_type").isin("error", "signup"), F.col("event_type"))
    return voice_events.effect_segments(ticks(spark, sf_dir).withColumn("effect", effect), "effect")


_ASIDES = f"""WITH {TICKS}, h AS (SELECT *, tick - row_number() OVER (PARTITION BY simulation_id ORDER BY tick) AS g FROM ticks WHERE user_speaks),
s AS (SELECT simulation_id, min(tick) AS start_tick, max(tick) + 1 AS end_tick, bool_or(value < 5) AS b, bool_or(event_id % 5 = 0) AS v, bool_or(event_id % 3 = 0) AS n, arg_min(agent_speaks, tick) AS over_speech FROM h GROUP BY simulation_id, g),
a AS ({_ISLANDS.format(flag="agent_speaks")}),
o AS (SELECT simulation_id, start_tick AS tick, CASE WHEN b THEN 'backchannel' WHEN v THEN 'vocal_tic' WHEN n THEN 'non_directed_speech' ELSE 'user_interrupts_agent' END AS event FROM s WHERE over_speech)"""


def _segments(spark, sf_dir):
    flags = {"backchannel": F.col("value") < 5, "vocal_tic": F.col("event_id") % 5 == 0, "non_directed_speech": F.col("event_id") % 3 == 0}
    return voice_events.flagged_segments(ticks(spark, sf_dir), "user", flags)


@query(_ASIDES + " SELECT * FROM o")
def overlap_kinds(spark, sf_dir):
    return voice_events.overlap_kinds(_segments(spark, sf_dir))


@query(_ASIDES + """ SELECT simulation_id, start_tick AS tick, CASE WHEN (SELECT min(a.start_tick) FROM a WHERE a.simulation_id = s.simulation_id AND a.start_tick >= s.start_tick) <= s.end_tick + 5
  THEN 'agent_responds' ELSE 'silent_correct' END AS event FROM s WHERE NOT over_speech AND (v OR n)""")
def aside_answers(spark, sf_dir):
    asides = _segments(spark, sf_dir).where("not over_speech and (vocal_tic or non_directed_speech)")
    return voice_events.answers(asides, voice.segments(ticks(spark, sf_dir), "agent"), 5)


@query(f"""WITH {TICKS} SELECT * FROM (SELECT simulation_id, tick, (SELECT min(q.tick) FROM ticks q WHERE q.simulation_id = t.simulation_id AND q.tick >= t.tick AND q.tick < t.tick + 3 AND NOT q.agent_speaks) AS stopped_at
  FROM ticks t WHERE event_id % 4 = 0 AND agent_speaks) WHERE stopped_at IS NOT NULL""")
def effect_yields(spark, sf_dir):
    return voice_events.yields_to_effects(ticks(spark, sf_dir), F.col("event_id") % 4 == 0, 3)


@query(_ASIDES + " SELECT simulation_id % 4 AS provider, event, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY simulation_id % 4), 6) AS share FROM o GROUP BY 1, 2")
def event_category_rates(spark, sf_dir):
    events = voice_events.overlap_kinds(_segments(spark, sf_dir)).withColumn("provider", F.col("simulation_id") % 4)
    return _rounded(voice_events.category_rates(events, ["provider"]))


# --- transcripts and tool results --------------------------------------------------------------


@query("""WITH c AS (SELECT user_id AS u, event_id AS call, event_id // 500 AS call_id FROM events WHERE event_type = 'click'),
r AS (SELECT user_id AS u, event_id AS result, event_id // 500 AS call_id FROM events WHERE event_type = 'purchase'),
m AS (SELECT u, result, (SELECT max(call) FROM c WHERE c.u = r.u AND c.call_id = r.call_id AND call <= result) AS own, (SELECT max(call) FROM c WHERE c.u = r.u AND call <= result) AS near FROM r)
SELECT u AS simulation_id, result, coalesce(own, near) AS call, CASE WHEN own IS NOT NULL THEN 'id' WHEN near IS NOT NULL THEN 'nearest' END AS how FROM m""")
def tool_result_pairs(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("simulation_id"), "event_id", F.floor(F.col("event_id") / 500).alias("call_id"), F.col("event_id").alias("at"), "event_type")
    calls = rows.where("event_type = 'click'").withColumnRenamed("event_id", "call").drop("event_type")
    return transcripts.pair_results(calls, rows.where("event_type = 'purchase'").withColumnRenamed("event_id", "result").drop("event_type"))


@query("""SELECT doc_id, CAST(part AS INT) AS part, length(slice) AS n_chars, md5(slice) AS digest FROM (
  SELECT doc_id, i - 1 AS part, substring(text, CAST(ceil(length(text) * lo / 10) AS BIGINT) + 1, CAST(ceil(length(text) * hi / 10) AS BIGINT) - CAST(ceil(length(text) * lo / 10) AS BIGINT)) AS slice
  FROM documents, (VALUES (1, 0, 1), (2, 1, 3), (3, 3, 6), (4, 6, 10)) w(i, lo, hi))""")
def transcript_slices(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(transcripts.slices(F.col("text"), [1, 2, 3, 4])).alias("part", "slice"))
    return rows.select("doc_id", "part", F.length("slice").cast("long").alias("n_chars"), F.md5("slice").alias("digest"))


@query("SELECT json_extract_string(props, '$.k') AS uuid, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS parts, count(*) AS chunks FROM events GROUP BY 1")
def merged_scripts(spark, sf_dir):
    chunks = _t(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("uuid"), "event_type")
    return transcripts.merged_scripts(chunks, "uuid", "event_type")


@query("""SELECT user_id, min(CASE WHEN event_type = 'signup' THEN event_id END) AS started, max(CASE WHEN event_type = 'error' THEN event_id END) AS stopped,
  arg_max(props, CASE WHEN event_type = 'view' THEN event_id END) AS text FROM events GROUP BY 1""")
def item_transcripts(spark, sf_dir):
    of = lambda kind, c: F.when(F.col("event_type") == kind, F.col(c))
    return transcripts.item_transcripts(_t(spark, sf_dir, "events").withColumn("pos", F.col("event_id")), ["user_id"], of("signup", "event_id"), of("error", "event_id"), of("view", "props"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, [event_type, json_extract_string(props, '$.k')[1:1]] AS ids, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT user_id, event_id, n, ids AS held, CAST(0 AS BIGINT) AS part FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN list_has_any(g.held, e.ids) THEN list_distinct(list_concat(g.held, e.ids)) ELSE e.ids END, g.part + CASE WHEN list_has_any(g.held, e.ids) THEN 0 ELSE 1 END FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1)
SELECT user_id AS simulation_id, event_id AS pos, part FROM g""")
def utterance_groups(spark, sf_dir):
    ids = F.array(F.col("event_type"), F.get_json_object("props", "$.k").substr(1, 1))
    chunks = _t(spark, sf_dir, "events").select(F.col("user_id").alias("simulation_id"), F.col("event_id").alias("pos"), ids.alias("ids"))
    return transcripts.utterance_groups(chunks)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_idx, role FROM conversations WHERE role <> 'system'")
def user_visible_messages(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").where("role <> 'system'")
    return rows.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("turn_idx"), "role")


@query("""WITH s AS (SELECT *, length(text) AS size, CASE WHEN length(text) > 91 THEN concat(substring(text, 1, 50), ' ... [truncated] ... ', right(text, 20)) ELSE text END AS short FROM conversations),
w AS (SELECT *, sum(size) OVER (PARTITION BY conv_id) - 3000 AS need, coalesce(sum(size - length(short)) OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'tool' THEN 0 ELSE 1 END, size DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved FROM s)
SELECT conv_id AS simulation_id, turn AS pos, md5(CASE WHEN saved < need AND size > length(short) THEN short ELSE text END) AS digest FROM w""")
def trimmed_messages(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("simulation_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    return dml.trim_to_budget(rows, 3000, 50, 20).select("simulation_id", "pos", F.md5("content").alias("digest"))


# --- lookups -----------------------------------------------------------------------------------

_REQUESTS = "r AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN CAST(s_suppkey AS VARCHAR) ELSE concat('missing ', s_suppkey) END AS request FROM supplier)"


@query(f"""WITH {_REQUESTS} SELECT request, coalesce(t.s_suppkey, i.s_suppkey) AS id, CASE WHEN t.s_suppkey IS NOT NULL THEN 'title' WHEN i.s_suppkey IS NOT NULL THEN 'id' END AS found_by
FROM r LEFT JOIN (SELECT s_name, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) t ON t.s_name = request LEFT JOIN supplier i ON CAST(i.s_suppkey AS VARCHAR) = request""")
def required_documents(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier")
    key, kind = F.col("s_suppkey"), F.col("s_suppkey") % 3
    requests = rows.select(F.when(kind == 0, F.col("s_name")).when(kind == 1, key.cast("string")).otherwise(F.concat(F.lit("missing "), key.cast("string"))).alias("request"))
    return lookups.by_title_then_id(requests, rows.select(key.alias("id"), F.col("s_name").alias("title")))


@query("""WITH r AS (SELECT concat(CASE n_nationkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'S' ELSE 'X' END, n_nationkey) AS request FROM nation)
SELECT request, kind, label FROM r JOIN (SELECT concat('C', c_custkey) AS request, 'C' AS kind, c_name AS label FROM customer UNION ALL SELECT concat('S', s_suppkey), 'S', s_name FROM supplier) USING (request)""")
def prefix_routed_lookup(spark, sf_dir):
    kind = F.col("n_nationkey") % 3
    requests = _t(spark, sf_dir, "nation").select(F.concat(F.when(kind == 0, "C").when(kind == 1, "S").otherwise("X"), F.col("n_nationkey").cast("string")).alias("request"))
    table = lambda name, key, label: _t(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(label).alias("label"))
    return lookups.by_prefix(requests, {"C": table("customer", "c_custkey", "c_name"), "S": table("supplier", "s_suppkey", "s_name")})


@query("SELECT DISTINCT n_nationkey AS value, s_suppkey FROM nation JOIN supplier ON s_suppkey = n_nationkey OR s_nationkey = n_nationkey")
def either_key_lookup(spark, sf_dir):
    requests = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("value"))
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("own"), F.col("s_nationkey").cast("long").alias("nation"))
    return lookups.by_either(requests, rows, ["own", "nation"], "s_suppkey")


@query("SELECT o_custkey, l_orderkey, l_linenumber, p_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'P'")
def customer_chain(spark, sf_dir):
    owners = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("order_ids"))
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return lookups.through_ids(owners, "order_ids", lines, "l_orderkey").join(parts, "l_partkey").select("o_custkey", "l_orderkey", "l_linenumber", "p_name")


@query("SELECT user_id, max(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' THEN value END) AS value FROM events GROUP BY 1")
def value_on_day(spark, sf_dir):
    return lookups.value_on(_t(spark, sf_dir, "events"), "user_id", F.date_format("ts", "yyyy-MM-dd"), F.col("value"), "2024-01-05")


@query("""SELECT o_custkey, o_orderkey, position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END DESC NULLS LAST, o_orderkey) AS position FROM orders) WHERE position <= 3""")
def newest_transactions(spark, sf_dir):
    key = F.col("o_orderkey")
    written = F.when(key % 7 == 0, "no date").when(key % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", written.alias("written"))
    return lookups.newest(rows, "o_custkey", dates.two_format_date(F.col("written")), "o_orderkey", 3).drop("written")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) WHERE n <= 3")
def stratified_sample(spark, sf_dir):
    return lookups.stratified(_t(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 3)


@query("""WITH now AS (SELECT doc_id, md5(text) AS d FROM documents WHERE doc_id % 10 > 0), old AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN concat(text, 'x') ELSE text END) AS d FROM documents WHERE doc_id % 3 > 0)
SELECT coalesce(now.doc_id, old.doc_id) AS doc_id, CASE WHEN now.doc_id IS NULL THEN 'removed' WHEN old.doc_id IS NULL THEN 'new' WHEN now.d = old.d THEN 'hit' ELSE 'stale' END AS plan FROM now FULL JOIN old ON now.doc_id = old.doc_id""")
def embedding_cache_plan(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents")
    now = rows.where("doc_id % 10 > 0").select("doc_id", F.md5("text").alias("digest"))
    before = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return lookups.cache_plan(now, rows.where("doc_id % 3 > 0").select("doc_id", F.md5(before).alias("digest")), "doc_id")


# --- breakdowns --------------------------------------------------------------------------------


@query("""WITH c AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS act, bool_or(l_linestatus = 'F') AS db FROM lineitem GROUP BY 1)
SELECT o_orderkey AS simulation_id, CASE WHEN o_orderstatus <> 'P' THEN CAST(act AS DOUBLE) END AS action_reward, CASE WHEN o_orderstatus <> 'O' THEN CAST(db AS DOUBLE) END AS db_reward FROM c JOIN orders ON o_orderkey = l_orderkey""")
def reward_breakdown(spark, sf_dir):
    parts = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("simulation_id")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("act"), F.bool_or(F.col("l_linestatus") == "F").alias("db"))
    rows = parts.join(_t(spark, sf_dir, "orders"), F.col("simulation_id") == F.col("o_orderkey"))
    status = F.col("o_orderstatus")
    basis = F.when(status == "P", F.array(F.lit("DB"))).when(status == "O", F.array(F.lit("ACTION"))).otherwise(F.array(F.lit("ACTION"), F.lit("DB")))
    return rows.select("simulation_id", *breakdown.reward_breakdown(basis, {"ACTION": F.col("act"), "DB": F.col("db")}))


@query("""WITH s AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS db_match, CASE o_orderkey % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'not_needed' END AS auth,
  CASE o_orderstatus WHEN 'F' THEN 'agent_stop' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'max_steps' ELSE 'timeout' END ELSE 'too_many_errors' END AS reason FROM orders)
SELECT count(*) FILTER (WHERE db_match) AS db_matches, count(*) FILTER (WHERE NOT db_match) AS db_mismatches, count(*) FILTER (WHERE db_match IS NULL) AS db_unchecked,
  count(*) FILTER (WHERE auth = 'succeeded') AS auth_succeeded, count(*) FILTER (WHERE auth = 'failed') AS auth_failed, count(*) FILTER (WHERE auth = 'not_needed') AS auth_not_needed,
  count(*) FILTER (WHERE reason = 'agent_stop') AS stopped, count(*) FILTER (WHERE reason = 'max_steps') AS out_of_steps, count(*) FILTER (WHERE reason = 'too_many_errors') AS failed FROM s""")
def outcome_counts(spark, sf_dir):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return breakdown.outcome_counts(
        _t(spark, sf_dir, "orders").select(
            F.when(key % 5 == 1, False).when(key % 5 > 1, True).alias("db_match"),
            F.when(key % 4 == 0, "succeeded").when(key % 4 == 1, "failed").when(key % 4 == 2, "not_needed").alias("auth_status"),
            F.when(status == "F", "agent_stop").when(status == "O", F.when(key % 2 == 0, "max_steps").otherwise("timeout")).otherwise("too_many_errors").alias("termination_reason"),
        )
    )


@query("""SELECT CASE WHEN r = 1 THEN 'always' WHEN r = 0 THEN 'never' WHEN r >= 0.5 THEN 'mostly' ELSE 'seldom' END AS label, count(*) AS tasks
FROM (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS r FROM lineitem GROUP BY l_orderkey) GROUP BY 1""")
def task_labels(spark, sf_dir):
    return breakdown.task_labels(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_returnflag") == "R").alias("success")))


@query("SELECT l_orderkey AS task_id, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R')")
def never_passed(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), "l_linenumber", (F.col("l_returnflag") == "R").alias("success"))
    return breakdown.never_passed(rows).drop("success")


@query("""SELECT conv_id, role, CASE WHEN bool_or(turn % 5 = 4) THEN NULL ELSE round(sum(length(text) / 1000), 6) END AS cost, CAST(sum(CASE WHEN turn % 3 > 0 THEN length(text) END) AS BIGINT) AS tokens FROM conversations GROUP BY 1, 2""")
def message_costs(spark, sf_dir):
    size = F.length("text")
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "role", F.when(F.col("turn") % 5 != 4, size / 1000).alias("cost"), F.when(F.col("turn") % 3 > 0, size).alias("tokens"))
    return _rounded(breakdown.message_costs(rows, ["conv_id", "role"]))


@query("SELECT l_orderkey AS simulation_id, CASE WHEN bool_or(l_shipdate > TIMESTAMP '2001-01-01') THEN 0.0 WHEN bool_and(l_discount < 0.09) THEN 1.0 ELSE 0.0 END AS reward FROM lineitem GROUP BY 1")
def recombined_rewards(spark, sf_dir):
    checks = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("simulation_id"), (F.col("l_discount") < 0.09).cast("int").alias("reward"), (F.col("l_shipdate") > F.lit("2001-01-01").cast("timestamp_ntz")).alias("late"))
    return breakdown.recombined(checks, F.col("late"))


@query("""SELECT l_suppkey, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) AS first_mean, round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) AS second_mean,
  round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) - avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) AS difference FROM lineitem GROUP BY 1""")
def mode_difference(spark, sf_dir):
    return _rounded(breakdown.mode_difference(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_linestatus", "F", "O", F.col("l_quantity")))


@query("SELECT s_nationkey, count(*) AS n, count(DISTINCT s_acctbal > 0) = 1 AS same_settings FROM supplier GROUP BY 1 HAVING count(*) > 1")
def duplicate_domains(spark, sf_dir):
    return breakdown.homogeneous(_t(spark, sf_dir, "supplier").withColumn("rich", F.col("s_acctbal") > 0), "s_nationkey", "rich")


# --- reports -----------------------------------------------------------------------------------


@query("""SELECT model, domain, score FROM (SELECT o_custkey AS model, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p FROM orders GROUP BY 1)
UNPIVOT (score FOR domain IN (f, o, p))""")
def leaderboard_long(spark, sf_dir):
    best = lambda s: F.max(F.when(F.col("o_orderstatus") == s.upper(), F.col("o_totalprice"))).alias(s)
    wide = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("model")).agg(*map(best, "fop"))
    return wide.unpivot("model", list("fop"), "domain", "score").where("score is not null")


@query("""SELECT model, CASE WHEN count(score) >= 3 THEN round(avg(score), 6) END AS overall FROM (SELECT o_custkey AS model, o_orderstatus, max(o_totalprice) AS score FROM orders GROUP BY 1, 2) GROUP BY 1""")
def core_overall(spark, sf_dir):
    scores = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("model"), "o_orderstatus").agg(F.max("o_totalprice").alias("score"))
    return _rounded(leaderboard.overall(scores, needed=3))


@query("""WITH p AS (SELECT l_suppkey % 20 AS model, l_partkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY 1, 2),
m AS (SELECT model, count(*) AS tasks, avg(c / n) AS one, avg(CASE WHEN n >= 2 THEN c / n * greatest(c - 1, 0) / (n - 1) END) AS two FROM p GROUP BY 1)
SELECT model, round(one, 6) AS pass_1, round(two, 6) AS pass_2, round(CASE WHEN tasks >= 10 THEN two / one END, 6) AS consistency FROM m""")
def consistency(spark, sf_dir):
    per = _t(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("model"), "l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    hat = lambda k: F.avg(metrics.hat_k(F.col("c"), F.col("n"), k)).alias(f"pass_{k}")
    rows = per.groupBy("model").agg(F.count("*").alias("tasks"), hat(1), hat(2))
    steady = leaderboard.supported(leaderboard.consistency(F.col("pass_1"), F.col("pass_2")), F.col("tasks"))
    return _rounded(rows.select("model", "pass_1", "pass_2", steady.alias("consistency")))


@query("SELECT c_mktsegment AS model, c_custkey AS seq, c_acctbal AS score FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey DESC) AS n FROM customer) WHERE n = 1")
def last_submission(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("model"), F.col("c_custkey").alias("seq"), F.col("c_acctbal").alias("score"))
    return leaderboard.last_per_model(rows)


@query("SELECT l_partkey AS task_id, count(*) AS trials FROM lineitem GROUP BY 1 HAVING count(*) <> 30")
def trials_off_plan(spark, sf_dir):
    return trials(spark, sf_dir).groupBy("task_id").agg(F.count("*").alias("trials")).where("trials <> 30")


# --- retrieval ---------------------------------------------------------------------------------


@query("WITH " + _BM25.replace("q AS (SELECT token, count(*) AS times FROM (SELECT unnest(['the', 'that', 'der', 'the']) AS token) GROUP BY 1)", "q AS (SELECT * FROM (VALUES (1, 'der', 1), (1, 'und', 2), (2, 'the', 1)) v(query_id, token, times))")
       .replace("bm AS (SELECT doc_id,", "bm AS (SELECT query_id, doc_id,").replace("JOIN dl USING (doc_id) GROUP BY 1)", "JOIN dl USING (doc_id) GROUP BY 1, 2)") + " SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def bm25_batch(spark, sf_dir):
    asked = spark.createDataFrame([(1, "und DER und"), (2, "The"), (3, "")], "query_id int, query string")
    return _rounded(retrieval.Bm25Index.build(_t(spark, sf_dir, "documents")).search(asked))


@query("""SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, v.vec_id) AS n FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) WHERE n <= 5""")
def cosine_batch(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings")
    return _rounded(retrieval.cosine_batches(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5))


_NEAREST = """SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, v.vec_id) AS n FROM embeddings v, embeddings q WHERE {}) WHERE n <= 10"""


@query(_NEAREST.format("q.vec_id = 7"))
def indexed_search(spark, sf_dir):
    """The ten nearest to one vector, through the index of cells."""
    vectors = _t(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 7").first()["embedding"]
    found, _ = VectorIndex.build(vectors).search([float(x) for x in asked], 10)
    return _rounded(found.select(F.lit(7).cast("long").alias("query_id"), "vec_id", "score"))


@query(_NEAREST.format("q.vec_id % 100 = 0"))
def indexed_batch(spark, sf_dir):
    """The ten nearest to every vector whose id is divisible by 100, through the index of cells."""
    vectors = _t(spark, sf_dir, "embeddings")
    return _rounded(VectorIndex.build(vectors).batch(vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10))


@query("SELECT doc_id, score FROM (SELECT doc_id, least(greatest(CAST(n_chars % 14 - 2 AS DOUBLE), 0), 10) AS score FROM documents) WHERE score >= 7 ORDER BY score DESC, doc_id LIMIT 20")
def rating_rerank(spark, sf_dir):
    return retrieval.rerank(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars") % 14 - 2, 7.0, 20).select("doc_id", "score")


# --- scalar functions --------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round((l_quantity + l_linenumber) * 3 / 4 - 1, 2) AS result FROM lineitem")
def calculations(spark, sf_dir):
    written = F.format_string("(%d + %d) * 3 / 4 - -(-1)", F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arithmetic.calculated(written).alias("result"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN round(o_totalprice, 2) END AS amount FROM orders")
def money_texts(spark, sf_dir):
    written = F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.amount(written).alias("amount"))


@query("SELECT o_orderkey, last_day(o_orderdate) AS cycle_end, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_start, last_day(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) AS next_end FROM orders")
def billing_cycles(spark, sf_dir):
    start, end = dates.next_month(F.col("o_orderdate"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", dates.cycle_end(F.col("o_orderdate")).alias("cycle_end"), start.alias("next_start"), end.alias("next_end"))


@query("SELECT event_id, concat('{\"k\": ', json_extract_string(props, '$.k'), '}') AS body, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def fenced_json(spark, sf_dir):
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\ndone"))).otherwise(F.col("props"))
    body = text.fenced_json(answer)
    return _t(spark, sf_dir, "events").select("event_id", body.alias("body"), F.get_json_object(body, "$.k").cast("int").alias("k"))
