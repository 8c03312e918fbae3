"""Quotas, retention, logs, queues and schedules."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions.schedule import occurrence_table
from granary.operators import control as K
from granary.registry import query
from granary.sources.bindings import SAMPLES_SQL, table, volume_samples

NOW = "2024-01-20 12:00:00"

#: Quota records from customers.
QUOTAS_SQL = """WITH quota AS (SELECT c_custkey AS id, c_mktsegment AS principal_namespace, c_nationkey::BIGINT AS principal_uid, 'volume' AS scope_kind, 'v' || (c_custkey % 3) AS scope_id, 'space' AS metric,
  ['system_imported', 'advisory', 'unknown', 'manual'][c_custkey % 4 + 1] AS origin, ['known', 'unlimited', 'unknown'][c_custkey % 3 + 1] AS limit_state,
  CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 40) * 1000 END AS limit_bytes, TIMESTAMP '2024-01-01' + to_hours((c_custkey % 24)::BIGINT) AS observed_at,
  CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2024-01-20 11:00:00' + to_minutes((c_custkey % 120)::BIGINT) END AS expires_at, 'p' || (c_custkey % 2) AS provider_label FROM customer),
flagged AS (SELECT *, coalesce(expires_at <= TIMESTAMP '2024-01-20 12:00:00', false) AS stale FROM quota) """


def quota_records(spark, sf):
    i = F.col("c_custkey")
    start, expiry = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-20 11:00:00").cast("timestamp")
    return table(spark, sf, "customer").select(
        i.alias("id"), F.col("c_mktsegment").alias("principal_namespace"), F.col("c_nationkey").cast("long").alias("principal_uid"), F.lit("volume").alias("scope_kind"),
        F.concat(F.lit("v"), (i % 3).cast("string")).alias("scope_id"), F.lit("space").alias("metric"),
        F.element_at(F.array(*map(F.lit, ("system_imported", "advisory", "unknown", "manual"))), (i % 4 + 1).cast("int")).alias("origin"),
        F.element_at(F.array(*map(F.lit, ("known", "unlimited", "unknown"))), (i % 3 + 1).cast("int")).alias("limit_state"),
        F.when(i % 3 == 0, (i % 40) * 1000).alias("limit_bytes"), (start + F.make_interval(hours=(i % 24).cast("int"))).alias("observed_at"),
        F.when(i % 5 != 0, expiry + F.make_interval(mins=(i % 120).cast("int"))).alias("expires_at"), F.concat(F.lit("p"), (i % 2).cast("string")).alias("provider_label"),
    )


@query("q1_effective_quota", QUOTAS_SQL + """SELECT principal_namespace, principal_uid, scope_id, id, origin, stale FROM flagged
QUALIFY row_number() OVER (PARTITION BY principal_namespace, principal_uid, scope_kind, scope_id, metric ORDER BY stale, observed_at DESC, CASE origin WHEN 'system_imported' THEN 0 WHEN 'advisory' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, id DESC) = 1""")
def q1(spark, sf):
    return K.effective_quotas(quota_records(spark, sf), NOW).select("principal_namespace", "principal_uid", "scope_id", "id", "origin", "stale")


@query("q2_stale_flag", QUOTAS_SQL + "SELECT stale, count(*) AS n FROM flagged GROUP BY 1")
def q2(spark, sf):
    return quota_records(spark, sf).groupBy(K.stale(NOW, F.col("expires_at")).alias("stale")).agg(F.count(F.lit(1)).alias("n"))


@query("q3_import_checks", QUOTAS_SQL + """, problems AS (
SELECT 'zero_limit' AS problem, 'warning' AS severity FROM flagged WHERE limit_state = 'known' AND limit_bytes = 0 UNION ALL
SELECT 'limit_bytes', 'error' FROM flagged WHERE (limit_state = 'known') <> (limit_bytes IS NOT NULL) UNION ALL SELECT 'stale_in_file', 'warning' FROM flagged WHERE stale UNION ALL
SELECT 'unknown_scope', 'error' FROM flagged WHERE scope_id = 'v2' UNION ALL
SELECT 'conflicting_display_name', 'warning' FROM flagged GROUP BY principal_namespace, principal_uid HAVING count(DISTINCT provider_label) > 1)
SELECT problem, severity, count(*) AS n FROM problems GROUP BY 1, 2""")
def q3(spark, sf):
    scopes = spark.createDataFrame([("v0",), ("v1",)], "scope_id string")
    return K.import_problems(quota_records(spark, sf), scopes, NOW).groupBy("problem", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("q4_import_summary", QUOTAS_SQL + "SELECT count(*) FILTER (id % 2 = 0) AS added, count(*) FILTER (id % 2 = 1) AS updated FROM quota")
def q4(spark, sf):
    q = quota_records(spark, sf)
    return K.import_summary(q, q.filter("id % 2 = 1"), ["id"])


@query("j14_identity_names", QUOTAS_SQL + "SELECT id, CASE WHEN principal_uid < 10 THEN 'user' || principal_uid ELSE 'uid:' || principal_uid END AS owner_name FROM quota")
def j14(spark, sf):
    names = spark.range(10).select(F.lit("posix").alias("namespace"), F.col("id").alias("uid"), F.concat(F.lit("user"), F.col("id").cast("string")).alias("display_name"))
    return K.display_owner(quota_records(spark, sf).select("id", F.col("principal_uid").alias("uid")), names, "posix").select("id", "owner_name")


#: Reports from orders: a profile for each customer.
REPORTS_SQL = "WITH reports AS (SELECT o_orderkey AS id, o_custkey AS profile_id, o_orderdate AS created_at, o_orderkey % 17 = 0 AS pinned, o_orderkey % 19 = 0 AS detail_pinned, o_orderkey % 3 <> 0 AS detail_available FROM orders) "


def reports(spark, sf):
    i = F.col("o_orderkey")
    return table(spark, sf, "orders").select(i.alias("id"), F.col("o_custkey").alias("profile_id"), F.col("o_orderdate").alias("created_at"), (i % 17 == 0).alias("pinned"), (i % 19 == 0).alias("detail_pinned"), (i % 3 != 0).alias("detail_available"))


@query("k4_retention_plan", REPORTS_SQL + """, a AS (SELECT id FROM reports WHERE NOT pinned QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, id DESC) > 5),
b AS (SELECT id FROM reports WHERE detail_available AND NOT detail_pinned AND NOT pinned QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, id DESC) > 2)
SELECT id, profile_id, id IN (FROM a) AS remove_report, id IN (FROM b) AS remove_detail FROM reports""")
def k4(spark, sf):
    return K.retention_plan(reports(spark, sf), 5, 2)


@query("w6_keep_newest", REPORTS_SQL + "SELECT id FROM reports WHERE NOT pinned QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, id DESC) > 3")
def w6(spark, sf):
    return K.beyond_newest(reports(spark, sf), 3, F.col("pinned")).select("id")


@query("s10_report_listing", REPORTS_SQL + "SELECT id, profile_id FROM reports WHERE detail_available AND (created_at, id) < (TIMESTAMP '1997-01-01', 100) ORDER BY created_at DESC, id DESC LIMIT 50")
def s10(spark, sf):
    return K.listing(reports(spark, sf), {"detail_available": True, "profile_id": None}, ("1997-01-01 00:00:00", 100)).select("id", "profile_id")


def job_events(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("sequence"), F.col("role").alias("type"))


_EVENTS = "WITH ev AS (SELECT conv_id AS job_id, turn AS sequence, role AS type FROM conversations) "


@query("w7_latest_events", _EVENTS + "SELECT job_id, sequence, type FROM ev QUALIFY sequence > max(sequence) OVER (PARTITION BY job_id) - 3")
def w7(spark, sf):
    return K.latest_events(job_events(spark, sf), 3)


@query("e1_events_after", _EVENTS + "SELECT job_id, sequence, type FROM ev WHERE job_id = 1 AND sequence > 0 ORDER BY sequence LIMIT 1000")
def e1(spark, sf):
    return K.events_after(job_events(spark, sf), 1, 0)


@query("a18_next_sequence", _EVENTS + "SELECT job_id, max(sequence) + 1 AS next_sequence FROM ev GROUP BY 1")
def a18(spark, sf):
    return K.next_sequence(job_events(spark, sf))


#: Jobs from orders.
_JOBS = "WITH jobs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'QUEUED' ELSE 'RUNNING' END AS state, o_orderdate AS created_at FROM orders) "


def jobs(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("RUNNING")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), state.alias("state"), F.col("o_orderdate").alias("created_at"))


@query("a15_job_counts", _JOBS + "SELECT count(*) FILTER (state = 'QUEUED') AS queued, count(*) FILTER (state = 'RUNNING') AS running FROM jobs")
def a15(spark, sf):
    return K.counts_by_state(jobs(spark, sf), ("QUEUED", "RUNNING"))


@query("s13_queue_head", _JOBS + "SELECT id, state FROM jobs WHERE state = 'QUEUED' ORDER BY created_at, id LIMIT 1")
def s13(spark, sf):
    return K.queue_head(jobs(spark, sf)).select("id", "state")


@query("k6_interrupted", _JOBS + "SELECT CASE WHEN state = 'RUNNING' THEN 'INTERRUPTED' ELSE state END AS state, count(*) AS n FROM jobs GROUP BY 1")
def k6(spark, sf):
    return K.recover_interrupted(jobs(spark, sf)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("k1_transitions", """WITH steps AS (SELECT ['QUEUED', 'RUNNING', 'PAUSING', 'PAUSED', 'CANCELLING', 'CANCELLED', 'SUCCEEDED', 'PARTIAL', 'FAILED', 'INTERRUPTED'][event_id % 10 + 1] AS b, user_id, event_id FROM events),
moves AS (SELECT lag(b) OVER (PARTITION BY user_id ORDER BY event_id) AS a, b FROM steps)
SELECT a, b, count(*) AS n, (a = 'QUEUED' AND b IN ('RUNNING', 'CANCELLING')) OR (a = 'RUNNING' AND b IN ('PAUSING', 'SUCCEEDED', 'PARTIAL', 'FAILED', 'CANCELLING')) OR (a = 'PAUSED' AND b IN ('RUNNING', 'CANCELLING')) OR (a = 'PAUSING' AND b IN ('PAUSED', 'CANCELLING')) OR (a = 'CANCELLING' AND b = 'CANCELLED') AS legal
FROM moves WHERE a IS NOT NULL GROUP BY 1, 2""")
def k1(spark, sf):
    """What a log of states holds: each move from one state of a job to the next, and whether it is a legal one."""
    states = ("QUEUED", "RUNNING", "PAUSING", "PAUSED", "CANCELLING", "CANCELLED", "SUCCEEDED", "PARTIAL", "FAILED", "INTERRUPTED")
    steps = table(spark, sf, "events").select("user_id", "event_id", F.element_at(F.array(*map(F.lit, states)), (F.col("event_id") % 10 + 1).cast("int")).alias("b"))
    moves = steps.withColumn("a", F.lag("b").over(Window.partitionBy("user_id").orderBy("event_id"))).filter(F.col("a").isNotNull())
    return moves.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("legal", K.legal(F.col("a"), F.col("b")))


@query("j8_due_purges", """WITH items AS (SELECT o_orderkey AS item_id, o_custkey AS plan_id, o_orderdate AS quarantined_at FROM orders), plans AS (SELECT c_custkey AS plan_id, c_nationkey AS source_id FROM customer),
taken AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'O' THEN o_custkey + 1 ELSE o_custkey END AS plan_id FROM orders WHERE o_orderstatus <> 'P')
SELECT item_id, plan_id FROM items JOIN plans USING (plan_id) JOIN nation ON source_id = n_nationkey WHERE quarantined_at <= TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.item_id = items.item_id AND t.plan_id = items.plan_id) ORDER BY quarantined_at, item_id LIMIT 100""")
def j8(spark, sf):
    """Jobs have taken the items of one status; those of another name the item under a plan that is not its own, and so do not count."""
    orders = table(spark, sf, "orders")
    items = orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("plan_id"), F.col("o_orderdate").alias("quarantined_at"))
    plans = table(spark, sf, "customer").select(F.col("c_custkey").alias("plan_id"), F.col("c_nationkey").alias("source_id"))
    plan = F.col("o_custkey") + F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    taken = orders.filter("o_orderstatus <> 'P'").select(F.format_string('{"item_id": %d, "plan_id": %d}', "o_orderkey", plan).alias("params_json"))
    sources = table(spark, sf, "nation").select(F.col("n_nationkey").alias("source_id"))
    return K.due_purges(items, plans, sources, taken, "1996-01-01 00:00:00").select("item_id", "plan_id")


@query("u5_upsert", QUOTAS_SQL + "SELECT id, CASE WHEN id % 4 = 0 THEN 'new' ELSE origin END AS origin FROM quota")
def u5(spark, sf):
    q = quota_records(spark, sf).select("id", "origin")
    return K.upsert(q, q.filter("id % 4 = 0").withColumn("origin", F.lit("new")), ["id"])


@query("u5_insert_or_ignore", "SELECT l_orderkey, min(l_linenumber)::INT AS l_linenumber FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1 UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 3 = 0")
def u5_ignore(spark, sf):
    # orders that are there already keep their row
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    there = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(-1).alias("l_linenumber"))
    return K.insert_or_ignore(there, li, ["l_orderkey"], "l_linenumber")


@query("i8_error_log", SAMPLES_SQL + "SELECT event_id AS error_id FROM volume_samples WHERE quality = 'error' ORDER BY event_id LIMIT 10000")
def i8(spark, sf):
    return K.error_log(volume_samples(spark, sf).filter("quality = 'error'").select(F.col("event_id").alias("error_id")))[0]


@query("k7_profile_sources", "SELECT o_orderkey AS source_id FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01'")
def k7(spark, sf):
    sources = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return K.profile_sources({"sources": "all", "created_at": "1996-01-01 00:00:00"}, sources).select("source_id")


@query("f28_planned_order", """SELECT event_id, row_number() OVER (ORDER BY coalesce(planned_at, planned_local_at) DESC, occurrence_key DESC) AS place FROM (
  SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M') END AS planned_at, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M') AS planned_local_at, strftime(ts, '%Y-%m-%dT%H:%M') || '#' || event_id AS occurrence_key FROM events WHERE user_id = 1) ORDER BY place LIMIT 1000""")
def f28(spark, sf):
    minute = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm")
    e = table(spark, sf, "events").filter("user_id = 1")
    e = e.select("event_id", F.when(F.col("event_id") % 4 != 0, minute("ts")).alias("planned_at"), minute(F.col("ts") + F.expr("interval 1 hour")).alias("planned_local_at"), F.concat_ws("#", minute("ts"), F.col("event_id").cast("string")).alias("occurrence_key"))
    return K.occurrence_listing(e, 1000).select("event_id", "place")


@query("e4_cron_minutes", "SELECT s_suppkey::VARCHAR AS profile_id, strftime(d, '%Y-%m-%dT%H:%M') AS occurrence_key FROM supplier, (SELECT unnest(generate_series(TIMESTAMP '2024-02-01 12:00:00', TIMESTAMP '2024-02-20 12:00:00', INTERVAL 5 MINUTE)) AS d) WHERE dayofweek(d) IN (1, 3) AND hour(d) IN (s_nationkey % 24, (s_nationkey + 1) % 24) AND minute(d) % 15 = 5 * (s_suppkey % 3) AND d > TIMESTAMP '2024-02-01 12:00:00'")
def e4(spark, sf):
    """A schedule for each supplier, of steps, a list of hours and names of weekdays."""
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    text = lambda c: c.cast("string")
    cron = F.concat(text(5 * (k % 3)), F.lit("-59/15 "), text(n % 24), F.lit(","), text((n + 1) % 24), F.lit(" * feb mon,wed"))
    profiles = table(spark, sf, "supplier").select(text(k).alias("profile_id"), cron.alias("cron"), F.lit("UTC").alias("zone"))
    return occurrence_table(profiles, datetime(2024, 2, 1, 12, tzinfo=UTC), datetime(2024, 2, 20, 12, tzinfo=UTC)).select("profile_id", "occurrence_key")


@query("e2_schedule_expansion", """SELECT c_custkey::VARCHAR AS profile_id, strftime(d, '%Y-%m-%dT') || lpad((c_custkey % 24)::VARCHAR, 2, '0') || ':' || lpad((c_custkey % 60)::VARCHAR, 2, '0') AS occurrence_key, d = DATE '2024-03-31' AND c_custkey % 24 = 2 AS skipped_nonexistent
FROM customer, (SELECT unnest(generate_series(DATE '2024-03-25', DATE '2024-04-05', INTERVAL 1 DAY)) AS d)""")
def e2(spark, sf):
    """A daily schedule for each customer, over the night in which an hour is missing."""
    k = F.col("c_custkey")
    cron = F.concat_ws(" ", (k % 60).cast("string"), (k % 24).cast("string"), F.lit("* * *"))
    profiles = table(spark, sf, "customer").select(k.cast("string").alias("profile_id"), cron.alias("cron"), F.lit("Europe/Berlin").alias("zone"))
    t = occurrence_table(profiles, datetime(2024, 3, 24, 22, 59, tzinfo=UTC), datetime(2024, 4, 5, 21, 59, tzinfo=UTC))
    return t.select("profile_id", "occurrence_key", "skipped_nonexistent")


@query("w9_first_occurrences", "SELECT user_id AS profile_id, strftime(ts, '%Y-%m-%dT%H:%M') AS occurrence_key, min(ts) AS planned_at FROM events GROUP BY 1, 2")
def w9(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("profile_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("occurrence_key"), F.col("ts").alias("planned_at"))
    return K.first_occurrences(e)


@query("e3_misfires", "SELECT user_id AS profile_id, max(ts) AS planned_at FROM events WHERE ts <= TIMESTAMP '2024-01-10 12:00:00' GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-10 06:00:00'")
def e3(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("profile_id"), F.col("ts").cast("timestamp").alias("planned_at"), F.lit(False).alias("skipped_nonexistent"))
    return K.misfires(e, "2024-01-10 12:00:00").withColumn("planned_at", F.col("planned_at").cast("timestamp_ntz"))


@query("e5_outbox_claim", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def e5(spark, sf):
    box = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("sent").alias("state"), F.col("o_orderdate").cast("timestamp").alias("next_attempt_at"), F.lit(None).cast("timestamp").alias("lease_until"))
    return K.outbox_claim(box, "1998-01-01 00:00:00").select("id")
