"""Tenant-scoped relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.operators import relational as op
from harrow.plans.registry import query
from harrow.plans.tables import NOW, SQL_NOW, applications, jobs, read, sql, staff

ORG = 7
KEY = ["job_id", "line", "candidate_id", "source_id"]


@query("SRC1_table_read", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= DATE '1996-01-01'")
def table_read(s: SparkSession, d: str) -> DataFrame:
    """A parameterised read: named markers instead of placeholders in the text."""
    return s.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_orderdate >= CAST(:since AS DATE)", {"status": "P", "since": "1996-01-01"}, orders=read(s, d, "orders"))


@query("SRC2_first_row", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC LIMIT 1")
def first_row(s, d):
    return read(s, d, "orders").where("o_custkey = 7").orderBy(F.desc_nulls_first("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey", "o_orderdate")


@query("FLT1_tenant_scope", sql(f"SELECT job_id, posted_on FROM jobs WHERE org_id = {ORG}"))
def tenant_scope(s, d):
    return op.scoped(jobs(s, d), ORG).select("job_id", "posted_on")


@query("FLT2_optional_filters", sql(f"SELECT job_id, line, candidate_id, source_id, score FROM applications WHERE outcome IN ('A', 'R') AND stage = 'F'"))
def optional_filters(s, d):
    return op.filtered(applications(s, d), outcome=["A", "R"], stage="F", candidate_id=None).select(*KEY, "score")


@query("FLT3_enabled_or_unknown", "SELECT p_partkey FROM part WHERE (CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END) IS NULL OR p_size % 3 = 1")
def enabled_or_unknown(s, d):
    flagged = read(s, d, "part").withColumn("enabled", F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3 == 1))
    return flagged.where(op.enabled("enabled")).select("p_partkey")


@query("FLT4_default_status", "SELECT c_custkey FROM customer WHERE coalesce(nullif(c_mktsegment, 'BUILDING'), 'active') = 'active'")
def default_status(s, d):
    return read(s, d, "customer").where(F.coalesce(F.expr("nullif(c_mktsegment, 'BUILDING')"), F.lit("active")) == "active").select("c_custkey")


@query("FLT5_folded_key", "SELECT c_custkey FROM customer WHERE lower(trim(c_name)) = 'customer#000000042'")
def folded_key(s, d):
    return read(s, d, "customer").where(op.email_key("c_name") == "customer#000000042").select("c_custkey")


@query("FLT6_prefixes", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO%' AND p_brand NOT LIKE 'Brand#1%'")
def prefixes(s, d):
    return read(s, d, "part").where(F.col("p_type").startswith("PROMO") & ~F.col("p_brand").like("Brand#1%")).select("p_partkey", "p_type")


@query("FLT7_guarded_cast", "SELECT c_custkey, CAST(substr(c_name, 10) AS BIGINT) AS suffix FROM customer WHERE regexp_matches(substr(c_name, 10), '^[0-9]+$')")
def guarded_cast(s, d):
    suffix = F.substr("c_name", F.lit(10))
    return read(s, d, "customer").where(suffix.rlike("^[0-9]+$")).select("c_custkey", suffix.try_cast("bigint").alias("suffix"))


@query("FLT8_membership", "SELECT event_id FROM events WHERE event_type IN ('signup', 'purchase')")
def membership(s, d):
    return read(s, d, "events").where(F.col("event_type").isin("signup", "purchase")).select("event_id")


@query("FLT9_existence", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def existence(s, d):
    return read(s, d, "customer").join(read(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("FLT10_recent", f"SELECT event_id FROM events WHERE ts > {SQL_NOW} - INTERVAL 36 HOUR")
def recent(s, d):
    return read(s, d, "events").where(op.since("ts", NOW, days=1, hours=12)).select("event_id")


SESSIONS_SQL = "sessions AS (SELECT user_id * 100000000 + CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS session_id, min(ts) AS started_at, count(*) AS n_events, bool_or(event_type = 'error') AS failed, list({'name': event_type, 'ms': CAST(round(value * 100) AS BIGINT), 'id': event_id} ORDER BY event_id) AS events FROM events GROUP BY ALL)"


def sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of a user and date, with their events nested: (name, ms, id). One user's events of one day have to fit a row."""
    rows = read(s, d, "events").select((F.col("user_id") * 100_000_000 + F.date_format("ts", "yyyyMMdd").cast("long")).alias("session_id"), "ts", F.col("event_type").alias("name"), F.round(F.col("value") * 100).cast("long").alias("ms"), F.col("event_id").alias("id"))
    event = F.struct("id", "name", "ms")
    return rows.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.count("*").alias("n_events"), F.bool_or(F.col("name") == "error").alias("failed"), F.sort_array(F.collect_list(event)).alias("events"))


@query("FLT11_session_filter", f"WITH {SESSIONS_SQL} SELECT session_id, started_at, n_events FROM sessions WHERE failed AND len(list_filter(events, lambda e: contains(e.name, 'urch'))) > 0 AND started_at >= TIMESTAMP '2024-01-10' ORDER BY started_at DESC, session_id LIMIT 50")
def session_filter(s, d):
    hit = F.exists("events", lambda e: F.contains(F.lower(e["name"]), F.lit("urch")))
    return sessions(s, d).where(F.col("failed") & hit & (F.col("started_at") >= F.lit("2024-01-10").cast("timestamp_ntz"))).orderBy(F.desc("started_at"), "session_id").limit(50).select("session_id", "started_at", "n_events")


@query("FLT12_disjunctive_scope", sql(f"SELECT event_id FROM events WHERE (event_type = 'view' AND user_id IN (SELECT staff_id FROM staff WHERE org_id = {ORG})) OR (event_type = 'click' AND user_id IN (SELECT p_partkey FROM part WHERE p_size < 10))"))
def disjunctive_scope(s, d):
    return s.sql("SELECT event_id FROM {e} WHERE (event_type = 'view' AND user_id IN (SELECT staff_id FROM {h} WHERE org_id = :org)) OR (event_type = 'click' AND user_id IN (SELECT p_partkey FROM {p} WHERE p_size < 10))", {"org": ORG}, e=read(s, d, "events"), h=staff(s, d), p=read(s, d, "part"))


@query("PRJ1_joined_alias", sql("SELECT j.*, staff_name AS poster FROM jobs j JOIN staff ON posted_by = staff_id WHERE status = 'P'"))
def joined_alias(s, d):
    return jobs(s, d).where("status = 'P'").alias("j").join(staff(s, d).select(F.col("staff_id").alias("posted_by"), F.col("staff_name").alias("poster")), "posted_by").select("j.*", "poster")


@query("PRJ2_flag", "SELECT p_partkey, CASE WHEN nullif(p_size, 1) IS NOT NULL OR nullif(p_brand, 'Brand#11') IS NOT NULL THEN 1 ELSE 0 END AS has_profile FROM part")
def flag(s, d):
    known = F.expr("nullif(p_size, 1)").isNotNull() | F.expr("nullif(p_brand, 'Brand#11')").isNotNull()
    return read(s, d, "part").select("p_partkey", F.when(known, 1).otherwise(0).alias("has_profile"))


MATCHES_SQL = "matches AS (SELECT l_orderkey AS job_id, l_partkey AS candidate_id, max(l_suppkey % 101) AS match_score FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)"


def matches(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("candidate_id")).agg(F.max(F.col("l_suppkey") % 101).alias("match_score"))


@query("PRJ3_score_precedence", sql(f", {MATCHES_SQL} SELECT a.job_id, a.line, a.candidate_id, a.source_id, coalesce(m.match_score, a.score) AS effective_score FROM applications a LEFT JOIN matches m USING (job_id, candidate_id)"))
def score_precedence(s, d):
    return applications(s, d).join(matches(s, d), ["job_id", "candidate_id"], "left").select(*KEY, F.coalesce("match_score", F.col("score").cast("long")).alias("effective_score"))


@query("PRJ4_clamp", "SELECT c_custkey, least(greatest(coalesce(nullif(c_acctbal, 0), 0), 0), 100) AS clamped FROM customer")
def clamp(s, d):
    return read(s, d, "customer").select("c_custkey", F.least(F.greatest(F.coalesce(F.expr("nullif(c_acctbal, 0)"), F.lit(0.0)), F.lit(0.0)), F.lit(100.0)).alias("clamped"))


@query("PRJ5_nested_children", sql("SELECT job_id, count(*) AS n_applications, string_agg(candidate_id || ':' || score, ',' ORDER BY line, candidate_id, source_id, score) AS applicants FROM applications GROUP BY job_id"))
def nested_children(s, d):
    """Child rows as a nested list in one pass, where row-by-row reads would ask once per parent."""
    child = F.struct("line", "candidate_id", "source_id", "score")
    nested = applications(s, d).groupBy("job_id").agg(F.sort_array(F.collect_list(child)).alias("children"))
    return nested.select("job_id", F.size("children").cast("long").alias("n_applications"), F.array_join(F.transform("children", lambda c: F.concat(c["candidate_id"], F.lit(":"), c["score"])), ",").alias("applicants"))


@query("PRJ6_api_names", sql("SELECT job_id AS \"jobId\", posted_by AS \"postedBy\", posted_on AS \"postedOn\", org_id AS \"organizationId\" FROM jobs"))
def api_names(s, d):
    return jobs(s, d).withColumnsRenamed({"job_id": "jobId", "posted_by": "postedBy", "posted_on": "postedOn", "org_id": "organizationId"}).select("jobId", "postedBy", "postedOn", "organizationId")


@query("JN1_tenant_join", sql(f"SELECT a.job_id, a.line, a.candidate_id, a.source_id FROM applications a JOIN jobs j ON a.job_id = j.job_id AND j.org_id = {ORG}"))
def tenant_join(s, d):
    return applications(s, d).join(op.scoped(jobs(s, d), ORG).select("job_id"), "job_id").select(*KEY)


@query("JN2_dimension_lookup", sql("SELECT s.staff_id, n_name AS org_name FROM staff s LEFT JOIN nation ON org_id = n_nationkey AND n_regionkey = 1"))
def dimension_lookup(s, d):
    dim = read(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("org_name"))
    return staff(s, d).join(dim, "org_id", "left").select("staff_id", "org_name")


@query("JN3_snowflake", sql(f", {MATCHES_SQL} SELECT a.job_id, a.line, a.candidate_id, a.source_id, p_name AS candidate, m.match_score, s.staff_name FROM applications a LEFT JOIN matches m ON m.job_id = a.job_id AND m.candidate_id = a.candidate_id LEFT JOIN part ON p_partkey = a.candidate_id AND p_size > 25 JOIN jobs j ON j.job_id = a.job_id JOIN staff s ON s.staff_id = j.posted_by WHERE j.org_id = {ORG}"))
def snowflake(s, d):
    people = read(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("candidate"))
    scope = op.scoped(jobs(s, d), ORG).join(staff(s, d).select(F.col("staff_id").alias("posted_by"), "staff_name"), "posted_by").select("job_id", "staff_name")
    return applications(s, d).join(scope, "job_id").join(matches(s, d), ["job_id", "candidate_id"], "left").join(people, "candidate_id", "left").select(*KEY, "candidate", "match_score", "staff_name")


@query("JN4_counted_children", sql("SELECT j.job_id, s.staff_name, n_name AS org_name, r_name AS region, (SELECT count(*) FROM applications a WHERE a.job_id = j.job_id) AS n_applications FROM jobs j JOIN staff s ON s.staff_id = j.posted_by JOIN nation ON n_nationkey = j.org_id JOIN region ON r_regionkey = n_regionkey"))
def counted_children(s, d):
    counts = applications(s, d).groupBy("job_id").agg(F.count("*").alias("n"))
    places = read(s, d, "nation").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("org_name"), F.col("r_name").alias("region"))
    named = jobs(s, d).join(staff(s, d).select(F.col("staff_id").alias("posted_by"), "staff_name"), "posted_by").join(places, "org_id")
    return named.join(counts, "job_id", "left").select("job_id", "staff_name", "org_name", "region", F.coalesce("n", F.lit(0)).alias("n_applications"))


@query("JN5_lateral_latest", sql("SELECT j.job_id, x.candidate_id, x.applied_at FROM jobs j LEFT JOIN LATERAL (SELECT candidate_id, applied_at FROM applications a WHERE a.job_id = j.job_id ORDER BY applied_at DESC, line DESC, candidate_id DESC, source_id DESC LIMIT 1) x ON TRUE"))
def lateral_latest(s, d):
    newest = op.latest_per_key(applications(s, d), ["job_id"], [F.desc("applied_at"), F.desc("line"), F.desc("candidate_id"), F.desc("source_id")])
    return jobs(s, d).join(newest.select("job_id", "candidate_id", "applied_at"), "job_id", "left").select("job_id", "candidate_id", "applied_at")


@query("JN6_last_by_kind", "SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'click') AS last_click, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'view') AS last_view, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'error') AS last_error, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'signup') AS last_signup FROM events GROUP BY user_id")
def last_by_kind(s, d):
    kinds = ("click", "view", "error", "signup")
    return read(s, d, "events").groupBy("user_id").agg(*[F.max_by(F.when(F.col("event_type") == k, F.col("event_id")), F.when(F.col("event_type") == k, F.struct("ts", "event_id"))).alias(f"last_{k}") for k in kinds])


@query("JN7_two_counts", sql("SELECT j.job_id, (SELECT count(*) FROM applications a WHERE a.job_id = j.job_id) AS applied, (SELECT count(*) FROM applications a WHERE a.job_id = j.job_id AND a.shortlisted) AS shortlisted FROM jobs j"))
def two_counts(s, d):
    counts = applications(s, d).groupBy("job_id").agg(F.count("*").alias("a"), F.count_if("shortlisted").alias("b"))
    return jobs(s, d).join(counts, "job_id", "left").select("job_id", F.coalesce("a", F.lit(0)).alias("applied"), F.coalesce("b", F.lit(0)).alias("shortlisted"))


@query("JN8_semi", sql("SELECT DISTINCT candidate_id FROM applications WHERE job_id IN (SELECT job_id FROM jobs WHERE status = 'P')"))
def semi(s, d):
    return applications(s, d).join(jobs(s, d).where("status = 'P'"), "job_id", "left_semi").select("candidate_id").distinct()


@query("JN9_visible", sql(f"SELECT candidate_id, count(*) AS n FROM applications a WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = a.job_id AND j.org_id = {ORG}) OR EXISTS (SELECT 1 FROM part WHERE p_partkey = a.candidate_id AND p_size = 1) GROUP BY candidate_id"))
def visible(s, d):
    return s.sql("SELECT candidate_id, count(*) AS n FROM {a} a WHERE EXISTS (SELECT 1 FROM {j} j WHERE j.job_id = a.job_id AND j.org_id = :org) OR EXISTS (SELECT 1 FROM {p} WHERE p_partkey = a.candidate_id AND p_size = 1) GROUP BY candidate_id", {"org": ORG}, a=applications(s, d), j=jobs(s, d), p=read(s, d, "part"))


@query("JN10_missing_stubs", sql("SELECT job_id, 'parsed' AS outcome FROM (SELECT DISTINCT job_id FROM applications) UNION ALL SELECT job_id, 'missing' FROM jobs WHERE job_id NOT IN (SELECT job_id FROM applications)"))
def missing_stubs(s, d):
    found = applications(s, d).select("job_id").distinct().withColumn("outcome", F.lit("parsed"))
    return op.anti_with_stubs(jobs(s, d), found, "job_id", outcome=F.lit("missing"))


@query("JN11_update_from", sql("SELECT a.job_id, a.line, a.candidate_id, a.source_id, CASE WHEN j.status = 'F' THEN 'closed' ELSE a.stage END AS stage FROM applications a LEFT JOIN jobs j USING (job_id)"))
def update_from(s, d):
    return applications(s, d).join(jobs(s, d).select("job_id", "status"), "job_id", "left").select(*KEY, F.when(F.col("status") == "F", "closed").otherwise(F.col("stage")).alias("stage"))


@query("JN12_status_merge", "WITH catalog(provider) AS (VALUES ('click'), ('view'), ('webhook')), configured(provider, active) AS (VALUES ('view', true), ('sftp', false)), seen AS (SELECT event_type AS provider, count(*) AS n FROM events GROUP BY ALL) SELECT provider, catalog.provider IS NOT NULL AS known, coalesce(active, false) AS active, coalesce(n, 0) AS n FROM catalog FULL JOIN configured USING (provider) FULL JOIN seen USING (provider)")
def status_merge(s, d):
    catalog = s.createDataFrame([("click",), ("view",), ("webhook",)], "provider string").withColumn("known", F.lit(True))
    configured = s.createDataFrame([("view", True), ("sftp", False)], "provider string, active boolean")
    seen = read(s, d, "events").groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("n"))
    return catalog.join(configured, "provider", "full").join(seen, "provider", "full").select("provider", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("active", F.lit(False)).alias("active"), F.coalesce("n", F.lit(0)).alias("n"))


@query("JN13_free_slots", "WITH slots AS (SELECT u AS staff, day + to_hours(h) AS start, day + to_hours(h + 1) AS \"end\" FROM (SELECT DISTINCT user_id AS u, CAST(ts AS DATE) AS day FROM events) CROSS JOIN (SELECT unnest(range(10, 17)) AS h) WHERE isodow(day) < 6), busy AS (SELECT user_id AS staff, ts AS start, ts + INTERVAL 45 MINUTE AS \"end\" FROM events) SELECT staff, start, \"end\" FROM slots s WHERE NOT EXISTS (SELECT 1 FROM busy b WHERE b.staff = s.staff AND s.start < b.\"end\" AND s.\"end\" > b.start)")
def free_slots(s, d):
    events = read(s, d, "events").select(F.col("user_id").alias("staff"), "ts")
    busy = events.select("staff", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 45 minutes")).alias("end"))
    slots = op.slot_grid(events.select("staff", F.to_date("ts").alias("day")).distinct(), "day").select("staff", "start", "end")
    return op.free_slots(slots, busy, ["staff"])


@query("AG1_executive_counters", sql("SELECT org_id, (SELECT count(*) FROM staff s WHERE s.org_id = o.org_id AND role = 'BUILDING') AS admins, candidates, jobs, active, applications, shortlisted FROM (SELECT j.org_id, count(DISTINCT candidate_id) AS candidates, count(DISTINCT j.job_id) AS jobs, count(DISTINCT j.job_id) FILTER (status <> 'F') AS active, count(candidate_id) AS applications, count(*) FILTER (shortlisted) AS shortlisted FROM jobs j LEFT JOIN applications a USING (job_id) GROUP BY j.org_id) o"))
def executive_counters(s, d):
    """Six counters of every organisation; counts of jobs and of applications are taken each at their own grain."""
    held = applications(s, d).join(jobs(s, d).select("job_id", "org_id"), "job_id")
    per_app = held.groupBy("org_id").agg(F.countDistinct("candidate_id").alias("candidates"), F.count("*").alias("applications"), F.count_if("shortlisted").alias("shortlisted"))
    per_job = jobs(s, d).groupBy("org_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") != "F").alias("active"))
    admins = staff(s, d).groupBy("org_id").agg(F.count_if(F.col("role") == "BUILDING").alias("admins"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return per_job.join(per_app, "org_id", "left").join(admins, "org_id", "left").select("org_id", *[zero(c) for c in ("admins", "candidates", "jobs", "active", "applications", "shortlisted")])


@query("AG2_distinct_non_null", sql("SELECT org_id, count(DISTINCT nullif(title, '5-LOW')) AS titles FROM jobs GROUP BY org_id"))
def distinct_non_null(s, d):
    return jobs(s, d).groupBy("org_id").agg(F.countDistinct(F.expr("nullif(title, '5-LOW')")).alias("titles"))


@query("AG3_candidate_rollup", sql("SELECT candidate_id, count(*) AS n_applications, max(applied_at) AS last_applied, string_agg(DISTINCT title, ', ' ORDER BY title) AS titles FROM applications JOIN jobs USING (job_id) GROUP BY candidate_id"))
def candidate_rollup(s, d):
    rows = applications(s, d).join(jobs(s, d).select("job_id", "title"), "job_id")
    return rows.groupBy("candidate_id").agg(F.count("*").alias("n_applications"), F.max("applied_at").alias("last_applied"), F.array_join(F.array_sort(F.collect_set("title")), ", ").alias("titles"))


@query("AG4_status_counts", sql("SELECT org_id, status, count(*) AS n FROM jobs GROUP BY ALL"))
def status_counts(s, d):
    return jobs(s, d).groupBy("org_id", "status").agg(F.count("*").alias("n"))


@query("AG5_duplicate_keys", "SELECT lower(trim(p_name)) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(s, d):
    return read(s, d, "part").groupBy(op.email_key("p_name").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query("AG6_backfill_minimum", sql("SELECT candidate_id, min(org_id) AS org_id FROM applications JOIN jobs USING (job_id) GROUP BY candidate_id"))
def backfill_minimum(s, d):
    return applications(s, d).join(jobs(s, d).select("job_id", "org_id"), "job_id").groupBy("candidate_id").agg(F.min("org_id").alias("org_id"))


@query("AG7_largest_suffix", "SELECT coalesce(max(CAST(substr(c_name, 10) AS INTEGER)), 0) AS top FROM customer")
def largest_suffix(s, d):
    return read(s, d, "customer").agg(F.coalesce(F.max(F.substr("c_name", F.lit(10)).cast("int")), F.lit(0)).alias("top"))


@query("AG8_allowed_keys", "SELECT event_id, json_extract_string(props, '$.k') AS k, 1 AS n_keys FROM events")
def allowed_keys(s, d):
    kept = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k.isin("k", "source"))
    return read(s, d, "events").select("event_id", kept["k"].alias("k"), F.size(kept).alias("n_keys"))


@query("WN2_latest_per_key", sql("SELECT job_id, candidate_id, line, source_id, applied_at FROM applications QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY applied_at DESC NULLS LAST, job_id DESC, line DESC, source_id DESC) = 1"))
def latest_rows(s, d):
    return op.latest_per_key(applications(s, d), ["candidate_id"], [F.desc_nulls_last("applied_at"), F.desc("job_id"), F.desc("line"), F.desc("source_id")]).select("job_id", "candidate_id", "line", "source_id", "applied_at")


@query("WN3_is_latest", sql("SELECT job_id, line, candidate_id, source_id, row_number() OVER (PARTITION BY job_id ORDER BY applied_at DESC, line DESC, candidate_id DESC, source_id DESC) = 1 AS is_latest FROM applications"))
def is_latest(s, d):
    return op.mark_latest(applications(s, d), ["job_id"], [F.desc("applied_at"), F.desc("line"), F.desc("candidate_id"), F.desc("source_id")]).select(*KEY, "is_latest")


@query("WN4_last_activity", "SELECT event_type, event_id, ts FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_activity(s, d):
    newest = read(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return op.latest_per_key(newest, ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id", "ts")


@query("WN6_next_ids", "WITH top AS (SELECT coalesce(max(CAST(substr(c_name, 10) AS BIGINT)), 0) AS n FROM customer WHERE c_name LIKE 'Customer#%') SELECT s_suppkey, 'Customer#' || lpad(CAST(n + row_number() OVER (ORDER BY s_suppkey) AS VARCHAR), 9, '0') AS c_name FROM supplier, top")
def next_ids(s, d):
    return op.next_ids(read(s, d, "customer"), read(s, d, "supplier").select("s_suppkey"), "Customer#", "c_name", [F.asc("s_suppkey")], F.expr("s_suppkey div 1000"), 9)


@query("WN8_keep_first", "WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS value, generate_subscripts(string_split(text, ' '), 1) - 1 AS position FROM conversations) SELECT conv_id, turn, position, value FROM w WHERE lower(trim(value)) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(trim(value)) ORDER BY position) = 1")
def keep_first(s, d):
    rows = read(s, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("words"))
    return op.keep_first(rows, ["conv_id", "turn"], "words").select("conv_id", "turn", F.col("position").cast("long").alias("position"), "value")


@query("WN9_recent_failures", "SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS failures FROM events")
def recent_failures(s, d):
    """Failures of the trailing twelve hours at every event; seconds order the range, so its bound is exact to the microsecond."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    window = Window.partitionBy("user_id").orderBy(micros).rangeBetween(-12 * 3600 * 1_000_000, 0)
    return read(s, d, "events").select("event_id", F.count_if(F.col("event_type") == "error").over(window).alias("failures"))


@query("WN10_known_device", "SELECT event_id, coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, props ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS known FROM events")
def known_device(s, d):
    before = Window.partitionBy("user_id", "props").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return read(s, d, "events").select("event_id", (F.coalesce(F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).over(before), F.lit(0)) > 0).alias("known"))


@query("WN11_recovered_id", "SELECT user_id, arg_max(coalesce(CASE WHEN event_type = 'view' THEN 'v' || event_id END, json_extract_string(props, '$.k')), (ts, event_id)) AS external_id FROM events WHERE event_type <> 'error' GROUP BY user_id")
def recovered_id(s, d):
    found = F.coalesce(F.when(F.col("event_type") == "view", F.concat(F.lit("v"), "event_id")), F.get_json_object("props", "$.k"))
    return read(s, d, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.max_by(found, F.struct("ts", "event_id")).alias("external_id"))


@query("SO1_newest_nulls_first", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS closed_on FROM orders ORDER BY closed_on DESC NULLS FIRST, o_orderkey LIMIT 25")
def newest_nulls_first(s, d):
    return read(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("closed_on")).orderBy(F.desc_nulls_first("closed_on"), "o_orderkey").limit(25)


@query("SO2_by_aggregate", sql("SELECT s.staff_id, max(posted_on) AS last_posted FROM staff s LEFT JOIN jobs ON posted_by = staff_id AND status = 'P' GROUP BY s.staff_id ORDER BY last_posted DESC NULLS LAST, s.staff_id LIMIT 40"))
def by_aggregate(s, d):
    last = jobs(s, d).where("status = 'P'").groupBy(F.col("posted_by").alias("staff_id")).agg(F.max("posted_on").alias("last_posted"))
    return staff(s, d).join(last, "staff_id", "left").select("staff_id", "last_posted").orderBy(F.desc_nulls_last("last_posted"), "staff_id").limit(40)


@query("SO3_case_order", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END ASC NULLS LAST, o_orderkey DESC LIMIT 30")
def case_order(s, d):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return read(s, d, "orders").orderBy(rank, F.asc_nulls_last(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))), F.desc("o_orderkey")).limit(30).select("o_orderkey")


@query("SO4_candidate_ranking", sql(f", {MATCHES_SQL} SELECT a.job_id, a.line, a.candidate_id, a.source_id, row_number() OVER (PARTITION BY a.job_id ORDER BY coalesce(m.match_score, a.score) DESC NULLS LAST, applied_at DESC, line, a.candidate_id, source_id) AS rank FROM applications a LEFT JOIN matches m USING (job_id, candidate_id)"))
def candidate_ranking(s, d):
    scored = applications(s, d).join(matches(s, d), ["job_id", "candidate_id"], "left")
    order = [F.desc_nulls_last(F.coalesce("match_score", F.col("score").cast("long"))), F.desc("applied_at"), "line", "candidate_id", "source_id"]
    return scored.select(*KEY, F.row_number().over(Window.partitionBy("job_id").orderBy(*order)).alias("rank"))


@query("SO5_top_n", sql("SELECT job_id, posted_on FROM jobs ORDER BY posted_on DESC, job_id LIMIT 10"))
def top_n(s, d):
    return jobs(s, d).select("job_id", "posted_on").orderBy(F.desc("posted_on"), "job_id").limit(10)


@query("SO6_activity_feed", sql("SELECT * FROM (SELECT 'application' AS kind, job_id AS ref, applied_at AS happened_at FROM applications UNION ALL SELECT 'job', job_id, posted_on FROM jobs) ORDER BY happened_at DESC, kind, ref DESC LIMIT 6"))
def activity_feed(s, d):
    first = applications(s, d).select(F.lit("application").alias("kind"), F.col("job_id").alias("ref"), F.col("applied_at").alias("happened_at"))
    return first.unionByName(jobs(s, d).select(F.lit("job").alias("kind"), F.col("job_id").alias("ref"), F.col("posted_on").alias("happened_at"))).orderBy(F.desc("happened_at"), "kind", F.desc("ref")).limit(6)


@query("SO7_natural_order", "SELECT s_suppkey, p_brand FROM supplier JOIN part ON p_partkey = s_suppkey ORDER BY TRY_CAST(substr(p_brand, 7) AS INTEGER) DESC NULLS LAST, s_suppkey DESC LIMIT 20")
def natural_order(s, d):
    rows = read(s, d, "supplier").join(read(s, d, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    return rows.orderBy(F.desc_nulls_last(F.substr("p_brand", F.lit(7)).try_cast("int")), F.desc("s_suppkey")).limit(20).select("s_suppkey", "p_brand")


@query("SET1_set_operations", "WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R') SELECT id, 'both' AS side FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT id, 'first' FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT id, 'second' FROM (SELECT id FROM b EXCEPT SELECT id FROM a)")
def set_operations(s, d):
    sides = read(s, d, "lineitem").where("l_returnflag in ('A', 'R')").groupBy(F.col("l_partkey").alias("id")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"))
    return sides.select("id", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").otherwise("second").alias("side"))
