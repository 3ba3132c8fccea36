"""Executive and operational analytics: funnels, buckets, conversion, timing of sessions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from harrow.operators.relational import half_up_percent
from harrow.plans.registry import query
from harrow.plans.relational import SESSIONS_SQL, sessions
from harrow.plans.tables import applications, jobs, read, sql

#: Application status aliases -> funnel stage, in funnel order.
STAGES = ("applied", "screening", "shortlisted", "interview", "offer", "hired", "rejected", "withdrawn")
#: What statuses are called, and the stage that each is; stages that a shortlisting doesn't change.
STAGES = {
    "pending": "applied", "applied": "applied", "profile_viewed": "screening", "reviewed": "screening", "screening": "screening", "matched": "screening", "shortlisted": "shortlisted",
    "interview": "interview", "rejected": "rejected", "not_shortlisted": "rejected", "offer": "offer", "hired": "hired", "withdrawn": "withdrawn", "ats_failed": "applied",
}
FINAL = ("shortlisted", "interview", "offer", "hired", "rejected", "withdrawn")
#: An application's status as it was typed in, by its score.
_TYPED = "CASE score % 20 WHEN 0 THEN 'Pending' WHEN 2 THEN ' APPLIED ' WHEN 4 THEN 'Profile Viewed' WHEN 6 THEN 'reviewed' WHEN 8 THEN 'Not  Shortlisted' WHEN 10 THEN 'interview' WHEN 12 THEN 'OFFER' WHEN 14 THEN 'ats failed' WHEN 16 THEN outcome ELSE CASE stage WHEN 'O' THEN 'withdrawn' ELSE NULL END END"
_STAGE_MAP = "MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in STAGES.items()) + "}"


def funnel_stage(status: Column, shortlisted: Column) -> Column:
    """The stage of a status by its name, with underscores for blanks, else applied; a shortlisted one is at least shortlisted, unless it has ended."""
    names = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    raw = F.trim(F.lower(F.coalesce(status, F.lit("applied"))))
    mapped = F.coalesce(F.try_element_at(names, raw), F.try_element_at(names, F.regexp_replace(raw, "\\s+", "_")), F.lit("applied"))
    return F.when(shortlisted & ~mapped.isin(*FINAL), "shortlisted").otherwise(mapped)


@query("AG9_funnel", sql(f""", typed AS (SELECT org_id, shortlisted, trim(lower(coalesce({_TYPED}, 'applied'))) AS raw FROM applications JOIN jobs USING (job_id)), named AS (SELECT org_id, shortlisted, coalesce({_STAGE_MAP}[raw], {_STAGE_MAP}[regexp_replace(raw, '\\s+', '_', 'g')], 'applied') AS stage FROM typed)
SELECT org_id, CASE WHEN shortlisted AND stage NOT IN ({', '.join(f"'{x}'" for x in FINAL)}) THEN 'shortlisted' ELSE stage END AS stage, count(*) AS n FROM named GROUP BY ALL"""))
def funnel(s, d):
    """Applications of each organisation by stage."""
    rows = applications(s, d).selectExpr("job_id", "shortlisted", f"{_TYPED} AS status")
    staged = rows.select("job_id", funnel_stage(F.col("status"), F.col("shortlisted")).alias("stage"))
    return staged.join(jobs(s, d).select("job_id", "org_id"), "job_id").groupBy("org_id", "stage").agg(F.count("*").alias("n"))


@query("AG10_outcomes", sql("SELECT job_id, count(*) FILTER (outcome = 'A') AS shortlisted, count(*) FILTER (outcome = 'N' AND stage = 'F') AS not_shortlisted, count(*) FILTER (outcome = 'R') AS rejected, count(*) FILTER (outcome = 'N' AND stage <> 'F') AS withdrawn FROM applications GROUP BY job_id"))
def outcomes(s, d):
    o, f = F.col("outcome"), F.col("stage") == "F"
    return applications(s, d).groupBy("job_id").agg(F.count_if(o == "A").alias("shortlisted"), F.count_if((o == "N") & f).alias("not_shortlisted"), F.count_if(o == "R").alias("rejected"), F.count_if((o == "N") & ~f).alias("withdrawn"))


@query("AG11_verdicts", sql("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(title), 'urgent') THEN 'strong' WHEN regexp_matches(lower(title), 'not spec') THEN 'unknown' WHEN score IS NULL THEN 'unknown' WHEN score >= 80 THEN 'strong' WHEN score >= 40 THEN 'potential' ELSE 'not_a_match' END AS verdict FROM applications JOIN jobs USING (job_id)) GROUP BY verdict"))
def verdicts(s, d):
    title, score = F.lower("title"), F.col("score")
    verdict = F.when(title.rlike("urgent"), "strong").when(title.rlike("not spec"), "unknown").when(score.isNull(), "unknown").when(score >= 80, "strong").when(score >= 40, "potential").otherwise("not_a_match")
    return applications(s, d).join(jobs(s, d).select("job_id", "title"), "job_id").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("AG12_score_buckets", sql("SELECT org_id, count(*) FILTER (score >= 60) AS high, count(*) FILTER (score >= 30 AND score < 60) AS medium, count(*) FILTER (score < 30) AS low, ((20 * sum(score) + count(*)) // (2 * count(*)))::BIGINT AS avg_tenths, (200 * count(*) FILTER (shortlisted) + count(*)) // (2 * count(*)) AS shortlist_rate FROM applications JOIN jobs USING (job_id) GROUP BY org_id"))
def score_buckets(s, d):
    """Averages in whole tenths, rounded half up in integers: the same on every engine."""
    n, score = F.count("*"), F.col("score")
    return applications(s, d).join(jobs(s, d).select("job_id", "org_id"), "job_id").groupBy("org_id").agg(
        F.count_if(score >= 60).alias("high"), F.count_if((score >= 30) & (score < 60)).alias("medium"), F.count_if(score < 30).alias("low"),
        F.expr("(20 * sum(score) + count(*)) div (2 * count(*))").alias("avg_tenths"), half_up_percent(F.count_if("shortlisted"), n).alias("shortlist_rate"),
    )


@query("AG13_job_conversion", sql("SELECT job_id, count(*) AS n, (200 * count(*) FILTER (shortlisted) + count(*)) // (2 * count(*)) AS conversion, ((20 * sum(score) + count(*)) // (2 * count(*)))::BIGINT AS avg_tenths FROM applications GROUP BY job_id ORDER BY n DESC, job_id LIMIT 6"))
def job_conversion(s, d):
    return applications(s, d).groupBy("job_id").agg(F.count("*").alias("n"), half_up_percent(F.count_if("shortlisted"), F.count("*")).alias("conversion"), F.expr("(20 * sum(score) + count(*)) div (2 * count(*))").alias("avg_tenths")).orderBy(F.desc("n"), "job_id").limit(6)


#: Score bands, half open; the first holds every application.
BANDS = (("all", None, None), ("80 and above", 80, 101), ("70 to 79", 70, 80), ("60 to 69", 60, 70), ("50 to 59", 50, 60), ("40 to 49", 40, 50), ("below 40", 0, 40))


@query("AG14_score_bands", sql("SELECT band, count(*) AS n FROM applications JOIN (VALUES ('all', NULL, NULL), ('80 and above', 80, 101), ('70 to 79', 70, 80), ('60 to 69', 60, 70), ('50 to 59', 50, 60), ('40 to 49', 40, 50), ('below 40', 0, 40)) b(band, low, high) ON low IS NULL OR (score >= low AND score < high) GROUP BY band"))
def score_bands(s, d):
    """One pass: every application names its bands, which are then counted."""
    score = F.col("score")
    named = F.array_compact(F.array(*[F.when(F.lit(True) if low is None else (score >= low) & (score < high), band) for band, low, high in BANDS]))
    return applications(s, d).select(F.explode(named).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


_CENTS = "CAST(round(value * 100) AS BIGINT)"


def timed(s, d):
    return read(s, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("name"), F.round(F.col("value") * 100).cast("long").alias("ms"))


@query("AG15_function_timing", f"SELECT event_type AS name, count(*) AS n, sum({_CENTS})::BIGINT AS total, max({_CENTS}) AS slowest, min({_CENTS}) AS fastest, ((2 * sum({_CENTS}) + count(*)) // (2 * count(*)))::BIGINT AS average FROM events GROUP BY ALL")
def function_timing(s, d):
    return timed(s, d).groupBy("name").agg(F.count("*").alias("n"), F.sum("ms").alias("total"), F.max("ms").alias("slowest"), F.min("ms").alias("fastest"), F.expr("(2 * sum(ms) + count(*)) div (2 * count(*))").alias("average"))


@query("AG15_extremes", f"(SELECT 'slowest' AS side, event_id, {_CENTS} AS ms FROM events ORDER BY ms DESC, event_id LIMIT 10) UNION ALL (SELECT 'fastest', event_id, {_CENTS} AS ms FROM events ORDER BY ms, event_id LIMIT 10)")
def extremes(s, d):
    rows = timed(s, d).select("event_id", "ms")
    side = lambda name, *order: rows.orderBy(*order).limit(10).select(F.lit(name).alias("side"), "event_id", "ms")
    return side("slowest", F.desc("ms"), "event_id").unionByName(side("fastest", "ms", "event_id"))


@query("AG15_distribution", f"SELECT ms, count(*) AS n FROM (SELECT {_CENTS} // 1000 AS ms FROM events) GROUP BY ms ORDER BY n DESC, ms LIMIT 20")
def distribution(s, d):
    """The twenty most frequent classes of duration."""
    return timed(s, d).groupBy(F.expr("ms div 1000").alias("ms")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ms").limit(20)


@query("AG16_p95_nearest", f"SELECT name, list_extract(v, CAST(round_even(0.95 * (len(v) - 1), 0) AS BIGINT) + 1) AS p95 FROM (SELECT event_type AS name, list({_CENTS} ORDER BY {_CENTS}) AS v FROM events GROUP BY ALL)")
def p95_nearest(s, d):
    """The value at the nearest index, ties to even: by rank, so that no group is collected."""
    counts = timed(s, d).groupBy("name", "ms").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("name").orderBy("ms"))  # over distinct values, each with its count
    sizes = counts.groupBy("name").agg(F.sum("n").alias("size"))
    rank = F.expr("cast(bround(0.95 * (size - 1), 0) as bigint) + 1")
    return counts.withColumn("upto", upto).join(sizes, "name").where((rank <= F.col("upto")) & (rank > F.col("upto") - F.col("n"))).select("name", F.col("ms").alias("p95"))


@query("AG17_hourly_series", f"SELECT event_type AS name, date_trunc('hour', ts) AS hour, count(*) AS n, ((2 * sum({_CENTS}) + count(*)) // (2 * count(*)))::BIGINT AS average FROM events GROUP BY ALL")
def hourly_series(s, d):
    return timed(s, d).groupBy("name", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.expr("(2 * sum(ms) + count(*)) div (2 * count(*))").alias("average"))


@query("AG18_kind_average", f"WITH t AS (SELECT event_type AS name, {_CENTS} AS ms, event_id FROM events), a AS (SELECT name, (sum(ms) // count(*))::BIGINT AS average FROM t WHERE ms > 30000 AND name <> 'error' GROUP BY name), k AS (SELECT DISTINCT name FROM t), f AS (SELECT ms FROM t WHERE name = 'click' ORDER BY event_id LIMIT 1) SELECT k.name, coalesce(average, f.ms) AS average FROM k LEFT JOIN a USING (name), f")
def kind_average(s, d):
    """Where a kind has no qualifying session, the first marker event of any session stands in."""
    t = timed(s, d)
    average = t.where("ms > 30000 and name <> 'error'").groupBy("name").agg(F.expr("sum(ms) div count(*)").alias("average"))
    marker = t.agg(F.min_by(F.when(F.col("name") == "click", F.col("ms")), F.when(F.col("name") == "click", F.col("event_id"))).alias("first_ms"))
    return t.select("name").distinct().join(average, "name", "left").crossJoin(F.broadcast(marker)).select("name", F.coalesce("average", "first_ms").alias("average"))


@query("AG19_bulk_groups", sql("SELECT job_id, sum(score)::BIGINT AS total, count(*) FILTER (outcome <> 'R') AS ok, count(*) FILTER (outcome = 'R') AS failed, min(applied_at) AS first_at, max(applied_at) AS last_at, string_agg(CAST(candidate_id AS VARCHAR), ',' ORDER BY candidate_id) AS files FROM applications GROUP BY job_id"))
def bulk_groups(s, d):
    return applications(s, d).groupBy("job_id").agg(
        F.sum("score").alias("total"), F.count_if(F.col("outcome") != "R").alias("ok"), F.count_if(F.col("outcome") == "R").alias("failed"), F.min("applied_at").alias("first_at"), F.max("applied_at").alias("last_at"),
        F.array_join(F.array_sort(F.collect_list("candidate_id")), ",").alias("files"),
    )


_SESSION = "user_id * 100000000 + CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS session_id"


@query("AG20_function_details", f"SELECT {_SESSION}, event_type AS name, max({_CENTS}) AS ms, arg_max(event_id, {_CENTS} * 1000000 + event_id) AS event_id, min(event_id) AS seen FROM events GROUP BY ALL")
def function_details(s, d):
    """The longest event of each function of a session; of equals the later. seen orders them by first appearance."""
    rows = timed(s, d).withColumn("session_id", F.col("user_id") * 100_000_000 + F.date_format("ts", "yyyyMMdd").cast("long"))
    return rows.groupBy("session_id", "name").agg(F.max("ms").alias("ms"), F.max_by("event_id", F.struct("ms", "event_id")).alias("event_id"), F.min(F.col("event_id")).alias("seen"))


@query("AG39_progress", sql("SELECT job_id, count(*) FILTER (stage = 'F') AS processed, count(*) - count(*) FILTER (stage = 'F') AS remainder, 100 * count(*) FILTER (stage = 'F') // count(*) AS progress FROM applications GROUP BY job_id"))
def progress(s, d):
    done = F.count_if(F.col("stage") == "F")
    return applications(s, d).groupBy("job_id").agg(done.alias("processed"), (F.count("*") - done).alias("remainder"), F.expr("100 * count_if(stage = 'F') div count(*)").alias("progress"))


@query("AG40_task_metrics", f"SELECT event_type AS provider, count(*) AS n, count(*) FILTER (value >= 10) AS succeeded, count(*) FILTER (value < 1) AS fallbacks, coalesce(sum({_CENTS}), 0)::BIGINT AS cost, coalesce((2 * sum({_CENTS}) + count(*)) // (2 * count(*)), 0)::BIGINT AS mean_duration, coalesce(sum(user_id % 3), 0)::BIGINT AS retries, count(*) FILTER (event_id % 11 = 0) AS validation_failures FROM events GROUP BY ROLLUP (event_type)")
def task_metrics(s, d):
    rows = timed(s, d)
    metrics = [F.count("*").alias("n"), F.count_if(F.col("ms") >= 1000).alias("succeeded"), F.count_if(F.col("ms") < 100).alias("fallbacks"), F.coalesce(F.sum("ms"), F.lit(0)).alias("cost"),
               F.coalesce(F.expr("(2 * sum(ms) + count(*)) div (2 * count(*))"), F.lit(0)).alias("mean_duration"), F.coalesce(F.sum(F.col("user_id") % 3), F.lit(0)).alias("retries"), F.count_if(F.col("event_id") % 11 == 0).alias("validation_failures")]
    return rows.rollup(F.col("name").alias("provider")).agg(*metrics)


@query("WN7_stage_timeline", f"SELECT session_id, name, ms, row_number() OVER (PARTITION BY session_id ORDER BY depth DESC, ms DESC, name) AS place FROM (SELECT {_SESSION}, event_type AS name, max({_CENTS}) AS ms, length(event_type) % 3 AS depth FROM events GROUP BY ALL)")
def stage_timeline(s, d):
    rows = timed(s, d).withColumn("session_id", F.col("user_id") * 100_000_000 + F.date_format("ts", "yyyyMMdd").cast("long"))
    longest = rows.groupBy("session_id", "name").agg(F.max("ms").alias("ms"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(F.length("name") % 3), F.desc("ms"), "name"))
    return longest.withColumn("place", place)


@query("SNK5_session_export", f"WITH {SESSIONS_SQL}, shown AS (SELECT session_id, started_at, list_filter(events, lambda e: e.name = 'purchase') AS bought FROM sessions) SELECT session_id, started_at, coalesce(b.name, '') AS name, coalesce(CAST(b.ms AS VARCHAR), '') AS ms FROM shown LEFT JOIN LATERAL (SELECT unnest(bought) AS b) ON TRUE")
def session_export(s, d):
    """Session times event, left outer: a session without such events is one row of blanks."""
    shown = sessions(s, d).select("session_id", "started_at", F.explode_outer(F.filter("events", lambda e: e["name"] == "purchase")).alias("b"))
    return shown.select("session_id", "started_at", F.coalesce("b.name", F.lit("")).alias("name"), F.coalesce(F.col("b.ms").cast("string"), F.lit("")).alias("ms"))


@query("SNK6_safe_cells", "SELECT conv_id, turn, substr(regexp_replace(coalesce(nullif(text, ''), ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), 1, 32767) AS cell FROM conversations")
def safe_cells(s, d):
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return read(s, d, "conversations").select("conv_id", "turn", F.substring(clean, 1, 32767).alias("cell"))


@query("SESSION_rollup", f"WITH {SESSIONS_SQL} SELECT n_events, count(*) AS n, count(*) FILTER (failed) AS failed FROM sessions GROUP BY ALL")
def session_rollup(s, d):
    return sessions(s, d).groupBy("n_events").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
