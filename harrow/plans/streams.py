"""Streaming behaviour run over stored events: outbox, leases, rate limits, rings, hourly windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harrow.plans.registry import query
from harrow.plans.tables import NOW, SQL_NOW, read
from harrow.streaming import flows, outbox


@query("STR1_outbox_claim", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1997-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 25")
def outbox_claim(s, d):
    """The oldest due rows: what one drain takes."""
    return read(s, d, "orders").where("o_orderstatus = 'P' and o_orderdate <= timestamp'1997-01-01'").orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderdate")


@query("STR2_retry", "SELECT event_id, attempt, attempt > 5 AS dead, CASE WHEN attempt <= 5 THEN ts + to_seconds(least(300, 5 * power(2, attempt))::BIGINT) END AS next_at FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')")
def retry(s, d):
    """Each failure's attempt number, when it is due again, and whether it is dead."""
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = read(s, d, "events").where("event_type = 'error'").select("event_id", "ts", attempt.cast("long").alias("attempt"))
    due = F.col("ts") + F.make_dt_interval(secs=F.least(F.lit(300), F.lit(5) * F.power(F.lit(2), F.least("attempt", F.lit(10)))))
    return rows.select("event_id", "attempt", (F.col("attempt") > 5).alias("dead"), F.when(F.col("attempt") <= 5, due).alias("next_at"))


@query("STR3_leases", f"SELECT user_id, max(ts) AS last_beat, max(ts) < {SQL_NOW} - INTERVAL 1 DAY AS stale FROM events GROUP BY user_id")
def leases(s, d):
    return read(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_beat")).withColumn("stale", F.col("last_beat") < F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 1 day"))


#: Half a day under a lease, three retries after ten minutes, twenty, forty.
RULES = outbox.Rules(lease=43_200, max_retries=3, backoff=600, most_backoff=36_000)
_KIND = "CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'beat' WHEN 'purchase' THEN 'success' ELSE 'failure' END"
_LEASE = int(RULES.lease * 1e6)
_OUTBOX = f"""WITH RECURSIVE e AS (SELECT user_id AS item, event_id AS seq, epoch_us(ts) AS us, {_KIND} AS kind, 'w' || (event_id % 2) AS worker, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT item, 0::BIGINT AS k, NULL::BIGINT AS us, NULL::BIGINT AS seq, NULL::VARCHAR AS worker, 'none' AS status, 0 AS attempt, NULL::BIGINT AS due, NULL::VARCHAR AS holder, NULL::BIGINT AS until, NULL::VARCHAR AS outcome, NULL::BIGINT AS back, NULL::VARCHAR AS back_worker, 0 AS back_attempt, NULL::BIGINT AS back_due FROM (SELECT DISTINCT item FROM e) UNION ALL
SELECT e.item, e.k, e.us, e.seq, e.worker, CASE o.x WHEN 'queued' THEN 'pending' WHEN 'done' THEN 'done' WHEN 'dead' THEN 'dead' ELSE w.status END, CASE o.x WHEN 'queued' THEN 0 WHEN 'retry' THEN w.attempt + 1 WHEN 'dead' THEN w.attempt + 1 ELSE w.attempt END,
CASE o.x WHEN 'queued' THEN e.us WHEN 'retry' THEN e.us + (least({RULES.backoff} * power(2, w.attempt), {RULES.most_backoff}) * 1000000)::BIGINT WHEN 'done' THEN NULL WHEN 'dead' THEN NULL ELSE w.due END,
CASE WHEN o.x = 'claimed' THEN e.worker WHEN o.x IN ('queued', 'done', 'dead', 'retry') THEN NULL ELSE f.h END, CASE WHEN o.x IN ('claimed', 'extended') THEN e.us + {_LEASE} WHEN o.x IN ('queued', 'done', 'dead', 'retry') THEN NULL ELSE f.u END,
o.x, CASE WHEN f.gone THEN w.until END, CASE WHEN f.gone THEN w.holder END, w.attempt, w.due
FROM w JOIN e ON e.item = w.item AND e.k = w.k + 1, LATERAL (SELECT coalesce(w.until < e.us, false) AS gone, CASE WHEN w.until < e.us THEN NULL ELSE w.until END AS u, CASE WHEN w.until < e.us THEN NULL ELSE w.holder END AS h) f,
LATERAL (SELECT CASE WHEN e.kind = 'enqueue' THEN CASE WHEN w.status = 'pending' THEN 'ignored' ELSE 'queued' END WHEN e.kind = 'claim' THEN CASE WHEN w.status <> 'pending' OR f.u IS NOT NULL OR w.due > e.us THEN 'refused' ELSE 'claimed' END
  WHEN f.u IS NULL OR f.h <> e.worker THEN 'stale' WHEN e.kind = 'beat' THEN 'extended' WHEN e.kind = 'success' THEN 'done' WHEN w.attempt >= {RULES.max_retries} THEN 'dead' ELSE 'retry' END AS x) o),
t AS (SELECT item, us AS moment, seq, outcome, worker, attempt, due, until FROM w WHERE k > 0 UNION ALL SELECT item, back, NULL, 'reclaimed', back_worker, back_attempt, back_due, NULL FROM w WHERE back IS NOT NULL UNION ALL
SELECT item, until, NULL, 'reclaimed', holder, attempt, due, NULL FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY item ORDER BY k DESC) = 1) WHERE until < (SELECT max(us) FROM e))
SELECT item, make_timestamp(moment) AS "at", """


def _outbox(s, d):
    """Events read as an outbox's: what happens to each user's item."""
    told = read(s, d, "events").selectExpr("user_id AS item", "event_id AS seq", "ts AS at", f"{_KIND} AS kind", "'w' || (event_id % 2) AS worker")
    moment = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return outbox.transitions(told, RULES).select("item", moment("at"), "seq", "outcome", "worker", "attempt", moment("due"), moment("leased_until"))


@query("STR1_claims", _OUTBOX + "seq, outcome, worker, make_timestamp(until) AS leased_until FROM t WHERE outcome IN ('claimed', 'refused', 'extended')")
def claims(s, d):
    """Which claims are granted, which are refused, and until when a lease runs. A stream gives the same rows; see the tests."""
    return _outbox(s, d).where("outcome in ('claimed', 'refused', 'extended')").select("item", "at", "seq", "outcome", "worker", "leased_until")


@query("STR2_dead_letters", _OUTBOX + "seq, outcome, attempt, make_timestamp(due) AS due FROM t WHERE outcome IN ('retry', 'dead', 'done')")
def dead_letters(s, d):
    """Ended attempts: done, due again after their backoff, or dead."""
    return _outbox(s, d).where("outcome in ('retry', 'dead', 'done')").select("item", "at", "seq", "outcome", "attempt", "due")


@query("STR3_reclaimed", _OUTBOX + "worker, attempt FROM t WHERE outcome = 'reclaimed'")
def reclaimed(s, d):
    """Leases that nobody ended, taken back at their end."""
    return _outbox(s, d).where("outcome = 'reclaimed'").select("item", "at", "worker", "attempt")


@query("STR4_rate_limit", """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, k, [ts] AS held, true AS allowed FROM e WHERE k = 1 UNION ALL
SELECT e.user_id, e.event_id, e.k, CASE WHEN len(list_filter(w.held, lambda x: x > e.ts - INTERVAL 6 HOUR)) < 3 THEN list_append(list_filter(w.held, lambda x: x > e.ts - INTERVAL 6 HOUR), e.ts) ELSE list_filter(w.held, lambda x: x > e.ts - INTERVAL 6 HOUR) END,
len(list_filter(w.held, lambda x: x > e.ts - INTERVAL 6 HOUR)) < 3 FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id, allowed FROM w""")
def rate_limit(s, d):
    """At most three events of a user in six hours; refused ones don't count."""
    return flows.rate_limited(read(s, d, "events"), 3, 6 * 3600)


@query("STR7_ring", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def ring(s, d):
    """The newest 20 of each user."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return read(s, d, "events").withColumn("k", rank).where("k <= 20").select("user_id", "event_id")


@query("STR10_hourly", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly(s, d):
    return flows.hourly(read(s, d, "events")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
