"""State transitions over immutable tables: each statement that would change rows is a transformation to the new table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harrow.operators import relational as op
from harrow.plans.registry import query
from harrow.plans.tables import NOW, SQL_NOW, applications, jobs, read, sql

KEY = ["job_id", "line", "candidate_id", "source_id"]


@query("SNK1_append", "SELECT event_id, event_type FROM events UNION ALL SELECT event_id + 1000000, 'replayed' FROM events WHERE event_type = 'error'")
def append(s, d):
    rows = read(s, d, "events").select("event_id", "event_type")
    return rows.unionByName(rows.where("event_type = 'error'").select((F.col("event_id") + 1000000).alias("event_id"), F.lit("replayed").alias("event_type")))


_BASE = "base AS (SELECT o_custkey AS k, count(*) AS v, max(o_orderkey) AS w FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), delta AS (SELECT o_custkey AS k, o_orderkey AS v, CASE WHEN o_orderstatus = 'P' THEN o_orderkey END AS w, o_orderkey AS seq FROM orders WHERE o_orderstatus <> 'F')"


def _base(s, d):
    return read(s, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v"), F.max("o_orderkey").alias("w"))


def _delta(s, d):
    return read(s, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")).alias("w"))


@query("SNK2_upsert", f"WITH {_BASE}, last AS (SELECT k, v, w FROM delta QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) SELECT * FROM last UNION ALL SELECT * FROM base WHERE k NOT IN (SELECT k FROM last)")
def upsert(s, d):
    return op.upsert(_base(s, d), _delta(s, d), ["k"], [F.desc("v")])


@query("SNK2_insert_absent", f"WITH {_BASE} SELECT * FROM base UNION ALL SELECT k, v, w FROM delta WHERE k NOT IN (SELECT k FROM base) QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1")
def insert_absent(s, d):
    return op.insert_absent(_base(s, d), _delta(s, d), ["k"], [F.asc("v")])


@query("SNK3_merge_columns", f"WITH {_BASE}, last AS (SELECT k, v, w FROM delta QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) SELECT k, coalesce(l.v, b.v) AS v, coalesce(l.w, b.w) AS w FROM base b FULL JOIN last l USING (k)")
def merge_columns(s, d):
    return op.merge_columns(_base(s, d), op.latest_per_key(_delta(s, d), ["k"], [F.desc("v")]), ["k"])


@query("SNK8_resume_anti", "SELECT doc_id, substr(sha256(text), 1, 16) AS document_id FROM documents WHERE substr(sha256(text), 1, 16) NOT IN (SELECT substr(sha256(text), 1, 16) FROM documents WHERE doc_id % 3 = 0)")
def resume_anti(s, d):
    """Content-addressed ids; what a former run finished (a third, here) isn't done again."""
    rows = read(s, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("document_id"))
    return rows.join(rows.where("doc_id % 3 = 0").select("document_id"), "document_id", "left_anti")


@query("DML1_soft_delete", sql("SELECT job_id, CASE WHEN posted_on < TIMESTAMP '1994-01-01' AND status = 'F' THEN 'inactive' ELSE status END AS status FROM jobs"))
def soft_delete(s, d):
    guard = (F.col("posted_on") < F.lit("1994-01-01").cast("timestamp_ntz")) & (F.col("status") == "F")
    return jobs(s, d).select("job_id", F.when(guard, "inactive").otherwise(F.col("status")).alias("status"))


@query("DML2_cascade", sql("SELECT job_id, line, candidate_id, source_id FROM applications WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'P')"))
def cascade(s, d):
    return applications(s, d).join(jobs(s, d).where("status = 'P'"), "job_id", "left_anti").select(*KEY)


@query("DML3_scoped_delete", sql("SELECT event_id FROM events WHERE NOT (event_type = 'error' AND user_id IN (SELECT staff_id FROM staff WHERE org_id < 12))"))
def scoped_delete(s, d):
    staff = read(s, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("user_id"), F.lit("error").alias("event_type"))
    return read(s, d, "events").join(staff, ["user_id", "event_type"], "left_anti").select("event_id")


@query("DML4_retention", f"SELECT count(*) FILTER (ts <= {SQL_NOW} - INTERVAL 7 DAY) AS pruned, count(*) FILTER (ts > {SQL_NOW} - INTERVAL 7 DAY) AS kept FROM events")
def retention(s, d):
    kept = op.since("ts", NOW, days=7)
    return read(s, d, "events").agg(F.count_if(~kept).alias("pruned"), F.count_if(kept).alias("kept"))


@query("DML5_claim_slot", "SELECT user_id AS slot, event_id AS winner FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def claim_slot(s, d):
    """Compare-and-set in a batch: of all claims to a slot, the first wins."""
    return op.latest_per_key(read(s, d, "events").where("event_type = 'signup'"), ["user_id"], [F.asc("ts"), F.asc("event_id")]).select(F.col("user_id").alias("slot"), F.col("event_id").alias("winner"))


@query("DML6_token_rotation", "SELECT event_id, CASE WHEN lead(event_id) OVER w IS NOT NULL THEN 'rotated' ELSE 'live' END AS state, lead(event_id) OVER w AS replaced_by FROM events WHERE event_type IN ('signup', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def token_rotation(s, d):
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(s, d, "events").where("event_type in ('signup', 'view')").select("event_id", F.when(after.isNotNull(), "rotated").otherwise("live").alias("state"), after.alias("replaced_by"))


#: Accepted spellings -> status, allowed transitions, and the statuses that nothing follows.
ALIASES = (("pending", "Applied"), ("applied", "Applied"), ("profile_viewed", "Screening"), ("screening", "Screening"), ("matched", "Matched"), ("shortlisted", "Shortlisted"), ("interview", "Interview"), ("rejected", "Rejected"), ("offer", "Offer"), ("hired", "Hired"), ("withdrawn", "Withdrawn"))
ALLOWED = (("Applied", "Shortlisted"), ("Applied", "Rejected"), ("Screening", "Shortlisted"), ("Screening", "Rejected"), ("Matched", "Shortlisted"), ("Matched", "Rejected"), ("Shortlisted", "Interview"), ("Shortlisted", "Rejected"), ("Interview", "Offer"), ("Interview", "Rejected"), ("Interview", "Shortlisted"), ("Offer", "Hired"), ("Offer", "Rejected"))
TERMINAL = ("Hired", "Withdrawn")
#: Spelling of each event's status: by its place in the list of spellings; every thirteenth has none.
_SPELT = "CASE event_id % 13 " + " ".join(f"WHEN {i} THEN '{a.upper() if i % 2 else a}'" for i, (a, _) in enumerate(ALIASES)) + " WHEN 11 THEN '' END"
_values = lambda rows: ", ".join(str(tuple(r)) for r in rows)


@query("DML7_status_machine", f"WITH alias(spelt, status) AS (VALUES {_values(ALIASES)}), allowed(a, b) AS (VALUES {_values(ALLOWED)}), named AS (SELECT event_id, user_id, ts, coalesce(status, 'Applied') AS status FROM (SELECT *, lower(trim({_SPELT})) AS spelt FROM events) LEFT JOIN alias USING (spelt)), steps AS (SELECT event_id, status, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM named) SELECT event_id, status, before IN ('Hired', 'Withdrawn') AS terminal, before IS NULL OR before = status OR EXISTS (SELECT 1 FROM allowed WHERE a = before AND b = status) AS allowed FROM steps")
def status_machine(s, d):
    """Spellings to the nine statuses (none: Applied), and whether each step from the one before is allowed."""
    alias = s.createDataFrame(list(ALIASES), "spelt string, status string")
    allowed = s.createDataFrame([(a, b, True) for a, b in ALLOWED], "before string, status string, known boolean")
    named = read(s, d, "events").withColumn("spelt", F.lower(F.trim(F.expr(_SPELT)))).join(F.broadcast(alias), "spelt", "left").withColumn("status", F.coalesce("status", F.lit("Applied")))
    steps = named.withColumn("before", F.lag("status").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    ok = F.col("before").isNull() | (F.col("before") == F.col("status")) | F.coalesce("known", F.lit(False))
    return steps.join(F.broadcast(allowed), ["before", "status"], "left").select("event_id", "status", F.col("before").isin(*TERMINAL).alias("terminal"), ok.alias("allowed"))


@query("DML8_replace_children", sql("SELECT job_id, candidate_id, score FROM applications WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'P') UNION ALL SELECT job_id, posted_by, 0 FROM jobs WHERE status = 'P'"))
def replace_children(s, d):
    parents = jobs(s, d).where("status = 'P'")
    return applications(s, d).join(parents, "job_id", "left_anti").select("job_id", "candidate_id", "score").unionByName(parents.select("job_id", F.col("posted_by").alias("candidate_id"), F.lit(0).alias("score")))


@query("DML9_verify_catalogue", "WITH c AS (SELECT DISTINCT sha256(text) AS hash, length(text) AS size FROM documents WHERE doc_id % 10 > 0) SELECT doc_id, CASE WHEN c.hash IS NULL THEN 'missing' WHEN c.size <> n_chars THEN 'size' ELSE 'intact' END AS state FROM documents LEFT JOIN c ON c.hash = sha256(CASE WHEN doc_id % 50 = 1 THEN text || 'x' ELSE text END)")
def verify_catalogue(s, d):
    """Stored contents, some damaged, are hashed again and looked up in a catalogue that was made before: some were never put there."""
    docs = read(s, d, "documents")
    catalogue = docs.where("doc_id % 10 > 0").select(F.sha2("text", 256).alias("hash"), F.length("text").alias("size")).distinct()
    stored = docs.select("doc_id", "n_chars", F.sha2(F.when(F.col("doc_id") % 50 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return stored.join(catalogue, "hash", "left").select("doc_id", F.when(F.col("size").isNull(), "missing").when(F.col("size") != F.col("n_chars"), "size").otherwise("intact").alias("state"))
