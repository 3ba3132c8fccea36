"""Nested records: JSON payloads, checklists, completeness, coverage, validation, sections, run summaries, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import values as v
from harrow.operators.folds import ordered_fold
from harrow.plans.registry import query
from harrow.plans.tables import read
from harrow.sources import html

_CELL = "CASE p_size % 3 WHEN 0 THEN ' ' || p_brand || ' ,, ' || p_type || ';x' WHEN 1 THEN p_type ELSE '' END"


@query("AR1_list_coercion", f"SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array({_CELL}, '[,;]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part")
def list_coercion(s, d):
    """A cell as a list: cut at commas and semicolons, trimmed, without empty items."""
    items = F.filter(F.transform(F.split("x", "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return read(s, d, "part").selectExpr("p_partkey", f"{_CELL} AS x").select("p_partkey", F.array_join(items, "|").alias("items"))


@query("AR2_alias_fields", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'n' || user_id ELSE NULL END AS name FROM events")
def alias_fields(s, d):
    """The first of a field's names that a record has and that isn't empty."""
    doc = "CASE event_id % 3 WHEN 0 THEN '{\"full_name\": \"' || event_type || '\"}' WHEN 1 THEN '{\"fullName\": \"\", \"name\": \"n' || user_id || '\"}' ELSE '{\"other\": 1}' END"
    rows = read(s, d, "events").selectExpr("event_id", f"{doc} AS doc")
    names = [F.nullif(F.get_json_object("doc", f"$.{name}"), F.lit("")) for name in ("full_name", "fullName", "name", "candidate_name")]
    return rows.select("event_id", F.coalesce(*names).alias("name"))


#: What outranks what as the source of a value.
RANK = {"signup": 4, "purchase": 3, "view": 2, "click": 1, "error": 0}


@query("AR3_provenance", "SELECT user_id, max_by(value, (CASE event_type WHEN 'signup' THEN 4 WHEN 'purchase' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END, ts, event_id)) AS value, max_by(event_type, (CASE event_type WHEN 'signup' THEN 4 WHEN 'purchase' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END, ts, event_id)) AS source FROM events GROUP BY user_id")
def provenance(s, d):
    """Of each user's values, the one of the highest source; of equal ones the latest."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair]), F.col("event_type"))
    best = F.max_by(F.struct("value", "event_type"), F.struct(F.coalesce(rank, F.lit(0)), "ts", "event_id"))
    return read(s, d, "events").groupBy("user_id").agg(best.alias("b")).select("user_id", "b.value", F.col("b.event_type").alias("source"))


@query("AR4_json_or_default", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_or_default(s, d):
    """Text that isn't JSON counts as an empty record."""
    doc = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return read(s, d, "events").select("event_id", F.coalesce(F.from_json(doc, "k bigint")["k"], F.lit(-1).cast("long")).alias("k"))


_PAYLOAD = """CASE event_id % 5 WHEN 0 THEN '{"jobId": "j' || event_id || '"}' WHEN 1 THEN '{"data": {"external_job_id": ' || event_id || '}}' WHEN 2 THEN '{"status": 1, "result": {"x": 1}, "job": {"id": "a' || user_id || '"}}' WHEN 3 THEN '{"id": null, "job_id": "b"}' ELSE '{"ok": true}' END"""
#: Where an id may stand, in order, and the records it may be nested in.
ID_NAMES = ("id", "jobId", "job_id", "externalJobId", "external_job_id", "applicationId")
NESTS = ("data", "result", "job", "application")


@query("AR5_payload_ids", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'j' || event_id WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'a' || user_id WHEN 3 THEN 'b' END AS id FROM events")
def payload_ids(s, d):
    rows = read(s, d, "events").selectExpr("event_id", f"{_PAYLOAD} AS doc")
    paths = [f"$.{n}" for n in ID_NAMES] + [f"$.{nest}.{n}" for nest in NESTS for n in ID_NAMES]
    return rows.select("event_id", F.coalesce(*[F.get_json_object("doc", p) for p in paths]).alias("id"))


@query("AR7_nested_applications", "SELECT user_id, event_id::VARCHAR AS application_id, event_type || '@x.org' AS email, 'new' AS status FROM events WHERE event_type <> 'error' UNION ALL SELECT user_id, 'none' AS application_id, NULL AS email, 'hired' AS status FROM (SELECT DISTINCT user_id FROM events)")
def nested_applications(s, d):
    """Applications out of the list of a payload, whichever of five names it has."""
    rows = read(s, d, "events")
    items = rows.where("event_type <> 'error'").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_id").cast("string").alias("id"), F.concat("event_type", F.lit("@x.org")).alias("email"), F.lit("new").alias("status"))).alias("items"))
    named = F.create_map(F.when(F.col("user_id") % 2 == 0, "applications").otherwise("results"), F.col("items"))
    payloads = items.select("user_id", F.to_json(named).alias("doc"))
    alone = rows.select("user_id").distinct().select("user_id", F.to_json(F.struct(F.array(F.struct(F.lit("none").alias("applicationId"), F.lit("hired").alias("stage"))).alias("candidates"))).alias("doc"))
    fields = "array<struct<id: string, applicationId: string, email: string, status: string, stage: string>>"
    parsed = F.from_json("doc", ", ".join(f"{name} {fields}" for name in ("applications", "data", "items", "results", "candidates")))
    found = payloads.unionByName(alone).select("user_id", parsed.alias("p")).select("user_id", F.explode(F.coalesce("p.applications", "p.data", "p.items", "p.results", "p.candidates")).alias("a"))
    return found.select("user_id", F.coalesce("a.id", "a.applicationId").alias("application_id"), "a.email", F.coalesce("a.status", "a.stage").alias("status"))


@query("MA2_percentiles", "SELECT source, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.99) AS p99 FROM documents GROUP BY source")
def percentiles(s, d):
    """Interpolated percentiles out of a histogram: each distinct value once with its count, so no group's rows are held."""
    counts = read(s, d, "documents").groupBy("source", "n_chars").agg(F.count("*").alias("n"))
    p = F.percentile("n_chars", [0.5, 0.9, 0.99], F.col("n"))
    return counts.groupBy("source").agg(p.alias("p")).select("source", *[F.get("p", F.lit(i)).alias(a) for i, a in enumerate(("median", "p90", "p99"))])


#: Column, weight, least length of a full value.
COMPLETE = (("name", 15, 2), ("email", 15, 3), ("phone", 15, 7), ("location", 10, 2), ("summary", 15, 40), ("skills", 10, 8), ("experience", 15, 20), ("education", 5, 8))
_ROW = """c_custkey, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN 'a@b' END AS email, CASE c_custkey % 4 WHEN 0 THEN '12345' WHEN 1 THEN '1234567890' ELSE ' ' END AS phone, c_mktsegment AS location,
repeat(c_mktsegment || ' ', CAST(c_custkey % 9 AS INT)) AS summary, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE '' END AS skills, CASE WHEN c_custkey % 5 > 1 THEN c_name || c_name ELSE 'x' END AS experience, CASE WHEN c_custkey % 6 = 0 THEN 'degree' ELSE 'a long degree' END AS education"""
_SCORE = " + ".join(f"CASE WHEN trim(coalesce({c}, '')) = '' THEN 0 WHEN length(trim({c})) < {n} THEN {max(1, w // 2)} ELSE {w} END" for c, w, n in COMPLETE)
_TIER = "CASE WHEN {0} >= 80 THEN 'OK' WHEN {0} >= 50 THEN 'PARTIAL' ELSE 'WEAK' END"


def completeness() -> Column:
    """0 to 100: each column's weight, half of it for a short value."""
    return sum((F.when(F.trim(F.coalesce(c, F.lit(""))) == "", 0).when(F.length(F.trim(c)) < n, max(1, w // 2)).otherwise(w) for c, w, n in COMPLETE), F.lit(0))


def tier(score: Column) -> Column:
    return F.when(score >= 80, "OK").when(score >= 50, "PARTIAL").otherwise("WEAK")


@query("MA6_completeness", f"SELECT c_custkey, score, {_TIER.format('score')} AS status FROM (SELECT c_custkey, {_SCORE} AS score FROM (SELECT {_ROW} FROM customer))")
def completeness_scores(s, d):
    return read(s, d, "customer").selectExpr(_ROW.split(",")[0], *_split(_ROW)[1:]).withColumn("score", completeness()).select("c_custkey", "score", tier(F.col("score")).alias("status"))


def _split(columns: str) -> list[str]:
    """The expressions of a select list: commas inside brackets don't count."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


@query("MA7_honest_score", f"SELECT c_custkey, final AS score, {_TIER.format('final')} AS status FROM (SELECT c_custkey, greatest(0, greatest(0, score - 5 * least(gaps, 4)) - 3 * least(weak, 4)) AS final FROM (SELECT c_custkey, {_SCORE} AS score, CAST(c_custkey % 7 AS INTEGER) AS gaps, CAST(c_custkey % 6 AS INTEGER) AS weak FROM (SELECT {_ROW} FROM customer)))")
def honest_score(s, d):
    """Completeness less 5 for each coverage gap and 3 for each weak field, four of either at most."""
    rows = read(s, d, "customer").selectExpr(*_split(_ROW)).withColumn("gaps", (F.col("c_custkey") % 7).cast("int")).withColumn("weak", (F.col("c_custkey") % 6).cast("int"))
    less = F.greatest(F.lit(0), F.greatest(F.lit(0), completeness() - 5 * F.least("gaps", F.lit(4))) - 3 * F.least("weak", F.lit(4)))
    return rows.withColumn("score", less).select("c_custkey", "score", tier(F.col("score")).alias("status"))


_PRESENT = "c_custkey % 2 > 0 AS skills, c_custkey % 3 > 0 AS experience, c_custkey % 5 > 0 AS education, c_custkey % 7 > 0 AS summary, c_custkey % 11 = 0 AS certifications, c_custkey % 4 AS person"
_CONFIDENCE = """SELECT c_custkey, CASE WHEN person < 2 THEN least(base, 0.55) WHEN NOT experience THEN least(base, 0.5) ELSE base END AS confidence FROM (SELECT *, CASE WHEN required = 700 THEN 1.0::DOUBLE
WHEN person > 0 AND (experience OR education) THEN greatest((required + optional) / 1000.0::DOUBLE, 0.65) ELSE (required + optional) / 1000.0::DOUBLE END AS base FROM (SELECT *,
CASE person WHEN 3 THEN 175 WHEN 0 THEN 0 ELSE 100 END + CASE WHEN skills THEN 175 ELSE 0 END + CASE WHEN experience THEN 175 ELSE 0 END + CASE WHEN education THEN 175 ELSE 0 END AS required,
CASE WHEN summary THEN 150 ELSE 0 END + CASE WHEN certifications THEN 150 ELSE 0 END AS optional FROM (SELECT c_custkey, """ + _PRESENT + " FROM customer)))"


@query("MA5_confidence", _CONFIDENCE)
def confidence(s, d):
    """Weighted presence of fields (thousandths), 1 with all required ones, capped without a name (0.55) or experience (0.5). person: 0 none, 1 e-mail, 2 name, 3 both."""
    rows = read(s, d, "customer").selectExpr("c_custkey", *_split(_PRESENT))
    c = F.col
    required = F.when(c("person") == 3, 175).when(c("person") == 0, 0).otherwise(100) + sum((F.when(c(x), 175).otherwise(0) for x in ("skills", "experience", "education")), F.lit(0))
    optional = sum((F.when(c(x), 150).otherwise(0) for x in ("summary", "certifications")), F.lit(0))
    scored = rows.withColumn("required", required).withColumn("share", (required + optional) / F.lit(1000.0))
    base = F.when(c("required") == 700, 1.0).when((c("person") > 0) & (c("experience") | c("education")), F.greatest("share", F.lit(0.65))).otherwise(c("share"))
    capped = F.when(c("person") < 2, F.least(c("base"), F.lit(0.55))).when(~c("experience"), F.least(c("base"), F.lit(0.5))).otherwise(c("base"))
    return scored.withColumn("base", base).select("c_custkey", capped.alias("confidence"))


#: The share of mandatory skills that a match needs, in per cent.
GATE = 40
_WANTED = "wanted AS (SELECT s_suppkey AS job, unnest(string_split(CASE s_suppkey % 4 WHEN 0 THEN 'steel,standard,large' WHEN 1 THEN 'brass,economy' WHEN 2 THEN 'tin' ELSE '' END, ',')) AS skill FROM supplier)"
_HAS = "has AS (SELECT DISTINCT p_partkey AS candidate, unnest(string_split(lower(p_type), ' ')) AS skill FROM part)"


def wanted_skills(s, d) -> DataFrame:
    """Mandatory skills of each job (supplier)."""
    listed = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'steel,standard,large' WHEN 1 THEN 'brass,economy' WHEN 2 THEN 'tin' ELSE '' END")
    return read(s, d, "supplier").select(F.col("s_suppkey").alias("job"), F.explode(F.split(listed, ",")).alias("skill")).where("skill <> ''")


@query("DM7_requirements", f"""WITH {_WANTED}, {_HAS}, pairs AS (SELECT DISTINCT l_suppkey AS job, l_partkey AS candidate FROM lineitem),
rows AS (SELECT job, pairs.candidate, w.skill, h.skill IS NOT NULL AS matched FROM pairs JOIN wanted w USING (job) LEFT JOIN has h ON h.candidate = pairs.candidate AND h.skill = w.skill WHERE w.skill <> '')
SELECT job, candidate, string_agg(skill || ':' || CASE WHEN matched THEN 'matched' ELSE 'missing' END, ',' ORDER BY skill) AS checklist, 100 * count(*) FILTER (matched) >= {GATE} * count(*) AS passed FROM rows GROUP BY ALL""")
def requirements(s, d):
    """Each applicant's checklist of the job's mandatory skills, and whether enough are matched: joins on job, then on candidate and skill."""
    pairs = read(s, d, "lineitem").select(F.col("l_suppkey").alias("job"), F.col("l_partkey").alias("candidate")).distinct()
    has = read(s, d, "part").select(F.col("p_partkey").alias("candidate"), F.explode(F.array_distinct(F.split(F.lower("p_type"), " "))).alias("skill"), F.lit(True).alias("matched"))
    rows = pairs.join(wanted_skills(s, d), "job").join(has, ["candidate", "skill"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    item = F.concat_ws(":", "skill", F.when(F.col("matched"), "matched").otherwise("missing"))
    return rows.groupBy("job", "candidate").agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("checklist"), (100 * F.count_if("matched") >= GATE * F.count("*")).alias("passed"))


#: Rules of one output record: name, and the condition under which it is broken.
RULES = (("status:required", "status IS NULL OR status = ''"), ("status:enum", "status NOT IN ('F', 'O')"), ("priority:regex", "NOT priority RLIKE '^[1-3]-'"), ("clerk:length", "length(priority) > 8"), ("total:range", "total < 1000 OR total > 300000"), ("date:order", "year < 1993"))
_RULES = [(n, c.replace("NOT priority RLIKE '^[1-3]-'", "NOT regexp_matches(priority, '^[1-3]-')")) for n, c in RULES]


@query("DM23_violations", "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_orderstatus END AS status, o_orderpriority AS priority, o_totalprice AS total, year(o_orderdate) AS year FROM orders) SELECT o_orderkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES) + "], lambda x: x IS NOT NULL), ',') AS violations FROM r")
def violations(s, d):
    """One column for each rule; the broken ones' names in order."""
    rows = read(s, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 10 > 0 THEN o_orderstatus END AS status", "o_orderpriority AS priority", "o_totalprice AS total", "year(o_orderdate) AS year")
    broken = F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in RULES]), lambda x: x.isNotNull())
    return rows.select("o_orderkey", F.array_join(broken, ",").alias("violations"))


_RUNS = "SELECT user_id % 4 AS run_id, event_type <> 'error' AS success, value AS latency, CAST(user_id % 3 AS INTEGER) AS retries, 'p' || (user_id % 2) AS provider FROM events"


@query("AG24_run_statistics", f"SELECT run_id, count(*) AS files, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, round(coalesce(avg(latency) FILTER (success AND latency > 0), 0), 4) AS mean_latency, round(coalesce(avg(retries) FILTER (success), 0), 4) AS mean_retries, count(*) FILTER (success AND provider = 'p0') AS p0, count(*) FILTER (success AND provider = 'p1') AS p1 FROM ({_RUNS}) GROUP BY run_id")
def run_statistics(s, d):
    rows, ok = read(s, d, "events").selectExpr("user_id % 4 AS run_id", "event_type <> 'error' AS success", "value AS latency", "cast(user_id % 3 as int) AS retries", "'p' || (user_id % 2) AS provider"), F.col("success")
    mean = lambda x, on: F.round(F.coalesce(F.avg(F.when(on, x)), F.lit(0.0)), 4)
    return rows.groupBy("run_id").agg(
        F.count("*").alias("files"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), mean(F.col("latency"), ok & (F.col("latency") > 0)).alias("mean_latency"),
        mean(F.col("retries"), ok).alias("mean_retries"), *[F.count_if(ok & (F.col("provider") == p)).alias(p) for p in ("p0", "p1")],
    )


@query("AG35_parsing_benchmark", "WITH c AS (SELECT o_orderkey AS id, o_orderstatus AS kind, o_orderkey % 101 AS score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score, id) AS k FROM c) SELECT kind, count(*) AS n, sum(score)::BIGINT // count(*) AS mean, sum(score) >= 95 * count(*) AS passed, string_agg(CASE WHEN k <= 5 THEN CAST(id AS VARCHAR) END, ',' ORDER BY k) AS worst FROM r GROUP BY kind")
def parsing_benchmark(s, d):
    """Each type's mean, whether it passes, and its five worst cases: the five least are kept while aggregating, no group is sorted."""
    rows = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 101).alias("score"))
    totals = rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("score", "id"))
    worst = rows.withColumn("k", rank).where("k <= 5").groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]), ",").alias("worst"))
    return totals.join(worst, "kind").select("kind", "n", F.expr("total div n").alias("mean"), (F.col("total") >= 95 * F.col("n")).alias("passed"), "worst")


@query("AG36_field_suite", "WITH f AS (SELECT l_orderkey AS id, o_orderstatus AS kind, l_quantity > 10 AS ok, l_extendedprice AS latency FROM lineitem JOIN orders ON o_orderkey = l_orderkey), c AS (SELECT id, kind, count(*) AS total, count(*) FILTER (ok) AS passed, max(latency) AS latency FROM f GROUP BY ALL) SELECT kind, count(*) AS cases, count(*) FILTER (passed = total) AS cases_passed, sum(passed)::BIGINT AS field_pass, sum(total)::BIGINT AS field_total, max(latency) AS slowest FROM c GROUP BY kind")
def field_suite(s, d):
    made = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"))
    fields = read(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") > 10).alias("ok"), F.col("l_extendedprice").alias("latency"))
    cases = fields.groupBy("id").agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.max("latency").alias("latency")).join(made, "id")
    return cases.groupBy("kind").agg(F.count("*").alias("cases"), F.count_if(F.col("passed") == F.col("total")).alias("cases_passed"), F.sum("passed").alias("field_pass"), F.sum("total").alias("field_total"), F.max("latency").alias("slowest"))


#: Categories and signs of failures of the surroundings, which are run again.
OUTAGES, OUTAGE_SIGNS = ("Frontend", "Timeout"), ("err_connection_refused", "err_network_changed", "err_connection_reset", "err_empty_response", "err_aborted", "net::err_", "timeout", "process_error:", "frontend:page.goto", "frontend:page.wait")
#: A checkpoint's line of an event: cut short, of another shape, passed, or failed by a fault or an outage.
_SIGNED = "CASE event_id % 5 WHEN 0 THEN 'net::ERR_FAILED' WHEN 1 THEN 'recall:name' WHEN 2 THEN 'api_timeout' ELSE 'apply:phone' END"
_CATEGORY = "CASE event_id % 6 WHEN 0 THEN 'Frontend' WHEN 1 THEN 'Parser' WHEN 2 THEN 'Timeout' ELSE 'Validation' END"


@query("WN12_checkpoint", f"""WITH l AS (SELECT 'c' || (user_id % 50) AS case_id, event_id AS line, event_type = 'purchase' AS passed, event_type = 'signup' AS unsupported, {_CATEGORY} AS category, {_SIGNED} AS signature FROM events WHERE event_id % 7 > 0 AND event_id % 11 > 0),
o AS (SELECT *, NOT passed AND NOT unsupported AND (category IN ('Frontend', 'Timeout') OR {' OR '.join(f"contains(lower(signature), '{x}')" for x in OUTAGE_SIGNS)}) AS outage FROM l)
SELECT case_id, CASE WHEN count(*) FILTER (NOT outage) > 0 THEN 'done' ELSE 'again' END AS state, arg_max(category, line) FILTER (NOT outage) AS category, max(line) FILTER (NOT outage) AS line, count(*) FILTER (outage) AS dropped FROM o GROUP BY case_id""")
def checkpoint(s, d):
    """Each case's last whole line that no outage spoilt, and how many did; a case that has none is run again. Lines that aren't JSON or name no case are skipped."""
    record = F.to_json(F.struct(F.expr("CASE WHEN event_id % 11 > 0 THEN 'c' || (user_id % 50) END AS case_id"), F.expr("event_type = 'purchase' AS passed"), F.expr("event_type = 'signup' AS unsupported"), F.expr(f"{_CATEGORY} AS category"), F.expr(f"{_SIGNED} AS signature")))
    lines = read(s, d, "events").select(F.col("event_id").alias("line"), F.when(F.col("event_id") % 7 == 0, F.lit('{"case_id": "c')).otherwise(record).alias("text"))
    rows = lines.select("line", F.from_json("text", "case_id string, passed boolean, unsupported boolean, category string, signature string").alias("r")).select("line", "r.*").where("case_id is not null")
    signed = F.lit(False)
    for sign in OUTAGE_SIGNS:
        signed = signed | F.lower("signature").contains(sign)
    outage = ~F.coalesce("passed", F.lit(False)) & ~F.coalesce("unsupported", F.lit(False)) & (F.trim("category").isin(*OUTAGES) | signed)
    told = rows.withColumn("outage", F.coalesce(outage, F.lit(False)))
    whole = F.when(~F.col("outage"), F.col("line"))
    return told.groupBy("case_id").agg(F.when(F.count(whole) > 0, "done").otherwise("again").alias("state"), F.max_by("category", whole).alias("category"), F.max(whole).alias("line"), F.count_if("outage").alias("dropped"))


@query("SNK7_reports", "SELECT 'statistics' AS report, '{\"files\":' || count(*) || ',\"chars\":' || sum(n_chars)::BIGINT || '}' AS body FROM documents UNION ALL SELECT 'sources', '{\"sources\":' || count(DISTINCT source) || ',\"langs\":' || count(DISTINCT lang) || '}' FROM documents")
def reports(s, d):
    """Reports as one JSON record each, ready to be written as text."""
    rows = read(s, d, "documents")
    made = {"statistics": rows.agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars")), "sources": rows.agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))}
    parts = [frame.select(F.lit(name).alias("report"), F.to_json(F.struct("*")).alias("body")) for name, frame in made.items()]
    return parts[0].unionByName(parts[1])


_CLEANED = "x"
for _pattern, _by in html.CLEANING:
    _CLEANED = f"regexp_replace({_CLEANED}, '{_pattern}', '{_by.replace('$', chr(92))}', 'g')"


@query("SRC8_visible_text", f"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is){"|".join(f"<{tag}{chr(92)}b.*?</{tag}{chr(92)}s*>" for tag in html.HIDDEN)}', '', 'g') AS x FROM pages),
l AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[\\r\\n]', ' ', 'g'), '(?i)</?(?:{html.BLOCKS})\\b[^>]*>', chr(10), 'g'), '(?i)<t[dh]\\b[^>]*>', ' | ', 'g'), '(?s)<[^>]*>', '', 'g') AS x FROM t),
e AS (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&middot(?:;|\\b)', '·', 'g'), '&copy(?:;|\\b)', '©', 'g'), '&quot(?:;|\\b)', '"', 'g'), '&amp(?:;|\\b)', '&', 'g'), chr(160), ' ') AS x FROM l)
SELECT page_id, {_CLEANED} AS text FROM e""")
def visible_text(s, d):
    """Page text by expressions: hidden elements go, blocks are lines, cells stand apart, references are read. What extraction of the main text needs beyond that is an operator of its own.

    The SQL knows the four references that the pages hold."""
    return read(s, d, "pages").select("page_id", html.visible(F.col("html")).alias("text"))


@query("STR5_single_flight", """WITH RECURSIVE e AS (SELECT event_id, ts, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_type, k, event_id, ts AS opened, true AS runs FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_type, e.k, e.event_id, CASE WHEN e.ts > w.opened + INTERVAL 1 DAY THEN e.ts ELSE w.opened END, e.ts > w.opened + INTERVAL 1 DAY FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.k = w.k + 1)
SELECT event_id FROM w WHERE runs""")
def single_flight(s, d):
    """The calls that run: others of their key within a day of one that ran join it. Which ones run depends on those before: a key's calls are
    folded in order, with the last one that ran as state."""
    day = 86_400_000_000

    def step(opened: tuple[int | None], row: tuple[int]) -> tuple[tuple[int | None], tuple[bool]]:
        runs = opened[0] is None or row[0] > opened[0] + day
        return (row if runs else opened), (runs,)

    calls = read(s, d, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return ordered_fold(calls, ["user_id", "event_type"], ["us", "event_id"], "runs boolean", lambda: (None,), step, ["us"]).where("runs").select("event_id")


@query("DM19_generated_gold", "SELECT i, ['ann', 'ben', 'eve'][i % 3 + 1] || ' ' || ['rao', 'khan'][i // 3 % 2 + 1] AS name, ['sql', 'go', 'java', 'rust'][i % 4 + 1] || ',' || ['etl', 'ml'][i % 2 + 1] AS skills, 2000 + i % 20 AS year FROM range((SELECT count(*) FROM nation) * 40) t(i)")
def generated_gold(s, d):
    """Cases drawn from pools by index arithmetic: forty an organisation."""
    n = read(s, d, "nation").count() * 40
    pick = lambda pool, at: F.get(F.array(*[F.lit(x) for x in pool]), at.cast("int"))
    i = F.col("id")
    return s.range(n).select(i.alias("i"), F.concat_ws(" ", pick(("ann", "ben", "eve"), i % 3), pick(("rao", "khan"), F.expr("id div 3") % 2)).alias("name"), F.concat_ws(",", pick(("sql", "go", "java", "rust"), i % 4), pick(("etl", "ml"), i % 2)).alias("skills"), (2000 + i % 20).alias("year"))


#: Words of unsupported files and of lost texts, fields whose groundless values are the parser's; characters of a text that is one.
UNSUPPORTED, LOST, IDENTITY, LEAST_TEXT = ("unsupported", "invalid file type", "legacy .doc"), ("extract", "ocr", "empty text", "no text", "pymupdf", "pdf"), ("fullName", "email", "phone"), 40


def failure(r: Column) -> Column:
    """(category, signature) of a failed case: the first rule that fits. ``r`` has timed_out, frontend_error, status, parse_error, api_error, answered, api_ok, chars, form, parity, mapped, recall, ungrounded, invalid array, shown."""
    text = lambda c: F.coalesce(r[c], F.lit(""))
    both = F.lower(F.concat_ws(" ", text("parse_error"), text("api_error")))
    holds = lambda x, words: F.coalesce(*[F.when(x.contains(w), True) for w in words], F.lit(False))
    told = lambda category, *sign: F.struct(F.lit(category).alias("category"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in sign]).alias("signature"))
    failed = (r["status"] == "error") | (r["answered"] & ~r["api_ok"])
    identity = r["ungrounded"].isin(*IDENTITY) | r["ungrounded"].startswith("education")
    return (
        F.when(r["timed_out"], told("Timeout", "timeout")).when(text("frontend_error") != "", told("Frontend", "frontend:", F.substring(r["frontend_error"], 1, 80))).when(holds(F.lower(text("parse_error")), UNSUPPORTED), told("Unsupported document", "unsupported"))
        .when(failed & holds(both, LOST), told("OCR/Text extraction", "extract:", F.substring(both, 1, 100))).when(failed & holds(both, ("timeout", "timed out")), told("Timeout", "api_timeout")).when(failed, told("Parser", "parse_error:", F.substring(both, 1, 100)))
        .when(r["chars"] < LEAST_TEXT, told("OCR/Text extraction", "short_text:", r["chars"].cast("string"))).when(~r["answered"] | ~r["form"], told("Mapping", "missing_form_dto")).when(r["parity"].isNotNull(), told("Autofill", "parity:", r["parity"])).when(~r["mapped"], told("Mapping", "canonical_not_mapped"))
        .when(r["recall"].isNotNull(), told("Parser", "recall:", r["recall"])).when(identity, told("Parser", "ungrounded:", r["ungrounded"])).when(r["ungrounded"].isNotNull(), told("Canonical model", "ungrounded:", r["ungrounded"]))
        .when(F.size(r["invalid"]) > 0, told("Validation", "apply:", F.array_join(F.array_sort(r["invalid"]), ","))).when(~r["shown"], told("Frontend", "screenshot_failed")).otherwise(told("Other", "unspecified"))
    )


#: A case's outcome, written out of an event: each part fails for some of them.
_OUTCOME = {
    "timed_out": "event_id % 29 = 0", "frontend_error": "CASE WHEN event_id % 23 = 0 THEN 'page.goto ' || event_type END", "status": "CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'ok' END",
    "parse_error": "CASE event_id % 17 WHEN 0 THEN 'Unsupported kind' WHEN 7 THEN 'OCR gave nothing' WHEN 14 THEN 'Timed out' WHEN 3 THEN 'odd ' || event_type END", "api_error": "CASE WHEN event_id % 4 = 0 THEN 'No text' ELSE '' END", "answered": "event_id % 13 > 0", "api_ok": "event_id % 5 > 0",
    "chars": "CAST(user_id AS INT)", "form": "event_id % 11 > 0", "parity": "CASE WHEN event_id % 19 = 1 THEN event_type END", "mapped": "event_id % 9 > 0", "recall": "CASE WHEN event_id % 8 = 3 THEN 'name' END",
    "ungrounded": "CASE event_id % 12 WHEN 5 THEN 'email' WHEN 6 THEN 'education.0' WHEN 7 THEN 'skills' END", "shown": "event_id % 6 > 0",
}
_BOTH = "lower(coalesce(parse_error, '') || ' ' || coalesce(api_error, ''))"
_ANY = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
_LOST_SQL, _FAILED = _ANY(_BOTH, LOST), "(status = 'error' OR (answered AND NOT api_ok))"


@query("DM18_failure_class", f"""WITH r AS (SELECT {', '.join(f'{x} AS {k}' for k, x in _OUTCOME.items())}, CASE WHEN event_id % 10 < 3 THEN ['phone', 'email'] ELSE [] END AS invalid FROM events),
t AS (SELECT CASE WHEN timed_out THEN ['Timeout', 'timeout'] WHEN frontend_error IS NOT NULL THEN ['Frontend', 'frontend:' || substr(frontend_error, 1, 80)] WHEN {_ANY("lower(coalesce(parse_error, ''))", UNSUPPORTED)} THEN ['Unsupported document', 'unsupported']
WHEN {_FAILED} AND {_LOST_SQL} THEN ['OCR/Text extraction', 'extract:' || substr({_BOTH}, 1, 100)] WHEN {_FAILED} AND {_ANY(_BOTH, ('timeout', 'timed out'))} THEN ['Timeout', 'api_timeout'] WHEN {_FAILED} THEN ['Parser', 'parse_error:' || substr({_BOTH}, 1, 100)]
WHEN chars < {LEAST_TEXT} THEN ['OCR/Text extraction', 'short_text:' || chars] WHEN NOT answered OR NOT form THEN ['Mapping', 'missing_form_dto'] WHEN parity IS NOT NULL THEN ['Autofill', 'parity:' || parity] WHEN NOT mapped THEN ['Mapping', 'canonical_not_mapped']
WHEN recall IS NOT NULL THEN ['Parser', 'recall:' || recall] WHEN ungrounded IN ('fullName', 'email', 'phone') OR starts_with(ungrounded, 'education') THEN ['Parser', 'ungrounded:' || ungrounded] WHEN ungrounded IS NOT NULL THEN ['Canonical model', 'ungrounded:' || ungrounded]
WHEN len(invalid) > 0 THEN ['Validation', 'apply:' || array_to_string(list_sort(invalid), ',')] WHEN NOT shown THEN ['Frontend', 'screenshot_failed'] ELSE ['Other', 'unspecified'] END AS c FROM r) SELECT c[1] AS category, c[2] AS signature, count(*) AS n FROM t GROUP BY ALL""")
def failure_class(s, d):
    """Failures by category and signature."""
    invalid = "CASE WHEN event_id % 10 < 3 THEN array('phone', 'email') ELSE cast(array() AS array<string>) END AS invalid"
    rows = read(s, d, "events").selectExpr(*[f"{x} AS {k}" for k, x in _OUTCOME.items()], invalid).select(F.struct("*").alias("r"))
    return rows.select(failure(F.col("r")).alias("f")).groupBy("f.category", "f.signature").agg(F.count("*").alias("n"))


@query("DM14_merge_records", "WITH r AS (SELECT l_orderkey AS id, l_suppkey AS company, l_linenumber AS n, CASE WHEN l_quantity > 25 THEN l_returnflag END AS title, CASE WHEN l_discount > 0.05 THEN l_linestatus END AS place, l_quantity AS confidence, l_partkey FROM lineitem) SELECT id, company, count(*) AS merged, max_by(title, (confidence, n, l_partkey)) FILTER (title IS NOT NULL) AS title, max_by(place, (confidence, n, l_partkey)) FILTER (place IS NOT NULL) AS place FROM r GROUP BY id, company")
def merge_records(s, d):
    """Records of one job become one: every slot takes the value of the surest record that has one."""
    rows = read(s, d, "lineitem").selectExpr("l_orderkey AS id", "l_suppkey AS company", "l_linenumber AS n", "CASE WHEN l_quantity > 25 THEN l_returnflag END AS title", "CASE WHEN l_discount > 0.05 THEN l_linestatus END AS place", "l_quantity AS confidence", "l_partkey")
    surest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("confidence", "n", "l_partkey"))).alias(c)
    return rows.groupBy("id", "company").agg(F.count("*").alias("merged"), surest("title"), surest("place"))
