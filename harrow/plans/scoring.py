"""Candidate to job scoring: skills, experience, education, location, and the weighted whole, in tenths of a per cent.

A pair is an applicant (part) and a job (order); what a job asks for and a candidate offers are written out of the rows' columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators.relational import spread
from harrow.plans.registry import query
from harrow.plans.tables import read

#: Weights of the parts in per cent; bands and the gate on mandatory skills; the cap without evidence; what counts as a degree.
WEIGHTS = {"skills": 60, "experience": 25, "education": 10, "location": 5}
MANDATORY, PREFERRED = 40, 20
STRONG, POTENTIAL, GATE, CAP = 800, 400, 400, 500
DEGREE = "\\b(?:bachelor|b\\.?s\\.?|b\\.?e\\.?|m\\.?s\\.?|m\\.?a\\.?|mba|phd|degree|diploma)\\b"

#: A job's and a candidate's facts, as both engines read them.
JOB = {
    "mandatory": "CASE o_orderkey % 4 WHEN 0 THEN 'steel,large' WHEN 1 THEN 'brass,standard,tin' WHEN 2 THEN 'copper' ELSE '' END",
    "preferred": "CASE o_orderkey % 3 WHEN 0 THEN 'economy,promo' WHEN 1 THEN 'small' ELSE '' END",
    "title": "CASE o_orderkey % 5 WHEN 0 THEN 'brass worker' WHEN 1 THEN 'steel' WHEN 2 THEN 'promo lead' WHEN 3 THEN 'tin' ELSE '' END",
    "min_years": "CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 20 AS INT) END",
    "max_years": "CASE WHEN o_orderkey % 2 > 0 THEN CAST(o_orderkey % 20 AS INT) + 10 END",
    "qualification": "CASE o_orderkey % 3 WHEN 0 THEN 'a Bachelor in anything' WHEN 1 THEN 'MBA' ELSE 'none' END",
    "place": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'new york' WHEN 2 THEN 'york' ELSE 'berlin, germany' END",
}
CANDIDATE = {
    "skills": "lower(p_type)",
    "roles": "CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN lower(p_type) ELSE lower(p_type) || ',brass worker,clerk' END",
    "years": "CASE WHEN p_size % 4 > 0 THEN CAST(p_size AS INT) END",
    "degree": "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'phd' WHEN 2 THEN 'school' ELSE 'b.e. civil' END",
    "home": "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'york, germany' WHEN 2 THEN 'new york 10001' WHEN 3 THEN 'berlin' ELSE 'rome' END",
}


def _facts(facts: dict[str, str]) -> list[str]:
    return [f"{x} AS {name}" for name, x in facts.items()]


_BASE = f"""job AS (SELECT o_orderkey AS job_id, {', '.join(_facts(JOB))} FROM orders), cand AS (SELECT p_partkey AS candidate_id, {', '.join(_facts(CANDIDATE))} FROM part),
pair AS (SELECT DISTINCT l_orderkey AS job_id, l_partkey AS candidate_id FROM lineitem),
wanted AS (SELECT job_id, kind, unnest(string_split(list, ',')) AS skill FROM (SELECT job_id, 'm' AS kind, mandatory AS list FROM job UNION ALL SELECT job_id, 'p', preferred FROM job) WHERE list <> ''),
has AS (SELECT DISTINCT candidate_id, unnest(string_split(skills, ' ')) AS skill FROM cand),
counted AS (SELECT pair.job_id, pair.candidate_id, count(*) FILTER (kind = 'm') AS m, count(*) FILTER (kind = 'm' AND has.skill IS NOT NULL) AS mm, count(*) FILTER (kind = 'p') AS p, count(*) FILTER (kind = 'p' AND has.skill IS NOT NULL) AS pm
  FROM pair LEFT JOIN wanted USING (job_id) LEFT JOIN has ON has.candidate_id = pair.candidate_id AND has.skill = wanted.skill GROUP BY ALL),
shares AS (SELECT job_id, candidate_id, m, mm, pm, CASE WHEN m > 0 THEN (2000 * mm + m) // (2 * m) ELSE 1000 END AS mandatory_share,
  CASE WHEN m = 0 AND p = 0 THEN {CAP} WHEN p = 0 THEN (2000 * mm + m) // (2 * m) WHEN m = 0 THEN (2000 * pm + p) // (2 * p) ELSE (2000 * ({MANDATORY} * mm * p + {PREFERRED} * pm * m) + 60 * m * p) // (120 * m * p) END AS skills FROM counted),
facts AS (SELECT s.*, j.title, j.min_years, j.max_years, j.qualification, j.place, c.roles, c.years, c.degree, c.home FROM shares s JOIN job j USING (job_id) JOIN cand c USING (candidate_id)),
parts AS (SELECT *, CASE WHEN roles = '' AND years IS NULL THEN 0 WHEN roles <> '' AND title <> '' THEN CASE WHEN len(list_filter(string_split(roles, ','), lambda r: contains(r, title) OR contains(title, r))) > 0 THEN 1000 ELSE least(500, 200 + 100 * least(len(string_split(roles, ',')), 3)) END
    WHEN years IS NOT NULL AND min_years IS NOT NULL THEN CASE WHEN years < min_years THEN greatest(0, 500 - 100 * (min_years - years)) WHEN max_years IS NULL OR years <= max_years THEN 500 ELSE 400 END
    WHEN years IS NOT NULL AND max_years IS NOT NULL THEN 400 ELSE 0 END AS experience,
  CASE WHEN NOT regexp_matches(lower(qualification), '{DEGREE}') THEN 1000 WHEN degree = '' THEN 0 WHEN regexp_matches(degree, '{DEGREE}') THEN 1000 ELSE 500 END AS education,
  CASE WHEN place = '' THEN 1000 WHEN home = '' THEN {CAP} ELSE (1000 * (len(jp) + len(list_intersect(jp, cp))) + len(jp)) // (2 * len(jp)) END AS location
  FROM (SELECT *, list_distinct(regexp_extract_all(place, '[a-z]+')) AS jp, list_distinct(regexp_extract_all(home, '[a-z]+')) AS cp FROM facts)),
whole AS (SELECT *, least(1000, greatest(0, (60 * skills + 25 * experience + 10 * education + 5 * location + 50) // 100)) AS overall FROM parts)"""


def jobs_asked(s, d) -> DataFrame:
    return read(s, d, "orders").selectExpr("o_orderkey AS job_id", *_facts(JOB))


def candidates(s, d) -> DataFrame:
    return read(s, d, "part").selectExpr("p_partkey AS candidate_id", *_facts(CANDIDATE))


def pairs(s, d) -> DataFrame:
    # dealt by job, which the join with the jobs needs next
    return spread(read(s, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("candidate_id")), "job_id").distinct()


def skill_rows(s, d) -> DataFrame:
    """(job_id, candidate_id, kind, skill, matched) of every pair and skill that its job asks for: equi-joins on job, then on candidate and skill."""
    job = jobs_asked(s, d)
    listed = F.array(F.struct(F.lit("m").alias("kind"), F.col("mandatory").alias("list")), F.struct(F.lit("p").alias("kind"), F.col("preferred").alias("list")))
    wanted = job.select("job_id", F.explode(listed).alias("l")).where("l.list <> ''").select("job_id", "l.kind", F.explode(F.split("l.list", ",")).alias("skill"))
    has = candidates(s, d).select("candidate_id", F.explode(F.array_distinct(F.split("skills", " "))).alias("skill"), F.lit(True).alias("matched"))
    return pairs(s, d).join(wanted, "job_id", "left").join(has, ["candidate_id", "skill"], "left")


def share(part: Column, whole: Column) -> Column:
    """part / whole in tenths of a per cent, rounded half up; both are whole numbers."""
    return F.floor((2000 * part + whole) / (2 * whole)).cast("long")


def skills_score(m: Column, mm: Column, p: Column, pm: Column) -> Column:
    """Mandatory and preferred skills matched, two to one; one of them alone where the other isn't asked for; the cap where neither is."""
    both = F.floor((2000 * (MANDATORY * mm * p + PREFERRED * pm * m) + 60 * m * p) / (120 * m * p)).cast("long")
    return F.when((m == 0) & (p == 0), CAP).when(p == 0, share(mm, m)).when(m == 0, share(pm, p)).otherwise(both)


def experience_score() -> Column:
    """Full marks where a role holds the title or it the role; half of them at most for other roles, or by the years alone."""
    roles, title, years, low, high = (F.col(c) for c in ("roles", "title", "years", "min_years", "max_years"))
    named = F.split(roles, ",")
    direct = F.exists(named, lambda r: r.contains(title) | title.contains(r))
    by_roles = F.when(direct, 1000).otherwise(F.least(F.lit(500), 200 + 100 * F.least(F.size(named), F.lit(3))))
    by_years = F.when(years < low, F.greatest(F.lit(0), 500 - 100 * (low - years))).when(high.isNull() | (years <= high), 500).otherwise(400)
    return F.when((roles == "") & years.isNull(), 0).when((roles != "") & (title != ""), by_roles).when(years.isNotNull() & low.isNotNull(), by_years).when(years.isNotNull() & high.isNotNull(), 400).otherwise(0)


def education_score() -> Column:
    asked, degree = F.lower("qualification").rlike(DEGREE), F.col("degree")
    return F.when(~asked, 1000).when(degree == "", 0).when(degree.rlike(DEGREE), 1000).otherwise(500)


def location_score() -> Column:
    """Half, and the other half by the share of the job's place words; all without a place asked for, the cap without one given."""
    letters = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0)))
    asked, both = F.size(letters(F.col("place"))), F.size(F.array_intersect(letters(F.col("place")), letters(F.col("home"))))
    return F.when(F.col("place") == "", 1000).when(F.col("home") == "", CAP).otherwise(F.floor((1000 * (asked + both) + asked) / (2 * asked)))


def parts(s, d) -> DataFrame:
    """Every pair with its scores. A pair meets its job's and its candidate's row once, and what they share is counted in that row; neither side is broadcast."""
    listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    asked = jobs_asked(s, d).withColumns({"mandatory": listed("mandatory"), "preferred": listed("preferred")})
    offered = candidates(s, d).withColumn("offered", F.split("skills", " ")).drop("skills")
    met = pairs(s, d).join(asked.hint("merge"), "job_id").join(offered.hint("merge"), "candidate_id")
    n, hits = lambda c: F.size(c).cast("long"), lambda c: F.size(F.filter(c, lambda x: F.array_contains("offered", x))).cast("long")
    counted = met.withColumns({"m": n("mandatory"), "mm": hits("mandatory"), "p": n("preferred"), "pm": hits("preferred")})
    m, mm, p, pm = (F.col(c) for c in ("m", "mm", "p", "pm"))
    whole = counted.withColumns({"mandatory_share": F.when(m > 0, share(mm, m)).otherwise(1000), "skills": skills_score(m, mm, p, pm).cast("long")})
    return whole.select("job_id", "candidate_id", "m", "mm", "pm", "mandatory_share", "skills", experience_score().cast("long").alias("experience"), education_score().cast("long").alias("education"), location_score().cast("long").alias("location"))


def overall() -> Column:
    total = sum((F.col(name) * weight for name, weight in WEIGHTS.items()), F.lit(50))
    return F.least(F.lit(1000), F.greatest(F.lit(0), F.floor(total / 100))).cast("long")


def verdict(score: Column, mandatory: Column, asked: Column) -> Column:
    """No match under the gate on mandatory skills, whatever the score; else by bands."""
    return F.when(asked & (mandatory < GATE), "not_a_match").when(score >= STRONG, "strong").when(score >= POTENTIAL, "potential").otherwise("not_a_match")


KEY = ("job_id", "candidate_id")


@query("JN14_skill_match", f"WITH {_BASE} SELECT job_id, candidate_id, mm AS mandatory, pm AS preferred FROM shares WHERE mm + pm > 0")
def skill_match(s, d):
    """Pairs of candidate and job that share skills, counted by kind."""
    rows = skill_rows(s, d).where("matched").groupBy(*KEY)
    return rows.agg(F.count_if(F.col("kind") == "m").alias("mandatory"), F.count_if(F.col("kind") == "p").alias("preferred"))


@query("DM1_skills", f"WITH {_BASE} SELECT job_id, candidate_id, mandatory_share::BIGINT AS mandatory_share, skills::BIGINT AS skills FROM parts")
def skills(s, d):
    return parts(s, d).select(*KEY, "mandatory_share", "skills")


@query("DM2_experience", f"WITH {_BASE} SELECT job_id, candidate_id, experience::BIGINT AS experience FROM parts")
def experience(s, d):
    return parts(s, d).select(*KEY, "experience")


@query("DM3_education", f"WITH {_BASE} SELECT job_id, candidate_id, education::BIGINT AS education FROM parts")
def education(s, d):
    return parts(s, d).select(*KEY, "education")


@query("DM4_location", f"WITH {_BASE} SELECT job_id, candidate_id, location::BIGINT AS location FROM parts")
def location(s, d):
    return parts(s, d).select(*KEY, "location")


@query("DM5_overall", f"WITH {_BASE} SELECT job_id, candidate_id, overall::BIGINT AS overall, CASE WHEN m > 0 AND mandatory_share < {GATE} THEN 'not_a_match' WHEN overall >= {STRONG} THEN 'strong' WHEN overall >= {POTENTIAL} THEN 'potential' ELSE 'not_a_match' END AS verdict FROM whole")
def whole(s, d):
    return parts(s, d).withColumn("overall", overall()).select(*KEY, "overall", verdict(F.col("overall"), F.col("mandatory_share"), F.col("m") > 0).alias("verdict"))


@query("DM6_reconcile", f"WITH {_BASE}, stored AS (SELECT *, (job_id * 7 + candidate_id * 13) % 1001 AS stored, job_id % 10 = 0 AS noisy FROM whole) SELECT job_id, candidate_id, CASE WHEN (noisy OR abs(overall - stored) >= 50) AND abs(overall - stored) >= 10 THEN overall ELSE stored END::BIGINT AS kept, (noisy OR abs(overall - stored) >= 50) AND abs(overall - stored) >= 10 AS adjusted FROM stored")
def reconcile(s, d):
    """A stored score gives way to the recomputed one where they are five apart, or where noise was filtered, and one at least."""
    rows = parts(s, d).withColumn("overall", overall()).withColumn("stored", (F.col("job_id") * 7 + F.col("candidate_id") * 13) % 1001)
    apart = F.abs(F.col("overall") - F.col("stored"))
    adjusted = ((F.col("job_id") % 10 == 0) | (apart >= 50)) & (apart >= 10)
    return rows.select(*KEY, F.when(adjusted, F.col("overall")).otherwise(F.col("stored")).alias("kept"), adjusted.alias("adjusted"))


@query("AG37_experience_years", "SELECT k, (sum(m) // 12)::BIGINT AS years FROM (SELECT DISTINCT l_partkey AS k, l_suppkey AS r, l_linenumber AS m FROM lineitem WHERE l_linenumber <= 480) GROUP BY k")
def experience_years(s, d):
    """Months of distinct positions, summed, not merged, in whole years."""
    rows = read(s, d, "lineitem").where("l_linenumber <= 480").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("r"), F.col("l_linenumber").alias("m")).distinct()
    return rows.groupBy("k").agg(F.expr("sum(m) div 12").alias("years"))


@query("DM15_grounding", "SELECT doc_id, contains(lower(text), lower(lang)) AS has_lang, contains(lower(text), lower(source)) AS has_source, contains(regexp_replace(text, '[^0-9]', '', 'g'), CAST(n_chars AS VARCHAR)) AS has_number, contains(regexp_replace(lower(text), 'https?://|www\\.', '', 'g'), 'example.') AS has_site FROM documents")
def grounding(s, d):
    """A stored value is grounded where the text holds it: words as they are, numbers by their digits, addresses without scheme and www."""
    text = F.lower("text")
    bare = F.regexp_replace(text, "https?://|www\\.", "")
    return read(s, d, "documents").select("doc_id", text.contains(F.lower("lang")).alias("has_lang"), text.contains(F.lower("source")).alias("has_source"), F.regexp_replace("text", "[^0-9]", "").contains(F.col("n_chars").cast("string")).alias("has_number"), bare.contains("example.").alias("has_site"))
