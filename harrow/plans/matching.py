"""Scores of lists against lists, phrases in texts, names within names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import values as v
from harrow.operators import matching as op
from harrow.operators.relational import spread
from harrow.plans import registry, resumes, values
from harrow.plans.registry import query
from harrow.plans.tables import read
from harrow.plans.values import _norm, _pairs, _tokens

#: What was found of a part's skills: all, some under other names, category labels, nothing.
_FOUND = f"CASE p_partkey % 6 WHEN 0 THEN {values._CELL} WHEN 1 THEN 'JavaScript developer, c++; kafka' WHEN 2 THEN '' WHEN 3 THEN 'TECHNICAL SKILLS, ' || lower(p_type) || ' | tools' WHEN 4 THEN 'kubernetes cluster / sql server admin' ELSE lower(p_brand) || ', js' END"


def _skill_lists(side: str, cell: str, kept: str) -> str:
    """CTEs up to ``<side>list`` (p_partkey, l): the distinct skills of a cell in order."""
    steps = re.sub(r"\b(cells|part_rows|cut|bare|pieces|normed|keys|firsts)\b", side + r"\1", values._SPLIT_STEPS)
    return f"{side}cells AS (SELECT p_partkey, {cell} AS x FROM part), {steps}, {side}list AS (SELECT p_partkey, list(k ORDER BY {kept}) FILTER ({kept} IS NOT NULL) AS l FROM {side}firsts GROUP BY p_partkey)"


def _matched(x: str, others: str) -> str:
    return f"len(list_filter({others}, lambda y: y = {x} OR contains(y, {x}) OR contains({x}, y) OR list_has_all(string_split(y, ' '), string_split({x}, ' ')) OR list_has_all(string_split({x}, ' '), string_split(y, ' ')))) > 0"


_SKILLS = f"""{_skill_lists('g_', values._HEADED, 'gold_place')}, {_skill_lists('f_', _FOUND, 'place')},
lists AS (SELECT p_partkey, coalesce(g.l, []) AS g, coalesce(f.l, []) AS f FROM part LEFT JOIN g_list g USING (p_partkey) LEFT JOIN f_list f USING (p_partkey)),
told AS (SELECT *, list_filter(g, lambda x: NOT ({_matched('x', 'f')})) AS missed, list_filter(f, lambda x: NOT ({_matched('x', 'g')})) AS extra FROM lists),
shares AS (SELECT *, CASE WHEN len(g) = 0 AND len(f) = 0 THEN 1.0::DOUBLE WHEN len(g) = 0 OR len(f) = 0 THEN 0.0 ELSE 1 - len(missed)::DOUBLE / len(g) END AS recall, CASE WHEN len(g) = 0 AND len(f) = 0 THEN 1.0::DOUBLE WHEN len(g) = 0 OR len(f) = 0 THEN 0.0 ELSE 1 - len(extra)::DOUBLE / len(f) END AS precision FROM told),
skills AS (SELECT p_partkey, precision, recall, CASE WHEN len(g) = 0 THEN 1.0::DOUBLE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS score, array_to_string(missed, ',') AS missed, array_to_string(extra, ',') AS extra FROM shares)"""


def _skill_scores(s, d, *kept: str) -> DataFrame:
    return op.skill_scores(spread(read(s, d, "part"), "p_partkey").selectExpr("p_partkey", f"{values._HEADED} AS gold", f"{_FOUND} AS found"), "p_partkey", "gold", "found", *kept)


@query("DM16_skills", f"WITH {_SKILLS} SELECT p_partkey, round(precision, 9) AS precision, round(recall, 9) AS recall, round(score, 9) AS score, missed, extra FROM skills")
def skills(s, d):
    """Precision, recall, score, missed and extra skills of each part's cell. The SQL leaves out likeness, which decides none of these."""
    whole = lambda c: F.round(c, 9).alias(c)
    return _skill_scores(s, d).select("p_partkey", whole("precision"), whole("recall"), whole("score"), F.array_join("missed", ",").alias("missed"), F.array_join("extra", ",").alias("extra"))


@query("DM16_likeness")
def likeness(s, d):
    """The same with misspelt skills, which only likeness finds; the tests compare it with a loop."""
    slip = lambda c: F.when(F.length(c) > 5, F.concat(F.substring(c, 1, 4), F.substring(c, 4, 99))).otherwise(c)
    rows = spread(read(s, d, "part"), "p_partkey").select("p_partkey", F.concat_ws(", ", F.lower("p_type"), "p_name").alias("gold"), F.concat_ws("; ", slip(F.lower(F.col("p_type"))), slip(F.col("p_name"))).alias("found"))
    return op.skill_scores(rows, "p_partkey", "gold", "found").select("p_partkey", "score", F.array_join("missed", ",").alias("missed"), F.array_join("extra", ",").alias("extra"))


def _gold_jobs(s, d) -> DataFrame:
    """(id, entry, facts, years): the jobs that a customer's résumé was written from."""
    jobs = spread(read(s, d, "orders").selectExpr("o_custkey AS id", "o_orderkey", "o_orderstatus", "CAST(year(o_orderdate) AS STRING) AS y"), "id").selectExpr("id", "o_orderkey AS entry", f"{resumes._ROLES} AS role", f"{resumes._FIRM} AS firm", "y", "o_orderkey % 6 = 2 AS nameless")
    return jobs.select("id", "entry", F.when(F.col("nameless"), F.array(v.norm(F.col("role")))).otherwise(F.array(v.norm(F.col("role")), v.norm(F.col("firm")))).alias("facts"), F.array("y").alias("years"))


_ROW_TEXT = _norm("regexp_replace(trim(title || ' ' || company), ' +', ' ', 'g')")
_SECTIONS = f"""gold AS (SELECT id, entry, CASE WHEN nameless THEN [{_norm('role')}] ELSE [{_norm('role')}, {_norm('firm')}] END AS facts, y FROM (SELECT o_custkey AS id, o_orderkey AS entry, {resumes._ROLES} AS role, {resumes._FIRM} AS firm, CAST(year(o_orderdate) AS VARCHAR) AS y, o_orderkey % 6 = 2 AS nameless FROM orders)),
listed AS (SELECT id, flatten(list(facts)) AS facts, list_distinct(list(y)) AS years, count(*) AS entries FROM gold WHERE id IN (SELECT id FROM parsed) GROUP BY id),
rows AS (SELECT id, {_ROW_TEXT} AS text, list_filter([{_norm('title')}, {_norm('company')}], lambda x: length(x) >= 3) AS strings, list_filter([substr(start_month, 1, 4), substr(end_month, 1, 4)], lambda y: regexp_matches(y, '^[0-9]{{4}}$')) AS years FROM parsed),
seen AS (SELECT id, list(text) AS texts, flatten(list(strings)) AS strings, list_distinct(flatten(list(years))) AS years, count(*) AS n FROM rows GROUP BY id),
joined AS (SELECT l.id, l.facts, l.years, l.entries, s.texts, s.strings, s.years AS found, s.n, {_tokens("array_to_string(l.facts, ' ')")} AS blob FROM listed l JOIN seen s USING (id)),
facts AS (SELECT id, unnest(facts) AS a, strings FROM joined),
told AS (SELECT id, count(*) AS n, count(*) FILTER (len(list_filter(strings, lambda b: b = a OR (length(a) >= 6 AND (contains(a, b) OR contains(b, a))))) > 0) AS hits FROM facts GROUP BY id),
texts AS (SELECT id, unnest(texts) AS a, facts, blob FROM joined),
judged AS (SELECT id, count(*) AS n, count(*) FILTER (a = '' OR NOT (len(list_filter(facts, lambda b: b = a OR (length(a) >= 6 AND (contains(a, b) OR contains(b, a))))) > 0 OR CASE WHEN len(t) = 0 THEN true ELSE len(list_intersect(t, blob)) >= 0.6 * len(t) END)) AS spurious FROM (SELECT *, {_tokens('a')} AS t FROM texts) GROUP BY id),
rated AS (SELECT b.id, b.entries, b.n, len(b.years) AS dated, told.hits::DOUBLE / told.n AS recall, 1 - judged.spurious::DOUBLE / judged.n AS precision, CASE WHEN len(b.years) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(b.years, b.found))::DOUBLE / len(b.years) END AS date_recall FROM joined b JOIN told USING (id) JOIN judged USING (id)),
sections AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM rated),
section_rows AS (SELECT id, recall, precision, date_recall, least(1.0, 0.65 * f1 + 0.2 * recall + 0.15 * date_recall) AS score, array_to_string(list_filter([CASE WHEN recall < 0.7 THEN 'low_fact_recall' END, CASE WHEN precision < 0.7 THEN 'spurious_rows' END, CASE WHEN dated > 0 AND date_recall < 0.5 THEN 'dates_missing' END, CASE WHEN n < entries AND entries > 1 THEN 'rows_merged' END, CASE WHEN n >= entries + 2 THEN 'rows_split' END], lambda x: x IS NOT NULL), ',') AS tags FROM sections)"""
_PARSED = f"parsed AS ({registry._SQL['DM10_experience']})"


def _section_scores(s, d) -> DataFrame:
    """The jobs found in each résumé against those it was written from."""
    found = resumes.experience(s, d)
    strings = F.filter(F.array(v.norm(F.col("title")), v.norm(F.col("company"))), lambda x: F.length(x) >= 3)
    years = F.filter(F.array(F.substring("start_month", 1, 4), F.substring("end_month", 1, 4)), lambda y: y.rlike("^[0-9]{4}$"))
    rows = found.select("id", F.col("entry"), strings.alias("strings"), v.norm(F.concat_ws(" ", "title", "company")).alias("text"), years.alias("years"))
    return op.section_scores(_gold_jobs(s, d), rows, "id")


@query("DM16_sections", f"WITH {_PARSED}, {_SECTIONS} SELECT id, round(recall, 9) AS recall, round(precision, 9) AS precision, round(date_recall, 9) AS date_recall, round(score, 9) AS score, tags FROM section_rows")
def sections(s, d):
    """The SQL leaves out likeness, which decides none of these."""
    whole = lambda c: F.round(c, 9).alias(c)
    return _section_scores(s, d).select("id", whole("recall"), whole("precision"), whole("date_recall"), whole("score"), F.array_join("tags", ",").alias("tags"))


def _key(x: str) -> str:
    """The SQL of ``values.url_key``."""
    return f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({x}, '^[<>()\\[\\],;]+|[<>()\\[\\],;]+$', '', 'g'), '/+$', ''), '(?i)^(?:https?://)?(?:www\\.)?', '')), '[?#].*$', ''), '/+$', ''), '^ +| +$', '', 'g')"


_URL = f"""SELECT c_custkey, CASE WHEN g = '' OR f = '' THEN 0.0::DOUBLE WHEN g = f THEN 1.0 WHEN (len(gp) > 1 OR len(fp) > 1) AND gp[-1] = fp[-1] THEN 0.95 ELSE 0.0 END AS score
FROM (SELECT *, list_filter(string_split(g, '/'), lambda x: x <> '') AS gp, list_filter(string_split(f, '/'), lambda x: x <> '') AS fp FROM (SELECT c_custkey, {_key('gold')} AS g, {_key('found')} AS f FROM v))"""
_SIMPLE = {"name": values._NAME, "email": values._EMAIL, "phone": values._PHONE, "enum": values._ENUM, "text": values._TEXT, "url": _URL}
_PLACES = registry._SQL["ST25_place_score"]
_FIELDS = (
    [f"{m} AS (WITH {_pairs(m)} SELECT '{m}' AS metric, gold, found, score FROM ({body}) JOIN v USING (c_custkey))" for m, body in _SIMPLE.items()]
    + [f"place AS (WITH {_pairs('location')} SELECT 'location' AS metric, gold, found, score FROM ({_PLACES}) JOIN v USING (c_custkey))"]
    + [f"skill AS (WITH {_SKILLS} SELECT 'skills' AS metric, {values._HEADED} AS gold, {_FOUND} AS found, score FROM skills JOIN part USING (p_partkey))"]
    + [f"section AS (WITH {_PARSED}, {_SECTIONS} SELECT 'section' AS metric, 'x' AS gold, 'x' AS found, score FROM section_rows)"]
)


@query("DM16_field_scores", "WITH " + ", ".join(_FIELDS) + """ SELECT metric, CASE WHEN trim(gold) = '' AND trim(found) = '' THEN 'blank_ok' WHEN trim(gold) = '' THEN 'false_positive' WHEN score >= 0.85 THEN 'match' WHEN score >= 0.6 THEN 'partial' ELSE 'miss' END AS verdict, count(*) AS n, round(sum(score), 6) AS total FROM ("""
       + " UNION ALL ".join(f"SELECT metric, gold, found, score FROM {m}" for m in [*_SIMPLE, "place", "skill", "section"]) + ") GROUP BY ALL")
def field_scores(s, d):
    """Every field's score by its metric (nine of them) and its verdict, counted."""
    # the customers are read once, and dealt: a score takes far longer than its row (outer: no filter on the scores is drawn before the dealing)
    scored = [F.struct(F.lit(m).alias("metric"), F.expr(gold).alias("gold"), F.expr(found).alias("found"), v.field_score(F.lit(m), F.expr(gold), F.expr(found)).alias("score")) for m, (gold, found) in values._VALUES.items() if m in (*_SIMPLE, "location")]
    simple = spread(read(s, d, "customer"), "c_custkey").select(F.array(*scored).alias("x")).select(F.explode_outer("x").alias("x")).select("x.*")
    skills = _skill_scores(s, d, "gold", "found").select(F.lit("skills").alias("metric"), "gold", "found", "score")
    section = _section_scores(s, d).select(F.lit("section").alias("metric"), F.lit("x").alias("gold"), F.lit("x").alias("found"), "score")
    rows = simple.unionByName(skills).unionByName(section)
    return rows.groupBy("metric", v.field_verdict(F.col("gold"), F.col("found"), F.col("score")).alias("verdict")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


_OPENING = "array_to_string(string_split(trim(regexp_replace(lower(text), '[^a-z0-9+#]+', ' ', 'g')), ' ')[1:{0}], ' ')"
#: Openings of the benchmark's items, of one to four words.
_SPOKEN = " UNION ".join(f"SELECT {_OPENING.format(n)} AS phrase FROM benchmark WHERE item_id % 4 = {n - 1}" for n in (1, 2, 3, 4))


@query("JN14_phrases", f"""WITH phrases AS (SELECT DISTINCT phrase FROM ({_SPOKEN}) WHERE phrase <> ''), t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9+#]+', ' ', 'g')) || ' ' AS x FROM documents)
SELECT phrase, count(*) AS documents, min(doc_id) AS first FROM t JOIN phrases ON contains(x, ' ' || phrase || ' ') GROUP BY phrase""")
def phrases(s, d):
    """How many documents hold each phrase as whole words: an equality join of runs of words."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9+#]+"), lambda w: w != "")
    spoken = read(s, d, "benchmark").select(F.array_join(F.slice(words, F.lit(1), (F.col("item_id") % 4 + 1).cast("int")), " ").alias("phrase")).where("phrase <> ''").distinct()
    hits = op.phrase_hits(spread(read(s, d, "documents").select("doc_id", "text"), "doc_id"), spoken, "doc_id", 4)
    return hits.groupBy("phrase").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))


@query("JN17_related_companies", f"""WITH k AS (SELECT s_suppkey, {values._COMPANY_KEY} AS company FROM (SELECT s_suppkey, trim(lower({values._COMPANY})) AS s FROM supplier)), o AS (SELECT n_nationkey AS org_id, 'supplier#00000000' || CAST(n_nationkey AS STRING) AS name FROM nation)
SELECT org_id, s_suppkey FROM k JOIN o ON company = name OR contains(company, name) OR contains(name, company)""")
def related_companies(s, d):
    """Companies and tenants one of whose names holds the other, joined on the rarest run of three characters of the name that is held."""
    found = read(s, d, "supplier").selectExpr("s_suppkey", f"{values._COMPANY} AS x").select("s_suppkey", v.company_key(F.col("x")).alias("a"))
    tenants = read(s, d, "nation").selectExpr("n_nationkey AS org_id", "'Supplier#00000000' || CAST(n_nationkey AS STRING) || ' Ltd.' AS x").select("org_id", v.company_key(F.col("x")).alias("b"))
    return op.contained(found, tenants).select("org_id", "s_suppkey")
