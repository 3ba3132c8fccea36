"""Gold cells written out of customers and orders: their entries, facts and dates, and rows that look wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import gold as g
from harrow.functions import toon
from harrow.functions import values as v
from harrow.operators.relational import spread
from harrow.plans.registry import query
from harrow.plans.resumes import _FIRM, _ROLES
from harrow.plans.tables import read
from harrow.plans.values import _EMAILS, _PHONES

_STUDIES = """CASE c_custkey % 5 WHEN 0 THEN 'Education 1: Bachelor of Science (Maths)' || chr(10) || 'Lake College, Mumbai.' || chr(10) || '06/2011- 04/2014.' || chr(10) || chr(10) || 'Education 2:- High School Programs' || chr(10) || 'St. Town School, Mumbai.' || chr(10) || '06/2009- 02/2011.' WHEN 1 THEN 'Degree: MBA | Hill University' || chr(10) || '2015' WHEN 2 THEN 'A long introduction of these studies follows Education 1 - B.Tech' || chr(10) || 'Institute: River Polytechnic since Jun''09' WHEN 3 THEN '' ELSE 'Education 3: 2001 - 2004' END"""
_PAPERS = """CASE c_custkey % 3 WHEN 0 THEN 'Certification 1:- Cloud ' || lower(c_mktsegment) || ' from Hill Academy. (Issued May 2020).' WHEN 1 THEN 'Data (advanced) 2019' ELSE '' END"""
_PLACE_CELL = "CASE c_custkey % 4 WHEN 0 THEN 'DB Migration, Installation' WHEN 1 THEN 'Pune' WHEN 2 THEN 'Flat 12, Tower 5, Long Street behind the Old Market, Navi Mumbai 400706' ELSE '' END"
_MAIL_CELL = "CASE c_custkey % 3 WHEN 0 THEN 'a@b.com' WHEN 1 THEN 'none' ELSE '' END"
_CALL_CELL = "CASE c_custkey % 4 WHEN 0 THEN '9999999999' WHEN 1 THEN '12345' ELSE '' END"
_LINK_CELL = "CASE c_custkey % 3 WHEN 0 THEN 'https://example.com/me' WHEN 1 THEN 'linkedin.com/in/x' ELSE '' END"


def cells(s, d) -> DataFrame:
    """(id, section, cell): education and certification cells of each customer, and an experience cell of its orders."""
    people = spread(read(s, d, "customer"), "c_custkey").selectExpr("c_custkey AS id", f"stack(2, 'education', {_STUDIES}, 'certifications', {_PAPERS}) AS (section, cell)")
    jobs = read(s, d, "orders").selectExpr("o_custkey AS id", "o_orderkey", "o_orderstatus", "CAST(year(o_orderdate) AS STRING) AS y").selectExpr("id", "o_orderkey AS k", f"{_FIRM} || CASE o_orderkey % 3 WHEN 0 THEN ', ' ELSE chr(10) || 'Role: ' END || {_ROLES} || CASE o_orderkey % 2 WHEN 0 THEN ', Mar''' || y || '- Till date' ELSE chr(10) || 'Jun ' || y || ' - Present' || chr(10) || 'Responsibilities: all' END AS job")
    listed = spread(jobs, "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "job"))).alias("jobs"))
    cell = F.array_join(F.transform("jobs", lambda j, i: F.concat(F.lit("Experience "), (i + 1).cast("string"), F.lit(": "), j["job"])), "     ")
    return people.unionByName(listed.select("id", F.lit("experiences").alias("section"), cell.alias("cell")))


def entries(rows: DataFrame) -> DataFrame:
    """(id, section, number, primary, secondary, start, end, facts, years): an entry of a cell, with where it came from."""
    cut = rows.select("id", "section", F.posexplode(g.entries(F.col("cell"))).alias("pos", "e")).select("id", "section", "pos", "e.*").withColumn("lines", g.lines(F.col("raw")))
    paper = F.col("section") == "certifications"
    cut = cut.where((paper & (F.length("raw") >= 3)) | (~paper & (F.size("lines") > 0)))

    def told(x: Column) -> Column:
        return F.when(paper, g.certification(F.col("raw"))).when(F.col("section") == "education", g.education(x)).otherwise(g.experience(x))

    when = F.when(paper, F.struct(F.lit("").alias("start"), v.month_key(F.col("raw")).alias("end"))).otherwise(g.dates(F.col("raw")))
    return cut.withColumn("told", told(F.col("lines"))).withColumn("dates", when).select("id", "section", "pos", "number", "told.*", "dates.*", v.year_set(F.col("raw")).alias("years"))


@query("DM17_gold_cells")
def gold_cells(s, d):
    """Facts with their entry and section, one row each. The tests compare whole tables with a plain loop."""
    rows = entries(cells(s, d))
    return rows.select("id", "section", "pos", "number", "primary", "secondary", F.col("start").alias("start_month"), F.col("end").alias("end_month"), F.array_join("years", " ").alias("years"), F.posexplode_outer("facts").alias("k", "fact"))


@query("DM17_audit", f"""WITH c AS (SELECT c_custkey, {_MAIL_CELL} AS mail, {_CALL_CELL} AS phone, {_PLACE_CELL} AS place, {_LINK_CELL} AS link FROM customer)
SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN mail <> '' AND len({_EMAILS.replace('{0}', 'mail')}) = 0 THEN 'email_unparseable' END, CASE WHEN phone <> '' AND len({_PHONES.replace('{0}', 'phone')}) = 0 THEN 'phone_unparseable' END, CASE WHEN place <> '' AND regexp_matches(place, '{g.SUSPECT_PLACE}') THEN 'location_looks_like_skills' END,
CASE WHEN length(place) > 60 THEN 'location_is_full_address' END, CASE WHEN link <> '' AND NOT contains(lower(link), 'github') THEN 'github_url_not_github' END, CASE WHEN link <> '' AND NOT contains(lower(link), 'linkedin') THEN 'linkedin_url_not_linkedin' END], lambda x: x IS NOT NULL)) AS issue FROM c) GROUP BY issue""")
def audit(s, d):
    """How many rows of gold cells look wrong, by issue."""
    rows = read(s, d, "customer").selectExpr(f"{_MAIL_CELL} AS mail", f"{_CALL_CELL} AS phone", f"{_PLACE_CELL} AS place", f"{_LINK_CELL} AS link")
    return rows.select(F.explode(g.audit(F.col("mail"), F.col("phone"), F.col("place"), F.col("link"), F.col("link"))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


#: A nested record of an order.
_ORDER = "id long, status string, at struct<priority: string, customer: long>, words array<string>, lines array<struct<line: int, part: long, flag: string, note: string>>"
_WORDS = "regexp_split_to_array(o_orderpriority, '[- ]')"
_NOTE = "CASE l_partkey % 4 WHEN 0 THEN 'small, red' WHEN 1 THEN '2012' WHEN 2 THEN 'say \"x\"' ELSE '' END"


def _records(s, d) -> DataFrame:
    line = F.struct(F.col("l_linenumber").cast("int").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.expr(_NOTE).alias("note"))
    lines = spread(read(s, d, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return spread(read(s, d, "orders"), "o_orderkey").join(lines.hint("merge"), "o_orderkey").select(F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderstatus")).alias("status"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer")).alias("at"), F.split("o_orderpriority", "[- ]").alias("words"), "lines").alias("r"))


_LINES = f"""SELECT l_orderkey, count(*) AS n, string_agg('  ' || l_linenumber || ',' || l_partkey || ',' || l_returnflag || ',' || CASE WHEN note = '' THEN '' WHEN regexp_matches(note, '[,"]|^[0-9]+$') THEN '"' || replace(note, '"', '\\"') || '"' ELSE note END, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag, note) AS block FROM (SELECT *, {_NOTE} AS note FROM lineitem) GROUP BY l_orderkey"""


@query("AR6_toon", f"""SELECT o_orderkey AS id, '#toon/v2' || chr(10) || 'id: ' || o_orderkey || chr(10) || CASE WHEN o_orderkey % 10 > 0 THEN 'status: ' || o_orderstatus || chr(10) ELSE '' END || 'at.priority: ' || o_orderpriority || chr(10) || 'at.customer: ' || o_custkey || chr(10) || 'words[' || len({_WORDS}) || ']: '
|| array_to_string(list_transform({_WORDS}, lambda w: CASE WHEN regexp_matches(w, '^[0-9]*$') THEN '"' || w || '"' ELSE w END), '|') || chr(10) || 'lines[' || n || ']' || '{{line,part,flag,note}}:' || chr(10) || block AS text FROM orders JOIN ({_LINES}) ON l_orderkey = o_orderkey""".replace("{{", "{").replace("}}", "}"))
def toon_texts(s, d):
    """Each order with its lines as one text."""
    return _records(s, d).select("r.id", toon.encode(F.col("r"), T.StructType.fromDDL(_ORDER)).alias("text"))


@query("AR6_round_trip", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 > 0 THEN o_orderstatus END AS status, o_custkey AS customer, len({_WORDS}) AS words, CAST(l_linenumber AS INTEGER) AS line, l_partkey AS part, l_returnflag AS flag, {_NOTE} AS note FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def toon_round_trip(s, d):
    """The lines read back from those texts; the SQL reads the tables themselves."""
    kind = T.StructType.fromDDL(_ORDER)
    back = toon_texts(s, d).select(toon.decode(F.col("text"), kind).alias("r"))
    return back.select("r.id", "r.status", F.col("r.at.customer").alias("customer"), F.size("r.words").alias("words"), F.explode_outer("r.lines").alias("l")).where("l IS NOT NULL").select("id", "status", "customer", "words", "l.*")
