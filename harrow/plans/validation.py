"""Output records written out of orders, some of them broken, against rules by dotted path."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import validators as c
from harrow.functions import values as v
from harrow.operators import merging
from harrow.operators import validation as op
from harrow.operators.validation import Rule
from harrow.plans.registry import query
from harrow.plans.resumes import _FIRM, _ROLES
from harrow.plans.tables import read

RULES = [
    Rule("required", "status"), Rule("required", "who"), Rule("enum", "status", allowed=("F", "O")), Rule("regex", "who.priority", pattern="[1-3]-"), Rule("length", "who.priority", least=6, most=8), Rule("items", "tags[]", least=1, most=2),
    Rule("date", "jobs[].start"), Rule("date", "until"), Rule("confidence", "confidence", least=0.5), Rule("confidence", "who.sure", least=0.3),
]
_Y = "CAST(year(o_orderdate) AS STRING)"
#: Records with missing parents, arrays in a path's way, wrong types and cut ends.
_DOC = f"""'{{{{' || CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '"status": null, ' WHEN 2 THEN '"status": 5, ' ELSE '"status": "' || o_orderstatus || '", ' END || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '"who": [1], ' ELSE '"who": {{{{"priority": "' || o_orderpriority || '", "sure": 0.' || CAST(o_orderkey % 10 AS STRING) || '}}}}, ' END
|| CASE o_orderkey % 4 WHEN 0 THEN '"tags": [], ' WHEN 1 THEN '"tags": ["a", "b", "c"], ' WHEN 2 THEN '"tags": "a", ' ELSE '' END || '"jobs": [{{{{"start": "' || {_Y} || '-07"}}}}, {{{{"start": "soon"}}}}, {{{{"start": ""}}}}, {{{{"end": 1}}}}, {{{{"start": "Present"}}}}, {{{{"start": "' || {_Y} || '-13"}}}}], '
|| '"until": "' || CASE o_orderkey % 3 WHEN 0 THEN {_Y} WHEN 1 THEN 'later' ELSE '' END || '", "confidence": ' || CASE o_orderkey % 6 WHEN 0 THEN '"high"' WHEN 1 THEN 'null' ELSE '0.' || CAST(o_orderkey % 9 AS STRING) END || CASE o_orderkey % 11 WHEN 0 THEN '' ELSE '}}}}' END""".format()
_KIND = "json_type(j, '$.{0}')"
_S = "json_extract_string(j, '$.{0}')"
_NUMBER = "CASE WHEN json_type(j, '$.{0}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(j, '$.{0}') AS DOUBLE) END"
_WRONG = f"{{0}} <> '' AND lower({{0}}) NOT IN ({', '.join(repr(x) for x in op.OPEN_DATES)}) AND NOT regexp_matches({{0}}, '{op.DATE_FORMS.replace('{', '{{').replace('}', '}}')}')"


@query("DM23_by_path", f"""WITH d AS (SELECT o_orderkey, {_DOC} AS doc FROM orders), p AS (SELECT o_orderkey, CASE WHEN json_valid(doc) THEN doc::JSON END AS j FROM d)
SELECT o_orderkey, CASE WHEN j IS NULL THEN 'json' ELSE array_to_string(list_concat(list_filter([CASE WHEN {_KIND.format('status')} IS NULL THEN 'missing:status' END, CASE WHEN {_KIND.format('who')} IS NULL THEN 'missing:who' END,
CASE WHEN {_KIND.format('status')} <> 'NULL' AND NOT ({_KIND.format('status')} = 'VARCHAR' AND {_S.format('status')} IN ('F', 'O')) THEN 'enum:status' END, CASE WHEN {_S.format('who.priority')} <> '' AND NOT regexp_matches({_S.format('who.priority')}, '^[1-3]-') THEN 'regex:who.priority' END,
CASE WHEN length({_S.format('who.priority')}) < 6 THEN 'length:who.priority:min' END, CASE WHEN length({_S.format('who.priority')}) > 8 THEN 'length:who.priority:max' END, CASE WHEN {_KIND.format('tags')} = 'ARRAY' AND json_array_length(j, '$.tags') < 1 THEN 'length:tags[]:min_items' END, CASE WHEN {_KIND.format('tags')} = 'ARRAY' AND json_array_length(j, '$.tags') > 2 THEN 'length:tags[]:max_items' END], lambda x: x IS NOT NULL),
list_transform(list_filter(json_extract_string(j, '$.jobs[*].start'), lambda x: {_WRONG.format('x')}), lambda x: 'date:jobs[].start'), list_filter([CASE WHEN {_WRONG.format(_S.format('until'))} THEN 'date:until' END, CASE WHEN {_NUMBER.format('confidence')} < 0.5 THEN 'confidence:confidence<0.5' END, CASE WHEN {_NUMBER.format('who.sure')} < 0.3 THEN 'confidence:who.sure<0.3' END], lambda x: x IS NOT NULL)), ',') END AS violations FROM p""")
def by_path(s, d):
    """The rules that each record breaks."""
    return read(s, d, "orders").selectExpr("o_orderkey", f"{_DOC} AS doc").select("o_orderkey", F.array_join(op.violations(F.col("doc"), RULES), ",").alias("violations"))


#: Values of each validator, by a customer's number.
_FIELDS = {
    "email": ["c_name || '@x.org'", "'cust' || c_custkey || '@x.org'", "''", "'a@b'"],
    "phone": ["'123'", "'2019202020212022'", "'+91 98765-43210'", "''", "'20182019'", "'ring 98765 43210'", "'(022) 2345.6789'"],
    "url": ["'https://site' || c_custkey || '.org/x'", "'b.tech'", "'mba.com'", "'http://example.com/a'", "'no host'", "''", "'https://github.com/example.com'"],
    "linkedin": ["'linkedin.com/in/a'", "'https://x.org/in/a'", "''"],
    "name": ["'Ann Lee'", "'Resume'", "'Ann Lee CV'", "c_name", "'ann@x.org'", "'Bachelor of Arts'", "'one two three four five six'", "''", "'Zo​e Lee'"],
    "date": ["'Mar 2020'", "'2020-13'", "'13/2020'", "'2020/12'", "'Now'", "''"],
    "institution": ["'Lake University'", "'March'", "'03/2020'", "'ab'", "'72.5%'", "'CGPA: 8'", "'Developed things'", "'lower case'", "'Data Analyst'", "'Acme Labs'", "'One two three four five six seven eight nine ten eleven twelve thirteen'", "'This is it all.'", "''", "'Acme Institute'"],
    "degree": ["'B.Tech (CSE)'", "'June'", "'Built things'", "'1. Wrote code'", "'msc'", "'Data Analyst'", "'Something'", "''", "repeat('Long words ', 9)", "'B.E. Computer'", "'12th'"],
}


def _case(field: str) -> str:
    values = _FIELDS[field]
    return "CASE c_custkey % " + str(len(values)) + " " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(values)) + " END"


def _rx(pattern: str, x: str = "s") -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


_WORD_COUNT = "len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''))"
_DIGITS = "regexp_replace(s, '[^0-9]', '', 'g')"
_TWO_YEARS = f"regexp_extract_all({_DIGITS}, '(?:19|20)[0-9]{{2}}')"
_URLS = f"WHEN {_rx(c.DEGREE_HOST)} THEN 'url_is_degree' WHEN NOT {_rx(c.URL)} THEN 'url_invalid'"
_CHECKS = {
    "email": f"CASE WHEN s = '' THEN 'email_empty' WHEN NOT {_rx('^' + v.EMAIL + '$')} THEN 'email_invalid' ELSE 'ok' END",
    "phone": f"CASE WHEN s = '' THEN 'phone_empty' WHEN length({_DIGITS}) NOT BETWEEN 7 AND 15 THEN 'phone_digit_count' WHEN len({_TWO_YEARS}) >= 2 AND contains({_DIGITS}, array_to_string({_TWO_YEARS}, '')) THEN 'phone_year_soup' WHEN NOT {_rx(c.PHONE)} THEN 'phone_invalid' ELSE 'ok' END",
    "url": f"CASE WHEN s = '' THEN 'url_empty' WHEN ({' OR '.join(f'contains(lower(s), {x!r})' for x in c.PLACEHOLDERS)}) AND NOT contains(lower(s), 'linkedin.com') AND NOT contains(lower(s), 'github.com') THEN 'url_placeholder' {_URLS} ELSE 'ok' END",
    "linkedin": f"CASE WHEN s = '' THEN 'empty_allowed' {_URLS} WHEN NOT contains(lower(s), 'linkedin') THEN 'url_host_mismatch_linkedin' ELSE 'ok' END",
    "name": f"CASE WHEN s = '' THEN 'name_empty' WHEN lower(s) IN ({', '.join(repr(x) for x in c.NO_NAMES)}) OR ends_with(lower(s), ' resume') OR ends_with(lower(s), ' cv') THEN 'name_is_title' WHEN contains(s, '@') OR contains(lower(s), 'http') THEN 'name_not_person' WHEN {_rx('[0-9]')} THEN 'name_has_digits' WHEN {_rx(c.DEGREE)} THEN 'name_is_degree' WHEN {_WORD_COUNT} NOT BETWEEN 1 AND 5 THEN 'name_word_count' ELSE 'ok' END",
    "date": f"CASE WHEN s = '' THEN 'empty_allowed' WHEN {_rx(c.MONTH_YEAR)} THEN 'ok' ELSE 'date_invalid' END",
    "institution": f"CASE WHEN s = '' THEN 'institution_empty' WHEN {_rx(c.MONTH)} THEN 'institution_is_month' WHEN {_rx(c.MONTH_YEAR)} THEN 'institution_is_date' WHEN length(s) < 3 THEN 'institution_too_short' WHEN {_rx(c.SCORE)} THEN 'institution_is_score' WHEN {_rx(c.DUTY)} THEN 'institution_is_duty' WHEN {_rx('^' + chr(92) + 'p{Ll}')} THEN 'institution_is_prose' WHEN {_rx(c.TITLE)} AND NOT {_rx(c.SCHOOL)} THEN 'institution_is_job_title' WHEN {_rx(c.COMPANY)} AND NOT {_rx(c.SCHOOL)} THEN 'institution_is_company' WHEN {_WORD_COUNT} > 12 AND NOT {_rx(c.SCHOOL)} THEN 'institution_too_long' WHEN ends_with(s, '.') AND {_WORD_COUNT} >= 4 AND NOT {_rx(c.SCHOOL)} THEN 'institution_is_sentence' ELSE 'ok' END",
    "degree": f"CASE WHEN s = '' THEN 'degree_empty' WHEN {_rx(c.MONTH)} OR {_rx(c.MONTH_YEAR)} THEN 'degree_is_date' WHEN {_rx(c.DUTY)} THEN 'degree_is_duty' WHEN {_rx('^[0-9]{1,2}' + chr(92) + '.' + chr(92) + 's+' + chr(92) + 'S')} THEN 'degree_is_numbered_duty' WHEN {_rx('^' + chr(92) + 'p{Ll}')} THEN 'degree_is_prose' WHEN length(s) > 80 AND NOT {_rx(c.DEGREE)} THEN 'degree_too_long' WHEN {_rx(c.TITLE)} AND NOT {_rx(c.DEGREE)} THEN 'degree_is_job_title' WHEN NOT {_rx(c.DEGREE)} THEN 'degree_no_cue' ELSE 'ok' END",
}
_GIVEN = "trim(regexp_replace(regexp_replace({0}, '" + c.INVISIBLE + "', '', 'g'), '^\\s+|\\s+$', '', 'g'))"


@query("DM13_validators", " UNION ALL ".join(f"SELECT c_custkey, '{f}' AS field, {check} AS verdict FROM (SELECT c_custkey, {_GIVEN.format(_case(f))} AS s FROM customer)" for f, check in _CHECKS.items()))
def validators(s, d):
    """Each validator's verdict on a value of each customer."""
    rows = read(s, d, "customer").selectExpr("c_custkey", *[f"{_case(f)} AS {f}" for f in _FIELDS])
    told = {"email": c.email, "phone": c.phone, "url": c.url, "linkedin": lambda x: c.url(x, "linkedin", allow_empty=True), "name": c.person_name, "date": c.month_year, "institution": c.institution, "degree": c.degree}
    checked = rows.select("c_custkey", *[check(F.col(f)).alias(f) for f, check in told.items()])
    return checked.select("c_custkey", F.expr("stack(" + str(len(told)) + ", " + ", ".join(f"'{f}', {f}" for f in told) + ") AS (field, verdict)"))


def job_rows(s, d, side: str):
    """Rows of jobs written out of a customer's orders, with other slots empty on either side, and some that are only there."""
    gaps = {"held": ("o_orderkey % 3 > 0", "o_orderkey % 4 > 0", "o_orderkey % 5 > 0", "o_orderkey % 2 > 0", "o_orderkey % 6 > 0"), "found": ("o_orderkey % 4 <> 1", "o_orderkey % 5 <> 2", "o_orderkey % 3 <> 1", "o_orderkey % 3 <> 2", "o_orderkey % 7 > 0")}[side]
    rows = read(s, d, "orders").selectExpr("o_custkey AS id", "o_orderkey", "o_orderstatus", "o_orderpriority", "CAST(year(o_orderdate) AS STRING) AS y").selectExpr("id", "o_orderkey", "y", f"{_ROLES} AS r", f"CASE WHEN o_orderkey % 11 = 0 THEN 'working with ' || o_orderpriority ELSE {_FIRM} END AS f")
    role, company, start, end, kept = gaps
    return rows.where(kept).selectExpr("id", "o_orderkey AS no", f"CASE WHEN {role} THEN CASE WHEN o_orderkey % 13 = 0 THEN f || ' Solutions' ELSE r END END AS role", f"CASE WHEN {company} THEN f END AS company", f"CASE WHEN {start} THEN y || '-03' END AS start", f"CASE WHEN {end} THEN y || '-09' END AS end", "o_orderkey % 9 = 0 AS current", "CASE WHEN o_orderkey % 8 > 3 THEN 'did ' || r END AS description")


@query("DM14_field_merge")
def field_merge(s, d):
    """Each customer's jobs out of two sources. The tests compare the whole table with a loop."""
    return merging.merge_fields(job_rows(s, d, "held"), job_rows(s, d, "found"), "id")
