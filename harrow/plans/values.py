"""Value keys and scores on contacts, names, places, levels, skills and dates written out of customers, parts and orders.

The inputs are expressions that Spark and DuckDB read alike; each query's SQL states the rule once more over them.
"""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from harrow.functions import text as t
from harrow.functions import values as v
from harrow.operators.relational import spread
from harrow.plans.registry import query
from harrow.plans.tables import read

_FIRST = "CASE c_custkey % 5 WHEN 0 THEN 'anna' WHEN 1 THEN 'Ben' WHEN 2 THEN 'carla' WHEN 3 THEN 'Dr. Dev' ELSE 'eve' END"
_LAST = "CASE c_custkey % 7 WHEN 0 THEN 'Rao' WHEN 1 THEN 'de Silva' WHEN 2 THEN 'Khan' ELSE c_mktsegment END"
_NUMBER = "'9' || substr(CAST(1000000000 + c_custkey * 7919 AS STRING), 2, 9)"
_LOCAL = "lower(c_mktsegment) || CAST(c_custkey AS STRING)"
#: One row of each customer: gold and found values of each metric.
_VALUES = {
    "name": (f"{_FIRST} || ' ' || {_LAST}", f"CASE c_custkey % 4 WHEN 0 THEN {_FIRST} || ' ' || {_LAST} WHEN 1 THEN 'Resume: ' || upper({_FIRST}) || ' M ' || {_LAST} WHEN 2 THEN 'zoe ' || {_LAST} ELSE '' END"),
    "email": (f"{_LOCAL} || '@Mail.example.org.'", f"CASE c_custkey % 3 WHEN 0 THEN 'see ' || {_LOCAL} || '@mail.example.org' WHEN 1 THEN {_LOCAL} || '@other.org' ELSE 'none' END"),
    "phone": (f"'+91 ' || {_NUMBER}", f"CASE c_custkey % 3 WHEN 0 THEN 'call (0)' || {_NUMBER} || '1' WHEN 1 THEN '91-' || {_NUMBER} ELSE '12345' END"),
    "location": ("CASE c_custkey % 4 WHEN 0 THEN 'Pune, Maharashtra 411001' WHEN 1 THEN 'Navi Mumbai East' WHEN 2 THEN 'India' ELSE 'Road 5, Delhi / NCR' END", "CASE c_custkey % 3 WHEN 0 THEN 'Mumbai, India' WHEN 1 THEN 'near pune' ELSE 'delhi' END"),
    "enum": ("CASE c_custkey % 4 WHEN 0 THEN 'Fresh graduate' WHEN 1 THEN 'Intern' WHEN 2 THEN 'Senior' ELSE 'other' END", "CASE c_custkey % 3 WHEN 0 THEN 'Experienced professional' WHEN 1 THEN 'entry level' ELSE '' END"),
    "url": ("CASE c_custkey % 3 WHEN 0 THEN 'https://www.linkedin.com/in/' || lower(c_name) WHEN 1 THEN 'HTTPS://GitHub.com/' || c_mktsegment || '/?tab=1' ELSE 'site' || c_custkey || '.example.org/' END", "CASE c_custkey % 4 WHEN 0 THEN 'linkedin.com/in/' || c_name || '/' WHEN 1 THEN 'in/' || c_name WHEN 2 THEN 'www.site' || c_custkey || '.example.org' ELSE '' END"),
    "text": ("'account ' || lower(c_mktsegment) || ' of ' || CAST(c_nationkey AS STRING)", "CASE c_custkey % 3 WHEN 0 THEN 'the ' || c_mktsegment || ' account' WHEN 1 THEN 'of of account' ELSE '' END"),
}


def pairs(s, d, metric: str) -> DataFrame:
    gold, found = _VALUES[metric]
    return read(s, d, "customer").selectExpr("c_custkey", f"{gold} AS gold", f"{found} AS found")


def _pairs(metric: str) -> str:
    gold, found = _VALUES[metric]
    return f"v AS (SELECT c_custkey, {gold} AS gold, {found} AS found FROM customer)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9+#./&\\- ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({_norm(x)}, '[^a-z0-9+#]+'), lambda q: length(q) > 1 OR regexp_matches(q, '^[0-9]$')))"


def _f1(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE WHEN len(list_intersect({a}, {b})) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


_NAME_WORDS = f"list_filter(regexp_split_to_array({_norm('{0}')}, '[^a-z]+'), lambda w: w <> '' AND NOT list_contains({_list(v.NAME_NOISE)}, w))"
_NAME = f"""SELECT c_custkey, CASE WHEN len(g) = 0 OR len(f) = 0 THEN 0.0::DOUBLE WHEN g = f THEN 1.0 WHEN list_has_all(f, g) OR list_has_all(g, f) THEN 0.95 ELSE {_f1('gt', 'ft')} END AS score
FROM (SELECT *, {_tokens("array_to_string(g, ' ')")} AS gt, {_tokens("array_to_string(f, ' ')")} AS ft FROM (SELECT c_custkey, {_NAME_WORDS.replace('{0}', 'gold')} AS g, {_NAME_WORDS.replace('{0}', 'found')} AS f FROM v))"""


@query("ST27_name_score", f"WITH {_pairs('name')} {_NAME}")
def name_score(s, d):
    return pairs(s, d, "name").select("c_custkey", v.name_score(F.col("gold"), F.col("found")).alias("score"))


_EMAILS = f"list_distinct(list_transform(regexp_extract_all({{0}}, '{v.EMAIL}'), lambda x: regexp_replace(lower(x), '\\.+$', '')))"
_EMAIL = f"""SELECT c_custkey, CASE WHEN list_has_any(g, f) THEN 1.0::DOUBLE WHEN list_has_any(list_transform(g, lambda x: split_part(x, '@', 1)), list_transform(f, lambda x: split_part(x, '@', 1))) THEN 0.6 ELSE 0.0 END AS score
FROM (SELECT c_custkey, {_EMAILS.replace('{0}', 'gold')} AS g, {_EMAILS.replace('{0}', 'found')} AS f FROM v)"""


#: What is said of a customer's pages: addresses, labels with a handle, and labels that name no portfolio.
_PAGES = """CASE c_custkey % 7 WHEN 0 THEN 'see https://www.linkedin.com/in/' || c_name || '/ and github.com/' || lower(c_mktsegment) WHEN 1 THEN 'LinkedIn: in/' || c_name WHEN 2 THEN 'GitHub: ' || lower(c_mktsegment) || '.' WHEN 3 THEN 'Website: ' || lower(c_mktsegment) || '.dev/me;'
WHEN 4 THEN 'portfolio: mba.com' WHEN 5 THEN 'Personal site: https://github.com/' || lower(c_mktsegment) || ' linkedin: ' || lower(c_mktsegment) ELSE 'Portfolio: www.' || lower(c_mktsegment) || '.example' END"""


def _schemed(x: str) -> str:
    bare = f"regexp_replace(trim({x}), '[/.,;]+$', '')"
    return f"CASE WHEN {bare} = '' THEN '' WHEN regexp_matches({bare}, '(?i)^https?://') THEN {bare} ELSE 'https://' || {bare} END"


@query("ST24_emails_urls", f"""WITH {_pairs('email')}, u AS (SELECT c_custkey AS k, 'HTTPS://www.' || c_mktsegment || '.com/in/' || c_name || CASE c_custkey % 3 WHEN 0 THEN '/?a=1' WHEN 1 THEN '//' ELSE '#x' END AS url, {_PAGES} AS pages FROM customer),
n AS (SELECT *, nullif(regexp_extract(pages, '{v.LINKEDIN}'), '') AS l1, nullif(regexp_extract(pages, '(?i)linkedin\\s*:\\s*(\\S+)', 1), '') AS l2, nullif(regexp_extract(pages, '{v.GITHUB}'), '') AS g1, nullif(regexp_extract(pages, '(?i)github\\s*:\\s*(\\S+)', 1), '') AS g2, nullif(regexp_extract(pages, '{v.PORTFOLIO_LABEL}', 1), '') AS p FROM u),
h AS (SELECT *, split_part(regexp_replace(lower({_schemed('p')}), '^https?://', ''), '/', 1) AS host FROM n)
SELECT v.c_custkey, array_to_string(list_sort({_EMAILS.replace('{0}', "gold || ' ' || found")}), ' ') AS emails, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url, '/+$', ''), '(?i)^(?:https?://)?(?:www\\.)?', '')), '[?#].*$', ''), '/+$', '') AS url,
CASE WHEN l1 IS NOT NULL THEN {_schemed('l1')} WHEN contains(lower(l2), 'linkedin') THEN {_schemed('l2')} WHEN contains(l2, '/') THEN {_schemed("'linkedin.com/in/' || l2")} ELSE '' END AS linkedin,
CASE WHEN g1 IS NOT NULL THEN {_schemed('g1')} WHEN contains(lower(g2), 'github') THEN {_schemed('g2')} WHEN g2 IS NOT NULL THEN {_schemed("'github.com/' || g2")} ELSE '' END AS github,
CASE WHEN regexp_matches(p, '{v.HOST_END}') AND NOT regexp_matches(lower(p), 'linkedin\\.com|github\\.com') AND NOT regexp_matches(host, '{v.DEGREE_HOST}') THEN {_schemed('p')} ELSE '' END AS portfolio FROM v JOIN h ON k = v.c_custkey""")
def emails_urls(s, d):
    """E-mail keys, the key of an address, and the profile links that a text names."""
    url = "'HTTPS://www.' || c_mktsegment || '.com/in/' || c_name || CASE c_custkey % 3 WHEN 0 THEN '/?a=1' WHEN 1 THEN '//' ELSE '#x' END AS url"
    gold, found = _VALUES["email"]
    rows = read(s, d, "customer").selectExpr("c_custkey", f"{gold} || ' ' || {found} AS both", url, f"{_PAGES} AS pages")
    return rows.select("c_custkey", F.array_join(v.emails(F.col("both")), " ").alias("emails"), v.url_key(F.col("url")).alias("url"), v.profile_links(F.col("pages")).alias("p")).select("c_custkey", "emails", "url", "p.*")


_PHONES = """list_sort(list_distinct(flatten(list_transform(list_transform(regexp_extract_all({0}, '[0-9][0-9\\s\\-().]{6,}[0-9]'), lambda r: regexp_replace(r, '[^0-9]', '', 'g')), lambda n: list_transform(range(1, length(n) // 10 + 1), lambda k: substr(n, length(n) - 10 * k + 1, 10))))))"""


@query("ST23_phone_keys", f"WITH {_pairs('phone')} SELECT c_custkey, array_to_string({_PHONES.replace('{0}', 'found')}, ' ') AS keys FROM v")
def phone_keys(s, d):
    return pairs(s, d, "phone").select("c_custkey", F.array_join(v.phone_keys(F.col("found")), " ").alias("keys"))


_PLACE = f"""parts AS (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({_norm('x')}, '\\b[0-9]{{5,6}}\\b', ' ', 'g'), '\\bno\\.?\\s*[0-9]+\\b', ' ', 'g'), '[,/|]+'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '') AS p FROM sides),
kept AS (SELECT *, list_filter(p, lambda q: NOT list_contains({_list(v.PLACE_NOISE + v.PLACE_PHRASES)}, q) AND NOT regexp_matches(q, '{v.ADDRESS}')) AS kp FROM parts),
raw AS (SELECT *, list_filter(list_distinct(string_split(array_to_string(CASE WHEN len(kp) > 0 THEN kp ELSE p END, ' '), ' ')), lambda w: w <> '' AND NOT list_contains({_list(v.DIRECTIONS)}, w)) AS r FROM kept),
bare AS (SELECT *, list_filter(r, lambda w: NOT list_contains({_list(v.PLACE_NOISE)}, w)) AS b FROM raw),
w AS (SELECT c_custkey, side, len(p) AS n, CASE WHEN len(b) > 0 THEN b ELSE r END AS w FROM bare)"""


@query("ST25_place_score", f"""WITH {_pairs('location')}, sides AS (SELECT c_custkey, 'g' AS side, gold AS x FROM v UNION ALL SELECT c_custkey, 'f', found FROM v), {_PLACE}
SELECT g.c_custkey, CASE WHEN g.n = 0 OR f.n = 0 THEN 0.0::DOUBLE WHEN len(g.w) = 0 THEN (CASE WHEN len(f.w) = 0 THEN 1.0 ELSE 0.0 END) WHEN list_has_all(f.w, g.w) THEN 1.0 WHEN list_has_any(f.w, g.w) THEN greatest(len(list_intersect(g.w, f.w))::DOUBLE / len(g.w), 0.75) ELSE 0.0 END AS score
FROM w g JOIN w f ON g.c_custkey = f.c_custkey AND g.side = 'g' AND f.side = 'f'""")
def place_score(s, d):
    return pairs(s, d, "location").select("c_custkey", v.place_score(F.col("gold"), F.col("found")).alias("score"))


_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '\\b{w}\\b') THEN '{k}'" for w, k in v.LEVELS) + " ELSE {0} END"
_ENUM = f"""SELECT c_custkey, CASE WHEN g = '' OR f = '' THEN 0.0::DOUBLE WHEN g = f THEN 1.0 WHEN g IN ('intern', 'fresher') AND f IN ('intern', 'fresher') THEN 0.5 ELSE 0.0 END AS score
FROM (SELECT c_custkey, {_LEVEL.replace('{0}', _norm('gold'))} AS g, {_LEVEL.replace('{0}', _norm('found'))} AS f FROM v)"""


@query("ST26_level_score", f"WITH {_pairs('enum')} {_ENUM}")
def level_score(s, d):
    return pairs(s, d, "enum").select("c_custkey", v.level_score(F.col("gold"), F.col("found")).alias("score"))


_TEXT = f"""SELECT c_custkey, CASE WHEN trim(found) = '' THEN 0.0::DOUBLE ELSE greatest(CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_intersect(g, f))::DOUBLE / len(g) END, {_f1('g', 'f')}) END AS score
FROM (SELECT c_custkey, found, {_tokens('gold')} AS g, {_tokens('found')} AS f FROM v)"""
_PHONE = f"SELECT c_custkey, CASE WHEN list_has_any({_PHONES.replace('{0}', 'gold')}, {_PHONES.replace('{0}', 'found')}) THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM v"


_CONTACT = f"CASE c_custkey % 5 WHEN 0 THEN 'x@y.org E-Mail: ' || {_LOCAL} || '@mail.org' WHEN 1 THEN {_LOCAL} || chr(10) || '@mail.org, other@b.net' WHEN 2 THEN 'mail id - ' || {_LOCAL} || '@c.net' WHEN 3 THEN 'only ' || {_LOCAL} || '@d.net here' ELSE 'no address' END"


@query("ST21_first_email", f"""WITH c AS (SELECT c_custkey, regexp_replace({_CONTACT}, '([A-Za-z0-9._%+\\-]+)\\s+(@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}})', '\\1\\2', 'g') AS x FROM customer)
SELECT c_custkey, coalesce(nullif(regexp_extract(x, '(?i)(?:e[\\-\\s]?mail|mail\\s*id|email\\s*id)\\s*[:.\\-–—]?\\s*({v.EMAIL})', 1), ''), regexp_extract(x, '{v.EMAIL}')) AS email FROM c""")
def first_email(s, d):
    return read(s, d, "customer").selectExpr("c_custkey", f"{_CONTACT} AS x").select("c_custkey", v.first_email(F.col("x")).alias("email"))


#: Sentences with a number in many forms, and rows of years that are none.
_CALL = f"""CASE c_custkey % 12 WHEN 0 THEN '2019 2020 Mobile no: ' || {_NUMBER} WHEN 1 THEN 'since 2018 20192020 and ' || {_NUMBER} WHEN 2 THEN '20182019202020212022' WHEN 3 THEN 'tel 022 2345 6789'
WHEN 4 THEN 'Call +91 ' || substr({_NUMBER}, 1, 2) || ' ' || substr({_NUMBER}, 3, 2) || ' ' || substr({_NUMBER}, 5, 2) || ' ' || substr({_NUMBER}, 7, 2) || ' ' || substr({_NUMBER}, 9, 2) WHEN 5 THEN substr({_NUMBER}, 1, 5) || ' ' || substr({_NUMBER}, 6, 5)
WHEN 6 THEN 'Mobile: 98' || substr('20192020202120', 1 + CAST(c_custkey % 4 AS INTEGER), 8) WHEN 7 THEN 'Phone - (022) 2345-' || substr({_NUMBER}, 1, 4) WHEN 8 THEN 'a 9 9 7 0 3 8 8 0 0 ' || CAST(c_custkey % 10 AS STRING) WHEN 9 THEN '01234567890 or +1 (415) 555-2671' WHEN 10 THEN 'cell 12345' ELSE 'none' END"""
_FIGURES = "regexp_replace({0}, '[^0-9]', '', 'g')"
_YEARS_IN = f"regexp_extract_all({_FIGURES}, '(?:19|20)[0-9]{{{{2}}}}')"
_IS_PHONE = f"""{_FIGURES} <> '' AND NOT (length({_FIGURES}) >= 12 AND len({_YEARS_IN}) >= 2 AND contains({_FIGURES}, array_to_string({_YEARS_IN}, ''))) AND (regexp_matches({_FIGURES}, '^[6-9][0-9]{{{{9}}}}$|^91[6-9][0-9]{{{{9}}}}$|^0[0-9]{{{{10}}}}$')
OR (length({_FIGURES}) BETWEEN 7 AND 13 AND NOT regexp_matches({_FIGURES}, '(?:19|20)[0-9]{{{{2}}}}(?:19|20)[0-9]{{{{2}}}}')))""".format("c")
_JOINED = "trim(regexp_replace(regexp_replace({0}, '([0-9])\\s+([0-9])', '\\1\\2', 'g'), '([0-9])\\s+([0-9])', '\\1\\2', 'g'))"
_SHAPED = "flatten([" + ", ".join(f"list_transform(regexp_extract_all({{0}}, '{x.replace('{', '{{').replace('}', '}}')}'), lambda y: trim(y))" for x in v.PHONE_SHAPES) + "])"
_LABELLED = _JOINED.format(f"regexp_extract(x, '{v.PHONE_LABEL}', 1)")
_PLUS = _JOINED.format(f"regexp_extract(head, '{v.PHONE_PLUS}', 1)")


@query("ST22_first_phone", f"""WITH t AS (SELECT 'customer' AS kind, c_custkey AS id, {_CALL} AS x FROM customer UNION ALL SELECT 'document', doc_id, text FROM documents),
j AS (SELECT *, substr(x, 1, {v.PHONE_HEAD}) AS head, {_JOINED.format('x')} AS jx, {_JOINED.format(f'substr(x, 1, {v.PHONE_HEAD})')} AS jh FROM t),
found AS (SELECT kind, id, list_concat([{_LABELLED}, {_PLUS}], {_SHAPED.format('head')}, {_SHAPED.format('jh')}, {_SHAPED.format('x')}, {_SHAPED.format('jx')}, [{_FIGURES.format(f"regexp_extract(x, '{v.PHONE_SPACED}', 1)")}]) AS found FROM j)
SELECT kind, id, coalesce(list_filter(found, lambda c: {_IS_PHONE})[1], '') AS phone FROM found""")
def first_phone(s, d):
    """The number of every customer's sentence and of every document's whole text."""
    said = read(s, d, "customer").selectExpr("'customer' AS kind", "c_custkey AS id", f"{_CALL} AS x").unionByName(read(s, d, "documents").selectExpr("'document' AS kind", "doc_id AS id", "text AS x"))
    return spread(said, "id").select("kind", "id", v.first_phone(F.col("x")).alias("phone"))


_CELL = "'Languages: JS, ' || lower(substr(p_type, 1, 8)) || '/C++' || chr(10) || CASE p_size % 3 WHEN 0 THEN 'Tools - K8s; 12; x' WHEN 1 THEN 'golang | ms sql' ELSE p_brand || ',js' END"
_ALIAS = "map {" + ", ".join(f"'{k}': '{x}'" for k, x in v.SKILL_ALIAS.items()) + "}"


_HEADED = "'TECHNICAL SKILLS' || chr(10) || 'Web & Tools, ' || " + _CELL
_SPLIT_STEPS = f"""part_rows AS (SELECT p_partkey, unnest(regexp_split_to_array(x, '[\\n;|]+')) AS part, generate_subscripts(regexp_split_to_array(x, '[\\n;|]+'), 1) AS i FROM cells),
cut AS (SELECT p_partkey, i, regexp_replace(part, '{v.SKILL_LABEL}', '') AS b FROM part_rows),
bare AS (SELECT p_partkey, i, CASE WHEN contains(b, ':') AND len(list_filter(regexp_split_to_array(split_part(b, ':', 1), '\\s+'), lambda w: w <> '')) <= 3 THEN substr(b, strpos(b, ':') + 1) ELSE b END AS b FROM cut),
pieces AS (SELECT p_partkey, i, unnest(regexp_split_to_array(b, '[,/]+')) AS x, generate_subscripts(regexp_split_to_array(b, '[,/]+'), 1) AS j FROM bare),
normed AS (SELECT p_partkey, i, j, trim({_norm('x')}, ' .;') AS n, list_filter(string_split(replace({_norm('x')}, '&', ' '), ' '), lambda w: w <> '') AS w FROM pieces),
keys AS (SELECT p_partkey, i, j, coalesce({_ALIAS}[n], {_ALIAS}[replace(n, ' ', '')], n) AS k, len(w) > 0 AND len(list_filter(w, lambda q: NOT list_contains({_list(v.SKILL_HEADING)}, q))) = 0 AS heading FROM normed),
firsts AS (SELECT p_partkey, k, min((i, j)) AS place, min((i, j)) FILTER (NOT heading) AS gold_place FROM keys WHERE length(k) >= 2 AND NOT regexp_matches(k, '^[0-9]+$') GROUP BY ALL)"""


@query("ST17_split_skills", f"""WITH cells AS (SELECT p_partkey, {_HEADED} AS x FROM part), {_SPLIT_STEPS}
SELECT p_partkey, string_agg(k, ',' ORDER BY place) AS skills, string_agg(k, ',' ORDER BY gold_place) FILTER (gold_place IS NOT NULL) AS gold_skills FROM firsts GROUP BY p_partkey""")
def split_skills(s, d):
    """The skills of a cell as found, and as gold, where category labels don't count."""
    rows = spread(read(s, d, "part").select("p_partkey", "p_type", "p_size", "p_brand"), "p_partkey").selectExpr("p_partkey", f"{_HEADED} AS x")
    return rows.select("p_partkey", F.array_join(v.split_skills(F.col("x")), ",").alias("skills"), F.array_join(v.split_skills(F.col("x"), True), ",").alias("gold_skills"))


_PHRASES = ("standard", "small", "medium", "large", "economy", "promo", "brass", "steel", "tin", "copper", "nickel", "tin plate")


@query("ST16_keywords", f"SELECT p_partkey, array_to_string(list_filter({_list(_PHRASES)}, lambda p: contains(' ' || regexp_replace(lower(p_type), '[^a-z0-9+#]+', ' ', 'g') || ' ', ' ' || p || ' ')), ',') AS found FROM part")
def keywords(s, d):
    return read(s, d, "part").select("p_partkey", F.array_join(v.keywords(F.col("p_type"), list(_PHRASES)), ",").alias("found"))


_COMPANY = "CASE s_suppkey % 6 WHEN 0 THEN s_name || ' Private Limited' WHEN 1 THEN s_name || ', Inc.' WHEN 2 THEN s_name || ' PVT. LTD.' WHEN 3 THEN s_name || ' Ltd Inc' WHEN 4 THEN '  ' || s_name ELSE s_name || ' llc' END"
_COMPANY_KEY = "CASE " + " ".join(f"WHEN ends_with(s, '{f}') THEN trim(substr(s, 1, length(s) - {len(f)}), ' ,.-')" for f in v.COMPANY_FORMS) + " ELSE s END"


@query("ST20_company_key", f"SELECT s_suppkey, {_COMPANY_KEY} AS company FROM (SELECT s_suppkey, trim(lower({_COMPANY})) AS s FROM supplier)")
def company_key(s, d):
    return read(s, d, "supplier").selectExpr("s_suppkey", f"{_COMPANY} AS x").select("s_suppkey", v.company_key(F.col("x")).alias("company"))


_LOG = "CASE event_id % 9 WHEN 0 THEN 'got Bearer abc.def' WHEN 1 THEN 'BASIC Zm9v x' WHEN 2 THEN 'Authorization: Digest a b c' WHEN 3 THEN 'Cookie: a=b; c=d' WHEN 4 THEN 'session=' || event_type || '; ok' WHEN 5 THEN 'postgresql+psycopg://u:pw@h/db' WHEN 6 THEN 'rediss://u:pw@h' WHEN 7 THEN 'redis://pw@h' ELSE 'POST https://h.org/api/webhook/' || event_type || '?x=1' END"
_REDACTED = _LOG
for _pattern, _by in v.CREDENTIALS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_by.replace('$', chr(92))}', 'g')"


@query("ST18_credentials", f"SELECT event_id, {_REDACTED} AS line FROM events")
def redact(s, d):
    return read(s, d, "events").selectExpr("event_id", f"{_LOG} AS x").select("event_id", v.redact(F.col("x")).alias("line"))


@query("ST19_redact_map", f"""SELECT event_id, 'type' AS key, event_type AS value FROM events UNION ALL SELECT event_id, 'Api_Key', '[REDACTED]' FROM events UNION ALL SELECT event_id, 'user_token', '[REDACTED]' FROM events UNION ALL SELECT event_id, 'note', {_REDACTED} FROM events""")
def redact_map(s, d):
    rows = read(s, d, "events").selectExpr("event_id", f"map('type', event_type, 'Api_Key', props, 'user_token', props, 'note', {_LOG}) AS m")
    return rows.select("event_id", F.explode(v.redact_map(F.col("m"))).alias("key", "value"))


_DATE = "CASE o_orderkey % 8 WHEN 0 THEN strftime_ WHEN 1 THEN 'till date' WHEN 2 THEN '3/' || y WHEN 3 THEN 'March ' || y WHEN 4 THEN 'Sept. ''' || substr(y, 3, 2) WHEN 5 THEN 'in ' || y WHEN 6 THEN 'foo ' || y ELSE 'none' END".replace("strftime_", "y || '-7'")
_ORDERS = f"SELECT o_orderkey, y, {_DATE} AS x FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS STRING) AS y FROM orders)"


def _dated(s, d) -> DataFrame:
    return read(s, d, "orders").selectExpr("o_orderkey", "CAST(year(o_orderdate) AS STRING) AS y").selectExpr("o_orderkey", "y", f"{_DATE} AS x")


_MONTH = "CASE o_orderkey % 8 WHEN 0 THEN y || '-07' WHEN 1 THEN 'present' WHEN 2 THEN y || '-03' WHEN 3 THEN y || '-03' WHEN 4 THEN y || '-09' WHEN 5 THEN y WHEN 6 THEN y ELSE '' END"


@query("DT2_month_key", f"SELECT o_orderkey, {_MONTH} AS month FROM ({_ORDERS})")
def month_key(s, d):
    """The SQL states the key of each form of date."""
    return _dated(s, d).select("o_orderkey", v.month_key(F.col("x")).alias("month"))


#: Lines with dates in many forms.
_SPOKEN = """CASE o_orderkey % 16 WHEN 0 THEN 'Clerk, Jan 2001 – Mar ' || y WHEN 1 THEN 'since ' || y WHEN 2 THEN 'no dates' WHEN 3 THEN 'Jan ' || y || '-Mar 2021' WHEN 4 THEN '01/' || y || '-03/2021' WHEN 5 THEN y || '-2021' WHEN 6 THEN '(09/' || y || ') – (06/2023)'
WHEN 7 THEN 'May ' || y WHEN 8 THEN 'SQL Server since ' || y WHEN 9 THEN 'Oracle, since May ' || y WHEN 10 THEN '5,Jan, ' || y || ' to 3rd Feb 2022' WHEN 11 THEN 'Aug’' || substr(y, 3, 2) || ' - present' WHEN 12 THEN '(Jun ' || y || ' — Aug 2023)' WHEN 13 THEN 'Sep ' || y || ' till date'
WHEN 14 THEN '12/05/' || y || ' - 01/06/2020' ELSE 'Windows ' || y END"""


def _plain(x: str) -> str:
    """The SQL of ``values.unified``."""
    return f"regexp_replace(regexp_replace(translate({x}, '{(v.QUOTES + v.DASHES + v.BULLETS).replace(chr(39), chr(39) * 2)}' || chr(160), '{v.PLAIN_QUOTES.replace(chr(39), chr(39) * 2)}{'-' * len(v.DASHES)}{' ' * (len(v.BULLETS) + 1)}'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _token(x: str) -> str:
    """The SQL of ``values.month_token``."""
    low, months = f"trim(lower({x}))", "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    part = lambda pattern, k: f"nullif(regexp_extract({low}, '{pattern}', {k}), '')"
    two, slashed, year_first = part("([0-9]{2})$", 1), "([0-9]{1,2})[/\\-]((?:19|20)[0-9]{2})$", "^((?:19|20)[0-9]{2})\\s*[/\\-]\\s*([0-9]{1,2})$"
    return f"""coalesce(CASE WHEN regexp_matches({low}, '(?i)^{v.OPEN_END}$') THEN 'present' END, coalesce({part("((?:19|20)[0-9]{2})$", 1)}, CASE WHEN {two} < '80' THEN '20' ELSE '19' END || {two}) || '-' || lpad(CAST(list_position({_list(v.MONTHS)}, {part(months, 1)}) AS VARCHAR), 2, '0'),
{part(slashed, 2)} || '-' || lpad({part(slashed, 1)}, 2, '0'), {part(year_first, 1)} || '-' || lpad({part(year_first, 2)}, 2, '0'), {low})"""


@query("DT3_date_range", f"""WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders),
l AS (SELECT 'order' AS kind, o_orderkey AS id, 1 AS pos, {_SPOKEN} AS line FROM o UNION ALL SELECT 'document', doc_id, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM documents),
u AS (SELECT kind, id, pos, {_plain('line')} AS p FROM l),
t AS (SELECT kind, id, pos, regexp_replace(CASE WHEN regexp_matches(p, '^\\([^()]*\\)$') THEN trim(regexp_replace(p, '^\\(|\\)$', '', 'g')) ELSE p END, '(?i)\\(\\s*({_sql(v.DATE_ATOM)})\\s*\\)', '\\1', 'g') AS p FROM u),
g AS (SELECT *, regexp_extract(p, '{_sql(v.DATE_SPAN)}', 1) AS a, regexp_extract(p, '{_sql(v.DATE_SPAN)}', 2) AS b, regexp_extract(p, '{_sql(v.DATE_TILL)}', 1) AS till, regexp_extract(p, '{_sql(v.DATE_SINCE)}', 1) AS since, regexp_extract(p, '(?i)\\b({_sql(v.DATE_ATOM)})', 1) AS single, regexp_matches(p, '{v.PRODUCT}') AS product FROM t),
k AS (SELECT *, CASE WHEN a <> '' THEN 1 WHEN till <> '' THEN 2 WHEN since <> '' AND NOT (product AND regexp_matches(since, '^(?:19|20)[0-9]{{2}}$')) THEN 3 WHEN regexp_matches(p, '(?i)^{v.OPEN_END}$') THEN 4 WHEN single <> '' AND NOT product THEN 5 END AS form FROM g)
SELECT kind, id, pos, CASE form WHEN 1 THEN {_token('a')} WHEN 2 THEN {_token('till')} WHEN 3 THEN {_token('since')} WHEN 4 THEN '' ELSE {_token('single')} END AS start_month, CASE form WHEN 1 THEN {_token('b')} WHEN 5 THEN '' ELSE 'present' END AS end_month FROM k WHERE form IS NOT NULL""")
def date_range(s, d):
    """The dates of every line of every document, and of lines written out of orders."""
    spoken = read(s, d, "orders").selectExpr("o_orderkey", "CAST(year(o_orderdate) AS STRING) AS y").selectExpr("'order' AS kind", "o_orderkey AS id", "1 AS pos", f"{_SPOKEN} AS line")
    lines = read(s, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)
    return spoken.unionByName(lines).select("kind", "id", "pos", v.date_range(F.col("line")).alias("r")).where("r is not null").select("kind", "id", "pos", F.col("r.start").alias("start_month"), F.col("r.end").alias("end_month"))


@query("DT1_year_set", f"SELECT o_orderkey, array_to_string(list_sort(list_distinct([y, CASE WHEN o_orderkey % 100 > 50 THEN '19' ELSE '20' END || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')])), ' ') AS years FROM ({_ORDERS})")
def year_set(s, d):
    text = F.expr("y || ' to Feb''' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')")
    return _dated(s, d).select("o_orderkey", F.array_join(v.year_set(text), " ").alias("years"))


@query("DT4_hour_bucket", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H') AS bucket FROM events")
def hour_bucket(s, d):
    return read(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH").alias("bucket"))


@query("DT6_expiry", "SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS expires_at, o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1996-01-01' AS expired FROM orders")
def expiry(s, d):
    expires = F.col("o_orderdate") + F.expr("interval 30 days")
    return read(s, d, "orders").select("o_orderkey", expires.alias("expires_at"), (expires <= F.expr("timestamp_ntz'1996-01-01'")).alias("expired"))


@query("DT7_slots", """WITH days AS (SELECT n_nationkey AS org_id, CAST(unnest(generate_series(TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-12', INTERVAL 1 DAY)) AS TIMESTAMP) AS day FROM nation),
slots AS (SELECT org_id, day + to_hours(h) AS local_at FROM days, (SELECT CAST(unnest(range(10, 17)) AS INTEGER) AS h) WHERE isodow(day) <= 5)
SELECT org_id, local_at, local_at - INTERVAL 330 MINUTE AS utc_at FROM slots QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY local_at) <= 40""")
def slots(s, d):
    """Each organisation's first 40 hourly slots, Monday to Friday from 10 to 17 local time (+05:30), with their times in UTC."""
    days = read(s, d, "nation").select(F.col("n_nationkey").alias("org_id"), F.explode(F.expr("sequence(date'2024-02-01', date'2024-02-12')")).alias("day")).where("weekday(day) < 5")
    local = days.select("org_id", F.explode(F.expr("transform(sequence(10, 16), h -> cast(day as timestamp_ntz) + make_dt_interval(0, h))")).alias("local_at"))
    first = local.groupBy("org_id").agg(F.slice(F.sort_array(F.collect_list("local_at")), 1, 40).alias("at"))  # 84 slots an organisation at most
    return first.select("org_id", F.explode("at").alias("local_at")).select("org_id", "local_at", (F.col("local_at") - F.expr("interval 330 minutes")).alias("utc_at"))


_QUALITY = r"""WITH s AS (SELECT kind, doc_id, regexp_replace(text, '\A\s+|\s+\z', '', 'g') AS s FROM (SELECT 'whole' AS kind, doc_id, text FROM documents UNION ALL SELECT 'made up', doc_id, CASE doc_id % 5 WHEN 0 THEN substr(text, 1, 60) WHEN 1 THEN '(cid:1)(cid:2)(cid:3) ' || substr(text, 1, 9) WHEN 2 THEN ' ' WHEN 3 THEN repeat('#-', 30) ELSE upper(text) END FROM documents)),
f AS (SELECT kind, doc_id, length(s) AS n, length(regexp_replace(s, '[^\p{L}\p{N}]', '', 'g')) AS letters, len(regexp_split_to_array(s, '\s+')) AS words, (length(lower(s)) - length(replace(lower(s), 'cid:', ''))) // 4 >= 3 AS broken,
  regexp_matches(s, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}') OR regexp_matches(s, '\b[6-9][0-9]{9}\b|\+[0-9][0-9\s\-()]{8,}[0-9]') OR regexp_matches(s, '(?i)\b(?:experience|education|skills|summary|engineer|developer|bachelor|master|university|college|resume|curriculum)\b') AS telling FROM s)
SELECT kind, doc_id, CASE WHEN n = 0 THEN 'EMPTY' WHEN broken AND NOT telling THEN 'GARBAGE' WHEN n BETWEEN 30 AND 400 AND letters < 0.35 * n AND NOT telling THEN 'GARBAGE' WHEN telling AND letters >= 0.35 * n THEN 'GOOD' WHEN n < 80 AND NOT telling THEN 'WEAK' WHEN letters >= 0.35 * n OR words >= 8 THEN 'GOOD' ELSE 'WEAK' END AS quality FROM f"""


@query("ST14_text_quality", _QUALITY)
def text_quality(s, d):
    """Every whole text, and one made up from it that is short, broken, blank or bare of letters."""
    docs = read(s, d, "documents")
    made = docs.selectExpr("'made up' AS kind", "doc_id", "CASE doc_id % 5 WHEN 0 THEN substr(text, 1, 60) WHEN 1 THEN '(cid:1)(cid:2)(cid:3) ' || substr(text, 1, 9) WHEN 2 THEN ' ' WHEN 3 THEN repeat('#-', 30) ELSE upper(text) END AS text")
    rows = docs.selectExpr("'whole' AS kind", "doc_id", "text").unionByName(made)
    return rows.select("kind", "doc_id", v.text_quality(F.col("text")).alias("quality"))


@F.pandas_udf(StringType())
def compatible(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility forms (NFKC), for which there is no expression."""
    for batch in texts:
        yield batch.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@query("ST5_unified", """SELECT conv_id, turn, trim(regexp_replace('"' || text || '"' || ' - file x', '[ \\t]+', ' ', 'g')) AS unified FROM conversations""".replace("\\\\", "\\"))
def unified(s, d):
    rows = read(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("“"), "text", F.lit("”  — • ﬁle ｘ")).alias("text"))
    return rows.select("conv_id", "turn", v.unified(compatible("text")).alias("unified"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks of two short strings (Ratcliff-Obershelp), for which there is no expression."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else float(x == y) for x, y in zip(a, b, strict=True)])


@query("ST9_ratio")
def ratio(s, d):
    """The larger of sequence similarity and token overlap; a test compares it with a loop."""
    rows = pairs(s, d, "name").select("c_custkey", v.norm(F.col("gold")).alias("g"), v.norm(F.col("found")).alias("f"))
    return rows.select("c_custkey", "g", "f", F.greatest(sequence_ratio("g", "f"), t.token_f1(t.tokens(F.col("g")), t.tokens(F.col("f")))).alias("ratio"))
