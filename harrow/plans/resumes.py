"""Sections and entries of résumés and job descriptions. The texts are the documents', and résumés and job descriptions written out of customers, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import values as v
from harrow.operators import sections as op
from harrow.operators.relational import spread
from harrow.plans.registry import query
from harrow.plans.tables import read
from harrow.plans.values import _IS_PHONE, _SHAPED, _list, _plain, _sql, _token

_ROLES = "CASE o_orderkey % 4 WHEN 0 THEN 'Data Analyst' WHEN 1 THEN 'Software Engineer' WHEN 2 THEN 'Cloud Intern' ELSE 'Test Lead' END"
_FIRM = "CASE o_orderkey % 3 WHEN 0 THEN 'Acme ' || o_orderstatus || ' Labs' WHEN 1 THEN 'River ' || CAST(o_orderkey % 50 AS STRING) ELSE 'Grey Ltd' END"
#: One job of a résumé, in six layouts, three lines each (an empty line counts).
_JOB = f"""CASE o_orderkey % 6 WHEN 0 THEN {_ROLES} || ' - ' || {_FIRM} || chr(10) || 'Mar ' || y || ' - Present' || chr(10) || '• Built ' || lower({_ROLES}) || ' things' WHEN 1 THEN {_FIRM} || ' | Thane' || chr(10) || {_ROLES} || chr(10) || '● Kept them'
WHEN 2 THEN '07/' || y || ' – 10/' || y || ' | Remote' || chr(10) || {_ROLES} || chr(10) || '• Wrote, tested, shipped.' WHEN 3 THEN {_ROLES} || ' - ' || {_FIRM} || ' - (Jun ' || y || ' - Aug ' || y || ')' || chr(10) || '- Automated' || chr(10)
WHEN 4 THEN {_FIRM} || chr(10) || {_ROLES} || chr(10) || y || '-' || CAST(CAST(y AS INT) + 1 AS STRING) ELSE {_ROLES} || ' — ' || {_FIRM} || chr(10) || 'Jan ' || y || ' till date' || chr(10) || 'Pune, India' END"""
_HEAD = """c_name || chr(10) || lower(c_mktsegment) || '@mail.example' || chr(10) || chr(10) || CASE c_custkey % 4 WHEN 0 THEN 'SKILLS' || chr(10) || 'Python, SQL, ' || lower(c_mktsegment) WHEN 1 THEN 'Key Skills: Go, Java' WHEN 2 THEN '___TECHNICAL SKILLS___' || chr(10) || 'Rust' ELSE 'Skills & Abilities' || chr(10) || 'SQL, Spark, Arrow and a good deal of ' || lower(c_mktsegment) END
|| chr(10) || CASE c_custkey % 3 WHEN 0 THEN 'EXPERIENCE' WHEN 1 THEN 'Professional Experience:' ELSE '=== Employment History ===' END"""
_FOOT = """CASE c_custkey % 3 WHEN 0 THEN 'Contact' || chr(10) || 'Ask ' || c_name WHEN 1 THEN 'Hobbies' || chr(10) || 'Chess' ELSE '' END || chr(10) || 'Education' || chr(10) || CASE c_custkey % 4 WHEN 0 THEN 'B.Sc Computer Science - Lake University' WHEN 1 THEN 'BCA' || chr(10) || 'Hill College' || chr(10) || '2015 - 2018' || chr(10) || 'HSC - Town School'
WHEN 2 THEN 'Sea University' || chr(10) || 'Bachelor of Arts, CGPA: 8.1' || chr(10) || 'Lake University' || chr(10) || 'MBA' ELSE 'Diploma in Art | Hill Institute | 2001-2003' || chr(10) || '72.5%' END || CASE c_custkey % 5 WHEN 0 THEN chr(10) || 'Skills' || chr(10) || 'Python, SQL' ELSE '' END"""


def resumes(s, d) -> DataFrame:
    """(id, text): a résumé of each customer that has orders, a job for each order, newest first."""
    jobs = spread(read(s, d, "orders").selectExpr("o_custkey AS id", "o_orderkey", "o_orderstatus", "CAST(year(o_orderdate) AS STRING) AS y"), "id").selectExpr("id", "o_orderkey", f"{_JOB} AS job")
    listed = jobs.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_orderkey")).alias("k"), "job"))), lambda j: j["job"]), "\n").alias("jobs"))
    people = spread(read(s, d, "customer").withColumnRenamed("c_custkey", "id"), "id").selectExpr("id", f"{_HEAD.replace('c_custkey', 'id')} AS head", f"{_FOOT.replace('c_custkey', 'id')} AS foot")
    return people.join(listed.hint("merge"), "id").select("id", F.concat_ws("\n", "head", "jobs", "foot").alias("text"))


_RESUMES = f"""resumes AS (SELECT c_custkey AS id, ({_HEAD}) || chr(10) || jobs || chr(10) || ({_FOOT}) AS text FROM customer JOIN
(SELECT o_custkey AS k, string_agg(job, chr(10) ORDER BY o_orderkey DESC) AS jobs FROM (SELECT o_custkey, o_orderkey, {_JOB} AS job FROM (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)) GROUP BY o_custkey) ON k = c_custkey)"""


def _table(names: dict[str, tuple[str, ...]]) -> str:
    rows = sorted({(key.replace(" ", ""), label) for label, keys in names.items() for key in keys})
    return "headings(key, label) AS (VALUES " + ", ".join(f"('{k}', '{x}')" for k, x in rows) + ")"


_EDGE = "^[\\s_\\-=~*•·#]+|[\\s_\\-=~*•·:#]+$"
_KEY = "regexp_replace(replace(lower({0}), '&', 'and'), '[^a-z0-9]', '', 'g')"


def _sectioned(texts: str, names: dict[str, tuple[str, ...]]) -> str:
    """The SQL of ``sections.sectioned`` over a relation (kind, id, text): CTEs up to ``lines``."""
    return f"""{_table(names)},
split AS (SELECT kind, id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), 1) - 1 AS pos FROM {texts}),
parted AS (SELECT *, contains(line, ':') AND trim(substr(line, strpos(line, ':') + 1)) <> '' AS inl FROM split),
bare AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN inl THEN split_part(line, ':', 1) ELSE line END, '{_EDGE}', '', 'g'), '[_\\-=~]{{2,}}', ' ', 'g') AS bare FROM parted),
keyed AS (SELECT *, CASE WHEN NOT regexp_matches(line, '{op.TICK}') AND length(bare) BETWEEN 1 AND 80 AND len(list_filter(regexp_split_to_array(bare, '\\s+'), lambda w: w <> '')) <= 8
  AND NOT (ends_with(trim(line), '.') AND len(list_filter(regexp_split_to_array(bare, '\\s+'), lambda w: w <> '')) > 3) AND NOT regexp_matches(bare, '{op.DUTY}') AND NOT regexp_matches(bare, '@|[0-9]{{6}}')
  AND NOT list_contains({_list(op.TITLES)}, {_KEY.format('bare')}) AND (NOT inl OR list_contains({_list(op.INLINE)}, {_KEY.format('bare')})) THEN {_KEY.format('bare')} END AS key FROM bare),
labelled AS (SELECT k.*, h.label AS label, CASE WHEN h.label IS NOT NULL AND inl THEN trim(substr(line, strpos(line, ':') + 1)) ELSE '' END AS rest FROM keyed k LEFT JOIN headings h USING (key)),
past AS (SELECT *, last_value(CASE WHEN label NOT IN ({', '.join(f"'{x}'" for x in op.IN_JOB)}) THEN label END IGNORE NULLS) OVER (PARTITION BY kind, id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM labelled),
own AS (SELECT *, CASE WHEN label IN ({', '.join(f"'{x}'" for x in op.IN_JOB)}) AND coalesce(past, '') = 'Experience' THEN NULL ELSE label END AS own FROM past),
lines AS (SELECT kind, id, pos, line, own IS NOT NULL AS heading, CASE WHEN own IS NOT NULL THEN rest ELSE '' END AS rest, count(own) OVER w AS section, coalesce(last_value(own IGNORE NULLS) OVER w, 'Preamble') AS label FROM own WINDOW w AS (PARTITION BY kind, id ORDER BY pos))"""


@query("DM9_sections", f"""WITH RECURSIVE {_RESUMES}, texts AS (SELECT 'resume' AS kind, id, text FROM resumes UNION ALL SELECT 'document', doc_id, text FROM documents), {_sectioned('texts', op.RESUME_HEADINGS)},
bodies AS (SELECT kind, id, section, label, min(pos) AS first, bool_or(heading) AS headed, coalesce(string_agg(CASE WHEN heading THEN nullif(rest, '') ELSE nullif(trim(line), '') END, chr(10) ORDER BY pos), '') AS body FROM lines GROUP BY kind, id, section, label),
found AS (SELECT *, list_distinct(regexp_extract_all(lower(body), '[a-z0-9]{{2,}}')) AS tokens, row_number() OVER (PARTITION BY kind, id, label ORDER BY section) AS k FROM bodies WHERE headed OR body <> ''),
walk AS (SELECT kind, id, label, k, section, false AS repeats, length(body) AS best, tokens AS known FROM found WHERE k = 1 AND label IN ({', '.join(f"'{x}'" for x in op.ONCE)}) UNION ALL
SELECT f.kind, f.id, f.label, f.k, f.section, r, CASE WHEN NOT r AND length(f.body) > w.best THEN length(f.body) ELSE w.best END, CASE WHEN NOT r AND length(f.body) > w.best THEN f.tokens ELSE w.known END FROM walk w JOIN found f ON f.kind = w.kind AND f.id = w.id AND f.label = w.label AND f.k = w.k + 1,
LATERAL (SELECT len(f.tokens) = 0 OR (len(w.known) > 0 AND len(list_intersect(f.tokens, w.known)) >= 0.85 * len(f.tokens) AND len(f.tokens) - len(list_intersect(f.tokens, w.known)) <= 3) AS r))
SELECT f.kind, f.id, f.section, CASE WHEN coalesce(w.repeats, false) THEN 'Unclassified' ELSE f.label END AS label, CASE WHEN coalesce(w.repeats, false) OR (f.label IN ({', '.join(f"'{x}'" for x in op.CONTENT)}) AND length(body) < {op.SHORT}) THEN 'uncertain' ELSE 'heuristic' END AS source,
first, CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END AS lines, body FROM found f LEFT JOIN walk w ON f.kind = w.kind AND f.id = w.id AND f.section = w.section AND f.label = w.label""")
def sections(s, d):
    """The sections of every résumé and of every document's whole text."""
    headings = op.heading_table(s, op.RESUME_HEADINGS)
    found = [op.sections(op.sectioned(op.text_lines(texts, "text"), headings, "id"), "id").select(F.lit(kind).alias("kind"), "*") for kind, texts in (("resume", resumes(s, d)), ("document", spread(read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")))]
    return found[0].unionByName(found[1])


def _resume_rows(s, d) -> DataFrame:
    return op.sectioned(op.text_lines(resumes(s, d), "text"), op.heading_table(s, op.RESUME_HEADINGS), "id")


def _classified(label: str) -> str:
    """The SQL of ``sections.classified`` over the lines of a section: CTEs up to ``kinds``."""
    strip = f"CASE WHEN regexp_matches(p, '^\\([^()]*\\)$') THEN trim(regexp_replace(p, '^\\(|\\)$', '', 'g')) ELSE p END"
    return f"""inner_ AS (SELECT id, section, pos, trim(CASE WHEN heading THEN rest ELSE line END) AS line, {_plain("trim(CASE WHEN heading THEN rest ELSE line END)")} AS p FROM lines WHERE label = '{label}' AND (NOT heading OR rest <> '')),
texted AS (SELECT *, regexp_replace({strip}, '(?i)\\(\\s*({_sql(v.DATE_ATOM)})\\s*\\)', '\\1', 'g') AS t FROM inner_),
dates AS (SELECT *, regexp_extract(t, '{_sql(v.DATE_SPAN)}', 1) AS a, regexp_extract(t, '{_sql(v.DATE_SPAN)}', 2) AS b, regexp_extract(t, '{_sql(v.DATE_TILL)}', 1) AS till, regexp_extract(t, '{_sql(v.DATE_SINCE)}', 1) AS since, regexp_extract(t, '(?i)\\b({_sql(v.DATE_ATOM)})', 1) AS single, regexp_matches(t, '{v.PRODUCT}') AS product FROM texted),
forms AS (SELECT *, CASE WHEN a <> '' THEN 1 WHEN till <> '' THEN 2 WHEN since <> '' AND NOT (product AND regexp_matches(since, '^(?:19|20)[0-9]{{2}}$')) THEN 3 WHEN regexp_matches(t, '(?i)^{v.OPEN_END}$') THEN 4 WHEN single <> '' AND NOT product AND length(regexp_replace(regexp_replace(t, '(?i){_sql(v.DATE_ATOM)}', '', 'g'), '[^A-Za-z]', '', 'g')) = 0 THEN 5 END AS form FROM dates),
kinds AS (SELECT id, section, pos, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '{op.BULLET}') THEN 'bullet' WHEN form IS NOT NULL THEN 'date' WHEN length(line) <= 80 AND NOT regexp_matches(line, '[.;!?]$') AND NOT regexp_matches(line, '{op.DUTY}') THEN 'head' ELSE 'prose' END AS kind,
  CASE form WHEN 1 THEN {_token('a')} WHEN 2 THEN {_token('till')} WHEN 3 THEN {_token('since')} WHEN 4 THEN '' WHEN 5 THEN {_token('single')} END AS start_, CASE form WHEN 1 THEN {_token('b')} WHEN 5 THEN '' ELSE 'present' END AS end_,
  CASE WHEN NOT regexp_matches(line, '{op.BULLET}') AND form IS NOT NULL THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{_sql(v.DATE_SPAN)}', '', 'g'), '{_sql(v.DATE_TILL)}', '', 'g'), '(?i)\\b(?:since\\s+)?{_sql(v.DATE_ATOM)}', '', 'g'), '\\(\\s*\\)', '', 'g'), '^[\\s|,;:()\\-]+|[\\s|,;:()\\-]+$', '', 'g') ELSE regexp_replace(line, '{op.BULLET}', '') END AS bare FROM forms)"""


_ENTRIES = f"""roles AS (SELECT *, CASE WHEN kind = 'date' AND bare <> '' THEN 'titled' ELSE kind END AS form, regexp_matches(bare, '{op.PLACE}') AND NOT regexp_matches(bare, '{op.ROLE}') AS place, kind IN ('head', 'date') AND regexp_matches(bare, '{op.ROLE}') AS role FROM kinds),
ahead AS (SELECT *, row_number() OVER w AS k, first_value(CASE WHEN kind <> 'blank' THEN form END IGNORE NULLS) OVER r AS following, first_value(CASE WHEN kind NOT IN ('blank', 'head') THEN form END IGNORE NULLS) OVER r AS beyond,
  coalesce(first_value(CASE WHEN kind <> 'blank' THEN role END IGNORE NULLS) OVER r, false) AS next_role FROM roles WINDOW w AS (PARTITION BY id, section ORDER BY pos), r AS (PARTITION BY id, section ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
walk AS (SELECT id, section, 0::BIGINT AS k, 0 AS entry, 0 AS heads, false AS titled, false AS dated, false AS body, false AS gap FROM ahead WHERE k = 1 UNION ALL
SELECT w.id, w.section, l.k, w.entry + CASE WHEN o.opens THEN 1 ELSE 0 END, CASE WHEN o.opens THEN 0 ELSE w.heads END + CASE WHEN l.kind = 'head' OR (l.kind = 'date' AND l.bare <> '') THEN 1 ELSE 0 END,
  (w.titled AND NOT o.opens) OR (l.kind IN ('head', 'date') AND l.role), CASE l.kind WHEN 'date' THEN true ELSE w.dated AND NOT o.opens END, CASE WHEN l.kind IN ('bullet', 'prose') THEN w.entry > 0 ELSE w.body AND NOT o.opens END, l.kind = 'blank'
FROM walk w JOIN ahead l ON l.id = w.id AND l.section = w.section AND l.k = w.k + 1, LATERAL (SELECT CASE l.kind WHEN 'date' THEN w.entry = 0 OR w.dated OR w.body
  WHEN 'head' THEN w.entry = 0 OR w.body OR (w.dated AND w.heads > 0 AND (w.gap OR coalesce(l.following = 'date', false) OR w.heads >= 3 OR (coalesce(l.beyond IN ('date', 'titled'), false) AND NOT l.place) OR (w.titled AND (l.role OR (l.next_role AND NOT l.place)))))
    OR (NOT w.dated AND w.heads >= 3) ELSE false END AS opens) o)"""


@query("DM10_entries", f"WITH RECURSIVE {_RESUMES}, texts AS (SELECT 'resume' AS kind, id, text FROM resumes), {_sectioned('texts', op.RESUME_HEADINGS)}, {_classified('Experience')}, {_ENTRIES} SELECT l.id, l.section, l.pos, l.kind, w.entry FROM ahead l JOIN walk w ON w.id = l.id AND w.section = l.section AND w.k = l.k")
def entries(s, d):
    """Where entries of jobs begin: each line's kind and entry. The SQL walks the lines with a recursive query."""
    return op.experience_lines(_resume_rows(s, d), "id").select("id", "section", "pos", "kind", "entry")


_CUT = "list_filter(list_transform(regexp_split_to_array({0}, '\\s+(?:-|\\||at|@)\\s+|\\s*\\|\\s*|\\s*,\\s+'), lambda x: trim(x)), lambda x: x <> '')"


@query("DM10_experience", f"""WITH RECURSIVE {_RESUMES}, texts AS (SELECT 'resume' AS kind, id, text FROM resumes), {_sectioned('texts', op.RESUME_HEADINGS)}, {_classified('Experience')}, {_ENTRIES},
placed AS (SELECT l.*, w.entry FROM ahead l JOIN walk w ON w.id = l.id AND w.section = l.section AND w.k = l.k WHERE w.entry > 0),
made AS (SELECT id, section, entry, flatten(list({_CUT.format(_plain('bare'))} ORDER BY pos) FILTER (kind IN ('head', 'date') AND bare <> '')) AS pieces, arg_min(start_, pos) FILTER (kind = 'date') AS s, arg_min(end_, pos) FILTER (kind = 'date') AS e, count(*) FILTER (kind IN ('bullet', 'prose')) AS items FROM placed GROUP BY ALL),
titled AS (SELECT *, list_filter(coalesce(pieces, []), lambda p: regexp_matches(p, '{op.ROLE}'))[1] AS t FROM made), rest AS (SELECT *, list_filter(coalesce(pieces, []), lambda p: t IS NULL OR p <> t) AS o FROM titled)
SELECT id, section, entry, coalesce(t, '') AS title, CASE WHEN len(o) = 1 AND lower(o[1]) IN ('remote', 'onsite', 'hybrid') THEN '' ELSE coalesce(o[1], '') END AS company, CASE WHEN len(o) = 1 AND lower(o[1]) IN ('remote', 'onsite', 'hybrid') THEN o[1] ELSE array_to_string(o[2:3], ', ') END AS place,
coalesce(s, '') AS start_month, coalesce(e, '') AS end_month, items FROM rest""")
def experience(s, d):
    return op.experience(_resume_rows(s, d), "id").withColumnsRenamed({"start": "start_month", "end": "end_month"})


@query("DM10_education", f"""WITH RECURSIVE {_RESUMES}, texts AS (SELECT 'resume' AS kind, id, text FROM resumes), {_sectioned('texts', op.RESUME_HEADINGS)}, {_classified('Education')},
cut AS (SELECT *, row_number() OVER (PARTITION BY id, section ORDER BY pos) AS k, list_filter(list_transform(regexp_split_to_array(regexp_replace({_plain('bare')}, '{op.SCORE}', '', 'g'), '\\s+(?:-|\\||from)\\s+|\\s*\\|\\s*'), lambda p: regexp_replace(trim(p), '^[,;]+|[,;]+$', '', 'g')), lambda p: p <> '') AS parts,
  coalesce(nullif(regexp_extract({_plain('bare')}, '{op.SCORE}', 1), ''), nullif(regexp_extract({_plain('bare')}, '{op.SCORE}', 2), '')) AS score FROM kinds),
schools AS (SELECT *, list_filter(parts, lambda p: regexp_matches(p, '{op.SCHOOL}'))[1] AS school FROM cut), known AS (SELECT *, list_filter(parts, lambda p: regexp_matches(p, '{op.DEGREE}') AND p <> coalesce(school, ''))[1] AS degree FROM schools),
walk AS (SELECT id, section, 0::BIGINT AS k, 0 AS entry, false AS d, false AS s FROM known WHERE k = 1 UNION ALL SELECT w.id, w.section, l.k, w.entry + CASE WHEN o.opens THEN 1 ELSE 0 END, (w.d AND NOT o.opens) OR l.degree IS NOT NULL, (w.s AND NOT o.opens) OR l.school IS NOT NULL
FROM walk w JOIN known l ON l.id = w.id AND l.section = w.section AND l.k = w.k + 1, LATERAL (SELECT l.kind <> 'blank' AND (w.entry = 0 OR (l.degree IS NOT NULL AND w.d) OR (l.school IS NOT NULL AND w.s AND NOT (l.degree IS NOT NULL AND NOT w.d))) AS opens) o)
SELECT l.id, l.section, w.entry, coalesce(arg_min(degree, pos) FILTER (degree IS NOT NULL), '') AS degree, coalesce(arg_min(school, pos) FILTER (school IS NOT NULL), '') AS school, coalesce(arg_min(start_, pos) FILTER (kind = 'date'), '') AS start_month, coalesce(arg_min(end_, pos) FILTER (kind = 'date'), '') AS end_month,
coalesce(arg_min(score, pos) FILTER (score IS NOT NULL), '') AS score FROM known l JOIN walk w ON w.id = l.id AND w.section = l.section AND w.k = l.k WHERE w.entry > 0 GROUP BY l.id, l.section, w.entry""")
def education(s, d):
    return op.education(_resume_rows(s, d), "id").withColumnsRenamed({"start": "start_month", "end": "end_month"})


_ADVERT = """s_name || chr(10) || chr(10) || 'Location: Remote' || chr(10) || CASE s_suppkey % 3 WHEN 0 THEN 'About the role' ELSE 'Job Summary:' END || chr(10) || 'We look for one who runs things.' || chr(10) || chr(10) || 'Key Responsibilities' || chr(10) || '• Run parts for many' || chr(10) || '  customers of ours' || chr(10) || '● Answer calls' || chr(10)
|| CASE s_suppkey % 4 WHEN 0 THEN 'Required Skills:' || chr(10) || '• AWS, EC2' || chr(10) || '• Terraform.' WHEN 1 THEN 'Skills: C#, SQL Server; Azure' WHEN 2 THEN 'Must have' || chr(10) || 'Java' || chr(10) || 'and Spring' ELSE 'Nice-to-have' || chr(10) || chr(10) || 'lower case item, two' END"""


@query("DM11_job_items", f"""WITH texts AS (SELECT 'job' AS kind, s_suppkey AS id, {_ADVERT} AS text FROM supplier), {_sectioned('texts', op.JOB_HEADINGS)},
body AS (SELECT id, section, label, pos, CASE WHEN heading THEN rest ELSE line END AS line FROM lines WHERE NOT heading OR rest <> ''),
marked AS (SELECT *, trim(line) <> '' AND (regexp_matches(line, '{op.BULLET}') OR NOT regexp_matches(line, '^(?:\\s+\\S|[a-z])') OR coalesce(trim(lag(line) OVER (PARTITION BY id, section ORDER BY pos)) = '', true)) AS opens FROM body),
numbered AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY id, section ORDER BY pos) AS item FROM marked),
items AS (SELECT id, section, label, item, string_agg(regexp_replace(trim(line), '{op.BULLET}', ''), ' ' ORDER BY pos) AS text FROM numbered WHERE item > 0 AND trim(line) <> '' GROUP BY ALL),
parts AS (SELECT *, CASE WHEN label IN ('Required Skills', 'Preferred Skills', 'Skills') THEN list_filter(list_transform(regexp_split_to_array(text, '\\s*[,;]\\s*'), lambda x: regexp_replace(trim(x), '\\.$', '')), lambda x: x <> '') ELSE [text] END AS p FROM items)
SELECT id, section, label, item, generate_subscripts(p, 1) - 1 AS part, unnest(p) AS text FROM parts""")
def job_items(s, d):
    """The duties, skills and other items of every supplier's job description."""
    texts = read(s, d, "supplier").selectExpr("s_suppkey AS id", f"{_ADVERT} AS text")
    return op.job_items(op.sectioned(op.text_lines(texts, "text"), op.heading_table(s, op.JOB_HEADINGS), "id"), "id")


#: A form filled from a customer's résumé: some fields right, some empty, some from elsewhere.
_FORM = {
    "name": "CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN 'Someone Else' ELSE 'Customer#' || lpad(CAST(id AS STRING), 9, '0') END", "email": "CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'other@mail.example' ELSE regexp_extract(text, '[a-z]+@mail[.]example', 0) END",
    "phone": "CASE id % 5 WHEN 0 THEN '9876543210' ELSE '' END", "location": "CASE id % 4 WHEN 0 THEN 'Pune' WHEN 1 THEN 'DB Migration' ELSE '' END", "skills": "CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Cobol' ELSE 'SQL' END",
    "education": "CASE id % 2 WHEN 0 THEN 'given' ELSE '' END", "experience": "CASE id % 8 WHEN 0 THEN '' ELSE 'given' END", "preferred": "CASE id % 9 WHEN 0 THEN 'Pune' ELSE '' END",
}
#: What tells in a text that a field could be filled.
EVIDENCE = {
    "email": v.EMAIL, "phone": "(?:\\+91[\\s\\-]*)?\\b[6-9][0-9]{4}[\\s\\-]?[0-9]{5}\\b", "location": "(?im)^\\s*(?:current\\s+location|location|address|city)\\s*[:\\-]|\\bPune, India\\b", "education": "(?im)^\\W*(?:education|academic|qualification)|" + op.DEGREE[4:],
    "experience": "(?im)^\\W*(?:work\\s+|professional\\s+)?(?:experience|employment)\\b", "skills": "(?im)^\\W*(?:key\\s+|technical\\s+)?skills\\b", "name": "\\A[A-Z][A-Za-z#0-9]+",
}
SUSPECT_PLACE = "(?i)\\b(?:migration|installation|support|developer|engineer|sql|oracle|database)\\b"
_COVERED = ("name", "email", "phone", "location", "education", "experience")
_TRACED = ("name", "email", "phone", "location", "skills")


def _forms(s, d) -> DataFrame:
    return resumes(s, d).selectExpr("id", "text", *[f"{x} AS {k}" for k, x in _FORM.items()])


def covered(field: str) -> Column:
    """filled, recovered (an e-mail or number that the text gives), missing with or without evidence in the text."""
    value, text, evidence = F.col(field), F.col("text"), F.col("text").rlike(EVIDENCE[field])
    filled = (F.trim(value) != "") & (~value.rlike(SUSPECT_PLACE) if field == "location" else F.lit(True))
    found = {"email": v.first_email(text) != "", "phone": v.first_phone(text) != ""}.get(field, F.lit(False))
    return F.when(filled, "filled").when(found, "recovered").when(evidence, "missing_with_evidence").otherwise("missing_no_evidence")


def traced(field: str) -> Column:
    """fallback, ok, weak_missing (empty, with evidence), weak_ungrounded (not in the text, or no place), absent. A preferred place may repeat the present one."""
    if field == "preferred":
        return F.when((F.col(field) != "") & (F.col(field) == F.col("location")), "fallback").when(F.col(field) == "", "absent").when(F.lower("text").contains(F.lower(field)), "ok").otherwise("weak_ungrounded")
    value = F.col(field)
    implausible = value.rlike(SUSPECT_PLACE) if field == "location" else F.lit(False)
    return F.when((value == "") & F.col("text").rlike(EVIDENCE[field]), "weak_missing").when(value == "", "absent").when(implausible | ~F.lower("text").contains(F.lower(value)), "weak_ungrounded").otherwise("ok")


def _has(field: str) -> str:
    return f"regexp_matches(text, '{EVIDENCE[field]}')"


_FORMS = f"{_RESUMES}, forms AS (SELECT id, text, {', '.join(f'{x} AS {k}' for k, x in _FORM.items())} FROM resumes)"
_FOUND = {"email": f"regexp_matches(text, '{v.EMAIL}')", "phone": f"len(list_filter({_SHAPED.format('text')}, lambda c: {_IS_PHONE})) > 0"}


def _covered_sql(f: str) -> str:
    filled = f"trim({f}) <> ''" + (f" AND NOT regexp_matches({f}, '{SUSPECT_PLACE}')" if f == "location" else "")
    return f"SELECT '{f}' AS field, CASE WHEN {filled} THEN 'filled' WHEN {_FOUND.get(f, 'false')} THEN 'recovered' WHEN {_has(f)} THEN 'missing_with_evidence' ELSE 'missing_no_evidence' END AS status FROM forms"


@query("DM12_coverage", f"WITH {_FORMS} SELECT field, status, count(*) AS n FROM ({' UNION ALL '.join(_covered_sql(f) for f in _COVERED)}) GROUP BY ALL")
def coverage(s, d):
    """The fields of all forms by what is known of them."""
    rows = _forms(s, d).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), covered(f).alias("status")) for f in _COVERED])).alias("c"))
    return rows.groupBy("c.field", "c.status").agg(F.count("*").alias("n"))


def _traced_sql(f: str) -> str:
    implausible = f"regexp_matches({f}, '{SUSPECT_PLACE}') OR " if f == "location" else ""
    return f"SELECT id, '{f}' AS field, {f} AS value, CASE WHEN {f} = '' AND {_has(f)} THEN 'weak_missing' WHEN {f} = '' THEN 'absent' WHEN {implausible}NOT contains(lower(text), lower({f})) THEN 'weak_ungrounded' ELSE 'ok' END AS verdict FROM forms"


@query("AG41_field_trace", f"WITH {_FORMS} {' UNION ALL '.join(_traced_sql(f) for f in _TRACED)} UNION ALL SELECT id, 'preferred', preferred, CASE WHEN preferred <> '' AND preferred = location THEN 'fallback' WHEN preferred = '' THEN 'absent' WHEN contains(lower(text), lower(preferred)) THEN 'ok' ELSE 'weak_ungrounded' END FROM forms")
def field_trace(s, d):
    """A row for each field of each form, with its verdict by the résumé's text."""
    rows = _forms(s, d).select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), traced(f).alias("verdict")) for f in (*_TRACED, "preferred")])).alias("t"))
    return rows.select("id", "t.*")
