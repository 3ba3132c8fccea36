"""Sections of résumés and job descriptions, and the entries within them.

Lines are rows. A line is a heading if a table of heading names holds its key; unknown short lines are none. Each line belongs to the last
heading above it, found by a window over its document. Entries of a section come from a line grammar: lines are told apart by expressions,
and a fold over them in order opens, continues and closes entries. A document's lines are in one task; no text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions import text as t
from harrow.functions import values as v
from harrow.operators.folds import ordered_fold

#: Names of résumé headings by section. Their keys are letters and digits only, "and" for "&".
RESUME_HEADINGS = {
    "Experience": (
        "experience", "work experience", "professional experience", "employment", "employment details", "employment history", "work history", "work", "career timeline", "career history",
        "professional history", "professional background", "career experience", "current experience", "previous experience", "professional experience and accomplishments",
        "organisational experience", "organizational experience", "details of experience", "details of experience and project", "details of experience and projects",
        "experience and project", "experience and projects", "internship", "internships", "internship experience", "industrial training", "industrial trainings", "summer internship",
        "trainings", "training", "apprenticeship", "apprenticeships", "management internship", "research internship", "graduate internship", "training experience", "technical experience",
    ),
    "Skills": (
        "skills", "technical skills", "professional skills", "relevant skills", "core skills", "key skills", "additional skills", "skills highlights", "knowledge and skills", "knowledge skills",
        "technical skills and tools", "technical skills tools", "skills and abilities", "technical proficiency", "technical expertise", "technical knowledge", "technical skill", "soft skills",
        "core competencies", "areas of expertise", "computer skills", "it skills", "it skill", "software skills", "technologies", "tech stack", "tools", "other technical skills", "skillset", "skills set",
    ),
    "Education": (
        "education", "academic background", "academic details", "academic profile", "academic profiles", "academic qualifications", "academic qualification", "academics", "scholastic record",
        "scholastic details", "education qualification", "education qualifications", "educational qualifications", "educational qualification", "educational background", "educational details",
        "professional qualification", "professional qualifications", "qualification", "qualifications", "educational credentials", "educational credential",
    ),
    "Certifications": ("certifications", "certificates", "certifications and licenses", "professional certifications", "courses", "licenses"),
    "Summary": (
        "summary", "professional summary", "professional objective", "professional profile", "personal profile", "profile summary", "career objective", "career profile", "career summary",
        "objective", "profile", "about me", "work summary", "personal summary", "experience summary", "overview", "role overview", "professional synopsis",
    ),
    "Projects": (
        "projects", "project", "key project", "key projects", "academic projects", "academic project", "personal projects", "personal project", "major projects", "major project",
        "project experience", "project details", "project description", "project descriptions", "project summary",
    ),
    "Achievements": (
        "achievements", "performance achievements", "key achievements", "major achievements", "accomplishments", "awards", "honors", "honours", "awards and honors", "extracurricular achievements",
        "co curricular achievements", "achievements tasks",
    ),
    "Strengths": ("strengths", "key strengths", "areas of strength", "area of strength"),
    "Hobbies": ("hobbies", "hobby", "interests"),
    "Activities": ("activities", "extracurricular activities", "extra curricular", "co curricular activities", "leadership activities"),
    "Languages": ("languages", "linguistic proficiency", "language skills", "languages known"),
    "Personal Information": ("personal information",),
    "Personal Details": ("personal details", "biodata"),
    "Contact": ("contact", "contact details"),
    "References": ("references",),
    "Declaration": ("declaration",),
}
#: Names of a job description's headings by section.
JOB_HEADINGS = {
    "Responsibilities": ("responsibilities", "key responsibilities", "duties", "role responsibilities"),
    "Requirements": ("requirements",),
    "Qualifications": ("qualifications",),
    "Required Skills": ("required skills", "mandatory skills", "core skills", "primary skills", "technical skills", "key skills", "must have", "tech stack"),
    "Skills": ("skills",),
    "Preferred Skills": ("preferred skills", "nice to have"),
    "Benefits": ("benefits",),
    "Summary": ("about the role", "job description", "job summary", "role overview", "overview", "position summary"),
    "Experience": ("experience", "work experience"),
    "Location": ("location", "work location"),
}
#: Titles of documents; headings whose text may follow on their line; sections whose repeated bodies count once; those that
#: stay part of a job within Experience; how short a body leaves a section uncertain.
TITLES = ("cv", "resume", "curriculumvitae", "confidentialresume")
INLINE = ("skills", "technicalskills", "education", "experience", "workexperience", "professionalexperience", "summary", "professionalsummary", "objective", "careerobjective", "projects", "certifications", "declaration")
ONCE = ("Experience", "Education", "Skills", "Certifications", "Projects", "Summary")
IN_JOB = ("Contact", "References")
CONTENT, SHORT = ("Skills", "Education", "Experience"), 40
#: Marks that begin an item, ticks among them; verbs that begin a duty; words of titles, schools, degrees and places of work.
BULLET = "^[•●▪◦‣○►▸✓✔☑*·\\-–—]+\\s*"
TICK = "^[\\s✓✔☑☒☐◆▪▫►▸√]*[✓✔☑☒☐◆▪▫►▸√]"
DUTY = "(?i)^(?:developed|designed|built|worked|responsible|managed|implemented|i\\s+am|i\\s+have|this\\s+is|the\\s+following)\\b"
ROLE = "(?i)\\b(?:engineer|developer|intern|analyst|manager|architect|administrator|admin|consultant|lead|specialist|executive|officer|associate|tester|designer|trainee|programmer|director|head|clerk|scientist)\\b"
DEGREE = "(?i)\\b(?:b\\.?\\s?tech|m\\.?\\s?tech|b\\.?e|m\\.?e|b\\.?sc|m\\.?sc|bca|mca|bba|mba|b\\.?com|m\\.?com|ph\\.?d|bachelors?|masters?|diploma|hsc|ssc|high school|degree)\\b"
SCHOOL = "(?i)\\b(?:university|college|institute|school|academy|vidyalaya|iit|nit)\\b"
PLACE = "^[A-Z][A-Za-z. ]+,\\s*[A-Z][A-Za-z. ]+$"
SCORE = "(?i)\\b(?:cgpa|gpa|percentage|marks|score)\\s*[:\\-]?\\s*([0-9]+(?:\\.[0-9]+)?)|([0-9]+(?:\\.[0-9]+)?)\\s*%"


def heading_table(spark: SparkSession, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, label): some 150 rows."""
    return spark.createDataFrame(sorted({(key.replace(" ", ""), label) for label, keys in names.items() for key in keys}), "key string, label string")


def text_lines(rows: DataFrame, text: str) -> DataFrame:
    """A row for each line, numbered from 0, with the other columns; a null text has none."""
    # outer: no filter on the split text is drawn before the dealing of the rows
    return rows.select(*[c for c in rows.columns if c != text], F.posexplode_outer(F.split(text, "\r\n|\r|\n")).alias("pos", "line")).where("pos IS NOT NULL")


def _bare(line: Column) -> Column:
    """A line without the decoration around it: rules, stars, bullets, a colon."""
    edge = "^[\\s_\\-=~*•·#]+|[\\s_\\-=~*•·:#]+$"
    return F.regexp_replace(F.regexp_replace(line, edge, ""), "[_\\-=~]{2,}", " ")


def heading_key(line: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(line), F.lit("&"), F.lit("and")), "[^a-z0-9]", "")


def headed(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """Add ``label``, the section that a line is the heading of, and ``rest``, what follows it on its line (``Skills: a, b``)."""
    left = F.split_part("line", F.lit(":"), F.lit(1))
    rest = F.trim(F.substring("line", F.length(left) + 2, F.length("line")))
    parted = lines.withColumn("rest", F.when(F.col("line").contains(":"), rest).otherwise(""))
    # in steps, so that each is computed once
    bared = parted.withColumn("bare", _bare(F.when(F.col("rest") != "", left).otherwise(F.col("line")))).withColumn("key", heading_key(F.col("bare")))
    bare, inline, words = F.col("bare"), F.col("rest") != "", F.size(F.filter(F.split("bare", "\\s+"), lambda w: w != ""))
    plausible = (
        ~F.col("line").rlike(TICK) & F.length(bare).between(1, 80) & (words <= 8) & ~(F.trim("line").endswith(".") & (words > 3)) & ~bare.rlike(DUTY) & ~bare.rlike("@|[0-9]{6}")
        & ~F.col("key").isin(*TITLES) & (~inline | F.col("key").isin(*INLINE))
    )
    keyed = bared.withColumn("key", F.when(plausible, F.col("key"))).drop("bare")
    found = keyed.join(F.broadcast(headings), "key", "left")  # some 150 rows
    return found.withColumn("rest", F.when(F.col("label").isNotNull(), F.col("rest")).otherwise("")).drop("key")


def sectioned(lines: DataFrame, headings: DataFrame, id: str) -> DataFrame:
    """Every line with its section's number (0: before the first heading), ``label`` and ``heading``. Contact data within a job open no section."""
    before = Window.partitionBy(id).orderBy("pos")
    rows = headed(lines, headings)
    past = F.last(F.when(~F.col("label").isin(*IN_JOB), F.col("label")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("own", F.when(F.col("label").isin(*IN_JOB) & (F.coalesce(past, F.lit("")) == "Experience"), None).otherwise(F.col("label")))
    section, label = F.count("own").over(before), F.coalesce(F.last("own", ignorenulls=True).over(before), F.lit("Preamble"))
    rest = F.when(F.col("own").isNotNull(), F.col("rest")).otherwise("")
    return rows.select(id, "pos", "line", F.col("own").isNotNull().alias("heading"), rest.alias("rest"), section.alias("section"), label.alias("label"))


def _body(heading: Column, rest: Column, line: Column) -> Column:
    return F.when(heading, F.nullif(rest, F.lit(""))).otherwise(F.nullif(F.trim(line), F.lit("")))


def sections(rows: DataFrame, id: str) -> DataFrame:
    """(id, section, label, source, first, lines, body) of ``sectioned`` rows: a row for each section that has a heading or a word.

    ``source`` is heuristic, or uncertain where a content section's body is shorter than 40 characters. A body that nearly repeats an earlier one
    of its label (85 % of its tokens, three new ones at most) becomes Unclassified; the longest body so far is compared with.
    """
    parts = F.array_sort(F.collect_list(F.struct("pos", _body(F.col("heading"), F.col("rest"), F.col("line")).alias("x"))))
    whole = rows.groupBy(id, "section", "label").agg(F.min("pos").alias("first"), parts.alias("parts"), F.bool_or("heading").alias("headed"))
    body = F.array_join(F.filter(F.transform("parts", lambda p: p["x"]), lambda x: x.isNotNull()), "\n")
    whole = whole.select(id, "section", "label", "first", "headed", body.alias("body")).where("headed or body <> ''")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    whole = whole.withColumns({"lines": F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n"))), "size": F.length("body"), "tokens": tokens})
    marked = ordered_fold(whole.where(F.col("label").isin(*ONCE)), [id, "label"], ["section"], "repeats boolean", lambda: ("new", 0, frozenset()), _repeat, ["size", "tokens"])
    rest = whole.where(~F.col("label").isin(*ONCE)).withColumn("repeats", F.lit(False))
    found, short = marked.unionByName(rest), F.col("label").isin(*CONTENT) & (F.col("size") < SHORT)
    label = F.when(F.col("repeats"), "Unclassified").otherwise(F.col("label"))
    return found.select(id, "section", label.alias("label"), F.when(F.col("repeats") | short, "uncertain").otherwise("heuristic").alias("source"), "first", "lines", "body")


def _repeat(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    seen, size, known = state
    length, tokens = row[0], frozenset(row[1])
    repeats = seen == "seen" and (not tokens or (bool(known) and len(tokens & known) >= 0.85 * len(tokens) and len(tokens - known) <= 3))
    if not repeats and (seen == "new" or length > size):
        state = ("seen", length, tokens)
    return state, (repeats,)


def classified(lines: DataFrame) -> DataFrame:
    """Add ``kind`` (blank, bullet, date, head, prose), ``start`` and ``end`` months and ``bare``, the line without its dates and bullet.

    A date line holds a range, or nothing but a date. A head is a short line that ends like no sentence and begins like no duty.
    """
    line, plain = F.trim("line"), F.col("plain_")
    # in steps, so that each is computed once
    told = lines.withColumn("plain_", v.date_text(line)).withColumn("months_", v.plain_range(plain))
    months, bullet = F.col("months_"), line.rlike(BULLET)
    alone = F.length(F.regexp_replace(F.regexp_replace(plain, f"(?i){v.DATE_ATOM}", ""), "[^A-Za-z]", "")) == 0
    told = told.withColumn("dated_", ~bullet & months.isNotNull() & F.coalesce((months["end"] != "") | alone, F.lit(False)))
    dated = F.col("dated_")
    without = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, v.DATE_SPAN, ""), v.DATE_TILL, ""), f"(?i)\\b(?:since\\s+)?{v.DATE_ATOM}", "")
    bare = F.when(dated, F.regexp_replace(F.regexp_replace(without, "\\(\\s*\\)", ""), "^[\\s|,;:()\\-]+|[\\s|,;:()\\-]+$", "")).otherwise(F.regexp_replace(line, BULLET, ""))
    short = (F.length(line) <= 80) & ~line.rlike("[.;!?]$") & ~line.rlike(DUTY)
    kind = F.when(line == "", "blank").when(bullet, "bullet").when(dated, "date").when(short, "head").otherwise("prose")
    return told.withColumns({"kind": kind, "start": F.when(dated, months["start"]), "end": F.when(dated, months["end"]), "bare": bare}).drop("plain_", "months_", "dated_")


def _experience(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """(entry, heads, titled, dated, body, gap): a date opens an entry unless the present one waits for one; so does a head after items or a gap, and one
    that begins the next entry: a date follows it, at once or after further heads, or a second title does; places don't."""
    entry, heads, titled, dated, body, gap = state
    kind, following, beyond, text, place, role, next_role = row
    if kind == "blank":
        return (entry, heads, titled, dated, body, True), (entry,)
    opens = False
    if kind == "date":
        opens = entry == 0 or dated or body
    elif kind == "head":
        anew = gap or following == "date" or heads >= 3 or (beyond in ("date", "titled") and not place) or (titled and (role or (next_role and not place)))
        opens = entry == 0 or body or (dated and heads > 0 and anew) or (not dated and heads >= 3)
    if opens:
        entry, heads, titled, dated, body = entry + 1, 0, False, False, False
    if kind == "date":
        heads, titled, dated = heads + (text != ""), titled or role, True
    elif kind == "head":
        heads, titled = heads + 1, titled or role
    else:
        body = entry > 0
    return (entry, heads, titled, dated, body, False), (entry,)


def _education(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """(entry, degree, school): a second degree or school opens the next entry."""
    entry, degree, school = state
    kind, has_degree, has_school = row
    if kind != "blank" and (entry == 0 or (has_degree and degree) or (has_school and school and not (has_degree and not degree))):
        entry, degree, school = entry + 1, False, False
    return (entry, degree or has_degree, school or has_school), (entry,)


def _inner(rows: DataFrame, label: str, id: str) -> DataFrame:
    """The classified lines of the sections of a label: bodies, and what follows a heading on its line."""
    lines = rows.where(F.col("label") == label).withColumn("line", F.when(F.col("heading"), F.col("rest")).otherwise(F.col("line"))).where("not heading or rest <> ''")
    return classified(lines.select(id, "section", "pos", "line"))


def experience_lines(rows: DataFrame, id: str) -> DataFrame:
    """Every line of the Experience sections with its entry (0: before the first)."""
    lines = _inner(rows, "Experience", id)
    # what follows, as what came before in the other direction: a frame that grows row by row
    spoken = Window.partitionBy(id, "section").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    bare = F.col("bare")
    kind, role = F.when((F.col("kind") == "date") & (bare != ""), "titled").otherwise(F.col("kind")), F.col("kind").isin("head", "date") & bare.rlike(ROLE)
    next_ = lambda x, skipped: F.last(F.when(~kind.isin(*skipped), x), ignorenulls=True).over(spoken)
    ahead = {"following": next_(kind, ["blank"]), "beyond": next_(kind, ["blank", "head"]), "place": bare.rlike(PLACE) & ~bare.rlike(ROLE), "role": role, "next_role": F.coalesce(next_(role, ["blank"]), F.lit(False))}
    start = lambda: (0, 0, False, False, False, False)
    return ordered_fold(lines.withColumns(ahead), [id, "section"], ["pos"], "entry int", start, _experience, ["kind", "following", "beyond", "bare", "place", "role", "next_role"]).drop(*ahead)


def _pieces(head: Column) -> Column:
    return F.filter(F.transform(F.split(head, "\\s+(?:-|\\||at|@)\\s+|\\s*\\|\\s*|\\s*,\\s+"), lambda x: F.trim(x)), lambda x: x != "")


def experience(rows: DataFrame, id: str) -> DataFrame:
    """(id, section, entry, title, company, place, start, end, items) of every entry of the Experience sections.

    The pieces of an entry's heads are its title (the first with a word of titles), its company and its place, in their order.
    """
    lines = experience_lines(rows, id).where("entry > 0")
    heads = F.array_sort(F.collect_list(F.when(F.col("kind").isin("head", "date") & (F.col("bare") != ""), F.struct("pos", F.col("bare").alias("x")))))
    made = lines.groupBy(id, "section", "entry").agg(heads.alias("heads"), F.min_by("start", F.when(F.col("start").isNotNull(), F.col("pos"))).alias("start"), F.min_by("end", F.when(F.col("end").isNotNull(), F.col("pos"))).alias("end"), F.count_if(F.col("kind").isin("bullet", "prose")).alias("items"))
    pieces = F.flatten(F.transform("heads", lambda h: _pieces(v.unified(h["x"]))))
    title = F.get(F.filter("pieces", lambda p: p.rlike(ROLE)), F.lit(0))
    others = F.filter("pieces", lambda p: ~F.col("title").isNotNull() | (p != F.col("title")))
    made = made.withColumn("pieces", pieces).withColumn("title", title).withColumn("others", others)
    empty = lambda c: F.coalesce(c, F.lit(""))
    only_place = (F.size("others") == 1) & F.lower(F.get("others", F.lit(0))).isin("remote", "onsite", "hybrid")
    company = F.when(only_place, "").otherwise(empty(F.get("others", F.lit(0))))
    place = F.when(only_place, F.get("others", F.lit(0))).otherwise(F.array_join(F.slice("others", 2, 2), ", "))
    return made.select(id, "section", "entry", empty(F.col("title")).alias("title"), company.alias("company"), place.alias("place"), empty(F.col("start")).alias("start"), empty(F.col("end")).alias("end"), "items")


def education(rows: DataFrame, id: str) -> DataFrame:
    """(id, section, entry, degree, school, start, end, score) of every entry of the Education sections."""
    lines = _inner(rows, "Education", id).withColumn("x", v.unified(F.col("bare")))
    parts = F.filter(F.transform(F.split(F.regexp_replace("x", SCORE, ""), "\\s+(?:-|\\||from)\\s+|\\s*\\|\\s*"), lambda p: F.regexp_replace(F.trim(p), "^[,;]+|[,;]+$", "")), lambda p: p != "")
    lines = lines.withColumn("parts", parts)
    school = F.get(F.filter("parts", lambda p: p.rlike(SCHOOL)), F.lit(0))
    degree = F.get(F.filter("parts", lambda p: p.rlike(DEGREE) & (F.coalesce(school, F.lit("")) != p)), F.lit(0))
    score = F.coalesce(F.nullif(F.regexp_extract("x", SCORE, 1), F.lit("")), F.nullif(F.regexp_extract("x", SCORE, 2), F.lit("")))
    lines = lines.withColumns({"degree": degree, "school": school, "score": score}).withColumns({"has_degree": F.col("degree").isNotNull(), "has_school": F.col("school").isNotNull()})
    entries = ordered_fold(lines.drop("parts"), [id, "section"], ["pos"], "entry int", lambda: (0, False, False), _education, ["kind", "has_degree", "has_school"]).where("entry > 0")
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))), F.lit("")).alias(c)
    return entries.groupBy(id, "section", "entry").agg(first("degree"), first("school"), first("start"), first("end"), first("score"))


def job_items(rows: DataFrame, id: str) -> DataFrame:
    """(id, label, item, text) of a job description's sections: an item for each bullet, with the lines that go on with it, or for each line without one.

    A line goes on with the item before if it has no bullet, begins in lower case or with white space, and follows at once. Items of skill sections are
    cut at commas; their parts are items of their own.
    """
    lines = rows.withColumn("line", F.when(F.col("heading"), F.col("rest")).otherwise(F.col("line"))).where("not heading or rest <> ''")
    lines = lines.withColumn("opens", F.col("line").rlike(BULLET) | ~F.col("line").rlike("^(?:\\s+\\S|[a-z])"))
    before = Window.partitionBy(id, "section").orderBy("pos")
    blank = F.trim("line") == ""
    opens = ~blank & (F.col("opens") | F.coalesce(F.trim(F.lag("line").over(before)) == "", F.lit(True)))
    numbered = lines.withColumn("opens", opens).withColumn("item", F.count_if("opens").over(before)).where("item > 0").where(~blank)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace(F.trim("line"), BULLET, "").alias("x")))), lambda p: p["x"]), " ")
    items = numbered.groupBy(id, "section", "label", "item").agg(text.alias("text"))
    parts = F.when(F.col("label").isin("Required Skills", "Preferred Skills", "Skills"), F.filter(F.transform(F.split("text", "\\s*[,;]\\s*"), lambda x: F.regexp_replace(F.trim(x), "\\.$", "")), lambda x: x != "")).otherwise(F.array("text"))
    return items.select(id, "section", "label", "item", F.posexplode(parts).alias("part", "text"))
