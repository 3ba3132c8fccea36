"""Comparable keys and scores of single values: names, contacts, places, levels, skills, months. All are Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t

#: Quotes, dashes and bullets that count as plain ones.
QUOTES, PLAIN_QUOTES = "‘’“”´", "''\"\"'"
DASHES, BULLETS = "‐‑‒–—―−", "•●▪◦⁃∙·"
#: Words that are no part of a name.
NAME_NOISE = ("mr", "mrs", "ms", "dr", "resume", "cv", "curriculum", "vitae", "profile", "name", "candidate")
EMAIL = "[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}"
#: Words that qualify a place, parts that are an address, directions.
PLACE_NOISE = (
    "india", "bharat", "maharashtra", "telangana", "karnataka", "kerala", "gujarat", "rajasthan", "punjab", "haryana", "bengal", "odisha", "bihar", "jharkhand",
    "assam", "goa", "uttarakhand", "uttar", "madhya", "andhra", "tamil", "nadu", "pradesh", "state", "dist", "district", "pin", "pincode", "ncr", "area",
)
PLACE_PHRASES = ("west bengal", "uttar pradesh")
ADDRESS = "\\b(?:house|flat|plot|road|rd|street|nagar|compound|sector|near|opp|baugh)\\b"
DIRECTIONS = ("east", "west", "north", "south")
#: Level words in the order in which they are looked for.
LEVELS = (("intern", "intern"), ("entry", "intern"), ("trainee", "intern"), ("fresher", "fresher"), ("fresh", "fresher"), ("graduate", "fresher"), ("experienced", "experienced"), ("experience", "experienced"), ("professional", "experienced"), ("senior", "experienced"), ("mid", "experienced"))
#: Other names of skills, label prefixes.
SKILL_ALIAS = {
    "js": "javascript", "node": "nodejs", "node.js": "nodejs", "reactjs": "react", "react.js": "react", "postgres": "postgresql", "ms sql": "mssql", "sql server": "mssql",
    "oracle sql": "oracle", "pl/sql": "plsql", "pl sql": "plsql", "ms excel": "excel", "ms office": "msoffice", "golang": "go", "c++": "cpp", "c#": "csharp", "dot net": "dotnet",
    ".net": "dotnet", "k8s": "kubernetes", "ci/cd": "cicd",
}
SKILL_LABEL = "(?i)^\\s*(?:programming language|language|database|tools?|technolog(?:y|ies)|skills?|operating system|os|framework|platform|cloud|soft skills?|technical skills?)s?\\s*[:\\-]\\s*"
#: Legal forms at the end of a company's name; the first that fits goes.
COMPANY_FORMS = (" private limited", " pvt. ltd.", " pvt ltd.", " pvt. ltd", " pvt ltd", " ltd.", " ltd", " inc.", " inc", " llc")
#: Month names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
YEAR = "\\b(?:19[7-9][0-9]|20[0-4][0-9])\\b"
#: Credentials in text, in order: pattern, and what replaces it.
CREDENTIALS = (
    ("(?i)\\bbearer\\s+\\S+", "Bearer [REDACTED]"),
    ("(?i)\\bbasic\\s+\\S+", "Basic [REDACTED]"),
    ("(?i)(authorization:\\s*)[^\\r\\n]+", "$1[REDACTED]"),
    ("(?i)(cookie:\\s*)[^\\r\\n]+", "$1[REDACTED]"),
    ("(?i)(session=)[^\\s;]+", "$1[REDACTED]"),
    ("(?i)(postgres(?:ql)?(?:\\+\\w+)?://[^:\\s/]+:)[^@\\s]+(@)", "$1[REDACTED]$2"),
    ("(?i)((?:redis|rediss)://[^@\\s/]*:)[^@\\s]+(@)", "$1[REDACTED]$2"),
    ("(?i)((?:redis|rediss)://)[^:@\\s/]+(@)", "$1[REDACTED]$2"),
    ("(?i)(https?://[^\\s\"']*?/webhook/)[^\\s\"'/?#]+", "$1[REDACTED]"),
)
#: Field names whose values are hidden, besides those that end in _token, _secret or _password.
SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "raw_json", "authorization", "cookie", "set-cookie")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def unified(text: Column) -> Column:
    """Plain quotes and dashes, blanks for bullets, one blank in a row, trimmed. Compatibility forms are the caller's (see ``compatible``)."""
    plain = F.translate(F.coalesce(text, F.lit("")), QUOTES + DASHES + BULLETS + " ", PLAIN_QUOTES + "-" * len(DASHES) + " " * (len(BULLETS) + 1))
    return F.regexp_replace(F.regexp_replace(plain, "[ \\t]+", " "), "\\A\\s+|\\s+\\z", "")


def norm(text: Column) -> Column:
    return t.norm(unified(text))


def words(text: Column, pattern: str = " +") -> Column:
    return F.array_distinct(F.filter(F.split(text, pattern), lambda x: x != ""))


def within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def name_words(name: Column) -> Column:
    return F.filter(F.split(norm(name), "[^a-z]+"), lambda x: (x != "") & ~x.isin(*NAME_NOISE))


def name_score(gold: Column, found: Column) -> Column:
    """1 for equal names, 0.95 where one holds the other's words, else the overlap of their words; 0 without either."""

    def score(p: Column) -> Column:
        g, f = p["g"], p["f"]
        overlap = let(F.struct(t.tokens(F.array_join(g, " ")).alias("g"), t.tokens(F.array_join(f, " ")).alias("f")), lambda q: t.token_f1(q["g"], q["f"]))
        return F.when((F.size(g) == 0) | (F.size(f) == 0), 0.0).when(g == f, 1.0).when(within(g, f) | within(f, g), 0.95).otherwise(overlap)

    return let(F.struct(name_words(gold).alias("g"), name_words(found).alias("f")), score)


def emails(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(unified(text), F.lit(EMAIL), F.lit(0)), lambda x: F.regexp_replace(F.lower(x), "\\.+$", ""))))


def email_score(gold: Column, found: Column) -> Column:
    local = lambda e: F.transform(e, lambda x: F.split_part(x, F.lit("@"), F.lit(1)))
    return let(F.struct(emails(gold).alias("g"), emails(found).alias("f")), lambda p: F.when(F.arrays_overlap(p["g"], p["f"]), 1.0).when(F.arrays_overlap(local(p["g"]), local(p["f"])), 0.6).otherwise(0.0))


def first_email(text: Column) -> Column:
    """The labelled address, else the first; addresses broken before the @ are healed. Empty if there is none."""
    healed = F.regexp_replace(text, "([A-Za-z0-9._%+\\-]+)\\s+(@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,})", "$1$2")
    labelled = F.regexp_extract(healed, f"(?i)(?:e[\\-\\s]?mail|mail\\s*id|email\\s*id)\\s*[:.\\-–—]?\\s*({EMAIL})", 1)
    return F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(F.regexp_extract(healed, EMAIL, 0), F.lit("")), F.regexp_extract(text, EMAIL, 0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def phone_keys(text: Column) -> Column:
    """The last ten digits of every run of digits; a run of more holds several numbers, read from its end."""
    runs = F.transform(F.regexp_extract_all(unified(text), F.lit("[0-9][0-9\\s\\-().]{6,}[0-9]"), F.lit(0)), digits)
    keys = lambda d: F.when(F.length(d) >= 10, F.transform(F.sequence(F.lit(1), F.floor(F.length(d) / 10).cast("int")), lambda k: F.substring(d, F.length(d) - 10 * k + 1, F.lit(10)))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(runs, keys))))


#: Shapes of numbers in the order in which they are looked for; a labelled number; one after +91; ten digits with blanks.
PHONE_SHAPES = (
    "\\+?[0-9]{1,3}[\\s\\-]?\\(?[0-9]{2,4}\\)?[\\s\\-]?[0-9]{3,4}[\\s\\-]?[0-9]{4}",
    "\\b[0-9]{10}\\b",
    "\\b[6-9][0-9]{4}[\\s\\-]?[0-9]{5}\\b",
    "\\b0[0-9]{2,4}[\\s\\-]?[0-9]{6,8}\\b",
)
PHONE_LABEL = "(?i)(?:phone|mobile|mob|cell|tel|contact)(?:\\s*(?:no\\.?|number|num))?\\s*[:.\\-–—]?\\s*([+0-9][0-9\\s().-]{7,}[0-9])"
PHONE_PLUS = "(\\+91[\\s\\-]?[0-9][0-9\\s\\-]{8,12}[0-9])"
PHONE_SPACED = "(?:\\+91[\\s\\-]*)?([6-9](?:\\s*[0-9]){9})"
#: Characters of the head of a text, where numbers are looked for first.
PHONE_HEAD = 2500


def year_row(d: Column) -> Column:
    """Twelve digits or more that hold two years or more, one after the other."""
    years = F.regexp_extract_all(d, F.lit("(?:19|20)[0-9]{2}"), F.lit(0))
    return (F.length(d) >= 12) & (F.size(years) >= 2) & d.contains(F.array_join(years, ""))


def phone_ok(raw: Column) -> Column:
    """A mobile number of ten digits, one after 91, eleven digits from 0, or 7 to 13 digits that don't hold two years in a row; no row of years."""

    def fine(d: Column) -> Column:
        shaped = d.rlike("^[6-9][0-9]{9}$|^91[6-9][0-9]{9}$|^0[0-9]{10}$")
        return (d != "") & ~year_row(d) & (shaped | (F.length(d).between(7, 13) & ~d.rlike("(?:19|20)[0-9]{2}(?:19|20)[0-9]{2}")))

    return let(digits(raw), fine)


def first_phone(text: Column) -> Column:
    """The labelled number if it is one, else the first after +91, of a known shape, or of ten digits with blanks. Empty if there is none.

    Shapes are looked for in turn, in the text's head, there with blanks between digits taken out, then in the whole text in the same way.
    """
    joined = lambda x: F.trim(F.regexp_replace(x, "(?<=[0-9])\\s+(?=[0-9])", ""))
    head = F.substring(text, 1, PHONE_HEAD)
    first = lambda x: F.coalesce(*[F.get(F.filter(F.transform(F.regexp_extract_all(x, F.lit(shape), F.lit(0)), lambda y: F.trim(y)), phone_ok), F.lit(0)) for shape in PHONE_SHAPES])
    checked = lambda x: let(x, lambda y: F.when(phone_ok(y), y))
    found = (
        checked(joined(F.regexp_extract(text, PHONE_LABEL, 1))), checked(joined(F.regexp_extract(head, PHONE_PLUS, 1))),
        first(head), let(joined(head), first), first(text), let(joined(text), first), checked(digits(F.regexp_extract(text, PHONE_SPACED, 1))), F.lit(""),
    )
    return F.coalesce(*found)


def url_key(url: Column) -> Column:
    """Without scheme, www, query, fragment and trailing slashes, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(unified(url), "^[<>()\\[\\],;]+|[<>()\\[\\],;]+$", ""), "/+$", "")
    short = F.lower(F.regexp_replace(bare, "(?i)^(?:https?://)?(?:www\\.)?", ""))
    return F.regexp_replace(F.regexp_replace(short, "[?#].*$", ""), "/+$", "")


#: What a profile's and a portfolio's address look like; degrees that are no hosts; endings of hosts.
LINKEDIN = "(?i)(?:https?://)?(?:www\\.)?linkedin\\.com/[A-Za-z0-9_\\-/%.]+"
GITHUB = "(?i)(?:https?://)?(?:www\\.)?github\\.com/[A-Za-z0-9_\\-]+/?"
PORTFOLIO_LABEL = "(?i)(?:portfolio|website|personal\\s+site)\\s*:\\s*(\\S+)"
DEGREE_HOST = "^(?:bsc|msc|bcom|mcom|bca|mca|bba|mba|btech|mtech|be|me|ba|ma|phd)\\.[a-z]{2,6}$"
HOST_END = "(?i)https?://|www\\.|/|\\.(?:com|dev|io|net|org|co|app|in|me)(?:/|$)"


def with_scheme(url: Column) -> Column:
    bare = F.regexp_replace(F.trim(url), "[/.,;]+$", "")
    return F.when(bare == "", "").when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def profile_links(text: Column) -> Column:
    """(linkedin, github, portfolio): addresses in the text, else what a label names; empty without one. A portfolio is neither of the others."""
    text = F.coalesce(text, F.lit(""))
    part = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    named = part("(?i)linkedin\\s*:\\s*(\\S+)", 1)
    linkedin = F.coalesce(with_scheme(part(LINKEDIN, 0)), F.when(F.lower(named).contains("linkedin"), with_scheme(named)).when(named.contains("/"), with_scheme(F.concat(F.lit("linkedin.com/in/"), named))), F.lit(""))
    handle = part("(?i)github\\s*:\\s*(\\S+)", 1)
    github = F.coalesce(with_scheme(part(GITHUB, 0)), F.when(F.lower(handle).contains("github"), with_scheme(handle)).otherwise(with_scheme(F.concat(F.lit("github.com/"), handle))), F.lit(""))
    site = part(PORTFOLIO_LABEL, 1)
    host = F.split_part(F.regexp_replace(F.lower(with_scheme(site)), "^https?://", ""), F.lit("/"), F.lit(1))
    own = site.rlike(HOST_END) & ~F.lower(site).rlike("linkedin\\.com|github\\.com") & ~host.rlike(DEGREE_HOST)
    return F.struct(linkedin.alias("linkedin"), github.alias("github"), F.when(own, with_scheme(site)).otherwise("").alias("portfolio"))


def url_score(gold: Column, found: Column) -> Column:
    """1 for equal addresses, 0.95 for the same last part of a path; of bare hosts, their likeness from 0.9 on (see ``likeness``) is the caller's."""

    def score(p: Column) -> Column:
        g, f = p["g"], p["f"]
        parts = lambda x: F.filter(F.split(x, "/"), lambda y: y != "")
        paths = (F.size(parts(g)) > 1) | (F.size(parts(f)) > 1)
        return F.when((g == "") | (f == ""), 0.0).when(g == f, 1.0).when(paths & (F.element_at(parts(g), -1) == F.element_at(parts(f), -1)), 0.95).otherwise(0.0)

    return let(F.struct(url_key(gold).alias("g"), url_key(found).alias("f")), score)


def place_parts(place: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(norm(place), "\\b[0-9]{5,6}\\b", " "), "\\bno\\.?\\s*[0-9]+\\b", " ")
    parts = F.filter(F.transform(F.split(key, "[,/|]+"), lambda p: F.trim(F.regexp_replace(p, "\\s+", " "))), lambda p: p != "")
    kept = lambda parts: F.filter(parts, lambda p: ~p.isin(*PLACE_NOISE, *PLACE_PHRASES) & ~p.rlike(ADDRESS))
    return let(parts, lambda p: let(kept(p), lambda k: F.when(F.size(k) > 0, k).otherwise(p)))


def place_words(place: Column) -> Column:
    raw = F.filter(words(F.array_join(place_parts(place), " ")), lambda w: ~w.isin(*DIRECTIONS))
    return let(raw, lambda r: let(F.filter(r, lambda w: ~w.isin(*PLACE_NOISE)), lambda bare: F.when(F.size(bare) > 0, bare).otherwise(r)))


def place_score(gold: Column, found: Column) -> Column:
    """The share of the gold place's words found; any of them is worth 0.75."""
    missing = (F.size(place_parts(gold)) == 0) | (F.size(place_parts(found)) == 0)

    def score(p: Column) -> Column:
        g, f = p["g"], p["f"]
        both = F.size(F.array_intersect(g, f))
        return F.when(F.size(g) == 0, F.when(F.size(f) == 0, 1.0).otherwise(0.0)).when(both == F.size(g), 1.0).when(both > 0, F.greatest(both / F.size(g), F.lit(0.75))).otherwise(0.0)

    return F.when(missing, 0.0).otherwise(let(F.struct(place_words(gold).alias("g"), place_words(found).alias("f")), score))


def level_key(level: Column) -> Column:
    return let(norm(level), lambda text: F.coalesce(*[F.when(text.rlike(f"\\b{word}\\b"), F.lit(key)) for word, key in LEVELS], text))


def level_score(gold: Column, found: Column) -> Column:
    near = lambda x: x.isin("intern", "fresher")
    return let(F.struct(level_key(gold).alias("g"), level_key(found).alias("f")), lambda p: F.when((p["g"] == "") | (p["f"] == ""), 0.0).when(p["g"] == p["f"], 1.0).when(near(p["g"]) & near(p["f"]), 0.5).otherwise(0.0))


def skill_key(skill: Column) -> Column:
    alias = F.create_map(*[F.lit(x) for pair in SKILL_ALIAS.items() for x in pair])
    return let(F.regexp_replace(norm(skill), "^[ .;]+|[ .;]+$", ""), lambda text: F.coalesce(F.try_element_at(alias, text), F.try_element_at(alias, F.regexp_replace(text, " ", "")), text))


#: Words that only headings of skill lists are made of.
SKILL_HEADING = (
    "technical", "technicals", "core", "key", "other", "others", "additional", "professional", "programming", "web", "scripting", "script", "gui", "ide",
    "cloud", "data", "base", "database", "databases", "language", "languages", "tool", "tools", "technology", "technologies", "framework", "frameworks",
    "library", "libraries", "skill", "skills", "operating", "system", "systems", "platform", "platforms", "environment", "environments", "expertise",
    "competency", "competencies", "soft", "misc", "miscellaneous", "area", "areas", "summary", "and", "of", "the",
)


def skill_heading(piece: Column) -> Column:
    """A category label: nothing but heading words."""
    parts = F.filter(F.split(F.replace(norm(piece), F.lit("&"), F.lit(" ")), " +"), lambda w: w != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda w: w.isin(*SKILL_HEADING))


def split_skills(cell: Column, drop_headings: bool = False) -> Column:
    """Distinct skill keys of a cell in order: lines, then commas and slashes; label prefixes go.

    ``drop_headings`` leaves out category labels. It is for the gold side: a heading found as a skill is a fault that has to show.
    """

    def body(part: Column) -> Column:
        bare = F.regexp_replace(part, SKILL_LABEL, "")
        label = F.split_part(bare, F.lit(":"), F.lit(1))
        short = F.size(F.filter(F.split(label, "\\s+"), lambda w: w != "")) <= 3
        return F.when(bare.contains(":") & short, F.substring(bare, F.length(label) + 2, F.length(bare))).otherwise(bare)

    pieces = F.flatten(F.transform(F.split(unified(cell), "[\\n;|]+"), lambda p: F.split(body(p), "[,/]+")))
    if drop_headings:
        pieces = F.filter(pieces, lambda x: ~skill_heading(x))
    return F.array_distinct(F.filter(F.transform(pieces, lambda x: skill_key(x)), lambda k: (F.length(k) >= 2) & ~k.rlike("^[0-9]+$")))


def keywords(text: Column, phrases: list[str]) -> Column:
    """Those of the phrases, in their order, that stand in the text as whole tokens."""
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: t.holds_token(text, p))


def company_key(name: Column) -> Column:
    s = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    bare = F.coalesce(*[F.when(s.endswith(form), F.regexp_replace(F.substring(s, F.lit(1), F.length(s) - len(form)), "^[ ,.\\-]+|[ ,.\\-]+$", "")) for form in COMPANY_FORMS])
    return F.coalesce(bare, s)


def redact(text: Column) -> Column:
    for pattern, by in CREDENTIALS:
        text = F.regexp_replace(text, pattern, by)
    return text


def sensitive(name: Column) -> Column:
    key = F.lower(F.trim(name))
    return key.isin(*SENSITIVE) | key.rlike("_(?:token|secret|password)$")


def redact_map(values: Column) -> Column:
    """Sensitive keys' values are hidden whole, credentials in other values one by one."""
    return F.transform_values(values, lambda k, v: F.when(sensitive(k), F.lit("[REDACTED]")).otherwise(redact(v)))


def year_set(text: Column) -> Column:
    """Distinct years from 1970 to 2049, two-digit ones after an apostrophe among them (over 50: 19yy)."""
    plain = unified(text)
    two = F.transform(F.regexp_extract_all(plain, F.lit("'([0-9]{2})\\b"), F.lit(1)), lambda y: F.concat(F.when(y > "50", "19").otherwise("20"), y))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(plain, F.lit(YEAR), F.lit(0)), two)))


def month_key(text: Column) -> Column:
    """present, YYYY-MM or YYYY of the first date of the first form that the text holds; empty without one."""
    iso, slash = "\\b((?:19|20)[0-9]{2})-([0-9]{1,2})\\b", "\\b([0-9]{1,2})[/\\-]((?:19|20)[0-9]{2})\\b"
    named = "(?i)\\b([a-z]{3,4})[a-z]*\\.?\\s*'?\\s*((?:19|20)?[0-9]{2})\\b"

    def key(plain: Column) -> Column:
        part = lambda pattern, k: F.nullif(F.regexp_extract(plain, pattern, k), F.lit(""))
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(part(named, 1), 1, 3)))
        year = let(part(named, 2), lambda y: F.when(F.length(y) == 4, y).otherwise(F.concat(F.when(y > "50", "19").otherwise("20"), y)))
        return F.coalesce(
            F.when(plain.rlike("(?i)\\b(?:present|current|till date|to date|now|ongoing)\\b"), "present"),
            F.concat(part(iso, 1), F.lit("-"), F.lpad(part(iso, 2), 2, "0")),
            F.concat(part(slash, 2), F.lit("-"), F.lpad(part(slash, 1), 2, "0")),
            let(month, lambda m: F.when(m > 0, F.concat(year, F.lit("-"), F.lpad(m.cast("string"), 2, "0")))),
            F.regexp_extract(plain, YEAR, 0),
        )

    return let(unified(text), key)


#: What a date looks like: day month year, month year, month 'yy, d/m/y, m/y, year or year-month; what an open end is called.
MONTH_NAME = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\.?"
DATE_ATOM = (
    f"(?:(?:(?:0?[1-9]|[12][0-9]|3[01])(?:st|nd|rd|th)?[\\s\\-]+)?{MONTH_NAME}[\\s\\-]+(?:19|20)[0-9]{{2}}|(?:0?[1-9]|[12][0-9]|3[01])\\s*,\\s*{MONTH_NAME}\\s*,?\\s*(?:19|20)[0-9]{{2}}"
    f"|{MONTH_NAME}\\s*['’]\\s*[0-9]{{2}}|{MONTH_NAME}\\s+[0-9]{{2}}\\b|(?:0?[1-9]|[12][0-9]|3[01])[/\\-](?:0?[1-9]|1[0-2])[/\\-](?:19|20)[0-9]{{2}}"
    "|(?:0?[1-9]|1[0-2])[/\\-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}(?:\\s*[/\\-]\\s*(?:0?[1-9]|1[0-2])\\b)?)"
)
OPEN_END = "(?:Present|Currently|Current|Now|Till\\s*(?:Date|Present|Now)|Tilldate|T[il]l\\s+now|To\\s+Date|Ongoing|Pursuing|Still(?:\\s+Date)?)"
DATE_SPAN = f"(?i)\\b(?:from\\s+)?({DATE_ATOM})\\s*(?:-|to|until|till)\\s*({DATE_ATOM}|{OPEN_END})\\b"
DATE_TILL = f"(?i)\\b(?:from\\s+)?({DATE_ATOM})\\s+till\\s*date\\b"
DATE_SINCE = f"(?i)\\bsince\\s+({DATE_ATOM})\\b"
PRODUCT = "(?i)\\b(?:server|sql|windows|oracle|version)\\b"


def month_token(atom: Column) -> Column:
    """YYYY-MM, YYYY or present of one date; two-digit years below 80 are of this century. Empty for an empty one."""

    def key(low: Column) -> Column:
        part = lambda pattern, k: F.nullif(F.regexp_extract(low, pattern, k), F.lit(""))
        named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part("(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", 1))
        year = F.coalesce(part("((?:19|20)[0-9]{2})$", 1), let(part("([0-9]{2})$", 1), lambda y: F.concat(F.when(y < "80", "20").otherwise("19"), y)))
        return F.coalesce(
            F.when(low.rlike(f"(?i)^{OPEN_END}$"), "present"),
            F.when(named > 0, F.concat(year, F.lit("-"), F.lpad(named.cast("string"), 2, "0"))),
            F.concat(part("([0-9]{1,2})[/\\-]((?:19|20)[0-9]{2})$", 2), F.lit("-"), F.lpad(part("([0-9]{1,2})[/\\-]((?:19|20)[0-9]{2})$", 1), 2, "0")),
            F.concat(part("^((?:19|20)[0-9]{2})\\s*[/\\-]\\s*([0-9]{1,2})$", 1), F.lit("-"), F.lpad(part("^((?:19|20)[0-9]{2})\\s*[/\\-]\\s*([0-9]{1,2})$", 2), 2, "0")),
            low,
        )

    return let(F.trim(F.lower(atom)), key)


def date_text(line: Column) -> Column:
    """A line with plain dashes and without the parentheses around all of it or around single dates."""
    plain = unified(line)
    alone = plain.rlike("^\\([^()]*\\)$")
    bare = F.when(alone, F.trim(F.regexp_replace(plain, "^\\(|\\)$", ""))).otherwise(plain)
    return F.regexp_replace(bare, f"(?i)\\(\\s*({DATE_ATOM})\\s*\\)", "$1")


def date_range(line: Column) -> Column:
    """``plain_range`` of any line."""
    return let(date_text(line), plain_range)


def plain_range(plain: Column) -> Column:
    """(start, end) months of 'a to b', 'a - b', 'a till date', 'since a', an open end or a single date alone; null without one.

    Years after the name of a product, such as SQL Server 2019, are no dates unless they are part of a range.
    """

    part = lambda pattern, k: F.regexp_extract(plain, pattern, k)
    atoms = F.struct(part(DATE_SPAN, 1).alias("a"), part(DATE_SPAN, 2).alias("b"), part(DATE_TILL, 1).alias("till"), part(DATE_SINCE, 1).alias("since"), part(f"(?i)\\b({DATE_ATOM})", 1).alias("single"), plain.rlike(PRODUCT).alias("product"), plain.rlike(f"(?i)^{OPEN_END}$").alias("open"))
    pair = lambda a, b: F.struct(month_token(a).alias("start"), month_token(b).alias("end"))

    def found(x: Column) -> Column:
        now, none = F.lit("present"), F.lit("")
        return (
            F.when(x["a"] != "", pair(x["a"], x["b"])).when(x["till"] != "", pair(x["till"], now)).when((x["since"] != "") & ~(x["product"] & x["since"].rlike("^(?:19|20)[0-9]{2}$")), pair(x["since"], now))
            .when(x["open"], pair(none, now)).when((x["single"] != "") & ~x["product"], pair(x["single"], none))
        )

    return F.when(plain.rlike("[0-9]{2}") | plain.rlike(f"(?i)^{OPEN_END}$"), let(atoms, found))  # a date has two digits at least


def text_quality(text: Column) -> Column:
    """EMPTY, GARBAGE, WEAK or GOOD."""
    def graded(s: Column) -> Column:
        n, letters = F.length(s), F.length(F.regexp_replace(s, "[^\\p{L}\\p{N}]", ""))
        telling = s.rlike("[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}") | s.rlike("\\b[6-9][0-9]{9}\\b|\\+[0-9][0-9\\s\\-()]{8,}[0-9]") | s.rlike("(?i)\\b(?:experience|education|skills|summary|engineer|developer|bachelor|master|university|college|resume|curriculum)\\b")
        lost = n - F.length(F.replace(s, F.lit("\ufffd"), F.lit("")))
        broken = (F.size(F.split(F.lower(s), "cid:")) > 3) | (lost >= 0.08 * n) | (s.rlike("([^\\p{L}\\p{N}_\\s])\\1{7,}") & (letters < 0.25 * n))
        facts = F.struct(n.alias("n"), letters.alias("letters"), telling.alias("telling"), broken.alias("broken"), F.size(F.split(s, "\\s+")).alias("words"))
        return let(facts, band)

    def band(f: Column) -> Column:
        n, dense, telling = f["n"], f["letters"] >= 0.35 * f["n"], f["telling"]
        return (
            F.when(n == 0, "EMPTY").when(f["broken"] & ~telling, "GARBAGE").when(n.between(30, 400) & ~dense & ~telling, "GARBAGE").when(telling & dense, "GOOD")
            .when((n < 80) & ~telling, "WEAK").when(dense | (f["words"] >= 8), "GOOD").otherwise("WEAK")
        )

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), "\\A\\s+|\\s+\\z", ""), graded)


def verdict(score: Column) -> Column:
    return F.when(score >= 0.85, "match").when(score >= 0.6, "partial").otherwise("miss")


def field_score(metric: Column, gold: Column, found: Column) -> Column:
    """The score of a gold value and a found one by the field's metric; text is scored by the share of gold tokens found or their overlap.

    Skills and sections are lists: see ``operators.matching``. Any other metric is an error.
    """
    text = let(F.struct(t.tokens(unified(gold)).alias("g"), t.tokens(unified(found)).alias("f")), lambda p: F.greatest(t.containment(p["g"], p["f"]), t.token_f1(p["g"], p["f"])))
    phone = F.when(F.arrays_overlap(phone_keys(gold), phone_keys(found)), 1.0).otherwise(0.0)
    return (
        F.when(metric == "email", email_score(gold, found)).when(metric == "phone", phone).when(metric == "name", name_score(gold, found)).when(metric == "location", place_score(gold, found))
        .when(metric == "enum", level_score(gold, found)).when(metric == "url", url_score(gold, found)).when(metric == "text", F.when(F.trim(found) == "", 0.0).otherwise(text))
        .otherwise(F.raise_error(F.concat(F.lit("unknown metric: "), metric)).cast("double"))
    )


def field_verdict(gold: Column, found: Column, score: Column) -> Column:
    """Without a gold value, nothing found is right and anything found is invented."""
    none = F.trim(F.coalesce(gold, F.lit(""))) == ""
    return F.when(none & (F.trim(F.coalesce(found, F.lit(""))) == ""), "blank_ok").when(none, "false_positive").otherwise(verdict(score))
