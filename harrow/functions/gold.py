"""Gold cells: entries, facts and dates out of what an author wrote into a section's cell. All are Column expressions.

A cell is cut at its numbered labels; an entry's lines are told apart by words of degrees, schools, roles and companies. Facts are what a
parser has to find: names in comparable form, without dates, labels and prose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions import values as v

#: Labels of entries and lines, hints of what a line names, dates alone, and what is cut from a fact.
ENTRY = "(?i)(?:^|\\s)(Education|Experience|Certifications|Certification|Project)\\s*([0-9]+)\\s*(?::-|:|-)\\s*"
SCHOOL = "(?i)\\b(?:college|university|institute|institution|school|academy|vidyalaya|vidyapeeth|polytechnic|iit|nit|bits|junior college|jr\\.? college|board)\\b"
DEGREE = "(?i)\\b(?:b\\.?\\s?e|b\\.?\\s?tech|b\\.?\\s?sc|b\\.?\\s?com|b\\.?\\s?a|b\\.?\\s?c\\.?\\s?a|bba|bms|m\\.?\\s?e|m\\.?\\s?tech|m\\.?\\s?sc|m\\.?\\s?com|m\\.?\\s?a|m\\.?\\s?c\\.?\\s?a|mba|ms|phd|diploma|bachelor|master|doctor|hsc|ssc|12th|10th|intermediate|graduation|post ?graduat|engineering|secondary)\\b"
COMPANY = "(?i)\\b(?:ltd|limited|pvt|private|inc|llp|llc|technologies|technology|solutions|systems|services|software|consultancy|consulting|infotech|labs|corp|corporation|group|bank|industries|enterprises|global)\\b"
ROLE = "(?i)\\b(?:engineer|developer|analyst|manager|consultant|administrator|admin|lead|architect|specialist|executive|associate|intern|trainee|officer|designer|scientist|tester|strategist|recruiter|dba|support|coordinator|assistant|director|head|president|programmer|technician)\\b"
LABEL = "(?i)^\\s*(?:company|role|designation|organisation|organization|employer|position|title|institute|institution|college|university|degree|course|issuer|issued by)\\s*[:\\-]\\s*"
DUTIES = "(?i)^\\s*(?:role\\s*&\\s*responsibilit|responsibilit|key result|duties)"
DATE = "(?:(?:[0-9]{1,2}[/\\-])?(?:19|20)[0-9]{2}|[a-z]{3,9}\\.?\\s*['’]?\\s*(?:19|20)?[0-9]{2})"
RANGE = f"(?i)({DATE})\\s*(?:-|to|till|until)\\s*({DATE}|present|current|till date|to date|now)"
DATE_ALONE = "(?i)^[\\s\\-/,.()]*(?:(?:[0-9]{1,2}[/\\-])?(?:19|20)?[0-9]{2}|[a-z]{3,9}\\.?\\s*['’]?\\s*(?:19|20)?[0-9]{2}|present|current|till date|to date|now|-|to|till|since|duration|cgpa|gpa|percentage|[0-9]+(?:\\.[0-9]+)?%?)[\\s\\-/,.()]*$"
DATE_WORDS = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "january", "february", "march", "april", "june", "july", "august",
    "september", "october", "november", "december", "present", "current", "till", "date", "to", "now", "since", "cgpa", "gpa", "percentage",
)
MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DATE_TAIL = f"(?i)[\\s.,\\-]*(?:\\b(?:{MONTH})\\b|\\bto\\b|\\btill\\b|\\buntil\\b|\\bnow\\b|\\bpresent\\b|\\bcurrent\\b|\\bdate\\b|\\bsince\\b|\\bfrom\\b|\\bin\\b|\\bon\\b|\\bat\\b|[0-9\\-/.]+)+$"
PROSE = "(?i)^\\s*(?:working|worked|serving|served|currently working)\\s+(?:as\\s+)?(?:a|an|the)?\\s*"
TAIL = "(?i)\\s+(?:responsible|responsibl\\w*|handling|involved|managing|reporting|where|who)\\b.*$"
ISSUER = "(?i)\\bfrom\\s+([^.(\\n]{2,60})"
NOISE = "^\\s*[\\-•o]\\s*"
YEAR = "\\b(?:19[7-9][0-9]|20[0-4][0-9])\\b"
SUSPECT_PLACE = "(?i)\\b(?:migration|installation|upgrad|administration|support|developer|engineer|sql|oracle|database)\\b"
#: An introduction of at least so many characters is an entry; words of a line that is prose; facts of an entry.
INTRODUCTION, LONG, FACTS = 26, 19, 4


def entries(cell: Column) -> Column:
    """(number, raw) of a cell's entries: its numbered blocks, 0 for an introduction before them, 1 for a cell without numbers."""

    def cut(text: Column) -> Column:
        parts = F.split(F.regexp_replace(text, ENTRY, "\u0001$2\u0002"), "\u0001")
        one = lambda n, raw: F.struct(n.cast("int").alias("number"), F.trim(F.regexp_replace(raw, "^\\s+|\\s+$", "")).alias("raw"))
        numbered = v.let(parts, lambda p: F.concat(F.filter(F.array(one(F.lit(0), F.get(p, F.lit(0)))), lambda e: F.length(e["raw"]) >= INTRODUCTION), F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda x: one(F.split_part(x, F.lit("\u0002"), F.lit(1)), F.split_part(x, F.lit("\u0002"), F.lit(2))))))
        return F.when(text == "", F.slice(F.array(one(F.lit(0), F.lit(""))), 1, 0)).when(F.size(parts) == 1, F.array(one(F.lit(1), text))).otherwise(F.filter(numbered, lambda e: e["raw"] != ""))

    return v.let(v.unified(cell), cut)




def _stripped(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v.unified(line), NOISE, ""), "^[ .,;:\\-]+|[ .,;:\\-]+$", "")


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, "\\s+"), lambda w: w != ""))


def lines(block: Column) -> Column:
    """The lines that may name something: no duties, no prose, without labels."""
    kept = F.filter(F.transform(F.split(block, "\n"), _stripped), lambda x: (F.length(x) >= 3) & ~x.rlike(DUTIES) & (_words(x) < LONG))
    return F.transform(kept, lambda x: F.regexp_replace(x, LABEL, ""))


def date_alone(line: Column) -> Column:
    rest = F.trim(F.regexp_replace(F.regexp_replace(line, YEAR, " "), "[\\s\\-/,.()–]+", " "))
    parts = F.filter(F.split(F.lower(rest), "\\s+"), lambda w: w != "")
    return (rest == "") | F.trim(line).rlike(DATE_ALONE) | F.forall(parts, lambda w: F.regexp_replace(w, "^[.\\-]+|[.\\-]+$", "").isin(*DATE_WORDS) | w.rlike("^[0-9]+$"))


def fact(name: Column) -> Column:
    """A name in comparable form, without dates at its end and prose around it."""
    edge = lambda x: F.regexp_replace(x, "^[ .,\\-]+|[ .,\\-]+$", "")
    x = F.regexp_replace(F.regexp_replace(v.norm(name), PROSE, ""), TAIL, "")
    x = edge(F.regexp_replace(F.regexp_replace(x, YEAR, " "), "\\s+", " "))
    for _ in range(3):  # what a date hid may be a date again
        x = edge(F.regexp_replace(x, DATE_TAIL, ""))
    return x


def facts(named: Column) -> Column:
    """At most four distinct facts of the lines; parts between bars are facts of their own."""
    pieces = F.flatten(F.transform(F.filter(named, lambda x: ~date_alone(x)), lambda x: F.split(x, "\\s*[|]\\s*")))
    kept = F.filter(F.transform(pieces, fact), lambda x: (F.length(x) >= 3) & ~x.rlike("^[0-9]+$"))
    return F.slice(F.array_distinct(kept), 1, FACTS)


def dates(block: Column) -> Column:
    """(start, end): the first range's months, else the first date alone."""
    a = F.regexp_extract(block, RANGE, 1)
    return F.when(a != "", F.struct(v.month_key(a).alias("start"), v.month_key(F.regexp_extract(block, RANGE, 2)).alias("end"))).otherwise(F.struct(v.month_key(block).alias("start"), F.lit("").alias("end")))


def _told(primary: Column, secondary: Column, preferred: Column, all_: Column) -> Column:
    first = F.get(all_, F.lit(0))
    named = v.let(preferred, lambda x: F.when(F.size(x) > 0, x).otherwise(F.slice(all_, 1, 2)))
    return F.struct(F.coalesce(primary, first).alias("primary"), F.coalesce(secondary, F.lit("")).alias("secondary"), facts(named).alias("facts"))


def education(all_: Column) -> Column:
    """(primary, secondary, facts) of an entry's lines: the degree, the school."""
    def told(p: Column) -> Column:
        degrees, schools = p["degrees"], p["schools"]
        return _told(F.get(degrees, F.lit(0)), F.get(F.filter(schools, lambda x: ~F.array_contains(F.slice(degrees, 1, 1), x)), F.lit(0)), F.concat(degrees, F.filter(schools, lambda x: ~F.array_contains(degrees, x))), all_)

    return v.let(F.struct(F.filter(all_, lambda x: x.rlike(DEGREE)).alias("degrees"), F.filter(all_, lambda x: x.rlike(SCHOOL)).alias("schools")), told)


def experience(all_: Column) -> Column:
    """(primary, secondary, facts) of an entry's lines: the role, the company. A first line may hold both."""
    head = F.filter(F.split(F.get(all_, F.lit(0)), "\\s*[,|]\\s*"), lambda x: F.trim(x) != "")
    named = lambda x: F.struct(F.filter(x, lambda y: y.rlike(ROLE) & (_words(y) <= 10)).alias("roles"), F.filter(x, lambda y: y.rlike(COMPANY)).alias("companies"))

    def told(p: Column) -> Column:
        roles, companies = p["roles"], p["companies"]
        return _told(F.get(roles, F.lit(0)), F.get(F.filter(companies, lambda x: ~F.array_contains(F.slice(roles, 1, 1), x)), F.lit(0)), F.concat(companies, F.filter(roles, lambda x: ~F.array_contains(companies, x))), all_)

    return v.let(v.let(F.concat(head, F.slice(all_, 1, 3)), named), told)


def certification(block: Column) -> Column:
    """(primary, secondary, facts): the certificate, who issued it."""
    text = v.unified(block)
    issuer = _stripped(F.regexp_extract(text, ISSUER, 1))
    before = F.when(text.rlike(ISSUER), F.regexp_extract(text, "(?is)^(.*?)\\bfrom\\s+[^.(\\n]{2,60}", 1)).otherwise(text)
    name = _stripped(F.regexp_replace(before, "\\([^)]*\\)", " "))
    return F.struct(name.alias("primary"), issuer.alias("secondary"), F.filter(F.array(v.norm(name), v.norm(issuer)), lambda x: F.length(x) >= 3).alias("facts"))


def audit(email: Column, phone: Column, place: Column, linkedin: Column, github: Column) -> Column:
    """What looks wrong in a row of gold cells."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    found = F.array(
        F.when(given(email) & (F.size(v.emails(email)) == 0), "email_unparseable"), F.when(given(phone) & (F.size(v.phone_keys(phone)) == 0), "phone_unparseable"), F.when(given(place) & place.rlike(SUSPECT_PLACE), "location_looks_like_skills"),
        F.when(F.length(place) > 60, "location_is_full_address"), F.when(given(github) & ~F.lower(github).contains("github"), "github_url_not_github"), F.when(given(linkedin) & ~F.lower(linkedin).contains("linkedin"), "linkedin_url_not_linkedin"),
    )
    return F.array_compact(found)
