"""Validators of a record's fields: ``ok`` or the reason why a value isn't one. Column expressions over texts; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions import values as v

#: Forms of phones, addresses and dates; cues of degrees, schools, companies, titles and duties; headings that are no names; hosts of placeholders.
PHONE = "^\\+?[0-9\\s\\-().]{7,20}$"
URL = "(?i)^(?:https?://)?(?:[A-Za-z0-9\\-]+\\.)+[A-Za-z]{2,}(?:/.*)?$"
DEGREE_HOST = "(?i)^(?:https?://)?(?:www\\.)?(?:bsc|msc|bcom|mcom|bca|mca|bba|mba|btech|mtech|be|me|ba|ma|phd)\\.[a-z]{2,6}/?$"
PLACEHOLDERS = ("example.com", "localhost", "placeholder", "loading.", "test.com")
DEGREE = (
    "(?i)\\b(?:(?:bachelor|master|doctor)(?:'?s)?s?|diploma|doctorate|phd|b\\.?\\s*-?\\s*tech|m\\.?\\s*-?\\s*tech|b\\.?\\s*e|m\\.?\\s*e|b\\.?\\s*sc|m\\.?\\s*sc|b\\.?\\s*com|m\\.?\\s*com|b\\.?\\s*s|m\\.?\\s*s|mba|mca|bca|bba|mms|pgdm|pgp|ph\\.?\\s*d"
    "|b\\.?\\s*pharm|d\\.?\\s*pharm|ll\\.?\\s*b|ll\\.?\\s*m|hsc|ssc|cbse|icse|puc|s\\.?\\s*s\\.?\\s*c|h\\.?\\s*s\\.?\\s*c|10th|12th|higher\\s+secondary|senior\\s+secondary|pre[\\s\\-]?university|intermediate|high\\s+school|secondary\\s+school|associate(?:'?s)?)\\b"
)
DUTY = "(?i)^(?:helped|trained|taught|managed|executed|coordinated|collaborated|developed|designed|created|built|led|implemented|optimized|improved|worked|assisted|supported|handled|performed|conducted|analyzed|delivered|configured|setup|responsible|identifying|enabling|applied|resulting|drove|leading\\s+to)\\b"
SCHOOL = "(?i)\\b(?:university|college|school|institute|academy|vidyalaya|polytechnic|campus|faculty|iit|nit|iiit|bits|mit)\\b"
COMPANY = "(?i)\\b(?:pvt\\.?\\s*ltd|private\\s+limited|ltd|inc|llc|gmbh|corp|technologies|technology|solutions|systems|foundation|consulting|services|labs?|studio|ventures)\\b"
MONTH_YEAR = "(?i)^(?:(?:0?[1-9]|1[0-2])[/\\-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}(?:[/\\-](?:0?[1-9]|1[0-2]))?|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+(?:19|20)[0-9]{2}|Present|Current|Now)$"
MONTH = "(?i)^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|0?[1-9]|1[0-2])$"
SCORE = "(?i)^(?:[0-9]{1,3}(?:\\.[0-9]+)?\\s*%|(?:cgpa|gpa)\\s*[:\\-]?\\s*[0-9.]+)$"
TITLE = "(?i)\\b(?:intern|engineer|developer|analyst|trainee|manager|officer|associate|consultant|lead|executive|specialist|administrator|admin|architect|dba|designer|scientist|director|head|programmer|coordinator|supervisor)\\b"
NO_NAMES = (
    "resume", "curriculum vitae", "cv", "profile", "summary", "objective", "overview", "role overview", "experience", "education", "skills", "projects", "certifications", "professional summary",
    "professional objective", "career objective", "work experience", "contact", "core competencies", "technical proficiency", "technical expertise", "academic background", "academic qualifications", "achievements",
    "accomplishments", "awards", "honors", "activities", "languages", "internships", "internship", "references", "responsibilities", "duties", "learnings", "conclusion",
)
INVISIBLE = "[​‌‍⁠﻿­]"


def _given(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), "\\A\\s+|\\s+\\z", "")


def _words(s: Column) -> Column:
    return F.size(F.filter(F.split(s, "\\s+"), lambda w: w != ""))


def nonempty(value: Column, label: str = "field") -> Column:
    return F.when(_given(value) == "", f"{label}_empty").otherwise("ok")


def email(value: Column) -> Column:
    return v.let(_given(value), lambda s: F.when(s == "", "email_empty").when(~s.rlike(f"^{v.EMAIL}$"), "email_invalid").otherwise("ok"))


def phone(value: Column) -> Column:
    """Seven to fifteen digits that aren't years in a row, with the signs of a number between them."""

    def fine(p: Column) -> Column:
        s, d = p["s"], p["d"]
        years = F.regexp_extract_all(d, F.lit("(?:19|20)[0-9]{2}"), F.lit(0))
        soup = (F.size(years) >= 2) & d.contains(F.array_join(years, ""))
        return F.when(s == "", "phone_empty").when(~F.length(d).between(7, 15), "phone_digit_count").when(soup, "phone_year_soup").when(~s.rlike(PHONE), "phone_invalid").otherwise("ok")

    return v.let(v.let(_given(value), lambda s: F.struct(s.alias("s"), v.digits(s).alias("d"))), fine)


def url(value: Column, host: str = "", allow_empty: bool = False) -> Column:
    def fine(s: Column) -> Column:
        low = F.lower(s)
        bad = F.lit(False)
        if "linkedin" not in host and "github" not in host:
            for word in PLACEHOLDERS:
                bad = bad | low.contains(word)
            bad = bad & ~low.contains("linkedin.com") & ~low.contains("github.com")
        told = F.when(s == "", "empty_allowed" if allow_empty else "url_empty").when(bad, "url_placeholder").when(s.rlike(DEGREE_HOST), "url_is_degree").when(~s.rlike(URL), "url_invalid")
        return (told.when(~low.contains(host.lower()), f"url_host_mismatch_{host}") if host else told).otherwise("ok")

    return v.let(_given(value), fine)


def person_name(value: Column) -> Column:
    def fine(s: Column) -> Column:
        low = F.lower(s)
        return (
            F.when(s == "", "name_empty").when(low.isin(*NO_NAMES) | low.endswith(" resume") | low.endswith(" cv"), "name_is_title").when(s.contains("@") | low.contains("http"), "name_not_person")
            .when(s.rlike("[0-9]"), "name_has_digits").when(s.rlike(DEGREE), "name_is_degree").when(~_words(s).between(1, 5), "name_word_count").otherwise("ok")
        )

    return v.let(_given(F.translate(F.regexp_replace(F.coalesce(value, F.lit("")), INVISIBLE, ""), "\xa0", " ")), fine)


def month_year(value: Column, allow_empty: bool = True) -> Column:
    return v.let(_given(value), lambda s: F.when(s == "", "empty_allowed" if allow_empty else "date_empty").when(s.rlike(MONTH_YEAR), "ok").otherwise("date_invalid"))


def institution(value: Column) -> Column:
    def fine(s: Column) -> Column:
        school = s.rlike(SCHOOL)
        return (
            F.when(s == "", "institution_empty").when(s.rlike(MONTH), "institution_is_month").when(s.rlike(MONTH_YEAR), "institution_is_date").when(F.length(s) < 3, "institution_too_short").when(s.rlike(SCORE), "institution_is_score")
            .when(s.rlike(DUTY), "institution_is_duty").when(s.rlike("^\\p{Ll}"), "institution_is_prose").when(s.rlike(TITLE) & ~school, "institution_is_job_title").when(s.rlike(COMPANY) & ~school, "institution_is_company")
            .when((_words(s) > 12) & ~school, "institution_too_long").when(s.endswith(".") & (_words(s) >= 4) & ~school, "institution_is_sentence").otherwise("ok")
        )

    return v.let(_given(value), fine)


def degree(value: Column) -> Column:
    def fine(s: Column) -> Column:
        cue = s.rlike(DEGREE)
        return (
            F.when(s == "", "degree_empty").when(s.rlike(MONTH) | s.rlike(MONTH_YEAR), "degree_is_date").when(s.rlike(DUTY), "degree_is_duty").when(s.rlike("^[0-9]{1,2}\\.\\s+\\S"), "degree_is_numbered_duty").when(s.rlike("^\\p{Ll}"), "degree_is_prose")
            .when((F.length(s) > 80) & ~cue, "degree_too_long").when(s.rlike(TITLE) & ~cue, "degree_is_job_title").when(~cue, "degree_no_cue").otherwise("ok")
        )

    return v.let(_given(value), fine)


def grounded(degree_: Column, school: Column) -> Column:
    """Both sides of an education row are what they should be."""
    return (degree(degree_) == "ok") & (institution(school) == "ok")
