"""Value keys and scores on small inputs, and those without SQL against plain loops."""

import difflib
import unicodedata

from pyspark.sql import functions as F

from harrow.functions import text as t
from harrow.functions import values as v
from harrow.plans import values as plans


def apply(spark, function, rows):
    width = len(rows[0])
    frame = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(width)))
    return [r.x for r in frame.select(function(*[F.col(c) for c in frame.columns]).alias("x")).collect()]


def test_contacts(spark):
    assert apply(spark, v.first_email, [("E-mail: a@b.com, c@d.org",), ("x.y\n@mail.org z@w.com",), ("c@d.org mail id - a@b.com",), ("none",), ("",)]) == ["a@b.com", "x.y@mail.org", "a@b.com", "", ""]
    assert apply(spark, v.phone_keys, [("+91 98765 43210",), ("98765432109876543211",), ("12",), (None,)]) == [["9876543210"], ["9876543210", "9876543211"], [], []]
    assert apply(spark, v.first_phone, [("Phone: 98765 43210",), ("2019 2020 2021 2022",), ("call 9876543210 now",), ("20192020",)]) == ["9876543210", "9202020212", "9876543210", ""]  # only twelve digits are a row of years
    forms = [("Mobile: 9820192020",), ("Call +91 99 70 38 80 01",), ("99 70 38 80 01",), ("tel 022 2345 6789",), ("since 2018 20192020 and 9123456789",), (None,), ("",), ("x " * 2000 + "9876543210",)]
    assert apply(spark, v.first_phone, forms) == ["9820192020", "+919970388001", "9970388001", "02223456789", "9123456789", "", "", "9876543210"]
    assert apply(spark, v.url_key, [("https://www.Site.com/in/X/?a=1",), ("<http://a.b/c/>",), ("",)]) == ["site.com/in/x", "a.b/c", ""]
    assert apply(spark, v.email_score, [("a@b.com", "A@B.com."), ("a@b.com", "a@c.com"), ("a@b.com", "")]) == [1.0, 0.6, 0.0]


def test_date_forms(spark):
    forms = {
        "Jan 2020-Mar 2021": ("2020-01", "2021-03"), "01/2020-03/2021": ("2020-01", "2021-03"), "2019-2021": ("2019", "2021"), "(09/2022) – (06/2023)": ("2022-09", "2023-06"), "May 2021": ("2021-05", ""),
        "SQL Server since 2019": None, "Oracle 2019": None, "since May 2020 Oracle": ("2020-05", "present"), "5,Jan, 2021 to 3rd Feb 2022": ("2021-01", "2022-02"), "Aug'20 - Dec’21": ("2020-08", "2021-12"),
        "Jun 2024 till date": ("2024-06", "present"), "Present": ("", "present"), "(Jun 2023 - Aug 2023)": ("2023-06", "2023-08"), "Dev (Jan 2022 - Dec 2024), Pune": ("2022-01", "2024-12"), "12/05/2019 - 01/06/2020": ("2019-05", "2020-06"), "": None,
    }
    assert [r and tuple(r) for r in apply(spark, v.date_range, [(x,) for x in forms])] == list(forms.values())


def test_profile_links(spark):
    texts = ["see https://www.linkedin.com/in/a-b/ and github.com/x", "GitHub: bar", "portfolio: mba.com", "Website: ann.dev/x.", "Portfolio: https://github.com/q", None]
    want = [("https://www.linkedin.com/in/a-b", "https://github.com/x", ""), ("", "https://github.com/bar", ""), ("", "", ""), ("", "", "https://ann.dev/x"), ("", "https://github.com/q", ""), ("", "", "")]
    assert [tuple(r) for r in apply(spark, v.profile_links, [(x,) for x in texts])] == want
    assert apply(spark, v.url_score, [("https://www.a.com/in/x", "a.com/in/x/"), ("linkedin.com/in/x", "in/x"), ("a.com/in/a", "a.com/in/b"), ("", "a.b")]) == [1.0, 0.95, 0.0, 0.0]


def test_category_labels(spark):
    cell = [("TECHNICAL SKILLS\nPROGRAMMING LANGUAGES\nC#, C++\nWEB TECHNOLOGIES\nASP.NET, HTML",)]
    assert apply(spark, lambda c: v.split_skills(c, True), cell) == [["csharp", "cpp", "asp.net", "html"]]
    assert "technical skills" in apply(spark, v.split_skills, cell)[0]


def test_names_places_levels(spark):
    assert apply(spark, v.name_score, [("Mr. Ann Lee", "ann lee"), ("Ann Lee Roe", "ann roe"), ("Ann Lee", "Ann Roe"), ("", "a")]) == [1.0, 0.95, 0.5, 0.0]
    assert apply(spark, v.place_score, [("Pune, India", "pune"), ("Pune East, Maharashtra 411001", "Mumbai"), ("Navi Mumbai", "Mumbai"), ("India", "India"), ("", "x")]) == [1.0, 0.0, 0.75, 1.0, 0.0]
    assert apply(spark, v.level_score, [("Senior dev", "experienced"), ("Fresher", "intern"), ("", "x"), ("odd", "odd")]) == [1.0, 0.5, 0.0, 1.0]
    assert apply(spark, v.company_key, [("Acme Pvt. Ltd.",), ("Acme, Inc.",), (" Acme ",), (None,)]) == ["acme", "acme", "acme", ""]


def test_skills_dates_redaction(spark):
    assert apply(spark, v.split_skills, [("Languages: JS, C++ / Go\nDB: Postgres; 12 | Node.js, js",)]) == [["javascript", "cpp", "go", "postgresql", "nodejs"]]
    assert apply(spark, v.month_key, [("Jan '09",), ("03/2015",), ("2014-7",), ("till date",), ("June 2012",), ("xx 1999",), ("",), (None,)]) == ["2009-01", "2015-03", "2014-07", "present", "2012-06", "1999", "", ""]
    assert [r and tuple(r) for r in apply(spark, v.date_range, [("Jan 2010 – Mar 2012",), ("since 2015",), ("2011 to Present",), ("no",)])] == [("2010-01", "2012-03"), ("2015", "present"), ("2011", "present"), None]
    assert apply(spark, v.year_set, [("Feb'14 and 1999, '75",)]) == [["1975", "1999", "2014"]]
    lines = [("Authorization: Digest a b",), ("got bearer abc.d",), ("postgres://u:p@h redis://:x@h session=1;",), ("https://h.org/x/webhook/key?a",), ("plain",)]
    assert apply(spark, v.redact, lines) == ["Authorization: [REDACTED]", "got Bearer [REDACTED]", "postgres://u:[REDACTED]@h redis://:[REDACTED]@h session=[REDACTED];", "https://h.org/x/webhook/[REDACTED]?a", "plain"]
    got = spark.sql("SELECT map('Password', 'x', 'my_token', 'y', 'note', 'basic z', 'n', NULL) AS m").select(v.redact_map(F.col("m")).alias("m")).first().m
    assert got == {"Password": "[REDACTED]", "my_token": "[REDACTED]", "note": "Basic [REDACTED]", "n": None}


def test_text_quality(spark):
    rows = [("",), (None,), ("#" * 40,), ("short",), ("an engineer",), ("word " * 30,), ("(cid:1)(cid:2)(cid:3) x",), ("�" * 5 + "abc" * 9,)]
    assert apply(spark, v.text_quality, rows) == ["EMPTY", "EMPTY", "GARBAGE", "WEAK", "GOOD", "GOOD", "GARBAGE", "GARBAGE"]


def test_compatibility_forms(spark):
    texts = ["ﬁle ｘ ①", "“a” – b • c", "é", "plain"]
    assert apply(spark, plans.compatible, [(x,) for x in texts]) == [unicodedata.normalize("NFKC", x) for x in texts]


def test_ratio_against_a_loop(spark, tiny):
    for r in plans.ratio(spark, tiny).collect():
        a, b = (set(x for x in s.split() if len(x) > 1 or x.isdigit()) for s in (r.g, r.f))
        overlap = 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
        whole = difflib.SequenceMatcher(None, r.g, r.f).ratio() if r.g and r.f else float(r.g == r.f)
        assert abs(r.ratio - max(whole, overlap)) < 1e-9 and t.norm
