"""Gold cells against a plain loop over the same patterns, on own cells and on the whole tables."""

import re

import pytest
from pyspark.sql import functions as F

from harrow.functions import gold as g
from harrow.functions import values as v
from harrow.plans import gold as plans

CELLS = [
    (1, "education", "Education 1: Bachelor of Science (Information Technology)\nHill College, Mumbai.\n06/2011- 04/2014.\n\nEducation 2: High School/Secondary Programs\nSt. John's College (SCIENCE), Mumbai.\n06/2009- 02/2011."),
    (2, "experiences", "Experience 1: North Group, Associate Vice President, Mar'2020- Till date          Experience 2: Royal Bank, Technical Lead, Feb'2014- Feb'2019."),
    (3, "certifications", "Certification 1:- Social Media Strategy from Hub Academy. (Issued May 2020)."),
    (4, "experiences", "Experience 1: IBEX DIGITAL PVT LTD (MOBILE), Mumbai\nJun 2023 - Present\nResponsibilities: all\n- working as a Developer handling things"),
    (5, "education", None), (6, "education", ""), (7, "experiences", "2010 - 2012"), (8, "education", "An introduction that is long enough Education 1 - MBA | Sea University\nsince 2001"),
]


def plain(section, cell):
    """Entries as (number, primary, secondary, facts) by loops."""
    text = re.sub(r"^\s+|\s+$", "", re.sub(r"[ \t]+", " ", (cell or "").translate(str.maketrans({**dict.fromkeys(v.DASHES, "-"), **dict.fromkeys(v.BULLETS + " ", " "), **dict(zip(v.QUOTES, v.PLAIN_QUOTES, strict=True))}))))
    norm = lambda x: re.sub(r" +", " ", re.sub(r"[^a-z0-9+#./&\- ]+", " ", x.lower())).strip(" ")
    found = list(re.finditer(g.ENTRY, text))
    blocks = [] if not text else [(1, text)] if not found else []
    if found:
        intro = text[: found[0].start()].strip()
        blocks += [(0, intro)] * (len(intro) > 25)
        for m, after in zip(found, [*found[1:], None], strict=True):
            body = text[m.end() : after.start() if after else len(text)].strip()
            blocks += [(int(m.group(2)), body)] * bool(body)

    def strip(line):
        return re.sub(g.NOISE, "", re.sub(r"[ \t]+", " ", line).strip()).strip(" .,;:-")

    def alone(line):
        rest = re.sub(r"[\s\-/,.()–]+", " ", re.sub(g.YEAR, " ", line)).strip()
        return not rest or bool(re.match(g.DATE_ALONE, line.strip())) or all(w.strip(".-") in g.DATE_WORDS or w.isdigit() for w in rest.lower().split())

    def facts(lines):
        out = []
        for piece in (p for x in lines if not alone(x) for p in re.split(r"\s*[|]\s*", x)):
            x = re.sub(g.TAIL, "", re.sub(g.PROSE, "", norm(piece)))
            x, before = re.sub(r"\s+", " ", re.sub(g.YEAR, " ", x)).strip(" .,-"), None
            while before != x:
                before, x = x, re.sub(g.DATE_TAIL, "", x).strip(" .,-")
            if len(x) >= 3 and not x.isdigit() and x not in out:
                out.append(x)
        return out[:4]

    out = []
    for number, block in blocks:
        if section == "certifications":
            m = re.search(g.ISSUER, block)
            issuer, name = strip(m.group(1)) if m else "", strip(re.sub(r"\([^)]*\)", " ", block[: m.start()] if m else block))
            if len(block) >= 3:
                out.append((number, name, issuer, [f for f in (norm(name), norm(issuer)) if len(f) >= 3]))
            continue
        lines = [re.sub(g.LABEL, "", x) for x in map(strip, block.split("\n")) if len(x) >= 3 and not re.match(g.DUTIES, x) and len(x.split()) <= 18]
        if not lines:
            continue
        if section == "education":
            first, second = [x for x in lines if re.search(g.DEGREE, x)], [x for x in lines if re.search(g.SCHOOL, x)]
            preferred = first + [x for x in second if x not in first]
        else:
            told = [p for p in re.split(r"\s*[,|]\s*", lines[0]) if p.strip()] + lines[:3]
            first, second = [x for x in told if re.search(g.ROLE, x) and len(x.split()) <= 10], [x for x in told if re.search(g.COMPANY, x)]
            preferred = second + [x for x in first if x not in second]
        out.append((number, (first or lines)[0], next((x for x in second if x not in first[:1]), ""), facts(preferred or lines[:2])))
    return out


def engine(rows):
    found = {}
    for r in plans.entries(rows).orderBy("id", "section", "pos").collect():
        found.setdefault((r.id, r.section), []).append((r.number, r.primary, r.secondary, r.facts))
    return found


def test_own_cells(spark):
    frame = spark.createDataFrame(CELLS, "id long, section string, cell string")
    want = {(i, s): e for i, s, c in CELLS if (e := plain(s, c))}
    assert engine(frame) == want
    rows = {(r.id, r.number): r for r in plans.entries(frame).collect()}
    assert (rows[1, 1].start, rows[1, 1].end, rows[1, 1].years) == ("2011-06", "2014-04", ["2011", "2014"]) and rows[2, 2].end == "2019-02"
    assert rows[3, 1].primary.lower().startswith("social media strategy") and "hub" in rows[3, 1].secondary.lower()
    assert rows[4, 1].facts and not any("present" in f for f in rows[4, 1].facts)
    assert not {5, 6} & {k[0] for k in rows}


@pytest.mark.parametrize("table", ["tiny"])
def test_whole_tables(spark, request, table):
    rows = plans.cells(spark, request.getfixturevalue(table))
    want = {(r.id, r.section): e for r in rows.collect() if (e := plain(r.section, r.cell))}
    assert engine(rows) == want


def test_audit(spark):
    rows = spark.createDataFrame([("a@b.com", "9999999999", "DB Migration, Installation", "https://example.com/me", None), (None,) * 5, ("x", "1", "y" * 61, "linkedin.com/in/x", "z")], "a string, b string, c string, d string, e string")
    assert [r.x for r in rows.select(g.audit(*[F.col(c) for c in "abcde"]).alias("x")).collect()] == [["location_looks_like_skills", "linkedin_url_not_linkedin"], [], ["email_unparseable", "phone_unparseable", "location_is_full_address", "github_url_not_github"]]
