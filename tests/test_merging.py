"""Merged jobs against loops over the rules, on own rows and on the whole table."""

import re

from harrow.functions import validators as c
from harrow.operators import merging
from harrow.plans import validation as plans

COLUMNS = "id long, no long, role string, company string, start string, end string, current boolean, description string"
TITLE = re.compile(c.TITLE)


def plain(held, found):
    """All rules in one place; rows are lists [role, company, start, end, current, description]."""
    prose = lambda x: bool(x) and bool(re.search(r"(?i)\b(as|from|currently|working with|worked with)\b", x) or (len(x.split()) >= 6 and not re.search(r"(?i)\b(pvt|ltd|llc|inc|corp|limited|technologies|solutions|labs|systems)\b", x)))

    def odd(r):
        if not r[0]:
            return False
        a, b = TITLE.search(r[0]), TITLE.search(r[1])
        firm = re.search(r"(?i)\b(pvt|ltd|llc|inc|corp|limited|technologies|solutions|labs|systems)\b", r[0]) and not a
        return bool((r[1] and b and not a) or (firm and (not r[1] or b)) or (not r[1] and not a and len(r[0].split()) <= 3))

    def pair(r):
        one = r[1] if r[1] and not r[0] else r[0] if r[0] and not r[1] else ""
        for dash in "—–-":
            if one and dash in one:
                left, right = (x.strip() for x in one.split(dash, 1))
                if left and right and len(left.split()) <= 8:
                    return left.lower(), right.lower()
        return r[0].lower(), r[1].lower()

    def same(x, y):
        (a, f), (b, g) = pair(x), pair(y)
        near, starts = not f or not g or f in g or g in f, not x[2] or not y[2] or x[2] == y[2]
        if not near or not starts:
            return False
        return (bool(x[2]) and x[2] == y[2]) or (bool(a) and a == b) or (bool(f) and bool(g) and (not a or not b or a == b))

    ok = lambda r: bool((r[0] and r[1] and not prose(r[1])) or ((r[0] or (r[1] and not prose(r[1]))) and r[2]))
    if not held:
        return [(True, *r) for r in found if ok(r) and not odd(r)]
    out = []
    for r in held:
        n = list(r)
        for o in found:
            if same(r, o):
                if o[1] and not prose(o[1]) and (not r[1] or prose(r[1])):
                    n[1] = o[1]
                if o[0] and (not r[0] or (odd(r) and (TITLE.search(o[0]) or not odd(o)))) and (TITLE.search(o[0]) or len(o[0].split()) <= 8):
                    n[0] = o[0]
                n[2] = r[2] or o[2]
                if not r[3] and not r[4] and (o[3] or o[4]):
                    n[3] = o[3]
                if o[4] and not r[4] and (not r[1] or not o[1] or r[1].lower() == o[1].lower()) and (not r[2] or not o[2] or r[2] == o[2]):
                    n[4] = True
                    if not r[3]:
                        n[3] = ""
                n[5] = r[5] or o[5]
                break
        out.append((False, *n))
    for o in found:
        if ok(o) and not odd(o) and not prose(o[1]) and not any(same(r[1:], o) for r in out):
            out.append((True, *o))
    return out


def compare(held, found):
    sides = []
    for frame in (held, found):
        rows = {}
        for r in sorted(frame.collect(), key=lambda r: (r.id, r.no)):
            rows.setdefault(r.id, []).append([(r[x] or "") if x != "current" else bool(r[x]) for x in merging.SLOTS])
        sides.append(rows)
    got = {}
    for r in merging.merge_fields(held, found, "id").collect():
        got.setdefault(r.id, []).append((r.added, r.no, tuple(r[x] for x in merging.SLOTS)))
    got = {i: [(a, *row) for a, _, row in sorted(rows)] for i, rows in got.items()}
    want = {i: w for i in sides[0] | sides[1] if (w := plain(sides[0].get(i, []), sides[1].get(i, [])))}
    assert got == want
    return got


def test_own_rows(spark):
    held = [(1, 1, "Engineer", "Acme Labs", "2020-01", "", False, ""), (1, 2, "", "", "2022", None, None, None), (2, 1, None, "Analyst - Grey Ltd", None, None, False, None), (4, 1, "Acme Solutions", "", "", "", False, "")]
    found = [(1, 1, "Lead", "Acme Labs", "2020-01", "2021-01", False, "did it"), (1, 2, "Tester", "River Ltd", "2022", "", True, ""), (1, 3, "Clerk", "Sea", "2001", "", False, ""), (1, 4, "Clerk", "Sea", "2001", "", False, ""), (1, 5, "Fine Systems", "", "1999", "", False, ""), (2, 1, "Analyst", "Grey", "2019", "2020", False, ""), (3, 1, "Manager", "", "2000", "", False, ""), (3, 2, "", "", "", "", False, "x"), (4, 1, "Director", "Acme Solutions", "", "", False, "")]
    got = compare(spark.createDataFrame(held, COLUMNS), spark.createDataFrame(found, COLUMNS))
    assert got[1] == [(False, "Engineer", "Acme Labs", "2020-01", "2021-01", False, "did it"), (False, "Tester", "River Ltd", "2022", "", True, ""), (True, "Clerk", "Sea", "2001", "", False, "")]
    assert got[3] == [(True, "Manager", "", "2000", "", False, "")]


def test_whole_table(spark, tiny):
    got = compare(plans.job_rows(spark, tiny, "held"), plans.job_rows(spark, tiny, "found"))
    assert any(r[0] for rows in got.values() for r in rows)


def test_nothing(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert merging.merge_fields(none, none, "id").count() == 0
