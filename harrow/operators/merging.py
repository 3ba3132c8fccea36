"""Rows of jobs from two sources merged field by field: empty slots are filled, a valid field is never replaced."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.validators import TITLE
from harrow.operators.folds import ordered_fold

#: Words of companies; words that a company's name doesn't hold; dashes between a role and a company.
ORGANISATION = re.compile(r"(?i)\b(?:pvt|ltd|llc|inc|corp|limited|technologies|solutions|labs|systems)\b")
LEFT_OVER = re.compile(r"(?i)\b(?:as|from|currently|working with|worked with)\b")
DASHES = ("—", "–", "-")
_TITLE = re.compile(TITLE)
SLOTS = ("role", "company", "start", "end", "current", "description")


def fragment(company: str) -> bool:
    """Left-over prose, no employer."""
    return bool(company) and bool(LEFT_OVER.search(company) or (len(company.split()) >= 6 and not ORGANISATION.search(company)))


def anchored(row: dict) -> bool:
    company = "" if fragment(row["company"]) else row["company"]
    return bool((row["role"] and company) or ((row["role"] or company) and row["start"]))


def swapped(row: dict) -> bool:
    """The role looks like a company or the company like a role."""
    role, company = row["role"], row["company"]
    if not role:
        return False
    titled, other = bool(_TITLE.search(role)), bool(_TITLE.search(company))
    organisation = bool(ORGANISATION.search(role)) and not titled
    return bool(company and other and not titled) or (organisation and (not company or other)) or (not company and not titled and len(role.split()) <= 3)


def _parted(row: dict) -> tuple[str, str]:
    """Role and company in lower case; a pair packed into one of them is taken apart."""
    role, company = row["role"], row["company"]
    packed = company if company and not role else role if role and not company else ""
    for dash in DASHES if packed else ():
        left, found, right = (x.strip() for x in packed.partition(dash))
        if found and left and right and len(left.split()) <= 8:
            return left.lower(), right.lower()
    return role.lower(), company.lower()


def same_job(a: dict, b: dict) -> bool:
    """Equal starts, equal roles or companies of which one holds the other, and nothing that speaks against it."""
    (role, company), (role_, company_) = _parted(a), _parted(b)
    start, start_ = a["start"], b["start"]
    fits = not company or not company_ or company in company_ or company_ in company
    if not fits or (start and start_ and start != start_):
        return False
    return bool((start and start == start_) or (role and role == role_) or (company and company_ and (not role or not role_ or role == role_)))


def filled(row: dict, other: dict) -> dict:
    """The row with its empty or doubtful slots taken from the other."""
    out = dict(row)
    if other["company"] and not fragment(other["company"]) and (not row["company"] or fragment(row["company"])):
        out["company"] = other["company"][:200]
    stronger = other["role"] and (not row["role"] or (swapped(row) and (_TITLE.search(other["role"]) or not swapped(other))))
    if stronger and (_TITLE.search(other["role"]) or len(other["role"].split()) <= 8):
        out["role"] = other["role"][:200]
    out["start"] = row["start"] or other["start"]
    if not row["end"] and not row["current"]:
        out["end"] = other["end"]
    alike = lambda x: not row[x] or not other[x] or row[x].lower() == other[x].lower()
    if other["current"] and not row["current"] and alike("company") and alike("start"):
        out["current"], out["end"] = True, row["end"]
    out["description"] = row["description"] or other["description"][:2000]
    return out


def _step(state: tuple[list, list], row: tuple) -> tuple[tuple[list, list], tuple]:
    incoming, out = state
    phase, *values = row
    here = dict(zip(SLOTS, values, strict=True))
    keep = phase == 1
    if phase == 0:
        incoming.append(here)
    elif phase == 1:
        other = next((x for x in incoming if same_job(here, x)), None)
        here = filled(here, other) if other else here
        out.append(("held", here))
    else:
        held = any(kind == "held" for kind, _ in out)
        keep = anchored(here) and not swapped(here) and (not held or (not fragment(here["company"]) and not any(same_job(x, here) for _, x in out)))
        if keep:
            out.append(("added", here))
    return (incoming, out), (keep, *[here[s] for s in SLOTS])


def merge_fields(existing: DataFrame, incoming: DataFrame, id: str) -> DataFrame:
    """(id, added, no, role, company, start, end, current, description): each existing row with its empty slots filled from the first incoming row of
    the same job, then the incoming rows that are no job there is, if they name one.

    Both have (id, no, role, company, start, end, current, description) and are taken in the order of ``no``; null texts are empty. A fold over an id's rows, which are
    held together: as many as a résumé has jobs. An id with no existing row keeps its incoming ones that name a job.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    plain = lambda rows, phase: rows.select(id, F.lit(phase).alias("phase"), F.col("no").cast("bigint").alias("no"), *[F.coalesce(c, F.lit(False)).alias(c) if c == "current" else text(c) for c in SLOTS])
    rows = plain(incoming, 0).unionByName(plain(existing, 1)).unionByName(plain(incoming, 2))
    gives = ", ".join(["keep boolean", *[f"{c}_ {'boolean' if c == 'current' else 'string'}" for c in SLOTS]])
    merged = ordered_fold(rows, [id], ["phase", "no"], gives, lambda: ([], []), _step, ["phase", *SLOTS])
    return merged.where("keep").select(id, (F.col("phase") == 2).alias("added"), "no", *[F.col(f"{c}_").alias(c) for c in SLOTS])
