"""Rules on nested output records, by dotted path.

A table of rules becomes one column: JSON is parsed once as VARIANT, each rule reads its path. Missing parents, nulls and arrays in a path's way
leave a value missing, and rules other than ``required`` don't apply to it. A text that isn't JSON breaks the rule ``json`` alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for an open date; forms of dates, years and months.
OPEN_DATES = ("present", "current", "now")
DATE_FORMS = "^(?:[0-9]{4}|[0-9]{4}-(?:0?[1-9]|1[0-2])|[0-9]{4}-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12][0-9]|3[01]))$"


@dataclass(frozen=True)
class Rule:
    """kind: required, enum, regex, length, items, date, confidence. ``path`` may name the items of a list: ``items`` takes ``tags[]``, ``date`` takes ``jobs[].start``.

    ``least`` and ``most`` are lengths, counts or the least confidence; ``allowed`` is an enum's values; ``pattern`` is matched from the text's begin.
    """

    kind: str
    path: str
    allowed: tuple[str, ...] = ()
    pattern: str = ""
    least: float | None = None
    most: float | None = None


def _kind(doc: Column, path: str) -> Column:
    """The type at a path: STRING, BIGINT, DECIMAL(…), DOUBLE, BOOLEAN, ARRAY<…>, OBJECT<…>, VOID for null; null if nothing is there."""
    return F.schema_of_variant(F.try_variant_get(doc, "$." + path, "variant"))


def _text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, "$." + path, "string")


def broken(doc: Column, rule: Rule) -> Column:
    """Names of how a rule is broken: an array, empty if it isn't."""
    names = lambda *found: F.array_compact(F.array(*found))
    path, given = rule.path, _text(doc, rule.path)
    if rule.kind == "required":
        return names(F.when(F.try_variant_get(doc, "$." + path, "variant").isNull(), f"missing:{path}"))
    if rule.kind == "enum":
        kind = _kind(doc, path)
        return names(F.when(kind.isNotNull() & (kind != "VOID") & ~((kind == "STRING") & given.isin(*rule.allowed)), f"enum:{path}"))
    if rule.kind == "regex":
        return names(F.when(given.isNotNull() & (given != "") & ~given.rlike(f"\\A(?:{rule.pattern})"), f"regex:{path}"))
    if rule.kind == "length":
        text = F.when(_kind(doc, path) == "STRING", given)
        return names(*[F.when(F.length(text) < rule.least, f"length:{path}:min")] * (rule.least is not None), *[F.when(F.length(text) > rule.most, f"length:{path}:max")] * (rule.most is not None))
    if rule.kind == "items":
        n = F.size(F.try_variant_get(doc, "$." + path.removesuffix("[]"), "array<variant>"))
        n = F.when(_kind(doc, path.removesuffix("[]")).startswith("ARRAY"), n)
        return names(*[F.when(n < rule.least, f"length:{path}:min_items")] * (rule.least is not None), *[F.when(n > rule.most, f"length:{path}:max_items")] * (rule.most is not None))
    if rule.kind == "date":
        wrong = lambda x: x.isNotNull() & (x != "") & ~F.lower(x).isin(*OPEN_DATES) & ~x.rlike(DATE_FORMS)
        if "[]." not in path:
            return names(F.when(wrong(given), f"date:{path}"))
        base, leaf = path.split("[].", 1)
        items = F.try_variant_get(doc, "$." + base, "array<variant>")
        values = F.transform(items, lambda e: F.try_variant_get(e, "$." + leaf, "string"))
        return F.coalesce(F.transform(F.filter(values, wrong), lambda x: F.lit(f"date:{path}")), F.array().cast("array<string>"))
    if rule.kind == "confidence":
        number = F.when(_kind(doc, path).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(doc, "$." + path, "double"))
        return names(F.when(number < rule.least, f"confidence:{path}<{rule.least:g}"))
    raise ValueError(f"unknown rule: {rule.kind}")


def violations(json: Column, rules: list[Rule]) -> Column:
    """The names of all broken rules of a JSON text, in the rules' order; a date rule over a list names each wrong item."""
    doc = F.try_parse_json(json)
    found = lambda d: F.flatten(F.array(*[broken(d, r) for r in rules]))
    return F.when(json.isNull() | doc.isNull(), F.array(F.lit("json"))).otherwise(found(doc))
