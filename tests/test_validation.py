"""Rules by dotted path on small records."""

import pytest
from pyspark.sql import functions as F

from harrow.operators.validation import Rule, violations

RULES = [
    Rule("required", "a"), Rule("enum", "a.kind", allowed=("x", "y")), Rule("regex", "a.code", pattern="[A-Z]+"), Rule("length", "name", least=2, most=4), Rule("items", "tags[]", least=1, most=2),
    Rule("date", "jobs[].start"), Rule("date", "end"), Rule("confidence", "confidence", least=0.5),
]
CASES = {
    '{"a": {"kind": "x", "code": "Ab"}, "name": "abc", "tags": ["t"], "jobs": [{"start": "2020-01"}], "end": "Now", "confidence": 0.5}': [],
    "{}": ["missing:a"], '{"a": null}': [], '{"a": 1}': [], '{"a": [{"kind": "z"}]}': [], '{"a": {"kind": null, "code": ""}}': [],
    '{"a": {"kind": 1, "code": "9"}}': ["enum:a.kind", "regex:a.code"], '{"a": 1, "name": "x"}': ["length:name:min"], '{"a": 1, "name": "toolong"}': ["length:name:max"], '{"a": 1, "name": 5}': [],
    '{"a": 1, "tags": []}': ["length:tags[]:min_items"], '{"a": 1, "tags": [1, 2, 3]}': ["length:tags[]:max_items"], '{"a": 1, "tags": "no list"}': [],
    '{"a": 1, "jobs": [{"start": "x"}, {"start": "2020-13"}, {}, 5, {"start": null}]}': ["date:jobs[].start"] * 2, '{"a": 1, "jobs": {"start": "x"}}': [], '{"a": 1, "end": "2020-02-31x"}': ["date:end"],
    '{"a": 1, "confidence": 0.4}': ["confidence:confidence<0.5"], '{"a": 1, "confidence": 0}': ["confidence:confidence<0.5"], '{"a": 1, "confidence": "low"}': [], '{"a": 1': ["json"], "": ["json"], None: ["json"],
}


def test_records(spark):
    got = spark.createDataFrame([(c,) for c in CASES], "doc string").select(violations(F.col("doc"), RULES).alias("v")).collect()
    assert [r.v for r in got] == list(CASES.values())


def test_unknown_rule(spark):
    with pytest.raises(ValueError, match="unknown rule"):
        violations(F.lit("{}"), [Rule("odd", "a")])
