"""The text form: random nested records there and back, its exact lines, and texts that are no records."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import toon

SCHEMA = (
    "id long, name string, ok boolean, score double, home struct<city: string, at: struct<zip: string, n: int>>, tags array<string>, nums array<int>, jobs array<struct<role: string, years: int, on: boolean>>, parts array<struct<name: string, tags: array<string>, rows: array<struct<k: string>>>>, grid array<array<int>>"
)
TEXTS = ["plain", "", " edge ", "a,b", "a|b", 'say "x"', '"all"', "two\nlines", "back\\slash", "\\n", "2012", "+91", "1.5", "true", "null", "é: ü", "x: y", "{a}", "[3]", "comma, \"q\" \\ end", "#toon/v2"]


def parsed(kind):
    return T.StructType.fromDDL(kind)


def record(rng):
    text = lambda: rng.choice(TEXTS)
    maybe = lambda x: None if rng.random() < 0.2 else x
    some = lambda make, least=0: [make() for _ in range(rng.randint(least, 3))]
    part = lambda: (text(), maybe(some(text)), some(lambda: (text(),)))
    return (
        maybe(rng.randint(-9, 10**12)), maybe(text()), maybe(rng.random() < 0.5), maybe(rng.randint(0, 1000) / 8), (maybe(text()), (maybe(text()), maybe(rng.randint(0, 9)))), maybe(some(text)), maybe(some(lambda: rng.randint(-5, 5))),
        maybe(some(lambda: (text(), maybe(rng.randint(0, 50)), maybe(rng.random() < 0.5)))), maybe(some(part)), maybe(some(lambda: some(lambda: rng.randint(0, 9), 1))),
    )


def test_round_trip(spark):
    rng, kind = random.Random(9), parsed(SCHEMA)
    rows = [record(rng) for _ in range(300)]
    frame = spark.createDataFrame([(r,) for r in rows], T.StructType([T.StructField("r", kind)]))
    got = frame.select("r", toon.decode(toon.encode(F.col("r"), kind), kind).alias("back")).collect()
    for r in got:
        assert r.back == r.r


def test_lines(spark):
    kind = parsed("a string, s struct<n: int, t: string>, l array<string>, e array<int>, t array<struct<x: string, y: string>>, d array<struct<x: string, z: array<int>>>")
    row = ("2012", (3, None), ["one", "a|b"], [], [("p, q", ""), ("null", "z")], [("u", [1, 2])])
    text = spark.createDataFrame([(row,)], T.StructType([T.StructField("r", kind)])).select(toon.encode(F.col("r"), kind).alias("x")).first().x
    assert text.split("\n") == ["#toon/v2", 'a: "2012"', "s.n: 3", 'l[2]: one|"a|b"', "e[0]:", "t[2]{x,y}:", '  "p, q",', '  "null",z', "d.0.x: u", "d.0.z[2]: 1|2"]


def test_odd_texts(spark):
    kind = parsed("a int, b string, t array<struct<x: string, y: int>>")
    texts = [None, "", "no colon", "a: x\nb: ok", "```toon\na: 7\n```", "t[2]{x,y}:\n  one,1\n  only one\n  two,zz\nb: after", "a: 1\na: 2", "t[1]{y,x}:\n  5,five", "b: null", "  a: 3"]
    got = [r.x for r in spark.createDataFrame([(x,) for x in texts], "x string").select(toon.decode(F.col("x"), kind).alias("x")).collect()]
    want = [(None, None, None)] * 3 + [(None, "ok", None), (7, None, None), (None, "after", [("one", 1), ("two", None)]), (2, None, None), (None, None, [("five", 5)]), (None, None, None), (None, None, None)]
    assert [(r.a, r.b, r.t and [tuple(x) for x in r.t]) for r in got] == want
