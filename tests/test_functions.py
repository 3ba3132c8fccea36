"""Nulls, empty values and ties, which the driver's tables don't hold."""

from pyspark.sql import functions as F

from harrow.functions import text as t
from harrow.operators import relational as op


def one(spark, column, **values):
    kinds = {str: "string", int: "long", type(None): "string", list: "array<string>"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_clean(spark):
    assert one(spark, t.clean(F.col("a")), a="  x \t\r\ny\r\r\r\rz  w\n\n") == "x\ny\n\nz w"
    assert one(spark, t.clean(F.col("a")), a=None) is None and one(spark, t.clean(F.col("a")), a="") == ""


def test_shares_and_hints(spark):
    assert one(spark, t.blank_share(F.col("a")), a="") == 10000 and one(spark, t.blank_share(F.col("a")), a="a b ") == 5000
    assert one(spark, t.language_hint(F.col("a")), a="too short") is None
    assert one(spark, t.language_hint(F.col("a")), a="one two three four five six seven eight nine ten") == "en"
    assert one(spark, t.language_hint(F.col("a")), a="ééé aaa") == "non_en"


def test_tokens(spark):
    assert sorted(one(spark, t.tokens(F.col("a")), a="C++ and C#, a 7 Java/java")) == ["7", "and", "c#", "c++", "java"]
    f1 = t.token_f1(F.col("a"), F.col("b"))
    assert one(spark, f1, a=[], b=[]) == 1 and one(spark, f1, a=["x"], b=[]) == 0 and one(spark, f1, a=["x", "y"], b=["y"]) == 2 / 3
    hold = t.holds_token(F.col("a"), F.col("b"))
    assert not one(spark, hold, a="I know JavaScript", b="java") and one(spark, hold, a="I know Java.", b="java")


def test_redaction(spark):
    got = one(spark, t.redact(F.col("a")), a="mail a.b@c.org, password: hunter2 Bearer abc.def call +49 30 1234567")
    assert got == "mail [EMAIL], [REDACTED] Bearer [REDACTED] call [PHONE]"


def test_latest_and_duplicates(spark):
    rows = spark.createDataFrame([(1, "a", 3), (2, "a", 3), (3, "b", None), (4, None, 1), (5, None, 1)], "id long, k string, v long")
    got = op.latest_per_key(rows, ["k"], [F.desc_nulls_last("v"), F.desc("id")]).collect()
    assert sorted((r.k or "", r.id) for r in got) == [("", 5), ("a", 2), ("b", 3)]
    marked = {r.id: r.duplicate_of for r in op.mark_duplicates(rows, "k", "id").collect()}
    assert marked == {1: None, 2: 1, 3: None, 4: None, 5: None}


def test_visible_text(spark):
    from harrow.sources import html

    pages = {
        "<head>x</head><p>a &amp; b&#8364;&#x41;</p><table><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></table>": "a & b€A\n\n1 | 2\n\n3", "<p>caf&eacute; &nosuch; &amp;lt; &copy 1&nbsp;2</p>": "café &nosuch; &lt; © 1 2",
        "one\ntwo<br>three<script>x</script><!-- y --><b>!</b>": "one two\nthree!", "": "", "&#0; &#55555555; &#xD800;": "&#0; &#55555555; &#xD800;",
    }
    got = spark.createDataFrame([(x,) for x in pages], "a string").select(html.visible(F.col("a")).alias("x")).collect()
    assert [r.x for r in got] == list(pages.values())
