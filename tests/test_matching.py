"""Matches against loops over all pairs."""

import difflib
import random

from pyspark.sql import functions as F

from harrow.operators import matching as op

WORDS = ["java", "javascript", "sql", "my sql", "postgresql", "postgressql", "spark", "apache spark", "spark streaming", "go", "golang", "kubernetes", "kubernets", "c#", "excel", "ms excel", "data science", "science of data"]


def like(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def matches(x, others):
    for y in others:
        a, b = set(x.split()), set(y.split())
        if x == y or x in y or y in x or a <= b or b <= a or (len(x) > 5 and like(x, y) >= 0.9):
            return True
    return False


def test_skills(spark):
    from harrow.functions import values as v

    rng = random.Random(3)
    rows = [(i, ", ".join(rng.sample(WORDS, rng.randint(0, 7))), "; ".join(rng.sample(WORDS, rng.randint(0, 7)))) for i in range(80)]
    rows += [(100, None, None), (101, "TECHNICAL SKILLS", "sql"), (102, "Python, Django, PostgreSQL, Redis", "Python, Django, Kafka"), (103, "sql", "TECHNICAL SKILLS, sql")]
    frame = spark.createDataFrame(rows, "id long, g string, f string")
    keys = {r.id: (r.a, r.b) for r in frame.select("id", v.split_skills(F.col("g"), True).alias("a"), v.split_skills(F.col("f")).alias("b")).collect()}
    for r in op.skill_scores(frame, "id", "g", "f").collect():
        g, f = keys[r.id]
        missed, extra = ([x for x in g if not matches(x, f)], [x for x in f if not matches(x, g)]) if g and f else (g, f)
        recall, precision = (1 - len(missed) / len(g), 1 - len(extra) / len(f)) if g and f else (float(not g and not f),) * 2
        f1 = 2 * recall * precision / (recall + precision) if recall + precision else 0.0
        assert (r.missed, r.extra) == (missed, extra)
        assert abs(r.precision - precision) + abs(r.recall - recall) + abs(r.f1 - f1) < 1e-12 and r.score == (r.f1 if g else 1.0)
    told = {r.id: r for r in op.skill_scores(frame, "id", "g", "f").where("id > 100").collect()}
    assert 0.3 < told[102].score < 0.9 and told[102].missed == ["postgresql", "redis"] and told[102].extra == ["kafka"]
    assert told[103].extra == ["technical skills"] and told[101].score == 1.0


def test_sections(spark):
    """Facts count, not rows: an entry split over two rows still scores well; rows from another section don't."""
    gold = [(i, 1, ["bachelor of science (information technology)", "hill college, mumbai"], ["2011", "2014"]) for i in (1, 2, 3)] + [(i, 2, ["high school programs", "st. johns college"], ["2009"]) for i in (1, 2, 3)] + [(4, 1, [], [])]
    row = lambda id, k, strings, years: (id, k, strings, " ".join(strings), years)
    found = [row(1, 1, ["bachelor of science (information technology)"], ["2011", "2014"]), row(1, 2, ["hill college, mumbai"], []), row(1, 3, ["high school programs", "st. johns colege"], ["2009"])]
    found += [row(2, 1, ["senior associate attorney"], []), row(2, 2, ["radius global solutions"], []), row(2, 3, [], []), row(4, 1, ["x y z"], [])]
    got = {r.id: r for r in op.section_scores(spark.createDataFrame(gold, "id long, entry int, facts array<string>, years array<string>"), spark.createDataFrame(found, "id long, entry int, strings array<string>, text string, years array<string>"), "id").collect()}
    assert got[1].recall == got[1].precision == got[1].date_recall == 1.0 and got[1].score > 0.99 and got[1].tags == []
    assert got[2].recall == 0 and got[2].precision == 0 and "spurious_rows" in got[2].tags
    assert got[3].score == 0 and got[3].tags == ["not_extracted"] and got[4].score == 0


def test_phrases(spark):
    texts = [(1, "I know Java, and Machine Learning; C++."), (2, "JavaScript only, machine"), (3, ""), (4, None), (5, "machine-learning with a very long name of a thing java")]
    phrases = [("java",), ("machine learning",), ("c++",), ("very long name of a thing",), ("",), ("Java",)]
    got = op.phrase_hits(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "phrase string"), "id", 6).collect()
    assert sorted(map(tuple, got)) == [(1, "Java"), (1, "c++"), (1, "java"), (1, "machine learning"), (5, "Java"), (5, "java"), (5, "machine learning"), (5, "very long name of a thing")]


def test_containment(spark):
    rng = random.Random(5)
    make = lambda n: ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 6))) for _ in range(n)]
    left, right = make(60), make(40)
    frames = spark.createDataFrame(list(enumerate(left)), "i long, a string"), spark.createDataFrame(list(enumerate(right)), "j long, b string")
    pairs = op.contained(*frames)
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()
    want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a and b and (a in b or b in a))
    assert sorted((r.i, r.j) for r in pairs.collect()) == want


def test_matches_are_not_broadcast(spark, tiny):
    """Short rows compress to little, and what comes out of them doesn't fit a driver."""
    import re

    from harrow.plans import registry

    for name in ("DM16_skills", "DM16_likeness", "DM16_sections", "DM16_field_scores"):
        plan = registry.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"BroadcastHashJoin \[[^\]]*\]", plan)
        assert all("key#" in join for join in joins), (name, joins)  # only the table of heading names


def test_facts(spark):
    """Facts told word for word, within others, by tokens and by likeness, against a loop; cases apart."""
    rng = random.Random(11)
    names = ["data analyst", "test lead", "acme labs", "acme lab", "river 12", "grey ltd", "hill college", "hill colege", "analyst, data", "x", "acme o labs pune", ""]
    rows = [[(i, rng.choice(names)) for i in range(30) for _ in range(6)] for _ in range(2)]
    got = op.fact_hits(spark.createDataFrame(rows[0], "id long, a string"), spark.createDataFrame(rows[1], "id long, b string"), "id").collect()

    def tokens(x):
        return {w for w in x.replace(",", " ").split() if len(w) > 1}

    def states(a, b):
        x, y = tokens(a), tokens(b)
        f1 = 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))
        return a == b or (len(a) >= 6 and (a in b or b in a)) or f1 >= 0.85 or like(a, b) >= 0.85

    assert sorted(map(tuple, got)) == sorted({(i, a) for i, a in rows[0] for j, b in rows[1] if i == j and a and b and states(a, b)})


def test_each_side_is_read_once(spark, tiny):
    """Résumés and gold jobs, customers' values and parts: five readings, however many fields are scored; no pair of texts is a row."""
    from harrow.plans import registry

    plan = registry.queries()["DM16_field_scores"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 5, plan
    scores = registry.queries()["DM16_skills"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in scores and "Generate" not in scores
