"""Measures against plain Python, sketches, limits, and the whole query against SQL."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from harrow.llm import quality_rules as q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if windows[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def prose(i, n=80):
    return " ".join(f"w{(i * 31 + k * k * 7) % 997}{'.' if k % 9 == 8 else ''}" for k in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, lang_ string, m int")


def test_measures(spark, odd_documents):
    got = q.rule_verdicts(odd_documents).collect()
    want = Counter((r["doc_id"], *plain(r["text"])) for r in odd_documents.collect())
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_lines_and_windows(spark):
    texts = ["a b\na b\n\n \na b \n", "x y z x y z", "x y z\tq x y z", "\n\n", "a b a b a", "\ré à\r\né à\r\n", "one two"]
    rows = frame(spark, [(i, t, "en", "s", "", 0) for i, t in enumerate(texts)])
    assert {r["doc_id"]: tuple(r)[1:6] for r in q.rule_verdicts(rows).collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_junk_goes_by_its_source(spark):
    """Symbols are usual in one source and junk in another."""
    noisy = lambda i: " ".join(f"w{(i * 31 + k * k * 7) % 997}{'|' if k % 2 else ''}" for k in range(80))
    rows = [(i, prose(i), "en", "prose", "", 0) for i in range(300)] + [(1000 + i, noisy(i), "en", "tables", "", 0) for i in range(300)]
    rows += [(5000, noisy(5), "en", "prose", "", 0), (5001, noisy(6), "en", "tables", "", 0), (5002, prose(7).upper(), "en", "prose", "", 0), (5003, prose(8), None, None, "", 0)]
    kept = {r["doc_id"]: r["kept"] for r in q.rule_verdicts(frame(spark, rows)).collect()}
    assert [kept.pop(i) for i in (5000, 5001, 5002, 5003)] == [False, True, False, True]
    assert all(kept.values())


def test_sketches_merge_and_come_near(spark):
    values = spark.range(5000).select((F.col("id") * F.col("id") % 70_001).alias("value"))
    sketch = values.groupBy(F.lit("x").alias("share"), q.bucket(F.col("value")).alias("bucket"), (F.col("value") % 3).alias("part")).agg(F.count("*").alias("n"))
    whole = q.quartiles(q.merge(sketch)).collect()[0]
    every = sorted(r["value"] for r in values.collect())
    assert whole["total"] == 5000
    for got, want in ((whole["low"], every[1249]), (whole["mid"], every[2499])):
        assert want * (1 - 1 / 32) - 1 <= got <= want
    assert q.quartiles(sketch.drop("part")).count() == 1


def test_many_groups_are_salted(spark, odd_documents, monkeypatch):
    rows = frame(spark, [(i, prose(i), "en", f"s{i % 7}", "", 0) for i in range(100)])
    want = sorted(map(tuple, q.rule_verdicts(rows).collect()))
    monkeypatch.setattr(q, "BROADCAST_GROUPS", 3)
    assert sorted(map(tuple, q.rule_verdicts(rows).collect())) == want


def test_kept_documents_keep_their_columns(spark, odd_documents, no_documents):
    rows = frame(spark, [(i, prose(i), "en", "s", "clash", 7) for i in range(30)] + [(99, None, None, None, None, None), (98, "short", "en", "s", "", 1)])
    kept = q.keep_documents(rows)
    assert kept.columns == rows.columns and kept.schema == rows.schema
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.where("doc_id < 90").collect()))
    assert q.keep_documents(odd_documents).columns == odd_documents.columns
    assert q.keep_documents(no_documents).count() == 0 and q.rule_verdicts(no_documents).count() == 0


@pytest.mark.parametrize("table", ["tiny", "small"])
def test_table_against_sql(spark, request, table):
    d = request.getfixturevalue(table)
    got = q.rule_verdicts(spark.read.parquet(f"{d}/documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet')")
    cursor = con.execute(q.ORACLE_SQL)
    assert [c[0] for c in cursor.description] == got.columns
    assert Counter(map(tuple, got.collect())) == Counter(cursor.fetchall())


def test_labelled_documents(spark, small):
    """Documents labelled good pass the adaptive limits if they pass the base rules; few of the bad ones do."""
    rows = q.rule_verdicts(spark.read.parquet(f"{small}/documents.parquet")).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in rows}
    assert share[1] > 0.995 and share[0] < 0.05
