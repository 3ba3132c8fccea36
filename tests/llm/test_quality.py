"""The classifier: held-out accuracy, repeatability, what it may not look at."""

import math
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from harrow.llm import quality


def test_held_out_accuracy(spark, small):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.quality_scores(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").toPandas()
    good, bad = rows[rows["quality"] == 1]["score"], rows[rows["quality"] == 0]["score"]
    area = sum((g > bad).mean() + (g == bad).mean() / 2 for g in good) / len(good)
    assert area > 0.9
    assert ((good >= 0.5).mean() + (bad < 0.5).mean()) / 2 > 0.85


def test_labels_of_held_out_rows_do_not_matter(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.remainder(3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.quality_scores(docs, labels).collect())) == sorted(map(tuple, quality.quality_scores(docs, turned).collect()))


def test_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (7, 0, 0), (0, 0, 1), (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.quality_scores(odd_documents, labels).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2, 3)}) == 1
    assert quality.quality_scores(no_documents, labels).count() == 0
    assert {r.score for r in quality.quality_scores(odd_documents, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(odd_documents, labels)
    assert kept.columns == odd_documents.columns


def plain_ftrl(rows, epochs):
    """FTRL-proximal, coordinate by coordinate. rows: ({place: value}, label)."""
    z, n, a, b, l1, l2 = {}, {}, quality.ALPHA, quality.BETA, quality.L1, quality.L2
    ones = sum(y for _, y in rows)

    def weight(i):
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((b + math.sqrt(n[i])) / a + l2)

    for _ in range(epochs):
        for x, y in rows:
            x = {**x, 1 << quality.BITS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (len(rows) / 2 / (ones if y else len(rows) - ones)) * (p - y) * v
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / a * w[i]
    return {i: weight(i) for i in z if weight(i)}


def test_updates_against_plain_ones():
    rng = random.Random(2)
    rows = [({rng.randrange(40) * 1000: rng.uniform(0.1, 3) for _ in range(rng.randrange(1, 9))}, rng.randrange(2)) for _ in range(120)]
    got = quality.ftrl([np.array(list(x), np.int32) for x, _ in rows], [np.array(list(x.values())) for x, _ in rows], np.array([y for _, y in rows]), 3)
    want = plain_ftrl(rows, 3)
    assert set(np.flatnonzero(got)) == set(want)
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items())


def test_columns_of_any_name_stay(spark, tiny):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([(1, "good words here", 0.25, 0.5), (2, "bad bad bad", 0.25, 0.5), (3, "good words too", 0.25, 0.5), (1, "good words here", 0.25, 0.5)], "doc_id bigint, text string, _score double, score double")
    kept = quality.keep_good(docs, labels, 0.0)
    assert kept.columns == docs.columns and {(r._score, r.score) for r in kept.collect()} == {(0.25, 0.5)} and kept.count() == 4


def test_a_task_takes_in_few_texts_at_a_time():
    """What a task holds while it scores or prepares a large batch doesn't grow with the batch."""
    texts = pa.array(["some words of a text, and more words of it " * 50] * 6000)
    ones = pa.array(np.ones(len(texts), np.int64))
    runs = []
    table = SimpleNamespace(columns=["doc_id", "text"], schema=SimpleNamespace(simpleString=lambda: "struct<doc_id:bigint,text:string>"), mapInArrow=lambda run, _: runs.append(run))
    table.drop, table.sparkSession = lambda _: table, SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda w: SimpleNamespace(value=w)))
    quality.score(table, np.ones(1 + (1 << quality.BITS), np.float32))
    quality._featurise(table)
    for run, columns in zip(runs, ({"doc_id": ones, "text": texts}, {"order": ones, "label": ones, "text": texts}), strict=True):
        batch = pa.RecordBatch.from_pydict(columns)
        tracemalloc.start()
        rows = sum(part.num_rows for part in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == len(texts) and peak < 100e6, peak
