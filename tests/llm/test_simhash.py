"""Fingerprints and components against a brute-force version."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from harrow.llm import common, simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def reachable(prints):
    """prints: list of (id, fp). The smallest id that each one reaches."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), k), k)
    return [least[root(i)] for i in range(len(prints))]


def test_documents(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 2)  # many hot fingerprints
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, fingerprint(r.text)) for r in rows]
    want = sorted((k, f"{fp:016x}", c) for (k, fp), c in zip(prints, reachable(prints), strict=True))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_links_of_any_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)  # many blocks for a bucket
    rng = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(8):
            prints.add(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    prints |= {0xABCDE00000000000 | rng.getrandbits(20) for _ in range(150)}  # one hot bucket
    rows = sorted(prints)
    signed = [int(np.uint64(x).view(np.int64)) for x in rows]
    found = common.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint")))
    got = {r.node: r.component for r in found.collect()}
    want = dict(zip(signed, reachable(list(zip(signed, rows, strict=True))), strict=True))
    assert {x: got.get(x, x) for x in signed} == want


def test_buckets_are_not_broadcast(spark):
    """35 rows come of each fingerprint, and Spark sizes them as one: few fingerprints pass for a small table."""
    plan = simhash.links(spark.range(1000).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_odd_documents(odd_documents, no_documents):
    got = simhash.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    blank = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in blank} == {None, 0, 1, 2, 3} and {r.component_id for r in blank} == {0}
    assert simhash.near_duplicates(no_documents).count() == 0
    clash = odd_documents.withColumn("_kept", F.lit(1)).withColumn("kept", F.lit(2))
    assert simhash.one_per_group(clash).select("_kept", "kept").distinct().collect() == [(1, 2)]
    kept = simhash.one_per_group(odd_documents)
    assert kept.columns == odd_documents.columns
    assert {0, 5}.issubset({r.doc_id for r in kept.collect()}) and kept.where("doc_id = 1").count() == 0
    assert kept.where(F.col("doc_id").isNull()).count() == 2


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(500)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    linked = {x for e in edges for x in e if e[0] != e[1]}
    assert {x: root(x) for x in linked} == {x: got.get(x, x) for x in linked}


def test_a_task_takes_in_few_texts_at_a_time(monkeypatch):
    """However large a batch is, about 1 MB of its texts is fingerprinted at a time, in order."""
    sizes, runs = [], []

    def counted(buffer, offsets):
        sizes.append(len(buffer))
        return np.arange(len(offsets) - 1, dtype=np.uint64)

    monkeypatch.setattr(simhash, "fingerprints_of", counted)
    table = SimpleNamespace(schema={"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}, mapInArrow=lambda run, _: runs.append(run))
    table.select = lambda *_: table
    simhash.fingerprints(table)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(4000)), "text": pa.array(["some words of a text, " * 50] * 4000)})
    got = [k for part in runs[0](iter([batch])) for k in part.column(0).to_pylist()]
    assert got == list(range(4000)) and sum(sizes) == 4000 * 1100 and max(sizes) <= 1 << 20
