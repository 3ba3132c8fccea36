"""The corpus pipeline, stage by stage, against versions without Spark."""

from test_line_dedup import brute as brute_lines
from test_packing import ids_of, whole
from test_simhash import fingerprint, reachable

import corpus_pipeline
from harrow.llm import common, quality


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "packing"]
    good, lines, near, packed = (stage for _, stage in corpus_pipeline.STAGES)
    kept = common.settle(good(spark, docs, tiny), "t")
    weights = quality.train(docs, spark.read.parquet(f"{tiny}/labels.parquet"), quality.F.lit(True))
    want = {r.doc_id for r in quality.score(docs, weights).where("score >= 0.5").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and len(want) > 100
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    clean = common.settle(lines(spark, kept, tiny), "t")
    assert clean.schema == docs.schema or clean.dtypes == docs.dtypes
    assert {r.doc_id: r.text for r in clean.collect()} == brute_lines(rows)
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    prints = [(r.doc_id, fingerprint(r.text)) for r in clean.collect()]
    one = common.settle(near(spark, clean, tiny), "t")
    assert one.dtypes == docs.dtypes and {r.doc_id for r in one.collect()} == set(reachable(prints))
    final = packed(spark, one, tiny).collect()
    whole(final, [(r.doc_id, r.text) for r in one.collect()])
    assert sum(r.length for r in final) == sum(len(ids_of(r.text)) for r in one.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, tiny).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in final)


def test_odd_documents(spark, tiny, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        out = docs
        for _, stage in corpus_pipeline.STAGES:
            out = common.settle(stage(spark, out, tiny), "t")
        assert set(out.columns) >= {"doc_id", "sequence_id", "offset"}
