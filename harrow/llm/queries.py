"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, context_tree, html_extract, line_dedup, media, neighbours, packing, pieces, quality, quality_rules, runs, simhash, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": lambda s, d: line_dedup.line_digests(table(s, d, "documents")),
        "op2_sentencepiece": lambda s, d: pieces.encode_documents(table(s, d, "documents")),
        "op3_context_tree": lambda s, d: context_tree.score(table(s, d, "documents"), quality.remainder(10) == 0),
        "op4_packing": lambda s, d: packing.pack(table(s, d, "documents")),
        "op5_nearest": lambda s, d: neighbours.nearest(table(s, d, "embeddings"), F.col("vec_id") % 100 == 0),
        "op6_quality": lambda s, d: quality.quality_scores(table(s, d, "documents"), table(s, d, "labels")),
        "op7_simhash": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
        "op8_html": lambda s, d: html_extract.main_text(table(s, d, "pages")),
        "op9_media": lambda s, d: media.media_digests(table(s, d, "documents")),
        "op10_url_filter": lambda s, d: url_filter.filter_pages(table(s, d, "pages")),
        "op11_centroids": lambda s, d: centroids.cluster_vectors(table(s, d, "embeddings")),
        "op12_quality_rules": lambda s, d: quality_rules.rule_verdicts(table(s, d, "documents")),
        "op13_runs": lambda s, d: runs.run_digests(table(s, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op10_url_filter": url_filter.ORACLE_SQL, "op11_centroids": centroids.ORACLE_SQL, "op12_quality_rules": quality_rules.ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
