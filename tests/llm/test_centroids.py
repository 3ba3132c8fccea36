"""Clustering against plain rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from harrow.llm import centroids


def plain(rows, k, rounds, dims, scale=64, seed=1):
    """(vec_id, cluster, distance, cluster inertia, inertia, centroid hash) by all distances."""
    kept = [(i, [min(centroids.MOST, max(-centroids.MOST, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for r in range(rounds + 1):
        where = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]
        if r < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, c) in zip(kept, where, strict=True) if c == j]
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else centres[j]
    of = lambda j: sum(d for d, c in where if c == j)
    return sorted(((i, c, d, of(c), sum(d for d, _ in where), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, where, strict=True)), key=str)


def run(spark, rows, **how):
    frame = spark.createDataFrame([(i, v, "x", i) for i, v in rows], "vec_id bigint, embedding array<float>, cluster string, v bigint")
    return sorted(map(tuple, centroids.cluster_vectors(frame, **how).collect()), key=str)


def test_random_vectors_with_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 4, 4) / 64 + 1e-4).tolist()) for i in range(300)]
    want = plain([(i, np.float32(v).tolist()) for i, v in rows], 7, 3, 4)
    assert run(spark, rows, k=7, rounds=3, dims=4, groups=3) == want
    assert run(spark, rows, k=7, rounds=3, dims=4, groups=1) == want


def test_odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, np.float32(rng.normal(size=3)).tolist()) for i in range(40)]
    rows += [(None, [0.5, 0.5, 0.5]), (1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, [1e30, -1e30, 0.0]), (8, [0.0, 0.0, 0.0]), (8, [0.0, 0.0, 0.0]), (9, [3e5, 0.0, -3e5])]
    for k in (1, 5, 60):
        assert run(spark, rows, k=k, rounds=2, dims=3) == plain(rows, k, 2, 3)


def test_nothing(spark):
    assert run(spark, [], k=3, rounds=2, dims=3) == []
    assert run(spark, [(1, [1.0])], k=3, rounds=2, dims=3) == []


@pytest.mark.parametrize("rounds", [0, 1])
def test_few_rounds(spark, rounds):
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(30)]
    assert run(spark, rows, k=4, rounds=rounds, dims=2) == plain(rows, 4, rounds, 2)


def test_filters_skip_and_agree():
    """On clustered vectors, later rounds compute a small part of the distances and find the same."""
    rng = np.random.default_rng(7)
    heads = rng.integers(-2000, 2000, (24, 16))
    x = np.concatenate([h + rng.integers(-90, 90, (200, 16)) for h in heads]).astype(np.int64)
    centres = x[rng.choice(len(x), 24, replace=False)]
    group = centroids.grouped(centres, 6)
    scan = centroids.Scan(centres, group)
    cluster, near, upper, lower = scan.first(x)
    spent = []
    for _ in range(6):
        moved = np.array([x[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centres[c] for c in range(24)])
        drift = np.sqrt(((moved - centres) ** 2).sum(1)) * (1 + centroids.SLACK)
        centres = moved
        scan = centroids.Scan(centres, group, drift)
        cluster, near, upper, lower = scan.again(x, cluster, near, upper, lower, exact=False)
        spent.append(scan.distances)
        d = centroids.squared(x, centres)
        assert (d.argmin(1) == cluster).all()
        assert (upper >= np.sqrt(d[np.arange(len(x)), cluster]) * (1 - 1e-6)).all()
        for g, m in enumerate(scan.members):
            others = np.where(m[None] == cluster[:, None], np.inf, d[:, m])
            assert (lower[:, g] <= np.sqrt(others.min(1)) * (1 + 1e-6) + 1e-6).all()
    assert spent[-1] < 0.2 * x.shape[0] * 24


def test_table_against_sql(spark, tiny):
    import duckdb

    got = centroids.cluster_vectors(spark.read.parquet(f"{tiny}/embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tiny}/embeddings.parquet')")
    cursor = con.execute(centroids.ORACLE_SQL)
    assert [c[0] for c in cursor.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())
