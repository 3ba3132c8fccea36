"""Approximate nearest neighbours by collision counting over query-centred windows (one projection per hash function).

Every vector is indexed. Vectors are dealt in blocks; a task holds one block at a time, builds its sorted arrays once, one for each
projection, and queries stream past them. A query's windows are widened by virtual rehashing (the radius grows by a factor);
vectors that collide in enough projections are verified exactly. A block's search stops when k verified vectors are so near
that nearer ones would have collided, or when a small share of the block is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, settle

K = 10
#: Projections (whole orthonormal bases, whose errors cancel in part); share of them that must collide; growth of the radius.
PROJECTIONS, THRESHOLD, GROWTH, SEED = 192, 0.8, 1.04, 7
#: A vector at distance d collides in THRESHOLD of the projections at a half window of REACH d, as expected; a search may stop at SLACK times that.
REACH, SLACK = 1.2816, 1.15
#: Beyond k, the share of a block's vectors after whose verification a search stops: at the end of a round, whose vectors are all verified.
VERIFIED = 0.04
#: Vectors of a block, on average.
BLOCK = 16384


def projections(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    """dim x m directions: random orthonormal bases side by side, scaled so that a difference of length d projects to d on average (in the square)."""
    rng, made = np.random.default_rng(SEED), []
    while sum(b.shape[1] for b in made) < m:
        made.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0] * np.sqrt(dim))
    return np.concatenate(made, axis=1)[:, :m]


class Index:
    """The sorted projections of one block of vectors of one length."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.rows, self.ids, self.x = rows, ids, x
        self.lines = projections(x.shape[1])
        shadow = x @ self.lines
        n, m = shadow.shape
        order = np.argsort(shadow, axis=0, kind="stable")
        self.low = shadow.min()
        # the arrays lie end to end, each moved beyond the one before: one search finds all windows
        self.wide = float(shadow.max() - self.low)
        self.shift = np.arange(m) * (2 * self.wide + 1.0)
        self.value = (np.take_along_axis(shadow, order, axis=0) - self.low + self.shift).T.reshape(-1)
        self.order = order.T.reshape(-1).astype(np.int32)
        self.first = np.arange(m) * n
        self.verified = 0

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest verified vectors of any row but ``own``; ties go to smaller ids."""
        n, m = len(self.x), len(self.first)
        others = n - int((self.rows == own).sum())
        hits, open_ = np.zeros(n, np.int32), self.rows != own
        need, limit = int(np.ceil(THRESHOLD * m)), k + VERIFIED * n
        if not others:
            return np.zeros(0, np.int64), np.zeros(0)
        # a query's place is kept near its array, whose whole width then is in reach
        at = np.clip(q @ self.lines - self.low, -self.wide, 2 * self.wide) + self.shift
        low = high = np.clip(np.searchsorted(self.value, at), self.first, self.first + n)
        # the first radius: half of what a vector at the mean distance of some needs
        some = self.x[:: max(1, n // 64)]
        radius = max(REACH / 2 * float(np.sqrt(((some - q) ** 2).sum(1)).mean()), 1e-12)
        best_ids, best, seen = np.zeros(0, np.int64), np.zeros(0), 0
        while len(best) < min(k, others) or not (radius >= REACH * SLACK * best[-1] or seen >= limit or seen >= others):
            width = min(radius, 3 * self.wide + 1.0)
            lo = np.minimum(np.maximum(np.searchsorted(self.value, at - width, "left"), self.first), low)
            hi = np.maximum(np.minimum(np.searchsorted(self.value, at + width, "right"), self.first + n), high)
            starts, sizes = np.concatenate([lo, high]), np.concatenate([low - lo, hi - high])
            places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            hits += np.bincount(self.order[places], minlength=n).astype(np.int32)
            low, high = lo, hi
            new = np.flatnonzero(open_ & (hits >= need))
            if len(new):
                open_[new] = False
                seen += len(new)
                d = np.sqrt(((self.x[new] - q) ** 2).sum(1))
                best_ids, best = np.r_[best_ids, self.ids[new]], np.r_[best, d]
                top = np.lexsort((best_ids, best))[:k]
                best_ids, best = best_ids[top], best[top]
            radius *= GROWTH if seen else 1.1
        self.verified += seen
        return best_ids, best


def usable(embedding: Column) -> Column:
    """The vector isn't null or zero and holds no null or non-finite component."""
    bad = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embedding.isNotNull() & ~bad & F.exists(embedding, lambda c: c != 0)


def nearest(embeddings: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``is_query`` holds for, nearest first.

    Candidates are all rows but the query's own: other rows of its id or vector are among them, and repeated rows count and
    are searched for each. Ties go to smaller ids. Rows with a null id or an unusable vector take no part, nor do those of another length
    than the query's. An empty table gives no rows.
    """
    asks = fresh(embeddings, "asks")
    marked = embeddings.withColumn(asks, F.coalesce(is_query, F.lit(False))).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # rows are numbered once, in a written table: repeated rows are told apart
    table = settle(marked.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col(asks).alias("asks")), "vectors")
    total = table.count()
    blocks = max(1, -(-total // BLOCK))
    stored = table.select("row", "vec_id", "embedding", F.lit(False).alias("asks"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long").alias("block"))
    asked = table.where("asks").select("row", "vec_id", "embedding", "asks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    dealt = stored.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    heads = ["row", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, indexes = None, [], {}
        for batch in batches:
            frame = batch.to_pandas()
            for number, part in frame.groupby("block", sort=True):
                if number != block:
                    block, held, indexes = number, [], {}
                if not part["asks"].all():
                    held.append(part[~part["asks"]])
                part = part[part["asks"]]
                if len(part) and held:
                    every = [row for h in held for row in zip(h["row"], h["vec_id"], h["embedding"], strict=True)]
                    for dim in {len(e) for _, _, e in every}:
                        own = [row for row in every if len(row[2]) == dim]
                        indexes[dim] = Index(np.array([r[0] for r in own]), np.array([r[1] for r in own], np.int64), np.stack([r[2] for r in own]))
                    held = []
                out: list[list[np.ndarray]] = [[] for _ in heads]
                for row, query, vector in zip(part["row"], part["vec_id"], part["embedding"], strict=True):
                    index = indexes.get(len(vector))
                    if index is None:
                        continue
                    ids, score = index.search(row, np.asarray(vector), k)
                    for column, value in zip(out, (np.full(len(ids), row), np.full(len(ids), query), ids, score), strict=True):
                        column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], heads)

    found = dealt.mapInArrow(run, "row bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
