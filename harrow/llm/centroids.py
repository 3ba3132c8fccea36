"""Centroid clustering: Lloyd's rounds with Yinyang filters, in exact integers.

Centroids are put into groups once. A vector keeps its centroid, an upper bound of the distance to it and one lower bound for each
group of the others. After a round, bounds move by as much as the centroids did: a vector whose upper bound lies below all its lower
bounds keeps its centroid unseen (global filter), else only the groups whose bound it does not undercut are scanned (group
filter), exactly. Bounds are compared with slack, so that rounding never skips a centroid, and ties are always scanned.

Components are integers floor(scale * x); squared distances and centroids (floor of sum / count) are exact. Only centroids, their
sums and the seeds reach the driver: k rows. A round is one pass over the vectors; sums follow from the vectors that moved.

Vectors are kept if they have exactly ``dims`` components, none null or non-finite; others are not returned. Components
beyond ±2^27 count as ±2^27, so that distances fit 64 bits. A null id is hashed as the empty text; repeated rows are vectors of
their own; seeds of equal hash are taken in the order of their components. With fewer vectors than k, each is a seed. An empty
table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

MOST = 1 << 27
#: Relative slack of bounds: far above the rounding of a few additions and roots, far below what filters gain.
SLACK = 1e-9
STATE = "vec_id bigint, v array<int>, cluster int, before int, distance bigint, upper double, lower array<double>"
NAMES = ["vec_id", "v", "cluster", "before", "distance", "upper", "lower"]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``, 64-bit integers."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    top = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < 1 << 53:  # every sum below is a whole number that a double holds
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """A group number for each centroid, by five rounds of clustering the centroids themselves; every group has at least one."""
    k = len(centroids)
    groups = max(1, min(groups, k))
    heads = centroids[np.linspace(0, k - 1, groups).astype(int)].astype(np.float64)
    of = np.zeros(k, int)
    for _ in range(5):
        of = ((centroids[:, None, :] - heads[None]) ** 2).sum(2).argmin(1)
        heads = np.stack([centroids[of == g].mean(0) if (of == g).any() else heads[g] for g in range(groups)])
    return np.unique(of, return_inverse=True)[1]


class Scan:
    """Assignment of blocks of vectors to the nearest of the present centroids; ties go to the smaller number."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, drift: np.ndarray | None = None):
        self.centroids, self.group, self.drift = centroids, group, drift
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max(initial=-1)) + 1)]
        self.distances = 0

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, exact distance, upper bound, lower bounds, by a scan of all centroids."""
        d = squared(x, self.centroids)
        self.distances += d.size
        best = d.argmin(1)
        row = np.arange(len(x))
        near = d[row, best]
        rest = np.sqrt(d.astype(np.float64))
        rest[row, best] = np.inf
        lower = np.stack([rest[:, m].min(1) for m in self.members], axis=1)
        return best, near, np.sqrt(near.astype(np.float64)), lower

    def again(self, x, cluster, near, upper, lower, exact: bool):
        """The same from the last round's bounds. ``near`` is the distance where it was computed; ``exact`` asks for it everywhere."""
        c, group, drift = self.centroids, self.group, self.drift
        upper = upper + drift[cluster]
        lower = lower - np.array([drift[m].max() for m in self.members])
        cluster, near = cluster.copy(), near.copy()
        clear = lambda u, low: low * (1 - SLACK) - SLACK > u * (1 + SLACK)
        open_ = np.ones(len(x), bool) if exact else ~clear(upper, lower.min(1))
        at = np.flatnonzero(open_)
        if not len(at):
            return cluster, near, upper, lower
        own = ((x[at] - c[cluster[at]]) ** 2).sum(1)
        self.distances += len(at)
        near[at], upper[at] = own, np.sqrt(own.astype(np.float64))
        scan = ~clear(upper[at][:, None], lower[at])
        first = cluster[at]
        best_d, best_c = own.copy(), first.copy()
        parts = []
        for g, m in enumerate(self.members):
            rows = np.flatnonzero(scan[:, g])
            if not len(rows):
                continue
            d = squared(x[at[rows]], c[m])
            self.distances += d.size
            parts.append((g, m, rows, d))
            low = d.argmin(1)
            dist, number = d[np.arange(len(rows)), low], m[low]
            better = (dist < best_d[rows]) | ((dist == best_d[rows]) & (number < best_c[rows]))
            best_d[rows[better]], best_c[rows[better]] = dist[better], number[better]
        moved = np.flatnonzero(best_c != first)
        left = at[moved], group[first[moved]]
        lower[left] = np.minimum(lower[left], np.sqrt(own[moved].astype(np.float64)))
        for g, m, rows, d in parts:
            root = np.sqrt(d.astype(np.float64))
            root[m[None, :] == best_c[rows][:, None]] = np.inf
            lower[at[rows], g] = root.min(1)
        cluster[at], near[at], upper[at] = best_c, best_d, np.sqrt(best_d.astype(np.float64))
        return cluster, near, upper, lower


def whole(embeddings: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that are kept, in integers."""
    x = F.col("embedding")
    fine = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    integer = lambda e: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(scale * e.cast("double")))).cast("int")
    return embeddings.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, integer).alias("v"))


def _matrix(column: pa.ListArray, dims: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dims)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def _pass(state: DataFrame, scan: Scan, dims: int, exact: bool) -> DataFrame:
    """One assignment: a map over the vectors with the k centroids."""
    begin = "cluster" not in state.columns
    size = len(scan.members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            if begin:
                before = np.full(len(x), -1, np.int32)
                cluster, near, upper, lower = scan.first(x)
            else:
                before = batch.column(2).to_numpy()
                near, upper = batch.column(4).to_numpy(), batch.column(5).to_numpy()
                cluster, near, upper, lower = scan.again(x, before.astype(np.int64), near, upper, _matrix(batch.column(6), size, np.float64), exact)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(before), pa.array(near), pa.array(upper), _lists(lower)], NAMES)

    return state.mapInArrow(run, STATE)


def _changes(state: DataFrame, dims: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, change of its count, changes of its sums), of the vectors that moved: at most k rows."""
    moved = state.where("cluster <> before").select("v", F.explode(F.array(F.struct(F.col("cluster"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("cluster"), F.lit(-1).alias("sign")))).alias("m")).select("v", "m.*").where("cluster >= 0")
    rows = moved.groupBy("cluster").agg(F.sum("sign").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i)).cast("bigint") * F.col("sign")) for i in range(dims)]).alias("sums")).collect()
    return [(r["cluster"], r["n"], r["sums"]) for r in rows]


def cluster_vectors(embeddings: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, groups: int | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector after ``rounds`` rounds.

    ``groups`` is the number of lower bounds a vector keeps, a quarter of the centroids unless given.
    """
    spark = embeddings.sparkSession
    kept = whole(embeddings, dims, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = [r["v"] for r in kept.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    result = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], result)
    k = len(seeds)
    centroids = np.array(seeds, np.int64)
    group = grouped(centroids, groups or -(-k // 4))
    counts, sums, drift = [0] * k, [[0] * dims for _ in range(k)], None
    state = kept
    for r in range(rounds + 1):
        scan = Scan(centroids, group, drift)
        following = settle(_pass(state, scan, dims, exact=r == rounds), "clusters")
        discard(state)
        state = following
        if r == rounds:
            break
        for c, n, change in _changes(state, dims):
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], change, strict=True)]
        moved = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c].tolist() for c in range(k)], np.int64)
        drift = np.sqrt(((moved - centroids) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        centroids = moved
    inertia = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda n: min(n, (1 << 63) - 1)
    total = fits(sum(inertia.values()))
    facts = [(c, fits(d), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    floor_div = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT i, c, sum((l.x - m.x) * (l.x - m.x))::BIGINT AS d FROM l JOIN c{r} m USING (pos) GROUP BY i, c),
a{r} AS (SELECT i, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"c{r + 1} AS (SELECT c, pos, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN (SELECT c, pos, ({floor_div})::BIGINT AS x FROM a{r} JOIN l USING (i) GROUP BY c, pos) n USING (c, pos))")
    return f"""WITH kept AS (SELECT row_number() OVER () AS i, vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
l AS (SELECT i, vec_id, generate_subscripts(embedding, 1) AS pos, CAST(floor({scale} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
seeds AS (SELECT i, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}), c0 AS (SELECT c, pos, x FROM seeds JOIN l USING (i)),
{", ".join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS s FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, s AS centroid_sha256 FROM a{rounds} JOIN h USING (c) JOIN kept USING (i)"""


ORACLE_SQL = _sql()
