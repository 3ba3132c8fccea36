"""Helpers shared by the training-data operators: lineage cuts, blocks, numpy hash maps, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Bytes of text that the pipeline's Python tasks take in at a time (one text at least); each takes 30 to 50 bytes of memory meanwhile.
CUT = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one serves only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark, "_harrow_shared", None)
    if own is None:
        own = spark._harrow_shared = "file://" + tempfile.mkdtemp(prefix="spark-harrow-")
    return own


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, on replicated storage.

    All tables of an application lie in one folder, which may go when it ends; ``discard`` deletes those that no later plan reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/harrow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._harrow_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a settled table that no later plan reads."""
    path = getattr(df, "_harrow_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text column holds about ``limit`` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, begin, total = np.cumsum(lengths), 0, 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(ends, total + limit, side="right")))
        yield batch.slice(begin, end - begin)
        total, begin = int(ends[end - 1]), end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n+1 offsets of its rows."""
    column = pc.fill_null(column, "")
    values = column.to_pylist()
    raw = [v.encode() for v in values]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


#: A fixed odd number for prefix hashes, and its inverse modulo 2^64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes, by differences of one polynomial prefix sum."""
    n = len(buffer)
    with np.errstate(over="ignore"):
        power, inverse = np.full(n + 1, _P, np.uint64), np.full(n + 1, _P_INV, np.uint64)
        power[0] = inverse[0] = 1
        np.cumprod(power, out=power), np.cumprod(inverse, out=inverse)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


class LongMap:
    """Open-addressing map from distinct uint64 keys to values, looked up for whole arrays."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, bool)
        self.values = np.zeros(1 << bits, values.dtype)
        keys, left = keys.astype(np.uint64), np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = ~self.used[slot]
            winner = np.zeros(len(self.keys), np.int64) - 1
            winner[slot[free]] = left[free]
            won = winner[slot] == left
            at = slot[won]
            self.keys[at], self.values[at], self.used[at] = keys[left[won]], values[left[won]], True
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.MULTIPLIER) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, default) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        slot = self._slot(keys)
        hit = self.used[slot] & (self.keys[slot] == keys)
        out = np.where(hit, self.values[slot], default)
        left = np.flatnonzero(~hit & self.used[slot])
        slot = slot[left]
        for _ in range(self.probes):
            if not len(left):
                break
            slot = (slot + 1) & self.mask
            hit = self.used[slot] & (self.keys[slot] == keys[left])
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & self.used[slot]
            left, slot = left[go], slot[go]
        return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Distributed union-find over ``edges(a, b)``: (node, component), the smallest node reachable; nodes with links only.

    Each round hooks every node to its smallest neighbour, halves the pointer paths until all end at a root, and contracts
    the graph to the distinct links between roots: rounds, and halvings in a round, grow with the logarithm of the nodes.
    All steps are joins and pre-aggregated groupings.
    """
    spark = edges.sparkSession
    live = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    label = None
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        hooks = settle(hooks, name)
        moved = True
        while moved:
            over = hooks.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            jumped = settle(hooks.select("node", "up").join(over, "up").select("node", F.col("upper").alias("up"), (F.col("upper") < F.col("up")).alias("moved")), name)
            discard(hooks)
            hooks, moved = jumped, bool(jumped.where("moved").limit(1).count())
        if label is None:
            next_label = hooks.select("node", F.col("up").alias("component"))
        else:
            step = hooks.select(F.col("node").alias("component"), "up")
            next_label = label.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        next_label = settle(next_label, name)
        to_a, to_b = hooks.select(F.col("node").alias("a"), F.col("up").alias("x")), hooks.select(F.col("node").alias("b"), F.col("up").alias("y"))
        contracted = live.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        next_live = settle(contracted, name)
        for old in (live, hooks, label):
            discard(old)
        live, label = next_live, next_label
    if label is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label
