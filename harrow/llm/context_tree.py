"""Language-model scoring by context-tree weighting of binary-decomposed bytes.

A text is read as its lower-cased words joined by one space and ended by a line feed. Every byte is eight binary decisions; the
context of a decision is the bits of its byte so far and the preceding bytes, DEPTH at most. Each node of that tree has a
Krichevsky-Trofimov estimate of its counts, and weights it equally with the product of its children; the probability of a
bit mixes the estimates of all depths by their posterior weights. The counts are those of the training texts only.

Everything is counted as n-grams of DEPTH + 1 bytes whose most recent context byte comes first, so that the contexts of every
depth are ranges of the sorted grams:

1. documents lie in blocks of bounded size, the parts in which they are read; each block lists its distinct grams and words
   with their counts, as compressed arrays dealt into buckets;
2. a bucket gathers the lists of all blocks; buckets of grams consist of whole subtrees, the grams that share their three
   nearest context bytes (2^24 at most), which one task weights; depths 0 to 2 are weighted together (2^16 contexts at most);
3. the log probability of each gram, and the count of each word, go back to the blocks that list it, which add them up along
   their texts. A block receives what it lists and no more, so nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LongMap, settle, span_hashes

#: Context bytes; depth up to which the tree is weighted in one place; bytes of text in a block, on average.
DEPTH, TOP, BLOCK = 5, 2, 24 << 20
END = 0x0A
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as read: their bytes, n+1 bounds, hashes of the words, and the word counts up to each text's begin."""
    raw = np.frombuffer(b"".join([(t or "").encode() + b"\xff" for t in texts]), np.uint8)  # a byte that UTF-8 never has
    gap = _GAP[raw]
    first = ~gap
    first[1:] &= gap[:-1] | (raw[:-1] == 0xFF) | (raw[1:] == 0xFF)
    kept, first = raw[~gap], first[~gap]
    ends = kept == 0xFF
    spaced = first & ~ends & ~np.r_[True, ends[:-1]]
    place = np.arange(len(kept)) + np.cumsum(spaced)
    out = np.full(int(place[-1]) + 1 if len(place) else 0, 0x20, np.uint8)
    out[place] = _LOWER[kept]
    out[place[ends]] = END
    bounds = np.r_[0, place[ends] + 1]
    starts = place[first & ~ends]
    stops = np.flatnonzero((out == 0x20) | (out == END))
    words = span_hashes(out, starts, stops[np.searchsorted(stops, starts)])
    return out, bounds, words, np.searchsorted(starts, bounds)


def grams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The gram of every byte: its context bytes, nearest first, then itself; before a text stand ends of texts."""
    key = data.astype(np.uint64)
    for k in range(1, DEPTH + 1):
        before = np.empty(len(data), np.uint64)
        before[k:] = data[:-k] if k < len(data) else data[:0]
        before[:k] = END
        for j in range(k):
            at = bounds[:-1] + j
            before[at[at < bounds[1:]]] = END
        key |= before << np.uint64(8 * (DEPTH + 1 - k))
    return key


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    return _log_gamma(n + 0.5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; arguments under eight are raised by the recurrence."""
    x, less = x.astype(np.float64), np.zeros(len(x))
    for _ in range(8):
        low = x < 8
        less = np.where(low, less + np.log(np.where(low, x, 1.0)), less)
        x = np.where(low, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - less


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma_half(zeros) + _log_gamma_half(ones) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


class Level:
    """The nodes of one depth and one bit of the byte: counts, weighted log probability, share of the own estimate."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.node, self.zeros, self.ones = node, zeros, ones
        own = log_kt(zeros, ones)
        self.log_weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.share = np.ones(len(node)) if below is None else np.exp(own - np.log(2) - self.log_weighted)
        self.one = (ones + 0.5) / (zeros + ones + 1)


def _node(key: np.ndarray, depth: int, bit: int) -> np.ndarray:
    """Context of that depth and the first bits of the byte, after a leading one, as a number."""
    prefix = ((key & np.uint64(0xFF)) | np.uint64(0x100)) >> np.uint64(8 - bit)
    return (key >> np.uint64(8 * (DEPTH - depth + 1))) << np.uint64(8) | prefix


def subtree(key: np.ndarray, count: np.ndarray, bit: int) -> list[tuple[Level, np.ndarray]]:
    """Depths TOP+1 to DEPTH, deepest first, for one bit: the nodes, and the node of each gram."""
    one = (key >> np.uint64(7 - bit) & np.uint64(1)) > 0
    out: list[tuple[Level, np.ndarray]] = []
    for depth in range(DEPTH, TOP, -1):
        node, inverse = np.unique(_node(key, depth, bit), return_inverse=True)
        ones = np.bincount(inverse, count * one, len(node))
        zeros = np.bincount(inverse, count * ~one, len(node))
        below = None
        if out:
            child, child_of = out[-1]
            parent = np.zeros(len(child.node), np.int64)
            parent[child_of] = inverse
            below = np.bincount(parent, child.log_weighted, len(node))
        out.append((Level(node, zeros, ones, below), inverse))
    return out


def subtree_sums(key: np.ndarray, count: np.ndarray) -> pd.DataFrame:
    """What the subtrees add to the nodes of depth TOP: counts, and the log probability of their children."""
    found = []
    for bit in range(8):
        top = subtree(key, count, bit)[-1][0]
        node = (top.node >> np.uint64(16)) << np.uint64(8) | (top.node & np.uint64(0xFF))
        found.append(pd.DataFrame({"node": node.astype(np.int64), "zeros": top.zeros, "ones": top.ones, "below": top.log_weighted}))
    return pd.concat(found).groupby("node", as_index=False).sum()


def top_mixture(sums: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every node of depth TOP: what depths 0 to TOP give to a one, and the share left to deeper contexts."""
    sums = sums.sort_values("node")
    node = sums["node"].to_numpy().astype(np.uint64)
    levels, zeros, ones, below, at = [], sums["zeros"].to_numpy(), sums["ones"].to_numpy(), sums["below"].to_numpy(), node
    inverse = np.arange(len(node))
    for depth in range(TOP, -1, -1):
        levels.append((Level(at, zeros, ones, below), inverse))
        if depth:
            upper, up = np.unique((at >> np.uint64(16)) << np.uint64(8) | (at & np.uint64(0xFF)), return_inverse=True)
            zeros, ones = np.bincount(up, zeros, len(upper)), np.bincount(up, ones, len(upper))
            below = np.bincount(up, levels[-1][0].log_weighted, len(upper))
            at, inverse = upper, up[inverse]
    given, left = np.zeros(len(node)), np.ones(len(node))
    for level, of in reversed(levels):
        given += left * (level.share * level.one)[of]
        left *= 1 - level.share[of]
    return node, given, left


def gram_log10(key: np.ndarray, count: np.ndarray, top: LongMap, given: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 of each gram's byte after its context."""
    out = np.zeros(len(key))
    for bit in range(8):
        at = top.get(_node(key, TOP, bit), -1)
        one, rest = given[at].copy(), left[at].copy()
        for level, of in reversed(subtree(key, count, bit)):
            one += rest * (level.share * level.one)[of]
            rest *= 1 - level.share[of]
        one = np.clip(one, 1e-12, 1 - 1e-12)
        out += np.log10(np.where(key >> np.uint64(7 - bit) & np.uint64(1), one, 1 - one))
    return out


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences and their 64-bit counts or values, byte planes apart, which compress well."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zlib.compress(planes, 1)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    n = len(raw) // 16
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).reshape(-1), dtype=np.uint64)
    return keys, np.ascontiguousarray(raw[8 * n :].reshape(8, n).T).view("<u8").reshape(-1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts]).astype(np.float64)
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, counts, len(unique))


def _counted(keys: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs where ``learnt``."""
    every = np.sort(keys)
    every = every[np.r_[True, every[1:] != every[:-1]]] if len(every) else every
    used = np.sort(keys[learnt])
    begin = np.flatnonzero(np.r_[True, used[1:] != used[:-1]]) if len(used) else np.zeros(0, np.int64)
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, used[begin])] = np.diff(np.r_[begin, len(used)])
    return every, counts


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _bucket(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Grams of one subtree share a bucket; words are dealt by their hash."""
    return (_mix(keys >> np.uint64(8 * (DEPTH - TOP))) if kind == 0 else keys >> np.uint64(20)) % np.uint64(buckets)


def _parts(texts: list[str | None], limit: int = 2 << 20) -> Iterator[slice]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= limit:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _lists(rows: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, block, packed): the distinct grams (kind 0) and words (1) of each block, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for batch in batches:
            block, learnt, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                own = texts.take(pa.array(at)).to_pylist()
                for part in _parts(own):
                    data, bounds, words, before = stream(own[part])
                    use = learnt[at[part]]
                    for kind, keys, sizes in ((0, grams(data, bounds), np.diff(bounds)), (1, words, np.diff(before))):
                        found = seen[int(b), kind]
                        found.append(_counted(keys, np.repeat(use, sizes)))
                        if len(found) >= 4:
                            seen[int(b), kind] = [_merged(found)]
        for (b, kind), found in seen.items():
            keys, counts = _merged(found)
            deal = _bucket(kind, keys, buckets)
            order = np.argsort(deal, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(deal[order]) > 0]) if len(order) else []
            for i in np.split(order, cuts[1:]) if len(order) else []:
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([int(deal[i[0]])], pa.int64()), pa.array([b], pa.int64()), pa.array([_packed(keys[i], counts[i])], pa.binary())], ["kind", "bucket", "block", "packed"])

    return rows.select("block", "learnt", "text").mapInArrow(run, "kind int, bucket bigint, block bigint, packed binary")


def _learn(held: pa.Table) -> pa.Table:
    """Of a bucket of grams: what it adds to the top of the tree. Of a bucket of words: their tokens (zeros) and distinct ones (ones)."""
    keys, counts = _merged([_unpacked(x.as_py()) for x in held.column("packed")])
    if held.column("kind")[0].as_py():
        return pa.table({"kind": pa.array([1], pa.int32()), "node": [0], "zeros": [float(counts.sum())], "ones": [float((counts > 0).sum())], "below": [0.0]})
    sums = subtree_sums(keys, counts)
    return pa.table({"kind": pa.array(np.zeros(len(sums), np.int32)), **{c: pa.array(sums[c].to_numpy()) for c in sums}})


def score(documents: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every whole text, learning from those not held out.

    score: log10 of the model's probability of the text's words and its end. A null or empty text is its end alone. Rows with
    a null id are scored; repeated rows count, and are scored, each. An empty table gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (~held_out).alias("learnt"))
    size, ends, n = rows.agg(F.sum(F.octet_length("text")), F.count_if("learnt"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")
    read = rows._jdf.queryExecution().toRdd().getNumPartitions()
    split = max(1, -(-size // (read * BLOCK)))
    buckets = 4 * max(1, -(-size // BLOCK))
    rows = rows.withColumn("block", F.spark_partition_id().cast("long") * split + F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(split)))
    lists = settle(_lists(rows, buckets), "lists")
    learnt = lists.groupBy("kind", "bucket").applyInArrow(_learn, "kind int, node bigint, zeros double, ones double, below double")
    # at most 2^16 contexts of two bytes, and 255 nodes of a byte in each
    sums = learnt.groupBy("kind", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toPandas()
    words = sums[sums["kind"] == 1]
    tokens, distinct = int(words["zeros"].sum()) + ends, int(words["ones"].sum()) + (ends > 0)
    shared = spark.sparkContext.broadcast(top_mixture(sums[sums["kind"] == 0].drop(columns="kind")))

    def values(held: pa.Table) -> pa.Table:
        """Of a bucket: each block's keys again, with log10 of the gram or the count of the word (as float bits)."""
        packed = [_unpacked(x.as_py()) for x in held.column("packed")]
        keys, counts = _merged(packed)
        if held.column("kind")[0].as_py():
            value = counts.astype("<u8")
        else:
            node, given, left = shared.value
            value = gram_log10(keys, counts, LongMap(node, np.arange(len(node))), given, left).astype("<f4").view("<u4")
        back = [_packed(k, value[np.searchsorted(keys, k)]) for k, _ in packed]
        return pa.table({"block": held.column("block"), "kind": held.column("kind"), "packed": pa.array(back, pa.binary())})

    given_back = lists.groupBy("kind", "bucket").applyInArrow(values, "block bigint, kind int, packed binary")
    scale = tokens + 0.1 * (distinct + 1)
    end_score = float(np.log10((ends + 0.1) / scale))

    def add_up(texts: pa.Table, held: pa.Table) -> pa.Table:
        found: list[list] = [[], []]
        for k, x in zip(held.column("kind").to_pylist(), held.column("packed"), strict=True):
            found[k].append(_unpacked(x.as_py()))
        maps = []
        for parts in found:
            keys, value = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in (0, 1))
            maps.append(LongMap(keys, np.arange(len(keys))))
            maps.append(np.append(value, 0))
        gram_map, gram_value, word_map, word_value = maps[0], maps[1].astype("<u4").view("<f4"), maps[2], maps[3].astype(np.float64)
        own, columns = texts.column("text").to_pylist(), []
        for part in _parts(own):
            data, bounds, words, before = stream(own[part])
            at = gram_map.get(grams(data, bounds), -1)
            of = word_map.get(words, -1)
            if (at < 0).any() or (of < 0).any():
                raise RuntimeError("the documents were read in other blocks than before")
            total = np.r_[0.0, np.cumsum(gram_value[at], dtype=np.float64)]
            count = word_value[of]
            base = np.r_[0.0, np.cumsum(np.log10((count + 0.1) / scale))]
            known = np.r_[0, np.cumsum(count > 0)]
            a, b = before[:-1], before[1:]
            columns.append((b - a + 1, known[b] - known[a] + (ends > 0), base[b] - base[a] + end_score, total[bounds[1:]] - total[bounds[:-1]], np.diff(bounds)))
        n_tokens, n_known, base, total, size = (np.concatenate(c) for c in zip(*columns, strict=True)) if columns else (np.zeros(0),) * 5
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": pc.invert(texts.column("learnt")), "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)), "train_tokens": pa.array(np.full(len(own), tokens, np.int64)), "base_score": pa.array(base.astype(np.float64)), "score": pa.array(total.astype(np.float64)), "bits_per_byte": pa.array(-total / np.log10(2) / np.maximum(size, 1))})

    return rows.groupBy("block").cogroup(given_back.groupBy("block")).applyInArrow(add_up, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")
