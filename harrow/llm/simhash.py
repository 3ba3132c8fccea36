"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a Hamming radius by bit-sliced comparison.

Fingerprints are compared in buckets: of seven parts of the bits, two fingerprints within four bits share three at least, so each
choice of three parts is a key of 27 bits or more.
In a bucket the fingerprints lie vertically, as bit planes of 64 lanes; the distances of one fingerprint to 64 others are
counted at once by carry-save adders over words, and a block of lanes is abandoned once all of them exceed the radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CUT, components, discard, fresh, settle, slices, text_buffer

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Bits of the seven parts, and how many make a key; fingerprints of a bucket that one group holds at most (larger ones are dealt in pairs of blocks).
PARTS, CHOSEN, BLOCK = (9, 9, 9, 9, 9, 9, 10), 3, 2048
#: A fingerprint of more than one in so many of the rows (and FEW rows) is hot: its rows are dealt in parts. There are SHARE of them at most.
SHARE, FEW = 1000, 4096
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def fingerprints_of(buffer: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The unsigned fingerprint of each text: bits set in over half of its shingles' hashes."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(buffer):
        return out
    gap = _GAP[buffer]
    first = ~gap
    first[1:] &= gap[:-1]
    first[offsets[:-1][offsets[:-1] < len(buffer)]] = ~gap[offsets[:-1][offsets[:-1] < len(buffer)]]
    keep = ~gap
    # each word with one space before it: words of a text are then joined as the shingles need them
    place = np.cumsum(keep.astype(np.int64) + first)
    joined = np.full(int(place[-1]), 0x20, np.uint8)
    joined[place[keep] - 1] = _LOWER[buffer[keep]]
    starts = place[first] - 1
    ends = np.r_[starts[1:] - 1, len(joined)]
    bounds = np.searchsorted(np.flatnonzero(first), offsets).tolist()
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    starts, ends = starts.tolist(), ends.tolist()
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a < b:
            k = min(size, b - a)
            h = np.array([digest(raw[s:e], SEED) for s, e in zip(starts[a : b - k + 1], ends[a + k - 1 : b], strict=True)], ">u8")
            ones = np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(h)).view(">u8")[0]
    return out


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit number, 0 for texts without words (null too)."""
    rows = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, CUT):
                fp = fingerprints_of(*text_buffer(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def within_radius(fp: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i != j, of equal ``run`` and at most ``radius`` (under 8) differing bits; ``run`` is sorted.

    Returned are the rows' surviving lane words: (row, word index, mask) flattened to row and column arrays.
    """
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(run)])
    words = -(-sizes // 64)
    base = np.r_[0, np.cumsum(words)]
    inside = np.arange(len(fp)) - np.repeat(starts, sizes)
    word_of, lane = np.repeat(base[:-1], sizes) + inside // 64, (inside % 64).astype(np.uint64)
    planes = np.zeros((64, base[-1]), np.uint64)
    edges = np.flatnonzero(np.r_[True, word_of[1:] != word_of[:-1]])
    for bit in range(64):
        planes[bit] = np.bitwise_or.reduceat(((fp >> np.uint64(bit)) & np.uint64(1)) << lane, edges)
    real = np.bitwise_or.reduceat(np.uint64(1) << lane, edges)
    first_row = np.arange(len(fp))[edges]
    found_row, found_col = [], []
    per_row = np.repeat(words, sizes)
    for a, b in _chunks(per_row, 1 << 18):
        row = np.repeat(np.arange(a, b), per_row[a:b])
        word = np.arange(len(row)) - np.repeat(np.cumsum(per_row[a:b]) - per_row[a:b], per_row[a:b]) + np.repeat(np.repeat(base[:-1], sizes)[a:b], per_row[a:b])
        c0 = c1 = c2 = over = np.zeros(len(row), np.uint64)
        query = fp[row]
        for bit in range(64):
            d = planes[bit][word] ^ (np.uint64(0) - ((query >> np.uint64(bit)) & np.uint64(1)))
            c0, d = c0 ^ d, c0 & d
            c1, d = c1 ^ d, c1 & d
            c2, d = c2 ^ d, c2 & d
            over = over | d
            if bit % 8 == 7:
                near = ~(over | _exceeds(c0, c1, c2, radius)) & real[word]
                live = near != 0
                if bit < 63 and live.mean() < 0.9:
                    row, word, query, c0, c1, c2, over = row[live], word[live], query[live], c0[live], c1[live], c2[live], over[live]
                    if not len(row):
                        break
        if not len(row):
            continue
        near = ~(over | _exceeds(c0, c1, c2, radius)) & real[word]
        live = np.flatnonzero(near)
        bits = np.unpackbits(near[live].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, at = np.nonzero(bits)
        i, j = row[live][which], first_row[word[live][which]] + at
        other = i != j
        found_row.append(i[other]), found_col.append(j[other])
    empty = np.zeros(0, np.int64)
    return np.concatenate(found_row or [empty]), np.concatenate(found_col or [empty])


def _chunks(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    ends, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b


def _exceeds(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is over the radius."""
    more, equal = np.zeros_like(c0), ~np.zeros_like(c0)
    for c, r in ((c2, radius >> 2 & 1), (c1, radius >> 1 & 1), (c0, radius & 1)):
        if r:
            equal = equal & c
        else:
            more, equal = more | (equal & c), equal & ~c
    return more


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that each row reaches over the pairs: labels shrink to a fixed point."""
    label = np.arange(n)
    while len(i):
        low = label.copy()
        np.minimum.at(low, i, label[j])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    return label


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between different fingerprints ``fp`` (distinct) that span the same groups as all links within the radius.

    A bucket over BLOCK fingerprints is dealt to pairs of its blocks, so no task holds more than two blocks of one; in a
    group only a spanning forest of its links is put out.
    """
    if radius + CHOSEN > len(PARTS) or radius > 6:
        raise ValueError("the buckets are made for a radius of four at most")
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(len(PARTS)), CHOSEN)):
        mask = sum(((1 << PARTS[p]) - 1) << sum(PARTS[:p]) for p in chosen)
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64))), F.lit(number)))
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    counts = rows.groupBy("bucket").count().where("count > 1").select("bucket", F.expr(f"(count + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    # never broadcast: Spark sizes the rows as if each fingerprint still had one
    placed = rows.join(counts.hint("merge"), "bucket").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    # the pairs of blocks that a fingerprint takes part in; with one block, that block alone
    dealt = placed.select("fp", "bucket", "own", F.explode(F.expr("if(blocks = 1, array(0L), filter(sequence(0L, blocks - 1), x -> x <> own))")).alias("other"))
    groups = dealt.select("fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("grp"))
    n = prints.sparkSession.conf.get("spark.sql.shuffle.partitions")
    held = groups.repartition(int(n), "grp").sortWithinPartitions("grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(fp: np.ndarray, grp: np.ndarray) -> pa.RecordBatch:
            i, j = within_radius(fp.view(np.uint64), grp, radius)
            label = spanning(i, j, len(fp))
            moved = np.flatnonzero(label != np.arange(len(fp)))
            a, b = fp[moved], fp[label[moved]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        fp, grp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            fp, grp = np.r_[fp, batch.column(0).to_numpy()], np.r_[grp, batch.column(1).to_numpy()]
            cut = int(np.searchsorted(grp, grp[-1])) if len(grp) else 0
            if cut >= 4096:  # the last group may go on
                yield linked(fp[:cut], grp[:cut])
                fp, grp = fp[cut:], grp[cut:]
        if len(fp):
            yield linked(fp, grp)

    return held.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; component_id is the smallest doc_id reachable.

    Texts without words, null ones among them, have fingerprint zero and link like any other. Rows with a null doc_id
    take part and keep a null id; it is no component's smallest id unless the group has no other. Repeated rows are
    repeated in the result; an empty table gives no rows; other columns are ignored.
    """
    prints = settle(fingerprints(documents), "fingerprints")
    low = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "prints")
    groups = components(links(low.select("fp")), "simhash")
    member = low.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = member.groupBy("component").agg(F.min("low").alias("component_id"))
    # one fingerprint may be a third of all documents: the rows of hot ones are dealt in parts, at most SHARE hot ones whatever the corpus
    total = low.agg(F.sum("n")).first()[0] or 0
    parts = F.ceil(F.col("n") / max(FEW, -(-total // SHARE))).cast("long")
    named = settle(member.join(least, "component").select("fp", "component_id", parts.alias("parts")), "named")
    discard(low), discard(groups)
    hot = named.where("parts > 1").select("fp", "parts")
    dealt = prints.join(F.broadcast(hot), "fp", "left").select("fp", "doc_id", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part"))
    owned = named.select("fp", "component_id", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    return dealt.join(owned.hint("merge"), ["fp", "part"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(documents: DataFrame) -> DataFrame:
    """The documents of the smallest doc_id of each group, with their own columns; those without an id all stay."""
    found = near_duplicates(documents.where("doc_id is not null"))
    name = fresh(documents, "kept")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    named = documents.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(name), "left_semi")
    return named.unionByName(documents.where("doc_id is null"))
