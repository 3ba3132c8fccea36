"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters and digits or runs of signs. The features of a text are its words and pairs of neighbouring
words, hashed to 2^18 places, and each word's distance to its last repetition, weighted by their share of the text. The score is a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CUT, fresh, slices, span_hashes, text_buffer

BITS = 18
#: At most so many labelled rows are learnt from, chosen by a hash of the id; passes over them.
MAX_TRAIN, EPOCHS = 6000, 4
ALPHA, BETA, L1, L2, SCALE = 0.15, 1.0, 0.3, 1.0, 10.0
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def hashed_words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, and the word counts up to each text's begin (n+1 values)."""
    n = len(buffer)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[buffer]
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < n]] = True
    cut = np.flatnonzero(edge)
    ends = np.r_[cut[1:], n]
    word = kind[cut] > 0
    cut, ends = cut[word], ends[word]
    h = span_hashes(buffer, cut, ends)
    return h, np.searchsorted(cut, offsets)


def features(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places, three a word, text by text, and the n+1 bounds: the word, the pair it begins, its repetition.

    The third is an n-gram up to the names of its words: the word's distance to the same word among the four before it.
    """
    h, bounds = hashed_words(buffer, offsets)
    place = np.empty((len(h), 3), np.uint32)
    if len(h):
        with np.errstate(over="ignore"):
            pairs = (h[:-1] * np.uint64(0x94D049BB133111EB) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
            place[:, 0] = h >> np.uint64(64 - BITS)
            place[:-1, 1] = pairs >> np.uint64(64 - BITS)
            last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
            place[last, 1] = place[last, 0]  # a text's last word begins no pair: it counts twice
            begin = np.repeat(bounds[:-1], np.diff(bounds))
            near = np.zeros(len(h), np.uint64)
            for k in (4, 3, 2, 1):
                same = np.flatnonzero((h[k:] == h[:-k]) & (np.arange(k, len(h)) - k >= begin[k:])) + k
                near[same] = k
            place[:, 2] = ((near + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    return place.reshape(-1), 3 * bounds


def _featurise(rows: DataFrame) -> DataFrame:
    """(order, label, idx, val): the distinct places of each text and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, CUT):
                place, bounds = features(*text_buffer(part.column(2)))
                idx, val = [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    i, c = np.unique(place[a:b], return_counts=True)
                    idx.append(i.astype(np.int32)), val.append((SCALE * c / max(1, b - a)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["order", "label", "idx", "val"])

    return rows.mapInArrow(run, "order bigint, label int, idx array<int>, val array<float>")


def ftrl(idx: list[np.ndarray], val: list[np.ndarray], label: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after per-coordinate FTRL-proximal updates, in row order; the last weight is the intercept."""
    z, n, w = np.zeros(1 + (1 << BITS)), np.zeros(1 + (1 << BITS)), np.zeros(1 + (1 << BITS))
    share = label.mean() if len(label) else 0.5
    balance = np.where(label == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    for _ in range(epochs):
        for i, x, y, weight in zip(idx, val, label, balance, strict=True):
            i, x = np.append(i, 1 << BITS), np.append(x.astype(np.float64), 1.0)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = weight * (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i], n[i] = zi + g - sigma * wi, ni + g * g
    used = np.abs(z) > L1
    w[used] = (np.sign(z[used]) * L1 - z[used]) / ((BETA + np.sqrt(n[used])) / ALPHA + L2)
    return w


def train(documents: DataFrame, labels: DataFrame, usable: Column, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights learnt from labelled documents whose id is ``usable``; at most ``max_train`` ids, lowest hash first.

    Rows with a null id, label or text are not learnt from; an id with several texts is learnt from by the one of the least hash, and
    once for each different label.
    Without any rows all weights are zero, which scores every text 0.5.
    """
    order = F.xxhash64("doc_id")
    known = labels.where("doc_id is not null and quality is not null").where(usable).select("doc_id", F.col("quality").cast("int").alias("label"), order.alias("order"))
    chosen = known.orderBy("order", "label").limit(max_train)  # its size is bounded, whatever the corpus
    held = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one row for each chosen id, however often the documents repeat it
    texts = held.groupBy("order", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "label"], kind="stable")
        w = ftrl(rows["idx"].tolist(), rows["val"].tolist(), rows["label"].to_numpy())
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at.astype(np.int32), "w": w[at]})

    # one group of bounded size: an SGD pass is sequential
    found = _featurise(texts).groupBy(F.lit(0).alias("g")).applyInPandas(fit, "at int, w double").toPandas()
    weights = np.zeros(1 + (1 << BITS), np.float32)
    weights[found["at"]] = found["w"]
    return weights


def score(documents: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """Add the probability of label 1 for each whole text (null: empty). Every row and column stays; a same-named column is replaced."""
    base = documents.drop(column)
    at, names, schema = base.columns.index("text"), base.columns, base.schema.simpleString()[7:-1]
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in slices(batch, at, CUT):
                place, bounds = features(*text_buffer(part.column(at)))
                sums = np.r_[0.0, np.cumsum(w[place], dtype=np.float64)]
                dot = w[-1] + SCALE * (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(1, np.diff(bounds))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], [*names, column])

    return base.mapInArrow(run, f"{schema}, {column} double")


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; rows whose remainder of 3 is 1 are never learnt from."""
    weights = train(documents, labels, remainder(3) != 1)
    scored = score(documents.select("doc_id", "text"), weights)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns. Learns from all labelled ids."""
    weights, column = train(documents, labels, F.lit(True)), fresh(documents, "score")
    return score(documents, weights, column).where(F.col(column) >= least).select(*[F.col(f"`{c}`") for c in documents.columns])
