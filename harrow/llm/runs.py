"""Periodic runs of words: Kolpakov and Kucherov's algorithm over a suffix automaton's factors and Main's search at their bounds.

A run is a maximal stretch of words whose smallest period fits at least twice, of ``least`` words at least. A text's words
become numbers. Stretches that can't hold a run are ruled out first, without loss: every word of a run lies in a window of ``least`` / 2
words that its stretch repeats. Each stretch left is cut into factors, the longest prefixes that occurred before, by walking its
suffix automaton. Runs that cross or touch a factor's begin come from longest common extensions to both sides (Main), those strictly within a
factor are copied from its earlier occurrence.

A null text has no words: no runs, and the empty text after collapsing. Rows keep their own results, repeated ids too; an empty
table gives an empty result; further columns are ignored. The automaton takes some 500 bytes for each word of a
repetitive stretch. Texts are spread as their table is; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, slices, text_buffer
from .quality_rules import _identities as identities

LEAST = 12
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def factors(x: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, earlier begin) of the factors of ``x``; -1 for a symbol that is new."""
    follow, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(x):
        here = len(follow)
        follow.append({}), length.append(length[last] + 1), first.append(i), link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = here
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                copy = len(follow)
                follow.append(follow[q].copy()), length.append(length[p] + 1), first.append(first[q]), link.append(link[q])
                link[q] = link[here] = copy
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
        last = here
    out, i, n = [], 0, len(x)
    while i < n:
        state, j = 0, i
        while j < n:
            step = follow[state].get(x[j])
            if step is None or first[step] >= j:  # its first occurrence isn't earlier than this one
                break
            state, j = step, j + 1
        out.append((i, j, first[state] - (j - i) + 1) if j > i else (i, i + 1, -1))
        i = max(j, i + 1)
    return out


def matches(y: list[int]) -> list[int]:
    """For each place of ``y``, how long its suffix there agrees with ``y`` (0 at the first)."""
    n = len(y)
    out, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and y[k] == y[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def crossing(x: list[int], a: int, b: int, e: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs that cross or touch ``b`` and end within the factor b..e; a..b is the factor before.

    With a period q, such a run starts after a - q (else the factor before would be longer), so q is less than e - a. One that goes on
    beyond e is found at a later factor.
    """
    before, size, n = b - a, e - b, len(x)
    if 2 * (before + size) <= least:
        return
    most = min(b, before + size - 1)
    own = x[b:e]
    back = matches(x[b - min(b, most + before) : b][::-1])
    ahead = matches([*own, -1, *x[b - most : e]])
    at = size + 1 + most
    for q in range(1, most + 1):  # a whole period lies before b
        to_left, to_right = back[q] if q < len(back) else 0, ahead[at - q]
        if to_left < before and to_left + to_right >= q and q + to_left + to_right >= least and not (to_right == size and e < n and x[e] == x[e - q]):
            yield b - q - to_left, b + to_right, q
    if size < 2:
        return
    inner = matches(own)
    reach = min(b, size)
    behind = matches([*x[b - reach : b][::-1], -1, *x[b - reach : e][::-1]])
    at = reach + 1 + size
    for q in range(1, size):  # less than a period lies before b
        to_left, to_right = behind[at - q], inner[q]
        end = b + q + to_right
        if to_left < q <= to_left + to_right and q + to_left + to_right >= least and not (end == e and e < n and x[e] == x[e - q]):
            yield b - to_left, end, q


def runs(x: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of ``x``, by start, then period."""
    period: dict[tuple[int, int], int] = {}
    starts: dict[int, list[int]] = {}

    def add(s: int, t: int, q: int) -> None:
        known = period.get((s, t))
        if known is None:
            starts.setdefault(s, []).append(t)
        if known is None or q < known:
            period[s, t] = q

    cut, a = factors(x), 0
    for b, e, source in [*cut, (len(x), len(x), -1)]:
        if b:
            for run in crossing(x, a, b, e, least):
                add(*run)
        if source >= 0 and e - b >= least + 2:
            end, shift = source + e - b, b - source
            for s in range(source + 1, end - least):
                for t in starts.get(s, ()):
                    if t < end:
                        add(s + shift, t + shift, period[s, t])
        a = b
    return sorted(((s, t, q) for (s, t), q in period.items()), key=lambda r: (r[0], r[2]))


def repetitive(word: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """The stretches (begin, end) that may hold runs: in each, every word lies in a window of ``width`` words that the stretch holds twice.

    Windows are compared by 64-bit hashes: equal ones never differ, and unequal ones that agree only leave more to look at.
    """
    n = len(word)
    if n <= width:
        return np.zeros((0, 2), np.int64)
    with np.errstate(over="ignore"):
        mixed = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : n - width + 1 + k]
        at = np.flatnonzero(owner[width - 1 :] == owner[: n - width + 1])
        stretch = owner.astype(np.int64)
        for _ in range(4):  # once more for every new division; any number is right
            key = (h[at] ^ (stretch[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x94D049BB133111EB)
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            left = at[count[which] > 1]
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, left, 1), np.add.at(cover, left + width, -1)
            covered = np.cumsum(cover[:n]) > 0
            if len(left) == len(at):
                break
            new = np.ones(n, bool)
            new[1:] = (owner[1:] != owner[:-1]) | ~covered[1:] | ~covered[:-1]
            stretch, at = np.cumsum(new), left
    new = covered.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | ~covered[:-1]
    begin = np.flatnonzero(new)
    stop = covered.copy()
    stop[:-1] &= (owner[1:] != owner[:-1]) | ~covered[1:]
    return np.stack([begin, np.flatnonzero(stop) + 1], axis=1)


def text_runs(buffer: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, end, period) of the runs of each text, in word numbers."""
    inside = ~_BLANK[buffer]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = inside[heads]
    at = np.flatnonzero(begin)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if not len(at):
        return out
    size = np.zeros(len(buffer) + 1, np.int64)
    np.cumsum(inside, out=size[1:])
    word = identities(buffer, inside, np.diff(size[np.r_[at, len(buffer)]]))
    first = np.searchsorted(at, offsets)
    owner = np.repeat(np.arange(len(out)), np.diff(first))
    for b, e in repetitive(word, owner, max(1, least // 2)).tolist():
        text = int(owner[b])
        base = b - int(first[text])
        out[text] += [(base + s, base + t, q) for s, t, q in runs(word[b:e].tolist(), least)]
    return out


def collapsed(raw: bytes, found: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one blank, without those that a run holds after its first period."""
    words = raw.split()  # bytes part at the six blanks only
    if found:
        depth = np.zeros(len(words) + 1, np.int64)
        for s, t, q in found:
            depth[s + q] += 1
            depth[t] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return b" ".join(words)


def find_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period by start, then period), collapsed: the text without its runs' repetitions."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                buffer, offsets = text_buffer(part.column(1))
                found = text_runs(buffer, offsets, least)
                raw = buffer.tobytes()
                texts = [collapsed(raw[offsets[i] : offsets[i + 1]], f) for i, f in enumerate(found)]
                spans = [[{"start": s, "length": t - s, "period": q} for s, t, q in f] for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    kept = documents.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_periods(doc_id: Column, text: Column) -> Column:
    """The texts of the query: of a tenth of the ids, the words from a place on repeat with a period, both by the id's hash."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, f"[{WORD[2:]}"), lambda w: w != "")
    make = lambda w, n, a, p: F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.get(F.transform(F.array(F.struct(w.alias("w"), a.alias("a"), p.alias("p"))), lambda s: make(s["w"], n, s["a"], s["p"])), F.lit(0))

    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(text)


def run_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; none: nulls), digests of all runs and of the collapsed text."""
    rows = find_runs(documents.select("doc_id", with_periods(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    length, period = -best["n"], best["period"]
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
