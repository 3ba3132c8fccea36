"""Runs against all periods and all starts; the query against a plain loop over whole texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import runs


def brute(x, least):
    """(start, end, smallest period) by comparing every word with the one each period before it."""
    found, v = {}, np.unique(np.array(x), return_inverse=True)[1]
    for q in range(1, len(x) // 2 + 1):
        same = np.r_[False, v[q:] == v[:-q], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j + q - i >= max(2 * q, least):
                found.setdefault((i, j + q), q)
    return sorted(((s, t, q) for (s, t), q in found.items()), key=lambda r: (r[0], r[2]))


def digests(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words, 12)
    best = min(((s - t, s, q) for s, t, q in found), default=None)
    dropped = {i for s, t, q in found for i in range(s + q, t)}
    facts = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *facts, sha("".join(f"{s},{t - s},{q}\n" for s, t, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(2, 12))
def test_short_sequences(x, least):
    assert runs.runs(x, least) == brute(x, least)


def test_periodic_sequences():
    random.seed(3)
    for _ in range(600):
        n = random.randint(5, 120)
        x = [random.randrange(6) for _ in range(n)]
        for _ in range(3):
            a, p = random.randrange(n), random.randint(1, 20)
            x = [v if i < a else x[min(n - 1, a + (i - a) % p)] for i, v in enumerate(x)] + [random.randrange(6) for _ in range(random.randint(0, 5))]
            n = len(x)
        assert runs.runs(x) == brute(x, 12)


def test_factors():
    """Each factor is the longest prefix of the rest that begins earlier."""
    random.seed(4)
    for _ in range(200):
        x = [random.randrange(3) for _ in range(random.randint(0, 50))]
        at = 0
        for b, e, source in runs.factors(x):
            longest = max((next((k for k in range(len(x) - b) if x[s + k] != x[b + k]), len(x) - b) for s in range(b)), default=0)
            assert (b, e - b) == (at, max(1, longest)) and (source < 0) == (longest == 0)
            assert source < 0 or (source < b and x[source : source + e - b] == x[b:e])
            at = e
        assert at == len(x)


def test_stretches_lose_nothing():
    """All runs of several texts in one buffer, with and without the stretches."""
    random.seed(5)
    texts = []
    for _ in range(80):
        x = [random.choice("abcdefgh") for _ in range(random.randint(0, 60))]
        a, p = random.randrange(61), random.randint(1, 12)
        texts.append(" ".join([*x[:a], *(x[a : a + p] * random.randint(1, 4)), *x]))
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    for least in (4, 12):
        got = runs.text_runs(np.frombuffer(b"".join(raw), np.uint8), offsets, least)
        assert got == [brute(t.split(), least) for t in texts]


def test_query(spark, odd_documents):
    unit = [f"w{i}" for i in range(40)]
    texts = ["a " * 11, "a " * 12, " ".join(unit * 3 + unit[:7]), "\n".join(unit + unit), " ".join(["x", *"ab" * 8, "ab", *"cd" * 9, "c", *"cd" * 9]), "Aa aA " * 7 + "\x0b\x0c", "é ü é ü " * 5, " ".join((["p"] * 13 + ["q"]) * 4)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, " ".join(f"v{j * j % 77}" for j in range(i))) for i in range(120)]
    frame = odd_documents.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"), allowMissingColumns=True)
    got = sorted(map(tuple, runs.run_digests(frame).collect()), key=str)
    assert got == sorted((digests(r["doc_id"], r["text"]) for r in frame.collect()), key=str)
    assert sum(r[1] > 0 for r in got) > 12


def test_general_interface(spark, no_documents):
    frame = spark.createDataFrame([(1, "so it is so it is so it is"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in runs.find_runs(frame, least=6).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 9, 3)] and got[1]["collapsed"] == "so it is"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == ""
    assert runs.run_digests(no_documents).count() == 0


@pytest.mark.parametrize("table", ["tiny"])
def test_table(spark, request, table):
    docs = spark.read.parquet(f"{request.getfixturevalue(table)}/documents.parquet")
    short = docs.where("n_chars < 6000")  # brute force is quadratic
    assert sorted(map(tuple, runs.run_digests(short).collect())) == sorted(digests(r["doc_id"], r["text"]) for r in short.collect())
