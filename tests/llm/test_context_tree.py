"""Scores against a context tree written out node by node."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from harrow.llm import context_tree, quality


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def decisions(text):
    """(context nodes from depth 0 on, bit) of each binary decision of a text."""
    data = " ".join(words_of(text)).encode() + b"\n"
    for i, byte in enumerate(data):
        before = bytes([0x0A] * 5 + list(data[:i]))[-5:][::-1]
        for bit in range(8):
            prefix = (byte | 0x100) >> (8 - bit)
            yield [(before[:d], prefix) for d in range(6)], byte >> (7 - bit) & 1


def brute(training, texts):
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for text in training:
        for nodes, bit in decisions(text):
            for n in nodes:
                counts[n][bit] += 1
            for a, b in zip(nodes, nodes[1:], strict=False):
                children[a].add(b)
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    weighted, share = {}, {}
    for n in sorted(counts, key=lambda n: -len(n[0])):
        own = kt(*counts[n])
        if len(n[0]) == 5:
            weighted[n], share[n] = own, 1.0
        else:
            weighted[n] = np.logaddexp(own, sum(weighted[c] for c in children[n])) - math.log(2)
            share[n] = math.exp(own - math.log(2) - weighted[n])
    out = []
    for text in texts:
        total = 0.0
        for nodes, bit in decisions(text):
            one, rest = 0.0, 1.0
            for n in nodes:
                # a node without counts: its estimate is one half whatever the depth
                z, o = counts[n] if n in counts else (0, 0)
                s = share.get(n, 1.0 if len(n[0]) == 5 else 0.5)
                one += rest * s * (o + 0.5) / (z + o + 1)
                rest *= 1 - s
            total += math.log10(one if bit else 1 - one)
        out.append(total)
    return out


def base(training, text):
    known = Counter(w for t in training for w in [*words_of(t), "\n"])
    n, v = sum(known.values()), len(known)
    return sum(math.log10((known[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words_of(text), "\n"]), sum(known[w] > 0 for w in [*words_of(text), "\n"]), n


def held_out(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0


def test_scores(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("length(text) < 800 or doc_id % 40 = 7").repartition(5)
    rows = docs.select("doc_id", "text").collect()
    training = [r.text for r in rows if not held_out(r.doc_id)]
    want = dict(zip([r.doc_id for r in rows], brute(training, [r.text for r in rows]), strict=True))
    got = context_tree.score(docs, quality.remainder(10) == 0).collect()
    text = {r.doc_id: r.text for r in rows}
    assert len(got) == len(rows) and {r.held_out for r in got} == {False, True}
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-5, abs=1e-4)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / len(" ".join(words_of(text[r.doc_id])).encode() + b"\n"))
        b, known, n = base(training, text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id), len(words_of(text[r.doc_id])) + 1, known, n)
        assert r.base_score == pytest.approx(b, rel=1e-9)


def test_better_than_the_base_on_held_out_texts(spark, small):
    got = context_tree.score(spark.read.parquet(f"{small}/documents.parquet"), quality.remainder(10) == 0).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_blocks_do_not_matter(spark, tiny, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    few = {r.doc_id: r.score for r in context_tree.score(docs, quality.remainder(10) == 0).collect()}
    monkeypatch.setattr(context_tree, "BLOCK", 20_000)
    many = {r.doc_id: r.score for r in context_tree.score(docs, quality.remainder(10) == 0).collect()}
    assert few == pytest.approx(many, rel=1e-6)


def test_odd_documents(odd_documents, no_documents):
    got = context_tree.score(odd_documents, quality.remainder(10) == 0).collect()
    rows = odd_documents.collect()
    training = [r.text for r in rows if not held_out(r.doc_id)]
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    empty = next(r for r in got if r.doc_id == 0)
    assert empty.n_tokens == 1 and empty.base_score == pytest.approx(base(training, None)[0])
    assert context_tree.score(no_documents, quality.remainder(10) == 0).count() == 0


def test_counts_beyond_32_bits():
    import numpy as np

    keys, counts = np.array([3, 9, 1 << 63], np.uint64), np.array([1, 5_000_000_000, 1 << 40])
    got = context_tree._unpacked(context_tree._packed(keys, counts))
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == counts.tolist()
