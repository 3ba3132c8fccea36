"""Packed pieces against the tokenizers library and the packing rules."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from harrow.llm import packing

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def whole(rows, texts):
    """Every id lies in one piece, every sequence is gapless and no longer than 2048; the padding's share."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    for k, text in texts:
        ids, at = ids_of(text), 0
        for r in sorted(pieces[k, len(ids)], key=lambda r: r.start):
            if r.start == at:
                assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
                at += r.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    return 1 - total / (2048 * len(sequences))


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    padding = whole(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert padding < 0.01


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  é你🙂\x00\n\t.,aA'ts1  the<|endoftext|>"), max_size=60))
def test_ids(text):
    assert np.frombuffer(packing.Ids(RANKS, packing.added_tokens(PATH))(text), "<u4").tolist() == ids_of(text)[:-1].tolist()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(text):
    assert np.frombuffer(packing.Ids(RANKS, packing.added_tokens(PATH))(text), "<u4").tolist() == ids_of(text)[:-1].tolist()


def test_first_fit_decreasing():
    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted((rng.randrange(1, 101) for _ in range(rng.randrange(1, 200))), reverse=True)
        free, want = [], []
        for n in lengths:
            k = next((i for i, f in enumerate(free) if f >= n), len(free))
            if k == len(free):
                free.append(100)
            free[k] -= n
            want.append(k)
        assert packing.first_fit_decreasing(lengths, 100) == want


def test_odd_documents(odd_documents, no_documents):
    rows = packing.pack(odd_documents).collect()
    whole(rows, [(r.doc_id, r.text) for r in odd_documents.collect()])
    assert sum(r.length for r in rows) == sum(len(ids_of(r.text)) for r in odd_documents.collect())
    assert packing.pack(no_documents).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "<|", " ", "  ", "\n", "a", " the", "你", "🙂", "'s", "1,"]), max_size=12).map("".join))
def test_ids_with_added_tokens(text):
    got = packing.Ids(RANKS, packing.added_tokens(PATH))(text)
    assert np.frombuffer(got, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_packed_added_tokens(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "none", "x <|endoftext|> " * 1500]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for k, text in enumerate(texts):
        ids = np.array([*LIBRARY.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want = [(s, len(ids), zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)]
        assert sorted((r.start, r.doc_tokens, r.ids_crc32) for r in rows if r.doc_id == k) == want
