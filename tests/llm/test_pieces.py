"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def agree(library, texts):
    for text, (n, listed, decoded) in zip(texts, pieces.model(PATH).encode(texts), strict=True):
        ids = library.encode(text)
        assert (n, listed) == (len(ids), ",".join(map(str, ids))), text[:80]
        assert decoded == library.decode(ids), text[:80]
        assert pieces.model(PATH).decode(ids) == decoded


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab  ▁é你🙂\x00\n\t.,aAtheing "), max_size=40), max_size=8))
def test_odd_texts(texts):
    agree(sentencepiece.SentencePieceProcessor(model_file=PATH), texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_texts(texts):
    agree(sentencepiece.SentencePieceProcessor(model_file=PATH), [t for t in texts if t.isprintable() or True])


def test_runs_and_long_words(library):
    rng = random.Random(3)
    agree(library, ["a" * 5000, "ab" * 3000, "".join(rng.choice("etaoin") for _ in range(20_000)), "  " * 50, " lead", "trail ", "aaa aaaa aaaaa", "=" * 301, "- " * 300])


def test_any_ids_decode_alike(library):
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32_000)]) for _ in range(rng.randrange(1, 12))]
        assert pieces.model(PATH).decode(ids) == library.decode(ids), ids


def test_documents(spark, library, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pieces.encode_documents(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_documents(odd_documents, no_documents, library):
    got = pieces.encode_documents(odd_documents, keep=True).collect()
    assert len(got) == odd_documents.count()
    want = sorted((str(r.doc_id), library.encode(r.text or "")) for r in odd_documents.collect())
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert pieces.encode_documents(no_documents).count() == 0
