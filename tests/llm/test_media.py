"""Round trips through media, and media found by signature and structure."""

import gzip
import hashlib
import io
import random
import struct
import wave
import zipfile
import zlib

from harrow.llm import media


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x00\x01")) + chunk(b"IEND", b"")
GIF = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = media.media_digests(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored = io.BytesIO()
        with wave.open(stored, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(media.RATE), w.writeframes(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.feature == f"audio/wav;samples={len(payload)};sum={sum(payload)};embedded="
        assert (r.media_bytes, r.media_sha256) == (len(stored.getvalue()), hashlib.sha256(stored.getvalue()).hexdigest())


def test_sniffing(spark):
    zip_file, packed = zipped(), gzip.compress(b"some text " * 50)
    stored = media.encode(b"payload " * 100)
    rows = [(1, PNG, "image/jpeg"), (2, GIF, "image/gif"), (3, b"junk" + PNG + b"more" + packed + zip_file, "text/plain"), (4, None, "image/png"), (5, b"", None), (6, b"\x89PNG\r\n\x1a\nbroken", "image/png"), (7, stored, None)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "id bigint, content binary, declared string, media_type string")
    got = {r.id: r for r in media.sniff_media(frame, "content", "declared").collect()}
    assert [(got[k].media_type, got[k].corrected) for k in range(1, 8)] == [("image/png", True), ("image/gif", False), ("text/plain", False), ("image/png", False), (None, False), ("image/png", False), ("audio/wav", True)]
    assert [(e.type, e.offset, bytes(e.content)) for e in got[3].embedded] == [("image/png", 4, PNG), ("application/gzip", 8 + len(PNG), packed), ("application/zip", 8 + len(PNG) + len(packed), zip_file)]


def test_any_bytes_are_safe():
    rng, signatures = random.Random(8), media.automaton()
    for _ in range(400):
        parts = [rng.choice([*media.MAGIC, PNG, GIF, rng.randbytes(rng.randrange(40))]) for _ in range(8)]
        data = b"".join(p[: rng.randrange(len(p) + 1)] if rng.random() < 0.3 else p for p in parts)
        assert all(at + n <= len(data) for _, at, n in media.sniff(data, signatures))


def test_odd_documents(odd_documents, no_documents):
    got = media.media_digests(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert {(r.n_bytes, r.payload_bytes) for r in got if r.doc_id in (0, 1)} == {(0, 576)}
    assert len({tuple(r)[1:] for r in got if r.doc_id in (0, 1)}) == 1
    assert media.media_digests(no_documents).count() == 0


def pdf(updates):
    return b"%PDF-1.4\n1 0 obj<<>>endobj\n" + b"".join(b"xref\nstartxref\n%d\n%%%%EOF\n" % i for i in range(1 + updates))


def test_lengths():
    signatures = media.automaton()
    one, two = pdf(0), pdf(2)
    assert media.sniff(two + b"tail", signatures) == [("pdf", 0, len(two) - 1)]
    assert media.sniff(one + b"xx" + two, signatures) == [("pdf", 0, len(one) - 1), ("pdf", len(one) + 2, len(two) - 1)]
    head = b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(34)
    frame = bytes([0xFF, 0xF8, 0x69, 0x08, 0x00])
    frame += bytes([0x00])  # the block size of code 6
    frame += bytes([media._crc8(frame)]) + b"samples"
    assert media.sniff(head + b"text that is no frame", signatures) == [("flac", 0, len(head))]
    assert media.sniff(head + frame, signatures) == [("flac", 0, len(head + frame))]
    assert media.sniff(head + frame + PNG, signatures) == [("flac", 0, len(head + frame)), ("png", len(head + frame), len(PNG))]
    ftyp = struct.pack(">I4s", 16, b"ftyp") + b"isom" * 2
    large = struct.pack(">I4sQ", 1, b"mdat", 20) + b"data"
    assert media.sniff(b"ab" + ftyp + large, signatures) == [("mp4", 2, 36)]
    assert media.sniff(ftyp + struct.pack(">I4s", 0, b"mdat") + b"to the end", signatures) == [("mp4", 0, 34)]


def test_many_hits_take_linear_time():
    import time

    signatures, began = media.automaton(), time.perf_counter()
    for magic in (b"%PDF-1", b"PK\x03\x04" + bytes(4), b"\x89PNG\r\n\x1a\n", b"fLaC\x80\x00\x00\x22" + bytes(34)):
        media.sniff(magic * 40_000, signatures)
    assert time.perf_counter() - began < 10
