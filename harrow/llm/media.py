"""Media columns: find media by signature, confirm it by its structure, correct declared types, carve embedded files.

An Aho-Corasick automaton reports every magic string of a value in one pass; a validator per format then
walks the structure (chunks, markers, pages, boxes) and returns the exact length, or rejects the hit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Media signatures as the formats define them -> (format, bytes before the magic).
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("png", 0),
    b"\xff\xd8\xff": ("jpeg", 0),
    b"GIF87a": ("gif", 0),
    b"GIF89a": ("gif", 0),
    b"RIFF": ("riff", 0),
    b"BM": ("bmp", 0),
    b"%PDF-": ("pdf", 0),
    b"PK\x03\x04": ("zip", 0),
    b"\x1f\x8b\x08": ("gzip", 0),
    b"OggS": ("ogg", 0),
    b"fLaC": ("flac", 0),
    b"ftyp": ("mp4", 4),
}
TYPES = {"png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "wav": "audio/wav", "webp": "image/webp", "avi": "video/x-msvideo", "bmp": "image/bmp", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "ogg": "audio/ogg", "flac": "audio/flac", "mp4": "video/mp4"}
BLOCK, RATE, HEADER = 576, 8000, 44


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return "png", p - at
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        m = b[p + 1]
        if m == 0xD9:
            return ("jpeg", p + 2 - at) if frame else None
        if m == 0xFF or 0xD0 <= m <= 0xD7 or m == 1:
            p += 1 if m == 0xFF else 2
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return None
        frame, p = frame or 0xC0 <= m <= 0xCF, p + 2 + n
        if m == 0xDA:  # entropy-coded data up to the next marker that is neither stuffing nor a restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return None
    return ("jpeg", p + 2 - at) if frame and b[p : p + 2] == b"\xff\xd9" else None


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return "gif", p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0))
        else:
            return None
    return None


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    n, form = struct.unpack_from("<I4s", b, at + 4)
    kind, end = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}.get(form), at + 8 + n
    if kind is None or end > len(b):
        return None
    p = at + 12
    while p + 8 <= end:
        p += 8 + (size := struct.unpack_from("<I", b, p + 4)[0]) + (size & 1)
    return (kind, end + (n & 1 if end + (n & 1) <= len(b) else 0) - at) if end <= p <= end + 1 else None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 30 > len(b):
        return None
    n, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    ok = zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= n <= len(b) - at
    return ("bmp", n) if ok and (head == 12 or struct.unpack_from("<HH", b, at + 26)[0] == 1) else None


def _pdf(b: bytes, at: int) -> tuple[str, int] | None:
    """To the last end mark before the next file's head: updated and linearised files have several."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    following = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, following if following >= 0 else len(b))
    return ("pdf", end + 5 - at) if end >= 0 and b.rfind(b"startxref", at, end) >= 0 else None


def _zip(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 30 > len(b) or struct.unpack_from("<H", b, at + 8)[0] not in (0, 8, 9, 12, 14, 93, 95):
        return None
    end = b.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start = struct.unpack_from("<II", b, end + 12)
    return ("zip", end + 22 + struct.unpack_from("<H", b, end + 20)[0] - at) if at + start + size == end else None


def _gzip(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    d = zlib.decompressobj(31)
    try:
        data = memoryview(b)[at:]
        while len(data) and not d.eof:
            d.decompress(data, 1 << 20)
            data = d.unconsumed_tail if not d.eof else data
    except zlib.error:
        return None
    return ("gzip", len(b) - at - len(d.unused_data)) if d.eof else None


def _ogg(b: bytes, at: int) -> tuple[str, int] | None:
    p = at
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0:
        table = b[p + 27 : p + 27 + b[p + 26]]
        p += 27 + len(table) + sum(table)
    return ("ogg", p - at) if at < p <= len(b) else None


def _crc8(b: bytes) -> int:
    """Remainder by x^8 + x^2 + x + 1, as frame headers carry it."""
    r = 0
    for x in b:
        r ^= x
        for _ in range(8):
            r = (r << 1 ^ 0x107) if r & 0x80 else r << 1
    return r


def _flac_frame(b: bytes, p: int) -> bool:
    """A frame header, confirmed by its checksum, begins here."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 2] >> 4 == 0 or b[p + 2] & 15 == 15 or b[p + 3] >> 4 > 10 or b[p + 3] & 1:
        return False
    lead, q = b[p + 4], p + 4
    q += 1 if lead < 0x80 else next((n for n in range(2, 8) if lead >> (7 - n) == (1 << (n + 1)) - 2), 0) if lead < 0xFE else 7 if lead == 0xFE else 0
    q += {6: 1, 7: 2}.get(b[p + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[p + 2] & 15, 0)
    return q > p + 4 and q < len(b) and _crc8(b[p:q]) == b[q]


def _flac(b: bytes, at: int) -> tuple[str, int] | None:
    """Metadata blocks and the frames after them. A frame's length isn't stored: the last one ends where the next signature or the value does."""
    p, first = at + 4, True
    while p + 4 <= len(b):
        last, kind, n = b[p] >> 7, b[p] & 0x7F, int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind, n) != (0, 34) or p + 4 + n > len(b):
            return None
        p, first = p + 4 + n, False
        if last:
            if not _flac_frame(b, p):
                return "flac", p - at  # metadata alone
            stops = [s for m, (_, before) in MAGIC.items() if len(m) > 3 and (s := b.find(m, p) - before) >= p]
            return "flac", min(stops, default=len(b)) - at
    return None


def _mp4(b: bytes, at: int) -> tuple[str, int] | None:
    p, kinds = at, set()
    while p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if n == 1 and p + 16 <= len(b):  # a 64-bit size follows
            n = struct.unpack_from(">Q", b, p + 8)[0]
        elif n == 0:  # to the end
            n = len(b) - p
        if n < 8 or p + n > len(b) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"udta", b"uuid", b"moof", b"mfra", b"sidx", b"meta", b"pdin", b"styp"):
            break
        p, kinds = p + n, kinds | {kind}
    return ("mp4", p - at) if kinds > {b"ftyp"} else None


VALIDATE = {"png": _png, "jpeg": _jpeg, "gif": _gif, "riff": _riff, "bmp": _bmp, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "ogg": _ogg, "flac": _flac, "mp4": _mp4}


#: What every file of the kind ends with or holds near its end.
ENDS = {"pdf": b"%%EOF", "zip": b"PK\x05\x06", "png": b"IEND"}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, (kind, before) in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + before))
    a.make_automaton()
    return a


def sniff(content: bytes, signatures: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Confirmed media in ``content`` as (format, offset, length), by offset; one found inside another is listed too."""
    found, none = [], set()
    for end, (kind, back) in signatures.iter(content.decode("latin-1")):
        if kind in none:
            continue
        if end >= back and (hit := VALIDATE[kind](content, end - back)):
            found.append((hit[0], end - back, hit[1]))
        elif kind in ENDS and content.find(ENDS[kind], end) < 0:
            none.add(kind)  # no end mark is left: no later hit of the kind can be whole
    return sorted(set(found), key=lambda x: (x[1], -x[2], x[0]))


def sniff_media(df: DataFrame, content: str, declared: str | None = None) -> DataFrame:
    """Add ``media_type`` (sniffed at offset 0, else the declared one), ``corrected`` and ``embedded`` to a binary column.

    ``embedded``: array of (type, offset, length, content) for every file carved from inside the value. A null or
    empty value has no confirmed type and nothing embedded; unconfirmed declared types stay, uncorrected. Columns
    that the frame already has under these three names are replaced.
    """
    base = df.drop("media_type", "corrected", "embedded")
    schema = base.schema.simpleString()[7:-1]
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = automaton()
        kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))
        for batch in batches:
            values = batch.column(names.index(content)).to_pylist()
            said = batch.column(names.index(declared)).to_pylist() if declared else [None] * len(values)
            types, wrong, inside = [], [], []
            for value, claim in zip(values, said, strict=True):
                hits = sniff(value or b"", signatures)
                top = next((TYPES[k] for k, at, n in hits if at == 0), None)
                types.append(top or claim)
                wrong.append(top is not None and top != claim)
                inside.append([{"type": TYPES[k], "offset": at, "length": n, "content": value[at : at + n]} for k, at, n in hits if at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(wrong, pa.bool_()), pa.array(inside, kind)], [*names, "media_type", "corrected", "embedded"])

    return base.mapInArrow(run, f"{schema}, media_type string, corrected boolean, embedded array<struct<type:string,offset:bigint,length:bigint,content:binary>>")


def encode(payload: bytes) -> bytes:
    """The payload as one channel of unsigned 8-bit PCM samples in a WAVE file: lossless, a fixed 44-byte header."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def decode(stored: bytes) -> bytes:
    """The samples of the file's data chunk."""
    p = 12
    while p + 8 <= len(stored):
        kind, n = struct.unpack_from("<4sI", stored, p)
        if kind == b"data":
            return stored[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("the stored media has no data chunk")


def media_digests(documents: DataFrame) -> DataFrame:
    """Store each whole text as media, read it back and describe what the sniffer confirms.

    A null or empty text is 576 bytes of 255. Equal texts give equal values, whatever their ids; a null id stays
    null and repeated rows give repeated results. The declared type is octet-stream, which the sniffer corrects.
    ``feature``: type; samples; sum of the samples; confirmed embedded files as type@offset+length.
    """
    rows = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = automaton()
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                stored = encode(raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)))
                hits = sniff(stored, signatures)
                if not hits or hits[0] != ("wav", 0, len(stored)):
                    raise ValueError("the stored media isn't confirmed by its structure")
                back = decode(stored)
                inside = ",".join(f"{TYPES[k]}@{at - HEADER}+{n}" for k, at, n in hits if at)
                feature = f"{TYPES['wav']};samples={len(back)};sum={int(np.frombuffer(back, np.uint8).sum(dtype=np.int64))};embedded={inside}"
                out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
