"""Packing: first-fit decreasing of token pieces into sequences, by a tournament tree over free capacities.

A document longer than a sequence is cut at multiples of the capacity: its full pieces fill sequences of their own,
and the rest is packed. Pieces are dealt at random (by a hash of the row) into groups of bounded expected size, which are
packed independently, so no group grows with the corpus.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, SEPARATOR = 2048, 1
#: Documents in a packing group, on average; words whose ids a task remembers.
GROUP_DOCS, MEMORY = 8192, 250_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s \s?| \s")
_encoders: dict[str, tiktoken.Encoding] = {}
_added: dict[str, dict[str, int]] = {}


def added_tokens(json_path: str) -> dict[str, int]:
    """Ids of the strings that the vocabulary lists as added tokens: they are one id wherever they occur."""
    if json_path not in _added:
        with open(json_path, encoding="utf-8") as file:
            listed = json.load(file)["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in listed):
            raise ValueError(f"{json_path}: added tokens that depend on their surroundings")
        _added[json_path] = {a["content"]: a["id"] for a in listed}
    return _added[json_path]


class Ids(dict):
    """Token ids of whole texts as little-endian uint32 bytes; ids of words met before are remembered.

    A single space between two other characters always starts a new pre-token, so a text can be cut there
    and each part encoded by itself; the keys are the parts after such a space. Strings in ``added`` are the ids given there; without it, ordinary text.
    """

    def __init__(self, ranks_path: str, added: dict[str, int] | None = None):
        super().__init__()
        self.added = {a: array("I", [i]).tobytes() for a, i in (added or {}).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        if ranks_path not in _encoders:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            _encoders[ranks_path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ordinary = _encoders[ranks_path].encode_ordinary
        self.single = _encoders[ranks_path]._core_bpe.encode_single_piece
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        """Ids of a part; a word, alone or before one sign, is a pre-token as it stands."""
        ids = self.older.get(part)
        if ids is None:
            if part.isalpha():
                ids = array("I", self.single((" " + part).encode())).tobytes()
            elif part[-1:] in (",", ".") and part[:-1].isalpha():
                ids = array("I", self.single((" " + part[:-1]).encode()) + self.single(part[-1].encode())).tobytes()
            else:
                ids = array("I", self.ordinary(" " + part)).tobytes()
        if len(part) < 64:
            self[part] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return b"".join(self.added.get(part) or self.plain(part) for part in self.cut.split(text) if part)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        parts = _SAFE.split(text) if _ODD.search(text) else text.split(" ")
        if len(self) > MEMORY:
            self.older = dict(self)
            self.clear()
        head = array("I", self.ordinary(parts[0])).tobytes()
        return head + b"".join(map(self.__getitem__, parts[1:])) if len(parts) > 1 else head


def pieces(rows: DataFrame, groups: int, capacity: int, ranks_path: str, json_path: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, grp) for every piece of every row of (doc_id, text, seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = Ids(ranks_path, added_tokens(json_path)), np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = (ids_of(text) if text else b"") + end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    piece = ids[4 * s : 4 * (s + capacity)]
                    row.append(i), start.append(s), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(n)
            at = np.array(row, np.int64)
            seed = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[at] + np.array(start, np.uint64)
            mixed = (seed ^ (seed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            grp = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(groups)).astype(np.int64)
            columns = [batch.column(0).take(pa.array(at)), *(pa.array(np.array(c, np.int64)) for c in (start, length, crc, total)), pa.array(grp)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, grp bigint")


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of every item. ``lengths`` must not increase. The tree's nodes hold the largest free capacity below them."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    free, bins = [capacity] * (2 * leaves), []
    for length in lengths:
        node = 1
        while node < leaves:  # the leftmost bin with room
            node *= 2
            if free[node] < length:
                node += 1
        bins.append(node - leaves)
        free[node] -= length
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return bins


def pack_group(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
    bins = np.array(first_fit_decreasing(group["length"].tolist(), capacity), np.int64)
    group["sequence_id"] = group.pop("grp") * (1 << 32) + bins
    group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
    return group


def pack(documents: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """Pack whole texts into sequences of at most ``capacity`` tokens, one row per piece.

    A null or empty text is the separator alone. Rows are packed as they come: a null id stays null, and repeated
    rows are packed each. An empty table gives no rows. Other columns are ignored. sequence_id: group * 2^32 + bin.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = json_path or public_tokenizers.path("byte_bpe_50k.json")
    groups = max(1, -(-documents.count() // GROUP_DOCS))
    rows = documents.select("doc_id", "text", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("seed"))
    cut = pieces(rows, groups, capacity, path, vocabulary)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut.groupBy("grp").applyInPandas(lambda g: pack_group(g, capacity), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
