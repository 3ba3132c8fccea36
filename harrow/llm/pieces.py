"""SentencePiece encoding and decoding by vectorised merge rounds.

The words of a batch lie in one flat array of symbols. In a round every word finds its best adjacent pair (a segmented
minimum over pair ranks), all words merge its leftmost occurrences at once, and the array is compacted; words without
a pair leave. A text is the concatenation of its words: pieces hold white space at their front only, so no merge
crosses from a character to a following space.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import LongMap, slices

SPACE = "▁"
MEMORY = 250_000
_SAFE = re.compile(f"(?<=[^ {SPACE}]) (?=[^ {SPACE}])")
_ODD = re.compile(f"  | $|^ |{SPACE}")
_models: dict = {}


class Pieces:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix, as tables for merge rounds."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        if sp.encode(" a  b ", out_type=str)[0][0] != SPACE or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the model isn't one of leading white space with a dummy prefix")
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        scores = np.array([sp.get_score(i) for i in range(n)])
        order = np.unique(-scores[plain], return_inverse=True)[1]
        rank = dict(zip(plain, order.tolist(), strict=True))
        pairs, made = [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right), made.append(rank[i] << 32 | i)
        self.pairs = LongMap(np.array(pairs, np.uint64), np.array(made, np.int64))
        self.decoded = [(names[i].replace(SPACE, " ").encode(), False) if i in rank else (b"", False) for i in range(n)]
        for b, i in enumerate(self.bytes.tolist()):
            self.decoded[i] = (bytes([b]), True)
        for i in range(n):
            if sp.is_unknown(i):
                self.decoded[i] = (" ⁇ ".encode(), False)
        self.raw, self.is_byte = [d[0] for d in self.decoded], frozenset(self.bytes.tolist())
        self.points = np.full(0x110000, -1, np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.points[ord(piece)] = i
        self.names = [str(i) for i in range(n)]
        self.words: dict[str, tuple[str, list[int]]] = {}
        self.older = self.words

    NONE = np.int64(1 << 62)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each with a space put before it, and the n+1 places where the words' ids begin."""
        points = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), "<u4").astype(np.int64)
        own = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
        sym = self.points[points]
        if (rare := np.flatnonzero(sym < 0)).size:  # byte fallback; bytes take no part in merges
            raw = [chr(c).encode() for c in points[rare].tolist()]
            counts = np.ones(len(sym), np.int64)
            counts[rare] = [len(r) for r in raw]
            sym, own = np.repeat(sym, counts), np.repeat(own, counts)
            sym[sym < 0] = -1 - np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        done_sym, done_own, done_pos = [], [], []
        pos = np.arange(len(sym))  # merges keep the first symbol's place
        while len(sym):
            best = self._ranks(sym, own)
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            low = np.minimum.reduceat(best, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            low_each = np.repeat(low, sizes)
            live = low_each < self.NONE
            if not live.all():
                done_sym.append(sym[~live]), done_own.append(own[~live]), done_pos.append(pos[~live])
                sym, own, pos, best, low_each = sym[live], own[live], pos[live], best[live], low_each[live]
                if not len(sym):
                    break
            hit = best == low_each
            at = self._leftmost(sym, own, best, hit)
            sym[at] = best[at] & 0xFFFFFFFF
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, own, pos = sym[keep], own[keep], pos[keep]
        sym, own, pos = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (done_sym, done_own, done_pos))
        order = np.argsort(pos, kind="stable")
        sym, own = sym[order], own[order]
        sym = np.where(sym < 0, self.bytes[np.where(sym < 0, -1 - sym, 0)], sym).astype("<i4")
        ends = np.searchsorted(own, np.arange(len(words) + 1))
        return sym, ends

    def _ranks(self, sym: np.ndarray, own: np.ndarray) -> np.ndarray:
        """rank << 32 | piece of the pair that begins at each symbol; NONE without one."""
        out = np.full(len(sym), self.NONE)
        ok = np.flatnonzero((own[1:] == own[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0))
        out[ok] = self.pairs.get((sym[ok] << 32 | sym[ok + 1]).view(np.uint64), self.NONE)
        return out

    def _leftmost(self, sym: np.ndarray, own: np.ndarray, best: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Places to merge: each word's leftmost best pair, and its other ones that don't overlap where the order can't matter."""
        at = np.flatnonzero(hit)
        run = np.r_[True, (np.diff(at) != 1) | (own[at[1:]] != own[at[:-1]])]
        begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        # pairs equal in rank may differ in piece: keep those of the first occurrence's piece
        first = np.flatnonzero(np.r_[True, own[at[1:]] != own[at[:-1]]])
        many = np.diff(np.r_[first, len(at)])
        if (many == 1).all():
            return at
        lead = np.repeat(first, many)
        piece, rank = best[at] & 0xFFFFFFFF, best[at] >> 32
        n = len(sym)
        after, before = np.minimum(at + 2, n - 1), np.maximum(at - 1, 0)
        next_ok, prev_ok = (at + 2 < n) & (own[after] == own[at]) & (sym[after] >= 0), (at > 0) & (own[before] == own[at]) & (sym[before] >= 0)
        worse = np.zeros(len(at), bool)
        for ok, left, right in ((next_ok, piece, sym[after]), (prev_ok, sym[before], piece), (next_ok, piece, piece)):
            made = np.full(len(at), self.NONE)
            i = np.flatnonzero(ok)
            made[i] = self.pairs.get((left[i] << 32 | right[i]).view(np.uint64), self.NONE)
            worse |= (made >> 32) <= rank
        worse |= best[at] != best[at[lead]]
        single = np.repeat(np.bitwise_or.reduceat(worse, first), many)
        return at[~single | (np.arange(len(at)) == lead)]

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of every whole text: the number of ids, the ids in decimal joined by commas, and the text they decode to.

        Ids are put together from the words', as they never run from one word into the next; the text is decoded from the ids.
        """
        split = [[] if not t else t.split(" ") if not _ODD.search(t) else [p.replace(" ", SPACE) for p in _SAFE.split(t)] for t in texts]
        if len(self.words) > MEMORY:
            self.older, self.words = self.words, {}
        known, older = self.words, self.older
        new = []
        for w in set().union(*split).difference(known):
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
        if new:
            sym, ends = self.merge(new)
            listed, bounds = sym.tolist(), ends.tolist()
            decimals = [self.names[i] for i in listed]
            for w, a, b in zip(new, bounds[:-1], bounds[1:], strict=True):
                known[w] = (",".join(decimals[a:b]), listed[a:b])
        out = []
        for parts in split:
            found = [known[p] for p in parts]
            ids = list(itertools.chain.from_iterable([f[1] for f in found]))
            out.append((len(ids), ",".join([f[0] for f in found]), self.decode(ids)))
        for w in new:
            if len(w) > 64:
                del known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, as the library gives it: the dummy prefix goes, bytes that aren't UTF-8 become U+FFFD each."""
        raw, is_byte = self.raw, self.is_byte
        if is_byte.isdisjoint(ids):
            text, front = b"".join([raw[i] for i in ids]).decode(), False
        else:
            runs = [(byte, b"".join([raw[i] for i in run])) for byte, run in itertools.groupby(ids, is_byte.__contains__)]
            text, front = "".join([_lossy(r) if byte else r.decode() for byte, r in runs]), runs[0][0]
        return text[1:] if text[:1] == " " and not front else text


def _lossy(raw: bytes) -> str:
    """Bytes as UTF-8; each byte that can't be part of a character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_documents(documents: DataFrame, model_path: str | None = None, keep: bool = False) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with ``keep``).

    A null or empty text has no ids and decodes to the empty text. Rows are taken as they come (repeats give repeats,
    a null id stays null); an empty table gives none; other columns are ignored.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                done = pieces.encode(part.column(1).to_pylist())
                columns = [
                    part.column(0),
                    pa.array([d[0] for d in done], pa.int64()),
                    pa.array([hashlib.sha256(d[1].encode()).hexdigest() for d in done], pa.string()),
                    pa.array([hashlib.sha256(d[2].encode()).hexdigest() for d in done], pa.string()),
                ]
                heads = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns += [pa.array([[int(i) for i in d[1].split(",") if i] for d in done], pa.list_(pa.int32())), pa.array([d[2] for d in done], pa.string())]
                    heads += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, heads)

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep)
