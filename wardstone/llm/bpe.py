"""Byte-level BPE by ranks, on padded matrices, and decoding.

New pieces (matches of the split pattern) of a block of texts are put into matrices by length, padded
to a power of two, one row each. In each round every row merges its leftmost pair of minimum rank;
ranks are looked up in an open hash table of all pairs; merged columns close up, and rows without a
further pair leave the matrix. Pieces of more than 256 bytes, for which rounds over a matrix grow with
the square of the length, are merged with a heap instead, in the same order.

Defined results: a null text counts as empty and gives no ids. Special strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._pieces import Remembered, text_blocks
from ._store import ship

NONE = np.int32(2**31 - 1)
WIDEST = 256


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.token = {i: t for t, i in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.bits = max(self.token).bit_length()
        pairs = {}
        for t, i in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << self.bits | b] = i
        self.pairs = pairs
        self._table(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.remembered = Remembered(self.find, self._pieces)

    def _table(self, keys: np.ndarray, ids: np.ndarray) -> None:
        size = 1 << max(10, (8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.slot_key, self.slot_id = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at[left]] < 0
            slots, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.slot_key[slots], self.slot_id[slots] = keys[won], ids[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id (its rank) that each pair merges to, or NONE."""
        key = (left.astype(np.int64) << self.bits) | right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        out = np.full(key.shape, NONE, np.int32)
        for _ in range(self.probes):
            hit = self.slot_key[at] == key
            np.copyto(out, self.slot_id[at], where=hit)
            at = (at + 1) & self.mask
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        m = self.byte[raw]
        m[np.arange(width) >= size[:, None]] = -1
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.lookup(m[:, :-1], m[:, 1:])
        row, out = np.arange(n), [None] * n
        while len(row):
            at = rank.argmin(axis=1)
            here = np.arange(len(row))
            best = rank[here, at]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[row[k]] = m[k, : size[k]].copy()
                go = ~done
                m, rank, row, size, at, best = m[go], rank[go], row[go], size[go], at[go], best[go]
                here = np.arange(len(row))
                if not len(row):
                    break
                used = int(size.max())
                m, rank = m[:, :used], rank[:, :used]
            m[here, at] = best
            col = np.arange(m.shape[1] - 1)
            take = col + (col > at[:, None])
            m, rank = np.take_along_axis(m, take, 1), np.take_along_axis(rank, take, 1)
            size -= 1
            after = np.where(at + 1 < m.shape[1], m[here, np.minimum(at + 1, m.shape[1] - 1)], -1)
            after[at + 1 >= size] = -1
            rank[here, at] = self.lookup(best, after)
            k = np.flatnonzero(at > 0)
            rank[k, at[k] - 1] = self.lookup(m[k, at[k] - 1], best[k])
            m[here, np.minimum(size, m.shape[1] - 1)] = np.where(size < m.shape[1], -1, m[here, -1])
            rank[here, size - 1] = NONE
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs, bits = len(ids), self.pairs, self.bits
        nxt, prev = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << bits | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], k = r, -1, nxt[j]
            nxt[i] = k
            if k >= 0:
                prev[k] = i
                if (x := pairs.get(r << bits | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := prev[i]) >= 0 and (x := pairs.get(ids[h] << bits | r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (i := self.ranks.get(p)) is not None:
                out[k] = np.array([i], np.int32)
            elif len(p) > WIDEST:
                out[k] = self._long(p)
            else:
                buckets.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
        for width, ks in buckets.items():
            step = max(1, (1 << 20) // width)
            for s in range(0, len(ks), step):
                some = ks[s : s + step]
                for k, ids in zip(some, self._matrix([pieces[k] for k in some], width), strict=True):
                    out[k] = ids
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return [v.astype("<u4").tobytes() for v in self.encode_pieces([p.encode() for p in pieces])]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for found in self.remembered(texts):
            yield np.frombuffer(b"".join(found), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    @property
    def decimal(self) -> dict[int, str]:
        if not hasattr(self, "_decimal"):
            self._decimal = {i: str(i) for i in self.token}
        return self._decimal


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _digests(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(1)):
                n, hashed, back, kept = [], [], [], []
                for ids in c.encode(texts):
                    own = ids.tolist()
                    n.append(len(own))
                    hashed.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, own)).encode()).hexdigest())
                    back.append(hashlib.sha256(c.decode(own)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                columns = [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cut = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(kept).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", row_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 (of the ids decoded again), and the ids if asked for."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["id"].dataType
    fields = [T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return docs.mapInArrow(_digests(path, pattern, keep_ids), T.StructType(fields)).withColumnRenamed("id", row_id)
