"""Byte-level BPE: a two-tier lookup encodes whole texts, and ids are decoded to bytes.

Tier one is a minimal perfect hash over the vocabulary (hash and displace: the keys of a bucket share the least
displacement that sends all of them to free slots; as many slots as keys): a pre-token that is a vocabulary entry is
resolved by one probe and a comparison. Tier two merges the others: a heap of adjacent pairs by rank and position over
bytes linked left and right, O(n log n) for a pre-token of n bytes however long it is.

Texts are cut before spaces that precede a non-space, where no pre-token spans; each worker remembers the ids of short
chunks and pre-tokens in tables of bounded size. The ids equal those of the rank file's reference tokeniser; decoding them gives the
text's bytes again.

Edge cases: null and empty texts have no ids; text without spaces is one chunk; ties in the heap go to the leftmost pair;
repeated rows stay; an empty table gives an empty table; columns besides the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, opened

_MASK = 2**64 - 1
_STEP, _SPREAD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Remembered chunks and pre-tokens of a worker (of each in two generations), and the longest that is remembered.
REMEMBERED, LONGEST = 250_000, 64


class PerfectHash:
    """Maps n byte strings to 0..n-1 without collisions; other strings are told apart by comparison."""

    def __init__(self, keys: list[bytes], load: int = 4):
        n = len(keys)
        self.size, self.buckets = n, max(1, n // load)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) < n:
            raise ValueError("the keys are not distinct")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift, self.slots, free = [0] * self.buckets, [0] * n, np.ones(n, bool)
        for b in sorted(range(self.buckets), key=lambda b: cuts[b] - cuts[b + 1]):
            own = order[cuts[b] : cuts[b + 1]]
            if not len(own):
                break
            low = 0
            while True:  # try displacements in growing runs
                tries = np.arange(low, low + 64 + 4 * low // 8, dtype=np.uint64)
                at = (self._mixed(hashes[own][None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
                good = free[at].all(1)
                if len(own) > 1:
                    good &= (np.diff(np.sort(at, 1), axis=1) > 0).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    break
                low += len(tries)
            self.shift[b] = low + k
            free[at[k]] = False
            for s, key in zip(at[k].tolist(), own.tolist(), strict=True):
                self.slots[s] = key
        self.keys = [keys[i] for i in self.slots]

    @staticmethod
    def _mixed(h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(_STEP))) * np.uint64(_SPREAD)
        return x >> np.uint64(24)

    def find(self, key: bytes) -> int:
        """The key's number in the list given, or -1."""
        h = xxhash.xxh64_intdigest(key)
        at = ((((h ^ (self.shift[h % self.buckets] * _STEP & _MASK)) * _SPREAD) & _MASK) >> 24) % self.size
        return self.slots[at] if self.keys[at] == key else -1


class Memory(dict):
    """Ids of strings, found where they are missing; of two generations the older goes when the younger is full."""

    def __init__(self, find, most: int):
        self.find, self.most, self.old = find, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.find(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Vocabulary:
    """Tokens by rank, their perfect hash and the pattern that cuts texts; sent to every worker once (its size is that of the vocabulary)."""

    def __init__(self, tokens: dict[bytes, int], pattern: str):
        self.tokens = tokens
        self.words = list(tokens)
        self.ids = [tokens[w] for w in self.words]
        self.hash = PerfectHash(self.words)
        self.bytes_of = dict(zip(self.ids, self.words, strict=True))
        # white space as Unicode has it, whatever the regex library's shorthand holds
        self.pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        order = b"\0".join(sorted(tokens, key=tokens.get)) + self.pattern.encode()
        self.key = f"vocabulary {hashlib.sha256(order).hexdigest()}"
        self._open()

    def _open(self) -> None:
        self._pre = regex.compile(self.pattern).findall
        self._gap = regex.compile(r" \p{White_Space}").search
        self._pieces = Memory(self._piece, REMEMBERED)
        self._rest = Memory(lambda chunk: self._resolve(" " + chunk), REMEMBERED)  # chunks after a space

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_pre", "_gap", "_pieces", "_rest")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._open()

    @classmethod
    def read(cls, ranks: str, pattern: str) -> Vocabulary:
        with open(ranks, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merged(self, piece: bytes) -> list[int]:
        """Merges by rank, then from the left: a heap over linked bytes. Stale pairs are known by their end."""
        n, rank = len(piece), self.tokens.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or not end[i] or end[j] != stop:
                continue
            end[i], after[i], end[j] = stop, after[j], 0
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.tokens[piece[i : end[i]]])
            i = after[i]
        return out

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        k = self.hash.find(raw)
        return np.array(self.merged(raw) if k < 0 else [self.ids[k]], "<u4").tobytes()

    def _resolve(self, chunk: str) -> bytes:
        found = self._pre(chunk)
        return self._pieces[chunk] if len(found) == 1 else b"".join(map(self._pieces.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._gap(text):  # a space before white space: cut by the pattern itself
            return b"".join(map(self._pieces.__getitem__, self._pre(text)))
        first, *rest = text.split(" ")
        return self._resolve(first) + b"".join(map(self._rest.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(id, ids binary, decoded binary): the ids of every whole text, and what they decode to (null without `decode`)."""
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = opened(key, lambda: shared.value)
        for part in blocks(batches, "text"):
            ids = [v.encode(t) for t in part.column(1).to_pylist()]
            back = [v.decode(x) if decode else None for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids binary, decoded binary")


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of ids as `encode_decode` makes them."""
    shared, key = encoded.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = opened(key, lambda: shared.value)
        for part in blocks(batches, "ids"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.decode(x or b"") for x in part.column(1).to_pylist()], pa.binary())], ["id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded binary")
