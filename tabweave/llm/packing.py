"""Packing by cutting-stock column generation.

Every document's ids are cut into pieces of the sequence length and a rest. A piece's class is its length in units
(rounded up, so a sequence never overflows). Over the histogram of classes a linear program asks for the fewest
sequences; its columns are patterns (how many pieces of each class share a sequence), priced by an unbounded knapsack
dynamic program over the duals until the bound says that no pattern gains anything. Multiplicities are rounded down; what
is left over, a few pieces of each class, is packed first-fit decreasing. Then documents are ranked within their class,
and ranks are dealt to the patterns' slots.

Only the histogram (as many numbers as a sequence has units) and the pattern table (bounded by its square) are on the
driver or broadcast. Ranks are made within (class, bucket of rows) and lifted by the buckets' counts, so a class that holds
a third of all pieces is spread over many tasks.

Edge cases: null and empty texts are documents of one id, the end mark; a text longer than a sequence is cut, exactly
full pieces need no padding; equal lengths rank by bucket and id; repeated rows are packed each; an empty table gives an
empty table; columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, opened

LENGTH, UNIT, END = 2048, 8, 1
#: Remembered chunks of a worker (in each of two generations), and the longest that is remembered.
REMEMBERED, LONGEST = 400_000, 64


class WordBpe:
    """The definition's merges on bytes, for chunks whose normal form and cuts are plain: the ids of lower-cased words.

    A byte that no text has stands for the end of a word; it joins the word's last byte before any other merge, as the
    definition has the two as one symbol from the start.
    """

    MARK = b"\xff"

    def __init__(self, definition: str):
        import tiktoken

        model = json.loads(definition)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256 on
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(c): b for b, c in [*((b, b) for b in printable), *((b, 256 + k) for k, b in enumerate(others))]}
        suffix = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(byte_of[c] for c in (token.removesuffix(suffix) if end else token)) + (self.MARK if end else b"")

        vocab, order = model["vocab"], {bytes([b]): b for b in range(256)}
        for b in range(255):
            order[bytes([b]) + self.MARK] = 256 + b
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            order.setdefault(raw(left + right), len(order))
        self.ids = np.zeros(len(order), "<u4")
        for token, k in vocab.items():
            if all(c in byte_of for c in token.removesuffix(suffix)) and (r := order.get(raw(token))) is not None:
                self.ids[r] = k
        self.piece = tiktoken.Encoding("merges", pat_str=r".+", mergeable_ranks=order, special_tokens={})._core_bpe.encode_single_piece
        self.cut = regex.compile("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+").findall
        #: Printable ASCII and Latin letters that no normal form changes.
        self.plain = regex.compile("[!-~\u00a1-\u00ac\u00ae-\u012f]*").fullmatch

    def encode(self, chunk: str) -> bytes | None:
        """None: the chunk isn't plain."""
        if not self.plain(chunk) or "<|" in chunk:
            return None
        found: list[int] = []
        for word in self.cut(chunk.lower()):
            found += self.piece(word.encode() + self.MARK)
        return self.ids[found].tobytes()


class Memory(dict):
    """ids of chunks, found where they are missing; of two generations the older goes when the younger is full."""

    def __init__(self, find, most: int):
        self.find, self.most, self.old = find, most, {}

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.find(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


class ChunkTokenizer:
    """ids of a text by a tokenizer that drops white space: of its chunks between ASCII white space, remembered."""

    def __init__(self, definition: str):
        self.definition, self.known = definition, None

    def _open(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        whole, merges = Tokenizer.from_str(self.definition), WordBpe(self.definition)

        def find(chunk: bytes) -> bytes:
            text = chunk.decode()
            found = merges.encode(text)
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if found is None else found

        self.known = Memory(find, REMEMBERED)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if self.known is None:
            self._open()
        get = self.known.__getitem__
        return [b"".join(map(get, t.encode().split())) if t else b"" for t in texts]


def cut_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, doc_tokens long, start, length, ids_crc32 long): every document's pieces in order. tokenizer: its JSON definition."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    key = f"tokenizer {hashlib.sha256(tokenizer.encode()).hexdigest()}"
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(key, lambda: ChunkTokenizer(shared.value))
        for part in blocks(batches, "text"):
            row, total, start, size, crc = [], [], [], [], []
            for k, ids in enumerate(own.ids(part.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for a in range(0, n, length):
                    row.append(k), total.append(n), start.append(a), size.append(min(length, n - a)), crc.append(zlib.crc32(ids[4 * a : 4 * (a + length)]))
            arrays = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (total, start, size, crc))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "doc_tokens", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, doc_tokens long, start long, length long, ids_crc32 long")


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack by dynamic programming over the capacity."""
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        fits = np.searchsorted(sizes, w, side="right")
        value[w], pick[w] = value[w - 1], -1
        if fits:
            gain = value[w - sizes[:fits]] + duals[:fits]
            k = int(np.argmax(gain))
            if gain[k] > value[w] + 1e-12:
                value[w], pick[w] = gain[k], k
    pattern, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            pattern[pick[w]] += 1
            w -= int(sizes[pick[w]])
    return float(value[capacity]), pattern


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-4, most: int = 6000) -> list[tuple[np.ndarray, float]]:
    """Patterns and multiplicities of the linear program, by column generation on a revised simplex."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))  # columns are patterns
    inverse = np.diag(1.0 / np.diag(basis))
    x = demand / np.diag(basis)
    bound = 0.0  # no fewer sequences than this, by any duals
    for _ in range(most):
        duals = np.maximum(inverse.sum(0), 0)  # every pattern costs one sequence
        best, pattern = price(duals, sizes, capacity)
        bound = max(bound, (duals * demand).sum() / best)
        if best <= 1 + 1e-9 or bound >= x.sum() * (1 - gap):
            break
        used = np.flatnonzero(pattern)
        direction = (inverse[:, used] * pattern[used]).sum(1)
        ratio = np.where(direction > 1e-9, x / np.maximum(direction, 1e-9), np.inf)
        k = int(np.argmin(ratio))
        if not np.isfinite(ratio[k]):
            break
        basis[:, k] = pattern
        row = inverse[k] / direction[k]
        inverse = inverse - np.outer(direction, row)
        inverse[k] = row
        step = ratio[k]
        x = np.maximum(x - step * direction, 0)
        x[k] = step
    return [(basis[:, k], float(x[k])) for k in range(n)]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern {class: pieces}, sequences), which hold every piece of the histogram exactly once."""
    classes = sorted(c for c, n in histogram.items() if n)
    if not classes:
        return []
    sizes, left = np.array(classes), np.array([histogram[c] for c in classes], np.int64)
    out: Counter = Counter()
    for pattern, x in relaxed(sizes, left.astype(float), capacity):
        a = pattern.round().astype(np.int64)
        if (times := int(min(x + 1e-6, *(left[a > 0] // a[a > 0])))) > 0:
            out[tuple(a.tolist())] += times
            left = left - times * a
    bins: list[list] = []  # [room, pieces by class]; first fit decreasing
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[k])):
            fit = next((b for b in bins if b[0] >= sizes[k]), None)
            if fit is None:
                fit = [capacity, [0] * len(sizes)]
                bins.append(fit)
            fit[0] -= int(sizes[k])
            fit[1][k] += 1
    out.update(tuple(b[1]) for b in bins)
    return [({classes[k]: m for k, m in enumerate(p) if m}, n) for p, n in sorted(out.items(), reverse=True)]


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, rank after the last, pieces a sequence, first sequence, first place in it)."""
    out, taken, sequence = [], Counter(), 0
    for pattern, times in patterns:
        place = 0
        for c, m in sorted(pattern.items(), reverse=True):
            out.append((c, taken[c], taken[c] + m * times, m, sequence, place))
            taken[c] += m * times
            place += m
        sequence += times
    return out


def bucket_count(n: int) -> int:
    """Rank buckets of a class with n pieces: about as many as each bucket has rows."""
    return max(1, math.isqrt(n))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece and its place."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = cut_documents(docs, tokenizer, id_col, text_col, length).withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    pieces = scratch.write(pieces.withColumn("at", F.xxhash64("id", "start", "ids_crc32")), "pieces")
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most length / unit rows
    table = slots(plan(histogram, length // unit))
    lookup = spark.createDataFrame(table, "class int, low long, high long, each long, sequence long, place long")
    parts = [(c, bucket_count(n)) for c, n in histogram.items()]
    buckets = spark.createDataFrame(parts, "class int, parts int")
    dealt = pieces.join(F.broadcast(buckets), "class").withColumn("part", F.pmod("at", "parts").cast("int"))  # at most length / unit rows
    counts = dealt.groupBy("class", "part").agg(F.count("*").alias("n"))
    below = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("class", "part", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"))
    order = Window.partitionBy("class", "part").orderBy("id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(before, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    # a row for each class and pattern, at most (length / unit) ** 2
    placed = ranked.join(F.broadcast(lookup), "class").where("rank >= low and rank < high")
    step = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor(step / F.col("each")).cast("long")).withColumn("place", F.col("place") + step % F.col("each"))
    along = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(along), F.lit(0)).alias("offset"))
