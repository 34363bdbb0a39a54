"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the hashed byte n-grams (3 to 6, A-Z lower-cased, white space as one kind of blank) that a text holds. Of
labelled texts, the n-grams are kept whose labelled texts differ from what the texts' lengths alone let expect; each
kept one is scaled by the logarithm of the ratio of its (smoothed) counts in the two classes, and a logistic regression
with a ridge penalty on the scaled features gives the weights. Scores are probabilities.

The classifier is fitted on a bounded sample of labelled rows: the `SAMPLE` rows with the least hash of their id, in one
task. Everything is scored: every text in whole, by vectorised look-ups in a table of `2 ** HASH` weights, which is
sent to the workers (4 MiB whatever the data). Labels, languages, sources and ids are no features.

Edge cases: null and empty texts have no features and get the score of the intercept; without labelled rows, or with
one class only, every score is the (smoothed) share of label 1; null labels are not used, repeated labels count as often
as they occur; repeated rows are scored alike; empty tables give empty tables; `scored` passes other columns through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, carried, text_batches, text_bytes, text_digests, trim, without
from .kernel import IS_SPACE, distinct

#: The most labelled rows that the classifier is fitted on.
SAMPLE = 12_000
ORDERS, HASH = (3, 4, 5, 6), 20
#: Least standard score of a kept n-gram, least number of texts with it, smoothing of counts, ridge penalty.
EVIDENCE, OFTEN, SMOOTH, RIDGE = 5.0, 8, 1.0, 2.0
#: Text whose n-grams are made at once (a byte takes some 140 bytes then), features that a step of the regression looks at at once.
PIECE, STEP = 1 << 18, 1 << 18
#: From this score on a text counts as toxic.
THRESHOLD = 0.3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[IS_SPACE] = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (start, bucket) of the n-grams that lie in one text."""
    folded = _FOLD[data].astype(np.uint64) + np.uint64(1)
    end = np.repeat(offsets[1:], np.diff(offsets))
    packed = folded.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(folded) < n:
            return
        packed = (packed[:-1] << np.uint64(9)) | folded[n - 1 :]  # at most 54 bits
        if n in ORDERS:
            h = packed * _ODD
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = np.arange(len(packed)) + n <= end[: len(packed)]
            bucket = (h >> np.uint64(64 - HASH)).astype(np.int32)
            yield (np.flatnonzero(inside), bucket[inside]) if not inside.all() else (np.arange(len(packed)), bucket)


def features(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket), each pair once, of buckets in the mask."""
    found = []
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for start, bucket in grams(data, offsets):
        if mask is not None:
            hit = np.flatnonzero(mask[bucket])
            start, bucket = start[hit], bucket[hit]
        found.append((row[start].astype(np.int64) << HASH) | bucket)
    pairs = distinct(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> HASH, pairs & ((1 << HASH) - 1)


@dataclass
class Model:
    weights: np.ndarray  # by bucket; most are 0
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, bucket = features(data, offsets, self.weights != 0)
        total = self.intercept + np.bincount(row, self.weights[bucket].astype(float), minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    def pack(self) -> bytes:
        return np.float64(self.intercept).tobytes() + self.weights.astype("<f4").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Model:
        return cls(np.frombuffer(raw, "<f4", offset=8).copy(), float(np.frombuffer(raw, "<f8", 1)[0]))


def logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, labels: np.ndarray, columns: int, start: float, ridge: float = RIDGE, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps; the step is the inverse of a bound of the curvature."""
    n = len(labels)

    def summed(by: np.ndarray, x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Sums of value * x[at] by `by`, without an array as long as all features."""
        out = np.zeros(size)
        for k in range(0, len(value), STEP):
            part = slice(k, k + STEP)
            out += np.bincount(by[part], value[part] * x[at[part]], minlength=size)
        return out

    # bound of the largest eigenvalue of X'X by power iteration
    v = np.ones(columns) / max(1, columns) ** 0.5
    top = 1.0
    for _ in range(20):
        u = summed(row, v, column, n)
        v = summed(column, u, row, columns)
        top = max(float(np.linalg.norm(v)), 1e-9)
        v /= top
    rate = 1.0 / (0.25 * (1.2 * top + n) + ridge)
    w = np.zeros(columns + 1)
    w[-1] = start
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(summed(row, ahead, column, n) + ahead[-1], -40, 40)))
        error = p - labels
        gradient = np.append(summed(column, error, row, columns) + ridge * ahead[:-1], error.sum())
        new = ahead - rate * gradient
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w[:-1], float(w[-1])


def fit_blocks(parts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """parts: blocks of texts (bytes, offsets) in the labels' order."""
    n = len(labels)
    share = (labels.sum() + SMOOTH) / (n + 2 * SMOOTH)
    plain = Model(np.zeros(1 << HASH, np.float32), float(np.log(share / (1 - share))))
    if not n or labels.min() == labels.max():
        return plain
    sizes = np.concatenate([np.diff(o) for _, o in parts])
    # the share of label 1 among texts of like length: what an n-gram's texts would have by their lengths alone
    order = np.argsort(sizes, kind="stable")
    expected = np.empty(n)
    for group in np.array_split(order, max(1, min(20, n // 100))):
        expected[group] = (labels[group].sum() + share) / (len(group) + 1)
    ones, with_it, hoped, spread = (np.zeros(1 << HASH) for _ in range(4))
    at = 0
    for data, offsets in parts:  # a block's features at a time
        row, bucket = features(data, offsets)
        row += at
        at += len(offsets) - 1
        for total, weight in ((ones, labels), (with_it, None), (hoped, expected), (spread, expected * (1 - expected))):
            total += np.bincount(bucket, None if weight is None else weight[row], minlength=1 << HASH)
    kept = np.flatnonzero(with_it >= OFTEN)
    kept = kept[np.abs(ones[kept] - hoped[kept]) >= EVIDENCE * np.sqrt(spread[kept] + 1e-9)]
    if not len(kept):
        return plain
    # what a class would count without the lengths' effect: observed over expected, both smoothed
    ones, with_it, hoped = ones[kept], with_it[kept], hoped[kept]
    zeros, rest = with_it - ones, with_it - hoped
    ratio = np.log((ones + SMOOTH) / (hoped + SMOOTH)) - np.log((zeros + SMOOTH) / (rest + SMOOTH))
    mask, place = np.zeros(1 << HASH, bool), np.zeros(1 << HASH, np.int32)
    mask[kept], place[kept] = True, np.arange(len(kept))
    rows, columns, at = [], [], 0
    for data, offsets in parts:
        row, bucket = features(data, offsets, mask)
        rows.append((row + at).astype(np.int32)), columns.append(place[bucket])
        at += len(offsets) - 1
    row, column = np.concatenate(rows), np.concatenate(columns)
    del rows, columns, spread, place
    weights, intercept = logistic(row, column, ratio.astype(np.float32)[column], labels.astype(float), len(kept), plain.intercept)
    plain.weights[kept] = weights * ratio
    plain.intercept = intercept
    return plain


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", order_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of (text, label 0 or 1), fitted on at most `sample` rows, those with the least hash of order_col."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels = [], []
        for part in blocks(batches, "text", PIECE):
            parts.append(text_bytes(part.column(0)))
            labels += part.column(1).to_pylist()
        model = fit_blocks(parts, np.array(labels, np.int64)).pack()
        del parts
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"), F.xxhash64(order_col, text_col).alias("at"))
    rows = rows.orderBy("at", "label", "text").limit(sample)
    with text_batches(labelled.sparkSession):
        found = rows.select("text", "label").coalesce(1).mapInArrow(run, "model binary").collect()  # one row of fixed size
    return Model.unpack(bytes(found[0].model)) if found else Model(np.zeros(1 << HASH, np.float32), 0.0)


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] | None = None, to: str = "score") -> DataFrame:
    """The rows (all columns, or `keep`) with a column `to` (double), the score of every whole text; `to` must be a new name."""
    shared = docs.sparkSession.sparkContext.broadcast(model.pack())  # of fixed size
    keep = tuple(docs.columns) if keep is None else keep
    if to in keep:
        raise ValueError(f"there is a column {to!r} already; name another one")

    rows, at, schema = carried(docs, text_col, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.unpack(shared.value)
        for part in blocks(batches, text_col, PIECE):
            found = own.score(*text_bytes(part.column(at)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found)], [*keep, to])

    return rows.mapInArrow(run, f"{schema}, `{to}` double")


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, all columns, whatever their names."""
    text = F.col(text_col).cast("string")
    marked = scored(docs.select(*text_digests(text), text.alias("text")), model, "text", ("d1", "d2"))
    toxic = Scratch(docs.sparkSession, "toxicity").write(marked.where(F.col("score") >= threshold).select("d1", "d2").distinct(), "toxic")
    return without(docs, toxic, text_col)


def held_out(id_col: str):
    """Rows that labels are not learnt from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Joins the labels to their texts, without held-out rows, and fits on the bounded sample.

    The sample is chosen among the labels alone, so only its texts are fetched.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return fit(texts.join(F.broadcast(chosen), "id").select("id", "text", "label"), order_col="id", sample=2 * sample)  # broadcast: at most `sample` rows
