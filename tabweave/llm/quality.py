"""Quality rules: exact base statistics of whole texts, then robust multivariate outliers per language and source.

Base statistics come from one vectorised pass over the text bytes. The method: every document that passes the base
rules becomes a vector of transformed statistics; for each (language, source) the minimum-covariance-determinant
estimate of centre and scatter is sought: of all sets of `SHARE` of the rows, that whose scatter has the least
determinant. From three deterministic starts, concentration steps (keep the share of rows nearest to the present
estimate, estimate again) lower the determinant until it settles; the least of all starts is kept. A document is
rejected if its squared Mahalanobis distance exceeds a chi-square quantile.

Concentration steps are aggregations over all rows: distances by expressions, the share's limit by a mergeable
percentile (off by a ten-thousandth of the rows at most), moments by sums that are added up before the shuffle, so a
source with a third of all rows is no single task's burden. Only the moments of each group go through a small pandas
function (a matrix inverse). Each coordinate's variance has a floor added, below which differences are no evidence (the
determinant is that of the scatter with the floors, so constant statistics are defined). A group's estimate is that of
its rows mixed with `LEAST` rows of the whole table's: groups of a few rows are judged by all rows, large ones by
themselves, without a size at which one turns into the other.

Edge cases: a null or empty text has zero statistics and fails the base rules (fewer than 20 words); null languages and
sources are groups of their own; repeated rows count as often as they occur; rows at equal distances at a share's limit
all belong to it, and a distance equal to the cutoff is kept; very long texts are blocks of their own; an empty table
gives an empty table; other columns are not read (`reject_outliers` passes them through, whatever their names).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, carried, text_bytes, text_digests, without
from .kernel import Words, mix, span_hashes, windows

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the vectors use besides: words equal to the word before them.
STATISTICS = (*BASE, "n_same_words")
#: Words of a window for repeated words.
WINDOW = 8
#: The symbols that count, as bytes.
SYMBOLS = b"#*$%&|<>"
#: The share of a group's rows that an estimate rests on.
SHARE = 0.75


def chi_square(x: float, freedom: int) -> float:
    """The chi-square law's probability up to x, by the series of the incomplete gamma function."""
    a, x = freedom / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi_square_limit(share: float, freedom: int) -> float:
    """Up to where the chi-square law has the probability `share`."""
    low, high = 0.0, 10.0 * freedom + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < share else (low, middle)
    return low


def consistency(share: float, freedom: int) -> float:
    """What the scatter of the nearest `share` of normal rows is multiplied with, to be that of all rows."""
    return share / chi_square(chi_square_limit(share, freedom), freedom + 2) if share < 1 else 1.0


#: A document is rejected from this squared distance on: one of a million normal ones.
CUTOFF = chi_square_limit(1 - 1e-6, 5)
#: A start has settled when a step lowers the log-determinant by less.
SETTLED = 1e-4
#: Least variance of each coordinate: word length (log), symbols a word (square root), repeated lines, repeated words, words
#: equal to the one before (square root).
FLOORS = (0.03**2, 0.12**2, 0.05**2, 0.06**2, 0.12**2)
#: A group of so many rows counts half in its estimate, and all rows the other half.
LEAST = 20


def base_block(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """STATISTICS of each text in a block."""
    rows = len(offsets) - 1
    words = Words(data, offsets)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    upto = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.starts] += 1
    np.subtract.at(inside, words.ends, 1)
    code_points = ((data & 0xC0) != 0x80) & np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    # lines: of each text the line feeds, and its end
    feeds = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate((feeds, offsets[1:])), kind="stable")
    row = np.concatenate((np.searchsorted(offsets, feeds, side="right") - 1, np.arange(rows)))[np.argsort(np.concatenate((feeds, offsets[1:])), kind="stable")]
    order = np.lexsort((ends, row))
    ends, row = ends[order], row[order]
    starts = np.empty_like(ends)
    starts[1:] = np.where(row[1:] == row[:-1], ends[:-1] + 1, offsets[row[1:]])
    starts[:1] = 0
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[full], ends[full], row[full]
    line = span_hashes(data, starts, ends)
    order = np.lexsort((line, row))
    again = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
    dup_lines = np.bincount(row[order][1:][again], minlength=rows)
    # words in windows that occur twice or more in their text
    repeated = np.zeros(rows, np.int64)
    hashes = words.hashes()
    same_words = np.bincount(words.row[1:][(hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])], minlength=rows)
    at = np.flatnonzero(words.room(WINDOW))
    if len(at):
        key = windows(hashes, WINDOW)[at] ^ mix(words.row[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.subtract.at(cover, at[twice] + WINDOW, 1)
        repeated = np.bincount(words.row[np.cumsum(cover)[:-1] > 0], minlength=rows)
    return [words.counts, upto(code_points), upto(is_symbol[data]), dup_lines, repeated, same_words]


def base_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns `keep` and STATISTICS (long) of every whole text."""

    rows, at, schema = carried(docs, text_col, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text_col):
            found = base_block(*text_bytes(part.column(at)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(x.astype(np.int64)) for x in found)], [*keep, *STATISTICS])

    return rows.mapInArrow(run, ", ".join([schema, *(f"{c} long" for c in STATISTICS)]))


def base_failed():
    """Too short, or over 30 of 100 words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vector():
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log1p(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n), F.col("n_dup_lines") / F.sqrt(n), F.col("n_repeat_words") / n, F.sqrt(F.col("n_same_words") / n)]


def _products(x: list) -> list:
    """Aggregates: count, sums, sums of products."""
    out = [F.count(x[0]).cast("double").alias("w")] + [F.sum(a).alias(f"s_{i}") for i, a in enumerate(x)]
    return out + [F.sum(a * b).alias(f"p_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]


ESTIMATE = "grp string, start int, centre array<double>, scatter array<double>, inverse array<double>, logdet double"


def _estimates(moments: DataFrame, floors: tuple[float, ...], how: Callable[[dict, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """ESTIMATE of each row of moments: how(row, mean, covariance) gives (start, centre, scatter)s."""
    p, unit = len(floors), np.sqrt(np.outer(floors, floors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                w = max(r["w"] or 0.0, 1.0)
                m = np.array([r[f"s_{i}"] or 0.0 for i in range(p)]) / w
                c = np.array([[r[f"p_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)]) / w
                for start, centre, scatter in how(r, m, c):
                    inverse, logdet = _inverse(scatter, unit)
                    out.append((r["grp"], start, centre.tolist(), scatter.ravel().tolist(), inverse.ravel().tolist(), logdet))
            yield pd.DataFrame(out, columns=["grp", "start", "centre", "scatter", "inverse", "logdet"])

    return moments.mapInPandas(run, ESTIMATE)


def _inverse(scatter: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log-determinant (in units of the floors) of the scatter with the floors added to its diagonal."""
    scatter = (scatter + scatter.T) / 2
    values, vectors = np.linalg.eigh(scatter / unit)
    values = np.maximum(values, 0) + 1.0
    return (vectors / values) @ vectors.T / unit, float(np.log(values).sum())


def _distance(x: list[str]):
    p = len(x)
    d = [F.col(a) - F.col("centre")[i] for i, a in enumerate(x)]
    return sum((d[i] * d[j] * F.col("inverse")[i * p + j] * (1.0 if i == j else 2.0) for i in range(p) for j in range(i, p)), F.lit(0.0))


def _starts(rows: DataFrame, scratch: Scratch, x: list[str], floors: tuple[float, ...]) -> DataFrame:
    """ESTIMATE of three starts for each group, without drawing rows.

    Medians with the floors, medians with the squared median deviations, and all rows' mean and scatter.
    """
    p = len(x)
    middle = scratch.write(rows.groupBy("grp").agg(*(F.percentile_approx(a, 0.5, 2000).alias(f"m_{i}") for i, a in enumerate(x))), "middle")
    spread = [F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{i}")), 0.5, 2000).alias(f"d_{i}") for i, a in enumerate(x)]
    moments = rows.join(middle, "grp").groupBy("grp").agg(*_products([F.col(a) for a in x]), *spread, *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(p)])

    def how(r: dict, m: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        median = np.array([r[f"m_{i}"] or 0.0 for i in range(p)])
        yield 0, median, np.zeros((p, p))
        # a median deviation of normal values is 0.6745 of their standard deviation
        yield 1, median, np.diag([((r[f"d_{i}"] or 0.0) / 0.6745) ** 2 for i in range(p)])
        yield 2, m, c - np.outer(m, m)

    return _estimates(moments, floors, how)


def _concentrated(rows: DataFrame, now: DataFrame, scratch: Scratch, x: list[str], floors: tuple[float, ...], share: float, scale: float, tag: str) -> DataFrame:
    """ESTIMATE after one step: of the `share` of a group's rows that are nearest by the present one."""
    far = rows.join(now.select("grp", "start", "centre", "inverse"), "grp").withColumn("d", _distance(x))
    # written, so that its size is known: rows of a group are joined where they are unless there are very many groups
    limit = scratch.write(far.groupBy("grp", "start").agg(F.percentile_approx("d", share, 10_000).alias("limit")), f"limit{tag}")
    near = far.join(limit, ["grp", "start"]).where(F.col("d") <= F.col("limit"))
    moments = near.groupBy("grp", "start").agg(*_products([F.col(a) for a in x]))

    def how(r: dict, m: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        yield int(r["start"]), m, (c - np.outer(m, m)) * scale

    return scratch.write(_estimates(moments, floors, how), f"step{tag}")


def mcd(vectors: DataFrame, scratch: Scratch, x: list[str], floors: tuple[float, ...] = FLOORS, share: float = SHARE, least: int = LEAST, most_steps: int = 100) -> DataFrame:
    """(grp, centre, inverse): robust centre and inverse scatter for each grp of `vectors` (columns grp and x).

    From every start steps are made until its determinant settles; the least determinant of all wins.
    """
    scale = consistency(share, len(x))
    rows = vectors.select("grp", *x)
    rows = rows.unionByName(rows.withColumn("grp", F.lit("*")))  # "*": all rows
    sizes = scratch.write(rows.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
    now = scratch.write(_starts(rows, scratch, x, floors), "starts")
    now, found = _concentrated(rows, now, scratch, x, floors, share, scale, "0"), []
    found.append(now)
    for k in range(1, most_steps):
        after = _concentrated(rows, now, scratch, x, floors, share, scale, f"{k}")
        found.append(after)
        before = now.select("grp", "start", F.col("logdet").alias("before"))
        now = after.join(before, ["grp", "start"]).where(F.col("before") - F.col("logdet") >= SETTLED).drop("before")
        if now.isEmpty():
            break
    else:
        raise RuntimeError("the determinants have not settled")
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    best = every.groupBy("grp").agg(F.min_by(F.struct("centre", "scatter"), F.struct("logdet", "start")).alias("e")).join(sizes, "grp").select("grp", "n", "e.centre", "e.scatter")
    best = scratch.write(best, "best")
    whole = best.where("grp = '*'").select(F.col("centre").alias("c0"), F.col("scatter").alias("s0"), F.lit(0).alias("z"))
    own = best.where("grp != '*'").withColumn("z", F.lit(0)).join(F.broadcast(whole), "z", "left").drop("z")  # one row
    p, unit = len(x), np.sqrt(np.outer(floors, floors))

    def mixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A group's rows and `least` rows of all: the mixture's centre and scatter."""
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                w = r["n"] / (r["n"] + least)
                apart = np.array(r["centre"]) - np.array(r["c0"])
                scatter = w * np.array(r["scatter"]).reshape(p, p) + (1 - w) * np.array(r["s0"]).reshape(p, p) + w * (1 - w) * np.outer(apart, apart)
                out.append((r["grp"], (np.array(r["c0"]) + w * apart).tolist(), _inverse(scatter, unit)[0].ravel().tolist()))
            yield pd.DataFrame(out, columns=["grp", "centre", "inverse"])

    return own.mapInPandas(mixed, "grp string, centre array<double>, inverse array<double>")


_X = [f"__x{i}" for i in range(len(FLOORS))]


def _grouped(stats: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """Statistics with the base verdict, the group's key and the vector."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    key = F.concat(part(lang_col), F.lit("\u0001"), part(source_col))
    return stats.withColumn("base_failed", base_failed()).withColumn("grp", key).select("*", *(v.alias(a) for a, v in zip(_X, _vector(), strict=True)))


def _verdicts(grouped: DataFrame, estimates: DataFrame, cutoff: float) -> DataFrame:
    found = grouped.join(estimates, "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance(_X)))
    found = found.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
    return found.drop("grp", "centre", "inverse", *_X)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """(id, language, source, statistics, base_failed, distance, kept) for every document."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.write(_grouped(base_statistics(docs, text_col, (id_col, lang_col, source_col)), lang_col, source_col), "stats")
    return _verdicts(stats, mcd(stats.where(~F.col("base_failed")), scratch, _X), cutoff)


def reject_outliers(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The documents that are kept, all columns, whatever their names."""
    scratch = Scratch(docs.sparkSession, "quality")
    text = F.col(text_col).cast("string")
    plain = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *text_digests(text), text.alias("text"))
    stats = scratch.write(_grouped(base_statistics(plain, "text", ("lang", "source", "d1", "d2")), "lang", "source"), "stats")
    found = _verdicts(stats, mcd(stats.where(~F.col("base_failed")), scratch, _X), cutoff)
    rejected = scratch.write(found.where(~F.col("kept")).select("d1", "d2", F.col("lang").alias(lang_col), F.col("source").alias(source_col)).distinct(), "rejected")
    scratch.drop("stats")
    return without(docs, rejected, text_col, (lang_col, source_col))
