"""Evaluation of rankings, aggregation over runs, corpus statistics, write-back of chosen answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1_score", "top1_acc", "top5_acc", "topall_acc", "answered_rate")


def _plain(y: str):
    return F.transform(y, lambda v: F.lower(F.trim(v)))


def evaluate(predictions: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (for each of `by`): predictions(x, y, score) against truth(x, y). Unanswered queries count in the rates."""
    by = by or []
    order = Window.partitionBy(*by, "x").orderBy(F.desc("score"), "y")
    ranked = predictions.select(*by, "x", "y", "score").withColumn("rank", F.row_number().over(order))
    right = truth.select(*by, "x", F.col("y").alias("truth"))
    same = F.coalesce(_plain("y") == _plain("truth"), F.lit(False))
    per = right.join(ranked, [*by, "x"], "left").groupBy(*by, "x", "truth").agg(
        F.max((F.col("rank").isNotNull()).cast("int")).alias("answered"),
        F.max((same & (F.col("rank") == 1)).cast("int")).alias("top1"),
        F.max((same & (F.col("rank") <= 5)).cast("int")).alias("top5"),
        F.max(same.cast("int")).alias("topall"),
    )
    rows = per.groupBy(*by) if by else per
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("answered", "top1", "top5", "topall")])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = sums.withColumn("precision", share("top1", "answered")).withColumn("recall", share("top1", "n"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.select(*by, "precision", "recall", f1.alias("f1_score"), share("top1", "n").alias("top1_acc"), share("top5", "n").alias("top5_acc"), share("topall", "n").alias("topall_acc"), share("answered", "n").alias("answered_rate"))


def over_repeats(runs: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and population deviation of each metric over repeats; a missing value counts as 0."""
    value = lambda m: F.coalesce(F.col(m), F.lit(0.0))
    return runs.groupBy(*by).agg(*[f(value(m)).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def over_exercises(results: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Means over exercises; missing values are left out."""
    return results.agg(*[F.avg(m).alias(m) for m in metrics])


def table_statistics(cells: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One row: how many tables, and their lengths' spread."""
    lengths = cells.groupBy("tableid").agg(F.count_distinct("rowid").alias("length"))
    at = F.percentile_approx("length", F.array(*map(F.lit, (0.5, 0.25, 0.75, 0.9, 0.99))), accuracy)
    names = ("median_length", "p25", "p75", "p90", "p99")
    out = lengths.agg(F.count("*").alias("table_count"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.avg("length").alias("avg_length"), F.stddev_samp("length").alias("std_length"), at.alias("q"))
    return out.select("table_count", "min_length", "max_length", "avg_length", "std_length", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def term_counts(cells: DataFrame, most: int | None = 10_000) -> DataFrame:
    """(tokenized, term_count), the most frequent; ties by token."""
    counts = cells.groupBy("tokenized").agg(F.count("*").alias("term_count"))
    return counts if most is None else counts.orderBy(F.desc("term_count"), "tokenized").limit(most)


def cell_count(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("*").alias("cell_count"))


def write_back(df: DataFrame, chosen: DataFrame, x_cols: list[str], y_cols: list[str]) -> DataFrame:
    """The rows with chosen answers (x array, y array) where an output is null; each column keeps its type."""
    # an input has one chosen answer: the first in order
    picked = chosen.groupBy(F.col("x").alias("__x")).agg(F.min("y").alias("__y"))
    match = reduce(lambda a, b: a & b, (F.col(f"`{c}`").cast("string") == F.col("__x")[i] for i, c in enumerate(x_cols)))
    kinds = {f.name: f.dataType for f in df.schema}
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.col("__y")[i].try_cast(kinds[c])) for i, c in enumerate(y_cols)}
    return df.join(picked, match, "left").select(*[filled.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
