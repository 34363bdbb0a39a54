"""Sinks: tokenised files, chosen answers, result grids, experiment logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import text as T
from ..sources.corpus import read_raw_rows


def tokenized_path(path: str) -> str:
    """Beside the input: name_tokenized."""
    return path.removesuffix(".csv") + "_tokenized"


def write_tokenized(spark: SparkSession, path: str, config: IndexConfig | None = None) -> str | None:
    """The file with all values tokenised, the header like other rows; nothing for files that are tokenised already."""
    if path.removesuffix(".csv").endswith("_tokenized"):
        return None
    raw = read_raw_rows(spark, path)
    raw.select(*[T.standard_tokens(F.col(c), config).alias(c) for c in raw.columns]).write.mode("overwrite").option("header", False).option("emptyValue", "").csv(tokenized_path(path))
    return tokenized_path(path)


def write_answers(df: DataFrame, path: str, header: bool = True) -> None:
    """A file as it was uploaded: with a header only if that had one."""
    df.write.mode("overwrite").option("header", header).csv(path)


def result_grid(ranked: DataFrame, least: float = 0.01) -> DataFrame:
    """(x, candidates): each input's answers from a probability on, best first, as text."""
    shown = ranked.where(F.col("score") >= least).withColumn("label", T.candidate_label(F.array_join("y", ", "), F.col("score")))
    listed = shown.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("rank", "label"))).alias("l"))
    return listed.select("x", F.transform("l", lambda e: e["label"]).alias("candidates"))


def write_log(metrics: DataFrame, path: str) -> None:
    """Metrics of runs, added to a log of JSON lines."""
    metrics.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)
