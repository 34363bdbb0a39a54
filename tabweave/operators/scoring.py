"""Ranking: table reliability and answer probability, each from the other until they settle, or a majority vote.

support(table_id, x, y) are distinct edges; scores(x, y, score, is_example). An example's score stays 1. With s(t) the
score of a table, an answer's probability is the product over the tables that speak about x, of s(t) for those that
support it and 1 - s(t) for the others, normalised with the probability that all are wrong. Dividing by that last
product leaves, for each answer, only the odds of its own supporters, so no table meets an answer it doesn't support.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScoreConfig
from ..storage import Scratch
from .search import seeded_hash

#: Scores are rounded to so many digits, so sums in another order don't break ties.
DIGITS = 12


def initial_scores(support: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples at 1, other answers at 0."""
    known = examples.select("x", "y").distinct().withColumns({"score": F.lit(1.0), "is_example": F.lit(True)})
    others = support.select("x", "y").distinct().join(known.select("x", "y"), ["x", "y"], "left_anti").withColumns({"score": F.lit(0.0), "is_example": F.lit(False)})
    return known.unionByName(others)


def table_scores(support: DataFrame, scores: DataFrame, alpha: float, prior: float) -> DataFrame:
    """(table_id, score): the share of good evidence. Good: scores of edges onto the best answer of an input; bad: other
    edges, 1 each; unseen: the best scores of inputs that the table doesn't have."""
    best = scores.groupBy("x").agg(F.max("score").alias("best"))
    total = best.agg(F.sum("best").alias("total"))  # one row
    is_best = F.round("score", DIGITS) == F.round("best", DIGITS)
    edges = support.join(scores.select("x", "y", "score"), ["x", "y"]).join(best, "x")
    by_x = edges.groupBy("table_id", "x").agg(F.sum(F.when(is_best, F.col("score")).otherwise(0.0)).alias("good"), F.sum(F.when(is_best, 0).otherwise(1)).alias("bad"), F.max("best").alias("covered"))
    sums = by_x.groupBy("table_id").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("covered").alias("covered")).join(F.broadcast(total))  # one row
    over = prior * F.col("good")
    under = over + (1 - prior) * (F.col("bad") + F.greatest(F.col("total") - F.col("covered"), F.lit(0.0)))
    return sums.select("table_id", F.round(F.when(under > 0, alpha * over / under).otherwise(0.0), DIGITS).alias("score"))


def answer_scores(support: DataFrame, scores: DataFrame, tables: DataFrame) -> DataFrame:
    """scores with every answer that is no example at its new probability."""
    odds = tables.select("table_id", F.when(F.col("score") > 0, F.ln(F.col("score") / (1 - F.col("score")))).otherwise(F.lit(float("-inf"))).alias("odds"))
    own = scores.where("not is_example").select("x", "y")
    logs = support.join(own, ["x", "y"]).join(odds, "table_id").groupBy("x", "y").agg(F.sum("odds").alias("log"))
    per_x = Window.partitionBy("x")
    top = F.greatest(F.max("log").over(per_x), F.lit(0.0))
    weighed = logs.withColumn("top", top).withColumn("w", F.exp(F.col("log") - F.col("top")))
    new = weighed.select("x", "y", F.round(F.col("w") / (F.exp(-F.col("top")) + F.sum("w").over(per_x)), DIGITS).alias("score"), F.lit(False).alias("is_example"))
    return scores.where("is_example").unionByName(new)


def majority(support: DataFrame, scores: DataFrame) -> DataFrame:
    """1 for the answer that most tables support (ties: the least), 0 for all others, examples too."""
    votes = support.join(scores.where("not is_example").select("x", "y"), ["x", "y"]).groupBy("x", "y").agg(F.count_distinct("table_id").alias("n"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("n"), "y"))
    won = votes.select("x", "y", F.when(rank == 1, 1.0).otherwise(0.0).alias("score"), F.lit(False).alias("is_example"))
    return scores.where("is_example").withColumn("score", F.lit(0.0)).unionByName(won)


def change(now: DataFrame, before: DataFrame) -> tuple[float, int]:
    """(sum of the scores' absolute differences, a hash of all scores); an answer that wasn't there had 0."""
    old = before.select("x", "y", F.col("score").alias("old"))
    delta = F.coalesce(F.sum(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0)))), F.lit(0.0))
    return tuple(now.join(old, ["x", "y"], "left").agg(delta, F.coalesce(F.bit_xor(F.xxhash64("x", "y", "score")), F.lit(0))).first())


def rounds(config: ScoreConfig, steps: int | None):
    """1, 2, .. up to the least limit that is set."""
    limits = [n for n in (steps, config.max_iterations) if n]
    return range(1, min(limits) + 1) if limits else count(1)


def iterate(support: DataFrame, scores: DataFrame, config: ScoreConfig, scratch: Scratch, steps: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(scores, table scores, iterations): until the change is at most epsilon or a state returns, or for `steps` iterations.

    Each iteration's scores are written and read back: plans and their size estimates don't grow with the iterations.
    """
    tables, met = None, set()
    for k in rounds(config, steps):
        if config.use_majority_voting:
            tables = support.select("table_id").distinct().withColumn("score", F.lit(0.0))
            return scratch.write(majority(support, scores), "scores"), tables, 1
        tables = scratch.write(table_scores(support, scores, config.alpha, config.table_prior), f"tables{k % 2}")
        new = scratch.write(answer_scores(support, scores, tables), f"scores{k % 2}")
        if steps is None:
            delta, state = change(new, scores)
            if k > 1 and delta <= config.epsilon or state in met:
                scores = new
                break
            met.add(state)
        scores = new
    return scores, tables, k


def kernel(table: np.ndarray, x: np.ndarray, answer: np.ndarray, x_of: np.ndarray, example: np.ndarray, config: ScoreConfig, steps: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The same iteration over codes: edges (table, x, answer), each answer's x and whether it is an example."""
    n_tables, n_x, n = int(table.max(initial=-1)) + 1, int(x_of.max(initial=-1)) + 1, len(x_of)
    score = example.astype(float)
    pairs = np.unique(np.stack((table, x), 1), axis=0) if len(table) else np.empty((0, 2), int)
    free = ~example
    supported = np.bincount(answer, minlength=n) > 0
    t, met = np.zeros(n_tables), set()
    for k in rounds(config, steps):
        best = np.zeros(n_x)
        np.maximum.at(best, x_of, score)
        top = np.round(score[answer], DIGITS) == np.round(best[x], DIGITS)
        good = np.bincount(table, np.where(top, score[answer], 0), minlength=n_tables)
        bad = np.bincount(table, ~top, minlength=n_tables)
        covered = np.bincount(pairs[:, 0], best[pairs[:, 1]], minlength=n_tables)
        over = config.table_prior * good
        under = over + (1 - config.table_prior) * (bad + np.maximum(best.sum() - covered, 0))
        t = np.round(np.where(under > 0, config.alpha * over / np.where(under > 0, under, 1), 0), DIGITS)
        with np.errstate(divide="ignore"):
            odds = np.where(t > 0, np.log(np.where(t > 0, t, 1) / (1 - t)), -np.inf)
        log = np.zeros(n)
        np.add.at(log, answer, odds[table])
        log[~supported] = -np.inf
        high = np.zeros(n_x)
        np.maximum.at(high, x_of[free], log[free])
        w = np.where(free, np.exp(log - high[x_of]), 0)
        new = np.where(free, np.round(w / (np.exp(-high) + np.bincount(x_of, w, minlength=n_x))[x_of], DIGITS), score)
        delta = float(np.abs(new - score).sum())
        score = new
        if steps is None:
            state = hash(score.tobytes())
            if k > 1 and delta <= config.epsilon or state in met:
                break
            met.add(state)
    return score, t, k


def iterate_grouped(support: DataFrame, examples: DataFrame, config: ScoreConfig, steps: int | None = None) -> DataFrame:
    """(exercise, x, y, score, is_example, iterations): one task iterates over an exercise. For exercises of bounded size.

    support: (exercise, table_id, x, y); examples: (exercise, x, y).
    """
    edges = support.select("exercise", F.col("table_id").cast("string").alias("table_id"), "x", "y", F.lit(False).alias("is_example"))
    known = examples.select("exercise", F.lit(None).cast("string").alias("table_id"), "x", "y", F.lit(True).alias("is_example"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pd.DataFrame({"x": pdf["x"].map(tuple), "y": pdf["y"].map(tuple)})
        answer, names = pd.factorize(pd.Series(list(zip(keys["x"], keys["y"], strict=True))))
        x_code, _ = pd.factorize(keys["x"])
        x_of, example = np.zeros(len(names), int), np.zeros(len(names), bool)
        x_of[answer] = x_code
        example[answer[pdf["is_example"].to_numpy(bool)]] = True
        is_edge = pdf["table_id"].notna().to_numpy()
        table, _ = pd.factorize(pdf["table_id"][is_edge])
        edge = np.unique(np.stack((table, x_code[is_edge], answer[is_edge]), 1), axis=0) if is_edge.any() else np.empty((0, 3), int)
        score, _, n = kernel(edge[:, 0], edge[:, 1], edge[:, 2], x_of, example, config, steps)
        return pd.DataFrame({"exercise": pdf["exercise"].iloc[0], "x": [list(a) for a, _ in names], "y": [list(b) for _, b in names], "score": score, "is_example": example, "iterations": n})

    kind = support.schema["exercise"].dataType.simpleString()
    return edges.unionByName(known).groupBy("exercise").applyInPandas(run, f"exercise {kind}, x array<string>, y array<string>, score double, is_example boolean, iterations int")


def ranked(scores: DataFrame, queries: DataFrame) -> DataFrame:
    """(x, y, score, rank): the queries' answers, best first."""
    order = Window.partitionBy("x").orderBy(F.desc("score"), "y")
    return scores.join(queries.select("x").distinct(), "x", "left_semi").select("x", "y", "score", F.row_number().over(order).alias("rank"))


def top_answers(scores: DataFrame, k: int, most: int, seed: int) -> DataFrame:
    """(x, y): the k best answers of every input, at most `most` of them (by seeded hash), as examples of the next round."""
    order = Window.partitionBy("x").orderBy(F.desc("score"), "y")
    best = scores.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).select("x", "y")
    return best.orderBy(seeded_hash(seed), "x", "y").limit(most)


def table_metrics(sizes: DataFrame, support: DataFrame, ranking: DataFrame) -> DataFrame:
    """Counts and mean sizes of tables, of multi-hop tables (negative ids), and of those that support a winner."""
    per = sizes.groupBy("table_id").agg(F.max("num_rows").alias("num_rows"))
    best = support.join(ranking.where("rank = 1").select("x", "y"), ["x", "y"], "left_semi").select("table_id").distinct().withColumn("best", F.lit(True))
    rows = per.join(best, "table_id", "left")
    hop, won = F.col("table_id") < 0, F.col("best")
    stat = lambda name, cond: [F.count(F.when(cond, 1)).cast("double").alias(f"n_tables{name}"), F.coalesce(F.avg(F.when(cond, F.col("num_rows"))), F.lit(0.0)).alias(f"avg_table_size{name}")]
    return rows.agg(*stat("", F.lit(True)), *stat("_multi", hop), *stat("_best", won), *stat("_best_multi", won & hop))
