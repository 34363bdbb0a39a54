"""Transformation discovery by example: search, validation, answers, chains of tables, ranking, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import evaluate, multihop, scoring, search
from ..sources.corpus import Corpus, both_layouts, route_upload
from ..storage import Scratch


@dataclass(frozen=True)
class Outcome:
    ranking: DataFrame  # x, y, score, rank for the queries
    scores: DataFrame  # x, y, score, is_example
    tables: DataFrame  # table_id, score
    support: DataFrame  # table_id, x, y
    sizes: DataFrame  # table_id, num_rows
    iterations: int

    def metrics(self) -> DataFrame:
        return scoring.table_metrics(self.sizes, self.support, self.ranking)


def arity(rows: DataFrame, column: str) -> int:
    found = rows.select(F.size(column).alias("n")).first()
    return found.n if found else 0


def gather(cells: DataFrame | Corpus, examples: DataFrame, asked: DataFrame, kx: int, ky: int, config: EngineConfig, scratch: Scratch, tag: str, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(support, sizes, tables met): one round of search, for examples and the inputs asked."""
    s = config.search
    cells, by_table = both_layouts(cells)
    cands = scratch.write(search.candidates(cells, examples, kx, ky, s.tau, s.table_limit, seen), f"cands{tag}")
    rows = scratch.write(search.table_rows(search.pushed(by_table, "tableid", cands.select("table_id")), cands, kx, ky), f"rows{tag}")
    valid = scratch.write(search.validated(rows, examples, kx, ky, s.tau), f"valid{tag}")
    support = search.answers(rows, valid, asked, kx)
    sizes = valid.groupBy("table_id").agg(F.max("num_rows").alias("num_rows"))
    met = cands.select("table_id").distinct()
    if config.use_multi_hop:
        if ky != 1:
            raise ValueError("chains of tables lead to one output column")
        fuzzy = (config.score.fuzzy_scorer, config.score.fuzzy_threshold) if config.score.use_fuzzy_matching else None
        hops = scratch.write(multihop.multi_hop(cells, examples, asked, kx, s.tau, config.hop, Scratch(cells.sparkSession, "hops"), met if seen is None else seen.unionByName(met), fuzzy, by_table), f"hops{tag}")
        support = support.unionByName(hops.select("table_id", "x", "y"))
        sizes = sizes.unionByName(hops.groupBy("table_id").agg(F.count_distinct("x").alias("num_rows")))
    if config.score.use_fuzzy_matching:
        support = search.canonical(support, config.score.fuzzy_scorer, config.score.fuzzy_threshold, examples)
    return scratch.write(support.distinct(), f"support{tag}"), scratch.write(sizes, f"sizes{tag}"), met


def discover(cells: DataFrame | Corpus, examples: DataFrame, queries: DataFrame, config: EngineConfig | None = None, steps: int | None = None) -> Outcome:
    """examples(x array, y array), queries(x array): ranked outputs for the queries. cells: alone, or an index in both layouts."""
    config = config or EngineConfig()
    spark: SparkSession = examples.sparkSession
    scratch = Scratch(spark, "discover")
    examples = scratch.write(examples.select("x", "y"), "examples")
    queries = scratch.write(search.distinct_queries(queries), "queries")
    known = search.complete(examples, "x", "y")
    kx, ky = arity(examples, "x"), arity(examples, "y")
    if not kx or not ky:
        raise ValueError("there is no example with inputs and outputs")
    asked = queries.unionByName(search.complete(examples, "x").select("x")).distinct()
    support, sizes, seen = gather(cells, examples, asked, kx, ky, config, scratch, "0")
    scores = scratch.write(scoring.initial_scores(support, known), "initial0")
    scores, tables, done = _settle(support, scores, known, config, steps, "0")
    for k in range(1, config.score.max_requery_iterations + 1):
        again = scratch.write(scoring.top_answers(scores, config.score.topk, config.score.max_requery_answers, config.score.seed), f"again{k}")
        if not again.select("y").exceptAll(examples.select("y")).take(1):
            break  # nothing new to ask with
        more, more_sizes, met = gather(cells, again, queries, kx, ky, config, scratch, str(k), seen)
        if not more.take(1):
            break
        # chains of tables are numbered from -1 in every round
        low = support.agg(F.least(F.min("table_id"), F.lit(0))).first()[0] or 0
        shift = lambda df, by=low: df.withColumn("table_id", F.when(F.col("table_id") < 0, F.col("table_id") + by).otherwise(F.col("table_id")))
        support = scratch.write(support.unionByName(shift(more)).distinct(), f"all{k}")
        sizes = sizes.unionByName(shift(more_sizes))
        seen = seen.unionByName(met)
        new = scoring.initial_scores(support, known).select("x", "y", "is_example", F.col("score").alias("start"))
        start = new.join(scores.select("x", "y", "score"), ["x", "y"], "left").select("x", "y", F.coalesce("score", "start").alias("score"), "is_example")
        scores, tables, n = _settle(support, scratch.write(start, f"initial{k}"), known, config, steps, str(k))
        done += n
    return Outcome(scoring.ranked(scores, queries), scores, tables, support, sizes, done)


def _settle(support: DataFrame, scores: DataFrame, examples: DataFrame, config: EngineConfig, steps: int | None, tag: str) -> tuple[DataFrame, DataFrame, int]:
    scratch = Scratch(support.sparkSession, f"scores{tag}")
    bounded = support.count() <= config.score.kernel_edges
    if config.score.use_majority_voting or not bounded or scores.where("is_example and score != 1").take(1) or scores.where("not is_example and score != 0").take(1):
        return scoring.iterate(support, scores, config.score, scratch, steps)
    one = F.lit("")
    out = scratch.write(scoring.iterate_grouped(support.withColumn("exercise", one), examples.withColumn("exercise", one), config.score, steps).drop("exercise"), "scores")
    done = out.agg(F.coalesce(F.max("iterations"), F.lit(0))).first()[0]
    out = out.drop("iterations")
    tables = scratch.write(scoring.table_scores(support, out, config.score.alpha, config.score.table_prior), "tables")
    return out, tables, done


def transform(df: DataFrame, x_cols: list[str], y_cols: list[str], cells: DataFrame | Corpus, config: EngineConfig | None = None, tokenised: bool = False, least: float = 0.01) -> DataFrame:
    """A table whose rows with outputs are examples: its rows, missing outputs filled with the best answers."""
    from ..functions.text import tokenize

    examples, queries = route_upload(df, x_cols, y_cols)
    token = lambda a: F.transform(a, lambda v: v if tokenised else tokenize(v))
    asked = queries.select("x", token("x").alias("t")).distinct()
    out = discover(cells, examples.select(token("x").alias("x"), token("y").alias("y")), asked.select(F.col("t").alias("x")), config)
    best = out.ranking.where((F.col("rank") == 1) & (F.col("score") >= least)).select(F.col("x").alias("t"), "y")
    return evaluate.write_back(df, asked.join(best, "t").select("x", "y"), x_cols, y_cols)


def run_exercise(cells: DataFrame | Corpus, rows: DataFrame, n_examples: int = 5, config: EngineConfig | None = None, repeats: int = 5) -> DataFrame:
    """Metrics of an exercise (x array, y array): mean and deviation over repeats with other examples."""
    config = config or EngineConfig()
    runs = None
    for r in range(repeats):
        examples, rest = search.example_split(rows, n_examples, config.score.seed + r)
        out = discover(cells, examples, rest.select("x"), config)
        one = evaluate.evaluate(out.ranking, rest).withColumn("repeat", F.lit(r))
        runs = one if runs is None else runs.unionByName(one)
    return evaluate.over_repeats(runs.withColumn("tau", F.lit(config.search.tau)), ["tau"])


def run_experiment(cells: DataFrame | Corpus, exercises: dict[str, DataFrame], taus: tuple[int, ...] = (1, 2, 3, 4, 5), config: EngineConfig | None = None, first: tuple[str, ...] = (), **options) -> DataFrame:
    """Every exercise for every tau; those named in `first` (slow ones) come first, in that order."""
    from dataclasses import replace

    config = config or EngineConfig()
    place = {name: k for k, name in enumerate(first)}
    out = None
    for tau in taus:
        for name in sorted(exercises, key=lambda e: (place.get(e, len(place)), e)):
            rows = exercises[name]
            one = run_exercise(cells, rows, config=replace(config, search=replace(config.search, tau=tau)), **options).withColumn("exercise", F.lit(name))
            out = one if out is None else out.unionByName(one)
    return out
