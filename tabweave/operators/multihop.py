"""Multi-hop search: chains of tables that lead from the inputs to the outputs where no single table does.

A path is the ids of its tables and columns; paths(path, x array, is_example, hops array<string>) holds its rows, the
present join value being the last hop. A step joins all paths with all their candidate tables at once and decides about
every (path, table, input columns, z column) by aggregates; nothing loops over tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import HopConfig
from ..functions import text as T
from ..storage import Scratch
from .search import pushed

KEY = ["path", "table_id", "x_cols", "zcol"]


@dataclass(frozen=True)
class Step:
    results: DataFrame  # path, table_id, x_cols, zcol, x, y, is_example
    paths: DataFrame  # path, x, is_example, hops


def columns_like(cells: DataFrame, values: DataFrame, k: int, tau: int, most: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(path, table_id, x_cols): tables with columns for the paths' present values (path, slot, token), at least tau of each.

    All paths at once; `most` candidates of each path are kept, by table and columns.
    """
    found = pushed(cells.select("tableid", "colid", "tokenized"), "tokenized", values.select("token")).join(values, F.col("tokenized") == F.col("token"))
    hits = found.groupBy("path", F.col("tableid").alias("table_id"), "slot", "colid").agg(F.count_distinct("token").alias("n")).where(F.col("n") >= tau)
    if seen is not None:
        hits = hits.join(seen.select("table_id").distinct(), "table_id", "left_anti")
    out = None
    for slot in range(k):
        own = hits.where(F.col("slot") == slot).select("path", "table_id", F.col("colid").alias(f"c{slot}"))
        out = own if out is None else out.join(own, ["path", "table_id"])
        for other in range(slot):
            out = out.where(F.col(f"c{slot}") != F.col(f"c{other}"))
    out = out.select("path", "table_id", F.array(*[f"c{s}" for s in range(k)]).alias("x_cols"))
    if most is None:
        return out
    order = Window.partitionBy("path").orderBy("table_id", "x_cols")
    return out.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__r")


def long_rows(cells: DataFrame, cands: DataFrame, k: int) -> DataFrame:
    """(path, table_id, x_cols, zcol, rowid, key array, z): every other column of a candidate against its input columns."""
    wanted = cands.select("path", "table_id", "x_cols")
    rows = cells.select(F.col("tableid").alias("table_id"), "rowid", "colid", "tokenized")
    keys = rows.join(wanted, "table_id").where(F.array_contains("x_cols", F.col("colid"))).groupBy("path", "table_id", "x_cols", "rowid")
    keys = keys.agg(F.map_from_entries(F.collect_list(F.struct("colid", "tokenized"))).alias("m"))  # one cell for each input column
    keys = keys.select("path", "table_id", "x_cols", "rowid", F.transform("x_cols", lambda c: F.element_at("m", c)).alias("key")).where(F.forall("key", lambda v: v.isNotNull()))
    # columns that miss a cell in a row have a null there
    other = rows.join(wanted.select("table_id").distinct(), "table_id", "left_semi").select("table_id", F.col("colid").alias("zcol")).distinct()
    whole = keys.join(other, "table_id").where(~F.array_contains("x_cols", F.col("zcol")))
    return whole.join(rows.select("table_id", "rowid", F.col("colid").alias("zcol"), F.col("tokenized").alias("z")), ["table_id", "rowid", "zcol"], "left")


def dependency_ratios(rows: DataFrame) -> DataFrame:
    """(path, table_id, x_cols, zcol, n_x, n_z): different keys and different values; the reference of the cardinality rule."""
    return rows.groupBy(*KEY).agg(F.count_distinct("key").alias("n_x"), F.count_distinct("z").alias("n_z"))


def functional(rows: DataFrame) -> DataFrame:
    """(path, table_id, x_cols, zcol): columns with one value for each key, the strict sense of a dependency."""
    per = rows.where("z is not null").groupBy(*KEY, "key").agg(F.count_distinct("z").alias("n"))
    return per.groupBy(*KEY).agg(F.max("n").alias("most")).where("most = 1").drop("most")


def first_rows(rows: DataFrame) -> DataFrame:
    """Rows without blank keys; of equal keys the first row."""
    full = rows.where(F.forall("key", lambda v: ~T.is_blank(v)))
    return full.withColumn("__r", F.row_number().over(Window.partitionBy(*KEY, "key").orderBy("rowid", "z"))).where("__r = 1").drop("__r")


def column_quality(rows: DataFrame, config: HopConfig) -> DataFrame:
    """Per (path, table, input columns, z column): counts of values and shares of numeric, null, blank and short ones."""
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    short = F.coalesce(F.length("z") < config.min_word_len, F.lit(False))
    return rows.groupBy(*KEY).agg(
        F.count_distinct("z").alias("n_z"), F.count_distinct("key").alias("n_key"), share(T.is_strict_number("z")).alias("numeric"),
        share(F.col("z").isNull()).alias("missing"), share(T.is_blank("z")).alias("blank"), share(short).alias("short"),
    )


def restrict_numbers(examples: DataFrame, threshold: float = 0.5) -> bool:
    """Whether numeric columns are no hops: not if one of the examples' own columns is mostly numeric."""
    values = examples.select(F.posexplode(F.concat("x", "y")).alias("slot", "v")).where(~T.is_blank("v"))
    shares = values.groupBy("slot").agg(F.avg(F.when(T.is_numeric_like("v"), 1.0).otherwise(0.0)).alias("share"))  # a row for each column
    return not shares.agg(F.coalesce(F.max("share"), F.lit(0.0)) > threshold).first()[0]


def expand(cells: DataFrame, paths: DataFrame, cands: DataFrame, y_values: DataFrame, k: int, tau: int, restrict: bool, config: HopConfig, scratch: Scratch, hop: int, fuzzy: tuple[str, float] | None = None) -> Step:
    """One hop of all paths over all their candidates."""
    rows = scratch.write(long_rows(pushed(cells, "tableid", cands.select("table_id")), cands, k), f"rows{hop}")
    ratio = dependency_ratios(rows).where((F.col("n_z") == 0) | (F.col("n_z") >= (1 - config.error_threshold_for_fd) * F.col("n_x")))
    # of each path, the tables with a column left, up to max_tables
    beam = F.dense_rank().over(Window.partitionBy("path").orderBy("table_id", "x_cols"))
    ratio = ratio.select(*KEY).withColumn("__b", beam).where(F.col("__b") <= max(1, config.max_tables // config.tables_factor ** (hop - 1))).drop("__b")
    kept = first_rows(rows.join(ratio, KEY, "left_semi"))
    quality = column_quality(kept, config)
    good = quality.where((F.col("n_z") >= tau) & (F.col("n_key") >= tau) & (F.col("missing") < config.none_precision) & (F.col("blank") < config.none_precision) & (F.col("short") < config.short_precision))
    good = good.where(F.col("numeric") < config.metric_precision) if restrict else good
    kept = scratch.write(kept.join(good.select(*KEY), KEY, "left_semi"), f"kept{hop}")
    if hop == 1:  # rows that only the table has carry an input of their own
        known = paths.select("x", "is_example")
        merged = kept.withColumn("x", F.col("key")).join(known, "x", "left").withColumn("is_example", F.coalesce("is_example", F.lit(False))).withColumn("hops", F.array().cast("array<string>"))
    else:
        now = paths.select("path", "x", "is_example", "hops", F.array(F.element_at("hops", -1)).alias("key"))
        merged = kept.join(now, ["path", "key"])
    merged = scratch.write(merged.select(*KEY, "x", "is_example", "hops", "z"), f"merged{hop}")
    full = merged.where("z is not null")
    counts = full.groupBy(*KEY).agg(F.count_distinct("x").alias("n_x"), F.count_distinct("z").alias("n_z"), F.count_distinct(F.when(~T.is_blank("z"), F.col("z"))).alias("n_full"))
    # how many of the values occur in the path's other columns already
    before = full.select(*KEY, F.explode(F.concat("x", "hops")).alias("v")).select(*KEY, F.lower("v").alias("low")).distinct()
    lows = full.select(*KEY, F.lower("z").alias("low")).distinct()
    overlap = lows.join(before.withColumn("old", F.lit(1)), [*KEY, "low"], "left").groupBy(*KEY).agg(F.avg(F.coalesce("old", F.lit(0))).alias("overlap"))
    shown = full.where("is_example").select(*KEY, "z").distinct()
    if fuzzy is None:
        hit = shown.join(y_values.select(F.col("v").alias("z")).distinct(), "z", "left_semi")
    else:
        from ..functions.fuzzy import fuzzy_match

        hit = shown.join(y_values.select("v").distinct(), (F.col("z") == F.col("v")) | fuzzy_match("z", "v", *fuzzy)).select(*KEY, "z").distinct()
    hits = hit.groupBy(*KEY).agg(F.count("*").alias("hits"))
    samples = full.where("is_example").groupBy(*KEY).agg(F.count("*").alias("samples"))
    state = counts.join(overlap, KEY).join(hits, KEY, "left").join(samples, KEY, "left").fillna(0, ["hits", "samples"])
    state = state.where((F.col("n_z") >= config.fd_threshold * F.col("n_x")) & (F.col("overlap") <= config.overlap_threshold) & (F.col("n_full") >= 2))
    state = scratch.write(state, f"state{hop}")
    results = full.join(state.where(F.col("hits") >= tau).select(*KEY), KEY, "left_semi")
    results = results.where(~T.is_blank("z")).select(*KEY, "x", F.array("z").alias("y"), "is_example")
    best = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(F.col("samples") * F.log1p("n_z")), "table_id", "x_cols", "zcol"))
    going = state.where((F.col("hits") < tau) & (F.col("samples") >= tau)).withColumn("__r", best).where(F.col("__r") <= config.max_paths_to_keep).select(*KEY)
    name = F.concat_ws("/", F.nullif(F.col("path"), F.lit("")), F.concat_ws(":", F.col("table_id").cast("string"), F.array_join(F.transform("x_cols", lambda c: c.cast("string")), "+"), F.col("zcol").cast("string")))
    onward = full.join(going, KEY, "left_semi").select(name.alias("path"), "x", "is_example", F.concat("hops", F.array("z")).alias("hops"))
    return Step(results, onward)


def multi_hop(cells: DataFrame, examples: DataFrame, queries: DataFrame, kx: int, tau: int = 2, config: HopConfig | None = None, scratch: Scratch | None = None, seen: DataFrame | None = None, fuzzy: tuple[str, float] | None = None, by_table: DataFrame | None = None) -> DataFrame:
    """(table_id < 0, path string, x, y): what every chain that reaches the examples' outputs says, as one table each.

    by_table: the same cells, clustered by table. Outputs have one column. Rows of inputs that nobody asked for are part of a chain's table.
    """
    config = config or HopConfig()
    scratch = scratch or Scratch(cells.sparkSession, "multihop")
    restrict = restrict_numbers(examples, config.threshold_for_numeric_cols)
    y_values = examples.select(F.explode("y").alias("v")).where("v is not null").distinct()
    shown = examples.select("x").distinct().withColumn("is_example", F.lit(True))
    asked = queries.select("x").distinct().join(shown, "x", "left_anti").withColumn("is_example", F.lit(False))
    paths = scratch.write(shown.unionByName(asked).withColumns({"path": F.lit(""), "hops": F.array().cast("array<string>")}).select("path", "x", "is_example", "hops"), "paths0")
    used, found, k = seen, None, kx
    for hop in range(1, config.max_path_len + 1):
        own = paths.where("is_example")
        values = own.select("path", F.posexplode("x" if hop == 1 else F.array(F.element_at("hops", -1))).alias("slot", "token")).where("token is not null").distinct()
        cands = scratch.write(columns_like(cells, values, k, tau, config.max_tables * 3, used), f"cands{hop}")
        if not cands.take(1):
            break
        step = expand(cells if by_table is None else by_table, paths, cands, y_values, k, tau, restrict, config, scratch, hop, fuzzy)
        results = scratch.write(step.results, f"results{hop}")
        found = results if found is None else found.unionByName(results)
        paths = scratch.write(step.paths, f"paths{hop}")
        met = cands.select("table_id").distinct()
        used = met if used is None else used.select("table_id").unionByName(met).distinct()
        k = 1
    if found is None:
        return queries.select(F.lit(None).cast("long").alias("table_id"), F.lit("").alias("path"), "x", F.col("x").alias("y")).limit(0)
    name = F.concat_ws("/", F.nullif(F.col("path"), F.lit("")), F.concat_ws(":", F.col("table_id").cast("string"), F.array_join(F.transform("x_cols", lambda c: c.cast("string")), "+"), F.col("zcol").cast("string")))
    rows = found.select(name.alias("path"), "x", "y").distinct()
    # a row for each chain found; few, by max_tables and max_paths_to_keep
    ids = rows.select("path").distinct().withColumn("table_id", -F.row_number().over(Window.orderBy(F.length("path"), "path")).cast("long"))
    return rows.join(ids, "path").select("table_id", "path", "x", "y")
