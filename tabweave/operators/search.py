"""Candidate search, row validation and answering over the cell index.

Relations: cells(tableid, colid, rowid, tokenized); examples(x array, y array); queries(x array); candidates(table_id,
x_cols array, y_cols array). Joins are declared without hints: the planner broadcasts example sides where they are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Keys up to which a search writes them into the scan as literals; beyond, its join alone decides.
PUSHED = 2000
#: Values in one list of literals: parquet looks up short lists value by value, longer ones by their least and greatest only.
LISTED = 10


def pushed(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df without rows that no key (one column, no bound needed) equals, where the keys are few: a scan of a table that is
    clustered by the column then skips the other row groups. A join has to follow; it does the same for many keys."""
    few = keys.distinct().limit(PUSHED + 1).collect()
    if len(few) > PUSHED:
        return df
    values = sorted(r[0] for r in few if r[0] is not None)
    lists = [F.col(column).isin(values[i : i + LISTED]) for i in range(0, len(values), LISTED)]
    return df.where(reduce(lambda a, b: a | b, lists, F.lit(False)))


def complete(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose arrays hold no null."""
    return rows.where(reduce(lambda a, b: a & b, (F.forall(c, lambda v: v.isNotNull()) for c in columns)))


def distinct_queries(queries: DataFrame) -> DataFrame:
    return complete(queries.select("x"), "x").distinct()


def slot_terms(examples: DataFrame, kx: int, ky: int) -> DataFrame:
    """(slot, token): the different tokens of each input and output column; slots 0..kx-1 are inputs."""
    both = F.concat("x", "y") if ky else F.col("x")
    return examples.select(F.posexplode(both).alias("slot", "token")).where((F.col("slot") < kx + ky) & F.col("token").isNotNull()).distinct()


def column_hits(cells: DataFrame, terms: DataFrame, tau: int) -> DataFrame:
    """(table_id, slot, colid): columns that hold at least tau different tokens of a slot."""
    found = pushed(cells.select("tableid", "colid", "tokenized"), "tokenized", terms.select("token")).join(terms, F.col("tokenized") == F.col("token"))
    return found.groupBy(F.col("tableid").alias("table_id"), "slot", "colid").agg(F.count_distinct("token").alias("n")).where(F.col("n") >= tau).drop("n")


def candidates(cells: DataFrame, examples: DataFrame, kx: int, ky: int, tau: int = 2, limit: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Every ordered choice of different columns of a table with a column for every slot. seen: (table_id) to leave out."""
    hits = column_hits(cells, slot_terms(examples, kx, ky), tau)
    if seen is not None:
        hits = hits.join(seen.select("table_id").distinct(), "table_id", "left_anti")
    names = [f"c{k}" for k in range(kx + ky)]
    out = None
    for k, name in enumerate(names):
        own = hits.where(F.col("slot") == k).select("table_id", F.col("colid").alias(name))
        out = own if out is None else out.join(own, "table_id").where(reduce(lambda a, b: a & b, (F.col(name) != F.col(other) for other in names[:k])))
    empty = F.array().cast("array<int>")
    out = out.select("table_id", F.array(*names[:kx]).alias("x_cols"), (F.array(*names[kx:]) if ky else empty).alias("y_cols"))
    return out if limit is None else out.orderBy("table_id", "x_cols", "y_cols").limit(limit)


def table_rows(cells: DataFrame, cands: DataFrame, kx: int, ky: int) -> DataFrame:
    """(table_id, x_cols, y_cols, rowid, x, y): the candidates' columns as rows; missing cells are null.

    Every content scan is one join of the cells with all wanted (table, column) pairs.
    """
    wanted = cands.select("table_id", "x_cols", "y_cols", F.posexplode(F.concat("x_cols", "y_cols")).alias("slot", "colid"))
    found = cells.select(F.col("tableid").alias("table_id"), "colid", "rowid", "tokenized").join(wanted, ["table_id", "colid"])
    wide = found.groupBy("table_id", "x_cols", "y_cols", "rowid").agg(*[F.max(F.when(F.col("slot") == k, F.col("tokenized"))).alias(f"v{k}") for k in range(kx + ky)])
    values = [F.col(f"v{k}") for k in range(kx + ky)]
    empty = F.array().cast("array<string>")
    return wide.select("table_id", "x_cols", "y_cols", "rowid", F.array(*values[:kx]).alias("x"), (F.array(*values[kx:]) if ky else empty).alias("y"))


def duplicate_cells(cells: DataFrame) -> DataFrame:
    """(tableid, rowid, colid, n): places with more than one cell, which a pivot could not hold."""
    return cells.groupBy("tableid", "rowid", "colid").agg(F.count("*").alias("n")).where("n > 1")


def table_content(cells: DataFrame, tables: DataFrame, columns: list[int], value: str = "tokenized") -> DataFrame:
    """(tableid, rowid, a column for each colid) of the tables (tableid); tables with places held twice are left out."""
    own = pushed(cells, "tableid", tables.select("tableid")).join(tables.select("tableid").distinct(), "tableid").where(F.col("colid").isin(columns))
    wide = own.groupBy("tableid", "rowid").agg(*[F.max(F.when(F.col("colid") == c, F.col(value))).alias(f"c{c}") for c in columns])
    return wide.join(duplicate_cells(own).select("tableid").distinct(), "tableid", "left_anti")


def null_safe(left: str, right: str, n: int) -> Column:
    return reduce(lambda a, b: a & b, (F.col(left)[i].eqNullSafe(F.col(right)[i]) for i in range(n)))


def validated(rows: DataFrame, examples: DataFrame, kx: int, ky: int, tau: int = 2) -> DataFrame:
    """(table_id, x_cols, y_cols, hits, num_rows): candidates with at least tau rows equal to whole examples, null equal to null."""
    known = examples.select(F.col("x").alias("ex"), F.col("y").alias("ey")).distinct()
    match = null_safe("x", "ex", kx)
    match = match & null_safe("y", "ey", ky) if ky else match
    marked = rows.join(known.withColumn("hit", F.lit(1)), match, "left")
    return marked.groupBy("table_id", "x_cols", "y_cols").agg(F.count("hit").alias("hits"), F.count("*").alias("num_rows")).where(F.col("hits") >= tau)


def answers(rows: DataFrame, valid: DataFrame, queries: DataFrame, kx: int) -> DataFrame:
    """(table_id, x, y): what valid candidates say about the queries; incomplete answers are dropped."""
    own = rows.join(valid.select("table_id", "x_cols", "y_cols"), ["table_id", "x_cols", "y_cols"])
    asked = queries.select(F.col("x").alias("qx")).distinct()
    found = own.join(asked, null_safe("x", "qx", kx)).select("table_id", "x", "y")
    return found.where(F.forall("y", lambda v: v.isNotNull() & (v != ""))).distinct()


def seeded_hash(seed: int) -> Column:
    """An order of (x, y) that no plan or partitioning changes, and that SQL can state."""
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), "x", "y"))


def example_split(rows: DataFrame, n: int, seed: int = 2) -> tuple[DataFrame, DataFrame]:
    """(n examples, the rest): by the least seeded hash of x, which no plan or partitioning changes."""
    keyed = rows.select("x", "y").distinct().withColumn("__h", seeded_hash(seed))
    chosen = keyed.orderBy("__h", "x", "y").limit(n).drop("__h")
    return chosen, keyed.drop("__h").join(chosen, ["x", "y"], "left_anti")


def canonical(support: DataFrame, scorer: str, threshold: float, examples: DataFrame | None = None) -> DataFrame:
    """Support edges (table_id, x, y) with each y replaced by the least y of its x that it is similar to."""
    from ..functions.fuzzy import fuzzy_tuple_match

    ys = support.select("x", "y").distinct()
    if examples is not None:  # an output that equals an example's stays what it is
        ys = ys.join(examples.select("x", "y").distinct(), ["x", "y"], "left_anti")
    pairs = ys.alias("a").join(ys.select("x", F.col("y").alias("z")).alias("b"), "x").where(F.col("z") <= F.col("y")).select("x", "y", "z")
    close = pairs.where((F.col("y") == F.col("z")) | fuzzy_tuple_match("y", "z", scorer, threshold))
    least = close.groupBy("x", "y").agg(F.min("z").alias("z"))
    return support.join(least, ["x", "y"], "left").select("table_id", "x", F.coalesce("z", "y").alias("y")).distinct()
