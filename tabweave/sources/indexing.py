"""From raw tables to the cell index: cells, headers, table facts, postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import text as T
from ..storage import Scratch
from .corpus import Corpus


def numbered(raw: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """Raw tables with a tableid, gapless from `first` in the order given, without sorting all rows in one task.

    Rows are dealt to buckets by ranges of the order; a bucket's rows are numbered and lifted by the counts before it. The
    buckets are written: ranges come from a sample, which another evaluation could draw otherwise.
    """
    scratch = Scratch(raw.sparkSession, "numbered")
    keyed = scratch.write(raw.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()), "buckets")
    numbers = keyed.select("*", F.row_number().over(Window.partitionBy("__b").orderBy(*order)).alias("__k"))
    counts = keyed.groupBy("__b").agg(F.count("*").alias("__n"))  # a row for each partition
    before = counts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return numbers.join(before, "__b").withColumn("tableid", (F.col("__o") + F.col("__k") + (first - 1)).cast("long")).drop("__b", "__k", "__o")


def build_index(raw: DataFrame, config: IndexConfig | None = None) -> Corpus:
    """raw: (tableid, url, title, hasHeader, headerPosition, relation by columns). A first-row header leaves the rows.

    Only first_row is understood as a header's position. Rows are numbered from 1 after the header. Null cells stay as null
    tokens; empty headers are null.
    """
    headed = F.coalesce(F.col("hasHeader"), F.lit(False)) & T.is_first_row("headerPosition")
    columns = raw.select("tableid", headed.alias("headed"), F.posexplode("relation").alias("c", "items")).withColumn("colid", (F.col("c") + 1).cast("int"))
    items = columns.select("tableid", "colid", "headed", F.posexplode("items").alias("r", "term"))
    shift = F.when(F.col("headed"), 0).otherwise(1)
    cells = items.where(~F.col("headed") | (F.col("r") > 0)).select("tableid", "colid", (F.col("r") + shift).cast("int").alias("rowid"), "term", T.tokenize("term", config).alias("tokenized"))
    header = F.when(F.col("headed") & (F.size("items") > 0), F.nullif(F.element_at("items", 1), F.lit("")))
    columns = columns.select("tableid", "colid", header.alias("header")).withColumn("header_tokenized", T.tokenize("header", config))
    tables = raw.select("tableid", "url", "title", F.lit(0.5).alias("weight"))
    return Corpus(cells, columns, tables)


def build_row_major(raw: DataFrame, config: IndexConfig | None = None) -> DataFrame:
    """raw: (tableid, tableData by rows): cells numbered from 0."""
    rows = raw.select("tableid", F.posexplode("tableData").alias("rowid", "cells"))
    cells = rows.select("tableid", "rowid", F.posexplode("cells").alias("colid", "cell"))
    return cells.select("tableid", "colid", "rowid", F.col("cell.text").alias("term"), T.tokenize("cell.text", config).alias("tokenized"))


def postings(cells: DataFrame) -> DataFrame:
    """(tokenized, postings): every token's places, in order. For output: a frequent token's list is as long as it is frequent."""
    return cells.where("tokenized is not null").groupBy("tokenized").agg(F.sort_array(F.collect_list(F.struct("tableid", "rowid", "colid"))).alias("postings"))


def layouts(corpus: Corpus) -> dict[str, DataFrame]:
    """What an index holds, by folder. Cells are there twice, by token and by table, so that a search for tokens and the
    reading of tables each touch few row groups; frequent tokens and long tables are dealt to several files."""
    ranged = lambda *order: corpus.cells.repartitionByRange(*order).sortWithinPartitions(*order)
    out = {"cells": ranged("tokenized", "tableid"), "cells_by_table": ranged("tableid", "colid", "rowid"), "columns": corpus.columns, "tables": corpus.tables}
    return {name: df for name, df in out.items() if df is not None}


def write_corpus(corpus: Corpus, path: str, mode: str = "overwrite") -> None:
    for name, df in layouts(corpus).items():
        df.write.mode(mode).parquet(f"{path}/{name}")
