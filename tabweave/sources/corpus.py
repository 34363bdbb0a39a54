"""Sources: web tables as JSON lines, exercise files, uploads, indexed corpora."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

WEB_TABLE = "url STRING, title STRING, hasHeader BOOLEAN, headerPosition STRING, relation ARRAY<ARRAY<STRING>>"
ROW_MAJOR_TABLE = "url STRING, title STRING, tableData ARRAY<ARRAY<STRUCT<text: STRING>>>"
CELLS = "tableid LONG, colid INT, rowid INT, term STRING, tokenized STRING"


@dataclass(frozen=True)
class Corpus:
    """The relations of an indexed corpus."""

    cells: DataFrame
    columns: DataFrame | None = None
    tables: DataFrame | None = None
    #: The same cells clustered by table, from which whole columns are read; None: `cells` serve for that too.
    by_table: DataFrame | None = None


def read_web_tables(spark: SparkSession, path: str, schema: str = WEB_TABLE) -> DataFrame:
    """JSON lines, plain or compressed: one file, or the files of a folder that have a known suffix (not deeper)."""
    reader = spark.read.schema(schema)
    if not path.endswith((".json", ".jsonl", ".ndjson", ".gz")):
        reader = reader.option("pathGlobFilter", "*.{json,jsonl,ndjson,gz}").option("recursiveFileLookup", "false")
    return reader.json(path)


def read_exercise(spark: SparkSession, path: str) -> DataFrame:
    """Exercise files: all columns are text, empty cells are null, `exercise` and `input_columns` come from the name."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    columns = raw.columns
    named = raw.select("*", F.col("_metadata.file_path").alias("__path")).withColumn("exercise", T.exercise_name("__path")).withColumn("input_columns", T.input_columns("exercise"))
    return named.select("exercise", "input_columns", *[T.unquoted(f"`{c}`").alias(c) for c in columns])


def sniffed_separator(spark: SparkSession, path: str, head: int = 2000) -> str:
    """A comma if there are more of them than semicolons at the file's start, else a semicolon."""
    lines = spark.read.text(path, wholetext=True).select(F.substring("value", 1, head).alias("h"))
    count = lambda sep: F.length("h") - F.length(F.replace("h", F.lit(sep), F.lit("")))
    found = lines.agg(F.sum(count(",")).alias("c"), F.sum(count(";")).alias("s")).first()
    return "," if (found.c or 0) > (found.s or 0) else ";"


def read_upload(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """An uploaded file with a sniffed separator; without a header its columns are 0, 1, .."""
    raw = spark.read.option("header", header).option("sep", sniffed_separator(spark, path)).option("multiLine", True).option("escape", '"').csv(path)
    return raw if header else raw.toDF(*map(str, range(len(raw.columns))))


def read_raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """A file whose header is a row like others."""
    return spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path)


def both_layouts(cells: DataFrame | Corpus) -> tuple[DataFrame, DataFrame]:
    """(cells to search for tokens, cells to read tables from)."""
    if isinstance(cells, DataFrame):
        return cells, cells
    return cells.cells, cells.cells if cells.by_table is None else cells.by_table


def read_corpus(spark: SparkSession, path: str) -> Corpus:
    return Corpus(*[spark.read.parquet(f"{path}/{name}") for name in ("cells", "columns", "tables", "cells_by_table")])


def read_jdbc_cells(spark: SparkSession, url: str, table: str, partitions: int = 32, low: int = 1, high: int = 1 << 28, **options: str) -> DataFrame:
    """Cells from a database, read in parallel by table id."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="tableid", lowerBound=low, upperBound=high, numPartitions=partitions, **options).load()


def route_upload(df: DataFrame, x_cols: list[str], y_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(examples (x, y), queries (x)): rows with all of x and y; rows with all of x and none of y; other rows are dropped."""
    if not x_cols or not y_cols or set(x_cols) & set(y_cols):
        raise ValueError("a column is input or output, not both, and there is one of each at least")
    text = lambda cs: F.array(*[F.when(~T.is_blank(F.col(f"`{c}`").cast("string")), F.col(f"`{c}`").cast("string")) for c in cs])
    rows = df.select(text(x_cols).alias("x"), text(y_cols).alias("y"))
    whole, some_y = F.forall("x", lambda v: v.isNotNull()), F.exists("y", lambda v: v.isNotNull())
    return rows.where(whole & F.forall("y", lambda v: v.isNotNull())), rows.where(whole & ~some_y).select("x")
