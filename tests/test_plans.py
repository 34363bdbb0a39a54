"""What the planner makes of the operators: columns read, joins chosen, no Python where none is needed."""

import re

from tabweave.operators import evaluate, search
from tabweave.queries import as_cells, examples, hop_rows
from tabweave.sources import corpus, indexing

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidate_search_reads_three_columns_and_joins_by_key(spark, tmp_path):
    path = str(tmp_path / "cells")
    as_cells(hop_rows(spark, FOLDER), "a", "b").withColumn("term", search.F.col("tokenized")).write.parquet(path)
    cells = spark.read.parquet(path)
    text = plan(search.candidates(cells, examples(spark, FOLDER), 1, 1))
    assert all(set(re.findall(r"(\w+):", s)) == {"tableid", "colid", "tokenized"} for s in re.findall(r"ReadSchema: struct<([^>]*tokenized[^>]*)>", text))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas", text)
    rows = search.table_rows(cells, search.candidates(cells, examples(spark, FOLDER), 1, 1), 1, 1)
    text = plan(search.validated(rows, examples(spark, FOLDER), 1, 1))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas", text)


def rows_read(df):
    """(rows that the scan of a plan without shuffles hands on, its text)"""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    return run.executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value(), run.executedPlan().toString()


def test_keys_reach_the_scans_of_both_layouts(spark, tmp_path):
    F = search.F
    own = as_cells(spark.range(20_000).select((F.col("id") % 400).alias("tableid"), (F.col("id") / 400).cast("int").alias("rowid"), F.md5(F.col("id").cast("string")).alias("a"), F.lit("b").alias("b")), "a", "b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # several files of so few rows
    indexing.write_corpus(corpus.Corpus(own.withColumn("term", F.col("tokenized")), own.select("tableid").distinct(), own.select("tableid").distinct()), str(tmp_path))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = corpus.read_corpus(spark, str(tmp_path))
    terms = own.where("colid = 1 and tableid = 3").select("tokenized").limit(1)
    for df, column, keys in ((back.cells, "tokenized", terms), (back.by_table, "tableid", spark.createDataFrame([(7,)], "tableid long"))):
        read, text = rows_read(search.pushed(df, column, keys))
        assert re.search(rf"PushedFilters: \[[^\]]*{column}", text) and read <= 40_000 / 4
    many = spark.range(search.PUSHED + 1).select("id")
    assert search.pushed(back.by_table, "tableid", many) is back.by_table
    assert search.pushed(back.by_table, "tableid", many.limit(0)).count() == 0
    assert search.pushed(back.by_table, "tableid", many.limit(25)).count() == back.by_table.where("tableid < 25").count()
    ex = own.where("colid = 1").select("tableid", F.array("tokenized").alias("x"), F.array(F.lit("b")).alias("y")).where("tableid = 3").drop("tableid")
    text = plan(search.column_hits(back.cells, search.slot_terms(ex.limit(5), 1, 1), 1))
    assert re.search(r"PushedFilters: \[[^\]]*In\(tokenized", text)


def test_statistics_aggregate_before_they_shuffle(spark, tmp_path):
    path = str(tmp_path / "cells")
    as_cells(hop_rows(spark, FOLDER), "a", "b").write.parquet(path)
    text = plan(evaluate.term_counts(spark.read.parquet(path)))
    assert "TakeOrderedAndProject" in text and "partial_count" in text and "ReadSchema: struct<tokenized:string>" in text
