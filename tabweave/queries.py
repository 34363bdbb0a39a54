"""Registered queries of the engine over the driver's tables, and the same in SQL.

The corpus is derived from whole tables: eight overlapping tables of customers and their market segments, three of them
wrong for half of the rows, and a chain of supplier tables with decoys.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig, HopConfig
from .functions import text as T
from .operators import evaluate, multihop, scoring, search
from .operators.sinks import result_grid
from .plans.discover import discover, gather
from .sources import indexing
from .sources.corpus import route_upload
from .storage import Scratch

EXAMPLES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("tableid"))
    wrong = (F.col("tableid") >= 6) & (F.col("c_custkey") % 2 == 0)
    y = F.when(wrong, F.concat(F.lit("wrong "), (F.col("c_custkey") % 5).cast("string"))).otherwise(F.lower("c_mktsegment"))
    return c.where((F.col("c_custkey") + F.col("tableid")) % 3 != 0).select(F.col("tableid").cast("long"), F.col("c_custkey").cast("int").alias("rowid"), F.lower("c_name").alias("x"), y.alias("y"))


def as_cells(rows: DataFrame, *values: str) -> DataFrame:
    columns = F.array(*[F.struct(F.lit(k + 1).alias("colid"), F.col(v).alias("tokenized")) for k, v in enumerate(values)])
    return rows.select("tableid", "rowid", F.explode(columns).alias("c")).select("tableid", "c.colid", "rowid", "c.tokenized")


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables without the examples' customers, which only answers lead to: 9 is right, 10 is wrong."""
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") > EXAMPLES)
    even = F.col("c_custkey") % 2 == 0
    y = F.when(even, F.lower("c_mktsegment")).otherwise(F.concat(F.lit("late "), (F.col("c_custkey") % 5).cast("string")))
    return c.select(F.when(even, 9).otherwise(10).cast("long").alias("tableid"), F.col("c_custkey").cast("int").alias("rowid"), F.lower("c_name").alias("x"), y.alias("y"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_cells(source_rows(spark, sf_dir), "x", "y")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.array(F.lower("c_name")).alias("x"), F.array(F.lower("c_mktsegment")).alias("y"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth(spark, sf_dir).orderBy("c_custkey").limit(EXAMPLES).select("x", "y")


def open_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth(spark, sf_dir).select("x").distinct().join(examples(spark, sf_dir).select("x"), "x", "left_anti")


def hop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key, name = F.col("s_suppkey"), F.lower("s_name")
    code = F.concat(F.lit("sup "), key.cast("string"))
    facts = [
        (101, name, code), (102, code, F.concat(F.lit("hq "), (key + 1000).cast("string"))), (103, name, (key * 3).cast("string")),
        (104, name, F.lower("n_name")), (105, name, F.when(key % 2 == 0, F.concat(F.lit("half "), key.cast("string")))),
    ]
    each = F.array(*[F.struct(F.lit(t).cast("long").alias("tableid"), a.alias("a"), b.alias("b")) for t, a, b in facts])
    return s.select(key.cast("int").alias("rowid"), F.explode(each).alias("r")).select("r.tableid", "rowid", "r.a", "r.b")


def hop_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").orderBy("s_suppkey").limit(EXAMPLES)
    return s.select(F.array(F.lower("s_name")).alias("x"), F.array(F.concat(F.lit("hq "), (F.col("s_suppkey") + 1000).cast("string"))).alias("y"))


def raw_web_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw table for each region: its nations by columns, with a header in every other one."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    headed = F.col("n_regionkey") % 2 == 0
    column = lambda name, field: F.concat(F.when(headed, F.array(F.lit(name))).otherwise(F.array().cast("array<string>")), F.transform("l", lambda e: e[field].cast("string")))
    return n.select(
        (F.col("n_regionkey") + 1).cast("long").alias("tableid"), F.concat(F.lit("http://r/"), F.col("n_regionkey").cast("string")).alias("url"), F.lit("Nations").alias("title"), headed.alias("hasHeader"),
        F.when(headed, "FIRST_ROW").otherwise("NONE").alias("headerPosition"), F.array(column("The Key", "n_nationkey"), column("Name of Nation", "n_name")).alias("relation"),
    )


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.element_at(c, 1) for c, k in df.dtypes if k == "array<string>"})


def index_cells(spark, sf_dir):
    return indexing.build_index(raw_web_tables(spark, sf_dir)).cells


def index_columns(spark, sf_dir):
    return indexing.build_index(raw_web_tables(spark, sf_dir)).columns


def index_postings(spark, sf_dir):
    out = indexing.postings(as_cells(hop_rows(spark, sf_dir), "a", "b"))
    first = F.element_at("postings", 1)
    return out.select("tokenized", F.size("postings").alias("n"), first["tableid"].alias("tableid"), first["rowid"].alias("rowid"), first["colid"].alias("colid"))


def tokenized_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.tokenize("p_name").alias("tokens"), T.standard_tokens("p_type").alias("words"))


def numeric_like(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.col("p_size").cast("string"), "p_brand", "p_name", F.concat_ws(",", F.col("p_size").cast("string"), F.lit("5")))).alias("v"))
    return p.groupBy("p_partkey").agg(F.sum(T.is_numeric_like("v").cast("int")).alias("numeric_like"), F.sum(T.is_strict_number("v").cast("int")).alias("strict"))


def candidates_1x1(spark, sf_dir):
    out = search.candidates(cells(spark, sf_dir), examples(spark, sf_dir), 1, 1, limit=1000)
    return out.select("table_id", F.col("x_cols")[0].alias("x0"), F.col("y_cols")[0].alias("y0"))


def _three_columns(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("nation"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.lit(1).cast("long").alias("tableid"), F.col("c_custkey").cast("int").alias("rowid"), F.lower("c_name").alias("name"), "nation", F.lower("c_mktsegment").alias("segment"))
    ex = rows.orderBy("rowid").limit(20).select(F.array("name", "nation").alias("x"), F.array("segment").alias("y"))
    return as_cells(rows, "name", "nation", "segment"), ex


def candidates_2x1(spark, sf_dir):
    own, ex = _three_columns(spark, sf_dir)
    out = search.candidates(own, ex, 2, 1)
    return out.select("table_id", F.col("x_cols")[0].alias("x0"), F.col("x_cols")[1].alias("x1"), F.col("y_cols")[0].alias("y0"))


def candidates_inputs_only(spark, sf_dir):
    seen = spark.range(1, 3).select(F.col("id").alias("table_id"))
    out = search.candidates(cells(spark, sf_dir), examples(spark, sf_dir), 1, 0, seen=seen)
    return out.select("table_id", F.col("x_cols")[0].alias("x0"))


def _valid(spark, sf_dir):
    own, ex = cells(spark, sf_dir), examples(spark, sf_dir)
    rows = search.table_rows(own, search.candidates(own, ex, 1, 1), 1, 1)
    return rows, search.validated(rows, ex, 1, 1)


def validated_tables(spark, sf_dir):
    return _valid(spark, sf_dir)[1].select("table_id", "hits", "num_rows")


def answers(spark, sf_dir):
    rows, valid = _valid(spark, sf_dir)
    return _flat(search.answers(rows, valid, open_queries(spark, sf_dir), 1))


def table_content(spark, sf_dir):
    return search.table_content(cells(spark, sf_dir), spark.range(1, 9).select(F.col("id").alias("tableid")), [1, 2])


def _outcome(spark, sf_dir, steps=None, **score):
    config = EngineConfig()
    config = dataclasses.replace(config, score=dataclasses.replace(config.score, **score))
    return discover(cells(spark, sf_dir), examples(spark, sf_dir), open_queries(spark, sf_dir), config, steps)


def scores_three_iterations(spark, sf_dir):
    return _flat(_outcome(spark, sf_dir, steps=3).scores).withColumn("score", F.round("score", 6))


def scores_distributed(spark, sf_dir):
    return _flat(_outcome(spark, sf_dir, steps=3, kernel_edges=0).scores).withColumn("score", F.round("score", 6))


def discover_direct(spark, sf_dir):
    return _flat(_outcome(spark, sf_dir).ranking).withColumn("score", F.round("score", 6))


def majority_vote(spark, sf_dir):
    return _flat(_outcome(spark, sf_dir, use_majority_voting=True).ranking.where("rank = 1")).select("x", "y", "score")


def table_metrics(spark, sf_dir):
    m = _outcome(spark, sf_dir, use_majority_voting=True).metrics()
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def requery(spark, sf_dir):
    """Best answers and how many tables support them, after answers of the first round were examples of a second one."""
    config = EngineConfig()
    config = dataclasses.replace(config, score=dataclasses.replace(config.score, max_requery_iterations=1, use_majority_voting=True))
    own = cells(spark, sf_dir).unionByName(as_cells(late_rows(spark, sf_dir), "x", "y"))
    out = discover(own, examples(spark, sf_dir), open_queries(spark, sf_dir), config)
    best = out.ranking.where("rank = 1").select("x", "y")
    return _flat(best.join(out.support, ["x", "y"]).groupBy("x", "y").agg(F.count_distinct("table_id").alias("n_tables")))


def evaluation(spark, sf_dir):
    out = _outcome(spark, sf_dir, use_majority_voting=True)
    rest = truth(spark, sf_dir).select("x", "y").join(open_queries(spark, sf_dir), "x", "left_semi")
    m = evaluate.evaluate(out.ranking, rest)
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


def grid(spark, sf_dir):
    out = result_grid(_outcome(spark, sf_dir, use_majority_voting=True).ranking)
    return _flat(out.select("x", F.array_join("candidates", "; ").alias("candidates")))


def written_back(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).alias("segment"))
    known = source_rows(spark, sf_dir).where("tableid < 6").select(F.array("x").alias("x"), F.array("y").alias("y")).distinct()
    return evaluate.write_back(df, known, ["name"], ["segment"])


def routed_upload(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.lower("c_name")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.when(F.col("c_custkey") % 3 == 1, " ")).alias("segment"))
    ex, q = route_upload(df, ["name"], ["segment"])
    return _flat(ex).withColumn("kind", F.lit("example")).unionByName(_flat(q).withColumns({"y": F.lit(None).cast("string"), "kind": F.lit("query")}))


def corpus_table_statistics(spark, sf_dir):
    out = evaluate.table_statistics(as_cells(hop_rows(spark, sf_dir), "a", "b").unionByName(cells(spark, sf_dir)))
    return out.withColumns({"avg_length": F.round("avg_length", 6), "std_length": F.round("std_length", 6)})


def corpus_term_counts(spark, sf_dir):
    return evaluate.term_counts(cells(spark, sf_dir))


def corpus_cell_count(spark, sf_dir):
    return evaluate.cell_count(cells(spark, sf_dir))


def _hop_long(spark, sf_dir):
    own = as_cells(hop_rows(spark, sf_dir), "a", "b")
    values = hop_examples(spark, sf_dir).select(F.lit("").alias("path"), F.posexplode("x").alias("slot", "token"))
    return own, multihop.long_rows(own, multihop.columns_like(own, values, 1, 2), 1)


def dependency_ratios(spark, sf_dir):
    out = multihop.dependency_ratios(_hop_long(spark, sf_dir)[1])
    return out.select("table_id", "zcol", "n_x", "n_z")


def column_quality(spark, sf_dir):
    out = multihop.column_quality(multihop.first_rows(_hop_long(spark, sf_dir)[1]), HopConfig())
    return out.select("table_id", "zcol", "n_z", "n_key", *[F.round(c, 9).alias(c) for c in ("numeric", "missing", "blank", "short")])


def multi_hop(spark, sf_dir):
    own = as_cells(hop_rows(spark, sf_dir), "a", "b")
    names = table(spark, sf_dir, "supplier").select(F.array(F.lower("s_name")).alias("x"))
    return _flat(multihop.multi_hop(own, hop_examples(spark, sf_dir), names, 1)).select("table_id", "x", "y")


def discover_multi_hop(spark, sf_dir):
    own = as_cells(hop_rows(spark, sf_dir), "a", "b")
    ex = hop_examples(spark, sf_dir)
    names = table(spark, sf_dir, "supplier").select(F.array(F.lower("s_name")).alias("x")).join(ex.select("x"), "x", "left_anti")
    return _flat(discover(own, ex, names, EngineConfig(use_multi_hop=True)).ranking.where("rank = 1")).select("x", "y")


def support_edges(spark, sf_dir):
    own, ex = cells(spark, sf_dir), examples(spark, sf_dir)
    asked = truth(spark, sf_dir).select("x").distinct()
    support, _, _ = gather(own, ex, asked, 1, 1, EngineConfig(), Scratch(spark, "support"), "0")
    return _flat(support)


def corpus_sample(spark, sf_dir):
    """A seeded sample of examples: a sampling operator."""
    chosen, _ = search.example_split(truth(spark, sf_dir), EXAMPLES, 2)
    return _flat(chosen)


QUERIES = {
    f.__name__: f
    for f in (
        index_cells, index_columns, index_postings, tokenized_parts, numeric_like, candidates_1x1, candidates_2x1, candidates_inputs_only, validated_tables, answers, support_edges, table_content,
        scores_three_iterations, scores_distributed, discover_direct, majority_vote, table_metrics, requery, evaluation, grid, written_back, routed_upload, corpus_table_statistics, corpus_term_counts,
        corpus_cell_count, dependency_ratios, column_quality, multi_hop, discover_multi_hop, corpus_sample,
    )
}

_SRC = """src AS (
  SELECT CAST(t.tableid AS BIGINT) AS tableid, c.c_custkey AS rowid, lower(c.c_name) AS x,
         CASE WHEN t.tableid >= 6 AND c.c_custkey % 2 = 0 THEN concat('wrong ', CAST(c.c_custkey % 5 AS VARCHAR)) ELSE lower(c.c_mktsegment) END AS y
  FROM customer c, (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) t(tableid) WHERE (c.c_custkey + t.tableid) % 3 <> 0),
cells AS (SELECT tableid, 1 AS colid, rowid, x AS tokenized FROM src UNION ALL SELECT tableid, 2, rowid, y FROM src),
ex AS (SELECT lower(c_name) AS x, lower(c_mktsegment) AS y FROM customer ORDER BY c_custkey LIMIT 5),
asked AS (SELECT DISTINCT lower(c_name) AS x FROM customer WHERE lower(c_name) NOT IN (SELECT x FROM ex)),
hx AS (SELECT tableid, colid FROM cells WHERE tokenized IN (SELECT x FROM ex) GROUP BY 1, 2 HAVING count(DISTINCT tokenized) >= 2),
hy AS (SELECT tableid, colid FROM cells WHERE tokenized IN (SELECT y FROM ex) GROUP BY 1, 2 HAVING count(DISTINCT tokenized) >= 2),
cand AS (SELECT hx.tableid AS table_id, hx.colid AS x0, hy.colid AS y0 FROM hx JOIN hy ON hx.tableid = hy.tableid AND hx.colid <> hy.colid),
rws AS (SELECT c.table_id, c.x0, c.y0, a.rowid, a.tokenized AS x, b.tokenized AS y FROM cand c JOIN cells a ON a.tableid = c.table_id AND a.colid = c.x0
        JOIN cells b ON b.tableid = c.table_id AND b.colid = c.y0 AND b.rowid = a.rowid),
valid AS (SELECT r.table_id, r.x0, r.y0, count(e.x) AS hits, count(*) AS num_rows FROM rws r LEFT JOIN (SELECT DISTINCT x, y FROM ex) e ON r.x = e.x AND r.y = e.y GROUP BY 1, 2, 3 HAVING count(e.x) >= 2),
support AS (SELECT DISTINCT r.table_id, r.x, r.y FROM rws r JOIN valid v ON r.table_id = v.table_id AND r.x0 = v.x0 AND r.y0 = v.y0
            WHERE r.y IS NOT NULL AND r.y <> '' AND (r.x IN (SELECT x FROM asked) OR r.x IN (SELECT x FROM ex))),
s0 AS (SELECT DISTINCT x, y, 1.0::DOUBLE AS score, true AS is_example FROM ex UNION ALL
       SELECT DISTINCT s.x, s.y, 0.0::DOUBLE, false FROM support s WHERE NOT EXISTS (SELECT 1 FROM ex e WHERE e.x = s.x AND e.y = s.y)),
votes AS (SELECT s.x, s.y, count(DISTINCT s.table_id) AS n FROM support s JOIN s0 USING (x, y) WHERE NOT is_example GROUP BY 1, 2),
won AS (SELECT x, y, CASE WHEN row_number() OVER (PARTITION BY x ORDER BY n DESC, y) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM votes),
mine AS (SELECT x, y, score, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS rank FROM won WHERE x IN (SELECT x FROM asked))"""


#: Iterations that the SQL of settled scores states; it chooses the first that meets the rule.
STATED = 30


def _steps(n: int) -> str:
    steps = []
    for k in range(1, n + 1):
        p = k - 1
        steps.append(f"""b{k} AS MATERIALIZED (SELECT x, max(score) AS best FROM s{p} GROUP BY x),
e{k} AS (SELECT u.table_id, u.x, s.score, b.best, round(s.score, 12) = round(b.best, 12) AS top FROM support u JOIN s{p} s USING (x, y) JOIN b{k} b USING (x)),
x{k} AS (SELECT table_id, x, sum(CASE WHEN top THEN score ELSE 0 END) AS good, sum(CASE WHEN top THEN 0 ELSE 1 END) AS bad, max(best) AS covered FROM e{k} GROUP BY 1, 2),
g{k} AS (SELECT table_id, sum(good) AS good, sum(bad) AS bad, sum(covered) AS covered FROM x{k} GROUP BY 1),
t{k} AS MATERIALIZED (SELECT table_id, 0.99 * (0.5 * good) / (0.5 * good + 0.5 * (bad + (SELECT sum(best) FROM b{k}) - covered)) AS s FROM g{k}),
w{k} AS (SELECT u.x, u.y, product(CASE WHEN o.y IS NOT NULL THEN t.s ELSE 1 - t.s END) AS p
         FROM s{p} u JOIN (SELECT DISTINCT table_id, x FROM support) d USING (x) JOIN t{k} t ON t.table_id = d.table_id
         LEFT JOIN support o ON o.table_id = d.table_id AND o.x = u.x AND o.y = u.y WHERE NOT u.is_example GROUP BY 1, 2),
z{k} AS (SELECT d.x, product(1 - t.s) AS p0 FROM (SELECT DISTINCT table_id, x FROM support) d JOIN t{k} t USING (table_id) GROUP BY 1),
s{k} AS MATERIALIZED (SELECT x, y, score, is_example FROM s{p} WHERE is_example UNION ALL
       SELECT w.x, w.y, round(w.p / (z.p0 + sum(w.p) OVER (PARTITION BY w.x)), 12), false FROM w{k} w JOIN z{k} z USING (x))""")
    return f"WITH {_SRC}, " + ", ".join(steps)


def _iterations(n: int) -> str:
    return _steps(n) + f" SELECT x, y, round(score, 6) AS score, is_example FROM s{n}"


def _settled(n: int) -> str:
    """Rankings after the first iteration but one that changes scores by 0.01 at most."""
    moved = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.score - coalesce(b.score, 0))) AS delta FROM s{k} a LEFT JOIN s{k - 1} b USING (x, y)" for k in range(2, n + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, x, y, score FROM s{k}" for k in range(2, n + 1))
    return f"""{_steps(n)}, moved AS ({moved}), every AS ({every}),
        done AS (SELECT x, y, score FROM every WHERE k = (SELECT min(k) FROM moved WHERE delta <= 0.01) AND x IN (SELECT x FROM asked))
        SELECT x, y, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS INTEGER) AS rank FROM done"""


_SECOND = """first AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS r FROM (SELECT x, y, score FROM won UNION ALL SELECT DISTINCT x, y, 0.0::DOUBLE FROM ex)),
again AS (SELECT x, y FROM first WHERE r = 1 ORDER BY md5(concat_ws(chr(31), '2', x, y)), x, y LIMIT 50),
late AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 9 ELSE 10 END::BIGINT AS tableid, c_custkey AS rowid, lower(c_name) AS x,
         CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE concat('late ', CAST(c_custkey % 5 AS VARCHAR)) END AS y FROM customer WHERE c_custkey > 5),
unseen AS (SELECT tableid, rowid, 1 AS colid, x AS tokenized FROM late UNION ALL SELECT tableid, rowid, 2, y FROM late
           UNION ALL SELECT tableid, rowid, colid, tokenized FROM cells WHERE tableid NOT IN (SELECT table_id FROM cand)),
ux AS (SELECT tableid, colid FROM unseen WHERE tokenized IN (SELECT x FROM again) GROUP BY 1, 2 HAVING count(DISTINCT tokenized) >= 2),
uy AS (SELECT tableid, colid FROM unseen WHERE tokenized IN (SELECT y FROM again) GROUP BY 1, 2 HAVING count(DISTINCT tokenized) >= 2),
urows AS (SELECT a.tableid AS table_id, a.colid AS x0, b.colid AS y0, a.tokenized AS x, b.tokenized AS y FROM unseen a JOIN unseen b ON a.tableid = b.tableid AND a.rowid = b.rowid AND a.colid <> b.colid
          JOIN ux ON ux.tableid = a.tableid AND ux.colid = a.colid JOIN uy ON uy.tableid = b.tableid AND uy.colid = b.colid),
uvalid AS (SELECT table_id, x0, y0 FROM urows JOIN again USING (x, y) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
both_rounds AS (SELECT table_id, x, y FROM support UNION SELECT table_id, x, y FROM urows JOIN uvalid USING (table_id, x0, y0) WHERE x IN (SELECT x FROM asked)),
counted AS (SELECT x, y, count(DISTINCT table_id) AS n_tables FROM both_rounds GROUP BY 1, 2)"""


_HOP = """hop AS (
  SELECT s_suppkey AS rowid, 101 AS tableid, lower(s_name) AS a, concat('sup ', CAST(s_suppkey AS VARCHAR)) AS b FROM supplier
  UNION ALL SELECT s_suppkey, 102, concat('sup ', CAST(s_suppkey AS VARCHAR)), concat('hq ', CAST(s_suppkey + 1000 AS VARCHAR)) FROM supplier
  UNION ALL SELECT s_suppkey, 103, lower(s_name), CAST(s_suppkey * 3 AS VARCHAR) FROM supplier
  UNION ALL SELECT s_suppkey, 104, lower(s_name), lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT s_suppkey, 105, lower(s_name), CASE WHEN s_suppkey % 2 = 0 THEN concat('half ', CAST(s_suppkey AS VARCHAR)) END FROM supplier),
hcells AS (SELECT CAST(tableid AS BIGINT) AS tableid, 1 AS colid, CAST(rowid AS INTEGER) AS rowid, a AS tokenized FROM hop UNION ALL SELECT tableid, 2, rowid, b FROM hop)"""

_NATIONS = """web AS (SELECT CAST(n_regionkey + 1 AS BIGINT) AS tableid, n_regionkey % 2 = 0 AS headed, n_nationkey, n_name,
  CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS rowid FROM nation),
raw AS (SELECT tableid, 1 AS colid, rowid, CAST(n_nationkey AS VARCHAR) AS term FROM web UNION ALL SELECT tableid, 2, rowid, n_name FROM web)"""
_STOP = "['" + "','".join(EngineConfig().index.stop_words) + "']"


def _tokens(c: str) -> str:
    """SQL of the tokeniser."""
    plain = f"trim(regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', '', 'g'))"
    return f"nullif(array_to_string(list_filter(regexp_split_to_array({plain}, '\\s+'), lambda w: length(w) >= 1 AND NOT list_contains({_STOP}, w)), ' '), '')"


_FLOAT = r"^[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)(e[+-]?[0-9](_?[0-9])*)?$|^[+-]?(inf|infinity|nan)$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity)$"
ORACLES = {
    "index_cells": f"WITH {_NATIONS} SELECT tableid, colid, rowid, term, {_tokens('term')} AS tokenized FROM raw",
    "index_columns": f"""WITH {_NATIONS}, h AS (SELECT DISTINCT tableid, colid, CASE WHEN tableid % 2 = 1 THEN CASE colid WHEN 1 THEN 'The Key' ELSE 'Name of Nation' END END AS header FROM raw)
        SELECT tableid, colid, header, {_tokens('header')} AS header_tokenized FROM h""",
    "index_postings": f"""WITH {_HOP} SELECT tokenized, CAST(count(*) AS INTEGER) AS n, min((tableid, rowid, colid))[1] AS tableid, CAST(min((tableid, rowid, colid))[2] AS INTEGER) AS rowid, min((tableid, rowid, colid))[3] AS colid
        FROM hcells WHERE tokenized IS NOT NULL GROUP BY tokenized""",
    "tokenized_parts": f"""SELECT p_partkey, {_tokens('p_name')} AS tokens, array_to_string(list_filter(regexp_extract_all(lower(p_type), '[\\p{{L}}\\p{{N}}_]+'), lambda w: NOT list_contains({_STOP}, w)), ' ') AS words FROM part""",
    "numeric_like": f"""WITH v AS (SELECT p_partkey, unnest([CAST(p_size AS VARCHAR), p_brand, p_name, concat(CAST(p_size AS VARCHAR), ',5')]) AS v FROM part)
        SELECT p_partkey, sum(CASE WHEN regexp_matches(replace(replace(v, ',', '.'), ' ', ''), '{_FLOAT}', 'i') OR (regexp_matches(v, '^[0-9\\s,.]+$') AND regexp_matches(v, '[0-9]')) THEN 1 ELSE 0 END)::BIGINT AS numeric_like,
               sum(CASE WHEN regexp_matches(trim(v), '{_NUMBER}', 'i') THEN 1 ELSE 0 END)::BIGINT AS strict FROM v GROUP BY 1""",
    "candidates_1x1": f"WITH {_SRC} SELECT table_id, x0, y0 FROM cand ORDER BY 1, 2, 3 LIMIT 1000",
    "candidates_2x1": """WITH rws AS (SELECT c_custkey AS rowid, lower(c_name) AS a, lower(n_name) AS b, lower(c_mktsegment) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey),
        cells AS (SELECT 1 AS colid, a AS t FROM rws UNION ALL SELECT 2, b FROM rws UNION ALL SELECT 3, c FROM rws), ex AS (SELECT * FROM rws ORDER BY rowid LIMIT 20),
        h0 AS (SELECT colid FROM cells WHERE t IN (SELECT a FROM ex) GROUP BY 1 HAVING count(DISTINCT t) >= 2), h1 AS (SELECT colid FROM cells WHERE t IN (SELECT b FROM ex) GROUP BY 1 HAVING count(DISTINCT t) >= 2),
        h2 AS (SELECT colid FROM cells WHERE t IN (SELECT c FROM ex) GROUP BY 1 HAVING count(DISTINCT t) >= 2)
        SELECT 1::BIGINT AS table_id, h0.colid AS x0, h1.colid AS x1, h2.colid AS y0 FROM h0, h1, h2 WHERE h0.colid <> h1.colid AND h0.colid <> h2.colid AND h1.colid <> h2.colid""",
    "candidates_inputs_only": f"WITH {_SRC} SELECT tableid AS table_id, colid AS x0 FROM hx WHERE tableid NOT IN (1, 2)",
    "validated_tables": f"WITH {_SRC} SELECT table_id, hits, num_rows FROM valid",
    "answers": f"WITH {_SRC} SELECT DISTINCT table_id, x, y FROM support WHERE x IN (SELECT x FROM asked)",
    "support_edges": f"WITH {_SRC} SELECT table_id, x, y FROM support",
    "table_content": f"WITH {_SRC} SELECT tableid, CAST(rowid AS INTEGER) AS rowid, max(CASE WHEN colid = 1 THEN tokenized END) AS c1, max(CASE WHEN colid = 2 THEN tokenized END) AS c2 FROM cells GROUP BY 1, 2",
    "scores_three_iterations": _iterations(3),
    "scores_distributed": _iterations(3),
    "discover_direct": _settled(STATED),
    "requery": f"""WITH {_SRC}, {_SECOND}
        SELECT x, y, n_tables FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n_tables DESC, y) AS r FROM counted WHERE x IN (SELECT x FROM asked)) WHERE r = 1""",
    "corpus_sample": """SELECT x, y FROM (SELECT DISTINCT lower(c_name) AS x, lower(c_mktsegment) AS y FROM customer) ORDER BY md5(concat_ws(chr(31), '2', x, y)), x, y LIMIT 5""",
    "majority_vote": f"WITH {_SRC} SELECT x, y, score FROM mine WHERE rank = 1",
    "table_metrics": f"""WITH {_SRC}, best AS (SELECT DISTINCT table_id FROM support JOIN mine USING (x, y) WHERE rank = 1),
        per AS (SELECT table_id, max(num_rows) AS num_rows FROM valid GROUP BY 1)
        SELECT count(*)::DOUBLE AS n_tables, round(avg(num_rows), 6) AS avg_table_size, 0.0::DOUBLE AS n_tables_multi, 0.0::DOUBLE AS avg_table_size_multi,
               count(*) FILTER (WHERE table_id IN (SELECT table_id FROM best))::DOUBLE AS n_tables_best, round(avg(num_rows) FILTER (WHERE table_id IN (SELECT table_id FROM best)), 6) AS avg_table_size_best,
               0.0::DOUBLE AS n_tables_best_multi, 0.0::DOUBLE AS avg_table_size_best_multi FROM per""",
    "evaluation": f"""WITH {_SRC}, tr AS (SELECT DISTINCT lower(c_name) AS x, lower(c_mktsegment) AS t FROM customer WHERE lower(c_name) IN (SELECT x FROM asked)),
        per AS (SELECT tr.x, tr.t, max(CASE WHEN m.x IS NOT NULL THEN 1 ELSE 0 END) AS answered, max(CASE WHEN m.y = tr.t AND rank = 1 THEN 1 ELSE 0 END) AS top1, max(CASE WHEN m.y = tr.t AND rank <= 5 THEN 1 ELSE 0 END) AS top5,
                max(CASE WHEN m.y = tr.t THEN 1 ELSE 0 END) AS topall FROM tr LEFT JOIN mine m ON tr.x = m.x GROUP BY 1, 2),
        s AS (SELECT count(*)::DOUBLE AS n, sum(answered)::DOUBLE AS answered, sum(top1)::DOUBLE AS top1, sum(top5)::DOUBLE AS top5, sum(topall)::DOUBLE AS topall FROM per)
        SELECT round(top1 / answered, 9) AS precision, round(top1 / n, 9) AS recall, round(2 * (top1 / answered) * (top1 / n) / (top1 / answered + top1 / n), 9) AS f1_score, round(top1 / n, 9) AS top1_acc,
               round(top5 / n, 9) AS top5_acc, round(topall / n, 9) AS topall_acc, round(answered / n, 9) AS answered_rate FROM s""",
    "grid": f"WITH {_SRC} SELECT x, concat(y, ' (1.00)') AS candidates FROM mine WHERE rank = 1",
    "written_back": f"""WITH {_SRC}, k AS (SELECT x, min(y) AS y FROM src WHERE tableid < 6 GROUP BY 1)
        SELECT c_custkey, lower(c_name) AS name, coalesce(CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END, k.y) AS segment FROM customer LEFT JOIN k ON lower(c_name) = k.x""",
    "routed_upload": """SELECT lower(c_name) AS x, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) END AS y, CASE WHEN c_custkey % 3 = 0 THEN 'example' ELSE 'query' END AS kind FROM customer WHERE c_custkey % 7 <> 0""",
    "corpus_table_statistics": f"""WITH {_SRC}, {_HOP}, l AS (SELECT tableid, count(DISTINCT rowid) AS length FROM (SELECT tableid, rowid FROM cells UNION ALL SELECT tableid, rowid FROM hcells) GROUP BY 1)
        SELECT count(*) AS table_count, min(length) AS min_length, max(length) AS max_length, round(avg(length), 6) AS avg_length, round(stddev_samp(length), 6) AS std_length, quantile_disc(length, 0.5) AS median_length,
               quantile_disc(length, 0.25) AS p25, quantile_disc(length, 0.75) AS p75, quantile_disc(length, 0.9) AS p90, quantile_disc(length, 0.99) AS p99 FROM l""",
    "corpus_term_counts": f"WITH {_SRC} SELECT tokenized, count(*) AS term_count FROM cells GROUP BY 1 ORDER BY term_count DESC, tokenized LIMIT 10000",
    "corpus_cell_count": f"WITH {_SRC} SELECT count(*) AS cell_count FROM cells",
    "dependency_ratios": f"""WITH {_HOP} SELECT CAST(tableid AS BIGINT) AS table_id, 2 AS zcol, count(DISTINCT a) AS n_x, count(DISTINCT b) AS n_z FROM hop WHERE tableid <> 102 GROUP BY 1""",
    "column_quality": f"""WITH {_HOP} SELECT CAST(tableid AS BIGINT) AS table_id, 2 AS zcol, count(DISTINCT b) AS n_z, count(DISTINCT a) AS n_key, round(avg(CASE WHEN regexp_matches(coalesce(b, ''), '{_NUMBER}', 'i') THEN 1.0 ELSE 0.0 END), 9) AS numeric,
        round(avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0.0 END), 9) AS missing, round(avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0.0 END), 9) AS blank, round(avg(CASE WHEN length(b) < 2 THEN 1.0 ELSE 0.0 END), 9) AS short
        FROM hop WHERE tableid <> 102 GROUP BY 1""",
    "multi_hop": f"""WITH {_HOP} SELECT -1::BIGINT AS table_id, p.a AS x, q.b AS y FROM hop p JOIN hop q ON p.tableid = 101 AND q.tableid = 102 AND p.b = q.a""",
    "discover_multi_hop": f"""WITH {_HOP} SELECT p.a AS x, q.b AS y FROM hop p JOIN hop q ON p.tableid = 101 AND q.tableid = 102 AND p.b = q.a WHERE p.rowid NOT IN (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5)""",
}
