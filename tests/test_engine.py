"""The engine against plain Python versions of its rules."""

import dataclasses
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabweave.config import EngineConfig, HopConfig, ScoreConfig
from tabweave.functions import fuzzy, text
from tabweave.functions.stemming import porter, stemmer
from tabweave.operators import evaluate, multihop, scoring, search
from tabweave.plans.discover import discover, run_exercise, transform
from tabweave.sources import corpus, indexing
from tabweave.storage import Scratch
from tabweave.streaming import index as streaming

CELLS = "tableid long, colid int, rowid int, tokenized string"


def cells_of(tables):
    """tables: {id: rows of values}."""
    return [(t, c + 1, r + 1, v) for t, rows in tables.items() for r, row in enumerate(rows) for c, v in enumerate(row)]


@pytest.fixture(scope="module")
def toy(spark):
    r = random.Random(1)
    keys = [f"k{i}" for i in range(30)]
    good = {k: f"v{i}" for i, k in enumerate(keys)}
    tables = {}
    for t in range(1, 9):
        rows = []
        for k in keys:
            if r.random() < 0.7:
                rows.append((k, good[k] if t < 6 or r.random() < 0.5 else f"w{r.randint(0, 3)}", "noise"))
        tables[t] = rows
    tables[9] = [("k0", "v1", "x"), ("k1", "v0", "y")]  # tokens, but no whole example
    examples = [([k], [good[k]]) for k in keys[:5]]
    return tables, examples, [([k],) for k in keys[5:]], good


def plain_support(tables, examples, queries, tau=2):
    out, sizes = set(), {}
    ex = {(x[0], y[0]) for x, y in examples}
    asked = {q[0][0] for q in queries} | {x for x, _ in ex}
    for t, rows in tables.items():
        n = len(rows[0])
        for a in range(n):
            for b in range(n):
                if a == b or len({r[a] for r in rows} & {x for x, _ in ex}) < tau or len({r[b] for r in rows} & {y for _, y in ex}) < tau:
                    continue
                if sum((r[a], r[b]) in ex for r in rows) >= tau:
                    out |= {(t, r[a], r[b]) for r in rows if r[a] in asked and r[b]}
                    sizes[t] = len(rows)
    return out, sizes


def plain_scores(support, examples, config, steps=None):
    ex = {(x[0], y[0]) for x, y in examples}
    score = {a: 1.0 for a in ex} | {(x, y): 0.0 for _, x, y in support if (x, y) not in ex}
    for k in range(1, (steps or 100) + 1):
        best = defaultdict(float)
        for (x, _), s in score.items():
            best[x] = max(best[x], s)
        tables = {}
        for t in {e[0] for e in support}:
            own = [(x, y) for u, x, y in support if u == t]
            good = sum(score[a] for a in own if round(score[a], 12) == round(best[a[0]], 12))
            bad = sum(round(score[a], 12) != round(best[a[0]], 12) for a in own)
            unseen = sum(best.values()) - sum(best[x] for x in {x for x, _ in own})
            under = config.table_prior * good + (1 - config.table_prior) * (bad + unseen)
            tables[t] = config.alpha * config.table_prior * good / under if under else 0.0
        new = {a: 1.0 for a in ex}
        for x in {x for x, y in score if (x, y) not in ex}:
            speak = {t for t, u, _ in support if u == x}
            p = {}
            for y in (b for a, b in score if a == x and (a, b) not in ex):
                back = {t for t, u, v in support if (u, v) == (x, y)}
                p[y] = math.prod(tables[t] if t in back else 1 - tables[t] for t in speak)
            none = math.prod(1 - tables[t] for t in speak)
            total = none + sum(p.values())
            new |= {(x, y): (v / total if total else 0.0) for y, v in p.items()}
        delta = sum(abs(new[a] - score[a]) for a in new)
        score = new
        if steps is None and k > 1 and delta <= config.epsilon:
            break
    return score, tables


def frames(spark, toy):
    tables, examples, queries, _ = toy
    return spark.createDataFrame(cells_of(tables), CELLS), spark.createDataFrame(examples, "x array<string>, y array<string>"), spark.createDataFrame(queries, "x array<string>")


@pytest.mark.parametrize("edges", [10**6, 0])
def test_discovery_equals_plain_rules(spark, toy, edges):
    tables, examples, queries, good = toy
    config = EngineConfig(score=ScoreConfig(kernel_edges=edges))
    steps = None if edges else 4
    out = discover(*frames(spark, toy), config, steps)
    support, sizes = plain_support(tables, examples, queries)
    assert {(r.table_id, r.x[0], r.y[0]) for r in out.support.collect()} == support
    assert {r.table_id: r.num_rows for r in out.sizes.collect()} == sizes and 9 not in sizes
    want, _ = plain_scores(support, examples, config.score, steps)
    got = {(r.x[0], r.y[0]): r.score for r in out.scores.collect()}
    assert set(got) == set(want) and all(got[a] == pytest.approx(want[a], abs=1e-6) for a in want)
    first = {r.x[0]: r.y[0] for r in out.ranking.where("rank = 1").collect()}
    assert sum(first[k] == good[k] for k in first) >= 0.9 * len(first)
    m = out.metrics().first()
    assert m.n_tables == len(sizes) and m.avg_table_size == pytest.approx(sum(sizes.values()) / len(sizes)) and m.n_tables_multi == 0


def test_majority_and_requery(spark, toy):
    tables, examples, queries, _ = toy
    out = discover(*frames(spark, toy), EngineConfig(score=ScoreConfig(use_majority_voting=True)))
    support, _ = plain_support(tables, examples, queries)
    votes = defaultdict(lambda: defaultdict(int))
    for _, x, y in support:
        votes[x][y] += 1
    first = {r.x[0]: r.y[0] for r in out.ranking.where("rank = 1").collect()}
    assert first == {q[0][0]: min(votes[q[0][0]], key=lambda y: (-votes[q[0][0]][y], y)) for q in queries if q[0][0] in votes}
    again = discover(*frames(spark, toy), EngineConfig(score=ScoreConfig(max_requery_iterations=1)))
    assert again.ranking.where("rank = 1").count() == len(first)


def test_two_inputs_nulls_and_column_orders(spark):
    tables = {1: [("a", "b", "c"), ("d", "e", "f"), ("g", "h", "i"), (None, "h", "j")], 2: [("c", "b", "a"), ("f", "e", "d")], 3: [("a", "e", "c"), ("d", "b", "f")]}
    cells = spark.createDataFrame(cells_of(tables), CELLS)
    ex = spark.createDataFrame([(["a", "b"], ["c"]), (["d", "e"], ["f"])], "x array<string>, y array<string>")
    cands = search.candidates(cells, ex, 2, 1)
    assert {(r.table_id, tuple(r.x_cols), tuple(r.y_cols)) for r in cands.collect()} == {(1, (1, 2), (3,)), (2, (3, 2), (1,)), (3, (1, 2), (3,))}
    rows = search.table_rows(cells, cands, 2, 1)
    valid = search.validated(rows, ex, 2, 1)
    assert {(r.table_id, r.hits, r.num_rows) for r in valid.collect()} == {(1, 2, 4), (2, 2, 2)}
    found = search.answers(rows, valid, spark.createDataFrame([(["g", "h"],), ([None, "h"],)], "x array<string>"), 2)
    assert {(r.table_id, tuple(r.x), tuple(r.y)) for r in found.collect()} == {(1, ("g", "h"), ("i",)), (1, (None, "h"), ("j",))}
    assert search.distinct_queries(spark.createDataFrame([(["g", "h"],), (["g", "h"],), ([None, "h"],)], "x array<string>")).count() == 1
    seen = spark.createDataFrame([(1,)], "table_id long")
    assert {r.table_id for r in search.candidates(cells, ex, 2, 1, seen=seen, limit=1).collect()} == {2}


def test_pivot_and_duplicate_cells(spark):
    cells = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "b"), (1, 2, 2, "c"), (2, 1, 1, "x"), (2, 1, 1, "y")], CELLS)
    got = search.table_content(cells, spark.range(1, 3).select(F.col("id").alias("tableid")), [1, 2])
    assert {tuple(r) for r in got.collect()} == {(1, 1, "a", "b"), (1, 2, None, "c")}
    assert [tuple(r) for r in search.duplicate_cells(cells).collect()] == [(2, 1, 1, 2)]


def test_multi_hop_and_gates(spark):
    n = 40
    tables = {
        101: [(f"s{i}", f"code {i}") for i in range(n)], 102: [(f"code {i}", f"hq {i}") for i in range(n)], 103: [(f"s{i}", str(i * 3)) for i in range(n)],
        104: [(f"s{i}", f"nat {i % 5}") for i in range(n)], 105: [(f"s{i}", f"half {i}" if i % 2 else None) for i in range(n)],
    }
    cells = spark.createDataFrame(cells_of(tables), CELLS)
    ex = spark.createDataFrame([([f"s{i}"], [f"hq {i}"]) for i in range(5)], "x array<string>, y array<string>")
    q = spark.createDataFrame([([f"s{i}"],) for i in range(5, n)], "x array<string>")
    got = multihop.multi_hop(cells, ex, q, 1)
    assert {(r.table_id, r.path, r.x[0], r.y[0]) for r in got.collect()} == {(-1, "101:1:2/102:1:2", f"s{i}", f"hq {i}") for i in range(n)}
    out = discover(cells, ex, q, EngineConfig(use_multi_hop=True))
    assert {(r.x[0], r.y[0]) for r in out.ranking.where("rank = 1").collect()} == {(f"s{i}", f"hq {i}") for i in range(5, n)}
    assert multihop.multi_hop(cells, ex, q, 1, config=HopConfig(max_path_len=1)).count() == 0
    with pytest.raises(ValueError):
        discover(cells, ex.withColumn("y", F.concat("y", "y")), q, EngineConfig(use_multi_hop=True))
    assert multihop.restrict_numbers(ex) and not multihop.restrict_numbers(spark.createDataFrame([(["1,5"], ["a"]), (["2"], ["b"])], "x array<string>, y array<string>"))


def test_canonical_answers(spark):
    s = spark.createDataFrame([(1, ["a"], ["new york"]), (2, ["a"], ["new yorks"]), (3, ["a"], ["boston"]), (4, ["b"], ["new yorks"])], "table_id long, x array<string>, y array<string>")
    got = {(r.table_id, r.x[0], r.y[0]) for r in search.canonical(s, "ratio", 0.9).collect()}
    assert got == {(1, "a", "new york"), (2, "a", "new york"), (3, "a", "boston"), (4, "b", "new yorks")}


def test_fuzzy_scores(spark):
    r = random.Random(2)

    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if p == q else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for _ in range(300):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert fuzzy.common(a, b) == lcs(a, b)
    assert fuzzy.similarity("this is a test", "this is a test!") == pytest.approx(2 * 14 / 29)
    assert fuzzy.similarity("fuzzy wuzzy was", "wuzzy fuzzy was", "token_sort") == 1
    assert fuzzy.similarity("fuzzy was a bear", "fuzzy fuzzy was a bear", "token_set") == 1
    assert fuzzy.similarity("a b", "b c", "max3") >= fuzzy.similarity("a b", "b c", "ratio")
    assert fuzzy.similarity(None, "a") == fuzzy.similarity("", "") == 0
    with pytest.raises(ValueError):
        fuzzy.similarity("a", "b", "other")
    df = spark.createDataFrame([("abcd", "abcx", ["abcd"], ["abcd"]), (None, "a", ["a"], ["a", "b"])], "a string, b string, p array<string>, q array<string>")
    got = df.select(fuzzy.fuzzy_score("a", "b").alias("s"), fuzzy.fuzzy_match("a", "b", threshold=0.7).alias("m"), fuzzy.fuzzy_tuple_match("p", "q").alias("t")).collect()
    assert [tuple(x) for x in got] == [(0.75, True, True), (0.0, False, False)]


def test_text_functions(spark):
    values = ["1", "1,5", "1e3", "1_000", "inf", "2020-01-31", "12.3.99", "1 000", "1d", "0x1", "abc", " ", "", None, "1__0", ".5", "5.", "1,2,3", "+-1", "nan", " 7 "]

    def numeric(s):
        import re

        s = (s or "").strip()
        try:
            float(s.replace(" ", "").replace(",", ".").replace("\xa0", ""))
            return True
        except ValueError:
            return bool(re.match(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$", s) or (re.match(r"^[\d\s,\.]+$", s) and any(c.isdigit() for c in s)))

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert {r.i: r.n for r in df.select("i", text.is_numeric_like("v").alias("n")).collect()} == {i: numeric(v) for i, v in enumerate(values)}
    strict = {r.v for r in df.where(text.is_strict_number("v")).collect()}
    assert strict == {"1", "1e3", "inf", ".5", "5.", " 7 "}
    one = spark.createDataFrame([("The Cat's, of-Paris!", " FIRST_ROW. ", "/d/City_State2Zip_tokenized.csv", '"q"')], "t string, p string, f string, q string")
    r = one.select(text.tokenize("t").alias("t"), text.standard_tokens("t").alias("s"), text.is_first_row("p").alias("p"), text.exercise_name("f").alias("f"), text.input_columns(text.exercise_name("f")).alias("k"), text.unquoted("q").alias("q"), text.exercise_title(text.exercise_name("f")).alias("title")).first()
    assert (r.t, r.s, r.p, r.f, r.k, r.q, r.title) == ("cats ofparis", "cat's paris", True, "City_State2Zip", 2, "q", "City & State → Zip")
    none = spark.createDataFrame([("the of",), ("  ",), (None,), ("...",)], "t string").select(text.tokenize("t").alias("t")).collect()
    assert all(x.t is None for x in none)
    label = spark.createDataFrame([("a (b) c", 0.456)], "y string, s double").select(text.candidate_label("y", "s").alias("l")).select("l", text.candidate_of_label("l").alias("y")).first()
    assert tuple(label) == ("a (b) c (0.46)", "a (b) c")


def test_stemming(spark):
    words = "caresses ponies ties caress cats feed agreed plastered motoring sing conflated sized hopping falling hissing failing happy sky relational conditional rational hopefulness electriciti formaliti replacement adjustment adoption rate cease controll roll".split()
    stems = "caress poni ti caress cat feed agre plaster motor sing conflat size hop fall hiss fail happi sky relat condit ration hope electr formal replac adjust adopt rate ceas control roll".split()
    assert [porter(w) for w in words] == stems
    with pytest.raises(ValueError):
        stemmer("other")
    from tabweave.config import IndexConfig

    got = spark.createDataFrame([("The Ponies of Paris",)], "t string").select(text.tokenize("t", IndexConfig(stemmer="porter")).alias("t")).first()
    assert got.t == "poni pari"


def test_index_sources_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [
        '{"url": "u1", "title": "t", "hasHeader": true, "headerPosition": "FIRST_ROW", "relation": [["City", "Paris", "Rome"], ["", "France", "the"]]}', "",
        '{"url": "u2", "title": null, "hasHeader": true, "headerPosition": "MIXED", "relation": [["a", null]]}',
    ]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "in" / "ignored.txt").write_text("x")
    raw = indexing.numbered(corpus.read_web_tables(spark, str(tmp_path / "in")), ["url"])
    built = indexing.build_index(raw)
    assert {tuple(r) for r in built.cells.collect()} == {(1, 1, 1, "Paris", "paris"), (1, 1, 2, "Rome", "rome"), (1, 2, 1, "France", "france"), (1, 2, 2, "the", None), (2, 1, 1, "a", None), (2, 1, 2, None, None)}
    assert {tuple(r) for r in built.columns.collect()} == {(1, 1, "City", "city"), (1, 2, None, None), (2, 1, None, None)}
    assert {tuple(r) for r in built.tables.collect()} == {(1, "u1", "t", 0.5), (2, "u2", None, 0.5)}
    indexing.write_corpus(built, str(tmp_path / "out"))
    back = corpus.read_corpus(spark, str(tmp_path / "out"))
    assert back.cells.count() == 6 and back.tables.count() == 2 and back.by_table.exceptAll(back.cells).count() == 0 and back.by_table.count() == 6
    assert {r.tokenized: [tuple(p) for p in r.postings] for r in indexing.postings(back.cells).collect()}["rome"] == [(1, 2, 1)]
    rows = spark.createDataFrame([(1, [[("A",), ("b",)], [("c",), (None,)]])], "tableid long, tableData array<array<struct<text: string>>>")
    assert {tuple(r) for r in indexing.build_row_major(rows).collect()} == {(1, 0, 0, "A", None), (1, 1, 0, "b", "b"), (1, 0, 1, "c", "c"), (1, 1, 1, None, None)}
    query = streaming.maintain_index(streaming.arriving_tables(spark, str(tmp_path / "in")), str(tmp_path / "idx"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert all(spark.read.parquet(str(tmp_path / "idx" / name)).count() == 6 for name in ("cells", "cells_by_table"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "idx" / "tables")).select("url").collect()} == {("u1",), ("u2",)}


def test_files_and_sinks(spark, tmp_path):
    from tabweave.operators import sinks

    (tmp_path / "City2Land.csv").write_text('City,Land\nParis,"France"\nRome,\n')
    ex = corpus.read_exercise(spark, str(tmp_path / "City2Land.csv")).collect()
    assert {tuple(r) for r in ex} == {("City2Land", 1, "Paris", "France"), ("City2Land", 1, "Rome", None)}
    (tmp_path / "up.csv").write_text("a;b\n1,5;x\n")
    assert [tuple(r) for r in corpus.read_upload(spark, str(tmp_path / "up.csv")).collect()] == [("1,5", "x")]
    assert corpus.read_upload(spark, str(tmp_path / "up.csv"), header=False).columns == ["0", "1"]
    out = sinks.write_tokenized(spark, str(tmp_path / "City2Land.csv"))
    assert {tuple(r) for r in corpus.read_raw_rows(spark, out).select("_c0").collect()} == {("city",), ("paris",), ("rome",)}
    assert sinks.write_tokenized(spark, out) is None
    ranked = spark.createDataFrame([(["a"], ["b"], 0.9, 1), (["a"], ["c"], 0.05, 2), (["a"], ["d"], 0.001, 3)], "x array<string>, y array<string>, score double, rank int")
    assert sinks.result_grid(ranked).first().candidates == ["b (0.90)", "c (0.05)"]
    sinks.write_answers(ranked.select("score"), str(tmp_path / "ans"))
    sinks.write_log(spark.createDataFrame([(1.0,)], "precision double"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first().precision == 1.0


def test_evaluation(spark):
    truth = spark.createDataFrame([(["a"], ["X "]), (["b"], ["y"]), (["c"], ["z"]), (["d"], ["q"])], "x array<string>, y array<string>")
    said = spark.createDataFrame([(["a"], ["x"], 0.9), (["a"], ["n"], 0.1), (["b"], ["n"], 0.5), (["b"], ["y"], 0.5), (["d"], [None], 0.2)], "x array<string>, y array<string>, score double")
    m = evaluate.evaluate(said, truth).first()
    assert m.precision == pytest.approx(1 / 3) and m.recall == 0.25 and m.top5_acc == m.topall_acc == 0.5 and m.answered_rate == 0.75
    assert m.f1_score == pytest.approx(2 * (1 / 3) * 0.25 / (1 / 3 + 0.25))
    runs = spark.createDataFrame([("e", 1.0), ("e", None)], "exercise string, precision double")
    r = evaluate.over_repeats(runs, ["exercise"], ("precision",)).first()
    assert (r.precision_mean, r.precision_std) == (0.5, 0.5)
    assert evaluate.over_exercises(runs, ("precision",)).first().precision == 1.0


def test_upload_flow_and_exercises(spark, toy):
    tables, _, _, good = toy
    cells = frames(spark, toy)[0]
    rows = [(k, good[k] if i < 5 else None, i) for i, k in enumerate(sorted(good))] + [(None, "v", 99), ("k0", " ", 98)]
    df = spark.createDataFrame(rows, "key string, val string, n int")
    out = {r.n: r.val for r in transform(df, ["key"], ["val"], cells, tokenised=True).collect()}
    assert len(out) == len(rows) and out[99] == "v" and sum(out[i] == good[k] for i, k in enumerate(sorted(good))) >= 27
    with pytest.raises(ValueError):
        transform(df, ["key"], ["key"], cells)
    pairs = spark.createDataFrame([([k], [v]) for k, v in good.items()], "x array<string>, y array<string>")
    m = run_exercise(cells, pairs, config=dataclasses.replace(EngineConfig(), score=ScoreConfig(use_majority_voting=True)), repeats=2).first()
    assert 0 < m.precision_mean <= 1 and m.answered_rate_mean > 0.5


def test_statistics(spark):
    cells = spark.createDataFrame([(t, 1, r, f"w{r % 2}") for t, n in ((1, 1), (2, 2), (3, 4), (4, 9)) for r in range(n)], CELLS)
    s = evaluate.table_statistics(cells).first()
    assert (s.table_count, s.min_length, s.max_length, s.avg_length, s.median_length) == (4, 1, 9, 4.0, 2)
    assert [tuple(r) for r in evaluate.term_counts(cells).collect()] == [("w0", 9), ("w1", 7)]
    assert evaluate.cell_count(cells).first().cell_count == 16


def test_scratch_is_read_back(spark):
    s = Scratch(spark, "t")
    assert s.write(spark.range(3).toDF("a"), "x").count() == 3


def test_fuzzy_discovery_and_hops(spark, toy):
    n = 12
    tables = {101: [(f"supplier {i}", f"code number {i}") for i in range(n)], 102: [(f"code number {i}", f"headquarter {i}a") for i in range(n)]}
    cells = spark.createDataFrame(cells_of(tables), CELLS)
    ex = spark.createDataFrame([([f"supplier {i}"], [f"headquarter {i}"]) for i in range(4)], "x array<string>, y array<string>")
    q = spark.createDataFrame([([f"supplier {i}"],) for i in range(n)], "x array<string>")
    assert multihop.multi_hop(cells, ex, q, 1).count() == 0
    got = multihop.multi_hop(cells, ex, q, 1, fuzzy=("ratio", 0.9))
    assert {(r.x[0], r.y[0]) for r in got.collect()} == {(f"supplier {i}", f"headquarter {i}a") for i in range(n)}
    out = discover(*frames(spark, toy), EngineConfig(score=ScoreConfig(use_fuzzy_matching=True, fuzzy_threshold=0.99)), steps=2)
    assert out.ranking.count() > 0


def test_nothing_found_and_no_examples(spark, toy):
    cells, examples, queries = frames(spark, toy)
    lost = spark.createDataFrame([(["nobody"], ["knows"]), (["this"], ["pair"])], "x array<string>, y array<string>")
    out = discover(cells, lost, queries)
    assert out.ranking.count() == 0 and out.support.count() == 0
    assert {r.x[0]: r.score for r in out.scores.collect()} == {"nobody": 1.0, "this": 1.0}
    same = discover(cells, examples, examples.select("x"))  # a query that equals an example has the example's output
    assert {(r.x[0], r.y[0], r.score) for r in same.ranking.where("rank = 1").collect()} == {(r.x[0], r.y[0], 1.0) for r in examples.collect()}
    with pytest.raises(ValueError):
        discover(cells, examples.limit(0), queries)


def test_index_in_two_layouts_finds_the_same(spark, toy, tmp_path):
    cells, examples, queries = frames(spark, toy)
    nothing = spark.range(0).toDF("tableid")
    indexing.write_corpus(corpus.Corpus(cells.withColumn("term", F.col("tokenized")), nothing, nothing), str(tmp_path))
    plain = discover(cells, examples, queries, steps=3)
    both = discover(corpus.read_corpus(spark, str(tmp_path)), examples, queries, steps=3)
    assert {tuple(map(str, r)) for r in both.ranking.collect()} == {tuple(map(str, r)) for r in plain.ranking.collect()}


def test_iterations_are_counted_and_limits_hold(spark, toy):
    counts = {}
    for edges in (0, 2_000_000):
        out = discover(*frames(spark, toy), EngineConfig(score=ScoreConfig(kernel_edges=edges)))
        counts[edges] = out.iterations
        assert discover(*frames(spark, toy), EngineConfig(score=ScoreConfig(kernel_edges=edges, max_iterations=2))).iterations == 2
    assert counts[0] == counts[2_000_000] > 2


def test_states_that_return_end_the_iteration(spark):
    # with no change allowed the scores still come to rest, or to a state that was there
    a = [0, 0, 1, 1]
    score, _, k = scoring.kernel(*map(__import__("numpy").array, (a, [0, 1, 0, 1], [0, 1, 2, 3], [0, 1, 0, 1], [True, False, False, False])), ScoreConfig(epsilon=-1.0))
    assert k < 10_000 and score[0] == 1
