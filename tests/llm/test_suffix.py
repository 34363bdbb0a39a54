import random
from collections import defaultdict

from pyspark.sql import functions as F

from tabweave.llm import suffix

SCHEMA = "doc_id long, text string, dig string, pos int, lang string"


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    common, other = prose(70), prose(55)
    docs = [prose(r.randint(0, 200)) for _ in range(25)]
    for d in (2, 5, 9, 11, 30):
        docs.append(prose(r.randint(0, 40)) + common[r.randint(0, 10) :] + prose(r.randint(0, 40)))
    docs.append(common + other + common)
    docs.append(other[:49])
    docs.append(["same"] * 130)
    docs.append(docs[3] + other)
    texts = [r.choice([" ", "\n", "  "]).join(d) for d in docs]
    texts += [texts[7], texts[25], None, "", " \n ", texts[25]]
    return [(i, t, "x", i, None) for i, t in enumerate(texts)]


def brute(rows, spark, passage):
    """Positions covered by windows that occur elsewhere, and whether they are the first by (least id of the text, position)."""
    least = {}
    for r in rows:
        least[r[1]] = min(least.get(r[1], r[0]), r[0])
    where = defaultdict(set)
    for r in rows:
        words = (r[1] or "").split()
        for s in range(len(words) - passage + 1):
            where[tuple(words[s : s + passage])].add((least[r[1]], s))
    out = set()
    for r in rows:
        words = (r[1] or "").split()
        if least[r[1]] != r[0]:
            if len(words) >= passage:
                out |= {(r[0], False, k) for k in range(len(words))}
            continue
        for s in range(len(words) - passage + 1):
            all_of = where[tuple(words[s : s + passage])]
            if len(all_of) > 1:
                first = min(all_of) == (least[r[1]], s)
                out |= {(r[0], first, k) for k in range(s, s + passage)}
    return out


def test_spans_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.id, r.kept, k) for r in suffix.repeated_spans(df, passage=50).collect() for k in range(r.begin, r.end)}
    assert got == brute(rows, spark, 50)
    assert got


def test_colliding_hashes_and_parts_change_nothing(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, spark, 50)
    for bits, part in ((4, 10**6), (64, 3), (4, 3)):
        got = {(r.id, r.kept, k) for r in suffix.repeated_spans(df, bits=bits, part=part).collect() for k in range(r.begin, r.end)}
        assert got == want, (bits, part)


def test_cut_passes_columns_of_any_name(spark):
    names = ["rows", "__cuts", "__dig", "d1", "id", "least", "cuts", "copy", "c0", "begin"]
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(k, *map(str, range(10)), t) for k, t in ((1, "a " + text), (2, text + " b"), (3, text + " b"), (4, None))], "doc_id long, " + ", ".join(f"`{n}` string" for n in names) + ", text string")
    out = suffix.cut_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "a " + text and got[2].text == " b" and got[3].text == "" and got[4].text is None
    assert all(got[2][n] == str(k) for k, n in enumerate(names))


def test_cut_keeps_columns_and_first_occurrences(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = suffix.cut_repeats(df)
    assert out.columns == df.columns
    cut = defaultdict(set)
    for i, first, k in brute(rows, spark, 50):
        if not first:
            cut[i].add(k)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert len(texts) == len(rows)
    for r in rows:
        words = (r[1] or "").split()
        assert (texts[r[0]] or "").split() == [w for k, w in enumerate(words) if k not in cut[r[0]]]
        if not cut[r[0]]:
            assert texts[r[0]] == r[1]


def test_empty_table_and_null_ids(spark):
    assert suffix.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    assert suffix.cut_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text, None, None, None), (None, None, None, None, None), (4, "z " + text, None, None, None), (4, "z " + text, None, None, None)], SCHEMA)
    got = suffix.repeated_spans(df).select("id", "begin", "end", "kept").collect()
    assert sorted(map(tuple, got), key=str) == [(4, 1, 61, False), (None, 0, 60, True)]


def test_long_text(spark):
    text = " ".join(f"w{i % 3000}" for i in range(200000))
    got = suffix.repeated_spans(spark.createDataFrame([(1, text, "", 0, "")], SCHEMA)).select("begin", "end", "kept").collect()
    assert {tuple(r) for r in got} == {(0, 3049, True), (3000, 200000, False)}


def test_word_count_matches_split(spark):
    texts = ["a b", "", None, " x\ty\x0bz\x0c ", "é b c", "\n"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(suffix.word_count(F.col("text")).alias("n")).collect()
    assert [r.n for r in got] == [len((t or "").encode().split()) for t in texts]
    assert spark.range(1).select(F.lit(1)).count() == 1
