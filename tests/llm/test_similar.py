import random

import numpy as np
from pyspark.sql import functions as F

from tabweave.llm import simhash, similar
from tabweave.llm.common import Scratch


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_edited_copies_are_one_group(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices(["an", "er", "th", "ou", "in", "re", "st"], k=r.randint(1, 5)))
    line = " ".join(word() for _ in range(12))  # a line that most documents have
    base = [" ".join([*(word() for _ in range(r.randint(60, 200))), line]) for _ in range(60)]
    texts = list(base)
    for t in base[:30]:
        w = t.split()
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join([*base[0].split()[:-k], *(word() for _ in range(k))]) for k in range(1, 9)] + ["", " ", "two words", "Two words"]
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in near:
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    kept = {x.doc_id for x in simhash.keep_one(df).collect()}
    assert kept == set(label) and len(kept) < len(texts) - 20
    # without the help of fingerprints, with few and with all shingles crowded
    made = Scratch(spark, "test").write(simhash.shingled(df, "doc_id", "text", 5).where("shingles is not null").dropDuplicates(["k1", "k2"]).withColumn("sid", F.col("id")), "sets")
    held = {r.id for r in made.collect()}
    none = spark.createDataFrame([], "u long, v long")
    for hot in (10**6, 5, 1):
        got = {x.node: x.label for x in similar.classes(made, none, Scratch(spark, "test"), hot=hot).collect()}
        for i in held:
            for j in held:
                assert (got.get(i, i) == got.get(j, j)) == (label[i] == label[j]), (hot, i, j)


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(r.integers(-(2**31), 2**31 - 1, r.integers(0, 400), dtype=np.int64)).astype(np.int32) for _ in range(2))
        b = np.unique(np.concatenate((b, r.choice(a, len(a) // 2, replace=False) if len(a) else a)))
        maps = similar.bitmaps(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        maps = [np.frombuffer(m, np.uint64) for m in maps]
        assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= len(np.setxor1d(a, b))


def test_columns_of_any_name_and_equal_rows(spark):
    names = ["id", "d1", "k1", "fp", "rows", "__fp", "n", "at", "c0", "label"]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(k, *map(str, range(10)), t) for k, t in ((2, text), (1, text), (1, text), (None, text), (5, None), (4, ""), (4, ""), (7, "x " * 100_000))]
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"`{n}` string" for n in names) + ", text string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(r.doc_id for r in got) == [1, 4, 7] and all(r[n] == str(k) for r in got for k, n in enumerate(names))
    assert simhash.keep_one(df.limit(0)).count() == 0
