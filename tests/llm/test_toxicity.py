import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from tabweave.llm import toxicity
from tabweave.llm.common import text_bytes


def corpus(n=900, seed=3):
    r = random.Random(seed)
    syllables = ["an", "er", "th", "ou", "in", "re", "st", "ly"]
    bad = ["idiot", "scum", "moron"]
    out = []
    for i in range(n):
        words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(5, 120))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randint(0, len(words)), r.choice(bad).upper() if r.random() < 0.2 else r.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_features_equal_plain_grams():
    texts = ["Ab c", "", None, "xyzé\tQ", "ab c", "aaaaaaaaaa"]
    row, bucket = toxicity.features(*text_bytes(pa.array(texts)))
    per = {k: set(bucket[row == k].tolist()) for k in range(len(texts))}

    def plain(t):
        raw = bytes(32 if chr(c).isspace() and c < 128 else c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        return {raw[i : i + n] for n in toxicity.ORDERS for i in range(len(raw) - n + 1)}

    assert [len(per[k]) for k in range(len(texts))] == [len(plain(t)) for t in texts]
    assert per[0] == per[4]


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "score") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(5, None, 1), (10**6, 1, 1)], "doc_id long, toxic int, text int")
    model = toxicity.fit_on_labels(docs, labels)
    out = {r.doc_id: r for r in toxicity.scored(docs, model, keep=("doc_id",)).withColumn("held", toxicity.held_out("doc_id")).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in out.items() if r.held} == set(held)
    right = sum((out[i].score >= toxicity.THRESHOLD) == bool(rows[i][2]) for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())
    # labels of held-out rows change nothing
    flipped = labels.replace({0: 1, 1: 0}, subset=["toxic"]).where(toxicity.held_out("doc_id")).unionByName(labels.where(~toxicity.held_out("doc_id")))
    again = toxicity.fit_on_labels(docs, flipped)
    assert np.allclose(again.weights, model.weights, atol=1e-5)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 2), (1, "", 2), (None, "x" * 200000, None)], "doc_id long, text string, k int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_on_labels(df, none)
    got = toxicity.scored(df, model)
    assert got.columns == ["doc_id", "text", "k", "score"] and {r.score for r in got.collect()} == {0.5}
    ones = toxicity.fit_on_labels(df, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert all(r.score > 0.5 for r in toxicity.scored(df, ones).collect())
    assert toxicity.scored(df.limit(0), model).count() == 0


def test_logistic_reaches_the_minimum():
    r = np.random.default_rng(1)
    x = (r.random((200, 5)) < 0.4) * r.normal(size=(200, 5))
    y = (r.random(200) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1, 3] - 0.5)))).astype(float)
    row, column = np.nonzero(x)
    w, b = toxicity.logistic(row, column, x[row, column], y, 5, 0.0, ridge=1.0, steps=3000)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-3 and abs((p - y).sum()) < 1e-3


def test_the_fit_takes_texts_in_small_pieces(spark, monkeypatch):
    rows = [(i, f"{t} {i % 7} " * 3, y) for i, t, y in corpus(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    whole = toxicity.blocks

    def pieces(batches, column, *limit):
        def small():
            for batch in batches:
                assert batch.num_rows <= 500
                yield batch

        for part in whole(small(), column, *limit):
            assert part.num_rows == 1 or len(text_bytes(part.column(0))[0]) <= 1 << 18
            yield part

    texts, labels = pa.array([t for _, t, _ in rows]), np.array([y for *_, y in rows])
    cut = [text_bytes(part.column(0)) for part in toxicity.blocks([pa.record_batch([texts], ["text"])], "text", 1 << 18)]
    several, one = toxicity.fit_blocks(cut, labels), toxicity.fit_blocks([text_bytes(texts)], labels)
    assert len(cut) > 3 and (one.weights != 0).any() and np.allclose(several.weights, one.weights, atol=1e-5) and abs(several.intercept - one.intercept) < 1e-5
    monkeypatch.setattr(toxicity, "blocks", pieces)
    model = toxicity.fit(df)
    assert ((model.score(*text_bytes(texts)) >= toxicity.THRESHOLD) == labels).mean() > 0.95


def test_the_regression_makes_no_array_of_all_features():
    r = np.random.default_rng(2)
    n = 2_000_000
    row, column, value = np.sort(r.integers(0, 3000, n)).astype(np.int32), r.integers(0, 500, n).astype(np.int32), r.random(n, np.float32)
    tracemalloc.start()
    toxicity.logistic(row, column, value, r.integers(0, 2, 3000).astype(float), 500, 0.0, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n
