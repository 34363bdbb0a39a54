import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabweave.llm import sharding


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 3), (3, 2), (3, 4), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(spark, dims, bits):
    cells = spark.range(2 ** (bits * dims)).select(*[F.shiftright("id", bits * i).bitwiseAND(F.lit(2**bits - 1)).alias(f"a{i}") for i in range(dims)])
    rows = sorted(sharding.hilbert(cells, [f"a{i}" for i in range(dims)], bits, "h").collect(), key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(2 ** (bits * dims)))
    for p, q in zip(rows, rows[1:]):
        assert sum(abs(p[i] - q[i]) for i in range(dims)) == 1


def documents(n=700):
    r = random.Random(5)
    rows = []
    for i in range(n):
        text = r.choice([None, "", "é" * r.randint(1, 40), "same text", "same text", "x" * r.randint(0, 900)])
        rows.append((i, text, r.choice(["en", "de", None, "fr"]), "src0" if r.random() < 0.4 else f"src{r.randint(1, 19)}", None if text is None else len(text), 7))
    return [*rows, (None, "n", None, None, None, None), rows[-1], rows[-1]]


def test_shards_of_documents(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int").repartition(6)
    out = sharding.hilbert_shards(df).collect()
    assert Counter((r.id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    order = [r.curve for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    # narrow runs: a shard holds few of the (language, source) pairs
    pairs = {s: len({(r.lang, r.source) for r in out if r.shard == s}) for s in range(16)}
    assert sum(pairs.values()) / 16 < 0.5 * len({(r.lang, r.source) for r in out})


def test_few_rows_and_files(spark, tmp_path):
    df = spark.createDataFrame(documents(3)[:3], "doc_id long, text string, lang string, source string, n_chars long, x int")
    out = sharding.hilbert_shards(df)
    assert sorted(r.slot for r in out.collect()) == [0, 0, 0]
    assert sharding.hilbert_shards(df.limit(0)).count() == 0
    sharding.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_long_common_prefixes_keep_a_dimension(spark):
    r = random.Random(1)
    rows = [(i, "t", r.choice(["en", "de"]), f"https://www.example.org/sources/{r.randint(0, 49):02d}", r.randint(1, 5000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = sharding.hilbert_shards(df).groupBy("shard").agg(F.min("source").alias("a"), F.max("source").alias("z"), F.min("n_chars").alias("b"), F.max("n_chars").alias("y")).collect()
    sources, sizes = sorted({x[3] for x in rows}), range(1, 5001, 100)
    # files that a predicate of equality reads, by their bounds, of 16
    assert sum(x.a <= s <= x.z for x in out for s in sources) / len(sources) < 8
    assert sum(x.b <= n <= x.y for x in out for n in sizes) / len(sizes) < 8
