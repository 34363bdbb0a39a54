import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabweave.llm import packing, queries


def test_plan_holds_every_piece_with_little_waste():
    r = random.Random(2)
    for n in (0, 1, 7, 300, 5000):
        histogram = Counter(min(256, int(r.lognormvariate(4, 1)) + 1) for _ in range(n))
        patterns = packing.plan(dict(histogram), 256)
        held = Counter()
        for p, times in patterns:
            assert sum(c * m for c, m in p.items()) <= 256 and times > 0
            held.update({c: m * times for c, m in p.items()})
        assert held == histogram
        least = sum(c * m for c, m in histogram.items()) / 256
        assert sum(t for _, t in patterns) <= 1.02 * least + 3
        table = packing.slots(patterns)
        for c, m in histogram.items():
            ranges = sorted((lo, hi) for k, lo, hi, *_ in table if k == c)
            assert [a for a, _ in ranges] + [m] == [0] + [b for _, b in ranges]


def test_pricing_equals_brute_force():
    r = np.random.default_rng(3)
    for _ in range(20):
        sizes = np.unique(r.integers(1, 12, 3))
        duals = r.random(len(sizes))
        best = 0.0
        for a in range(31):
            for b in range(31):
                for c in range(31):
                    m = np.array([a, b, c])[: len(sizes)]
                    if m @ sizes <= 30:
                        best = max(best, float(m @ duals))
        value, pattern = packing.price(duals, sizes, 30)
        assert value == pytest.approx(best) and pattern @ duals == pytest.approx(best) and pattern @ sizes <= 30


def test_pieces_and_places(spark):
    r = random.Random(4)
    words = ["The", "it's", "l’été", "naïve", "x1y22", "<|endoftext|>", "#", " b", "ＡＢ", "é"]
    texts = [None, "", " \n", "a" * 9000, " ".join(r.choice(words) for _ in range(5000))]
    texts += ["\t".join(r.choice(words) for _ in range(r.randint(1, 900))) for _ in range(80)] + ["same text"] * 40
    rows = [(i if i != 20 else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string").repartition(3)
    tokenizer = Tokenizer.from_str(queries.word_tokenizer())
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, _ in rows}
    got = packing.pack(df, queries.word_tokenizer()).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(want[p.id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(want[p.id])
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda p: p.start)
        assert [p.start for p in pieces] + [len(want[i])] == [0] + [p.start + p.length for p in pieces]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        ends = [p.offset + p.length for p in pieces]
        assert [p.offset for p in pieces] == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(map(len, want.values()))
    assert len(by_sequence) <= 1.02 * total / 2048 + 2
    assert packing.pack(df.limit(0), queries.word_tokenizer()).count() == 0


def test_buckets_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(packing, "bucket_count", lambda n: n // 7 + 1)
    df = spark.createDataFrame([(i, "one two three " * (i % 3 + 1)) for i in range(150)], "doc_id long, text string")
    got = packing.pack(df, queries.word_tokenizer()).collect()
    assert len(got) == 150 and len({(p.sequence_id, p.offset) for p in got}) == 150


def test_byte_merges_equal_the_definition():
    r = random.Random(7)
    merges, tokenizer = packing.WordBpe(queries.word_tokenizer()), Tokenizer.from_str(queries.word_tokenizer())
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéßñŒ'ıİ.,!$%09²¼ªº-_<|>`~\""
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(20000)] + ["a" * 3000, "it's", "İi", "<|startoftext|>", "x́", "\u0085", "中"]
    plain = 0
    for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
        got = merges.encode(w)
        if got is not None:
            plain += 1
            assert np.frombuffer(got, "<u4").tolist() == e.ids, w
    assert plain > 10000 and merges.encode("x́") is None and merges.encode("<|startoftext|>") is None
