import random

import numpy as np
import pytest
import tiktoken

import public_tokenizers as P
from tabweave.llm import bpe, queries


@pytest.fixture(scope="module")
def vocabulary():
    return queries.byte_vocabulary()


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.tokens, special_tokens={})


def texts():
    r = random.Random(5)
    alphabet = ["a", "th", "er", " ", "  ", "\n", "\t", "'s", "'ll", ".", "!!", "1", "23", "é", "中", "😀", " ", " ", "\x85", "\x1c", "​", " \n", "Z"]
    out = [None, "", " ", "   ", "\n\n x", "a  b   c \n d", "hello world", "a" * 5000, "the " * 500, "<|endoftext|> it's"]
    return out + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(500)]


def test_perfect_hash():
    r = random.Random(1)
    keys = [*{r.randbytes(r.randint(1, 9)) for _ in range(5000)}]
    h = bpe.PerfectHash(keys)
    assert [h.find(k) for k in keys] == list(range(len(keys)))
    assert sorted(h.slots) == list(range(len(keys)))
    others = [k for k in (r.randbytes(12) for _ in range(500)) if k not in set(keys)]
    assert all(h.find(k) == -1 for k in others)
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])


def test_ids_equal_reference_and_round_trip(spark, vocabulary, reference):
    rows = [(i, t, b"x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary").repartition(3)
    got = {r.id: (np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in bpe.encode_decode(df, vocabulary).collect()}
    for i, t, _ in rows:
        assert got[i] == (reference.encode_ordinary(t or ""), (t or "").encode()), t
    back = bpe.decode_ids(bpe.encode_decode(df, vocabulary, decode=False), vocabulary)
    assert {r.id: bytes(r.decoded) for r in back.collect()} == {i: x for i, (_, x) in got.items()}
    assert bpe.encode_decode(df.limit(0), vocabulary).count() == 0


def test_memory_is_bounded(vocabulary, reference):
    vocabulary._rest = bpe.Memory(vocabulary._rest.find, 10)
    vocabulary._pieces = bpe.Memory(vocabulary._pieces.find, 10)
    text = " ".join(f"word{i} x" for i in range(300))
    assert np.frombuffer(vocabulary.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    assert len(vocabulary._rest) <= 10 and len(vocabulary._pieces) <= 10
