import random
import re

import numpy as np
import pytest
import xxhash

from tabweave.llm import simhash
from tabweave.llm.common import Scratch
from tabweave.llm.components import connected_components


def plain_fingerprint(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    """fps: {node: fingerprint}; the least node reachable over links of at most 3 bits."""
    label = {}
    for k in sorted(fps):
        if k in label:
            continue
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = k
                todo += [y for y in fps if y not in label and bin(fps[x] ^ fps[y]).count("1") <= 3]
    return label


def test_fingerprints(spark):
    r = random.Random(3)
    texts = [None, "", " \n", "One", "one TWO", "a b c", "É é A\x0bb c d", "x " * 3000]
    texts += [" ".join(r.choice(["ab", "Cd", "ef", "ü", "x y"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "fp", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, id int")
    got = {r.id: r.fp for r in simhash.fingerprints(df).collect()}
    assert got == {i: int(np.uint64(plain_fingerprint(t)).view(np.int64)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("segment,hot", [(2, 64), (2, 1), (4, 64), (8, 2)])
def test_links_keep_components(spark, segment, hot):
    r = random.Random(segment * 100 + hot)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:25]:
        x = b
        for _ in range(r.randint(1, 8)):
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    fps |= {0, 2**64 - 1, 7, 1 << 63}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    scratch = Scratch(spark, "test")
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), scratch, segment=segment, hot=hot, block=16)
    rows = [(r.u, r.v) for r in found.collect()]
    assert all(bin((u ^ v) & (2**64 - 1)).count("1") <= 3 and u < v for u, v in rows)
    want = components({f: f & (2**64 - 1) for f in signed})
    got = {r.node: r.label for r in connected_components(found, scratch).collect()}
    assert {f: got.get(f, f) for f in signed} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{k: 1000 for k in range(1000, 1200)}, 6000: 6000, 6001: 6000}


def test_groups_with_odd_rows(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (9, " ".join(words)), (9, " ".join(words)), (None, " ".join(words)), (4, None), (3, ""), (7, "other text entirely here")]
    out = simhash.simhash_groups(spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component string")).collect()
    want = components({k: plain_fingerprint(t) for k, (_, t) in enumerate(rows)})
    least = {lab: min(rows[k][0] for k, v in want.items() if v == lab and rows[k][0] is not None) for lab in want.values()}
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.id, r.component) for r in out), key=key) == sorted(((rows[k][0], least[want[k]]) for k in want), key=key)
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
