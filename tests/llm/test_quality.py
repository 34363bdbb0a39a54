import random
from collections import Counter
from itertools import combinations

import numpy as np

from tabweave.llm import quality
from tabweave.llm.common import Scratch


def plain(text):
    text = text or ""
    split = lambda t: [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    words = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {k for i, w in enumerate(windows) if n[w] > 1 for k in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), sum(a == b for a, b in zip(words, words[1:])))


def texts():
    r = random.Random(8)
    out = [None, "", " ", "\n\n", "a", "a\na\n a\na", "é " * 40, "x", "\n" * 5 + "b c\x0b\nb c\x0b\nd"]
    for _ in range(200):
        words = [r.choice(["ab", "c#", "é", "dd$", "e|f", "中文", "g"]) for _ in range(r.randint(0, 80))]
        out.append("".join(w + r.choice([" ", "\n", "  ", "\t", " \n"]) for w in words))
    return out + ["one two three four five six seven eight nine " * 4]


def test_base_statistics(spark):
    rows = [(i, t, "l", "s", 5) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int").repartition(3)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_same_words) for r in quality.base_statistics(df).collect()}
    assert got == {i: plain(t) for i, t, *_ in rows}


def test_estimates_equal_brute_force_over_all_subsets(spark):
    floors, share, scale = (0.01, 0.02), 0.75, quality.consistency(0.75, 2)
    rows, groups = [], {}
    for g in range(8):
        r = np.random.default_rng(g)
        v = np.vstack([r.normal([1, g], [0.5, 1], (9, 2)), r.normal(8, 0.5, (3, 2))])
        groups[f"g{g}"] = v
        rows += [(f"g{g}", *map(float, x)) for x in v]
    df = spark.createDataFrame(rows, "grp string, x0 double, x1 double")
    got = {e.grp: (np.array(e.centre), np.array(e.inverse).reshape(2, 2)) for e in quality.mcd(df, Scratch(spark, "test"), ["x0", "x1"], floors, share, least=0).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        best = None
        for some in combinations(range(12), 9):
            scatter = np.cov(v[list(some)].T, bias=True) * scale + np.diag(floors)
            if best is None or np.linalg.det(scatter) < best[0]:
                best = (np.linalg.det(scatter), v[list(some)].mean(0), np.linalg.inv(scatter))
        assert np.allclose(got[g][0], best[1]) and np.allclose(got[g][1], best[2]), g


def test_estimates_resist_outliers(spark):
    r = np.random.default_rng(9)
    good, bad = r.normal([1, 2, 0, 3, 1], [0.5, 1, 0.4, 0.8, 1], (3000, 5)), r.normal(30, 0.1, (600, 5))
    rows = [("g", *map(float, v)) for v in np.vstack([good, bad])] + [("tiny", 1.0, 2.0, 0.0, 3.0, 1.0)] * 3
    x = ["x0", "x1", "x2", "x3", "x4"]
    got = {e.grp: np.array(e.centre) for e in quality.mcd(spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double, x3 double, x4 double"), Scratch(spark, "test"), x).collect()}
    assert set(got) == {"g", "tiny"}
    assert np.abs(got["g"] - [1, 2, 0, 3, 1]).max() < 0.2 and np.abs(got["tiny"] - [1, 2, 0, 3, 1]).max() < 0.2


def test_chi_square_law():
    assert abs(quality.CUTOFF - 35.888) < 1e-3 and abs(quality.consistency(0.75, 5) - 1.4118) < 1e-3
    assert abs(quality.chi_square(3.841459, 1) - 0.95) < 1e-6 and abs(quality.chi_square_limit(0.5, 2) - 2 * np.log(2)) < 1e-9


def test_stage_passes_columns_of_any_name(spark):
    base = " ".join(f"word{i}" for i in range(60))
    names = ["n_words", "kept", "grp", "d1", "c0", "__x0", "distance", "centre"]
    rows = [(k, *map(str, range(8)), base + chr(97 + k % 26), "en", None) for k in range(40)] + [(50, *map(str, range(8)), None, "en", "s"), (51, *map(str, range(8)), "ab cd " * 40_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"`{n}` string" for n in names) + ", text string, lang string, source string")
    out = quality.reject_outliers(df)
    assert out.columns == df.columns
    got = out.collect()
    assert {r.doc_id for r in got} == set(range(40)) and all(r[n] == str(k) for r in got for k, n in enumerate(names))


def test_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, base.replace("5", chr(97 + i % 26)), "en", "a") for i in range(80)]
    rows += [(100, None, None, None), (101, " ".join(w + "&&&" for w in base.split()), "en", "a"), (102, base, None, "a"), (103, base, "en", None), (None, base, "en", "a"), (3, rows[3][1], "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.judged(df).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[100] and not kept[101] and kept[102] and kept[103] and kept[None] and all(kept[i] for i in range(80))
    assert quality.judged(df.limit(0)).count() == 0
