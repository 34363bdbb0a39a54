import numpy as np
from pyspark.sql import functions as F

from tabweave.llm import media
from tabweave.llm.common import Scratch

SCHEMA = "id long, width int, height int, pixels binary, x string"


def scene(seed, side=120):
    r = np.random.default_rng(seed)
    a = np.full((side, side), 128.0)
    for _ in range(60):
        y, x = r.integers(0, side - 8, 2)
        h, w = r.integers(6, 26, 2)
        a[y : y + h, x : x + w] = r.integers(0, 256)
    return media._box(a, 1).clip(0, 255)


def row(k, a):
    return (k, a.shape[1], a.shape[0], np.clip(np.rint(a), 0, 255).astype(np.uint8).tobytes(), "x")


def test_copies_are_found_and_others_are_not(spark):
    rows, want = [], {}
    for k in range(8):
        a = scene(k)
        r = np.random.default_rng(100 + k)
        edits = [a, a[10:115, 5:115], a * 0.8 + 20, a + r.normal(0, 2, a.shape), np.rot90(a), a]
        for j, e in enumerate(edits):
            rows.append(row(10 * k + j, e))
            want[10 * k + j] = 10 * k
    for k in range(30):
        rows.append(row(1000 + k, scene(1000 + k)))
        want[1000 + k] = 1000 + k
    out = {r.id: r for r in media.image_classes(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert len(out) == len(rows)
    edited = [k for k in want if k < 1000]
    assert all(out[k].class_id == k and out[k].links == 0 for k in want if k >= 1000)
    assert sum(out[k].class_id == want[k] for k in edited) >= 0.95 * len(edited)
    assert all(out[k].class_id // 10 == k // 10 for k in edited)


def plain_classes(images):
    """Classes by comparing all pairs; images: {id: pixels}."""
    found = {k: media.described(np.clip(np.rint(a), 0, 255).astype(np.uint8)[None]) for k, a in images.items()}
    entries = {k: set(p.entries().ravel().tolist()) for k, p in found.items()}
    label = {k: k for k in images}
    for i in images:
        for j in images:
            if i < j and len(entries[i] & entries[j]) >= media.MEET and media.agreement(found[i], found[j]) >= media.AGREE:
                a, z = sorted((label[i], label[j]))
                label = {k: a if v == z else v for k, v in label.items()}
    return label


def same(got, want):
    return {(a, b) for a in got for b in got if got[a] == got[b]} == {(a, b) for a in want for b in want if want[a] == want[b]}


def test_large_group_is_whole(spark):
    a = scene(5, 90)
    r = np.random.default_rng(1)
    images = {k: a + r.normal(0, 1.0, a.shape) for k in range(60)} | {100 + k: scene(200 + k, 90) for k in range(10)}
    out = {r.id: r.class_id for r in media.image_classes(spark.createDataFrame([row(k, a) for k, a in images.items()], SCHEMA)).collect()}
    assert {out[k] for k in range(60)} == {0} and all(out[100 + k] == 100 + k for k in range(10))


def test_odd_rows(spark):
    a = scene(3)
    rows = [(1, 0, 0, b"", ""), (2, 5, 5, b"x" * 25, ""), (3, 50, 50, b"short", ""), (4, None, None, None, ""), (5, 64, 64, bytes(4096), ""), (6, 64, 64, bytes(4096), ""), row(None, a), row(8, a)]
    out = {r.id: (r.class_id, r.links) for r in media.image_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (5, 0), None: (8, 0), 8: (8, 0)}
    assert media.image_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pictures_of_vectors(spark):
    v = np.random.default_rng(1).normal(size=64)
    df = spark.createDataFrame([(1, v.tolist()), (2, (v * 3).tolist()), (3, None), (4, [])], "vec_id long, embedding array<double>")
    got = {r.id: r for r in media.pictures(df).collect()}
    assert got[1].pixels == got[2].pixels and len(got[1].pixels) == got[1].width * got[1].height and got[3].pixels is None and got[4].pixels is None


def turned(a, degrees):
    t = np.deg2rad(degrees)
    h, w = a.shape
    y, x = np.mgrid[:h, :w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy = np.clip(np.cos(t) * (y - cy) - np.sin(t) * (x - cx) + cy, 0, h - 1.001)
    sx = np.clip(np.sin(t) * (y - cy) + np.cos(t) * (x - cx) + cx, 0, w - 1.001)
    i, j = sy.astype(int), sx.astype(int)
    u, v = sy - i, sx - j
    return a[i, j] * (1 - u) * (1 - v) + a[i + 1, j] * u * (1 - v) + a[i, j + 1] * (1 - u) * v + a[i + 1, j + 1] * u * v


EDITS = {
    "turn 5": lambda a: turned(a, 5), "turn 30": lambda a: turned(a, 30), "quarter turn": np.rot90, "scale 0.9": lambda a: media._resized(a, 0.9),
    "scale 0.75": lambda a: media._resized(a, 0.75), "scale 0.6": lambda a: media._resized(a, 0.6), "blur": lambda a: media._box(a, 2),
    "crop to 60% of each side": lambda a: a[32:128, 32:128], "crop to a quarter": lambda a: a[40:120, 40:120], "noise": lambda a: a + np.random.default_rng(3).normal(0, 4, a.shape), "contrast": lambda a: a * 0.8 + 20,
}


def test_recall_by_edit(spark):
    many = 20
    images = {100 * k: scene(500 + k, 160) for k in range(many)}
    for n, edit in enumerate(EDITS.values(), 1):
        images |= {100 * k + n: edit(images[100 * k]) for k in range(many)}
    out = {r.id: r.class_id for r in media.image_classes(spark.createDataFrame([row(k, a) for k, a in images.items()], SCHEMA).repartition(8)).collect()}
    for n, name in enumerate(EDITS, 1):
        assert sum(out[100 * k + n] == out[100 * k] for k in range(many)) >= 0.9 * many, name
    assert sum(out[k] // 100 == k // 100 for k in out) >= 0.97 * len(out)


def test_blocks_find_what_all_pairs_find(spark):
    r = np.random.default_rng(9)
    icons = [scene(700 + k, 40)[:26, :26] for k in range(12)]
    images = {}
    for n in range(40):
        a = np.full((160, 160), 128.0)
        for place, k in enumerate(r.permutation(12)):
            y, x = 8 + 38 * (place // 4) + r.integers(0, 10), 4 + 38 * (place % 4) + r.integers(0, 10)
            a[y : y + 26, x : x + 26] = icons[k]
        images[n] = a
    images |= {1000 + k: images[k][2:150, 2:158] for k in range(15)}
    want = plain_classes(images)
    df = spark.createDataFrame([row(k, a) for k, a in images.items()], SCHEMA).withColumns({"p1": F.col("id"), "p2": F.col("id")})
    points = Scratch(spark, "test").write(media.descriptors(df).withColumn("pid", F.col("p1")), "points")
    for crowd, block in ((12, 1_024), (2, 7), (10**6, 10)):
        labels, _ = media.copies(points, Scratch(spark, "test"), crowd=crowd, block=block)
        got = {k: k for k in images} | {x.node: x.label for x in labels.collect()}
        assert same(got, want), (crowd, block)
    assert sum(want[1000 + k] == want[k] for k in range(15)) >= 14
