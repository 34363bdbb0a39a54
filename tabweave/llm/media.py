"""Media columns: copies of images, cropped or edited, by local descriptors.

Corners (least eigenvalue of the structure tensor, local maxima) are found at several scales; each gets an orientation
from its neighbourhood's intensity centroid and a descriptor of `BANDS * BITS` binary intensity tests in the turned
neighbourhood. Hamming tables: of a corner's bands of bits, the `KEPT` ones whose least certain test is most certain are
table entries, so near descriptors are likely to have an entry in common. Two images with at least `MEET` common entries are
compared: descriptors within `NEAR` bits match, matches vote for a similarity transform (turn, scale, shift), the
transform is fitted to its votes by least squares, and the pair is a copy if corners at `AGREE` different places of both
images lie within `OFF` pixels of where it puts them.

Images with equal pixels are one image (128 bits). First every image of an entry is paired with one of them, which connects
groups of copies. Of entries up to `CROWD` images the pairs follow that are not of one class by then. Larger entries (a
common texture) whose images are of one class are done; of the others, the images outside the entry's largest class are compared
with all of other classes, block against block, in tasks that return spanning forests. So every pair that meets in
`MEET` entries is compared unless it is of one class already. That last step is quadratic in images that share an entry
and are no copies.

Edge cases: null or impossible pixels (wrong number of bytes, sides below `LEAST_SIDE`) and images without corners are
classes of their own; very large images are described one at a time; ties between corners or bands go to the first;
null ids are rows with a class of null unless a copy has an id; repeated rows share a class; empty tables give empty tables;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks
from .components import connected_components
from .kernel import mix

SCALES = (1.0, 0.8, 0.64, 0.51)
#: Pixels (away from the margin) for each corner of an image and scale, least number of corners, margin of descriptors, least side.
AREA, CORNERS, MARGIN, LEAST_SIDE = 250, 24, 10, 24
BANDS, BITS, KEPT = 4, 60, 2
#: Common entries of images that are compared, bits in which matches differ at most, places that must agree, pixels that they are off at most.
MEET, NEAR, AGREE, OFF = 3, 12, 12, 3.0
#: Images up to which all pairs of an entry are made, images of a block.
CROWD, BLOCK = 64, 1_024
#: Bins of votes: turn in steps of 1 / TURNS of a circle, shift in pixels.
TURNS, SHIFT = 12, 16.0

_RNG = np.random.Generator(np.random.PCG64(77))
#: Binary tests: pairs of offsets within the margin, drawn by a fixed rule.
_TESTS = np.clip(_RNG.normal(0, 3.2, (BANDS * BITS, 4)), -6, 6)
_SIDE = np.arange(-6, 7)
_DISC = (_SIDE[:, None] ** 2 + _SIDE[None, :] ** 2) <= 36


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r + 1 of an image or a stack of them; edges repeat."""
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(r + 1, r)] * 2, mode="edge").cumsum(-2).cumsum(-1)
    n = 2 * r + 1
    return (p[..., n:, n:] - p[..., :-n, n:] - p[..., n:, :-n] + p[..., :-n, :-n]) / (n * n)


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return a
    h, w = (max(2, round(n * scale)) for n in a.shape[-2:])
    a = _box(a, 1)
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y, x = np.clip(y, 0, a.shape[-2] - 1.001), np.clip(x, 0, a.shape[-1] - 1.001)
    i, j = y.astype(int), x.astype(int)
    u, v = (y - i)[:, None], x - j
    rows = a[..., i, :] * (1 - u) + a[..., i + 1, :] * u
    return rows[..., j] * (1 - v) + rows[..., j + 1] * v


def corners(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, row, column) of the strongest corners of a stack of images, at least MARGIN from the edges."""
    gy, gx = np.gradient(_box(a, 1), axis=(1, 2))
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    strength = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
    around = strength
    for axis in (1, 2):
        padded = np.pad(around, [(2, 2) if k == axis else (0, 0) for k in range(3)], constant_values=-np.inf)
        around = np.max([np.take(padded, np.arange(k, k + strength.shape[axis]), axis=axis) for k in range(5)], axis=0)
    is_corner = (strength >= around) & (strength > np.maximum(1.0, 0.02 * strength.max((1, 2)))[:, None, None])
    is_corner[:, :MARGIN] = is_corner[:, -MARGIN:] = False
    is_corner[:, :, :MARGIN] = is_corner[:, :, -MARGIN:] = False
    flat = np.where(is_corner, strength, -np.inf).reshape(len(a), -1)
    most = min(max(CORNERS, (a.shape[1] - 2 * MARGIN) * (a.shape[2] - 2 * MARGIN) // AREA), flat.shape[1])
    at = np.argsort(-flat, axis=1, kind="stable")[:, :most] if flat.shape[1] < 4096 else np.argpartition(-flat, most - 1, axis=1)[:, :most]
    image, k = np.nonzero(np.isfinite(np.take_along_axis(flat, at, 1)))
    at = at[image, k]
    return image, at // a.shape[2], at % a.shape[2]


class Points:
    """Corners with their descriptors, in arrays: image, x, y (in pixels of the whole image), angle, scale, bands, kept bands."""

    FIELDS = ("image", "at", "angle", "scale", "bands", "kept")

    def __init__(self, *parts: np.ndarray):
        self.image, self.at, self.angle, self.scale, self.bands, self.kept = parts

    def of(self, rows) -> Points:
        return Points(*(getattr(self, f)[rows] for f in self.FIELDS))

    def entries(self) -> np.ndarray:
        """The table entries of each corner (KEPT columns): band and value in one number."""
        bands = np.take_along_axis(self.bands, self.kept.astype(np.int64), 1)
        return mix(bands.view(np.uint64) ^ mix(self.kept.astype(np.uint64) + np.uint64(1))).view(np.int64)


def described(stack: np.ndarray) -> Points:
    """Corners of a stack of grey images of one size."""
    out = []
    for scale in SCALES:
        a = _resized(stack.astype(np.float64), scale)
        if min(a.shape[1:]) <= 2 * MARGIN:
            continue
        image, y, x = corners(a)
        if not len(y):
            continue
        soft = _box(a, 2)
        patch = soft[image[:, None, None], y[:, None, None] + _SIDE[None, :, None], x[:, None, None] + _SIDE[None, None, :]] * _DISC
        angle = np.arctan2((patch * _SIDE[None, :, None]).sum((1, 2)), (patch * _SIDE[None, None, :]).sum((1, 2)))
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
        seen = lambda dx, dy: soft[image[:, None], np.rint(y[:, None] + s * dx + c * dy).astype(int), np.rint(x[:, None] + c * dx - s * dy).astype(int)]  # noqa: B023, E731
        apart = seen(_TESTS[:, 0], _TESTS[:, 1]) - seen(_TESTS[:, 2], _TESTS[:, 3])
        sure = np.abs(apart).reshape(len(y), BANDS, BITS).min(2)
        bands = (apart < 0).reshape(len(y), BANDS, BITS) @ (1 << np.arange(BITS))
        out.append((image, (x + 1j * y) / scale, angle, np.full(len(y), scale), bands, np.argsort(-sure, axis=1, kind="stable")[:, :KEPT].astype(np.int8)))
    if not out:
        return Points(np.empty(0, int), np.empty(0, complex), np.empty(0), np.empty(0), np.empty((0, BANDS), np.int64), np.empty((0, KEPT), np.int8))
    points = Points(*(np.concatenate(c) for c in zip(*out, strict=True)))
    return points.of(np.argsort(points.image, kind="stable"))


def agreement(p: Points, q: Points) -> int:
    """Places of two images that agree on one similarity transform; the first image is moved."""
    apart = np.zeros((len(p.at), len(q.at)), np.uint16)
    for b in range(BANDS):
        apart += np.bitwise_count(p.bands[:, b][:, None] ^ q.bands[:, b][None, :])
    i, j = np.nonzero(apart <= NEAR)
    if len(i) < AGREE:
        return 0
    turn, grow = np.mod(q.angle[j] - p.angle[i], 2 * np.pi), p.scale[i] / q.scale[j]
    a, b = p.at[i], q.at[j]
    a = a - a.mean()
    shift = (b - grow * np.exp(1j * turn) * a) / SHIFT
    kind = (np.floor(turn * TURNS / (2 * np.pi) + 0.5) % TURNS) * 64 + np.rint(2 * np.log2(grow)) + 32
    places = lambda z: len(np.unique(np.rint(z / OFF)))
    best = 0
    for u in (0, 0.5):
        for v in (0, 0.5):
            bins = (kind * (1 << 20) + np.floor(shift.real + u)) * (1 << 20) + np.floor(shift.imag + v)
            _, of, n = np.unique(bins, return_inverse=True, return_counts=True)
            for k in np.argsort(-n, kind="stable")[:2]:
                near = of == k
                for _ in range(3):
                    if near.sum() < 3:
                        break
                    from_, to = a[near].mean(), b[near].mean()
                    turned = ((a[near] - from_).conj() * (b[near] - to)).sum() / max(1e-9, (np.abs(a[near] - from_) ** 2).sum())
                    near = (np.abs(b - turned * (a - from_) - to) < OFF) & (np.abs(np.angle(np.exp(1j * turn) * np.conj(turned))) < 0.6) & (np.abs(np.log2(max(abs(turned), 1e-6) / grow)) < 0.5)
                if near.sum() >= AGREE:
                    best = max(best, min(places(a[near]), places(b[near])))
    return best


_ARRAYS = {"x": pa.float32(), "y": pa.float32(), "angle": pa.float32(), "scale": pa.float32(), "bands": pa.int64(), "kept": pa.int8()}
POINTS = "x array<float>, y array<float>, angle array<float>, scale array<float>, bands array<bigint>, kept array<tinyint>"


def _packed(points: Points, images: int) -> list[pa.Array]:
    """A row for each image: a list of each of _ARRAYS."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(points.image, minlength=images))))
    columns = {"x": points.at.real, "y": points.at.imag, "angle": points.angle, "scale": points.scale, "bands": points.bands, "kept": points.kept}
    out = []
    for name, kind in _ARRAYS.items():
        own = columns[name]
        many = own.shape[1] if own.ndim == 2 else 1
        out.append(pa.ListArray.from_arrays(pa.array((ends * many).astype(np.int32)), pa.array(own.ravel(), kind)))
    return out


def _unpacked(columns: list[pa.Array]) -> tuple[Points, np.ndarray]:
    """(Points of all rows, where each row's begin)."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    offsets = columns[0].offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    x, y, angle, scale, bands, kept = flat
    return Points(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), x.astype(float) + 1j * y, angle.astype(float), scale.astype(float), bands.reshape(-1, BANDS), kept.reshape(-1, KEPT)), offsets


def descriptors(images: DataFrame) -> DataFrame:
    """(p1, p2, POINTS) of images (p1, p2, width, height, pixels: grey bytes by rows) that have corners.

    A task describes equal images once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for part in blocks(batches, "pixels", 1 << 19):
            sizes: dict[tuple[int, int], list[tuple[tuple[int, int], bytes]]] = {}
            for p1, p2, width, height, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (p1, p2) in met or raw is None or not width or not height or len(raw) != width * height or min(width, height) < LEAST_SIDE:
                    continue
                if len(met) > 1_000_000:
                    met.clear()
                met.add((p1, p2))
                sizes.setdefault((height, width), []).append(((p1, p2), raw))
            for (height, width), rows in sizes.items():
                points = described(np.frombuffer(b"".join(raw for _, raw in rows), np.uint8).reshape(-1, height, width))
                some = np.flatnonzero(np.bincount(points.image, minlength=len(rows)))
                keys = [rows[k][0] for k in some.tolist()]
                packed = [c.take(pa.array(some)) for c in _packed(points, len(rows))]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), *packed], ["p1", "p2", *_ARRAYS])

    return images.select("p1", "p2", "width", "height", "pixels").mapInArrow(run, f"p1 long, p2 long, {POINTS}")


def entries_of(points: DataFrame) -> DataFrame:
    """(pid, entry): an image's table entries, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "bands"):
            own, _ = _unpacked(part.columns[1:])
            pids = part.column(0).to_numpy()[own.image]
            rows = np.unique(np.stack([np.repeat(pids, KEPT), own.entries().ravel()], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["pid", "entry"])

    return points.select("pid", *_ARRAYS).mapInArrow(run, "pid long, entry long")


def verified(pairs: DataFrame, points: DataFrame, scratch: Scratch, agree: int) -> DataFrame:
    """(u, v): those of the (written) pairs whose places agree."""
    needed = scratch.write(pairs.select(F.col("u").alias("pid")).unionByName(pairs.select(F.col("v").alias("pid"))).distinct(), "needed")
    own = points.select("pid", *_ARRAYS).join(needed, "pid", "left_semi")
    both = pairs.join(own.toDF("u", *(f"{c}_u" for c in _ARRAYS)), "u").join(own.toDF("v", *(f"{c}_v" for c in _ARRAYS)), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "bands_u"):
            p, a = _unpacked([part.column(f"{c}_u") for c in _ARRAYS])
            q, b = _unpacked([part.column(f"{c}_v") for c in _ARRAYS])
            held = [agreement(p.of(slice(a[k], a[k + 1])), q.of(slice(b[k], b[k + 1]))) >= agree for k in range(part.num_rows)]
            yield part.select(["u", "v"]).filter(pa.array(held, pa.bool_()))

    return both.select("u", "v", *(f"{c}_u" for c in _ARRAYS), *(f"{c}_v" for c in _ARRAYS)).mapInArrow(run, "u long, v long")


def crossing_links(full: DataFrame, labels: DataFrame, points: DataFrame, scratch: Scratch, agree: int, block: int = BLOCK) -> DataFrame | None:
    """(u, v): links that connect copies of different classes within crowded entries (entry, pid); None if there is none of the kind."""
    own = full.join(labels.select(F.col("node").alias("pid"), "label"), "pid", "left").withColumn("label", F.coalesce("label", "pid"))
    counts = own.groupBy("entry", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("entry").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("c")).where(F.col("c") > F.col("m.c"))
    main = main.select("entry", F.col("m.label").alias("main"), F.ceil(F.col("m.c") / block).cast("int").alias("nm"), F.ceil((F.col("c") - F.col("m.c")) / block).cast("int").alias("nr"))
    own = scratch.write(own.join(main, "entry"), "mixed")
    if own.isEmpty():
        return None
    own = own.withColumn("rest", F.col("label") != F.col("main"))
    mine = F.pmod(F.xxhash64("pid"), F.when(F.col("rest"), F.col("nr")).otherwise(F.col("nm"))).cast("int")
    # the rest meets every block of the main class (i counts down from -1), and itself block against block
    to = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    places = F.when(F.col("rest"), F.concat(F.transform(every("nm"), lambda b: to(-1 - b, F.col("mine"))), F.transform(every("nr"), lambda b: to(F.least(b, F.col("mine")), F.greatest(b, F.col("mine"))))))
    places = places.otherwise(F.transform(every("nr"), lambda b: to(-1 - F.col("mine"), b)))
    needed = scratch.write(own.select("pid").distinct(), "needed")
    carried = points.select("pid", *_ARRAYS).join(needed, "pid", "left_semi")
    dealt = own.withColumn("mine", mine).select("entry", "pid", "label", "rest", "mine", F.explode(places).alias("p")).select("entry", "pid", "label", "rest", "mine", "p.i", "p.j").join(carried, "pid")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        one = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        pid, mine, rest = table["pid"].to_numpy(), table["mine"].to_numpy(), table["rest"].to_numpy().astype(bool)
        root = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
        own, at = _unpacked([one(table[c].combine_chunks()) for c in _ARRAYS])
        entries = own.entries()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        p, q = np.flatnonzero(rest & (mine == j)), np.flatnonzero(~rest if i < 0 else rest & (mine == i))
        among = np.zeros(len(pid), bool)
        among[q] = True
        # an image's entries, each once, in one sorted list
        listed = np.unique(np.stack([entries.ravel(), np.repeat(own.image, KEPT)], axis=1), axis=0)
        listed = listed[among[listed[:, 1]]]
        out = []
        for x in p.tolist():
            mine_ = np.unique(entries[at[x] : at[x + 1]])
            low, high = np.searchsorted(listed[:, 0], mine_, "left"), np.searchsorted(listed[:, 0], mine_, "right")
            n = high - low
            met = listed[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n), 1]
            counts = np.bincount(met, minlength=len(pid))
            for y in np.flatnonzero(counts >= MEET).tolist():
                if root[x] != root[y] and (i < 0 or y > x or i != j):
                    a, b = (x, y) if pid[x] < pid[y] else (y, x)
                    if agreement(own.of(slice(at[a], at[a + 1])), own.of(slice(at[b], at[b + 1]))) >= agree:
                        out.append((int(pid[a]), int(pid[b])))
                        root[root == root[y]] = root[x]
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return dealt.groupBy("entry", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def copies(points: DataFrame, scratch: Scratch, agree: int = AGREE, crowd: int = CROWD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((node, label), (u, v)): classes of the images (pid, POINTS) that have copies, and the links that connect them."""
    entries = scratch.write(entries_of(points), "entries")
    sizes = scratch.write(entries.groupBy("entry").agg(F.count("*").alias("c"), F.min("pid").alias("u")).where("c > 1"), "sizes")
    full = scratch.write(entries.join(sizes, "entry").select("entry", "pid", "c", "u"), "full")  # without images' own entries
    often = lambda pairs: pairs.groupBy("u", "v").agg(F.count("*").alias("c")).where(F.col("c") >= MEET).select("u", "v")
    stars = scratch.write(often(full.where("pid != u").select("u", F.col("pid").alias("v"))), "stars")
    scratch.drop("entries")
    links = scratch.write(verified(stars, points, scratch, agree), "near")
    labels = scratch.write(connected_components(links, scratch), "groups")
    # a number of partitions: small entries make many pairs, so they must not be brought together in one task
    many = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = full.where(F.col("c") <= crowd).repartition(many, "entry")
    side = lambda to: cold.select("entry", F.col("pid").alias(to))
    pairs = often(side("u").hint("merge").join(side("v"), "entry").where("u < v").select("u", "v"))
    named = lambda to, of: labels.select(F.col("node").alias(to), F.col("label").alias(of))
    apart = pairs.join(named("u", "p"), "u", "left").join(named("v", "q"), "v", "left").where(F.coalesce("p", "u") != F.coalesce("q", "v")).select("u", "v")
    links = scratch.write(links.unionByName(verified(scratch.write(apart, "pairs"), points, scratch, agree)), "linked")
    labels = scratch.write(connected_components(links, scratch), "labels")
    full = full.where(F.col("c") > crowd)
    more = crossing_links(full.select("entry", "pid"), labels, points, scratch, agree, block)
    if more is not None:
        links = scratch.write(links.unionByName(scratch.write(more, "more")).distinct(), "links")
        labels = scratch.write(connected_components(links, scratch), "classes")
    return labels, links


def image_classes(images: DataFrame, id_col: str = "id", agree: int = AGREE) -> DataFrame:
    """(id, class_id, links): images (id, width, height, pixels) with the least id of their class and their links found."""
    scratch = Scratch(images.sparkSession, "media")
    drawn = ("width", "height", "pixels")
    rows = images.select(F.col(id_col).alias("id"), *drawn, F.xxhash64(*drawn).alias("p1"), F.xxhash64(F.lit(1), *drawn).alias("p2"))
    known = scratch.write(rows.select("id", "p1", "p2"), "known")
    made = scratch.write(descriptors(rows).withColumn("pid", F.monotonically_increasing_id()), "points")  # numbers are written, so they stay
    own = scratch.write(made.groupBy("p1", "p2").agg(F.min("pid").alias("pid")), "own")
    again = scratch.write(made.select("pid", "p1", "p2").join(own, ["p1", "p2", "pid"], "left_anti").select("pid"), "again")
    labels, links = copies(made.join(again, "pid", "left_anti"), scratch, agree)  # again: copies that different tasks have met
    degree = links.select(F.col("u").alias("pid")).unionByName(links.select(F.col("v").alias("pid"))).groupBy("pid").agg(F.count("*").alias("links"))
    facts = own.join(labels, F.col("pid") == F.col("node"), "left").select("p1", "p2", "pid", F.coalesce("label", "pid").alias("label")).join(degree, "pid", "left").drop("pid")
    named = scratch.write(known.join(facts, ["p1", "p2"], "left"), "named")
    # an image without corners is of the class of its pixels
    key = [F.coalesce("label", "p1").alias("a"), F.when(F.col("label").isNull(), F.col("p2")).alias("b")]
    least = named.groupBy(*key).agg(F.min("id").alias("class_id")).alias("l")
    n = named.select("id", "links", *key).alias("n")
    out = n.join(least, (F.col("n.a") == F.col("l.a")) & F.col("n.b").eqNullSafe(F.col("l.b")))
    return out.select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def pictures(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", side: int = 72) -> DataFrame:
    """(id, width, height, pixels): a vector's numbers as amplitudes of a picture's waves, for tables without media.

    Vectors that differ little make pictures that differ little; a factor doesn't matter. A vector of n numbers has the
    least square of waves that holds them all.
    """
    t = (np.arange(side) + 0.5) / side

    def drawn(rows: np.ndarray) -> np.ndarray:
        waves = int(np.ceil(np.sqrt(rows.shape[1])))
        a = np.zeros((len(rows), waves * waves))
        a[:, : rows.shape[1]] = rows
        wave = np.cos(2 * np.pi * np.arange(1, waves + 1)[:, None] * t[None, :] + np.arange(waves)[:, None])
        a = np.matmul(wave.T, np.matmul(a.reshape(-1, waves, waves), wave))
        return np.clip(np.rint(128 + 48 * a / np.maximum(a.std((1, 2), keepdims=True), 1e-12)), 0, 255).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "v", 1 << 14):
            out: list[bytes | None] = [None] * part.num_rows
            sizes: dict[int, list[int]] = {}
            vectors = part.column(1).to_pylist()
            for k, v in enumerate(vectors):
                if v is not None and len(v) and not any(x is None for x in v):
                    sizes.setdefault(len(v), []).append(k)
            for rows in sizes.values():
                for k, picture in zip(rows, drawn(np.array([vectors[k] for k in rows], float)), strict=True):
                    out[k] = picture.tobytes()
            size = pa.array([side] * part.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), size, size, pa.array(out, pa.binary())], ["id", "width", "height", "pixels"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"id {kind}, width int, height int, pixels binary")
