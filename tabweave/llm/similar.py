"""Sets of word shingles for near-duplicates: the join on Jaccard similarity that completes SimHash's links.

Fingerprints of 64 bits can't decide a similarity of 0.8: such pairs differ in some ten bits. So the sets are
joined on prefixes as well: in any one order of all shingles, two sets of similarity s share k of the first
n - ceil(s * n) + k shingles of each (k grows with the smaller set, `several`). Shingles that are frequent in a sample
come last in that order, which decides about the number of candidates only. Candidates are bounded from above by their
sizes and by the places of a common shingle; what is left is verified on the whole sets. So no pair is lost.

A shingle that begins more than `hot` sets makes no rows of all pairs. Its sets are compared with one of them, which
connects a group of copies. Shingles whose sets are of one class by then are done; of the others, the sets outside the
shingle's largest class are compared with all of other classes, block against block, in tasks that return spanning
forests: first by parity bitmaps (a set's shingles flip bits; two bitmaps differ in no more bits than the sets in
shingles), then by the whole sets. That last step is quadratic in sets that share a frequent prefix shingle and are not
of one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, text_bytes
from .components import connected_components
from .kernel import Words, windows

#: Sets of which one is looked at for frequent shingles, sets of the sample that make a shingle frequent, most of those.
SAMPLE, OFTEN, MOST = 16, 3, 200_000
#: Sets of so many shingles need one more common shingle in their prefixes.
SEVERAL = 16
#: Bits of a parity bitmap.
MAP = 1024


def shingle_hashes(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all texts' shingles, how many each text has); case of A-Z is ignored, short texts have one or none."""
    data, offsets = text_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    words = Words(data, offsets)
    found = windows(words.hashes(), shingle)
    room = words.room(shingle) if len(words.starts) else np.empty(0, bool)
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    for k in short.tolist():  # the text's first word stands for its one shingle
        at = int(words.of_row[k])
        own = b" ".join(data[offsets[k] : offsets[k + 1]].tobytes().split())
        found[at], room[at] = xxhash.xxh64_intdigest(own), True
    counts = np.maximum(words.counts - shingle + 1, 0)
    counts[short] = 1
    return found[room], counts


def sets_of(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted different 32-bit shingles of each row, one row after the other; offsets)."""
    row = np.repeat(np.arange(len(counts)), counts)
    keys = np.sort((row.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    sizes = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(counts))
    return keys.astype(np.uint32).view(np.int32), np.concatenate(([0], np.cumsum(sizes)))


def bitmaps(tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each row's parity bitmap."""
    rows, size = len(offsets) - 1, MAP // 8
    row = np.repeat(np.arange(rows), np.diff(offsets))
    odd = np.bincount(row * MAP + (tokens.view(np.uint32) % np.uint32(MAP)), minlength=rows * MAP) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[k * size : (k + 1) * size] for k in range(rows)]


def several(n: Column) -> Column:
    """Shingles that the prefixes of two similar sets share at least, by the smaller set's size."""
    return 1 + F.floor(n / SEVERAL)


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(token, sid, n, at): the first shingles of each set, and their places."""
    some = sets.where(F.pmod(F.xxhash64("sid"), F.lit(SAMPLE)) == 0).select(F.explode("shingles").alias("t"))
    often = some.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "t").limit(MOST)
    late = sets.sparkSession.sparkContext.broadcast(np.sort(np.array([r.t for r in often.select("t").collect()], np.int32)))  # MOST numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "shingles"):
            lists = part.column(1)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            tokens = lists.flatten().to_numpy()
            row = np.repeat(np.arange(part.num_rows), sizes)
            slot = np.searchsorted(late.value, tokens)
            is_late = (late.value[np.minimum(slot, len(late.value) - 1)] == tokens) if len(late.value) else np.zeros(len(tokens), bool)
            order = np.lexsort((tokens, is_late, row))
            at = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = at < (sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1 + sizes // SEVERAL)[row]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[order][keep]), part.column(0).take(pa.array(row[keep])), pa.array(sizes[row[keep]].astype(np.int32)), pa.array(at[keep].astype(np.int32))], ["token", "sid", "n", "at"])

    return sets.where("n > 0").select("sid", "shingles").mapInArrow(run, "token int, sid long, n int, at int")


def alike(both: Column, n: Column, m: Column, least: float) -> Column:
    return both >= least * (n + m - both) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """(u, v): those of the (written) pairs of sets that are similar, by the whole sets."""
    # written, so that its size is known: few sets that have candidates are picked out where they are
    needed = scratch.write(pairs.select(F.col("u").alias("sid")).unionByName(pairs.select(F.col("v").alias("sid"))).distinct(), "needed")
    own = sets.select("sid", "shingles").join(needed, "sid", "left_semi")
    both = pairs.join(own.toDF("u", "s"), "u").join(own.toDF("v", "t"), "v")
    return both.where(alike(F.size(F.array_intersect("s", "t")), F.size("s"), F.size("t"), least)).select("u", "v")


def _near_in_size(n: Column, m: Column, least: float) -> Column:
    return F.least(n, m) >= least * F.greatest(n, m) - 1e-9


def rare_pairs(rows: DataFrame, crowded: DataFrame, least: float) -> DataFrame:
    """(u, v): sets whose prefixes share enough shingles that are not crowded."""
    cold = rows.join(crowded, "token", "left_anti")
    a, b = cold.toDF("token", "u", "n", "i"), cold.toDF("token", "v", "m", "j")
    most = F.least("i", "j") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))  # common shingles, by the places of one
    near = (F.col("u") < F.col("v")) & _near_in_size(F.col("n"), F.col("m"), least) & alike(most, F.col("n"), F.col("m"), least)
    pairs = a.join(b, "token").where(near).groupBy("u", "v").agg(F.count("*").alias("c"), F.min(F.least("n", "m")).alias("n"))
    return pairs.where(F.col("c") >= several(F.col("n"))).select("u", "v")


def _labelled(full: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of crowded shingles that have sets of several classes, with their classes."""
    own = full.join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    mixed = own.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a != z").select("token")
    return own.join(mixed, "token")


def star_pairs(full: DataFrame, least: float) -> DataFrame:
    """(u, v): every set of a crowded shingle with one of them."""
    centre = full.groupBy("token").agg(F.min(F.struct("sid", "n")).alias("c")).select("token", F.col("c.sid").alias("u"), F.col("c.n").alias("m"))
    met = full.join(centre, "token").where((F.col("sid") != F.col("u")) & _near_in_size(F.col("n"), F.col("m"), least))
    return met.select("u", F.col("sid").alias("v")).distinct()


def crossing_links(full: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch, least: float, block: int = 2_048) -> DataFrame | None:
    """(u, v): links that connect what is similar and of different classes within crowded shingles; None if there is none of the kind."""
    own = scratch.write(_labelled(full, labels), "mixed")
    if own.isEmpty():
        return None
    counts = own.groupBy("token", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("c")).select("token", F.col("m.label").alias("main"), F.ceil(F.col("m.c") / block).cast("int").alias("nm"), F.ceil((F.col("c") - F.col("m.c")) / block).cast("int").alias("nr"))
    needed = scratch.write(own.select("sid").distinct(), "needed")
    carried = sets.select("sid", "bitmap", "shingles").join(needed, "sid", "left_semi")
    own = own.join(main, "token").withColumn("rest", F.col("label") != F.col("main"))
    mine = F.pmod(F.xxhash64("sid"), F.when(F.col("rest"), F.col("nr")).otherwise(F.col("nm"))).cast("int")
    # the rest meets every block of the main class (i counts down from -1), and itself block against block
    to = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    places = F.when(
        F.col("rest"),
        F.concat(F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda b: to(-1 - b, F.col("mine"))), F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda b: to(F.least(b, F.col("mine")), F.greatest(b, F.col("mine"))))),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda b: to(-1 - F.col("mine"), b)))
    dealt = own.withColumn("mine", mine).select("token", "sid", "label", "n", "rest", "mine", F.explode(places).alias("p")).select("token", "sid", "label", "n", "rest", "mine", "p.i", "p.j").join(carried, "sid")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        mine, sid, n, label = (table[c].to_numpy() for c in ("mine", "sid", "n", "label"))
        rest = table["rest"].to_numpy().astype(bool)
        bits = np.frombuffer(b"".join(table["bitmap"].to_pylist()), np.uint64).reshape(len(sid), -1)
        lists = table["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        bounds, tokens = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint32)  # sorted as such
        root = np.unique(label, return_inverse=True)[1]
        one, two = table["i"][0].as_py(), table["j"][0].as_py()
        p, q = np.flatnonzero(rest & (mine == two)), np.flatnonzero(~rest if one < 0 else rest & (mine == one))
        out = []
        for x in p:
            ys = q[(root[q] != root[x]) & (np.minimum(n[q], n[x]) >= least * np.maximum(n[q], n[x]) - 1e-9)]
            ys = ys[np.bitwise_count(bits[ys] ^ bits[x]).sum(1) <= (1 - least) / (1 + least) * (n[ys] + n[x]) + 1e-9]
            if not len(ys):
                continue
            own, sizes = tokens[bounds[x] : bounds[x + 1]], n[ys].astype(np.int64)
            ends = np.cumsum(sizes)
            others = tokens[np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(bounds[ys], sizes)]
            held = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            both = np.add.reduceat(held, ends - sizes, dtype=np.int64)
            for y in ys[both >= least * (sizes + len(own) - both) - 1e-9]:
                if root[x] != root[y]:
                    out.append((min(sid[x], sid[y]), max(sid[x], sid[y])))
                    root[root == root[y]] = root[x]
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return dealt.groupBy("token", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def classes(sets: DataFrame, first: DataFrame, scratch: Scratch, least: float = 0.8, hot: int = 64) -> DataFrame:
    """(node, label) of the sets that are connected by pairs of similarity `least` or more; first: pairs to look at besides."""
    rows = scratch.write(prefixes(sets, least), "prefixes")
    crowded = scratch.write(rows.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("token"), "crowded")
    full = scratch.write(rows.join(crowded, "token").select("token", "sid", "n"), "full")
    pairs = scratch.write(rare_pairs(rows, crowded, least).unionByName(first).unionByName(star_pairs(full, least)).distinct(), "pairs")
    scratch.drop("prefixes")
    held = scratch.write(verified(pairs, sets, scratch, least), "held")
    scratch.drop("pairs", "needed")
    labels = scratch.write(connected_components(held, scratch), "labels")
    more = crossing_links(full, labels, sets, scratch, least)
    if more is None:
        return labels
    # the new links connect what the classes left apart, so the classes' own links need not be kept
    joined = labels.where("node != label").select(F.col("label").alias("u"), F.col("node").alias("v")).unionByName(scratch.write(more, "more"))
    return scratch.write(connected_components(joined, scratch), "classes")
