"""SimHash near-duplicates: fingerprints, a grid range-join over segment popcounts, exact verification, components.

A fingerprint's two 32-bit halves are each mapped to the bit counts of their segments. The Manhattan distance of two
such vectors is a lower bound of the Hamming distance, so of two fingerprints that differ in at most 3 bits one half
has vectors at distance 0 or 1. Every vector is a grid cell; vectors of odd weight also visit the cells at distance 1
(all of even weight), so each such pair meets in a cell. Pairs that meet are verified by the exact Hamming distance.

Copies count once: only different fingerprints are joined. Cells with more than `hot` fingerprints are cut into blocks
of bounded size; every pair of blocks is compared in a task of its own, which returns a spanning forest of its links
instead of all of them, so that no links between components are lost and a group of n makes O(n) rows.

How cells fill: a half's vector of 16 counts has 3^16 values of uneven weight, about 24 bits by entropy, so n fingerprints
that nothing connects make some n^2 / 2^23 candidates: few beside n up to 10^7 or so, and beyond that the blocks' share of
the work grows with n^2; what the blocks compare is 8 bytes a fingerprint.

`keep_one` is the pipeline's stage: five-word shingles and a Jaccard similarity of 0.8 or more. Pairs of that similarity
differ in about ten of 64 bits, so 3 bits find the closest only: links of fingerprints, verified by their sets, are
completed by the join in `similar`, so that no similar pair is lost.

Edge cases: a null or wordless text has fingerprint 0 and is linked as any other (in `keep_one`: all of them are one
group); fewer words than a shingle make one shingle; very long texts are one row, whose shingles are counted in pieces;
repeated rows and null ids stay rows of their own (a component's id is the smallest id that isn't null); ties between
rows that could represent a group go to the least id, then the text's digest; an empty table gives an empty table;
columns besides the id and the text, whatever their names, are not read (`keep_one` passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import similar
from .common import Scratch, blocks, text_digests
from .components import connected_components

SEED = 42
#: Hashes whose bits are counted at once, sets that a task remembers.
PIECE, MET = 1 << 17, 1_000_000
LOW = {2: 0x55555555, 4: 0x11111111, 8: 0x01010101}


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of `counts` hashes: a bit is 1 if set in over half; rows without hashes have 0."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    ends = np.cumsum(n)
    sums = np.zeros((len(full), 64), np.int64)
    raw = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    for a in range(0, len(raw), PIECE):  # a long text's bits are not all there at once
        bits = np.unpackbits(raw[a : a + PIECE], axis=1, bitorder="little")
        low, high = np.searchsorted(ends, a, "right"), np.searchsorted(ends, min(a + PIECE, len(raw)) - 1, "right") + 1
        sums[low:high] += np.add.reduceat(bits, np.maximum(ends[low:high] - n[low:high] - a, 0), axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_block(texts: list[str | None], shingle: int) -> np.ndarray:
    """64-bit fingerprints of the shingles' XXH64, repeats included."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.encode().lower().split() if text else []  # bytes.lower changes A-Z only; bytes.split cuts at 0x20, 0x09-0x0D
        if len(words) <= shingle:
            if words:
                hashes.append(digest(b" ".join(words), SEED))
            counts.append(bool(words))
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        counts.append(len(starts))
    return majority(np.array(hashes, np.uint64), np.array(counts, np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): the fingerprint of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint_block(part.column(1).to_pylist(), shingle).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def cells(fps: DataFrame, segment: int = 2) -> DataFrame:
    """(key, home boolean, fp): each half's own cell, and for vectors of odd weight the cells at Manhattan distance 1."""
    low, top = LOW[segment], segment
    halves = F.array(*[F.struct(F.lit(h).alias("h"), F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF)).alias("x")) for h in (0, 1)])
    # the bit counts of all segments at once, in fields of `segment` bits; a count of `segment` itself fits from 2 bits on
    counts = sum((F.shiftrightunsigned(F.col("s.x"), i).bitwiseAND(F.lit(low)) for i in range(segment)), F.lit(0).cast("long"))
    own = fps.select("fp", F.explode(halves).alias("s")).select("fp", "s.h", counts.alias("v"), (F.bit_count("s.x") % 2 == 1).alias("odd"))
    field = lambda i: F.shiftright("v", i).bitwiseAND(F.lit(2**segment - 1))
    steps = [F.when(field(i) < top, F.col("v") + F.lit(1 << i)) for i in range(0, 32, segment)] + [F.when(field(i) > 0, F.col("v") - F.lit(1 << i)) for i in range(0, 32, segment)]
    near = F.when(F.col("odd"), F.array(F.col("v"), *steps)).otherwise(F.array("v"))
    return own.select("fp", "h", F.posexplode(near).alias("i", "v")).where("v is not null").select((F.col("h") * F.lit(1 << 40) + F.col("v")).alias("key"), (F.col("i") == 0).alias("home"), "fp")


def forest(a: np.ndarray, b: np.ndarray, most: int, a_home: np.ndarray, b_home: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks (or within one), by rows of the distance matrix."""
    every, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(every))
    ia, ib = back[: len(a)], back[len(a) :]
    out = []
    for k in range(len(a)):
        near = (np.bitwise_count(b ^ a[k]) <= most) & (b_home | a_home[k])
        hit = ib[near]
        roots = np.unique(root[hit])
        mine = root[ia[k]]
        for r in roots[roots != mine]:
            out.append((int(every[ia[k]]), int(every[hit[root[hit] == r][0]])))
            root[root == r] = mine
    return out


def links(fps: DataFrame, scratch: Scratch, bits: int = 3, segment: int = 2, hot: int = 64, block: int = 1024) -> DataFrame:
    """(u, v): links that connect any two different fingerprints of `fps` (column fp, distinct) that differ in at most 3 bits."""
    if bits > 3:
        raise ValueError("halves at distance 1 are certain to meet for at most 3 differing bits")
    all_cells = cells(fps, segment)
    sizes = all_cells.groupBy("key").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("n"))
    crowded = scratch.write(sizes.where((F.col("homes") > hot) & (F.col("n") > 1)).select("key", F.ceil(F.col("n") / block).cast("int").alias("nb")), "crowded")
    cold = all_cells.join(crowded, "key", "left_anti")
    a, b = cold.where("home").select("key", F.col("fp").alias("u")), cold.select("key", "home", F.col("fp").alias("v"))
    pairs = a.join(b, "key").where((F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits) & (F.col("u") != F.col("v")) & (~F.col("home") | (F.col("u") < F.col("v")))).select("u", "v")
    dealt = all_cells.join(crowded, "key").withColumn("at", F.pmod(F.xxhash64("fp"), "nb").cast("int"))
    dealt = dealt.select("key", "home", "fp", "at", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "home", "fp")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["at"].to_numpy() == pdf["i"].to_numpy()
        fp, home = pdf["fp"].to_numpy().astype(np.int64).view(np.uint64), pdf["home"].to_numpy().astype(bool)
        other = ~own if pdf["i"].iloc[0] != pdf["j"].iloc[0] else own
        found = np.array(forest(fp[own], fp[other], bits, home[own], home[other]), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    dense = dealt.groupBy("key", "i", "j").applyInPandas(compare, "u long, v long")
    return pairs.unionByName(dense).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def labelled(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, shingle: int, bits: int, segment: int) -> tuple[DataFrame, DataFrame]:
    """((id, fp) of every document, (fp, least id, label) of every fingerprint); linked fingerprints share a label."""
    marked = scratch.write(fingerprints(docs, id_col, text_col, shingle), "marked")
    reps = scratch.write(marked.groupBy("fp").agg(F.min("id").alias("least")), "reps")
    found = scratch.write(links(reps.select("fp"), scratch, bits, segment), "links")
    labels = connected_components(found, scratch)  # (node, label) of fingerprints that have links
    named = reps.join(labels, reps.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    return marked, scratch.write(named, "named")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3, segment: int = 2) -> DataFrame:
    """(id, fp long, component): documents whose fingerprints are connected by links share the smallest id."""
    marked, named = labelled(docs, Scratch(docs.sparkSession, "simhash"), id_col, text_col, shingle, bits, segment)
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    by_fp = named.join(least, "label").select("fp", "component")
    return marked.join(by_fp, "fp").select("id", "fp", "component")


def shingled(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, d1, d2, k1, k2, fp, n, bitmap, shingles): each document's text, set of shingles (128 bits each) and fingerprint.

    Sets that a task has met before are not carried again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for part in blocks(batches, "text"):
            hashes, counts = similar.shingle_hashes(part.column(3), shingle)
            fps = majority(hashes, counts).view(np.int64)
            tokens, offsets = similar.sets_of(hashes, counts)
            maps = similar.bitmaps(tokens, offsets)
            keys = [xxhash.xxh128_intdigest(tokens[a:b].tobytes(), SEED) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            keys = [(k >> 64) - (1 << 63) for k in keys], [(k & (1 << 64) - 1) - (1 << 63) for k in keys]
            new = []
            for key in zip(*keys, strict=True):
                new.append(key not in met)
                met.add(key)
            if len(met) > MET:
                met.clear()
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens))
            lists = pc.if_else(pa.array(new), lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), *(pa.array(k, pa.int64()) for k in keys), pa.array(fps), pa.array(np.diff(offsets).astype(np.int32)), pa.array(maps, pa.binary()), lists], ["id", "d1", "d2", "k1", "k2", "fp", "n", "bitmap", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    plain = docs.select(F.col(id_col).alias("id"), *text_digests(text), text.alias("text"))
    return plain.mapInArrow(run, f"id {kind}, d1 long, d2 long, k1 long, k2 long, fp long, n int, bitmap binary, shingles array<int>")


def near_copies(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, shingle: int, similarity: float, bits: int = 3) -> tuple[DataFrame, DataFrame]:
    """((id, d1, d2, k1, k2) of every document, (k1, k2, label) of every set of shingles); similar sets share a label.

    Fingerprints within `bits` bits are candidates, which are verified by their sets; the join of `similar` adds the pairs
    that fingerprints can't tell.
    """
    made = scratch.write(shingled(docs, id_col, text_col, shingle).withColumn("sid", F.monotonically_increasing_id()), "shingled")  # numbers are written, so they stay
    carrying = F.when(F.col("shingles").isNotNull(), F.col("sid"))
    own = scratch.write(made.groupBy("k1", "k2").agg(F.min(carrying).alias("sid")), "own")  # one row of each set
    rest = scratch.write(made.where("shingles is not null").select("sid", "k1", "k2").join(own, ["k1", "k2", "sid"], "left_anti").select("sid"), "rest")
    sets = made.where("shingles is not null").join(rest, "sid", "left_anti")  # few: copies that different tasks have met
    fps = scratch.write(sets.groupBy("fp").agg(F.min("sid").alias("rep")), "fps")
    between = links(fps.select("fp"), scratch, bits)
    u, v = fps.select(F.col("fp").alias("u"), F.col("rep").alias("a")), fps.select(F.col("fp").alias("v"), F.col("rep").alias("b"))
    pairs = between.join(u, "u").join(v, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = scratch.write(pairs.unionByName(sets.select("fp", "sid").join(fps, "fp").where("sid != rep").select(F.col("rep").alias("u"), F.col("sid").alias("v"))), "links")
    labels = similar.classes(sets, pairs, scratch, similarity)
    named = own.join(labels, F.col("sid") == F.col("node"), "left").select("k1", "k2", F.coalesce("label", "sid").alias("label"))
    return made.select("id", "d1", "d2", "k1", "k2"), named


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, all columns, with one of each group of near copies: that with the least id (a null id is the greatest).

    Near copies have sets of word shingles with a Jaccard similarity of at least `similarity`; a group is what they
    connect. Of rows with the same id in a group one stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked, named = near_copies(docs, scratch, id_col, text_col, shingle, similarity)
    own = F.struct(F.col("id").isNull().alias("none"), "id", "d1", "d2")
    reps = marked.groupBy("k1", "k2").agg(F.min(own).alias("rep"))  # copies are many rows of one set
    keepers = reps.join(named, ["k1", "k2"]).groupBy("label").agg(F.min("rep").alias("k")).select("k.id", "k.d1", "k.d2")
    rows = marked.groupBy("id", "d1", "d2").agg(F.count("*").alias("rows"))
    m, k = rows.alias("m"), keepers.alias("k")
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.d1") == F.col(f"{b}.d1")) & (F.col(f"{a}.d2") == F.col(f"{b}.d2"))
    keepers = scratch.write(m.join(k, same("m", "k")).select("m.*"), "keepers")
    scratch.drop("shingled", "full", "mixed", "held", "more")
    names = [f"c{k}" for k in range(len(docs.columns))]
    at, own_id = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    plain = docs.toDF(*names)
    p = plain.select("*", F.col(own_id).alias("id"), *text_digests(F.col(at).cast("string"))).alias("p")
    stay = p.join(keepers.alias("k"), same("p", "k")).select("p.*", "k.rows")
    if (keepers.agg(F.max("rows")).first()[0] or 0) > 1:  # equal rows: one of each stays
        first = Window.partitionBy("id", "d1", "d2").orderBy(F.xxhash64(*[F.col(c).cast("string") for c in names if c != at]))
        stay = stay.withColumn("at", F.row_number().over(first)).where("at = 1")
    return stay.select(*names).toDF(*docs.columns)
