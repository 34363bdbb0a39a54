"""Shards along a Hilbert curve over several metadata dimensions; DataFrame functions only.

Every dimension is quantised to `bits` bits by its own quantiles (of texts by their whole values in order); the
cell's index on the Hilbert curve orders the rows, and the order is cut into runs of equal row counts. Neighbours on the
curve are near in every dimension, so a file's minima and maxima are narrow in all of them and readers skip files for
predicates on any.

The order needs every row's rank, but no task sorts all rows: cells are divided by the text's hash and then the id's, the
counts of (cell, part) are summed up along the curve (within cells, and over the at most 2 ** (bits * dimensions) cells),
and rows are numbered within their part. A cell that holds a third of all rows is many parts.

Edge cases: nulls are the lowest code of a dimension, as are values below its first limit; very long texts and values are
compared and measured as a whole; rows tied in cell, parts and text go by their id; a null text has size 1 and the checksum of no bytes; null ids rank
first in their part; repeated rows have ranks of their own, and rows that agree in everything are interchangeable; an
empty table gives an empty table; other columns are not read by `hilbert_shards`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

BITS, TEXT_PARTS, ID_PARTS = 4, 16, 64
LAW = "rows"


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.StringType, T.BinaryType))


def numeric(df: DataFrame, column: str):
    """A number that orders the column's values (of texts there is none)."""
    if isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType)):
        return F.unix_timestamp(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def text_limits(df: DataFrame, column: str, shares: list[float], scratch: Scratch) -> list:
    """The values of a text column at the shares of its rows, by whole values in order.

    Values are counted, dealt by ranges, and counts are summed up within ranges and over them; no task has all values.
    """
    counts = df.select(F.col(column).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    dealt = scratch.write(counts.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("range")), f"values_{column}")
    ranges = dealt.groupBy("range").agg(F.sum("n").alias("n"))  # as many rows as partitions
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    upto = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("upto", F.sum("n").over(upto)).join(ranges, "range").select("v", ((F.col("before") + F.col("upto")) / F.col("rows")).alias("share"))
    row = ranked.agg(*[F.min(F.when(F.col("share") > s, F.col("v"))).alias(f"l{k}") for k, s in enumerate(shares)]).first()
    return [v for v in row if v is not None]


def quantised(df: DataFrame, dimensions: list[str], scratch: Scratch, bits: int = BITS) -> DataFrame:
    """The rows with codes __d0, __d1, ..: how many of the dimension's quantile limits the value reaches."""
    shares = [k / 2**bits for k in range(1, 2**bits)]
    numbers = [d for d in dimensions if not is_text(df, d)]
    found = df.select(*[F.percentile_approx(numeric(df, d), shares, 10_000).alias(d) for d in numbers]).first() if numbers else {}  # 2 ** bits numbers each
    out = df
    for i, d in enumerate(dimensions):
        text = is_text(df, d)
        limits = text_limits(df, d, shares, scratch) if text else found[d] or ()
        value = F.col(d) if text else numeric(df, d)
        out = out.withColumn(f"__d{i}", sum((F.when(value >= F.lit(s), 1).otherwise(0) for s in sorted(set(limits))), F.lit(0)))
    return out


def hilbert(df: DataFrame, codes: list[str], bits: int, to: str) -> DataFrame:
    """The rows with column `to`: the index of the cell (codes) on the Hilbert curve, by the transposed-axes form.

    The steps are folds over a row's array of axes: written out, every step would repeat those before it several times.
    """
    n, one = len(codes), F.lit(1).cast("long")
    axes = F.array(*[F.col(c).cast("long") for c in codes])

    def undo(x, s):
        q = F.call_function("shiftleft", one, (F.lit(bits - 1) - F.floor(s / n)).cast("int"))
        i = s % n
        own, first, low = F.get(x, i), F.get(x, F.lit(0)), q - 1
        is_set = own.bitwiseAND(q) != 0
        swap = F.when(is_set, F.lit(0).cast("long")).otherwise(first.bitwiseXOR(own).bitwiseAND(low))
        turn = F.when(is_set, low).otherwise(F.lit(0).cast("long"))
        return F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(turn).bitwiseXOR(swap)).when(j == i, v.bitwiseXOR(swap)).otherwise(v))

    undone = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), axes, undo) if bits > 1 else axes
    df = df.withColumn("__x", undone)
    gray = F.transform("__x", lambda v, j: F.aggregate(F.slice("__x", 1, j + 1), F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(w)))
    df = df.withColumn("__x", gray)
    if bits > 1:
        power = lambda k: F.call_function("shiftleft", one, k)
        flip = F.aggregate(F.sequence(F.lit(1), F.lit(bits - 1)), F.lit(0).cast("long"), lambda a, k: F.when(F.get("__x", F.lit(n - 1)).bitwiseAND(power(k)) != 0, a.bitwiseXOR(power(k) - 1)).otherwise(a))
        df = df.withColumn("__t", flip).withColumn("__x", F.transform("__x", lambda v: v.bitwiseXOR(F.col("__t")))).drop("__t")
    bit = lambda s: F.call_function("shiftright", F.get("__x", s % n), (F.lit(bits - 1) - F.floor(s / n)).cast("int")).bitwiseAND(one)
    index = F.aggregate(F.sequence(F.lit(0), F.lit(bits * n - 1)), F.lit(0).cast("long"), lambda a, s: a * 2 + bit(s))
    return df.withColumn(to, index).drop("__x")


def ranked(df: DataFrame, cell: str, parts: list[str], order: list[str]) -> DataFrame:
    """The rows with __rank (gapless from 0, by cell, parts, order) and __rows (of the table)."""
    counts = df.groupBy(cell, *parts).agg(F.count("*").alias("__n"))
    inner = Window.partitionBy(cell).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy(cell).agg(F.sum("__n").alias("__c"))
    # at most as many rows as the curve has cells
    outer = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(cell, F.coalesce(F.sum("__c").over(outer), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("__rows"))
    starts = counts.withColumn("__within", F.coalesce(F.sum("__n").over(inner), F.lit(0))).join(cells, cell).select(cell, *parts, (F.col("__before") + F.col("__within")).alias("__start"), "__rows")
    number = F.row_number().over(Window.partitionBy(cell, *parts).orderBy(*order)) - 1
    return df.withColumn("__k", number).join(starts, [cell, *parts]).withColumn("__rank", F.col("__start") + F.col("__k")).drop("__k", "__start")


def hilbert_shards(docs: DataFrame, shards: int = 16, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, the dimensions, curve, size, text_crc32, shard, slot): every row's run along the curve and its place there."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    scratch = Scratch(docs.sparkSession, "sharding")
    coded = hilbert(quantised(docs, list(dimensions), scratch, bits), [f"__d{i}" for i in range(len(dimensions))], bits, "curve")
    rows = coded.select(
        F.col(id_col).alias("id"), *[F.col(d) for d in dimensions if d != "id"], "curve",
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(TEXT_PARTS)).cast("int").alias("__p"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(ID_PARTS)).cast("int").alias("__q"),
    )
    rows = scratch.write(rows, "rows")  # without texts, which are read once
    out = ranked(rows, "curve", ["__p", "__q"], ["text_crc32", "id"])
    shard = F.expr(f"(__rank * {shards}) div __rows")
    return out.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("__rank") - F.expr(f"(cast(shard as long) * __rows + {shards - 1}) div {shards}")).drop("__p", "__q", "__rank", "__rows")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Files by shard in curve order; a large shard is several files of consecutive runs."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
