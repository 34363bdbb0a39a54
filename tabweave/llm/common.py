"""Helpers shared by the operators: scratch tables in the cluster's shared folder, Arrow blocks, grouping keys."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of an Arrow batch.
TEXT_ROWS = 500
#: Text that a worker handles at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, on a local master only) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="tabweave-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive executors; removed when the driver's JVM ends, or by drop()."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self._fs().deleteOnExit(self._path(self.base))

    def _path(self, where: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)

    def _fs(self):
        return self._path(self.base).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with text_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads, and lets Spark remove the shuffle files of plans that are done."""
        for name in names:
            self._fs().delete(self._path(self.path(name)), True)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Spark removes a finished plan's shuffle files when the driver collects its garbage; ask for that between stages."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives memory that a task has freed back to the system, which a worker would keep for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column holds at most limit bytes (of a list: items), or one row."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(column)
            sizes = pc.list_value_length(own) if pa.types.is_list(own.type) else pc.binary_length(own)
            sizes = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(sizes):
                before = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
                yield batch.slice(start, stop - start)
                start = stop
            del batch, own
    finally:
        trim()


@contextlib.contextmanager
def text_batches(spark: SparkSession):
    """Bounds the session's Arrow batches for rows of whole texts, for as long as the block runs.

    The default of 10,000 rows is made for numbers. A smaller setting of the session's own stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= TEXT_ROWS:
        yield
        return
    spark.conf.set(key, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_open: dict[str, object] = {}


def opened(key: str, make: Callable[[], object], most: int = 2) -> object:
    """A worker's object for a key, made once for all tasks and queries that the process serves; the oldest goes.

    Whatever is remembered beside a broadcast value would otherwise be there once for each query of a session.
    """
    if key not in _open:
        while len(_open) >= most:
            _open.pop(next(iter(_open)))
        _open[key] = make()
    return _open[key]


def carried(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, int, str]:
    """The columns `keep` with the text, which is sent to the workers once; the text's place; the kept columns' schema."""
    columns = [*keep] if text_col in keep else [*keep, text_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*columns), columns.index(text_col), schema


def text_digests(text: Column) -> list[Column]:
    """128 bits of a text, null as empty: d1, d2."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2")]


def without(docs: DataFrame, rejected: DataFrame, text_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The documents, all columns whatever their names, whose text (and the columns `by`, null-safe) isn't among rejected (d1, d2, *by).

    Both are dealt by digest, at every size: a second pass of all texts through workers would cost their memory.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    p, r = own.select("*", *text_digests(F.col(names[docs.columns.index(text_col)]))).alias("p"), rejected.distinct().hint("merge").alias("r")
    same = (F.col("p.d1") == F.col("r.d1")) & (F.col("p.d2") == F.col("r.d2"))
    for c in by:
        same = same & F.col(f"p.{names[docs.columns.index(c)]}").eqNullSafe(F.col(f"r.{c}"))
    return p.join(r, same, "left_anti").select(*names).toDF(*docs.columns)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes in one array, and the rows' offsets in it (nulls are empty)."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]
