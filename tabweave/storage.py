"""Scratch tables of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Writes tables under spark.checkpoint.dir (or, on a local master only, a folder of our own where that is unset) and reads them back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tabweave-")
            spark.sparkContext.setCheckpointDir(root)
        self.base = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """A table that an earlier one of the same name is replaced by: it must not be read any more."""
        where = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)
