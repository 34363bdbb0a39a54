"""New web tables, as they arrive, become cells of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import IndexConfig
from ..sources.corpus import WEB_TABLE
from ..sources.indexing import build_index, layouts


def arriving_tables(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(WEB_TABLE).option("pathGlobFilter", "*.{json,jsonl,ndjson,gz}").option("maxFilesPerTrigger", files_per_trigger).json(folder)


def table_key():
    """Ids that don't depend on arrival: a positive hash of url, title and content."""
    return F.xxhash64("url", "title", "relation").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def maintain_index(tables: DataFrame, path: str, checkpoint: str, config: IndexConfig | None = None, available_now: bool = True) -> StreamingQuery:
    """Appends each batch's cells (by token and by table), columns and tables under `path`. A batch that is run again replaces its own folder."""

    def add(batch: DataFrame, number: int) -> None:
        for name, df in layouts(build_index(batch.withColumn("tableid", table_key()), config)).items():
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    writer = tables.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
