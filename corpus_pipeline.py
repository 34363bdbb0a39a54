"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents, whatever further columns there are and however they are named.
Quality rules and toxicity drop what they reject; of every group of near copies (sets of five-word shingles with a Jaccard
similarity of 0.8 or more) the document with the least id stays; passages that occur before are cut out of the texts; what
is left is packed into sequences.

Edge cases: null and empty texts fail the quality rules and go there; null ids, languages and sources are values like any
other (a null id represents its group only if all ids are null; passages' first occurrences are those of the least id, null
first); of rows with equal id and text one stays; ties go to the least id, then the text; very long texts pass every stage
as a whole; an empty table makes an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import packing, quality, simhash, suffix, toxicity
from tabweave.llm.common import Scratch
from tabweave.llm.queries import word_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject_outliers(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_on_labels(docs, labels)
    return toxicity.clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix.cut_repeats(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("simhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", pack_sequences),
]

#: SQL has no word for these stages; the tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
