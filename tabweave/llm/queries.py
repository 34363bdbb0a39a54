"""The queries of this subpackage: thin, whole tables, production parameters."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, media, packing, quality, sharding, simhash, suffix, toxicity, urlrules, warc
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def byte_vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@functools.cache
def word_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as definition:
        return definition.read()


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more: one row per document and span."""
    out = suffix.repeated_spans(_table(spark, sf_dir, "documents"))
    return out.withColumnsRenamed({"id": "doc_id", "begin": "begin_word", "end": "end_word", "source": "copy_of"})


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of pictures, one drawn from every embedding (the tables hold no images)."""
    return media.image_classes(media.pictures(_table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 runs along a Hilbert curve over language, source and length."""
    out = sharding.hilbert_shards(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


#: The rules that a url filter starts from.
URL_RULES = [
    urlrules.HostRule("org/", "allow"),
    urlrules.HostRule("example.org/es/", "block"),
    urlrules.HostRule("example.org/en/1", "block"),
    urlrules.HostRule("com/fr/", "allow"),
    urlrules.HostRule("com/de/", "block"),
]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: explicit rules, else rules mined from the urls that they label."""
    return urlrules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    out = bpe.encode_decode(_table(spark, sf_dir, "documents"), byte_vocabulary())
    out = out.select(F.col("id").alias("doc_id"), F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return Scratch(spark, "op5").write(out, "digests")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    out = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 2048."""
    return packing.pack(_table(spark, sf_dir, "documents"), word_tokenizer()).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a classifier fitted on labels that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_on_labels(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, model, keep=("doc_id",))
    out = out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))
    return Scratch(spark, "op8").write(out, "scores")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    out = quality.judged(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.BASE, "base_failed", "kept", "distance")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from archives."""
    out = warc.round_trip(_table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_image_copies, op3_hilbert_shards, op4_url_rules, op5_byte_bpe, op6_simhash, op7_packing, op8_toxicity, op9_quality, op10_warc)}
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
        t AS (SELECT least AS doc_id, text, list_filter(regexp_split_to_array(text, '[\\x09-\\x0D ]+'), lambda w: w <> '') AS w FROM g),
        n AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) AS s FROM t),
        v AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 50], ' ') AS p FROM n),
        r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY p ORDER BY doc_id, s) = 1 AS kept, count(*) OVER (PARTITION BY p) AS c FROM v),
        q AS (SELECT doc_id, kept, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id, kept ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM r WHERE c > 1),
        i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kept ORDER BY s) AS k FROM q)
        SELECT doc_id, CAST(min(s) AS INTEGER) AS begin_word, CAST(max(s) + 50 AS INTEGER) AS end_word, kept, CAST(NULL AS BIGINT) AS copy_of FROM i GROUP BY doc_id, kept, k
        UNION ALL SELECT d.doc_id, 0, CAST(len(t.w) AS INTEGER), false, g.least FROM d JOIN g USING (text) JOIN t ON t.text = d.text WHERE d.doc_id <> g.least AND len(t.w) >= 50""",
    "op10_warc": """
        WITH f AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM f)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM g""",
}
