"""The thin queries on the smallest tables: columns, digests and whole tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

import public_tokenizers as P
from tabweave.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, db.sql(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()))


def test_byte_bpe_digests(spark, documents):
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=queries.byte_vocabulary().tokens, special_tokens={})
    want = set()
    for i, t in documents:
        ids = reference.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {tuple(r) for r in queries.op5_byte_bpe(spark, FOLDER).collect()} == want


def test_packing_checksums(spark, documents):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in documents}
    rows = queries.op7_packing(spark, FOLDER).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.03 * sum(map(len, ids.values())) / 2048 + 2


@pytest.mark.parametrize(
    "name,columns",
    [
        ("op2_image_copies", ["vec_id", "class_id", "links"]),
        ("op3_hilbert_shards", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve"]),
        ("op4_url_rules", ["page_id", "host", "path", "rule", "verdict"]),
        ("op6_simhash", ["doc_id", "fingerprint", "component_id"]),
        ("op8_toxicity", ["doc_id", "held_out", "score", "predicted"]),
        ("op9_quality", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]),
    ],
)
def test_columns_and_rows(spark, name, columns):
    out = queries.QUERIES[name](spark, FOLDER)
    assert out.columns == columns
    table = {"vec_id": "embeddings", "page_id": "pages", "doc_id": "documents"}[columns[0]]
    want = duckdb.sql(f"SELECT {columns[0]} FROM '{FOLDER}/{table}.parquet'").fetchall()
    assert sorted(r[0] for r in out.collect()) == sorted(x[0] for x in want)


def test_fingerprints_are_hex(spark):
    assert all(len(r.fingerprint) == 16 and int(r.fingerprint, 16) >= 0 for r in queries.op6_simhash(spark, FOLDER).collect())
