"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from tabweave import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


def plain(rows):
    rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, FOLDER)
    want = sql.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(sql.sql(f"SELECT {listed} FROM ({queries.ORACLES[name]})").fetchall())


def test_sql_is_for_registered_queries():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_flagship(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["x", "y", "score", "rank"] and out.count() > 0
