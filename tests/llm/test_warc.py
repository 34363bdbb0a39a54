import gzip
import hashlib
import random
from pathlib import Path

import pytest

from tabweave.llm import warc
from tabweave.llm.common import Scratch

SCHEMA = "page_id long, url string, html string, digest string, id int"


def rows():
    r = random.Random(6)
    big = "é\r\n\r\nWARC/1.1\r\n" * 20000
    texts = [None, "", "small", "small", big, big + "x", "y" * 1000, "y" * 1000, "y" * 999, "y" * 999, "é" * 500, "z" * (1 << 16), "z" * ((1 << 16) + 1)]
    texts += ["".join(r.choice("ab \r\n") for _ in range(r.randint(0, 3000))) for _ in range(30)] + [big] * 5
    out = [(i, r.choice([None, "http://a/b", "x\r\nWARC-Type: warcinfo"]), t, "d", 1) for i, t in enumerate(texts)]
    return [*out, (None, None, big, None, None), (None, None, "n", None, None), out[-1]]


def wanted(data):
    by = {}
    for i, _, t, *_ in data:
        raw = (t or "").encode()
        if len(raw) >= 1000 and i is not None:
            by[raw] = max(by.get(raw, i), i)
    out = []
    for i, _, t, *_ in data:
        raw = (t or "").encode()
        last = by.get(raw)
        again = last is not None and last != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,records", [(1 << 16, 128), (700, 3)])
def test_round_trip(spark, monkeypatch, chunk, records):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    path = Scratch(spark, "test").path("w")
    warc.write_archives(df, path, chunk=chunk, records=records)
    got = warc.read_archives(spark, path)
    assert sorted(((None if r.id is None else int(r.id), r.bytes, r.digest, r.type, None if r.refers is None else int(r.refers)) for r in got.collect()), key=str) == wanted(data)
    urls = sorted((r.url or "") for r in got.collect())
    assert urls == sorted((u or "").replace("\r", "%0D").replace("\n", "%0A") for _, u, *_ in data)
    assert records > 3 or spark.read.format("binaryFile").load(path).count() > 10


def test_query_form_and_empty_table(spark):
    out = warc.round_trip(spark.createDataFrame(rows(), SCHEMA))
    assert sorted(((r.id, r.bytes, r.digest, r.type, r.refers) for r in out.collect()), key=str) == wanted(rows())
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damage_is_found(spark):
    df = spark.createDataFrame([(1, "u", "q" * 5000, "", 0)], SCHEMA)
    for change in (lambda b: b.replace(b"qqqq", b"qqqr", 1), lambda b: b[:-400]):
        path = Scratch(spark, "test").path("w")
        warc.write_archives(df, path, chunk=1000)
        for f in Path(path.removeprefix("file://").removeprefix("file:")).glob("*.gz"):
            f.write_bytes(gzip.compress(change(gzip.decompress(f.read_bytes()))))
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
        with pytest.raises(Exception, match="differs|ends within|lacks"):
            warc.read_archives(spark, path).collect()


def test_text_ids_come_back(spark):
    ids = ["a\r\nWARC-Type: x", "%0D%", "", " lead", "é", "a: b", None]
    df = spark.createDataFrame([(i, "u", "payload " * 200) for i in ids] + [("z", "u", "short")], "page_id string, url string, html string")
    got = warc.round_trip(df).collect()
    last = max(i for i in ids if i is not None)
    assert sorted(((r.id, r.refers) for r in got), key=str) == sorted([(i, None if i == last else last) for i in ids] + [("z", None)], key=str)


def test_archives_are_cut_by_bytes(spark):
    df = spark.range(3000).selectExpr("id as page_id", "'u' as url", "concat(id, repeat('x', 200)) as html").coalesce(2)
    path = Scratch(spark, "test").path("w")
    warc.write_archives(df, path)
    assert spark.read.format("binaryFile").load(path).count() <= 2
