"""WARC archives through a chunked record table.

A payload is written as rows (record, segment, bytes): the first row is the record itself, the others are WARC
continuation records, which name their origin and number; the last one carries the total length. A row holds at most
`CHUNK` payload bytes. An archive has so many rows that it holds some `ARCHIVE` bytes of mean rows, at most `ROWS`, so it
is bounded (by ROWS * CHUNK) however large its records are, and a record may go on in another archive. Archives are text files whose rows end with the two line ends that end a WARC
record, compressed; Spark's writer commits them task by task, so a lost executor leaves no half-written archive.

Reading parses archives as streams. The digest and the length of a record of one segment are known where it is read; the
segments of longer ones are brought together by record, sorted by number, and hashed one after the other, so a whole
payload is never in a worker's memory. Both are held against the record's headers; a difference or a missing segment is
an error.

Records whose payloads are equal (length, SHA-1) and at least `LEAST` bytes long are written once: the one with the
largest id; the others become revisit records without a payload, which name it. Who refers to whom is found on ids and
digests alone.

Edge cases: a null payload is empty; null and unusual urls are written as they can be (line ends are escaped); ids are
escaped and come back as they were; very long payloads are rows of at most CHUNK bytes; rows with
a null id are records without an id and revisit like others, but are never referred to unless all of the group's ids are
null, where all are responses; rows with equal id and payload are all responses if theirs is the largest id; an empty
table writes no records; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

CHUNK, LEAST = 1 << 16, 1000
#: Uncompressed bytes of an archive, by the mean row; most rows of an archive.
ARCHIVE, ROWS = 1 << 26, 8_192
#: Fixed value: the date of records whose table has none.
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"


def _line(name: str, value) -> F.Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def digests(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    return pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))


def revisits(facts: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, digest, refers): the records (id, digest, bytes) whose payload another one holds."""
    facts = facts.where(F.col("bytes") >= least)
    groups = facts.groupBy("digest", "bytes").agg(F.max("id").alias("refers"), F.count("*").alias("n")).where("n > 1 and refers is not null")
    return facts.join(groups, ["digest", "bytes"]).where(~F.col("id").eqNullSafe(F.col("refers"))).select("id", "digest", "refers").distinct()


def chunk_rows(pages: DataFrame, known: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """(record, segment, segments, id, url, digest, bytes, refers, body binary): a row for each record and chunk number."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    a, b = rows.alias("a"), known.alias("b")
    rows = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.digest") == F.col("b.digest")), "left").select("a.*", "b.refers")
    rows = rows.withColumn("segments", F.when(F.col("refers").isNotNull() | (F.col("bytes") == 0), 1).otherwise(F.ceil(F.col("bytes") / chunk)).cast("int"))
    rows = rows.withColumn("record", F.expr("uuid()")).withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("segments"))))
    body = F.when(F.col("refers").isNotNull(), F.lit("").cast("binary")).otherwise(F.substring("payload", (F.col("segment") - 1) * chunk + 1, F.lit(chunk)))
    return rows.select("record", "segment", "segments", "id", "url", "digest", "bytes", "refers", body.alias("body"))


def record_text(rows: DataFrame) -> DataFrame:
    """(value): each row as a WARC record without the line ends after it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END * 2)).cast("binary")
    first = F.col("segment") == 1
    block = F.when(first, F.concat(http, F.col("body"))).otherwise(F.col("body"))
    name = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    own = F.when(first, F.col("record")).otherwise(F.concat_ws("-", "record", F.col("segment").cast("string")))
    lines = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    escaped = lambda c: lines(F.replace(F.col(c).cast("string"), F.lit("%"), F.lit("%25")))
    url = lines(F.col("url"))
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _line("WARC-Type", F.when(~first, "continuation").when(F.col("refers").isNotNull(), "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(own)),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _line("WARC-Profile", F.when(first & F.col("refers").isNotNull(), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Segment-Number", F.when(F.col("segments") > 1, F.col("segment").cast("string"))),
        _line("WARC-Segment-Origin-ID", F.when(~first, name(F.col("record")))),
        _line("WARC-Segment-Total-Length", F.when((F.col("segments") > 1) & (F.col("segment") == F.col("segments")), (F.octet_length(http) + F.col("bytes")).cast("string"))),
        _line("X-Id", escaped("id")),
        _line("X-Refers-To-Id", escaped("refers")),
        _line("X-Payload-Length", F.col("bytes").cast("string")),
        _line("Content-Type", F.when(first, "application/http;msgtype=response").otherwise("application/octet-stream")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END * 2),
    )
    return rows.select(F.concat(header.cast("binary"), block).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK, records: int | None = None, least: int = LEAST) -> None:
    """Archives of all rows, in the folder `path`; records: rows of an archive (by default, what ARCHIVE bytes hold)."""
    scratch = Scratch(pages.sparkSession, "warc")
    facts = scratch.write(digests(pages, id_col, payload_col), "facts")
    known = scratch.write(revisits(facts, least), "known")  # written, so that its size is known: few are sent to the payloads
    if records is None:
        rows = facts.agg(F.sum("bytes").alias("bytes"), F.sum(F.greatest(F.ceil(F.col("bytes") / chunk), F.lit(1))).alias("n")).first()
        records = max(1, min(ROWS, int(ARCHIVE // (500 + (rows["bytes"] or 0) / max(1, rows["n"] or 0)))))
    rows = chunk_rows(pages, known, id_col, url_col, payload_col, chunk)
    record_text(rows).write.mode("overwrite").option("lineSep", _END * 2).option("maxRecordsPerFile", records).option("compression", "gzip").text(path)


def _bytes(content: memoryview, step: int = 1 << 18) -> Iterator[bytes]:
    """The archive's bytes, decompressed piece by piece without a copy of the whole; any number of compressed members."""
    content, at = memoryview(content), 0
    if bytes(content[:2]) != b"\x1f\x8b":
        for k in range(0, len(content), step):
            yield bytes(content[k : k + step])
        return
    while at < len(content):
        stream = zlib.decompressobj(31)
        while not stream.eof and at < len(content):
            piece = content[at : at + step]
            while len(piece) and not stream.eof:
                out = stream.decompress(piece, 4 * step)  # bounded, however well it was compressed
                if out:
                    yield out
                piece = stream.unconsumed_tail
            at = min(at + step, len(content))
        while not stream.eof and (out := stream.decompress(b"", 4 * step)):
            yield out
        if not stream.eof:
            raise ValueError("the archive ends within a compressed member")
        at -= len(stream.unused_data)


class Reader:
    """Records of a byte stream: headers, then the block in parts of bounded size."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.buffer = parts, bytearray()

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.buffer += part
        return True

    def _take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def headers(self) -> dict[str, str] | None:
        while self.buffer[:2] == b"\r\n" or len(self.buffer) < 2:
            if self.buffer[:2] == b"\r\n":
                del self.buffer[:2]
            elif not self._more():
                if self.buffer:
                    raise ValueError("bytes after the last record")
                return None
        seen = 0
        while (end := self.buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(self.buffer) - 3)
            if not self._more():
                raise ValueError("the archive ends within a record's headers")
        version, *lines = self._take(end + 4)[:-4].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}

    def block(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record's block")
            part = self._take(min(length, len(self.buffer)))
            length -= len(part)
            yield part


FIELDS = "record string, segment int, id string, url string, type string, digest string, bytes long, refers string, total long, sha1 string, size long, body binary"


def _plain(text: str | None) -> str | None:
    """An id as it was before it was escaped."""
    return text if text is None else text.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def _parsed(content: bytes) -> Iterator[tuple]:
    """A row for each record or continuation; the body only where a record has several segments."""
    reader = Reader(_bytes(content))
    while (h := reader.headers()) is not None:
        go_on = h["warc-type"] == "continuation"
        several = "warc-segment-number" in h
        left, body, size, digest = int(h["content-length"]), [], 0, hashlib.sha1()
        head = b"" if go_on else None  # of an HTTP message, until its blank line
        pending = bytearray()
        for part in reader.block(left):
            if head is None:
                pending += part
                if (end := pending.find(b"\r\n\r\n")) < 0:
                    continue
                head, part = bytes(pending[:end]), bytes(pending[end + 4 :])
            size += len(part)
            if several:
                body.append(part)
            else:
                digest.update(part)
        name = h["warc-segment-origin-id"] if go_on else h["warc-record-id"]
        yield (
            name.removeprefix("<urn:uuid:").removesuffix(">"), int(h.get("warc-segment-number", 1)), _plain(h.get("x-id")), h.get("warc-target-uri"), None if go_on else h["warc-type"],
            h.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(h["x-payload-length"]), _plain(h.get("x-refers-to-id")),
            int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, None if several else digest.hexdigest(), size, b"".join(body) if several else None,
        )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in FIELDS.split(", "))])
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for row in _parsed(memoryview(content.as_buffer())):
                rows.append(row)
                held += row[10] if row[11] is not None else 200
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def segment_rows(spark: SparkSession, path: str) -> DataFrame:
    """The archives of a folder as rows of record and segment."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, FIELDS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by record and segment: each record's digest and length, carried from row to row."""
    state: dict | None = None

    def done(s: dict) -> tuple:
        if s["total"] is None and s["next"] > 2 or s["first"] is None:
            raise ValueError(f"record {s['record']} lacks segments")
        found = s["sha1"] or s["hash"].hexdigest()
        if s["first"][1] == "response" and (found != s["first"][2] or s["size"] != s["first"][3]):
            raise ValueError(f"record {s['record']} differs from its digest or length")
        return (s["record"], *s["first"])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [("record", pa.string()), ("id", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("refers", pa.string()), ("url", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    for batch in batches:
        out = []
        names = ("record", "segment", "id", "url", "type", "digest", "bytes", "refers", "total", "sha1", "size")
        columns = [batch.column(n).to_pylist() for n in names]
        bodies = batch.column("body")
        for k, (record, segment, id_, url, kind, digest, size, refers, total, sha1, held) in enumerate(zip(*columns, strict=True)):
            if state is None or state["record"] != record:
                if state is not None:
                    out.append(done(state))
                state = {"record": record, "next": 1, "hash": hashlib.sha1(), "size": 0, "first": None, "total": None, "sha1": sha1}
            if segment != state["next"]:
                raise ValueError(f"record {record} lacks segment {state['next']}")
            if segment == 1:
                state["first"] = (id_, kind, digest, size, refers, url)
            state["next"] += 1
            state["size"] += held
            state["total"] = total
            if bodies[k].is_valid:
                state["hash"].update(memoryview(bodies[k].as_buffer()))
        if out:
            # (record, id, type, digest, bytes, refers, url)
            yield batch_of(out)
    if state is not None:
        yield batch_of([done(state)])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record, id string, type, digest, bytes, refers string, url): every record, its payload checked."""
    rows = segment_rows(spark, path).repartition("record").sortWithinPartitions("record", "segment")
    return rows.mapInArrow(_joined, "record string, id string, type string, digest string, bytes long, refers string, url string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes archives to the shared folder and reads them back."""
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archives")
    write_archives(pages, path, id_col, url_col, payload_col)
    kind = pages.schema[id_col].dataType
    return read_archives(spark, path).withColumns({"id": F.col("id").cast(kind), "refers": F.col("refers").cast(kind)})
