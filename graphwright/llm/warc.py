"""Operator 3: WARC archives through a chunked record table.

A record is a row of headers followed by one row for each chunk of its payload, in order; the
rows are written by Spark's text writer with CRLF between them, so the files are plain gzipped
WARC/1.1 whose HTTP bodies use chunked transfer coding, in any file system that Spark reaches and
under its commit protocol (a lost executor's half file never counts). Reading back streams the
same rows; the digest state is carried from chunk to chunk. No Python worker holds a record whole:
the writer gets it a chunk at a time. A page is one value of its table, so Spark itself holds each
page while it is read, hashed and cut.

Defined results: a null payload is empty; rows that repeat the winning page_id and payload are all
responses; a null page_id is below every other and keeps null; a page's other columns are ignored;
no rows give no rows. CR, LF or spaces in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small_batches, text_or_empty

#: Code points of a payload chunk, so at most 1 MiB.
CHUNK = 262_144
#: Payload chunks of one output batch, in bytes and rows.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 2_000
DATE = "2000-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
CHUNK_SCHEMA = "page_id long, record_type string, refers_to long, chunk_no long, chunk_bytes long, running_bytes long, running_digest string, is_last boolean, data binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def head_rows(page_id: int | None, url: str | None, digest: str, n_bytes: int, refers_to: int | None, revisit: bool, body: int) -> Iterator[str]:
    """The rows of one record before its payload; CRLF follows each of them in the file."""
    where = (url or "about:blank").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {where}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {n_bytes}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}", "Content-Length: 0"]
        yield "\r\n".join(head) + "\r\n"
    else:
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(HTTP) + body + 5}"]
        yield "\r\n".join(head) + "\r\n"
        yield HTTP[:-2]


def chunk_rows(records: DataFrame) -> DataFrame:
    """plan_records() with html as rows (chunk_no, chunk), in order; one row with null chunk where
    it is empty. body is the length of the coded chunks, n_chunks their number."""
    number = F.ceil(F.char_length("html") / CHUNK).cast("int")
    parts = F.when(number > 0, F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.substring("html", i * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<string>"))
    out = records.withColumn("parts", parts).drop("html")
    coded = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, c: acc + F.octet_length(c) + F.char_length(F.hex(F.octet_length(c).cast("long"))) + 4)
    out = out.withColumn("body", coded).withColumn("n_chunks", F.size("parts"))
    return out.select("page_id", "url", "digest", "n_bytes", "refers_to", "revisit", "body", "n_chunks", F.posexplode_outer("parts").alias("chunk_no", "chunk"))


def _write_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[str] = []
    size = 0
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "digest", "n_bytes", "refers_to", "revisit", "body", "n_chunks", "chunk_no", "chunk")]
        for i in range(batch.num_rows):
            page_id, url, digest, n_bytes, refers_to, revisit, body, n_chunks, chunk_no, chunk = (c[i].as_py() for c in columns)
            rows = [] if chunk_no else list(head_rows(page_id, url, base32(digest), n_bytes, refers_to, revisit, body))
            if chunk is not None:
                rows += [f"{len(chunk.encode()):x}", chunk]
            if (chunk_no or 0) + 1 >= n_chunks:
                rows += ["", ""] if revisit else ["0\r\n", "", ""]
            for row in rows:
                out.append(row)
                size += len(row)
                if size > BATCH_BYTES or len(out) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, n_bytes, refers_to, revisit). Only rows that revisit are looked
    up by digest, without payload; payloads are only matched by page and digest, which are not hot."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    rows = rows.select("*", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))
    slim = rows.where(F.col("n_bytes") >= least_bytes).select("page_id", "digest")
    winners = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = slim.join(winners, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    again = again.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    out = rows.join(again, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    revisit = F.col("r_digest").isNotNull()
    return out.select("page_id", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), "digest", "n_bytes", "refers_to", revisit.alias("revisit"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    rows = chunk_rows(plan_records(pages, least_bytes)).mapInArrow(_write_rows, "value string")
    with small_batches(pages.sparkSession):
        rows.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class _Reader:
    """Parses the rows of one file; feed() takes a row, chunks come out as tuples."""

    def __init__(self) -> None:
        self.state, self.head, self.need = "version", {}, 0

    def feed(self, row: bytes) -> tuple | None:
        if self.state == "version":
            if row:
                if not row.startswith(b"WARC/1."):
                    raise ValueError(f"not a WARC record: {row[:40]!r}")
                self.head, self.state = {}, "head"
        elif self.state == "head":
            if row:
                name, _, value = row.decode().partition(":")
                self.head[name.lower()] = value.strip()
            elif self.head["warc-type"] == "revisit":
                self.state = "version"
                return self._chunk(0, 0, int(self.head["warc-payload-length"]), self.head["warc-payload-digest"].removeprefix("sha1:"), True, b"")
            else:
                self.state, self.sha, self.total, self.number = "http", hashlib.sha1(), 0, 0
        elif self.state == "http":
            if not row:
                self.state = "size"
        elif self.state == "size":
            self.need, self.parts, self.got = int(row, 16), [], 0
            self.state = "data" if self.need else "end"
            self.held = None
        elif self.state == "data":
            self.parts += [row] if not self.parts else [b"\r\n", row]
            self.got += len(row) + 2 * (len(self.parts) > 1)
            if self.got > self.need:
                raise ValueError("a chunk is longer than its size")
            if self.got == self.need:
                data = b"".join(self.parts)
                self.sha.update(data)
                self.total, self.number, self.state = self.total + len(data), self.number + 1, "size"
                return self._chunk(self.number - 1, len(data), self.total, self._digest(), False, data)
        elif self.state == "end":
            self.state = "version"
            if (digest := self._digest()) != self.head["warc-payload-digest"].removeprefix("sha1:") or self.total != int(self.head["warc-payload-length"]):
                raise ValueError(f"payload digest differs: {self.head['warc-record-id']}")
            return self._chunk(self.number, 0, self.total, digest, True, b"")
        return None

    def _digest(self) -> str:
        return base64.b32encode(self.sha.copy().digest()).decode()

    def _chunk(self, number: int, n: int, total: int, digest: str, last: bool, data: bytes) -> tuple:
        page, refers = self.head.get("warc-page-id"), self.head.get("warc-refers-to-page-id")
        return (None if page is None else int(page), self.head["warc-type"], None if refers in (None, "None") else int(refers), number, n, total, digest, last, data)


_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk_bytes", pa.int64()), ("running_bytes", pa.int64()), ("running_digest", pa.string()), ("is_last", pa.bool_()), ("data", pa.binary())])


def _read_rows(with_data: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file, out, size = _Reader(), None, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        for batch in batches:
            files = batch.column("file")
            for i, row in enumerate(batch.column("value")):
                if (now := files[i].as_py()) != file:
                    if reader.state not in ("version",):
                        raise ValueError(f"{file} ends inside a record")
                    reader, file = _Reader(), now
                if chunk := reader.feed(row.as_py().encode()):
                    out.append(chunk if with_data else (*chunk[:8], None))
                    size += len(chunk[8]) * with_data
                    if len(out) >= BATCH_ROWS or size > BATCH_BYTES:
                        yield flush()
                        out, size = [], 0
        if out:
            yield flush()

    return read


def read_warc(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunked record table: one row a chunk with the digest so far, and a last row a record."""
    rows = spark.read.option("lineSep", "\r\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return rows.mapInArrow(_read_rows(with_data), CHUNK_SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: writes all pages and reads the archives back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch(spark, "warc")
    write_warc(pages, path)
    ends = read_warc(spark, path, with_data=False).where("is_last")
    return ends.select("page_id", F.col("running_bytes").alias("payload_bytes"), F.col("running_digest").alias("payload_digest"), "record_type", "refers_to")


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as h, max(page_id) over (partition by html) as last from p)
select page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, i::int * 5 + 1, 5))::int) >> s) & 31) + 1, 1)), '')), '') as payload_digest,
       case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to
from d
"""
