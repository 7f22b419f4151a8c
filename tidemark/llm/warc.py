"""WARC archives: a record per page in a gzip member of its own, and a sequential reader.

The writer streams records into archives in the shared folder; a manifest table names the archives
of committed tasks only, so a retried task leaves no record twice. The reader takes an archive from
its start: one decompressor per member, fed by bounded reads, header lines up to the empty line, then
exactly Content-Length bytes, then the digests. Payload bytes are digested as they come.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import file_system, fresh_path

ARCHIVE_BYTES = 256 << 20
#: Archives are read by at most so many tasks.
MOST_TASKS = 200_000
READ_BYTES = 1 << 16
#: Payloads below this size are never written as revisits.
REVISIT_BYTES = 1000
#: The profile that the WARC 1.1 standard names for revisits with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "block_digest string, digests_verified boolean, archive string, archive_offset long")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    named = "".join(c for c in (uri or "") if c > " " and c != "\x7f")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {named}", "Content-Type: application/http;msgtype=response",
             f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


class DamagedArchive(ValueError):
    """An archive that breaks framing, or whose bytes do not give the digests it states."""


class _Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, source: BinaryIO, rest: bytes):
        self.source, self.raw, self.out = source, rest, bytearray()
        self.gz = zlib.decompressobj(31)
        self.used = 0

    def more(self) -> bool:
        """Decompress another piece; False at the member's end."""
        if self.gz.eof:
            return False
        raw = self.gz.unconsumed_tail or self.raw or self.source.read(READ_BYTES)
        if not raw:
            raise DamagedArchive("archive ends inside a member")
        fresh = not self.gz.unconsumed_tail
        if fresh:
            self.used += len(raw)
        self.raw = b""
        self.out += self.gz.decompress(raw, READ_BYTES)
        if self.gz.eof:
            self.raw = self.gz.unused_data
            self.used -= len(self.raw)
        return True

    def line(self) -> str:
        while (at := self.out.find(b"\r\n")) < 0:
            if not self.more():
                raise DamagedArchive("header without end")
        got = bytes(self.out[:at])
        del self.out[:at + 2]
        return got.decode("utf-8", "replace")

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes, in pieces."""
        while n:
            if not self.out and not self.more():
                raise DamagedArchive("content is shorter than its length")
            got = bytes(self.out[:n])
            del self.out[:n]
            n -= len(got)
            if got:
                yield got


def read_records(source: BinaryIO, archive: str = "") -> Iterator[tuple]:
    """Records of an archive in order, as tuples of RECORD's columns; memory stays at a few reads."""
    offset, rest = 0, b""
    while True:
        rest = rest or source.read(READ_BYTES)
        if not rest:
            return
        m = _Member(source, rest)
        if m.line() != "WARC/1.1":
            raise DamagedArchive(f"no WARC record at {offset}")
        head = {}
        while line := m.line():
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        block, payload = hashlib.sha1(), hashlib.sha1()
        seen, stated, start = bytearray(), None, None
        for piece in m.take(int(head["content-length"])):
            block.update(piece)
            if start is None:
                seen += piece
                if (at := seen.find(b"\r\n\r\n")) >= 0:
                    start = at + 4
                    for line in seen[:at].decode("latin-1").split("\r\n"):
                        if line.lower().startswith("content-length:"):
                            stated = int(line.split(":", 1)[1])
                    payload.update(seen[start:])
                    size = len(seen) - start
            else:
                payload.update(piece)
                size += len(piece)
        if b"".join(m.take(4)) != b"\r\n\r\n":
            raise DamagedArchive(f"record at {offset} does not end with two line ends")
        while m.more():
            pass
        if m.out or start is None:
            raise DamagedArchive(f"record at {offset} is framed wrongly")
        kind = head["warc-type"]
        good = head["warc-block-digest"] == "sha1:" + base64.b32encode(block.digest()).decode()
        if kind == "response":
            good &= size == stated and head["warc-payload-digest"] == "sha1:" + base64.b32encode(payload.digest()).decode()
        if not good:
            raise DamagedArchive(f"digest or length of the record at {offset} is wrong")
        number = lambda urn: None if urn is None or urn.endswith(":none>") else int(urn[len("<urn:page:"):-1])
        yield (number(head["warc-record-id"]), head["warc-target-uri"], kind, number(head.get("warc-refers-to")), stated,
               base64.b32decode(head["warc-payload-digest"][5:]).hex(), block.hexdigest(), good, archive, offset)
        offset += m.used
        rest = m.raw


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), refers_to, revisit. The largest id of equal payloads responds.

    Only digests, sizes and ids are aggregated (partial maxima before the shuffle); a hot payload's rows
    are split by Spark's skew join. Short payloads get a key of their own, so they never meet."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    one = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    size = F.octet_length("html")
    one = one.withColumn("same", F.when(size >= REVISIT_BYTES, F.concat_ws(":", F.sha2("html", 256), size))
                         .otherwise(F.concat(F.lit("short:"), F.xxhash64("page_id", "url"))))
    last = one.groupBy("same").agg(F.max("page_id").alias("last"), F.max(size).alias("size"))
    refers = F.when((F.col("size") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return one.join(last, "same").select("page_id", "url", "html", refers.alias("refers_to"), refers.isNotNull().alias("revisit"))


def write_archives(marked: DataFrame, path: str) -> DataFrame:
    """Write the records of `mark_revisits` under `path`; the manifest of archives: archive, records, bytes."""

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(path)
        fs.create_dir(top, recursive=True)
        sink, name, n = None, "", 0

        def close() -> pa.RecordBatch:
            size = sink.tell()
            sink.close()
            return pa.record_batch([[name], pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for batch in it:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if sink is None:
                    name, n = f"{top}/{uuid.uuid4().hex}.warc.gz", 0
                    sink = fs.open_output_stream(name, compression=None)  # the records are members already
                sink.write(record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"], r["revisit"]))
                n += 1
                if sink.tell() >= ARCHIVE_BYTES:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    spark = marked.sparkSession
    marked.mapInArrow(write, "archive string, records long, bytes long").write.parquet(path + "/manifest")
    return spark.read.parquet(path + "/manifest")


def read_archives(manifest: DataFrame, path: str) -> DataFrame:
    """Every record of the manifest's archives, with verified digests; a damaged archive raises."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(path)
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in it:
            for name in batch.column("archive").to_pylist():
                with fs.open_input_stream(name, compression=None) as source:
                    rows: list[tuple] = []
                    for row in read_records(source, name.rsplit("/", 1)[-1]):
                        rows.append(row)
                        if len(rows) == 4096:
                            yield _rows(rows, names)
                            rows = []
                    if rows:
                        yield _rows(rows, names)

    # A task an archive: without a number small partitions would be merged into one.
    return manifest.repartition(max(1, min(manifest.count(), MOST_TASKS)), "archive").mapInArrow(read, RECORD)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "digests_verified": pa.bool_(), "archive_offset": pa.int64()}
    return pa.record_batch([pa.array(c, kinds.get(n, pa.string())) for c, n in zip(zip(*rows), names)], names)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write `pages` (page_id, url, html) to archives in the shared folder and read them back.

    Returns RECORD's columns, a row per page. Null html is an empty payload; a null page_id is a record
    without number, which never answers for others unless all equals lack one; rows with one id and one
    payload are all responses if that id is the largest; no pages give no archives and no rows; other
    columns are ignored; line ends and blanks are cut from URIs.
    """
    path = fresh_path(spark, "warc")
    return read_archives(write_archives(mark_revisits(pages), path), path)
