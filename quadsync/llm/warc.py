"""Operator 5: WARC archives, written and read back by a splittable reader.

Each task writes one archive of gzip members, one record each.  Payloads that
occur once, and the smallest page id of those that occur more often, are
``response`` records; the others are ``revisit`` records with the payload's
digest and length and the response they refer to.  Only the archives that the
stored list names count, so a task that ran twice leaves no trace.

The reader cuts archives into byte ranges.  A task scans its range for gzip's
magic, takes a place for a member only if it decodes to a WARC header, reads
the record (beyond the range's end if need be) and goes on behind it; it owns
the records that start inside its range.  Digest and length of every response
are taken anew from its payload and must equal its headers.

Cases: a null html is an empty payload; among rows with equal payload and the
same smallest page id all are responses; a null page id is never referred to,
and without any other id in the group it is a response; an id that comes twice
gives two records of one name; a null url is an empty target.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadsync.llm.shared import fresh_dir, store, table
from quadsync.session import ship_package

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_PAYLOAD = 0
NAME = "urn:quadsync:page:"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<{NAME}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
              ("WARC-Target-URI", quote(url or "", safe="/:?#[]@!$&'()*+,;=%~")), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{NAME}{refers_to}>")]
    return member(fields, http if is_revisit else http + payload)


def write_archives(folder: str) -> Callable:
    """(page_id, url, html, refers_to, is_revisit) -> (path, bytes): one archive a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, base = open_fs(folder)
        files.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        size = 0
        with files.open_output_stream(name, compression=None) as out:
            info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:quadsync:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            size += out.write(info)
            for b in batches:
                for page_id, url, html, refers, again in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    size += out.write(page_record(page_id, url, html or b"", refers, again))
        yield pa.record_batch([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([size], pa.int64())], names=["path", "bytes"])
    return run


class Range:
    """Bytes of a file from a position on, read forward as needed."""

    def __init__(self, f, start: int, end: int):
        self.f, self.end, self.at, self.buf = f, end, start, b""
        f.seek(start)

    def more(self) -> bool:
        got = self.f.read(READ_BYTES)
        self.buf += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.buf, self.at = self.buf[n:], self.at + n

    def magic(self) -> bool:
        """Go to the next magic that starts before the end of the range."""
        while self.at < self.end:
            i = self.buf.find(MAGIC)
            if i >= 0:
                self.skip(i)
                return self.at < self.end
            self.skip(max(0, len(self.buf) - len(MAGIC) + 1))
            if not self.more():
                return False
        return False

    def record(self) -> tuple[dict[str, str], bytes] | None:
        """The record of the member that starts here, and on behind it; None if none does."""
        z, out, used, head = zlib.decompressobj(31), [], 0, None
        total = 0
        while not z.eof:
            if used == len(self.buf) and not self.more():
                return None
            try:
                got = z.decompress(self.buf[used:used + READ_BYTES])
            except zlib.error:
                return None
            used = min(len(self.buf), used + READ_BYTES) - len(z.unused_data)
            out.append(got)
            total += len(got)
            if head is None and (total >= 7 or z.eof):
                first = b"".join(out)
                if not first.startswith(b"WARC/1."):
                    return None
                head = True
        data = b"".join(out)
        top, blank, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.partition(": ")[::2] for line in top.decode("utf-8", "replace").split("\r\n")[1:])
        if not blank or not fields.get("Content-Length", "").isdigit() or len(rest) != int(fields["Content-Length"]) + 4:
            return None
        self.skip(used)
        return fields, rest[:-4]


def read_range(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive that start in [start, end)."""
    files, name = open_fs(path)
    with files.open_input_file(name) as f:
        r = Range(f, start, end)
        while r.magic():
            got = r.record()
            if got is None:
                r.skip(1)
            else:
                yield got


def page_of(name: str) -> int | None:
    n = name.strip("<>").removeprefix(NAME)
    return int(n) if n else None


def read_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for ranges in frames:
        for path, start, end in zip(ranges["path"], ranges["start"], ranges["end"], strict=True):
            rows = []
            for fields, block in read_range(path, int(start), int(end)):
                kind = fields["WARC-Type"]
                if kind not in ("response", "revisit"):
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(dict(x.partition(": ")[::2] for x in http.decode().split("\r\n")[1:])["Content-Length"])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} is not what its header says")
                rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind, page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None))
            out = pd.DataFrame(rows, columns=cols)
            yield out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def write_warc(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """pages (page_id, url, html) -> the stored list (path, bytes) of the archives written."""
    ship_package(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("html"))
    p = p.withColumn("sum", F.sha1("html"))
    again = (p.where(F.octet_length("html") >= min_payload).groupBy("sum").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
             .where("n > 1").select(F.col("sum").alias("of"), "first"))
    again = store(again, "warc-equal")
    is_revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = (p.join(again, F.col("sum") == F.col("of"), "left")
           .select("page_id", "url", "html", F.when(is_revisit, F.col("first")).alias("refers_to"), is_revisit.alias("is_revisit")))
    return store(out.mapInArrow(write_archives(folder), "path string, bytes long"), "warc-list")


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, bytes) -> (page_id, url, payload_bytes, payload_digest, record_type, refers_to)."""
    ship_package(archives.sparkSession)
    ranges = (archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
              .select("path", "start", F.least(F.col("bytes"), F.col("start") + split_bytes).alias("end")))
    n = int(archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1)
    return ranges.repartition(n).mapInPandas(read_pages, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark, sf_dir):
    archives = write_warc(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (
  SELECT *, [('0x' || substr(h, (5 * i + 1)::INT, 5))::INT FOR i IN range(0, 8)] AS v FROM s)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32768) % 32 + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 1024) % 32 + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32) % 32 + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1) FOR x IN v], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
