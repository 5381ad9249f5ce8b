"""WARC archives: a writer with revisit records, and a splittable reader (operator 9).

Each record is a gzip member of its own. The reader deals out byte ranges; a task looks for gzip
magic in its range, tries each find by decoding the member's first bytes, which must be a WARC
header, and owns the records that start inside the range, whose ends it reads beyond it.
Archives lie in the shared folder and are opened with ``pyarrow.fs`` (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import urllib.parse
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import new_path, read_table, staged

MAGIC, DATE = b"\x1f\x8b\x08", "2024-01-01T00:00:00Z"
#: Bytes: an archive is closed after so many; a reading task's range; a read; what a header may take, compressed.
ARCHIVE, RANGE, READ, HEADER = 512 << 20, 32 << 20, 4 << 20, 1 << 16
_URN = "<urn:page:"


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One gzip member: a response, or a revisit (headers only) where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_URN}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"  # an attempt never writes another's file
        out, files, size, count = None, [], 0, 0

        def close() -> None:
            nonlocal out, size, count
            if out is not None:
                out.close()
                files.append((f"{folder}/{name}-{len(files)}.warc.gz", size, count))
            out, size, count = None, 0, 0

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}-{len(files)}.warc.gz", compression=None)
                payload = (html or "").encode()
                member = record(page_id, url, payload, refers_to, bare_digest(payload))
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ARCHIVE:
                    close()
        close()
        columns = list(zip(*files, strict=True)) if files else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "size", "records"])

    return run


def write_warc(pages: DataFrame, folder: str | None = None, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row; the table (path, size, records) of the archives that count.

    Of rows with equal payloads of ``least`` bytes or more, those of the smallest id become
    responses, the others revisits of it; null payloads are empty. Rows with null ids become
    revisits where the payload has an id elsewhere, else responses; rows that repeat in full are
    all responses, as the smallest id has no smaller one. Payloads may have any length (a record
    is held whole); an empty table gives no archives; other columns are ignored. Only files named
    in the result are part of the archive: a lost attempt leaves files that nothing names.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    key = F.when(F.octet_length("html") >= least, F.sha1(F.encode("html", "UTF-8")))
    rows = rows.withColumn("sha", key)
    first = staged(rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND sha IS NOT NULL").select("sha", "first"), "firsts")  # written, so that the join can split a hot payload
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    made = rows.join(first, "sha", "left").select("page_id", "url", "html", refers_to.alias("refers_to"))
    return staged(made.mapInArrow(_writer(folder), "path string, size bigint, records bigint"), "archives")


class Window:
    """Bytes of a file by position, read ahead in pieces."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        self.size, self.at, self.held = self.file.size(), 0, b""

    def get(self, start: int, n: int) -> bytes:
        """At most n bytes from ``start``, fewer only at the end."""
        n = min(n, self.size - start)
        if n <= 0:
            return b""
        if start < self.at or start + n > self.at + len(self.held):
            self.at, self.held = start, self.file.read_at(min(max(n, READ), self.size - start), start)
        return self.held[start - self.at : start - self.at + n]


def _member(file: Window, start: int) -> tuple[bytes, int] | None:
    """The unpacked member at ``start`` and where it ends; None if there is no WARC record."""
    head = zlib.decompressobj(31)
    try:
        if not head.decompress(file.get(start, HEADER), 8).startswith(b"WARC/1."):
            return None
        unpack, parts, at = zlib.decompressobj(31), [], start
        while not unpack.eof:
            piece = file.get(at, 1 << 18)
            if not piece:
                return None
            parts.append(unpack.decompress(piece))
            at += len(piece)
        return b"".join(parts), at - len(unpack.unused_data)
    except zlib.error:
        return None


def _parsed(member: bytes) -> tuple | None:
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)

    def page(value: str | None) -> int | None:
        m = re.fullmatch(re.escape(_URN) + r"(-?\d+)>", value or "")
        return int(m[1]) if m else None

    revisit = fields["warc-type"] == "revisit"
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else bare_digest(payload)
    size = int(length[1]) if revisit and length else len(payload)
    url = fields.get("warc-target-uri")
    return page(fields.get("warc-record-id")), url, fields["warc-type"], digest, size, page(fields.get("warc-refers-to")), None if revisit else payload


def _reader(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload", "path", "position"]

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, at = Window(path), start
                while at < end:
                    here = file.get(at, READ)
                    hit = here.find(MAGIC)
                    if hit < 0:
                        at += max(1, len(here) - len(MAGIC) + 1)
                        continue
                    at += hit
                    if at >= end:
                        break
                    member = _member(file, at)
                    found = _parsed(member[0]) if member else None
                    if found is None:
                        at += 1
                        continue
                    out.append((*found[:6], found[6] if payloads else None, path, at))
                    size += len(found[6] or b"") if payloads else 0
                    at = member[1]
                    if len(out) >= 5000 or size >= 32 << 20:
                        yield made(out)
                        out, size = [], 0
        yield made(out)

    return run


def read_warc(archives: DataFrame, payloads: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """Records of the archives (path, size): page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload, path, position.

    The digest of a response is that of its payload as read; a revisit's digest and size are
    those that it states. What is no WARC record is skipped, a record cut off at a file's end too.
    Empty files and an empty table give no rows; a null size is a file that is not read.
    """
    total = archives.agg(F.sum("size")).first()[0] or 0
    ranges = archives.filter("size > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes))).alias("start"), "size").select("path", "start", F.least("size", F.col("start") + range_bytes).alias("end"))
    tasks = max(1, min(100_000, math.ceil(total / range_bytes)), min(2 * archives.sparkSession.sparkContext.defaultParallelism, math.ceil(total / (1 << 20))))
    return ranges.repartition(tasks).mapInArrow(_reader(payloads), "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary, path string, position bigint")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(read_table(spark, sf_dir, "pages"))
    return read_warc(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
