"""WARC archives: a writer with payload revisits and a splittable reader.

Archives are gzip files with one member per record.  The reader's tasks get byte ranges, not
files: a task looks for gzip magic in its range, takes a candidate for a record start only when
the member decodes to a WARC header, and owns the records that start inside its range, reading
past the range's end to finish the last one.  Any range size gives the same records, and a
damaged stretch costs only the records it touches.

Writer: of records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest page
id is written as response, the others as revisits that name it; smaller payloads are always
responses.  Each task writes files of its own (the name has a random part, so a repeated task never
collides) and reports them; only reported files of finished tasks are ever read.

Files go through ``pyarrow.fs``, in the folder given or in the shared checkpoint folder.

Defined results: null html is an empty payload, a null url is left out, control characters of a url
are percent-encoded; rows that repeat the largest page id are all responses; a null page id never
counts as the largest unless the whole group has none, and then all are responses; an empty table
gives no archives and no records; a very long payload is one record like any other; only the three
named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage, ensure_checkpoint_dir

REVISIT_BYTES = 1000
ROLL_BYTES = 256 * 1024 * 1024
SPLIT_BYTES = 64 * 1024 * 1024
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("path string, offset long, record_type string, page_id long, url string, payload_bytes long, "
           "payload_digest string, refers_to long, intact boolean, payload binary")


def open_fs(uri: str):
    """(filesystem, path) of a Hadoop-style or plain path."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, refers_to: null for a response, the response's page id for a revisit.

    Digest groups come from a partial aggregate over slim rows; pages meet them in a join whose
    hot partitions adaptive execution splits.  Pages too small to be revisits stay out of the join."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    large = F.octet_length("html") >= REVISIT_BYTES
    rest = rows.where(~large).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    rows = rows.where(large).withColumn("sha", F.sha1("html"))
    groups = rows.groupBy("sha").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(groups, "sha", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("keep")), F.lit(None)).otherwise(F.col("keep")).alias("refers_to"))
    return joined.unionByName(rest)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member."""
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return packer.compress(top.encode("utf-8", "surrogatepass")) + packer.compress(block + b"\r\n\r\n") + packer.flush()


def write_archives(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``with_revisits`` rows; returns the stored list of finished files: path, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out = name = None
        size = 0
        done: list[tuple[str, int]] = []
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    page_id, url, html, refers_to = (batch.column(c)[i].as_py() for c in range(4))
                    size += out.write(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
                    if size >= roll_bytes:
                        out.close()
                        out = None
                        done.append((name, size))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, size))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder.rstrip('/')}/{n}" for n, _ in done]), pa.array([s for _, s in done], pa.int64())], names=["path", "size"])

    return cut_lineage(records.mapInArrow(run, "path string, size long"))


class Ahead:
    """Sequential bytes of a file from a position on."""

    def __init__(self, file, at: int):
        self.file, self.buffer, self.at = file, b"", at  # ``at`` is the file position of buffer[0]
        file.seek(at)

    def fill(self) -> bool:
        more = self.file.read(CHUNK)
        self.buffer += more
        return bool(more)

    def skip(self, n: int) -> None:
        self.buffer, self.at = self.buffer[n:], self.at + n

    def find(self, what: bytes, before: int) -> int | None:
        """File position of the next ``what`` that starts below ``before``; bytes in front are dropped."""
        while True:
            k = self.buffer.find(what)
            if k >= 0:
                self.skip(k)
                return self.at if self.at < before else None
            self.skip(max(0, len(self.buffer) - len(what) + 1))
            if self.at >= before or not self.fill():
                return None


def decode_member(ahead: Ahead) -> tuple[dict[str, str], bytes, int] | None:
    """(header fields, content block, compressed length) of the member at the position, or None
    if it isn't one: the first decoded bytes must be a WARC header, then the rest is decoded."""
    unzip = zlib.decompressobj(31)
    out, used, top = bytearray(), 0, None
    while not unzip.eof:
        if used == len(ahead.buffer) and not ahead.fill():
            return None
        part = ahead.buffer[used:used + CHUNK]
        try:
            out += unzip.decompress(part)
        except zlib.error:
            return None
        used += len(part) - len(unzip.unused_data)
        if not b"WARC/1.".startswith(bytes(out[:7])):
            return None
        if top is None and (end := out.find(b"\r\n\r\n")) >= 0:
            lines = out[:end].decode("utf-8", "replace").split("\r\n")
            top = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            if "warc-type" not in top or not top.get("content-length", "").isdigit():
                return None
    if top is None:
        return None
    start = out.find(b"\r\n\r\n") + 4
    block = bytes(out[start:start + int(top["content-length"])])
    return (top, block, used) if len(block) == int(top["content-length"]) else None


def told_digest(value: str) -> str | None:
    """The SHA-1 that a payload digest header names, base32 or hex, as bare lower-case hex; None for anything else."""
    name, _, told = value.rpartition(":")
    if name.lower() not in ("", "sha1"):
        return None
    try:
        raw = bytes.fromhex(told) if len(told) == 40 else base64.b32decode(told.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def read_range(path: str, start: int, end: int) -> Iterator[tuple]:
    """RECORDS tuples of the records that start in [start, end)."""
    fs, base = open_fs(path)
    with fs.open_input_file(base) as file:
        ahead = Ahead(file, start)
        while (at := ahead.find(MAGIC, end)) is not None:
            got = decode_member(ahead)
            if got is None:
                ahead.skip(1)
                continue
            head, block, length = got
            ahead.skip(length)
            number = lambda k: int(head[k]) if head.get(k, "").lstrip("-").isdigit() else None
            top, _, payload = block.partition(b"\r\n\r\n")
            told = told_digest(head.get("warc-payload-digest", ""))
            if head["warc-type"] == "revisit":
                # The payload is elsewhere: its digest and length are those that the headers name, if they do.
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in top.split(b"\r\n")[1:])}
                length = fields.get(b"content-length", b"")
                size = int(length) if length.isdigit() else None
                digest, intact, payload = told, told is not None and size is not None, None
            else:
                digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                intact = digest == told
            yield (path, at, head["warc-type"], number("x-page-id"), head.get("warc-target-uri"), size, digest,
                   number("x-refers-to-page-id"), intact, payload)


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the files (path, size); see RECORDS.  ``payloads`` False leaves payloads out."""
    spark = files.sparkSession
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "size").alias("end"))
    n = max(1, ranges.count())
    # A bounded number of ranges per task, dealt out evenly.
    dealt = ranges.repartition(min(n, max(spark.sparkContext.defaultParallelism * 4, n // 16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in range(3))):
                rows, size = [], 0
                for r in read_range(path, start, end):
                    rows.append(r if payloads else (*r[:-1], None))
                    size += len(rows[-1][-1] or b"") + 200
                    if size > 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return dealt.mapInArrow(run, RECORDS)


def q_warc(spark, sf_dir) -> DataFrame:
    from quire.session import table

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quire-warc/{uuid.uuid4().hex}"
    files = write_archives(with_revisits(table(spark, sf_dir, "pages")), folder)
    read = read_archives(files, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT page_id, n, d, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS keep FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keep = page_id THEN NULL ELSE keep END AS refers_to
FROM g
"""
