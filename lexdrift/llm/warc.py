"""WARC archives with revisit resolution (operator 7).

Only headers (id, digest, length) are shuffled by payload digest; the few
digests that repeat are joined back to the headers, and one payload shuffle by
record brings each payload to the task that writes it. Archives follow WARC/1.1
with one gzip member a record. A revisit record holds the HTTP header of its
response, thus the full payload's length, but no payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.llm.common import file_system, handed_back, materialize, partitions_for, tune

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:x-page:"

MANIFEST = "path string, n_records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_FIELDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def resolve(headers: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(key, digest, original) of records whose payload another record has too.

    ``headers``: key, page_id, digest, payload_bytes. The largest page_id of a
    digest is the original; payloads under ``least_bytes`` stay out. The count
    is combined before its shuffle and written: the join that follows then has
    shuffles of its own on both sides, which Spark can split where a digest is
    hot, and carries headers only.
    """
    large = headers.where(F.col("payload_bytes") >= least_bytes)
    repeated = large.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and original is not null")
    repeated = materialize(repeated.select("digest", "original"), "digests")
    return large.select("key", "digest").join(repeated, "digest").distinct()


def write_archives(pages: DataFrame, out_dir: str, least_bytes: int = 1000, id_column: str = "page_id", url_column: str = "url", body_column: str = "html", date: str | None = None) -> DataFrame:
    """Write one record a row below ``out_dir`` and return the manifest, one row an archive.

    Of rows with equal payloads of ``least_bytes`` or more, one with the largest
    id becomes the response and the others revisit it; where that id repeats
    with the payload, one of its rows is the response. Rows with a null id can
    revisit but not be revisited: where all are null, all are responses. A null
    payload is the empty one. A null url gives about:blank. An empty table
    gives no archive. Other columns are ignored. Files are named by attempt,
    and only those in the manifest count.
    """
    spark = pages.sparkSession
    tune(spark)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    fs, root = file_system(out_dir)
    fs.create_dir(root, recursive=True)
    body = F.coalesce(F.col(body_column), F.lit("")).cast("binary")
    ident = F.col(id_column).cast("long")
    rows = pages.select(ident.alias("page_id"), F.col(url_column).cast("string").alias("url"), body.alias("body")).withColumns({"key": F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest": F.sha1("body")})
    headers = pages.select(ident.alias("page_id"), body.alias("body")).select("page_id", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key"), F.sha1("body").alias("digest"), F.octet_length("body").alias("payload_bytes"))
    decided = resolve(materialize(headers, "headers"), least_bytes)
    placed = rows.repartition(partitions_for(pages), "key", "digest").join(decided, ["key", "digest"], "left").sortWithinPartitions("key", "digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, before, ordinal = None, "", 0, None, 0
        for batch in batches:
            if out is None:
                fs, root = file_system(out_dir)
                fs.create_dir(root, recursive=True)
                name = f"archive-{uuid.uuid4().hex}.warc.gz"
                path, out = f"{out_dir}/{name}", fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(packed(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: lexdrift\r\nformat: WARC file version 1.1\r\n")))
            made = []
            for page_id, url, body, digest, original in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body", "digest", "original")), strict=True):
                ordinal = ordinal + 1 if before == (page_id, digest) else 0
                before = (page_id, digest)
                refers = None if original is None or (original == page_id and ordinal == 0) else original
                made.append(packed(page_record(page_id, ordinal, url, body, digest, refers, date)))
            n += len(made)
            out.write(b"".join(made))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

    return materialize(placed.mapInArrow(handed_back(write), MANIFEST), "archives")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    machine = zlib.compressobj(3, zlib.DEFLATED, 31)
    return machine.compress(data) + machine.flush()


def page_record(page_id: int | None, ordinal: int, url: str | None, body: bytes, digest: str, refers: int | None, date: str) -> bytes:
    """A response record, or where ``refers`` is given a revisit record of that page's response."""
    name = "" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    target = "about:blank" if url is None else "".join(c if "!" <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url) if not url.isascii() or any(not "!" <= c < "\x7f" for c in url) else url
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    headers = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<{RECORD_URN}{name}:{ordinal}>"), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Payload-Digest", sha1), ("Content-Type", "application/http; msgtype=response")]
    if refers is None:
        return record(headers, http + body)
    return record([*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD_URN}{refers}:0>"), ("WARC-Refers-To-Date", date)], http)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        yield headers, stream.read(int(headers["content-length"]))


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix(RECORD_URN).partition(":")[0]
    return int(name) if name else None


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("latin-1").partition(":") for x in head.split(b"\r\n")[1:])}, body


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row a response or revisit record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken from its payload, which must
    agree with its header; those of a revisit stand in its headers. Archives
    are streamed.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, where = file_system(path)
                rows: list[tuple] = []
                with fs.open_input_stream(where, compression=None) as f, io.BufferedReader(gzip.GzipFile(fileobj=f)) as stream:
                    for headers, block in records(stream):
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, body = http_parts(block)
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = int(http["content-length"])
                        if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError(f"{path}: payload of {headers['warc-record-id']} does not agree with its headers")
                        rows.append((page_of(headers["warc-record-id"]), size, digest, kind, page_of(headers["warc-refers-to"]) if kind == "revisit" else None))
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD_FIELDS)], schema=RECORD_FIELDS)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD_FIELDS)], schema=RECORD_FIELDS)

    return manifest.select("path").repartition(partitions_for(manifest)).mapInArrow(read, RECORDS)


def manifest_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A manifest of archives that others wrote."""
    return spark.createDataFrame([(p, None) for p in paths], MANIFEST)
