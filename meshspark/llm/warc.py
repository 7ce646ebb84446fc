"""Deduplicated WARC archives: revisit records stand for payloads that another record carries.

Headers alone (id, address, payload digest and size) are shuffled by digest; the smallest id of each
digest of at least MIN_PAYLOAD bytes is the original.  Revisits join their original by digest, and
the verdicts join the pages by id and digest, so payloads move once, by a key without hot values.
Each task writes archives of its own, one gzip member per record, with fresh headers: a response
carries its payload, a revisit the address and record id of its original.  Only files in the
manifest count; a repeated attempt of a task writes others.

A null payload is an empty one.  Payloads under MIN_PAYLOAD bytes are always responses.  Rows that
tie for the smallest id with equal payloads are responses alike.  A null id is never an original as
long as another row has one; equal payloads under null ids only are all responses.

An empty table gives no archives and no rows.  Columns other than page_id, url and html are not read.  A payload of any
length is one record of one task.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import open_store
from .shared import materialise, new_folder, small_batches

MIN_PAYLOAD = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def headers(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))


def resolve_revisits(heads: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to, refers_url) of each id and payload that is a revisit."""
    large = heads.where(F.col("n_bytes") >= MIN_PAYLOAD)
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = large.groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    firsts = firsts.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    found = large.select("page_id", "digest").join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "digest", "refers_to", "refers_url").distinct()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:sha256:{digest}>"


def _line(text: str | None) -> str:
    return " ".join((text or "").split())


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Target-URI", _line(refers_url))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def members(f, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    data = f.read(size)
    while data:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                raise ValueError("the archive ends within a record")
            out.append(z.decompress(data))
            data = z.unused_data if z.eof else f.read(size)
        yield b"".join(out)
        data = data or f.read(size)


def write_archives(pages: DataFrame, folder: str, file_bytes: int = 64 << 20) -> DataFrame:
    """Write each page (page_id, url, html) as a response or a revisit; returns the manifest."""
    small_batches(pages.sparkSession)
    verdicts = resolve_revisits(headers(pages))
    body = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("digest"))
    keys = full["page_id"].eqNullSafe(verdicts["page_id"]) & (full["digest"] == verdicts["digest"])
    rows = full.join(verdicts, keys, "left").select(full["page_id"], "url", "html", full["digest"], "refers_to", "refers_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        store.create_dir(top, recursive=True)
        done, f, n, size, name = [], None, 0, 0, ""
        for b in batches:
            for k in range(b.num_rows):
                page_id, url, html, digest, refers_to, refers_url = (c[k].as_py() for c in b.columns)
                if f is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    f = store.open_output_stream(f"{top}/{name}", compression=None)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = z.compress(format_record(page_id, url, html.encode(), digest, refers_to, refers_url)) + z.flush()
                f.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    f.close()
                    done.append((name, n, size))
                    f, n, size = None, 0, 0
        if f is not None:
            f.close()
            done.append((name, n, size))
        cols = list(zip(*done, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "n_records", "n_bytes"])

    return materialise(rows.mapInArrow(write, MANIFEST), "archives")


def _page(record: str) -> int | None:
    x = record.split(":")[2]
    return int(x) if x else None


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """RECORDS of the archives; digests of responses are computed from what was read."""
    files = manifest.select("file").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        for b in batches:
            for file in b.column(0).to_pylist():
                with store.open_input_stream(f"{top}/{file}", compression=None) as f:
                    rows = []
                    for data in members(f):
                        fields, http, payload = parse_record(data)
                        first = fields["WARC-Type"] == "response"
                        declared = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        digest = hashlib.sha256(payload).hexdigest() if first else declared
                        if digest != declared:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                        rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Record-ID"], len(payload) if first else int(http["Content-Length"]), digest, fields["WARC-Type"], None if first else _page(fields["WARC-Refers-To"])))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(read, RECORDS)


def deduplicated(pages: DataFrame) -> DataFrame:
    """Write the archives and read them back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    return read_archives(spark, folder, write_archives(pages, folder))
