"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A data file is a sequence of records, each framed as

    length     uint64, bytes of the payload
    check      uint32, masked crc32 of the length field
    payload    doc_id int64, null mark uint8, bytes of an id (2 or 4) uint8, the ids
    check      uint32, masked crc32 of the payload

all little-endian.  The mask rotates a checksum by 15 bits and adds a constant, so that a checksum
stored among data doesn't upset a checksum over them.  Beside each data file stands an index, one
entry of 24 bytes a record: byte offset, ids of this file before it, bytes.  With it a reader takes
any record by one seek (`read_record`).

Files follow each other in ascending doc_id order and so do their records; null doc_ids come
first, rows with equal doc_ids stand side by side in order of a hash of their texts, and a null text is an
empty one.  Every attempt of a task writes files of its own name; only those in the manifest, one
row per file, count, so lost executors and repeated attempts leave nothing wrong behind.

An empty table gives no files and no rows.  Columns other than doc_id and text are not read, whatever they are
called.  A text of any length is one record, encoded in one task.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise, new_folder, small_batches
from .tokens import Vocabulary

MANIFEST = "part long, file string, n_records long, n_ids long, n_bytes long"
INDEX_ENTRY = np.dtype([("at", "<u8"), ("start", "<u8"), ("size", "<u8")])
_MASK = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """(payload, where the next record starts); ValueError if a checksum is wrong."""
    size = bytes(data[at : at + 8])
    (n,), (c,) = struct.unpack("<Q", size), struct.unpack_from("<I", data, at + 8)
    if c != masked_crc(size):
        raise ValueError(f"length of the record at byte {at} is damaged")
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked_crc(payload):
        raise ValueError(f"record at byte {at} is damaged")
    return payload, at + 16 + n


def open_store(folder: str):
    """(file system, path) of a folder by its URI: local, HDFS or object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_records(docs: DataFrame, folder: str, vocabulary: Vocabulary, end_id: int = 1, file_bytes: int = 64 << 20) -> DataFrame:
    """Encode and write every text; returns the manifest (see MANIFEST), which is itself written to `folder`."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range cuts are drawn from ids and hashes, so no texts go to the driver.
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    kind = np.dtype(f"<u{vocabulary.id_bytes}")
    end = np.array([end_id], kind).tobytes()


    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), vocabulary.encoder()
        store, top = open_store(folder)
        store.create_dir(top, recursive=True)
        done, data, index, at, ids = [], None, [], 0, 0
        name, number = "", 0

        def close() -> None:
            nonlocal data, index, at, ids
            data.close()
            with store.open_output_stream(f"{top}/{name}.index") as f:
                f.write(np.array(index, INDEX_ENTRY).tobytes())
            done.append((part << 20 | number, name, len(index), ids, at))
            data, index, at, ids = None, [], 0, 0

        for b in batches:
            for doc_id, got in zip(b.column(0).to_pylist(), encoder.each(b.column(1)), strict=True):
                if data is None:
                    number = len(done)
                    name = f"part-{part:06d}-{number:05d}-{uuid.uuid4().hex}.rec"
                    data = store.open_output_stream(f"{top}/{name}")
                record = frame(struct.pack("<qBB", doc_id or 0, doc_id is None, kind.itemsize) + got.astype(kind).tobytes() + end)
                data.write(record)
                index.append((at, ids, len(record)))
                at, ids = at + len(record), ids + len(got) + 1
                if at >= file_bytes:
                    close()
        if data is not None:
            close()
        cols = list(zip(*done, strict=True)) or [[]] * 5
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["part", "file", "n_records", "n_ids", "n_bytes"])

    return materialise(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_record(store, top: str, file: str, k: int) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of the k-th record of a file, by its index."""
    with store.open_input_file(f"{top}/{file}.index") as f:
        entry = np.frombuffer(f.read_at(24, 24 * k), INDEX_ENTRY)[0]
    with store.open_input_file(f"{top}/{file}") as f:
        payload, _ = unframe(f.read_at(int(entry["size"]), int(entry["at"])))
    return _parse(payload)


def _parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack_from("<qBB", payload)
    return (None if null else doc_id), np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def read_records(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every record of the files in the manifest: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    One file is read by one task, record by record.  `start` counts the ids of all files before
    (a running sum over the manifest, one row a file) and those before it in its own file.
    """
    first = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(first), F.lit(0)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = files.select("file", "start").repartition(parts)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{top}/{file}.index") as f:
                    index = np.frombuffer(f.read(), INDEX_ENTRY)
                rows = []
                with store.open_input_stream(f"{top}/{file}", buffer_size=1 << 20) as f:
                    for entry in index:
                        payload, _ = unframe(f.read(int(entry["size"])))
                        doc_id, ids = _parse(payload)
                        rows.append((doc_id, base + int(entry["start"]), len(ids), zlib.crc32(ids.tobytes()), *([ids] * with_ids)))
                        if len(rows) == 2000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int64) for x in cols[4]], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    return files.mapInArrow(read, schema)


def token_records(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Write docs as records and read them back."""
    folder = new_folder(docs.sparkSession, "records")
    return read_records(docs.sparkSession, folder, write_records(docs, folder, vocabulary))
