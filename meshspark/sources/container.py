"""The level-of-detail container: header, index (nodes, patches, textures) and one payload per node.

`spark.read.format("lodmesh").option("table", ...)` reads header, nodes, patches, textures, vertices or
faces of one file, by byte ranges: a task reads the slice of the index it needs and the payloads of its
nodes, over a local or shared path, any file system that pyarrow opens, or http with range requests.
The driver reads the header's 88 bytes.

`write_container` writes one file on a path that all executors mount: the payloads' offsets are a running
sum of their padded sizes, and every task writes its nodes at their places, so a task that runs again
writes the same bytes again.
"""

from __future__ import annotations

import os
import struct
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.geometry import COORD_BYTES, FACE_BYTES, pad
from ..operators.prefix import running
from ..tables import discard, materialise

# Fixed values of the format: magic number, padding, and the layout of its records (little endian).
MAGIC, VERSION, PADDING = 0x4E787320, 2, 256
HEADER_FORMAT = "<IIQQ36sIII4f"
HEADER_SIZE = struct.calcsize(HEADER_FORMAT)
NODE = np.dtype([("offset", "<u4"), ("nvert", "<u2"), ("nface", "<u2"), ("error", "<f4"), ("cone", "<i2", 4), ("sphere", "<f4", 4), ("tight_radius", "<f4"), ("first_patch", "<u4")])
PATCH = np.dtype([("node", "<u4"), ("triangle_offset", "<u4"), ("texture", "<u4")])
TEXTURE = np.dtype([("offset", "<u4"), ("matrix", "<f4", 16)])
NO_TEXTURE = 0xFFFFFFFF
ATTRIBUTE_TYPES = ("none", "byte", "ubyte", "short", "ushort", "int", "uint", "float", "double")
#: Slots of a signature: coordinates, normals, colours, texture coordinates; a face's indices.
COORD, NORMAL, COLOUR, UV = range(4)
NODES = 256  # nodes a task

TABLES = {
    "header": "version int, nvert long, nface long, normals boolean, colours boolean, uv boolean, flags int, n_nodes long, n_patches long, n_textures long, cx float, cy float, cz float, radius float",
    "nodes": "node long, offset long, size long, nvert int, nface int, error float, n0 int, n1 int, n2 int, n3 int, cx float, cy float, cz float, radius float, tight_radius float, first_patch long, last_patch long",
    "patches": "patch long, src long, ordinal int, dst long, tri_begin long, tri_end long, texture long",
    "textures": "texture long, offset long, matrix array<float>",
    "vertices": "node long, vid int, x float, y float, z float, u float, v float, nx int, ny int, nz int, r int, g int, b int, a int",
    "faces": "node long, fid int, v0 int, v1 int, v2 int",
}


def read_range(path: str, start: int, n: int) -> bytes:
    """n bytes of a file from `start` on."""
    if n <= 0:
        return b""
    if path.startswith(("http://", "https://")):
        ask = urllib.request.Request(path, headers={"Range": f"bytes={start}-{start + n - 1}"})
        with urllib.request.urlopen(ask) as got:
            data = got.read()
            return data if got.status == 206 else data[start : start + n]
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if urlparse(path).scheme else "file://" + os.path.abspath(path))
    with system.open_input_file(name) as f:
        return f.read_at(n, start)


@dataclass
class Header:
    nvert: int
    nface: int
    signature: bytes
    n_nodes: int
    n_patches: int
    n_textures: int
    sphere: tuple[float, float, float, float]
    version: int = VERSION

    @classmethod
    def read(cls, path: str) -> Header:
        magic, version, nvert, nface, signature, n, p, t, *sphere = struct.unpack(HEADER_FORMAT, read_range(path, 0, HEADER_SIZE))
        if magic != MAGIC:
            raise ValueError(f"{path} is no container: magic {magic:#x}")
        return cls(nvert, nface, signature, n, p, t, tuple(sphere), version)

    def pack(self) -> bytes:
        return struct.pack(HEADER_FORMAT, MAGIC, self.version, self.nvert, self.nface, self.signature, self.n_nodes, self.n_patches, self.n_textures, *self.sphere)

    def has(self, slot: int) -> bool:
        return self.signature[2 * slot] != 0

    @property
    def patches_at(self) -> int:
        return HEADER_SIZE + self.n_nodes * NODE.itemsize

    @property
    def textures_at(self) -> int:
        return self.patches_at + self.n_patches * PATCH.itemsize

    @property
    def payload_at(self) -> int:
        return -(-(self.textures_at + self.n_textures * TEXTURE.itemsize) // PADDING) * PADDING


def signature(normals: bool, colours: bool, uv: bool) -> bytes:
    """Eight attributes of a vertex and eight of a face, a type and a number each, and no flags."""
    out = bytearray(36)
    kinds = {COORD: ("float", 3, True), NORMAL: ("short", 3, normals), COLOUR: ("ubyte", 4, colours), UV: ("float", 2, uv)}
    for slot, (kind, n, there) in kinds.items():
        if there:
            out[2 * slot : 2 * slot + 2] = bytes([ATTRIBUTE_TYPES.index(kind), n])
    out[16:18] = bytes([ATTRIBUTE_TYPES.index("ushort"), 3])
    return bytes(out)


class Nodes(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class ContainerReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table, self.header, self.only = path, table, Header.read(path), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Nodes asked for by number are the only ones read; Spark applies the filters again."""
        for f in filters:
            if self.table != "header" and isinstance(f, (EqualTo, In)) and f.attribute == ("node",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
            yield f

    def partitions(self) -> list[Nodes]:
        if self.table == "header":
            return [Nodes(0, 0)]
        n = self.header.n_textures if self.table == "textures" else self.header.n_nodes - 1
        if self.only is not None:
            return [Nodes(k, k + 1) for k in sorted(self.only) if 0 <= k < n] or [Nodes(0, 0)]
        return [Nodes(k, min(k + NODES, n)) for k in range(0, n, NODES)] or [Nodes(0, 0)]

    def read(self, part: Nodes) -> Iterator[pa.RecordBatch]:
        for cols in getattr(self, f"_{self.table}")(part):
            yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in cols], names=[x.split()[0] for x in TABLES[self.table].split(", ")])

    def _header(self, part: Nodes) -> Iterator[list]:
        h = self.header
        flags = int.from_bytes(h.signature[32:36], "little")
        row = [h.version, h.nvert, h.nface, h.has(NORMAL), h.has(COLOUR), h.has(UV), flags, h.n_nodes, h.n_patches, h.n_textures, *h.sphere]
        types = [pa.int32(), pa.int64(), pa.int64(), *[pa.bool_()] * 3, pa.int32(), *[pa.int64()] * 3, *[pa.float32()] * 4]
        yield [pa.array([v], t) for v, t in zip(row, types, strict=True)]

    def _index(self, part: Nodes) -> np.ndarray:
        """Records of the nodes and of the one behind, whose offset and first patch end the last."""
        n = part.end + 1 - part.first
        return np.frombuffer(read_range(self.path, HEADER_SIZE + part.first * NODE.itemsize, n * NODE.itemsize), NODE)

    def _nodes(self, part: Nodes) -> Iterator[list]:
        r = self._index(part)
        at = r["offset"].astype(np.int64) * PADDING
        cone, sphere = r["cone"][:-1].astype(np.int32), r["sphere"][:-1]
        patches = r["first_patch"].astype(np.int64)
        own = [np.ascontiguousarray(x) for x in (*cone.T, *sphere.T)]
        yield [np.arange(part.first, part.end), at[:-1], np.diff(at), r["nvert"][:-1].astype(np.int32), r["nface"][:-1].astype(np.int32), np.ascontiguousarray(r["error"][:-1]), *own, np.ascontiguousarray(r["tight_radius"][:-1]), patches[:-1], patches[1:]]

    def _patches(self, part: Nodes) -> Iterator[list]:
        first = self._index(part)["first_patch"].astype(np.int64)
        n = np.diff(first)
        p = np.frombuffer(read_range(self.path, self.header.patches_at + int(first[0]) * PATCH.itemsize, int(n.sum()) * PATCH.itemsize), PATCH) if n.sum() else np.zeros(0, PATCH)
        ordinal = np.arange(len(p)) - np.repeat(first[:-1] - first[0], n)
        end = p["triangle_offset"].astype(np.int64)
        begin = np.where(ordinal > 0, np.append(0, end)[:-1], 0) if len(p) else end
        tex = p["texture"].astype(np.int64)
        yield [np.arange(first[0], first[-1]), np.repeat(np.arange(part.first, part.end), n), ordinal.astype(np.int32), p["node"].astype(np.int64), begin, end, pa.array(tex, mask=tex == NO_TEXTURE)]

    def _textures(self, part: Nodes) -> Iterator[list]:
        n = part.end - part.first
        r = np.frombuffer(read_range(self.path, self.header.textures_at + part.first * TEXTURE.itemsize, n * TEXTURE.itemsize), TEXTURE)
        yield [np.arange(part.first, part.end), r["offset"].astype(np.int64) * PADDING, pa.array(r["matrix"].tolist(), pa.list_(pa.float32()))]

    def _payloads(self, part: Nodes) -> Iterator[tuple[int, int, int, bytes]]:
        r = self._index(part)
        at = r["offset"].astype(np.int64) * PADDING
        for k in range(part.end - part.first):
            if at[k + 1] > at[k]:
                yield part.first + k, int(r["nvert"][k]), int(r["nface"][k]), read_range(self.path, int(at[k]), int(at[k + 1] - at[k]))

    def _vertices(self, part: Nodes) -> Iterator[list]:
        h = self.header
        for node, n, _, data in self._payloads(part):
            at, cols = COORD_BYTES * n, [np.full(n, node, np.int64), np.arange(n, dtype=np.int32), *np.frombuffer(data, "<f4", 3 * n).reshape(n, 3).T]
            for slot, kind, size, width, as_type in ((UV, "<f4", 4, 2, pa.float32()), (NORMAL, "<i2", 2, 3, pa.int32()), (COLOUR, "u1", 1, 4, pa.int32())):
                if h.has(slot):
                    cols += [x.astype(as_type.to_pandas_dtype()) for x in np.frombuffer(data, kind, width * n, at).reshape(n, width).T]
                    at += size * width * n
                else:
                    cols += [pa.nulls(n, as_type)] * width
            yield [c if isinstance(c, pa.Array) else np.ascontiguousarray(c) for c in cols]

    def _faces(self, part: Nodes) -> Iterator[list]:
        h = self.header
        width = COORD_BYTES + 8 * h.has(UV) + 6 * h.has(NORMAL) + 4 * h.has(COLOUR)
        for node, nvert, n, data in self._payloads(part):
            f = np.frombuffer(data, "<u2", 3 * n, width * nvert).reshape(n, 3).astype(np.int32)
            yield [np.full(n, node, np.int64), np.arange(n, dtype=np.int32), *(np.ascontiguousarray(x) for x in f.T)]


class Container(DataSource):
    """Options: path, table."""

    @classmethod
    def name(cls) -> str:
        return "lodmesh"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "nodes")]

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(self.options["path"], self.options.get("table", "nodes"))


def read_container(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes filters needs it
    spark.dataSource.register(Container)
    return spark.read.format("lodmesh").option("table", table).load(path)


def payload(vertices: pa.Table, faces: pa.Table, normals: bool, colours: bool, uv: bool) -> bytes:
    """Columns one behind the other: coordinates, texture coordinates, normals, colours, faces."""
    order = np.argsort(vertices.column("vid").to_numpy(), kind="stable")
    block = lambda names, kind: np.stack([vertices.column(c).to_numpy()[order] for c in names], 1).astype(kind).tobytes()
    out = [block("xyz", "<f4")]
    out += [block(names, kind) for names, kind, there in (("uv", "<f4", uv), (("nx", "ny", "nz"), "<i2", normals), ("rgba", "u1", colours)) if there]
    at = np.argsort(faces.column("fid").to_numpy(), kind="stable")
    return b"".join([*out, np.stack([faces.column(f"v{k}").to_numpy()[at] for k in range(3)], 1).astype("<u2").tobytes()])


def write_container(path: str, nodes: DataFrame, patches: DataFrame, vertices: DataFrame, faces: DataFrame) -> None:
    """Write nodes (node, error, n0 .. n3, cx, cy, cz, radius, tight_radius), patches (src, ordinal, dst, tri_end,
    texture or null), vertices (node, vid, x, y, z, and u, v; nx, ny, nz; r, g, b, a where there are any) and
    faces (node, fid, v0, v1, v2).

    Numbers of nodes are gapless from 0, those of vertices and faces in each node; patches into the number
    after the last node lead to the sink, which is added.  Node 0 gives the header's sphere.
    """
    scheme = urlparse(path).scheme
    if scheme not in ("", "file"):
        raise ValueError(f"a container is written at places of one file, which {scheme} doesn't offer")
    name = urlparse(path).path
    kinds = {"normals": "nx" in vertices.columns, "colours": "r" in vertices.columns, "uv": "u" in vertices.columns}

    def pack(v: pa.Table, f: pa.Table) -> pa.Table:
        data = payload(v, f, **kinds)
        return pa.table([pa.array([x], t) for x, t in ((v.column("node")[0].as_py(), pa.int64()), (len(v), pa.int64()), (len(f), pa.int64()), (data + bytes(-len(data) % PADDING), pa.binary()))], names=["node", "nvert", "nface", "data"])

    packed = materialise(vertices.groupBy("node").cogroup(faces.groupBy("node")).applyInArrow(pack, "node long, nvert long, nface long, data binary"), "payloads")
    counts = patches.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    sized = nodes.join(packed.select("node", "nvert", "nface", F.octet_length("data").alias("bytes")), "node", "left").join(counts, "node", "left").fillna(0, ["nvert", "nface", "bytes", "n"])
    index = materialise(running(sized, ["node"], {"ends": "bytes", "patch_ends": "n"}), "index")
    total = index.agg(F.count("*").alias("nodes"), F.sum("nvert").alias("v"), F.sum("nface").alias("f"), F.sum("bytes").alias("bytes"), F.sum("n").alias("patches")).first()
    root = nodes.where("node = 0").first()
    sphere = tuple(float(root[c]) for c in ("cx", "cy", "cz", "radius")) if root else (0.0,) * 4
    header = Header(total["v"] or 0, total["f"] or 0, signature(**kinds), total["nodes"] + 1, total["patches"] or 0, 0, sphere)
    end = header.payload_at + (total["bytes"] or 0)
    sink = np.zeros(1, NODE)
    sink["offset"], sink["first_patch"] = end // PADDING, header.n_patches
    with open(name, "wb") as f:
        f.truncate(end)
        f.write(header.pack())
        f.seek(header.patches_at - NODE.itemsize)
        f.write(sink.tobytes())

    def records(b: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        r = np.zeros(b.num_rows, NODE)
        r["offset"] = (header.payload_at + get("ends") - get("bytes")) // PADDING
        r["nvert"], r["nface"], r["error"], r["tight_radius"], r["first_patch"] = get("nvert"), get("nface"), get("error"), get("tight_radius"), get("patch_ends") - get("n")
        for k in range(4):
            r["cone"][:, k], r["sphere"][:, k] = get(f"n{k}"), get(("cx", "cy", "cz", "radius")[k])
        for node, one in zip(get("node"), r, strict=True):
            yield HEADER_SIZE + int(node) * NODE.itemsize, one.tobytes()

    def links(b: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        r = np.zeros(b.num_rows, PATCH)
        r["node"], r["triangle_offset"], r["texture"] = get("dst"), get("tri_end"), get("texture")
        for at, one in zip(get("place"), r, strict=True):
            yield header.patches_at + int(at) * PATCH.itemsize, one.tobytes()

    def data(b: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        for at, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield header.payload_at + at, x

    first = index.select(F.col("node").alias("src"), (F.col("patch_ends") - F.col("n")).alias("first"))
    placed = patches.join(first, "src").select((F.col("first") + F.col("ordinal")).alias("place"), "dst", "tri_end", F.coalesce("texture", F.lit(NO_TEXTURE)).alias("texture"))
    bodies = index.select("node", (F.col("ends") - F.col("bytes")).alias("at")).join(packed.select("node", "data"), "node").select("at", "data")
    for table, make in ((index, records), (placed, links), (bodies, data)):
        _put(table, name, make)
    discard(packed, index)


def _put(table: DataFrame, name: str, make) -> None:
    """Write make(batch)'s (place, bytes) into the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(name, "r+b") as f:
            for b in batches:
                for at, x in make(b):
                    f.seek(at)
                    f.write(x)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["done"])

    table.mapInArrow(run, "done long").agg(F.sum("done")).collect()


def face_bytes(nface: int) -> int:
    return nface * FACE_BYTES


__all__ = ["Container", "Header", "pad", "read_container", "read_range", "signature", "write_container"]
