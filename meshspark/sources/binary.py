"""Binary mesh files (PLY, STL, raw triangles) read in ranges of records.

The driver reads headers alone; a partition is a range of one file's fixed-width records, so a file of any size spreads
over as many tasks as it needs.  Columns follow the header: float or double coordinates, and colours, normals, texture
coordinates and texture numbers where there are any.  Files of one path that differ give nulls for what one lacks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .container import read_range

RECORDS = 1 << 17  # of a partition
BATCH = 1 << 14
HEADER_STEP, HEADER_MOST = 1 << 13, 1 << 24
# Fixed values of the formats.
TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
COLOURS = {"r": ("red", "diffuse_red"), "g": ("green", "diffuse_green"), "b": ("blue", "diffuse_blue"), "a": ("alpha",)}
LISTS = {"vertex_indices": 3, "vertex_index": 3, "texcoord": 6}
STL = np.dtype([("normal", "<f4", 3), ("corners", "<f4", 9), ("attribute", "<u2")])
STL_HEADER = 84
RAW = np.dtype([("corners", "<f4", 9), ("normals", "<f4", 9), ("colours", "<f4", 9)])
CORNERS = [f"{c}{k}" for k in range(3) for c in "xyz"]
TINTS = [f"{c}{k}" for k in range(3) for c in "rgb"]
WEDGES = [f"t{c}{k}" for k in range(3) for c in "uv"]


@dataclass
class Layout:
    """A file's elements: name -> (record type, records, first byte); and the names of its textures."""

    path: str
    elements: dict[str, tuple[np.dtype, int, int]]
    textures: list[str] = field(default_factory=list)


def files(path: str) -> list[str]:
    """The path, or the files of the folder it names, in order of name."""
    if path.startswith(("http://", "https://")):
        return [path]
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if urlparse(path).scheme else "file://" + os.path.abspath(path))
    info = system.get_file_info(name)
    if info.type == fs.FileType.Directory:
        head = path[: len(path) - len(name)] if path.endswith(name) else "file://"
        return sorted(head + f.path for f in system.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [path]


def size_of(path: str) -> int:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if urlparse(path).scheme else "file://" + os.path.abspath(path))
    return system.get_file_info(name).size


def ply_layout(path: str) -> Layout:
    """From the header alone; ValueError where it isn't a binary PLY file, or a list has no fixed length."""
    data = b""
    while b"end_header" not in data or b"\n" not in data[data.index(b"end_header") :]:
        more = read_range(path, len(data), HEADER_STEP)
        data += more
        if not more or len(data) > HEADER_MOST:
            raise ValueError(f"no PLY header in {path}")
    at = data.index(b"\n", data.index(b"end_header")) + 1
    lines = [w for line in data[:at].decode("latin-1").splitlines() if (w := line.split())]
    kind = next((w[1] for w in lines if w[0] == "format"), "")
    if lines[0] != ["ply"] or not kind.startswith("binary"):
        raise ValueError(f"{path} is no binary PLY file")
    order, found, textures = "<" if kind == "binary_little_endian" else ">", [], []
    for w in lines:
        if w[0] == "comment" and w[1:2] == ["TextureFile"]:
            textures.append(" ".join(w[2:]))
        elif w[0] == "element":
            found.append((w[1], int(w[2]), []))
        elif w[0] == "property" and w[1] == "list":
            if w[-1] not in LISTS:
                raise ValueError(f"list {w[-1]} of element {found[-1][0]} has no fixed length")
            found[-1][2].extend([(f"{w[-1]}#", order + TYPES[w[2]]), (w[-1], order + TYPES[w[3]], LISTS[w[-1]])])
        elif w[0] == "property":
            found[-1][2].append((w[-1], order + TYPES[w[1]]))
    elements = {}
    for name, n, fields in found:
        elements[name] = (np.dtype(fields), n, at)
        at += n * np.dtype(fields).itemsize
    missing = {"x", "y", "z"} - set(elements.get("vertex", (np.dtype([]),))[0].names or ())
    if missing:
        raise ValueError(f"vertices of {path} lack {sorted(missing)}")
    return Layout(path, elements, textures)


def stl_layout(path: str) -> Layout:
    return Layout(path, {"triangle": (STL, int.from_bytes(read_range(path, STL_HEADER - 4, 4), "little"), STL_HEADER)})


def raw_layout(path: str) -> Layout:
    """27 floats a triangle: places, normals (not used), colours from 0 to 1; what is left over at the end doesn't count."""
    return Layout(path, {"triangle": (RAW, size_of(path) // RAW.itemsize, 0)})


LAYOUTS = {"ply": ply_layout, "stl": stl_layout, "raw": raw_layout}
ELEMENT = {"vertices": "vertex", "faces": "face", "triangles": "triangle", "textures": None}


def _columns(layouts: list[Layout], kind: str, table: str) -> list[tuple[str, str]]:
    """(column, type) of a table of files, by what any of them has."""
    names = {f for x in layouts if ELEMENT[table] in x.elements for f in x.elements[ELEMENT[table]][0].names}
    if table == "textures":
        return [("file", "string"), ("tex", "int"), ("name", "string")]
    if table == "triangles":
        return [("file", "string"), ("fid", "long"), *((c, "double") for c in CORNERS), *((c, "double") for c in TINTS if kind == "raw")]
    if table == "vertices":
        out = [("file", "string"), ("vid", "long"), *((c, "double") for c in "xyz"), *((c, "int") for c in "rgba")]
        return out + [(c, "double") for c in ("nx", "ny", "nz") if c in names]
    out = [("file", "string"), ("fid", "long"), *((f"v{k}", "long") for k in range(3))]
    return out + [(c, "double") for c in WEDGES if "texcoord" in names] + [("tex", "int")] * ("texnumber" in names)


class Range(InputPartition):
    def __init__(self, path: str, dtype: list, first: int, n: int, at: int, rows: list | None = None):
        self.path, self.dtype, self.first, self.n, self.at, self.rows = path, dtype, first, n, at, rows


class BinaryReader(DataSourceReader):
    def __init__(self, path: str, kind: str, table: str, records: int):
        self.kind, self.table, self.records = kind, table, records
        self.layouts = [LAYOUTS[kind](f) for p in path.split("\n") for f in files(p)]
        self.columns = _columns(self.layouts, kind, table)

    def partitions(self) -> list[Range]:
        out = []
        for x in self.layouts:
            if self.table == "textures":
                out.append(Range(x.path, [], 0, 0, 0, x.textures))
            elif ELEMENT[self.table] in x.elements:
                dtype, n, at = x.elements[ELEMENT[self.table]]
                out += [Range(x.path, dtype.descr, k, min(self.records, n - k), at + k * dtype.itemsize) for k in range(0, n, self.records)]
        return out or [Range("", [], 0, 0, 0, [])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        if part.rows is not None:
            rows = {"file": [part.path] * len(part.rows), "tex": range(len(part.rows)), "name": part.rows}
            if self.table == "textures":
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], kinds[t]) for c, t in self.columns], names=[c for c, _ in self.columns])
            return
        dtype = np.dtype(part.dtype)
        for k in range(0, part.n, BATCH):
            n = min(BATCH, part.n - k)
            r = np.frombuffer(read_range(part.path, part.at + k * dtype.itemsize, n * dtype.itemsize), dtype)
            if len(r) < n:
                raise ValueError(f"{part.path} ends before its header says")
            made = getattr(self, f"_{self.table}")(r) | {"file": [part.path] * n, ("vid" if self.table == "vertices" else "fid"): np.arange(n) + part.first + k}
            arrays = [pa.nulls(n, kinds[t]) if c not in made else pa.array(np.ascontiguousarray(made[c]) if isinstance(made[c], np.ndarray) else made[c], kinds[t]) for c, t in self.columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in self.columns])

    def _vertices(self, r: np.ndarray) -> dict:
        out = {c: r[c].astype(float) for c in ("x", "y", "z", "nx", "ny", "nz") if c in r.dtype.names}
        for c, known in COLOURS.items():
            own = next((x for x in known if x in r.dtype.names), None)
            if own:
                out[c] = r[own].astype(np.int32)
            elif c == "a" and "r" in out:
                out[c] = np.full(len(r), 255, np.int32)
        return out

    def _faces(self, r: np.ndarray) -> dict:
        for f in LISTS:
            if f in r.dtype.names and (r[f"{f}#"] != LISTS[f]).any():
                raise ValueError(f"{f} of other lengths than {LISTS[f]}")
        ids = r["vertex_indices" if "vertex_indices" in r.dtype.names else "vertex_index"].astype(np.int64)
        out = {f"v{k}": ids[:, k] for k in range(3)}
        if "texcoord" in r.dtype.names:
            out |= {c: r["texcoord"][:, i].astype(float) for i, c in enumerate(WEDGES)}
        return out | ({"tex": r["texnumber"].astype(np.int32)} if "texnumber" in r.dtype.names else {})

    def _triangles(self, r: np.ndarray) -> dict:
        out = {c: r["corners"][:, i].astype(float) for i, c in enumerate(CORNERS)}
        return out | ({c: np.floor(r["colours"][:, i].astype(float) * 255) for i, c in enumerate(TINTS)} if "colours" in r.dtype.names else {})


class BinaryMesh(DataSource):
    """Options: path (a file or a folder, or several on lines of their own), kind (ply, stl, raw), table (vertices, faces, textures; triangles), records of a partition."""

    @classmethod
    def name(cls) -> str:
        return "binarymesh"

    def _reader(self) -> BinaryReader:
        return BinaryReader(self.options["path"], self.options["kind"], self.options["table"], int(self.options.get("records", RECORDS)))

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in self._reader().columns)

    def reader(self, schema) -> BinaryReader:
        return self._reader()


def read_binary(spark: SparkSession, path: str, kind: str, table: str, records: int = RECORDS) -> DataFrame:
    spark.dataSource.register(BinaryMesh)
    return spark.read.format("binarymesh").option("kind", kind).option("table", table).option("records", records).load(path)


def ply_bytes(corners: np.ndarray, order: str = "<") -> bytes:
    """A whole PLY file of triangles (n, 9): double coordinates, three vertices a face."""
    n = len(corners)
    kind = "little" if order == "<" else "big"
    head = ["ply", f"format binary_{kind}_endian 1.0", f"element vertex {3 * n}", *(f"property double {c}" for c in "xyz"), f"element face {n}", "property list uchar int vertex_indices", "end_header", ""]
    faces = np.zeros(n, [("n", "u1"), ("v", f"{order}i4", 3)])
    faces["n"], faces["v"] = 3, np.arange(3 * n).reshape(n, 3)
    return "\n".join(head).encode() + corners.reshape(-1, 3).astype(f"{order}f8").tobytes() + faces.tobytes()


def raw_bytes(corners: np.ndarray) -> bytes:
    rows = np.zeros(len(corners), RAW)
    rows["corners"] = corners
    return rows.tobytes()


def stl_bytes(corners: np.ndarray) -> bytes:
    rows = np.zeros(len(corners), STL)
    rows["corners"] = corners
    return bytes(STL_HEADER - 4) + len(rows).to_bytes(4, "little") + rows.tobytes()


WRITERS = {"ply": ply_bytes, "raw": raw_bytes, "stl": stl_bytes}


def write_parts(soup: DataFrame, folder: str, kind: str) -> list[str]:
    """Triangles (x0 .. z2) as whole files of at most RECORDS triangles in a folder; their paths.

    Every attempt of a task writes files of its own names, and only those of the attempts that counted are returned.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        done: list[str] = []

        def close(rows: list[np.ndarray]) -> None:
            name = f"part-{uuid.uuid4().hex}.{kind}"
            with system.open_output_stream(f"{top}/{name}") as f:
                f.write(WRITERS[kind](np.concatenate(rows)))
            done.append(f"{folder}/{name}")

        rows: list[np.ndarray] = []
        for b in batches:
            rows.append(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in CORNERS], 1).astype(float))
            if sum(map(len, rows)) + 20_000 > RECORDS:
                close(rows)
                rows = []
        if sum(map(len, rows)):
            close(rows)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    return [r["path"] for r in soup.select(*CORNERS).mapInArrow(write, "path string").collect()]  # a name a file
