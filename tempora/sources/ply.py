"""PLY point clouds as a splittable Python data source.

spark.dataSource.register(PlySource)
spark.read.format("ply").option("rows", 1_000_000).load(path, folder or pattern)
df.write.format("ply").mode("append").save(folder)

The header names the properties of a vertex and so the length of its record: a
binary file, of either byte order, is read in ranges of `rows` vertices, each a
partition of its own that seeks to its first byte. An ascii file, whose lines
vary, is one partition. Columns: path, row (the vertex' place in its file, from
0) and the properties; all files have those of the first. Elements before the
vertices may be skipped if their records have one length; what comes after is
not read. A file that ends early, or has list properties in its vertices, is an
error. Writing makes one binary file a task, little endian, without path and
row; a task that runs again writes its file again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DataType, StructType

from tempora.sources.files import listed, opened, read_range

# The scalar types of the format, by both of their names.
TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}
#: Column types that hold each scalar type, and the scalar types that hold a column's.
COLUMNS = {"i1": "short", "u1": "short", "i2": "short", "u2": "int", "i4": "int", "u4": "long", "f4": "float", "f8": "double"}
WRITTEN = {"tinyint": "char", "smallint": "short", "int": "int", "float": "float", "double": "double"}
#: Vertices that are turned into columns at once.
CHUNK = 65_536
_ARROW = {"short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}


@dataclass(frozen=True)
class Header:
    """Byte order ('' for ascii), vertices, where they begin (in lines for ascii), and their properties."""

    order: str
    count: int
    begin: int
    properties: tuple[tuple[str, str], ...]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, (self.order or "<") + t) for n, t in self.properties])

    @property
    def schema(self) -> str:
        return ", ".join(["path string", "row long", *[f"`{n}` {COLUMNS[t]}" for n, t in self.properties]])


def parse_header(data: bytes) -> Header:
    """The header at the beginning of a file; ValueError where it is none or not whole."""
    end = re.search(rb"end_header\r?\n", data)
    if not data.startswith(b"ply") or not end:
        raise ValueError("no header of a PLY file")
    order, skipped, elements = None, 0, []
    for line in data[: end.start()].decode("ascii", "replace").splitlines()[1:]:
        words = line.split()
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            if words[1] not in ORDERS:
                raise ValueError(f"unknown format {words[1]}")
            order = ORDERS[words[1]]
        elif words[0] == "element":
            elements.append((words[1], int(words[2]), []))
        elif words[0] == "property":
            elements[-1][2].append((words[-1], "list" if words[1] == "list" else TYPES[words[1]]))
    if order is None:
        raise ValueError("no format")
    for name, count, properties in elements:
        fixed = all(t != "list" for _, t in properties)
        if name == "vertex":
            if not fixed:
                raise ValueError("vertices with list properties")
            return Header(order, count, (0 if order == "" else end.end()) + skipped, tuple(properties))
        if order == "":
            skipped += count
        elif fixed:
            skipped += count * sum(int(t[1]) for _, t in properties)
        else:
            raise ValueError(f"element {name} of varying length before the vertices")
    raise ValueError("no vertices")


def header_of(uri: str, first: int = 1 << 16) -> Header:
    """The header of a file, however long."""
    while True:
        data = read_range(uri, 0, first)
        if b"end_header" in data[:-2] or len(data) < first:
            return parse_header(data)
        first *= 4


@dataclass
class Vertices(InputPartition):
    """Some vertices of a file."""

    path: str
    header: Header
    start: int
    stop: int


class PlyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", 1_000_000))

    def partitions(self):
        out = []
        for path, size in listed(self.path):
            h = header_of(path)
            if h.order and h.begin + h.count * h.dtype.itemsize > size:
                raise ValueError(f"{path} ends early")
            step = self.rows if h.order else max(1, h.count)
            # A file without vertices is an empty range, as there must be some partition.
            out += [Vertices(path, h, i, min(i + step, h.count)) for i in range(0, max(1, h.count), step)]
        return out

    def read(self, partition):
        h, names = partition.header, [n for n, _ in partition.header.properties]
        for start, rows in self._chunks(partition):
            columns = [pa.array(np.ascontiguousarray(rows[n].astype(rows[n].dtype.newbyteorder("="))), _ARROW[COLUMNS[t]]) for n, t in h.properties]
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * len(rows)), pa.array(np.arange(start, start + len(rows), dtype=np.int64)), *columns],
                ["path", "row", *names],
            )

    def _chunks(self, p: Vertices):
        """(first place, structured rows) of the partition."""
        h, size = p.header, p.header.dtype.itemsize
        if h.order:
            for i in range(p.start, p.stop, CHUNK):
                n = min(CHUNK, p.stop - i)
                data = read_range(p.path, h.begin + i * size, n * size)
                if len(data) < n * size:
                    raise ValueError(f"{p.path} ends early")
                yield i, np.frombuffer(data, h.dtype)
            return
        system, path = opened(p.path)
        with system.open_input_stream(path) as f:
            lines = _lines(f)
            for line in lines:
                if line.strip() == b"end_header":
                    break
            for _ in range(h.begin):
                next(lines)
            for i in range(0, h.count, CHUNK):
                n = min(CHUNK, h.count - i)
                cells = [line.split() for line, _ in zip(lines, range(n))]
                if len(cells) < n:
                    raise ValueError(f"{p.path} ends early")
                out = np.zeros(n, h.dtype)
                for j, (name, _) in enumerate(h.properties):
                    out[name] = np.array([c[j] for c in cells], float)
                yield i, out


def _lines(stream):
    """The lines of a stream, without reading it whole."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


@dataclass
class Written(WriterCommitMessage):
    path: str


class PlyWriter(DataSourceWriter):
    def __init__(self, options, schema: StructType):
        self.path = options["path"].rstrip("/")
        self.properties = [(f.name, _scalar(f.dataType)) for f in schema.fields if f.name not in ("path", "row")]

    def write(self, iterator):
        from pyspark import TaskContext

        names = [n for n, _ in self.properties]
        dtype = np.dtype([(n, "<" + TYPES[t]) for n, t in self.properties])
        body, count, waiting = [], 0, []

        def pack():
            if waiting:
                body.append(np.array(waiting, dtype).tobytes())
                waiting.clear()

        for row in iterator:
            waiting.append(tuple(row[n] for n in names))
            count += 1
            if len(waiting) == CHUNK:
                pack()
        pack()
        head = ["ply", "format binary_little_endian 1.0", f"element vertex {count}", *[f"property {t} {n}" for n, t in self.properties], "end_header"]
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        name = f"{path}/part-{TaskContext.get().partitionId():05}.ply"
        with system.open_output_stream(name) as f:
            f.write(("\n".join(head) + "\n").encode())
            for data in body:
                f.write(data)
        return Written(name)


def _scalar(kind: DataType) -> str:
    if kind.simpleString() not in WRITTEN:
        raise ValueError(f"a PLY file has no {kind.simpleString()}")
    return WRITTEN[kind.simpleString()]


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        files = listed(self.options["path"])
        if not files:
            raise FileNotFoundError(self.options["path"])
        return header_of(files[0][0]).schema

    def reader(self, schema):
        return PlyReader(self.options)

    def writer(self, schema, overwrite):
        return PlyWriter(self.options, schema)
