"""MAT files of level 5 as a Spark data source that plans its partitions from the files' tags.

The planner reads only tags, dimensions, names and a few starts of sparse columns, and makes a partition for each range of columns of each
wanted variable; columns before the first entry and after the last one of a sparse variable get none. A partition then reads its columns' bytes alone, dense or sparse. Variables that are not asked for cost their tags. A deflated variable
has no places of its own in the file, so it is one partition. Files are reached through pyarrow's file systems, by URI.

    spark.dataSource.register(MatSource)
    spark.read.format("mat").option("path", "file:///graphs").option("variables", "net,features").load()
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmesh.sources.mat import DEFLATED, MATRIX, NUMBERS, NUMERIC, SPARSE, MatError, variables

SCHEMA = "name string, row long, col long, value double, rows long, cols long, sparse boolean"
_ARROW = pa.schema([("name", pa.string()), ("row", pa.int64()), ("col", pa.int64()), ("value", pa.float64()), ("rows", pa.int64()), ("cols", pa.int64()), ("sparse", pa.bool_())])
#: Columns of a partition, and entries of an Arrow batch.
COLUMNS, ENTRIES = 4096, 1 << 16
#: Entries of a written file on average: each file holds the starts of all columns, so their number must not grow with these.
FILE_ENTRIES = 1 << 20
#: Bytes of a deflated variable that are inflated to see its name.
HEAD = 1 << 16


@dataclass
class Columns(InputPartition):
    """Columns [first, last) of a variable: where its parts lie, as (number type, offset, values) of values or of rows, starts and values; or a
    whole deflated variable at (offset, bytes)."""

    uri: str
    order: str
    name: str
    shape: tuple[int, int]
    first: int
    last: int
    parts: tuple[tuple[str, int, int], ...]
    deflated: tuple[int, int] | None = None


def _tag(raw: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """(type, size, offset of the data, offset after the element) of the element at `at`."""
    kind, size = struct.unpack_from(order + "II", raw, at)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, size, at + 8, at + 8 + size + (-size % 8)


def _described(raw: bytes, order: str) -> tuple[int, tuple[int, ...], str, int] | None:
    """(class, shape, name, offset of the first part) from the head of a matrix's body."""
    _, _, at, after = _tag(raw, 0, order)
    flags = struct.unpack_from(order + "I", raw, at)[0]
    _, size, at, after = _tag(raw, after, order)
    shape = struct.unpack_from(f"{order}{size // 4}i", raw, at)
    _, size, at, after = _tag(raw, after, order)
    if len(shape) != 2 or not (flags & 255 == SPARSE or flags & 255 in NUMERIC):
        return None
    return flags & 255, shape, raw[at : at + size].decode("latin-1"), after


def _filled(file: pa.NativeFile, starts: tuple[str, int, int], cols: int) -> tuple[int, int]:
    """(first, last): all entries of a sparse variable lie in these columns; found by bisection, as starts don't fall."""
    kind = np.dtype(starts[0])

    def at(i: int) -> int:
        file.seek(starts[1] + i * kind.itemsize)
        return int(np.frombuffer(file.read(kind.itemsize), kind)[0])

    if not cols or not (total := at(cols)):
        return 0, 0
    first = bisect.bisect_right(range(cols + 1), 0, key=at) - 1
    return first, bisect.bisect_left(range(cols + 1), total, key=at)


def plan(uri: str, wanted: set[str], columns: int = COLUMNS) -> Iterator[Columns]:
    """The partitions of one file."""
    store, path = stores.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        size, head = file.size(), file.read(128)
        if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
            raise MatError(f"{uri} is not a MAT file of level 5")
        order = "<" if head[126:128] == b"IM" else ">"
        at = 128
        while at + 8 <= size:
            file.seek(at)
            kind, length, body, after = _tag(file.read(8), 0, order)
            body, after = at + body, at + after
            if body + length > size:
                raise MatError(f"{uri} ends within an element")
            file.seek(body)
            if kind == DEFLATED:
                after = body + length
                inner = zlib.decompressobj().decompress(file.read(min(length, HEAD)), HEAD)
                if struct.unpack_from(order + "I", inner)[0] == MATRIX and (found := _described(inner[8:], order)) and (not wanted or found[2] in wanted):
                    yield Columns(uri, order, found[2], found[1], 0, found[1][1], (), (body, length))
            elif kind == MATRIX and (found := _described(file.read(min(length, 4096)), order)) and (not wanted or found[2] in wanted):
                kind, shape, name, inside = found
                parts, inside = [], body + inside
                for _ in range(3 if kind == SPARSE else 1):
                    file.seek(inside)
                    number, held, data, end = _tag(file.read(8), 0, order)
                    if number not in NUMBERS:
                        raise MatError(f"{name} in {uri} is not numeric")
                    parts.append((order + NUMBERS[number], inside + data, held // np.dtype(NUMBERS[number]).itemsize))
                    inside += end
                low, high = _filled(file, parts[1], shape[1]) if kind == SPARSE else (0, shape[1])
                for first in range(low, max(high, low + 1), columns):
                    yield Columns(uri, order, name, shape, first, min(first + columns, high), tuple(parts))
            at = after


def read_columns(p: Columns) -> Iterator[pa.RecordBatch]:
    store, path = stores.FileSystem.from_uri(p.uri)
    with store.open_input_file(path) as file:

        def values(part: tuple[str, int, int], first: int, last: int) -> np.ndarray:
            kind = np.dtype(part[0])
            file.seek(part[1] + first * kind.itemsize)
            return np.frombuffer(file.read((last - first) * kind.itemsize), kind)

        if p.deflated:
            file.seek(p.deflated[0])
            body = file.read(p.deflated[1])
            head = b"\0" * 126 + (b"IM" if p.order == "<" else b"MI")
            (_, _, rows, cols, v, sparse), = variables(head + struct.pack(p.order + "II", DEFLATED, len(body)) + body)
        elif len(p.parts) == 1:
            n, sparse = p.shape[0], False
            v = values(p.parts[0], p.first * n, p.last * n).astype(float)
            rows, cols = np.tile(np.arange(n), p.last - p.first), np.repeat(np.arange(p.first, p.last), n)
        else:
            starts, sparse = values(p.parts[1], p.first, p.last + 1).astype(np.int64), True
            rows, v = values(p.parts[0], starts[0], starts[-1]).astype(np.int64), values(p.parts[2], starts[0], starts[-1]).astype(float)
            cols = np.repeat(np.arange(p.first, p.last), np.diff(starts))
    for i in range(0, len(v), ENTRIES):
        n = len(v[i : i + ENTRIES])
        made = [pa.array([p.name] * n), pa.array(rows[i : i + n], pa.int64()), pa.array(cols[i : i + n], pa.int64()), pa.array(v[i : i + n]), *[pa.array(np.full(n, s), pa.int64()) for s in p.shape], pa.array([sparse] * n)]
        yield pa.record_batch(made, schema=_ARROW)


class MatReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.columns = options["path"], int(options.get("columns", COLUMNS))
        self.wanted = {v.strip() for v in options.get("variables", "").split(",") if v.strip()}

    def partitions(self) -> list[Columns]:
        store, path = stores.FileSystem.from_uri(self.path)
        found = store.get_file_info(path)
        files = sorted(f.path for f in store.get_file_info(stores.FileSelector(path)) if f.is_file and f.path.endswith(".mat")) if found.type == stores.FileType.Directory else [path]
        scheme = self.path.split("://", 1)[0] + "://" if "://" in self.path else ""
        made = [p for f in files for p in plan(f"{scheme}{f}", self.wanted, self.columns)]
        missing = self.wanted - {p.name for p in made}
        if missing:
            raise MatError(f"{self.path} has no {', '.join(sorted(missing))}")
        return made

    def read(self, partition: Columns) -> Iterator[pa.RecordBatch]:
        return read_columns(partition)


class MatSource(DataSource):
    """Options: path (a file or a folder of .mat files, as a URI), variables (names with commas; all without it), columns (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatReader:
        return MatReader(self.options)


def _element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def sparse_file(name: str, shape: tuple[int, int], rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> bytes:
    """A MAT file with one sparse variable; entries in the order of columns, then rows."""
    starts = np.searchsorted(cols, np.arange(shape[1] + 1)).astype("<i4")
    body = _element(6, struct.pack("<II", SPARSE, max(len(values), 1))) + _element(5, struct.pack("<2i", *shape)) + _element(1, name.encode("latin-1"))
    body += _element(5, rows.astype("<i4").tobytes()) + _element(5, starts.tobytes()) + _element(9, values.astype("<f8").tobytes())
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + _element(MATRIX, body)


def write_sparse(entries: DataFrame, path: str, columns: int | None = None) -> int:
    """Writes (name, row, col, value, rows, cols) as files of one variable and one range of columns each, so no task holds a whole
    matrix; each is written aside and renamed. Without `columns` a range has as many columns as hold FILE_ENTRIES entries on average.
    Returns the number of files."""
    if columns is None:
        wide = entries.groupBy("name").agg(F.max("cols").alias("cols"), F.count("*").alias("n")).collect()  # one row for each variable
        of = {r.name: max(COLUMNS, -(-int(r.cols) * FILE_ENTRIES // r.n)) for r in wide}
    else:
        of = {}

    def save(key: tuple, parts: list[np.ndarray]) -> tuple[str, int]:
        name, at, n, m = key
        row, col, value = (np.concatenate(c) for c in zip(*parts, strict=True))
        store, folder = stores.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        aside, target = f"{folder}/.{name}-{at}-{uuid.uuid4().hex}", f"{folder}/{name}-{at:06d}.mat"
        with store.open_output_stream(aside) as out:
            out.write(sparse_file(name, (n, m), row, col, value))
        store.move(aside, target)
        return target, len(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            row, col, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))
            names = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0)
            changes = sum((np.diff(c) != 0 for c in (names, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)))), np.zeros(max(len(names) - 1, 0), bool))
            cut = [0, *(np.flatnonzero(changes) + 1).tolist(), len(names)]
            for a, b in zip(cut, cut[1:], strict=False):
                if a < b:
                    own = tuple(batch.column(i)[a].as_py() for i in range(4))
                    if key is not None and own != key:
                        yield _saved(*save(key, held))
                        held = []
                    key = own
                    held.append((row[a:b], col[a:b], value[a:b]))
        if held:
            yield _saved(*save(key, held))

    every = F.create_map(*[F.lit(x) for name, n in of.items() for x in (name, n)])[F.col("name")] if of else F.lit(columns or COLUMNS)
    rows = entries.select("name", F.floor(F.col("col") / every).cast("long").alias("at"), F.col("rows").cast("long"), F.col("cols").cast("long"), F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"))
    return rows.repartition("name", "at").sortWithinPartitions("name", "at", "col", "row").mapInArrow(run, "file string, entries long").count()


def _saved(file: str, entries: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array([file]), pa.array([entries], pa.int64())], ["file", "entries"])
