"""MAT files of level 5: dense and sparse numeric variables as rows.

A file is a header of 128 bytes and data elements: an 8-byte tag (type, size; small elements hold both in one word), the data,
and padding to 8 bytes. An element may be a deflated one. A matrix element holds flags, dimensions, name and values; a sparse
one also row indices and column starts. Variables are bounded by the format (below 2 GB), so a task parses a whole file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: number types by code, and codes of elements and array classes.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, DEFLATED = 14, 15
SPARSE, NUMERIC = 5, frozenset(range(6, 16))


class MatError(ValueError):
    pass


def _elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # a small element: size and type in the first word, data in the second
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size:
            raise MatError("the file ends within an element")
        if kind == DEFLATED:
            yield from _elements(zlib.decompress(body), order)
            at += 8 + size
        else:
            yield kind, body
            at += 8 + size + (-size % 8)


def _values(element: tuple[int, bytes], order: str) -> np.ndarray:
    kind, body = element
    if kind not in NUMBERS:
        raise MatError(f"data of type {kind} is not numeric")
    return np.frombuffer(body, order + NUMBERS[kind])


def variables(raw: bytes) -> Iterator[tuple[str, tuple[int, ...], np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(name, shape, rows, columns, values, sparse) of the numeric variables with two dimensions; others are left out."""
    if len(raw) < 128 or raw[126:128] not in (b"IM", b"MI"):
        raise MatError("not a MAT file of level 5")
    order = "<" if raw[126:128] == b"IM" else ">"
    for kind, body in _elements(raw[128:], order):
        if kind != MATRIX:
            continue
        parts = list(_elements(body, order))
        if len(parts) < 4:
            continue
        flags = int(_values(parts[0], order)[0])
        shape, name = tuple(int(n) for n in _values(parts[1], order)), parts[2][1].decode("latin-1")
        if len(shape) != 2:
            continue
        if flags & 255 == SPARSE:
            starts = _values(parts[4], order).astype(np.int64)
            rows, column = _values(parts[3], order).astype(np.int64)[: starts[-1]], np.repeat(np.arange(shape[1]), np.diff(starts))
            yield name, shape, rows, column, _values(parts[5], order).astype(float)[: starts[-1]], True
        elif flags & 255 in NUMERIC:
            v = _values(parts[3], order).astype(float)
            yield name, shape, np.tile(np.arange(shape[0]), shape[1]), np.repeat(np.arange(shape[1]), shape[0]), v, False


def mat_entries(spark: SparkSession, path: str) -> DataFrame:
    """(name, row, col, value, rows, cols, sparse) of the variables of MAT files, entry by entry, by column."""
    schema = pa.schema([("name", pa.string()), ("row", pa.int64()), ("col", pa.int64()), ("value", pa.float64()), ("rows", pa.int64()), ("cols", pa.int64()), ("sparse", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for name, shape, row, col, value, sparse in variables(content.as_py()):
                    for i in range(0, len(value), 1 << 16):
                        n = len(value[i : i + (1 << 16)])
                        columns = [pa.array([name] * n), pa.array(row[i : i + n]), pa.array(col[i : i + n]), pa.array(value[i : i + n]), pa.array([shape[0]] * n), pa.array([shape[1]] * n), pa.array([sparse] * n)]
                        yield pa.record_batch(columns, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, row long, col long, value double, rows long, cols long, sparse boolean")


def read_graph(spark: SparkSession, path: str, relations: dict[str, str], features: str = "features", label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes: node_id and own__f0..; labels: node_id, y; entries: relation, i, j, v) of one MAT file. relations: name -> variable. A
    missing variable and a label other than 0 and 1 are errors."""
    every = mat_entries(spark, path)
    shapes = {r.name: r for r in every.select("name", "rows", "cols").distinct().collect()}  # one row for each variable
    missing = [v for v in [features, label, *relations.values()] if v not in shapes]
    if missing:
        raise MatError(f"{path} has no {', '.join(missing)}")
    labels = every.where(F.col("name") == label).select((F.col("row") + F.col("col")).alias("node_id"), F.col("value").alias("y"))
    wrong = labels.where("y not in (0, 1)").limit(1).collect()
    if wrong:
        raise MatError(f"label {wrong[0].y} of node {wrong[0].node_id} is neither 0 nor 1")
    width = shapes[features].cols
    wide = every.where(F.col("name") == features).groupBy(F.col("row").alias("node_id")).pivot("col", list(range(width))).agg(F.first("value"))
    digits = max(2, len(str(width - 1)))
    all_nodes = spark.range(shapes[features].rows).withColumnRenamed("id", "node_id")
    nodes = all_nodes.join(wide, "node_id", "left").select("node_id", *[F.coalesce(F.col(str(j)), F.lit(0.0)).alias(f"own__f{j:0{digits}d}") for j in range(width)])
    names = F.create_map(*[F.lit(x) for k, v in relations.items() for x in (v, k)])
    entries = every.where(F.col("name").isin(list(relations.values())) & (F.col("value") != 0)).select(names[F.col("name")].alias("relation"), F.col("row").alias("i"), F.col("col").alias("j"), F.col("value").alias("v"))
    return nodes, labels.select("node_id", F.col("y").cast("int").alias("y")), entries
