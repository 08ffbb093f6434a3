"""The MAT source's plan and pruning, and results that are whole or absent."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.sources import mat, mat_source
from quillmesh.storage import committed, commit, is_committed


def dense(name, a, kind=9, dtype="<f8"):
    body = mat_source._element(6, struct.pack("<II", 6, 0)) + mat_source._element(5, struct.pack("<2i", *a.shape)) + mat_source._element(1, name.encode()) + mat_source._element(kind, a.T.astype(dtype).tobytes())
    return mat_source._element(14, body)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("mats")
    rng = np.random.default_rng(0)
    net = (rng.random((9, 9)) < 0.3) * rng.integers(1, 5, (9, 9))
    rows, cols = np.nonzero(net.T)[::-1]
    head = b"text".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    features = rng.normal(size=(9, 4))
    small = np.arange(9).reshape(9, 1)
    (path / "a.mat").write_bytes(mat_source.sparse_file("net", (9, 9), rows, cols, net[rows, cols].astype(float)) + dense("features", features) + dense("label", small, 5, "<i4"))
    packed = zlib.compress(dense("packed", features * 2))
    (path / "b.mat").write_bytes(head + struct.pack("<II", 15, len(packed)) + packed)
    return path, net, features, small


def entries(spark, path, **options):
    spark.dataSource.register(mat_source.MatSource)
    return spark.read.format("mat").options(path=str(path), **options).load()


@pytest.mark.parametrize("columns", ["2", "4096"])
def test_every_variable_and_range_of_columns(spark, folder, columns):
    path, net, features, small = folder
    got = {}
    for r in entries(spark, path, columns=columns).collect():
        got.setdefault(r.name, {})[r.row, r.col] = r.value
        assert r.sparse == (r.name == "net") and (r.rows, r.cols) == {"net": (9, 9), "features": (9, 4), "packed": (9, 4), "label": (9, 1)}[r.name]
    assert got["net"] == {(i, j): float(net[i, j]) for i, j in zip(*np.nonzero(net), strict=True)}
    for name, want in (("features", features), ("packed", features * 2), ("label", small)):
        assert got[name] == {(i, j): float(want[i, j]) for i in range(9) for j in range(want.shape[1])}
    # the same as the reader of whole files
    whole = {(n, i, j): v for f in ("a.mat", "b.mat") for n, _, rows, cols, vs, _ in mat.variables((path / f).read_bytes()) for i, j, v in zip(rows.tolist(), cols.tolist(), vs.tolist(), strict=True)}
    assert whole == {(n, *k): v for n, own in got.items() for k, v in own.items()}


def test_only_what_is_asked_for_is_planned(spark, folder):
    path = folder[0]
    reader = mat_source.MatReader({"path": str(path), "variables": "features, label", "columns": "3"})
    assert [(p.name, p.first, p.last) for p in reader.partitions()] == [("features", 0, 3), ("features", 3, 4), ("label", 0, 1)]
    assert entries(spark, path, variables="packed").select("name").distinct().collect()[0].name == "packed"
    with pytest.raises(mat.MatError, match="has no other"):
        mat_source.MatReader({"path": str(path), "variables": "other"}).partitions()
    (path / "c.mat").write_bytes(b"no")
    with pytest.raises(mat.MatError, match="not a MAT"):
        mat_source.MatReader({"path": str(path)}).partitions()
    (path / "c.mat").unlink()


def test_written_matrices_come_back(spark, tmp_path):
    rows = spark.range(500).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("name"), (F.col("id") % 37).alias("row"), (F.col("id") % 101).alias("col"), (F.col("id") / 4).alias("value"), F.lit(40).alias("rows"), F.lit(101).alias("cols")).dropDuplicates(["name", "row", "col"])
    assert mat_source.write_sparse(rows, str(tmp_path / "out"), columns=30) == 8
    assert sorted(map(tuple, entries(spark, tmp_path / "out").select("name", "row", "col", "value").collect())) == sorted(map(tuple, rows.select("name", "row", "col", "value").collect()))


def test_wide_matrices_take_few_files_and_partitions(spark, tmp_path):
    """20 ranges of columns in one file for each variable, and partitions only where entries are: not ranges times files."""
    cols = 20 * mat_source.COLUMNS
    rows = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 'x' ELSE 'y' END AS name", "id % 50 AS row", f"id * 91 % {cols} AS col", "id / 4 AS value", f"{cols} AS rows", f"{cols} AS cols")
    assert mat_source.write_sparse(rows, str(tmp_path / "one")) == 2
    assert mat_source.write_sparse(rows, str(tmp_path / "many"), columns=mat_source.COLUMNS) == 40
    empty = mat_source.sparse_file("z", (5, 9000), *(np.zeros(0, int),) * 2, np.zeros(0))
    (tmp_path / "many" / "z.mat").write_bytes(empty)
    for folder, most in (("one", 40), ("many", 41)):
        made = mat_source.MatReader({"path": str(tmp_path / folder)}).partitions()
        assert len(made) <= most
        got = entries(spark, tmp_path / folder).select("name", "row", "col", "value").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, rows.select("name", "row", "col", "value").collect()))


def test_results_are_whole_or_absent(spark, tmp_path):
    path = f"file://{tmp_path}/deep/er/result"
    with pytest.raises(FileNotFoundError):
        committed(spark, path)
    commit(spark.range(5), path)
    assert is_committed(spark, path) and committed(spark, path).count() == 5
    commit(spark.range(7), path)
    assert committed(spark, path).count() == 7
    failing = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        commit(failing, path)
    assert committed(spark, path).count() == 7  # the former one stands
    spark.range(3).write.parquet(f"{path}2")  # half a commit: no mark
    assert not is_committed(spark, f"{path}2")
    commit(spark.range(4), f"{path}2")
    assert committed(spark, f"{path}2").count() == 4
