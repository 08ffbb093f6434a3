"""Tables and intermediate results in storage that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_used: "weakref.WeakKeyDictionary[SparkSession, str]" = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark only: the path may be in any store Spark knows."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a session on one machine (tests) makes a temporary one and sets it; a
    cluster, whose machines would not share it, gets an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This session's own folder in the shared one, deleted by release() or when the driver ends."""
    if spark not in _used:
        _used[spark] = f"{shared_dir(spark)}/quillmesh/{uuid.uuid4().hex}"
        atexit.register(release, spark)
    return _used[spark]


def release(spark: SparkSession) -> None:
    """Deletes the intermediate results of this session. DataFrames that read them can't be evaluated afterwards."""
    path = _used.pop(spark, None)
    if path is None or spark.sparkContext._jsc is None:
        return
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already; the folder is then the cluster's to clean
        pass


def written(df: DataFrame, name: str, codec: str = "zstd", rows_in_file: int = 0) -> DataFrame:
    """Write a result to the shared folder and read it back: lineage ends at replicated files, so a lost executor costs
    no recomputation and no second evaluation of Python code. Few large rows go to files of `rows_in_file`, which a later read deals out evenly.
    Released at the end of the session, or by release()."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("maxRecordsPerFile", rows_in_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Written last: readers take a result for whole only with it.
COMMITTED = "_COMMITTED"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Write a result to `path`, whole or not at all: aside first, then renamed, then marked. A former result stands until the new one is
    written; what a lost driver leaves behind has no mark, and is taken away by the next commit."""
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.option("compression", codec).parquet(aside)
    target, store = _place(spark, path)
    store.delete(target, True)
    if target.getParent() is not None:
        store.mkdirs(target.getParent())
    if not store.rename(_place(spark, aside)[0], target):
        store.delete(_place(spark, aside)[0], True)
        raise OSError(f"{path} could not be put in place")
    store.create(spark._jvm.org.apache.hadoop.fs.Path(target, COMMITTED), True).close()


def is_committed(spark: SparkSession, path: str) -> bool:
    place, store = _place(spark, path)
    return bool(store.exists(spark._jvm.org.apache.hadoop.fs.Path(place, COMMITTED)))


def committed(spark: SparkSession, path: str) -> DataFrame:
    """A committed result; an error if there is none."""
    if not is_committed(spark, path):
        raise FileNotFoundError(f"no committed result at {path}")
    return spark.read.parquet(path)
