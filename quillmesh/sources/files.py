"""Sources and sinks: checked appends, verified digests, exactly-one lookups, coordinate-format matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a path; hashing runs on the executors."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two digest tables."""
    both = before.select("path", F.col("sha256").alias("a")).join(after.select("path", F.col("sha256").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def append_entry(rows: DataFrame, path: str, run_id: str, forbidden: tuple[str, ...] = ("node_id", "label"), most: int = 1000) -> None:
    """Append one entry's result rows under its run id: no row-level columns, at most `most` rows, no second entry of that id."""
    bad = [c for c in rows.columns if c in forbidden]
    if bad:
        raise ValueError(f"row-level columns in results: {bad}")
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    rows.withColumn("run_id", F.lit(run_id)).write.mode("errorifexists").parquet(f"{path}/{run_id}")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries' rows; columns that an entry lacks are null."""
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)


def write_partitioned(edges: DataFrame, path: str) -> None:
    """Edges by relation, sorted, so that a read of one relation prunes the others."""
    edges.repartition("relation").sortWithinPartitions("src", "dst").write.mode("overwrite").partitionBy("relation").parquet(path)


def exactly_one(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """The only file that matches a glob; an error if there are none or several."""
    found = spark.read.format(fmt).options(**options).load(path)
    files = found.select(F.input_file_name()).distinct().limit(2).count()
    if files != 1:
        raise ValueError(f"{'no file' if not files else 'several files'} at {path}")
    return found


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value): entries of coordinate text files with 1-based indices, % comments and an optional value (else 1), from any
    store that Spark reads; files are split as Spark splits text."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.col("value").startswith("%")).select(parts.alias("p")).where("size(p) in (2, 3)")
    return lines.select((F.col("p")[0].cast("long") - 1).alias("row"), (F.col("p")[1].cast("long") - 1).alias("col"), F.coalesce(F.get("p", F.lit(2)).cast("double"), F.lit(1.0)).alias("value"))
