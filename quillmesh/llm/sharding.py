"""Proportional stratified interleaving: every shard is a small copy of the mixture of sources.

Rows are shuffled by a seeded hash and ranked within their source; row r of a source of m rows gets the fractional rank
(r + 1/2) / m. In the order of fractional ranks each source is spread evenly, so cutting that order into equal runs gives
shards whose counts differ by at most one (law `rows`) and whose shares of each source match the whole.

Both ranks are made without gathering a source in one task: rows are dealt into ranges of the shuffle hash (of the fractional
rank), ranges are counted with map-side combining, counts become offsets, and only the rows of one range are sorted together.
The number of ranges follows the number of rows. Texts are never shuffled: size and checksum are taken in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.storage import written

#: Rows in a range on average, and the least and most ranges. The counts of one group's ranges are added up in one task, so
#: their number is bounded; beyond it ranges hold more rows, which are sorted with spilling.
RANGE_ROWS = 5_000
LEAST_RANGES = 256
MOST_RANGES = 1 << 14


def _ranked(rows: DataFrame, within: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based rank by (bucket, order) within the groups `within`; bucket must be monotone in the order."""
    keyed = rows.withColumn("__b", bucket)
    counts = keyed.groupBy(*within, "__b").agg(F.count("*").alias("__n"))
    # One row for each range: a bounded number for each group, far below the rows themselves.
    before = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    at = counts.withColumn("__at", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = Window.partitionBy(*within, "__b").orderBy(*order)
    ranked = keyed.withColumn("__r", F.row_number().over(local) - 1)
    null_safe = [ranked[c].eqNullSafe(at[c]) for c in [*within, "__b"]]
    joined = ranked.join(at, _all(null_safe), "inner")
    return joined.select(*[ranked[c] for c in rows.columns], (F.col("__at") + F.col("__r")).alias(name))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def stratified_shards(rows: DataFrame, shards: int, key: str, source: str, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, shard, slot) of every row. A null source is a source of its own; repeated keys are ordered among
    themselves by the carried columns (rows equal in all of these are interchangeable); an empty table gives none."""
    used = rows.select(F.col(key).alias("__k"), F.col(source).alias("__s"), *[F.col(c).alias(f"__c_{c}") for c in carry])
    used = written(used.withColumn("__h", F.xxhash64("__k", F.lit(seed))), "shuffled")
    sizes = written(used.groupBy("__s").agg(F.count("*").alias("__m")), "sources")
    total = sizes.agg(F.sum("__m")).first()[0] or 0
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-total // RANGE_ROWS)))
    hashed = F.floor((F.shiftright("__h", 44) + (1 << 19)) * ranges / (1 << 20)).cast("long")
    ties = [F.col("__k"), *[F.col(f"__c_{c}") for c in carry]]
    ranked = _ranked(used, ["__s"], hashed, [F.col("__h"), *ties], "__rank")
    ranked = ranked.join(sizes.withColumnRenamed("__s", "__s2"), F.col("__s").eqNullSafe(F.col("__s2"))).drop("__s2")
    share = ((F.col("__rank") + 0.5) / F.col("__m")).cast("double")
    placed = ranked.withColumn("__f", share).withColumn("__sh", F.xxhash64("__s", F.lit(seed)))
    placed = written(placed, "shares").withColumn("__one", F.lit(0))
    placed = _ranked(placed, ["__one"], F.floor(F.col("__f") * ranges).cast("long"), [F.col("__f"), F.col("__sh"), F.col("__s"), F.col("__rank")], "__pos")
    rows_in_all = max(total, 1)
    placed = placed.withColumn("shard", F.expr(f"int((__pos * {shards}) div {rows_in_all})"))
    first = F.expr(f"(shard * {rows_in_all}L + {shards - 1}) div {shards}")
    return placed.select(F.col("__k").alias(key), *[F.col(f"__c_{c}").alias(c) for c in carry], F.col("shard"), (F.col("__pos") - first).cast("long").alias("slot"), F.col("__s").alias(source))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `rows`), source. A null text has no bytes; texts of
    any length count by their size and checksum only; null sources are one source; repeated rows and null ids are placed like
    others; an empty table gives no row; other columns are not read."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", "source", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    dealt = stratified_shards(rows, shards, "doc_id", "source", carry=("size", "text_crc32"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
