"""Document quality by histogram gradient-boosted trees over document statistics.

The forest is fitted on the driver on the statistics of at most SAMPLE labelled documents, those with the smallest seeded hash
of doc_id. Their ids are chosen from the narrow labels and broadcast (a bounded number), so texts are never shuffled. Every
document's statistics are then computed and scored in one pass, all trees at once.

Defined results: a null text is an empty one and has a score like all others; whole texts count, however long; equal texts have equal
scores; repeated rows and null ids pass through; an empty table gives no row; other columns, those named as results too, are
not read (the filter keeps them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.forest import Forest, fit
from quillmesh.llm.docstats import FEATURES, feature_rows
from quillmesh.llm.textscan import small_batches

SAMPLE = 20_000
KEEP = 0.7

_STATS = pa.schema([("id", pa.int64()), ("stats", pa.list_(pa.float32()))])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<float>) of every row, in the order of FEATURES; a null text is an empty one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = np.concatenate(list(feature_rows(batch.column(1))))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, every.size + 1, every.shape[1], dtype=np.int32)), pa.array(every.reshape(-1)))
                yield pa.record_batch([batch.column(0), flat], schema=_STATS)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, stats array<float>").withColumnRenamed("id", id_col)


def smallest_hashes(own: DataFrame, count: int, id_col: str, seed: int) -> DataFrame:
    """The rows with the `count` smallest seeded hashes of their id. A threshold on the hash, from the number of rows, bounds
    what the tasks send to the driver before the exact cut."""
    total = own.count()
    hashed = own.withColumn("__h", F.xxhash64(id_col, F.lit(seed)))
    if total > 4 * count:
        hashed = hashed.where(F.shiftrightunsigned("__h", 32) < int(2 * count / total * (1 << 32)))
    return hashed.orderBy("__h", id_col).limit(count).drop("__h")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """The forest of labelled documents. Null labels are left out; of contradicting labels of one id the more frequent counts,
    1 on a tie. Without labelled documents, or with one label, every score is the smoothed share of label 1."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("of")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    label = {r.of: r.y for r in smallest_hashes(own, sample, "of", 3).collect()}
    chosen = docs.sparkSession.createDataFrame(list(label.items()), "of long, y int")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = document_statistics(text.join(F.broadcast(chosen.select("of")), F.col("id") == F.col("of"), "left_semi"), "id", "text")
    rows = sorted({(r.id, tuple(r.stats)) for r in found.collect()})
    x = np.array([s for _, s in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([label[i] for i, _ in rows], float))


def _scores(texts: pa.Array, forest: Forest) -> np.ndarray:
    return np.round(np.concatenate([forest.probability(x.astype(float)) for x in feature_rows(texts)]), 9)


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; a null text is an empty one. Null ids and repeated rows pass through."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pa.array(_scores(batch.column(1), forest))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, forest: Forest, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is at least `keep`; one pass without a shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_scores(batch.column(batch.schema.get_field_index(text_col)), forest) >= keep))

    return docs.mapInArrow(run, docs.schema)


def may_teach(id_col: str = "doc_id"):
    """Rows whose labels may be learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def quality_of_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (see the module's text for null, empty, long and repeated ones)."""
    forest = learn(docs, labels.where(may_teach()).select("doc_id", "quality"))
    scored = score(docs, forest)
    return scored.select("doc_id", F.coalesce(~may_teach(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))
