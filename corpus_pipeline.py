"""The corpus pipeline: documents that pass the quality classifier and have a known language, one of each group of near
duplicates, packed into sequences of power-of-two lengths.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; all but the last return the
columns of documents. Labels for the classifier come from the labels table of sf_dir, under the same rule as op7's.

Defined results of the stages: a null or empty text is scored like others by `quality`, has no language and goes in `language`, is linked
with nothing in `near_duplicates` and has one token in `pack`; long texts count whole; of copies the smallest id stays; rows
that repeat an id are filtered alike and one of them stays in `near_duplicates`; rows without an id are filtered by their text and
stay there; empty tables give empty results; other columns are carried through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import hdc_language, metric_join, packing, quality_trees
from quillmesh.storage import table, written

#: A document's language is known if its best cosine is at least this: eight deviations of the cosine of unrelated vectors, and
#: below the 0.1 % quantile of training documents (0.175 at sf0.1). Unlearnt scripts and random letters were at most at 0.083.
LEAST_COSINE = 0.125


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least quality_trees.KEEP."""
    labels = table(spark, sf_dir, "labels").where(quality_trees.may_teach()).select("doc_id", "quality")
    return quality_trees.keep_good(docs, quality_trees.learn(docs, labels))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language that is learnt from the stage's own documents."""
    return hdc_language.keep_known(docs, hdc_language.learn(hdc_language.training_rows(docs)), LEAST_COSINE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    return metric_join.keep_representatives(docs, k=5, num=80, den=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as op8's."""
    return packing.pack_power_of_two(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", pack)]
#: Boosted trees and tokenizers are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
