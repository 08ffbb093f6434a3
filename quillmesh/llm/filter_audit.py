"""Filter interaction audit: what each filter removes in every order of the filters, from one pass over the texts.

Five flags say which filters a document fails. `GROUP BY CUBE` over the flags and the part gives, for each subset S of the filters,
the row in which the flags of S are all false and the others are rolled up: the survivors of S. Whatever the order of filters,
a step takes the survivors of the filters so far to those of one more, so each of the 600 rows of a part is a join of two subsets.
Texts are read once and never shuffled: flags and a digest are taken in the scan, and copies are found by the least id of each
digest, joined back by id, so that a text with many copies stays spread out. The cube runs over counts by flags, not over rows.

Defined results: a null text is empty; a null source is the part '' (with the empty source); rows that repeat an id count as often
as they stand, and as copies only if a smaller id has their text; a null id is nobody's copy and makes none; a document that has
several labels is good or toxic if one of them says so; an empty table gives no row; long texts count whole; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.storage import written

FILTERS = "ABCDE"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(words) < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), "C": 100 * capitals > 5 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents by part and flags A to E: n, and of these good and toxic ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("id", "part", *[c.alias(f) for f, c in failures(F.col("t")).items()], F.sha2(F.col("t").cast("binary"), 256).alias("digest"))
    rows = written(rows, "flags")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = rows.join(first, ["id", "digest"], "left").join(known, "id", "left")
    rows = rows.withColumn("E", F.col("id").isNotNull() & F.col("first").isNull())
    return rows.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, passed, n, good, toxic): documents of a part that fail no filter of `passed`, a number with a bit for each filter. No
    row where there are none."""
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    chosen = sum((F.lit(b) * (1 - F.grouping(f)) for f, b in bits.items()), F.lit(0))
    cube = counts.cube(*FILTERS, "part").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), chosen.cast("int").alias("passed"), F.grouping("part").alias("every_part"))
    clear = [~F.coalesce(F.col(f), F.lit(False)) for f in FILTERS]
    return cube.where((F.col("every_part") == 0) & clear[0] & clear[1] & clear[2] & clear[3] & clear[4]).select("part", "passed", "n", "good", "toxic")


def audit(counts: DataFrame) -> DataFrame:
    """The audit of counts as made by `flagged`: one row for each part, order of filters and step."""
    counts = written(counts, "flag-counts")
    alive = written(survivors(counts), "survivors")
    every = (1 << len(FILTERS)) - 1
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for k, i in enumerate(order):
            steps.append((name, k + 1, FILTERS[i], before, before | 1 << i, 1 << i, every & ~(1 << i)))
            before |= 1 << i
    spark = counts.sparkSession
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int, alone int, others int"))
    # A subset without survivors has no row in the cube: every part gets every subset, with 0 there.
    parts = alive.where("passed = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(every))).alias("passed"))
    alive = written(parts.join(alive, ["part", "passed"], "left").fillna(0, ["n", "good", "toxic"]), "subsets")

    def subset(column: str, *of: str) -> DataFrame:
        """The survivors of the subset in `column`, as columns <column>_<count>."""
        return alive.select("part", F.col("passed").alias(column), *[F.col(c).alias(f"{column}_{c}") for c in of])

    rows = subset("before", "n", "good", "toxic").join(steps, "before").join(subset("after", "n", "good", "toxic"), ["part", "after"])
    rows = rows.join(subset("alone", "n"), ["part", "alone"]).join(subset("others", "n"), ["part", "others"])
    ends = alive.groupBy("part").agg(F.max(F.when(F.col("passed") == 0, F.col("n"))).alias("none_n"), F.max(F.when(F.col("passed") == every, F.col("n"))).alias("all_n"))
    rows = rows.join(ends, "part").withColumn("removed", F.col("before_n") - F.col("after_n"))
    shapley = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    rows = rows.join(shapley, ["part", "filter"])
    return rows.select("part", "filter_order", "step", F.col("after_n").alias("kept"), "removed", (F.col("none_n") - F.col("alone_n") - F.col("removed")).alias("redundant"), (F.col("others_n") - F.col("all_n")).alias("unique_fails"), (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: see the module."""
    return audit(flagged(docs, labels))
