"""The most used operators with named arguments; `operator` applies any registered template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.plans import registry  # noqa: F401  defines the templates
from quillmesh.plans.dialect import LIBRARY


def _none(name: str) -> DataFrame:
    raise ValueError(f"the operator needs the input {name}")


def operator(name: str, **inputs: DataFrame) -> DataFrame:
    """The template operator `name` on given inputs (see LIBRARY.sql[name] for their names and columns)."""
    spark = next(iter(inputs.values())).sparkSession
    return LIBRARY.apply(spark, name, _none, inputs)


def neighbour_block(own: DataFrame, edges: DataFrame, columns: list[str], name: str = "nbr") -> DataFrame:
    """One row for each node: for every relation of `edges` (relation, src, dst; undirected, each edge once) the mean of every
    column over the neighbours, 0 without any, and ln(1 + degree). The relations are few and are listed first.

    Only the used columns travel along the edges, and sums are combined before their shuffle by node."""
    relations = sorted(r.relation for r in edges.select("relation").distinct().collect())
    both = edges.select("relation", F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.col("dst").alias("nb")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("nb")))).alias("e")).select("relation", "e.node_id", "e.nb")
    joined = both.join(own.select(F.col("node_id").alias("nb"), *columns), "nb")
    sums = joined.groupBy("node_id").agg(
        *[F.avg(F.when(F.col("relation") == r, F.col(c))).alias(f"{name}__{r}_mean_{c.split('__')[-1]}") for r in relations for c in columns],
        *[F.log1p(F.count_if(F.col("relation") == r)).alias(f"{name}__{r}_log1p_degree") for r in relations],
    )
    return own.select("node_id").join(sums, "node_id", "left").fillna(0.0)


def average_precision(scores: DataFrame, by: list[str], score: str = "prob", label: str = "y") -> DataFrame:
    """(by, ap): the exact area under the precision-recall steps, ties taken together."""
    return _curve(scores, by, score, label).groupBy(*by).agg(F.sum(F.col("p") / F.nullif(F.col("pos"), F.lit(0)) * F.col("tp") / F.col("taken")).alias("ap"))


def auroc(scores: DataFrame, by: list[str], score: str = "prob", label: str = "y") -> DataFrame:
    """(by, auroc): the share of pairs in order, ties counting half; null with one class."""
    below = (F.col("total") - F.col("pos")) - (F.col("taken") - F.col("tp")) + 0.5 * (F.col("n") - F.col("p"))
    return _curve(scores, by, score, label).groupBy(*by).agg((F.sum(F.col("p") * below) / F.nullif(F.max(F.col("pos") * (F.col("total") - F.col("pos"))).cast("double"), F.lit(0.0))).alias("auroc"))


def _curve(scores: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    from pyspark.sql.window import Window

    whole = Window.partitionBy(*by)
    steps = whole.orderBy(F.desc("s"))
    grouped = scores.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    return grouped.select(*by, "s", "n", "p", F.sum("p").over(steps).alias("tp"), F.sum("n").over(steps).alias("taken"), F.sum("p").over(whole).alias("pos"), F.sum("n").over(whole).alias("total"))


def f1_threshold(scores: DataFrame, score: str = "prob", label: str = "y") -> DataFrame:
    """(threshold, f1): the largest F1, the highest threshold on a tie."""
    return operator("f1_threshold", scored=scores.select(F.col(score).alias("pa"), F.col(label).alias("y"), F.lit("train").alias("split")))


def holm(p_values: DataFrame, key: str, p: str = "p") -> DataFrame:
    """(key, p, adjusted): step-down adjusted p values."""
    return operator("holm", p_values=p_values.select(F.col(key).alias("contrast"), F.col(p).alias("p"))).withColumnRenamed("contrast", key)


def outcome_table(scores: DataFrame, threshold_a: float = 0.5, threshold_b: float = 0.5) -> DataFrame:
    """node_id, y, pa, pb, outcome, gap of two models' scores (node_id, y, pa, pb) at their thresholds."""
    cut = lambda t: scores.sparkSession.createDataFrame([(float(t),)], "threshold double")
    return operator("node_outcomes", test_scores=scores.select("node_id", "y", "pa", "pb"), f1_threshold=cut(threshold_a), f1_threshold_b=cut(threshold_b))
