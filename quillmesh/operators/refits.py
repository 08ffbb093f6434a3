"""What survives refitting: other seeds and near-best settings, fitted side by side and attributed in one pass over the rows.

Fits are made in tasks on the bounded training sample; attributions are exact interventional Shapley values over all rows to explain,
of which only sums of absolute values, one for each fit and column, leave the tasks.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import forest
from quillmesh.operators.models import fan_out


@dataclass(frozen=True)
class Settings:
    trees: int = 20
    depth: int = 3
    rate: float = 0.15
    share: float = 0.8

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 13) -> forest.Forest:
        return forest.fit(x, y, trees=self.trees, depth=self.depth, rate=self.rate, share=self.share, seed=seed)


GRID = tuple(Settings(t, d, r) for t, d, r in itertools.product((10, 20, 40), (2, 3, 4), (0.1, 0.2)))


def settings_scores(rows: DataFrame, columns: list[str], grid: Sequence[Settings] = GRID) -> DataFrame:
    """(setting, trees, depth, rate, share, fold, ap): each setting fitted outside each saved fold and scored on it, a task each. rows:
    node_id, columns, label, fold."""
    _, x, y, fold = forest.sampled(rows, columns)

    def work(i: int, k: int) -> list[tuple]:
        made = grid[i].fit(x[fold != k], y[fold != k])
        return [(i, *asdict(grid[i]).values(), k, round(forest.ranking_score(y[fold == k], made.margin(x[fold == k])), 6))]

    jobs = [(i, int(k)) for i in range(len(grid)) for k in np.unique(fold)]
    return fan_out(rows.sparkSession, jobs, work, "setting long, trees long, depth long, rate double, share double, fold long, ap double")


def near_best(scores: DataFrame) -> DataFrame:
    """(setting, cv_mean, cv_sd, role) of the best setting by mean score over folds (`best`; on a tie the first) and of those within one of its
    standard deviations (`near`)."""
    means = scores.groupBy("setting").agg(F.round(F.avg("ap"), 9).alias("cv_mean"), F.round(F.coalesce(F.stddev_pop("ap"), F.lit(0.0)), 9).alias("cv_sd"))
    top = means.agg(F.max_by(F.struct("setting", "cv_mean", "cv_sd"), F.struct(F.round("cv_mean", 12), -F.col("setting"))).alias("t")).select("t.*").first()
    if top is None or top.setting is None:
        return means.select("*", F.lit("near").alias("role")).limit(0)
    return means.where(F.col("cv_mean") >= top.cv_mean - top.cv_sd - 1e-12).withColumn("role", F.when(F.col("setting") == top.setting, "best").otherwise("near"))


def fitted(rows: DataFrame, columns: list[str], fits: Sequence[tuple[str, Settings, int, int]]) -> list[tuple[str, forest.Forest]]:
    """Forests (name, settings, seed, fold left out or -1), fitted in tasks."""
    _, x, y, fold = forest.sampled(rows, columns)

    def work(i: int) -> list[tuple]:
        _, settings, seed, out = fits[i]
        return [(i, pickle.dumps(settings.fit(x[fold != out], y[fold != out], seed)))]

    made = {r.i: pickle.loads(r.model) for r in fan_out(rows.sparkSession, [(i,) for i in range(len(fits))], work, "i long, model binary").collect()}
    return [(fits[i][0], made[i]) for i in range(len(fits))]


def importance_by_fit(rows: DataFrame, columns: list[str], fits: Sequence[tuple[str, forest.Forest]], background: np.ndarray) -> DataFrame:
    """(fit, name, importance): the mean absolute interventional Shapley value of each column over all rows, for every fit, in one pass."""
    size = len(fits) * len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(fits), len(columns))), 0
        for batch in batches:
            if batch.num_rows:
                x = np.nan_to_num(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float))
                total += np.array([np.abs(f.shapley_against(x, background)).sum(0) for _, f in fits])
                n += len(x)
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(total.ravel()), pa.array(np.full(size, n))], ["place", "total", "n"])

    sums = rows.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "place long, total double, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    names = rows.sparkSession.createDataFrame([(i * len(columns) + j, f, c) for i, (f, _) in enumerate(fits) for j, c in enumerate(columns)], "place long, fit string, name string")
    return names.join(sums, "place").select("fit", "name", F.round(F.col("total") / F.greatest("n", F.lit(1)), 9).alias("importance"))
