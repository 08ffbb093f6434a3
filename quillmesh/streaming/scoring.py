"""Structured streaming forms of request-time scoring and of event counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import forest


def score_stream(rows: DataFrame, model: forest.Forest, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """(node_id, prob, predicted) of a stream (or a table) of node_id and columns: stateless, so any trigger and any number of
    restarts give each row the same score. Nulls count as 0."""
    scored = forest.scored(rows, columns, ["prob"], lambda x: np.round(model.probability(x), 6))
    return scored.select("node_id", "prob", (F.col("prob") >= threshold).cast("int").alias("predicted"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) of events by window; rows later than `late` behind the newest are dropped, and so is the state of windows
    that old."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")
