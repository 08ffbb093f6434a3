"""What one edge means to a node's embedding: removal through an encoder of two layers, its projection and a score.

Without the edge between a target t and a neighbour n both have one neighbour less, so the weights 1 / sqrt((d_i + 1)(d_j + 1)) around both
change. Of the target's embedding only this changes: its own weights, the first-layer output of every neighbour u (whose weight to t
has changed, the same for all n), and that of neighbours u that t and n share (whose weight to n has changed too). So the sum over
neighbours is made once for each target, and each edge adds a correction of its own and one for each triangle it is in.
Triangles are listed from their end of least degree, so a hub costs no square of its degree.

Targets are dealt into blocks, as in `networks`. A block gets its nodes and their neighbours once each, the edges as pairs of ids and the
triangles as three ids; first-layer outputs of edges and triangles, many numbers each, are made and used inside the task and never
written. So one node's edges and triangles must fit a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.networks import block_of
from quillmesh.storage import written

#: W1, b1, slopes, W2, b2, slopes, as in infomax.parts.
Encoder = Sequence[np.ndarray]


def _rectified(pre: np.ndarray, slope: np.ndarray) -> np.ndarray:
    return np.where(pre > 0, pre, slope * pre)


def each_triangle(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """(t, b, c) for each triangle, once. edges: (t, u) both ways; degrees: (node_id, d)."""
    low = degrees.select(F.col("node_id").alias("t"), F.col("d").alias("dt"))
    high = degrees.select(F.col("node_id").alias("u"), F.col("d").alias("du"))
    up = written(edges.join(low, "t").join(high, "u").where("dt < du or dt = du and t < u").select("t", "u"), "upward")
    wedges = up.select("t", F.col("u").alias("b")).join(up.select("t", F.col("u").alias("c")), "t").where("b < c")
    return wedges.join(up.select(F.least("t", "u").alias("b"), F.greatest("t", "u").alias("c")), ["b", "c"]).select("t", "b", "c")


def triangles(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """(t, n, u) for each triangle, in all six orders."""
    ways = [F.struct(F.col(x).alias("t"), F.col(y).alias("n"), F.col(z).alias("u")) for x, y, z in itertools.permutations("tbc")]
    return each_triangle(edges, degrees).select(F.explode(F.array(*ways)).alias("w")).select("w.*")


def _by_key(key: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sums of rows with equal key, 0 to size - 1."""
    out = np.zeros((size, rows.shape[1]))
    if len(key):
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out[key[first]] = np.add.reduceat(rows[by], first, axis=0)
    return out


def removed_in_block(ids: np.ndarray, d: np.ndarray, x: np.ndarray, s: np.ndarray, edges: np.ndarray, corners: np.ndarray, own: np.ndarray, encoder: Encoder, score: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(targets, neighbours, moved, delta) for the edges of a block. ids (in order), degrees, features and what the first layer sees of its
    nodes and their neighbours; edges (target, neighbour) and corners (of triangles) as ids; own: which ids are targets."""
    w1, b1, a1, w2, b2, a2 = encoder[:6]
    first = lambda v: _rectified(v @ w1 + b1, a1)
    at = np.minimum(np.searchsorted(ids, edges), len(ids) - 1)
    at = at[(ids[at] == edges).all(1)]
    at = at[np.lexsort((at[:, 1], at[:, 0]))]
    t, u = at.T
    change = 1 / np.sqrt(np.maximum(d, 1)) - 1 / np.sqrt(d + 1)
    # The neighbours' first layer once t has a neighbour less, and as it is.
    without = s[u] + (change[t] / np.sqrt(d[u] + 1))[:, None] * x[t]
    once = first(without)
    g = once / np.sqrt(d[t] * (d[u] + 1))[:, None]
    all_g = _by_key(t, g, len(ids))
    all_h = _by_key(t, first(s)[u] / np.sqrt((d[t] + 1) * (d[u] + 1))[:, None], len(ids))
    # Triangles, in the orders whose first is a target here: n is the neighbour that goes, u the one that both share.
    place = np.searchsorted(ids, corners)
    ways = np.concatenate([place[:, w] for w in itertools.permutations(range(3))]) if len(place) else np.zeros((0, 3), int)
    ways = ways[own[ways[:, 0]]]
    key, n = t * len(ids) + u, ways[:, 1]
    gone, shared = (np.searchsorted(key, ways[:, 0] * len(ids) + ways[:, i]) for i in (1, 2))
    twice = first(without[shared] + (change[n] / np.sqrt(d[ways[:, 2]] + 1))[:, None] * x[n])
    c = _by_key(gone, (twice - once[shared]) / np.sqrt(d[ways[:, 0]] * (d[ways[:, 2]] + 1))[:, None], len(t))
    left = np.sqrt((d[t] + 1) / d[t])[:, None] * (s[t] - x[t] / (d[t] + 1)[:, None] - x[u] / np.sqrt((d[t] + 1) * (d[u] + 1))[:, None]) + x[t] / d[t][:, None]
    before = all_h[t] + first(s)[t] / (d[t] + 1)[:, None]
    after = all_g[t] - g + c + first(left) / d[t][:, None]
    z, w = _rectified(before @ w2 + b2, a2), _rectified(after @ w2 + b2, a2)
    return ids[t], ids[u], np.round(np.sqrt(((z - w) ** 2).sum(1)), 9), np.round(score(z) - score(w), 9)


def removal_through_encoder(values: DataFrame, columns: list[str], edges: DataFrame, encoder: Encoder, score: Callable[[np.ndarray], np.ndarray], block_nodes: int | None = None) -> DataFrame:
    """(target, neighbour, moved, delta): for each edge how far the target's embedding moves without it, and how far its score falls.
    values: node_id and the features `columns` of every node; edges: (node_id, nb) of one relation, both ways; score: of a matrix of
    embeddings."""
    xs, ss = ([f"{p}{i}" for i in range(len(columns))] for p in "xs")
    edges = written(edges.select(F.col("node_id").cast("long").alias("t"), F.col("nb").cast("long").alias("u")).distinct(), "edges")
    nodes = values.select(F.col("node_id").cast("long").alias("node_id"), *[F.col(c).cast("double").alias(x) for c, x in zip(columns, xs, strict=True)])
    degrees = written(nodes.select("node_id").join(edges.groupBy(F.col("t").alias("node_id")).agg(F.count("*").alias("d")), "node_id", "left").fillna(0, ["d"]), "degrees")
    nodes = nodes.join(degrees, "node_id")
    # What a node's first layer sees: its own row of the weights times the features.
    sent = nodes.select(F.col("node_id").alias("u"), *[(F.col(x) / F.sqrt(F.col("d") + 1)).alias(x) for x in xs])
    near = edges.join(sent, "u").groupBy(F.col("t").alias("node_id")).agg(*[F.sum(x).alias(s) for x, s in zip(xs, ss, strict=True)])
    seen = nodes.join(near, "node_id", "left").fillna(0.0, ss)
    nodes = written(seen.select("node_id", "d", *xs, *[(F.col(s) / F.sqrt(F.col("d") + 1) + F.col(x) / (F.col("d") + 1)).alias(s) for x, s in zip(xs, ss, strict=True)]), "seen")

    number = block_of(nodes, block_nodes)
    pairs = edges.select(number("t").alias("block"), "t", "u")
    around = pairs.select("block", F.col("u").alias("node_id")).distinct().join(nodes, "node_id").where(number("node_id") != F.col("block"))
    every = nodes.select(number("node_id").alias("block"), F.lit(True).alias("mine"), *nodes.columns).unionByName(around.select("block", F.lit(False).alias("mine"), *nodes.columns))
    corners = each_triangle(edges, degrees).select(F.explode(F.array_distinct(F.array(number("t"), number("b"), number("c")))).alias("block"), "t", F.col("b").alias("u"), F.col("c").alias("v"))
    links = pairs.select("*", F.lit(0).cast("long").alias("v"), F.lit(False).alias("closed")).unionByName(corners.select("*", F.lit(True).alias("closed")))

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        made: Sequence[np.ndarray] = [np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)]
        if len(n) and len(e):
            n = n.sort_values("node_id", kind="stable")
            closed = e["closed"].to_numpy(bool)
            triples = e.loc[closed, ["t", "u", "v"]].to_numpy(np.int64)
            made = removed_in_block(n["node_id"].to_numpy(), n["d"].to_numpy(float), n[xs].to_numpy(), n[ss].to_numpy(), e.loc[~closed, ["t", "u"]].to_numpy(np.int64), triples, n["mine"].to_numpy(), encoder, score)
        return pd.DataFrame(dict(zip(("target", "neighbour", "moved", "delta"), made, strict=True)))

    return every.groupBy("block").cogroup(links.groupBy("block")).applyInPandas(run, "target long, neighbour long, moved double, delta double")


def projected_score(z: np.ndarray, y: np.ndarray, places: int, fit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """The chance of label 1 from the first principal components of embeddings: `fit` gives weights (the last is the constant)."""
    mean = z.mean(0)
    axes = np.linalg.svd(z - mean, full_matrices=False)[2][:places].T
    weights = fit((z - mean) @ axes, y)
    return lambda v: 1 / (1 + np.exp(-np.clip((v - mean) @ axes @ weights[:-1] + weights[-1], -30, 30)))
