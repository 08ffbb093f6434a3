"""A trained graph attention layer over several relations, by full-batch passes over edges and nodes.

out_i = x_i R + b + sum over relations of (sum over neighbours j of alpha_ij h_j), h = x W, alpha the softmax over a target's edges of
LeakyReLU(h_i a_dst + h_j a_src), for each head; a node's margin is relu(out) v + c.

Nodes are packed once into blocks with their neighbours' features and the edges that lead to them, as in `networks`: h is made once for
each node of a block, a target's softmax lies within its block, and an epoch is one pass without a shuffle. Only sums, as many as
there are weights, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.encoders import Moments
from quillmesh.operators.networks import Block, over_blocks, packed_blocks, unpacked
from quillmesh.storage import written

SLOPE = 0.2
#: Edges of an Arrow batch of logits.
LOGIT_ROWS = 1 << 15


@dataclass
class Shape:
    inputs: int
    relations: int
    heads: int
    channels: int

    @property
    def dim(self) -> int:
        return self.heads * self.channels

    @property
    def size(self) -> int:
        return self.relations * (self.inputs * self.dim + 2 * self.dim) + self.inputs * self.dim + 2 * self.dim + 1

    def relation(self, theta: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """W, a_src and a_dst (heads x channels) of a relation; views."""
        k = self.inputs * self.dim + 2 * self.dim
        own = theta[r * k : (r + 1) * k]
        at = self.inputs * self.dim
        return own[:at].reshape(self.inputs, self.dim), own[at : at + self.dim].reshape(self.heads, -1), own[at + self.dim :].reshape(self.heads, -1)

    def root(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """R, b, v and c; views."""
        own = theta[self.relations * (self.inputs * self.dim + 2 * self.dim) :]
        at = self.inputs * self.dim
        return own[:at].reshape(self.inputs, self.dim), own[at : at + self.dim], own[at + self.dim : at + 2 * self.dim], own[-1:]


def _edge(shape: Shape, theta: np.ndarray, r: int, xt: np.ndarray, xn: np.ndarray) -> tuple[np.ndarray, ...]:
    """(h of the neighbour, h of the target, what the rectifier saw, exp(e)) of edges of relation r."""
    w, src, dst = shape.relation(theta, r)
    hn, ht = ((x @ w).reshape(len(x), shape.heads, shape.channels) for x in (xn, xt))
    u = (hn * src).sum(2) + (ht * dst).sum(2)
    return hn, ht, u, np.exp(np.clip(np.where(u > 0, u, SLOPE * u), -30, 30))


def edge_sums(shape: Shape, theta: np.ndarray, relation: np.ndarray, xt: np.ndarray, xn: np.ndarray) -> np.ndarray:
    """edges x (relations * (heads + dim)): exp(e) and exp(e) h at the place of the edge's relation, else 0."""
    k = shape.heads + shape.dim
    out = np.zeros((len(xt), shape.relations * k))
    for r in range(shape.relations):
        own = np.flatnonzero(relation == r)
        hn, _, _, e = _edge(shape, theta, r, xt[own], xn[own])
        out[own, r * k : (r + 1) * k] = np.concatenate([e, (e[:, :, None] * hn).reshape(len(own), shape.dim)], 1)
    return out


def node_out(shape: Shape, theta: np.ndarray, x: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(margins, out, means over the neighbours of each relation) of nodes with their targets' sums."""
    root, b, v, c = shape.root(theta)
    k, out, means = shape.heads + shape.dim, x @ root + b, []
    for r in range(shape.relations):
        z, s = sums[:, r * k : r * k + shape.heads], sums[:, r * k + shape.heads : (r + 1) * k].reshape(len(x), shape.heads, shape.channels)
        means.append(s / np.maximum(z, 1e-300)[:, :, None] * (z > 0)[:, :, None])
        out = out + means[-1].reshape(len(x), shape.dim)
    return np.maximum(out, 0) @ v + c[0], out, means


def node_gradient(shape: Shape, theta: np.ndarray, x: np.ndarray, sums: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(gradient of the root's weights at their places, gradient of out for each node, loss)."""
    total = np.zeros(shape.size)
    g_root, g_b, g_v, g_c = shape.root(total)
    margin, out, _ = node_out(shape, theta, x, sums)
    error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
    below = np.outer(error, shape.root(theta)[2]) * (out > 0)
    g_root += x.T @ below
    g_b += below.sum(0)
    g_v += np.maximum(out, 0).T @ error
    g_c += error.sum()
    return total, below, float((weight * (np.logaddexp(0, margin) - y * margin)).sum())


def edge_gradient(shape: Shape, theta: np.ndarray, relation: np.ndarray, xt: np.ndarray, xn: np.ndarray, sums: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The gradient of the relations' weights from edges with their targets' sums and gradients of out."""
    total = np.zeros(shape.size)
    k = shape.heads + shape.dim
    for r in range(shape.relations):
        own = np.flatnonzero(relation == r)
        if not len(own):
            continue
        g_w, g_src, g_dst = shape.relation(total, r)
        _, src, dst = shape.relation(theta, r)
        hn, ht, u, e = _edge(shape, theta, r, xt[own], xn[own])
        z, s = sums[own, r * k : r * k + shape.heads], sums[own, r * k + shape.heads : (r + 1) * k].reshape(len(own), shape.heads, shape.channels)
        g = below[own].reshape(len(own), shape.heads, shape.channels)
        alpha = e / np.maximum(z, 1e-300)
        du = alpha * ((g * hn).sum(2) - (g * s).sum(2) / np.maximum(z, 1e-300)) * np.where(u > 0, 1, SLOPE)
        g_src += (du[:, :, None] * hn).sum(0)
        g_dst += (du[:, :, None] * ht).sum(0)
        g_w += xn[own].T @ (alpha[:, :, None] * g + du[:, :, None] * src).reshape(len(own), shape.dim) + xt[own].T @ (du[:, :, None] * dst).reshape(len(own), shape.dim)
    return total


def _firsts(to: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))


def block_sums(shape: Shape, theta: np.ndarray, block: Block) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(sums of the own nodes, as edge_sums gives them; for each relation h of all places and exp(e) of its edges)."""
    k, kept = shape.heads + shape.dim, []
    sums = np.zeros((block.own, shape.relations * k))
    for r in range(shape.relations):
        w, src, dst = shape.relation(theta, r)
        to, place, _ = block.edges[r]
        h = (block.values @ w).reshape(-1, shape.heads, shape.channels)
        u = (h * src).sum(2)[place] + (h[: block.own] * dst).sum(2)[to]
        e = np.exp(np.clip(np.where(u > 0, u, SLOPE * u), -30, 30))
        if len(to):
            first = _firsts(to)
            sums[to[first], r * k : r * k + shape.heads] = np.add.reduceat(e, first, axis=0)
            sums[to[first], r * k + shape.heads : (r + 1) * k] = np.add.reduceat((e[:, :, None] * h[place]).reshape(len(to), shape.dim), first, axis=0)
        kept.append((h, e))
    return sums, kept


def block_gradient(shape: Shape, theta: np.ndarray, block: Block, up: float, weight_sum: float) -> np.ndarray:
    """The block's part of the gradient, and of the loss at the end."""
    sums, kept = block_sums(shape, theta, block)
    y = block.facts[:, 0]
    weight = np.where(y < 0, 0.0, np.where(y == 1, up, 1.0)) / weight_sum
    total, below, loss = node_gradient(shape, theta, block.values[: block.own], sums, np.maximum(y, 0).astype(float), weight)
    k, g = shape.heads + shape.dim, below.reshape(-1, shape.heads, shape.channels)
    for r, (h, e) in enumerate(kept):
        to, place, _ = block.edges[r]
        if not len(to):
            continue
        g_w, g_src, g_dst = shape.relation(total, r)
        _, src, dst = shape.relation(theta, r)
        z, s = np.maximum(sums[:, r * k : r * k + shape.heads], 1e-300), sums[:, r * k + shape.heads : (r + 1) * k].reshape(g.shape)
        alpha, g_to = e / z[to], g[to]
        # What the rectifier saw is above 0 where exp(e) is above 1.
        du = alpha * ((g_to * h[place]).sum(2) - ((g * s).sum(2) / z)[to]) * np.where(e > 1, 1, SLOPE)
        at, back = np.zeros((block.own, shape.heads)), (alpha[:, :, None] * g_to).reshape(len(to), shape.dim)
        first, n = _firsts(to), len(block.ids)
        at[to[first]] = np.add.reduceat(du, first, axis=0)
        near = np.stack([np.bincount(place, c, n) for c in du.T], 1)
        through = np.stack([np.bincount(place, c, n) for c in back.T], 1) + (near[:, :, None] * src).reshape(n, shape.dim)
        g_src += (near[:, :, None] * h).sum(0)
        g_dst += (at[:, :, None] * h[: block.own]).sum(0)
        g_w += block.values.T @ through + block.values[: block.own].T @ (at[:, :, None] * dst).reshape(block.own, shape.dim)
    return np.append(total, loss)


def train_gat(nodes: DataFrame, edges: DataFrame, columns: list[str], relations: list[str], heads: int = 2, channels: int = 4, epochs: int = 15, rate: float = 0.1, seed: int = 7, block_nodes: int | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """((node_id, prob), (relation, target, neighbour, head, e), losses): scores of all nodes and the attention logits of all edges, from
    a layer trained on the nodes with a label; positives weigh as negatives do together. nodes: node_id, standardised columns,
    label (null: not trained on); edges: relation, node_id, nb, in both directions."""
    k, shape = len(columns), Shape(len(columns), len(relations), heads, channels)
    own = written(nodes.select(F.col("node_id").cast("long").alias("node_id"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col("label").cast("long").alias("label")), "gat-nodes")
    ids = own.select("node_id")
    e = edges.where(F.col("relation").isin(relations)).select("relation", F.col("node_id").cast("long").alias("node_id"), F.col("nb").cast("long").alias("nb"), F.lit(1.0).alias("w"))
    e = e.join(ids, "node_id", "left_semi").join(ids.withColumnRenamed("node_id", "nb"), "nb", "left_semi")
    blocks = packed_blocks(own, [f"x{i}" for i in range(k)], written(e, "gat-edges"), relations, facts=("label",), block_nodes=block_nodes)
    stats = own.agg(F.count("label").alias("n"), F.sum("label").alias("p")).first()
    up = (stats.n - stats.p) / stats.p if stats.p else 1.0
    weight_sum = max((stats.n - (stats.p or 0)) + up * (stats.p or 0), 1e-300)
    rng, theta = np.random.default_rng(seed), np.zeros(shape.size)
    for r in range(shape.relations):
        w, src, dst = shape.relation(theta, r)
        w[:], src[:], dst[:] = rng.normal(size=w.shape) / np.sqrt(k), 0.3 * rng.normal(size=src.shape), 0.3 * rng.normal(size=dst.shape)
    root, _, v, _ = shape.root(theta)
    root[:], v[:] = rng.normal(size=root.shape) / np.sqrt(k), rng.normal(size=v.shape) / np.sqrt(shape.dim)
    moments, losses, best, least = Moments(shape.size, rate), [], theta, np.inf

    for _ in range(epochs):
        found = over_blocks(blocks, shape.size + 1, lambda b, now=theta: block_gradient(shape, now, b, up, weight_sum), k, 1)
        losses.append(float(found[-1]))
        if losses[-1] < least:
            best, least = theta, losses[-1]
        theta = theta - moments.step(found[:-1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in unpacked(batch, k, 1):
                margin = node_out(shape, best, block.values[: block.own], block_sums(shape, best, block)[0])[0]
                yield pa.record_batch([pa.array(block.ids[: block.own]), pa.array(np.round(1 / (1 + np.exp(-np.clip(margin, -30, 30))), 6))], ["node_id", "prob"])

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in unpacked(batch, k, 1):
                for r, (_, weights) in enumerate(block_sums(shape, best, block)[1]):
                    to, place, _ = block.edges[r]
                    for at in range(0, len(to), LOGIT_ROWS):
                        t, n, v = (x[at : at + LOGIT_ROWS] for x in (to, place, weights))
                        made = [[relations[r]] * (heads * len(t)), np.repeat(block.ids[t], heads), np.repeat(block.ids[n], heads), np.tile(np.arange(heads, dtype=np.int32), len(t)), np.round(np.log(v).ravel(), 9)]
                        yield pa.record_batch([pa.array(c) for c in made], ["relation", "target", "neighbour", "head", "e"])

    return blocks.mapInArrow(score, "node_id long, prob double"), blocks.mapInArrow(logits, "relation string, target long, neighbour long, head int, e double"), losses
