"""Self-supervised embeddings by mutual information with the graph's summary: encoders of two layers, all relations in the same passes.

For each relation H1 = PReLU(A x W1 + b1), z = PReLU(A H1 W2 + b2). A discriminator sigmoid(z M s), with the summary s = sigmoid(mean z),
tells the z of the graph from those of the same graph with features dealt to other nodes. A x is a constant of each node, for real
and dealt features, so blocks packed as in `networks` hold all that the gradient needs; an epoch is three passes over the rows that count
(in single precision within a block, in double across blocks): the summary, the gradient with the summary fixed, and its part that goes through the summary. Training of a relation stops when its loss has not
fallen for `patience` epochs; the epoch with the least loss counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.encoders import Moments
from quillmesh.operators.networks import Block, over_blocks, packed_blocks, trimmed, unpacked


def sizes(inputs: int, hidden: int, dim: int) -> list[tuple[int, ...]]:
    """W1, b1, slopes, W2, b2, slopes, M."""
    return [(inputs, hidden), (hidden,), (hidden,), (hidden, dim), (dim,), (dim,), (dim, dim)]


def parts(theta: np.ndarray, inputs: int, hidden: int, dim: int) -> list[np.ndarray]:
    out, at = [], 0
    for s in sizes(inputs, hidden, dim):
        out.append(theta[at : at + math.prod(s)].reshape(s))
        at += math.prod(s)
    return out


def start(rng: np.random.Generator, inputs: int, hidden: int, dim: int) -> np.ndarray:
    made = [rng.normal(size=s) / math.sqrt(s[0]) if len(s) == 2 else np.zeros(s) for s in sizes(inputs, hidden, dim)]
    made[2][:], made[5][:] = 0.25, 0.25
    made[6] /= math.sqrt(dim)
    return np.concatenate([m.ravel() for m in made])


def encode(p: Sequence[np.ndarray], block: Block, values: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(z of the own nodes, what the way back needs)."""
    w1, b1, a1, w2, b2, a2, _ = p
    pre1 = values @ w1 + b1
    mixed = block.near(0, np.where(pre1 > 0, pre1, a1 * pre1))
    pre2 = mixed @ w2 + b2
    return np.where(pre2 > 0, pre2, a2 * pre2), (values, pre1, mixed, pre2)


def back(p: Sequence[np.ndarray], block: Block, kept: tuple, dz: np.ndarray) -> list[np.ndarray]:
    """Gradients of W1, b1, slopes, W2, b2, slopes from those of z."""
    _, _, a1, w2, _, a2, _ = p
    values, pre1, mixed, pre2 = kept
    d2 = np.where(pre2 > 0, dz, a2 * dz)
    dh = block.back(0, d2 @ w2.T)
    d1 = np.where(pre1 > 0, dh, a1 * dh)
    slopes = np.einsum("nh,nh->h", np.minimum(pre1, 0), dh), np.einsum("nh,nh->h", np.minimum(pre2, 0), dz)
    return [values.T @ d1, d1.sum(0, dtype=float), slopes[0], mixed.T @ d2, d2.sum(0, dtype=float), slopes[1]]


def _own_parts(theta: np.ndarray, block: Block, k: int, hidden: int, dim: int) -> list[np.ndarray]:
    """In the precision of the block's values."""
    return parts(theta.astype(block.values.dtype), k, hidden, dim)


def summary_of(theta: np.ndarray, block: Block, k: int, hidden: int, dim: int) -> np.ndarray:
    """The sum of z over the rows that count."""
    return encode(_own_parts(theta, block, k, hidden, dim), block, block.values[:, :k])[0][block.facts[:, 0] == 1].sum(0, dtype=float)


def gradient(theta: np.ndarray, block: Block, mean: np.ndarray, k: int, hidden: int, dim: int) -> np.ndarray:
    """Sums over the rows that count: the gradient with the summary fixed, the loss's derivative by the summary, the loss."""
    p, s = _own_parts(theta, block, k, hidden, dim), 1 / (1 + np.exp(-mean))
    m, counts = p[6].astype(float), block.facts[:, 0] == 1
    asked = m @ s
    total, dm, ds, loss = None, np.zeros((dim, dim)), np.zeros(dim), 0.0
    for values, real in ((block.values[:, :k], 1.0), (block.values[:, k:], 0.0)):
        z, kept = encode(p, block, values)
        margin = z @ asked
        loss += float((np.logaddexp(0, margin) - real * margin)[counts].sum())
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - real) * counts
        seen = error @ z
        dm += np.outer(seen, s)
        ds += m.T @ seen
        made = back(p, block, kept, np.outer(error.astype(z.dtype), asked.astype(z.dtype)))
        total = made if total is None else [a + b for a, b in zip(total, made, strict=True)]
    return np.concatenate([*[g.ravel() for g in total], dm.ravel(), ds, [loss]])


def through_summary(theta: np.ndarray, block: Block, dmean: np.ndarray, k: int, hidden: int, dim: int) -> np.ndarray:
    """The gradient's other part: each z that counts moves the mean, and so the summary."""
    p = _own_parts(theta, block, k, hidden, dim)
    z, kept = encode(p, block, block.values[:, :k])
    made = back(p, block, kept, np.outer(block.facts[:, 0] == 1, dmean).astype(z.dtype))
    return np.concatenate([*[g.ravel() for g in made], np.zeros(dim * dim)])


def train_infomax(rows: DataFrame, weights: DataFrame, relations: Sequence[str], columns: list[str], noise: list[str], hidden: int = 64, dim: int = 64, epochs: int = 30, patience: int = 5, rate: float = 0.01, seed: int = 3, block_nodes: int | None = None) -> tuple[DataFrame, list[list[float]], np.ndarray]:
    """((relation, node_id, z1..zdim), losses of the epochs of each relation, weights of each relation's encoder). rows: relation, node_id, propagated features `columns`, the
    same of dealt features (`noise`), and loss (whether the row counts in loss and summary: test rows do not); weights:
    (relation, node_id, nb, w), the same propagation."""
    k, count, blocks = len(columns), len(relations), None
    for i, r in enumerate(relations):
        own = rows.where(F.col("relation") == r).withColumn("at", F.lit(i)).withColumn("loss", F.col("loss").cast("int"))
        made = packed_blocks(own, [*columns, *noise], weights, [r], facts=("loss", "at"), block_nodes=block_nodes)
        blocks = made if blocks is None else blocks.unionByName(made)

    counting = trimmed(blocks, 2 * k, 2, lambda b: b.facts[:, 0] == 1)

    def over(width: int, part: Callable[[int, Block], np.ndarray], active: Sequence[int]) -> np.ndarray:
        def one(block: Block) -> np.ndarray:
            out, i = np.zeros((count, width)), int(block.facts[0, 1])
            if i in active:
                out[i] = part(i, block)
            return out.ravel()

        return over_blocks(counting, count * width, one, 2 * k, 2, np.float32).reshape(count, width)

    n = np.maximum(over(1, lambda i, b: np.array([(b.facts[:, 0] == 1).sum()], float), range(count)), 1)
    size = sum(map(math.prod, sizes(k, hidden, dim)))
    theta = np.array([start(np.random.default_rng([seed, i]), k, hidden, dim) for i in range(count)])
    moments, losses = [Moments(size, rate) for _ in relations], [[] for _ in relations]
    best, least, waited, active = theta.copy(), np.full(count, np.inf), np.zeros(count, int), list(range(count))
    for _ in range(epochs):
        if not active:
            break
        mean = over(dim, lambda i, b, t=theta: summary_of(t[i], b, k, hidden, dim), active) / n
        found = over(size + dim + 1, lambda i, b, t=theta, mu=mean: gradient(t[i], b, mu[i], k, hidden, dim), active) / n
        s = 1 / (1 + np.exp(-mean))
        dmean = found[:, size:-1] * s * (1 - s)
        through = over(size, lambda i, b, t=theta, d=dmean: through_summary(t[i], b, d[i], k, hidden, dim), active) / n
        theta = theta.copy()
        for i in list(active):
            losses[i].append(float(found[i, -1]))
            waited[i] += 1
            if found[i, -1] < least[i]:
                best[i], least[i], waited[i] = theta[i], found[i, -1], 0
            theta[i] = theta[i] - moments[i].step(found[i, :size] + through[i])
            if waited[i] >= patience:
                active.remove(i)
    names = [f"z{i + 1}" for i in range(dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in unpacked(batch, 2 * k, 2):
                i = int(block.facts[0, 1])
                z = np.round(encode(parts(best[i], k, hidden, dim), block, block.values[:, :k])[0], 6)
                yield pa.record_batch([pa.array([relations[i]] * block.own), pa.array(block.ids[: block.own]), *[pa.array(z[:, c]) for c in range(dim)]], ["relation", "node_id", *names])

    return blocks.mapInArrow(run, "relation string, node_id long, " + ", ".join(f"{c} double" for c in names)), losses, best
