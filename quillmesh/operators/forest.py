"""Histogram gradient-boosted trees as flat arrays, with exact tree Shapley values.

Columns are cut into at most `bins` bins at training quantiles. A tree grows level by level: for all nodes of a level, one
weighted count for each column gives the gradient and hessian histograms, cumulative sums give every split's gain. Trees are complete
binary trees of one depth, so a forest is a few arrays (column, cut, leaf value, cover) and a row's path needs no branching: at
each level node = 2 * node + 1 + (value > cut), for all rows and trees at once. Fitting is deterministic. It runs in one place
on a bounded sample of rows (`sampled`: all rows where there are fewer); scoring runs on the cluster.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a forest is fitted on at most.
SAMPLE_ROWS = 200_000


@dataclass
class Forest:
    column: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes: go right if the value is above it
    leaf: np.ndarray  # trees x leaves
    base: float
    cover: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # trees x all nodes: weight of the training rows there

    def margin(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        trees = np.arange(len(self.column))[None, :]
        for i in range(0, len(x), rows):
            part = x[i : i + rows]
            node = np.zeros((len(part), len(self.column)), np.int64)
            at = np.arange(len(part))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (part[at, self.column[trees, node]] > self.cut[trees, node])
            out[i : i + rows] += self.leaf[trees, node - self.column.shape[1]].sum(1) if len(self.column) else 0
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def thresholds(self) -> list[tuple[int, float]]:
        """(column, cut) of every split, distinct and sorted."""
        real = np.isfinite(self.cut)
        return sorted(set(zip(self.column[real].tolist(), self.cut[real].tolist(), strict=True)))

    def expected(self) -> float:
        """The mean margin over the training weights."""
        return self.base + sum(float((v * c).sum() / max(c.sum(), 1e-300)) for v, c in zip(self.leaf, self.cover[:, self.column.shape[1] :], strict=True))

    def leaves(self) -> Iterator[tuple[int, np.ndarray, list[list[tuple[int, bool]]], np.ndarray, float]]:
        """Each leaf with a value: its tree, the columns of its path, for each of these the (inner node, goes right) tests on the path,
        the share of training weight that passes them, and the value."""
        inner = self.column.shape[1]
        depth = int(np.log2(inner + 1)) if inner else 0
        for t, (column, cut, leaf, cover) in enumerate(zip(self.column, self.cut, self.leaf, self.cover, strict=True)):
            for at in np.flatnonzero(leaf):
                node, tests, share, real = int(at) + inner, {}, {}, True
                for _ in range(depth):
                    up, is_right = (node - 1) // 2, node % 2 == 0
                    if np.isfinite(cut[up]):
                        c = int(column[up])
                        tests.setdefault(c, []).append((up, is_right))
                        share[c] = share.get(c, 1.0) * (cover[node] / cover[up] if cover[up] > 0 else 0.0)
                    elif is_right:  # no split: all rows go left
                        real = False
                    node = up
                if real:
                    yield t, np.array(list(tests), np.int64), list(tests.values()), np.array(list(share.values())), float(leaf[at])

    def patterns(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
        """(columns, shares, pattern of each row, value) of each leaf: bit i of a row's pattern says whether the row passes all tests
        of the leaf's i-th column. A leaf has few columns, so what a row gets from it is looked up by its pattern."""
        last, right = -1, None
        for t, columns, tests, share, value in self.leaves():
            if t != last:
                right, last = x[:, self.column[t]] > self.cut[t], t
            pattern = np.zeros(len(x), np.int64)
            for i, own in enumerate(tests):
                passed = np.ones(len(x), bool)
                for node, is_right in own:
                    passed &= right[:, node] == is_right
                pattern |= passed.astype(np.int64) << i
            yield columns, share, pattern, value

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """rows x columns: exact Shapley values of the margin, where an unknown column sends a row down both sides of a split in the
        shares of the training weights. A leaf counts with the product, over the columns of its path, of (does the row pass?) if the
        column is known, else of the shares, so its values run over the subsets of its few columns."""
        out = np.zeros(x.shape)
        for columns, share, pattern, value in self.patterns(x):
            k = len(columns)
            bits = _bits(k)
            for i in range(k):
                rest = np.zeros(len(bits))
                for chosen, weight in _coalitions(k, [i]):
                    rest += weight * np.prod(np.where(chosen, bits, share), axis=1, where=np.arange(k) != i)
                out[:, columns[i]] += (value * rest * (bits[:, i] - share[i]))[pattern]
        return out

    def interactions(self, x: np.ndarray) -> np.ndarray:
        """rows x columns x columns: exact Shapley interaction values of the same game. A pair's interaction stands in equal halves at
        (a, b) and (b, a); the diagonal is what is left of a column's Shapley value, so each row sums to it."""
        out = np.zeros((len(x), x.shape[1], x.shape[1]))
        for columns, share, pattern, value in self.patterns(x):
            k = len(columns)
            bits = _bits(k)
            for i, j in itertools.combinations(range(k), 2):
                rest = np.zeros(len(bits))
                for chosen, weight in _coalitions(k, [i, j]):
                    rest += weight * np.prod(np.where(chosen, bits, share), axis=1, where=(np.arange(k) != i) & (np.arange(k) != j))
                half = (0.5 * value * rest * (bits[:, i] - share[i]) * (bits[:, j] - share[j]))[pattern]
                out[:, columns[i], columns[j]] += half
                out[:, columns[j], columns[i]] += half
        at = np.arange(x.shape[1])
        out[:, at, at] = self.shapley(x) - out.sum(2)
        return out

    def shapley_against(self, x: np.ndarray, background: np.ndarray) -> np.ndarray:
        """rows x columns: exact interventional Shapley values of the margin, where unknown columns are those of a background row, averaged
        over all of these. Row and background row go down a tree together: a leaf is reached if the columns that only the row
        passes (p of them) are known and those that only the background passes (q) are not, which gives the former
        (p-1)! q! / (p+q)! of its value each and the latter -p! (q-1)! / (p+q)!."""
        out = np.zeros(x.shape)
        if not len(background):
            return out
        for (columns, _, pattern, value), (_, _, behind, _) in zip(self.patterns(x), self.patterns(background), strict=True):
            k = len(columns)
            bits = _bits(k).astype(bool)
            seen = np.bincount(behind, minlength=1 << k) / len(background)
            table = np.zeros((1 << k, k))
            for b in np.flatnonzero(seen):
                p, q = (bits & ~bits[b]).sum(1), (~bits & bits[b]).sum(1)
                open_ = (bits | bits[b]).all(1)
                for i in range(k):
                    mine, its = open_ & bits[:, i] & ~bits[b, i], open_ & ~bits[:, i] & bits[b, i]
                    table[mine, i] += seen[b] * _FACTORIAL[p[mine] - 1] * _FACTORIAL[q[mine]] / _FACTORIAL[p[mine] + q[mine]]
                    table[its, i] -= seen[b] * _FACTORIAL[p[its]] * _FACTORIAL[q[its] - 1] / _FACTORIAL[p[its] + q[its]]
            out[:, columns] += value * table[pattern]
        return out


_FACTORIAL = np.array([math.factorial(i) for i in range(21)], float)


def _bits(k: int) -> np.ndarray:
    """All patterns of k bits, a row each."""
    return (np.arange(1 << k)[:, None] >> np.arange(k) & 1).astype(float)


def _coalitions(k: int, out: list[int]) -> Iterator[tuple[np.ndarray, float]]:
    """The subsets of k players without those in `out`, as masks, with their weights in the Shapley value (one player out) or
    interaction (two)."""
    others = [i for i in range(k) if i not in out]
    n = len(others) + 1
    for size in range(n):
        for chosen in itertools.combinations(others, size):
            mask = np.zeros(k, bool)
            mask[list(chosen)] = True
            yield mask, math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least_hessian: float = 1.0, weight: np.ndarray | None = None, share: float = 1.0, seed: int = 13) -> Forest:
    """A forest for labels y in {0, 1}. Without rows, or with one label, it is the smoothed share of label 1. With share < 1 the splits of
    each tree are chosen on that share of the rows, another one each time and for each seed; its leaves and covers are those of all rows."""
    y = y.astype(float)
    w = np.ones(len(y)) if weight is None else weight.astype(float)
    positive = ((w * y).sum() + 0.5) / (w.sum() + 1)
    inner, leaves = 2**depth - 1, 2**depth
    base = float(np.log(positive / (1 - positive)))
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base, np.zeros((0, inner + leaves)))
    x = np.nan_to_num(x.astype(float))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])  # a row for each column; value <= cuts[b] lies in bins up to b
    columns, margin = x.shape[1], np.full(len(y), base)
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base, np.zeros((trees, inner + leaves)))
    usable = np.zeros((columns, bins), bool)
    for j, c in enumerate(cuts):
        usable[j, : len(c)] = True
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        some = np.flatnonzero(np.random.default_rng([seed, t]).random(len(y)) < share) if share < 1 else slice(None)
        seen, gs, hs = binned[:, some], g[some], h[some]
        out.cover[t, 0] = w.sum()
        for level in range(depth):
            count, first = 2**level, 2**level - 1
            key = (node[some] - first) * bins
            hist = np.empty((2, count, columns, bins))
            for j in range(columns):
                at = key + seen[j]
                hist[0, :, j] = np.bincount(at, gs, count * bins).reshape(count, bins)
                hist[1, :, j] = np.bincount(at, hs, count * bins).reshape(count, bins)
            left = hist.cumsum(3)
            whole = left[..., -1:]
            right = whole - left
            score = lambda s: s[0] ** 2 / (s[1] + l2)
            gain = score(left) + score(right) - score(whole)
            gain = np.where(usable[None] & (left[1] >= least_hessian) & (right[1] >= least_hessian), gain, 0).round(9)
            best = gain.reshape(count, -1).argmax(1)
            worth = gain.reshape(count, -1).max(1) > 1e-6
            column, cut = best // bins, best % bins
            for i in range(count):
                out.column[t, first + i] = column[i]
                out.cut[t, first + i] = cuts[column[i]][cut[i]] if worth[i] else np.inf
            own = node - first
            node = 2 * node + 1 + (worth[own] & (binned[column[own], np.arange(len(y))] > cut[own]))
            out.cover[t, 2 * count - 1 : 4 * count - 1] = np.bincount(node - (2 * count - 1), w, 2 * count)
        at = node - inner
        sums = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        out.leaf[t] = -rate * sums[0] / (sums[1] + l2)
        margin += out.leaf[t][at]
    return out


def ranking_score(y: np.ndarray, s: np.ndarray) -> float:
    """Average precision with ties taken together; NaN without label 1."""
    values, place = np.unique(-s, return_inverse=True)
    n, p = np.bincount(place, minlength=len(values)), np.bincount(place, y, len(values))
    return float((p * np.cumsum(p) / np.cumsum(n)).sum() / p.sum()) if p.sum() else float("nan")


def training(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The training rows: node_id, columns, label, fold."""
    return rows.where("label is not null and fold is not null").select("node_id", *[F.col(c).cast("double").alias(c) for c in columns], F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"))


def gathered(own: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node ids, x, labels, folds) of training rows on the driver, in the order of ids."""
    found = own.toPandas().sort_values("node_id", kind="stable")
    return found["node_id"].to_numpy(), found[columns].to_numpy(float), found["label"].to_numpy(int), found["fold"].to_numpy(int)


def sampled(rows: DataFrame, columns: list[str], most: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node ids, x, labels, folds) of the training rows (node_id, columns, label, fold) on the driver, in the order of ids: all of
    them, or the `most` with the smallest hashed ids, the same ones however the rows are partitioned."""
    own = training(rows, columns)
    total = own.count()
    if total > most:
        hashed = own.withColumn("__h", F.shiftrightunsigned(F.xxhash64("node_id"), 32))
        # The bound on the hash leaves enough rows (with five deviations to spare), and few more, to be ordered.
        bound = (most + 5 * math.sqrt(most) + 10) / total
        own = hashed.where(F.col("__h") < int(min(bound, 1) * (1 << 32))).orderBy("__h", "node_id").limit(most).drop("__h")
    return gathered(own, columns)


def scored(rows: DataFrame, columns: list[str], names: list[str], score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """node_id and columns `names` of every row: what `score` makes of its values, batch by batch on the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]) if batch.num_rows else np.zeros((0, len(columns)))
            made = score(np.nan_to_num(x.astype(float))).reshape(len(x), len(names))
            yield pa.record_batch([batch.column(0), *[pa.array(made[:, i]) for i in range(len(names))]], ["node_id", *names])

    return rows.select(F.col("node_id").cast("long"), *[F.col(c).cast("double") for c in columns]).mapInArrow(run, "node_id long, " + ", ".join(f"{n} double" for n in names))
