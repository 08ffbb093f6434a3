"""Search over classifiers, selections of columns and settings, with a budget of trials.

A trial is a classifier and a selection with settings drawn from the trial's seed (trial 0 has the defaults), fitted outside each saved
fold and scored on it. The trials of one classifier, selection and fold are a task, which ranks the columns once and finds the neighbours
of trials with the same columns once. So tasks run side by side and a lost one is done again alike. Selections are made inside the training part of each fold. Fits use all training rows: more than
`forest.SAMPLE_ROWS` are not gathered, but all trials are fitted in the same passes over blocks of rows (`by_passes`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.operators import forest, passes
from quillmesh.operators.models import fan_out
from quillmesh.storage import written

CLASSIFIERS = ("trees", "logistic", "neighbours", "bayes")
SELECTIONS = ("none", "filter", "embed")
#: Neighbours are looked for in blocks of rows held, among chunks of training rows.
BLOCK, CHUNK = 256, 4096


def drawn(classifier: str, selection: str, trial: int, seed: int) -> dict[str, float]:
    """The settings of a trial; trial 0 has the defaults."""
    rng = np.random.default_rng([seed, trial, CLASSIFIERS.index(classifier), SELECTIONS.index(selection)])
    first = trial == 0
    out = {"keep": 1.0 if selection == "none" else 0.5 if first else float(rng.uniform(0.15, 0.95))}
    if classifier == "trees":
        out |= {"trees": 20, "depth": 3, "rate": 0.15} if first else {"trees": int(rng.integers(5, 60)), "depth": int(rng.integers(1, 6)), "rate": float(10 ** rng.uniform(-1.7, -0.4))}
    elif classifier == "logistic":
        out |= {"l2": 1e-3} if first else {"l2": float(10 ** rng.uniform(-5, 1))}
    elif classifier == "neighbours":
        out |= {"k": 15} if first else {"k": int(rng.integers(3, 100))}
    else:
        out |= {"smooth": 1e-9} if first else {"smooth": float(10 ** rng.uniform(-9, 0))}
    return out


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 25) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps on the penalised likelihood."""
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), max(l2, 1e-9) * len(x))
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (p - y) + ridge * w)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


class Nearest:
    """The k nearest of the base rows read so far of each row held, by squared distance, rounded to nine places; of equally far ones those of the
    least key. Distances in single precision tell, with a bound of their error, which few rows can be among the nearest; these are
    measured in double."""

    def __init__(self, held: np.ndarray, k: int) -> None:
        self.held, self.small, self.size, self.k = held, held.astype(np.float32), (held**2).sum(1), k
        self.bound, self.seen, self.chunks, self.due = np.full(len(held), np.inf), 0, 0, 1
        self.found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def add(self, base: np.ndarray, squares: np.ndarray, small: np.ndarray, label: np.ndarray, key: np.ndarray) -> None:
        """base: see `chunks_of`."""
        far, most = self.small @ small, float(squares.max())
        far += squares.astype(np.float32)
        slack = 2 * (base.shape[1] + 4) * 2.0**-23 * (most + 2 * np.sqrt(self.size * most)) + 1e-8
        bound = self.bound - self.size
        if self.k <= len(base) and np.isinf(self.bound).any():
            bound = np.minimum(bound, np.partition(far, self.k - 1, axis=1)[:, self.k - 1] + slack)
        limit = np.nextafter((bound + slack).astype(np.float32), np.float32(np.inf))
        row, col = np.divmod(np.flatnonzero(far <= limit[:, None]), len(base))
        exact = (self.size[row] - 2 * np.einsum("nc,nc->n", self.held[row], base[col]) + squares[col]).round(9)
        self.found.append((row, exact, key[col], label[col]))
        self.seen, self.chunks = self.seen + len(base), self.chunks + 1
        # Later chunks have ever fewer near rows: what was found is put in order after 1, 2, 4, ... chunks, or when it is much.
        if self.chunks >= self.due or sum(len(f[0]) for f in self.found[1:]) > 4 * self.k * len(self.held):
            self._merge()
            self.due = 2 * self.chunks

    def _merge(self) -> None:
        row, exact, key, label = (np.concatenate(v) for v in zip(*self.found, strict=True))
        by = np.lexsort((key, exact, row))
        place = np.arange(len(by)) - np.searchsorted(row[by], np.arange(len(self.held)))[row[by]]
        by, place = by[place < self.k], place[place < self.k]
        self.found = [(row[by], exact[by], key[by], label[by])]
        last = by[place == self.k - 1]
        self.bound[row[last]] = exact[last]

    def labels(self) -> np.ndarray:
        """held x k, the nearest first."""
        self._merge()
        return self.found[0][3].reshape(len(self.held), min(self.k, self.seen))


def chunks_of(base: np.ndarray, label: np.ndarray, key: np.ndarray) -> Iterator[tuple]:
    """Base rows as `Nearest.add` takes them: values, their squares, -2 x their transpose in single precision, labels and keys."""
    for i in range(0, len(base), CHUNK):
        part = base[i : i + CHUNK]
        yield part, (part**2).sum(1), np.ascontiguousarray(-2 * part.T, np.float32), label[i : i + CHUNK], key[i : i + CHUNK]


def nearest_labels(base: np.ndarray, label: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """held x k: the labels of the nearest rows of base, see `Nearest`; of equally far ones the first."""
    k = min(k, len(base))
    if not len(base) or not len(held):
        return np.zeros((len(held), k), label.dtype)
    chunks, out = list(chunks_of(base, label, np.arange(len(base)))), []
    for i in range(0, len(held), BLOCK):
        near = Nearest(held[i : i + BLOCK], k)
        for c in chunks:
            near.add(*c)
        out.append(near.labels())
    return np.concatenate(out)


def neighbour_scores(x: np.ndarray, y: np.ndarray, held: np.ndarray, ks: Sequence[int]) -> list[np.ndarray]:
    """For each k the share of label 1 among the nearest rows; columns are standardised on x."""
    mean, spread = x.mean(0), x.std(0)
    scale = lambda v: (v - mean) / np.where(spread > 0, spread, 1)
    found = nearest_labels(scale(x), y, scale(held), max(ks))
    return [found[:, :k].mean(1) for k in ks]


def fitted_scores(classifier: str, settings: dict[str, float], x: np.ndarray, y: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Scores of `held` from a fit on (x, y); columns are standardised on x."""
    mean, spread = x.mean(0), x.std(0)
    scale = lambda v: (v - mean) / np.where(spread > 0, spread, 1)
    if classifier == "trees":
        return forest.fit(x, y, trees=settings["trees"], depth=settings["depth"], rate=settings["rate"]).margin(held)
    if classifier == "logistic":
        w = logistic(scale(x), y, settings["l2"])
        return scale(held) @ w[:-1] + w[-1]
    if classifier == "neighbours":
        return neighbour_scores(x, y, held, [int(settings["k"])])[0]
    margin = np.zeros(len(held))
    for value, sign in ((1, 1), (0, -1)):
        own = x[y == value]
        if len(own):
            m, v = own.mean(0), own.var(0) + settings["smooth"] * max(float(x.var(0).max()), 1e-12) + 1e-12
            margin += sign * (np.log(len(own)) - 0.5 * (np.log(v) + (held - m) ** 2 / v).sum(1))
    return margin


def column_ranks(selection: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The places of all columns, in the order in which a selection takes them: as they stand, by falling absolute correlation with the label,
    or by falling attribution in a small forest."""
    if selection == "none":
        return np.arange(x.shape[1])
    if selection == "filter":
        centred, label = x - x.mean(0), y - y.mean()
        rank = np.abs(centred.T @ label) / np.maximum(np.sqrt((centred**2).sum(0) * (label**2).sum()), 1e-12)
    else:
        rank = np.abs(forest.fit(x, y, trees=10, depth=3).shapley(x)).mean(0)
    return np.argsort(-rank.round(12), kind="stable")


def kept_columns(selection: str, share: float, ranks: np.ndarray) -> np.ndarray:
    return np.sort(ranks if selection == "none" else ranks[: max(1, round(share * len(ranks)))])


def chosen_columns(selection: str, share: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the columns that a selection keeps: all, those of the largest absolute correlation with the label, or those of the
    largest attribution in a small forest."""
    return kept_columns(selection, share, column_ranks(selection, x, y))


FOUND = "classifier string, selection string, trial long, settings string, fold long, n_columns long, ap double"


def as_text(settings: dict[str, float]) -> str:
    return ", ".join(f"{n}={v:.6g}" for n, v in sorted(settings.items()))


@dataclass
class Trial:
    """A trial outside one fold, with the columns it keeps."""

    classifier: str
    selection: str
    trial: int
    fold: int
    settings: dict[str, float]
    columns: np.ndarray


class Moments:
    """Means and variances of all columns over the rows outside each fold, by label, added up in passes around the means of all rows."""

    def __init__(self, blocks: DataFrame, width: int) -> None:
        self.sizes = passes.fold_sizes(blocks)
        self.folds = sorted(self.sizes)
        self.centre = passes.summed(blocks, lambda r: r.x.sum(0), (width,)) / max(sum(n for n, _ in self.sizes.values()), 1)

        def part(r: passes.Rows, folds: list = self.folds, centre: np.ndarray = self.centre) -> np.ndarray:
            out = np.zeros((len(folds), 2, 2, width))
            for i, f in enumerate(folds):
                for value in (0, 1):
                    own = r.x[(r.fold == f) & (r.y == value)] - centre
                    out[i, value] = own.sum(0), (own**2).sum(0)
            return out

        self.sums = passes.summed(blocks, part, (len(self.folds), 2, 2, width))

    def outside(self, k: int, values: tuple[int, ...] = (0, 1)) -> tuple[int, np.ndarray, np.ndarray]:
        """(rows, means around the centre, variances) of the rows with these labels outside the fold."""
        n = sum((p if v else m - p) for f, (m, p) in self.sizes.items() if f != k for v in values)
        one, two = (sum(self.sums[i, v, at] for i, f in enumerate(self.folds) if f != k for v in values) + np.zeros(len(self.centre)) for at in (0, 1))
        mean = one / max(n, 1)
        variance = two / max(n, 1) - mean**2
        return n, mean, np.where(variance > 1e-13 * two / max(n, 1), variance, 0.0)

    def scale(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Means, and deviations (1 for a constant), of the columns."""
        _, mean, variance = self.outside(k)
        return self.centre + mean, np.where(variance > 0, np.sqrt(variance), 1.0)

    def correlation(self, k: int) -> np.ndarray:
        n, mean, variance = self.outside(k)
        positives, own, _ = self.outside(k, (1,))
        share = positives / max(n, 1)
        return np.abs(positives * (own - mean)) / np.maximum(np.sqrt(n * variance * n * share * (1 - share)), 1e-12)


def ranks_by_passes(blocks: DataFrame, width: int, moments: Moments, selection: str) -> dict[int, np.ndarray]:
    """`column_ranks` of the rows outside each fold."""
    folds = moments.folds
    if selection == "none":
        return {k: np.arange(width) for k in folds}
    if selection == "filter":
        rank = {k: moments.correlation(k) for k in folds}
    else:
        made = passes.forests(blocks, width, [passes.Spec((k,), np.arange(width), 10, 3) for k in folds], covers=True)
        sums = passes.summed(blocks, lambda r: np.array([np.abs(m.shapley(r.x[r.fold != k])).sum(0) for k, m in zip(folds, made, strict=True)]), (len(folds), width))
        rank = {k: s / max(moments.outside(k)[0], 1) for k, s in zip(folds, sums, strict=True)}
    return {k: np.argsort(-rank[k].round(12), kind="stable") for k in folds}


def logistic_by_passes(blocks: DataFrame, moments: Moments, trials: Sequence[Trial], steps: int = 25) -> list[np.ndarray]:
    """`logistic` of all trials, a step of all in each pass."""
    scales = {k: moments.scale(k) for k in moments.folds}
    made, going = [np.zeros(len(t.columns) + 1) for t in trials], list(range(len(trials)))
    for _ in range(steps):
        if not going:
            break
        now = [(trials[i].fold, trials[i].columns, made[i]) for i in going]
        sizes = [len(w) * (len(w) + 1) for *_, w in now]

        def part(r: passes.Rows, now: list = now) -> np.ndarray:
            out, of = [], {}
            for k, own, w in now:
                if k not in of:
                    use = r.fold != k
                    of[k] = np.column_stack([(r.x[use] - scales[k][0]) / scales[k][1], np.ones(use.sum())]), r.y[use]
                z, y = of[k]
                z = z[:, [*own, -1]]
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                out += [((z * (p * (1 - p))[:, None]).T @ z).ravel(), z.T @ (p - y)]
            return np.concatenate(out)

        found, still = np.split(passes.summed(blocks, part, (sum(sizes),)), np.cumsum(sizes)[:-1]), []
        for i, own in zip(going, found, strict=True):
            w, n = made[i], moments.outside(trials[i].fold)[0]
            ridge = np.full(len(w), max(trials[i].settings["l2"], 1e-9) * n)
            ridge[-1] = 1e-9
            move = np.linalg.solve(own[: len(w) ** 2].reshape(len(w), -1) + np.diag(ridge + 1e-9), own[len(w) ** 2 :] + ridge * w)
            made[i] = w - move
            if np.abs(move).max() >= 1e-8:
                still.append(i)
        going = still
    return made


def neighbours_by_passes(blocks: DataFrame, moments: Moments, trials: dict[int, Trial], ddl: str) -> DataFrame:
    """Scores of the held rows of each trial. A task holds one block and reads all blocks, one after the other."""
    scales = {k: moments.scale(k) for k in moments.folds}
    of: dict[int, dict[tuple, list[int]]] = {}
    for i, t in trials.items():
        of.setdefault(t.fold, {}).setdefault(tuple(t.columns), []).append(i)

    def held_of(r: passes.Rows) -> dict[int, tuple]:
        out = {}
        for k in of:
            own = r.fold == k
            if own.any():
                z = (r.x[own] - scales[k][0]) / scales[k][1]
                out[k] = r.y[own], {c: [Nearest(z[i : i + BLOCK][:, list(c)], max(int(trials[t].settings["k"]) for t in ts)) for i in range(0, len(z), BLOCK)] for c, ts in of[k].items()}
        return out

    def read(r: passes.Rows, held: dict[int, tuple]) -> None:
        for k, (_, near) in held.items():
            use = r.fold != k
            z, y, ids = (r.x[use] - scales[k][0]) / scales[k][1], r.y[use].astype(np.int64), r.ids[use]
            for c, tiles in near.items():
                for chunk in chunks_of(z[:, list(c)], y, ids):
                    for tile in tiles:
                        tile.add(*chunk)

    def told(held: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        for k, (y, near) in held.items():
            for c, tiles in near.items():
                found = np.concatenate([t.labels() for t in tiles])
                for i in of[k][c]:
                    score = found[:, : int(trials[i].settings["k"])].mean(1) if found.shape[1] else np.zeros(len(y))
                    yield pa.record_batch([pa.array([i]), pa.array([score.tobytes()], pa.binary()), pa.array([y.astype("i1").tobytes()], pa.binary())], ["i", "score", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, {}
        for batch in batches:
            tasks = batch.column(batch.schema.get_field_index("task")).to_pylist()
            for t, r in zip(tasks, passes.opened(batch), strict=True):
                if t != task:
                    yield from told(held)
                    task, held = t, held_of(r)
                read(r, held)
        yield from told(held)

    # The block held comes first.
    numbers = blocks.select(F.col("block").alias("task"))
    count = numbers.agg(F.max("task")).first()[0] + 1
    every = blocks.crossJoin(F.broadcast(numbers)).repartitionById(count, F.col("task")).sortWithinPartitions("task", F.col("block") != F.col("task"), "block")
    return every.mapInArrow(run, ddl)


def by_passes(blocks: DataFrame, width: int, count: int, seed: int, classifiers: Sequence[str], selections: Sequence[str]) -> DataFrame:
    """`search` over blocks of rows, see `passes`: every classifier and selection fitted on all rows outside each fold."""
    moments = Moments(blocks, width)
    ranks = {s: ranks_by_passes(blocks, width, moments, s) for s in selections}
    trials = []
    for c in classifiers:
        for s in selections:
            for k in moments.folds:
                for t in range(max(1, count)):
                    settings = drawn(c, s, t, seed)
                    trials.append(Trial(c, s, t, k, settings, kept_columns(s, settings["keep"], ranks[s][k])))
    of = {c: [i for i, t in enumerate(trials) if t.classifier == c] for c in CLASSIFIERS}
    fits: dict[int, object] = {}
    made = passes.forests(blocks, width, [passes.Spec((t.fold,), t.columns, t.settings["trees"], t.settings["depth"], t.settings["rate"]) for t in map(trials.__getitem__, of["trees"])]) if of["trees"] else []
    fits |= dict(zip(of["trees"], made, strict=True))
    fits |= dict(zip(of["logistic"], logistic_by_passes(blocks, moments, [trials[i] for i in of["logistic"]]), strict=True))
    for i in of["bayes"]:
        t, sides = trials[i], []
        least = t.settings["smooth"] * max(float(moments.outside(t.fold)[2][t.columns].max()), 1e-12) + 1e-12
        for value, sign in ((1, 1), (0, -1)):
            n, mean, variance = moments.outside(t.fold, (value,))
            if n:
                sides.append((sign, n, (moments.centre + mean)[t.columns], variance[t.columns] + least))
        fits[i] = sides
    scales = {k: moments.scale(k) for k in moments.folds}

    def part(r: passes.Rows) -> Iterator[tuple]:
        for k in np.unique(r.fold):
            x, y = r.x[r.fold == k], r.y[r.fold == k].astype("i1").tobytes()
            z = (x - scales[k][0]) / scales[k][1]
            for i, fit in fits.items():
                t = trials[i]
                if t.fold != k:
                    continue
                if t.classifier == "trees":
                    score = fit.margin(x)
                elif t.classifier == "logistic":
                    score = z[:, t.columns] @ fit[:-1] + fit[-1]
                else:
                    score = np.zeros(len(x))
                    for sign, n, m, v in fit:
                        score += sign * (np.log(n) - 0.5 * (np.log(v) + (x[:, t.columns] - m) ** 2 / v).sum(1))
                yield i, score.tobytes(), y

    ddl = "i long, score binary, y binary"
    scored = passes.over(blocks, part, ddl)
    if of["neighbours"]:
        scored = scored.unionByName(neighbours_by_passes(blocks, moments, {i: trials[i] for i in of["neighbours"]}, ddl))

    def reached(rows: pd.DataFrame) -> pd.DataFrame:
        t = trials[int(rows["i"].iloc[0])]
        score, y = (np.concatenate([np.frombuffer(v, kind) for v in rows[n]]) for n, kind in (("score", "<f8"), ("y", "i1")))
        return pd.DataFrame([(t.classifier, t.selection, t.trial, as_text(t.settings), t.fold, len(t.columns), round(forest.ranking_score(y, score), 6))], columns=[c.split()[0] for c in FOUND.split(", ")])

    return written(scored, "trial-scores").groupBy("i").applyInPandas(reached, FOUND)


def search(rows: DataFrame, columns: list[str], trials: int = 8, seed: int = 1, classifiers: Sequence[str] = CLASSIFIERS, selections: Sequence[str] = SELECTIONS) -> DataFrame:
    """(classifier, selection, trial, settings, fold, n_columns, ap) of every trial and fold. rows: node_id, columns, label, fold."""
    own = forest.training(rows, columns)
    total = own.count()
    if total > forest.SAMPLE_ROWS:
        return by_passes(passes.packed(own, columns, total), len(columns), trials, seed, classifiers, selections)
    _, x, y, fold = forest.gathered(own, columns)
    x = np.nan_to_num(x)

    def work(classifier: str, selection: str, k: int) -> list[tuple]:
        out, fit, held = [], fold != k, fold == k
        x_fit, y_fit, x_held, y_held = x[fit], y[fit], x[held], y[held]
        ranks = column_ranks(selection, x_fit, y_fit)
        drawn_for: dict[tuple, list[tuple]] = {}
        for trial in range(max(1, trials)):
            settings = drawn(classifier, selection, trial, seed)
            drawn_for.setdefault(tuple(kept_columns(selection, settings["keep"], ranks)), []).append((trial, settings))
        for own, of in drawn_for.items():
            a, b = x_fit[:, list(own)], x_held[:, list(own)]
            if classifier == "neighbours":
                scores = neighbour_scores(a, y_fit, b, [int(s["k"]) for _, s in of])
            else:
                scores = [fitted_scores(classifier, s, a, y_fit, b) for _, s in of]
            for (trial, settings), score in zip(of, scores, strict=True):
                out.append((classifier, selection, trial, as_text(settings), k, len(own), round(forest.ranking_score(y_held, score), 6)))
        return out

    jobs = [(c, s, int(k)) for c in classifiers for s in selections for k in np.unique(fold)]
    return fan_out(rows.sparkSession, jobs, work, FOUND)


def tuned_against_default(found: DataFrame) -> DataFrame:
    """(classifier, selection, trial, settings, cv_mean, cv_sd, default_cv, gain, place): of each classifier and selection the trial with the
    best mean score over folds (the first, on a tie), beside its default, and its place among all."""
    means = found.groupBy("classifier", "selection", "trial", "settings").agg(F.round(F.avg("ap"), 9).alias("cv_mean"), F.round(F.stddev_samp("ap"), 9).alias("cv_sd"))
    of = Window.partitionBy("classifier", "selection")
    best = means.withColumn("default_cv", F.max(F.when(F.col("trial") == 0, F.col("cv_mean"))).over(of)).withColumn("rank", F.row_number().over(of.orderBy(F.desc("cv_mean"), "trial"))).where("rank = 1").drop("rank")
    # A row for each classifier and selection.
    return best.withColumn("gain", F.round(F.col("cv_mean") - F.col("default_cv"), 9)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("cv_mean"), "classifier", "selection")))
