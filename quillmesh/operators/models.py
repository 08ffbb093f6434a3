"""Operators that iterate or fit: components, rewiring, grouped folds, PCA, probes, importance, removal and retraining, encoders.

Boosted trees are fitted on a bounded sample of training rows (`forest.SAMPLE_ROWS`; all rows where there are fewer), many fits side by
side in tasks, those of `cross_fit` on all rows (`passes`, where they are more); rows are scored where they are. Networks are trained in data-parallel passes (`encoders`). What reaches the
driver is bounded: the sample, a matrix of features x features (PCA), one row for each group (folds), weights or metrics.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.operators import forest, passes
from quillmesh.operators.components import connected_components
from quillmesh.storage import written


def hashed(seed: int, *cols) -> F.Column:
    """The 32-bit hash of the templates' $H."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def component_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, group_id): components numbered from 0 by their smallest member; isolated nodes are components."""
    found = connected_components(edges, "src", "dst")
    named = nodes.select("node_id").join(found.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("first"))
    firsts = named.select("first").distinct()
    return named.join(numbered(firsts, "first", "group_id"), "first").select("node_id", "group_id")


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys with gapless numbers from 0 in their order, by range partitions and their counts (no single-task window)."""
    ranged = written(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id()), "ranged")
    counts = {r["__p"]: r["n"] for r in ranged.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    at = rows.sparkSession.createDataFrame(starts or [(0, 0)], "__p int, __at long")
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    return ranged.withColumn("__r", rank).join(F.broadcast(at), "__p").select(key, (F.col("__at") + F.col("__r")).alias(name))


def dealt(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, from_key): a seeded permutation of the distinct keys, by two numberings (no single-task window)."""
    own = rows.select(F.col(key).cast("long").alias(key)).distinct()
    mixed = own.select(F.struct(hashed(seed, key).alias("h"), F.col(key).alias("k")).alias("o"))
    return numbered(own, key, "i").join(numbered(mixed, "o", "i").select("i", F.col("o.k").alias(f"from_{key}")), "i").select(key, f"from_{key}")


#: Edges of a class pair on average, and the rounds that share the swaps asked for.
PAIR_EDGES, SWAP_ROUNDS = 20_000, 5


def swapped(src: np.ndarray, dst: np.ndarray, side: np.ndarray | None, wanted: int, rng: np.random.Generator, passes: int = 20) -> tuple[np.ndarray, np.ndarray, int]:
    """(src, dst, swaps made) after at least `wanted` double-edge swaps among these edges, or `passes` passes. A pass pairs edges at random
    and proposes (a,b),(c,d) -> (a,d),(c,b); proposals that make a loop, an edge that exists or one that another proposal makes are
    dropped. `side` tells whether an edge's first end is its src (so that both new edges join the classes the old ones joined); without
    it either way of crossing is as likely."""
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    u, v = ends[: len(src)], ends[len(src) :]
    if side is not None:
        u, v = np.where(side, u, v), np.where(side, v, u)
    made, size, half = 0, len(ids), len(u) // 2
    code = lambda x, y: np.minimum(x, y) * size + np.maximum(x, y)
    for _ in range(passes if half else 0):
        if made >= wanted:
            break
        order = rng.permutation(len(u))
        i, j = order[:half], order[half : 2 * half]
        a, z, c, d = u[i], v[i], u[j], v[j]
        if side is None:
            flip = rng.random(half) < 0.5
            c, d = np.where(flip, d, c), np.where(flip, c, d)
        one, two, now = code(a, d), code(c, z), np.sort(code(u, v))
        there = lambda x, now=now: now[np.minimum(np.searchsorted(now, x), len(now) - 1)] == x
        good = (a != d) & (c != z) & (one != two)
        again, count = np.unique(np.concatenate([one[good], two[good]]), return_counts=True)
        again = again[count > 1]
        twice = lambda x, again=again: np.isin(x, again) if len(again) else np.zeros(len(x), bool)
        good &= ~(there(one) | there(two) | twice(one) | twice(two))
        i, j = i[good], j[good]
        u[i], v[i], u[j], v[j] = a[good], d[good], c[good], z[good]
        made += int(good.sum())
    return ids[np.minimum(u, v)], ids[np.maximum(u, v)], made


def swap_rewire(edges: DataFrame, swaps_per_edge: float = 10.0, max_rounds: int = 500, seed: int = 3, pair_edges: int = PAIR_EDGES) -> tuple[DataFrame, dict[str, int]]:
    """((relation, src, dst), swaps made in each relation): double-edge swaps in all relations at once. Every node
    keeps its degree; there are no loops and no repeated edges. It ends when every relation has its swaps, when a round makes none, or
    after `max_rounds`; the counts tell which.

    A round deals the nodes into classes by a hash, anew each time, and brings all edges between two classes together: a swap
    that keeps the classes of both ends makes edges between the same two, so whether an edge exists is known where the swap is made.
    Many swaps are made in one round for one shuffle of the edges, and the next round mixes other edges with one another.
    """
    now = written(edges.select("relation", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct(), "rewire")
    total = {r.relation: r["count"] for r in now.groupBy("relation").count().collect()}
    done = dict.fromkeys(total, 0)
    classes = {r: max(1, math.ceil(math.sqrt(2 * n / pair_edges))) if n > pair_edges else 1 for r, n in total.items()}
    for turn in range(max_rounds):
        # The share of its edges that each relation still wants as swaps in this round.
        share = {r: min(swaps_per_edge / SWAP_ROUNDS, swaps_per_edge - done[r] / total[r]) for r in total if done[r] < swaps_per_edge * total[r]}
        if not share:
            break

        def run(share: dict, turn: int, pairs: pd.DataFrame) -> pd.DataFrame:
            relation, low, high = pairs["relation"].iloc[0], int(pairs["low"].iloc[0]), int(pairs["high"].iloc[0])
            if relation not in share:
                return pairs[["relation", "src", "dst"]].assign(made=0)
            pairs = pairs.sort_values(["src", "dst"])
            rng = np.random.default_rng([seed, turn, zlib.crc32(relation.encode()), low, high])
            side = None if low == high else (pairs["of_src"] == low).to_numpy()
            src, dst, made = swapped(pairs["src"].to_numpy(), pairs["dst"].to_numpy(), side, math.ceil(share[relation] * len(pairs)), rng)
            return pd.DataFrame({"relation": relation, "src": src, "dst": dst, "made": np.where(np.arange(len(src)) == 0, made, 0)})

        k = F.create_map(*[F.lit(x) for r, n in classes.items() for x in (r, n)])[F.col("relation")]
        of = lambda c: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(turn)), k).cast("int")
        keyed = now.select("relation", "src", "dst", of("src").alias("of_src"), of("dst").alias("of_dst"))
        keyed = keyed.select("relation", "src", "dst", "of_src", F.least("of_src", "of_dst").alias("low"), F.greatest("of_src", "of_dst").alias("high"))
        after = written(keyed.groupBy("relation", "low", "high").applyInPandas(partial(run, share, turn), "relation string, src long, dst long, made long"), "rewire")
        found = {r.relation: r.made for r in after.groupBy("relation").agg(F.sum("made").alias("made")).collect()}
        now = after.drop("made")
        for r, n in found.items():
            done[r] += n
        if not any(found.values()):
            break
    return now, done


def rewired_report(edges: DataFrame, **settings: float) -> DataFrame:
    """(relation, edges, swaps, surviving): swaps made and the share of the old edges that are still there."""
    edges = written(edges.select("relation", "src", "dst").distinct(), "edges")
    after, swaps = swap_rewire(edges, **settings)
    same = edges.join(after.withColumn("kept", F.lit(1)), ["relation", "src", "dst"], "left")
    made = edges.sparkSession.createDataFrame(sorted(swaps.items()) or [("", 0)], "relation string, swaps long")
    out = same.groupBy("relation").agg(F.count("*").alias("edges"), F.round(F.count("kept") / F.count("*"), 9).alias("surviving"))
    return out.join(made, "relation").select("relation", "edges", "swaps", "surviving")


def grouped_folds(groups: DataFrame, folds: int, exact: int = 10_000) -> DataFrame:
    """(group_id, fold) by the public greedy rule of stratified group folds: groups in falling order of the spread of their class
    counts, each to the fold that leaves class shares most even. groups: (group_id, positives, negatives), a row for each.

    Groups with equal counts are interchangeable, so the driver sees one row for each pair of counts and decides how many of its groups
    each fold gets (one by one up to `exact` groups of a kind, beyond that in runs of a share of 1 / `exact`); which ones
    follows from their rank, which range partitions give."""
    kinds = {(r.negatives, r.positives): r["count"] for r in groups.groupBy("negatives", "positives").count().collect()}
    total = np.maximum(sum((np.array(k, float) * n for k, n in kinds.items()), np.zeros(2)), 1)
    held, ranges, first, at = np.zeros((folds, 2)), [], {}, 0
    for k in sorted(kinds):
        first[k], at = at, at + kinds[k]
    for k in sorted(kinds, key=lambda c: (-np.std(c), c)):
        own, left = np.zeros(folds, np.int64), kinds[k]
        run = max(1, left // exact)
        while left:
            step = min(run, left)
            spread = []
            for f in range(folds):
                held[f] += np.array(k) * step
                spread.append((round(float((held / total).std(0).mean()), 12), float(held[f].sum()), f))
                held[f] -= np.array(k) * step
            f = min(spread)[2]
            held[f] += np.array(k) * step
            own[f] += step
            left -= step
        start = first[k]
        for f in range(folds):
            ranges.append((int(k[0]), int(k[1]), f, int(start), int(start + own[f])))
            start += own[f]
    ranked = numbered(groups.select(F.struct(F.col("negatives").cast("long").alias("n"), F.col("positives").cast("long").alias("p"), F.col("group_id").cast("long").alias("g")).alias("o")), "o", "place")
    of = groups.sparkSession.createDataFrame(ranges or [(0, 0, 0, 0, 0)], "n long, p long, fold int, low long, high long")
    placed = ranked.select("o.n", "o.p", "o.g", "place").join(F.broadcast(of), ["n", "p"]).where("place >= low and place < high")
    return placed.select(F.col("g").alias("group_id"), "fold")


def stratified_group_split(nodes: DataFrame, parts: int = 5, test_parts: int = 2, folds: int = 5) -> DataFrame:
    """(node_id, group_id, split, cv_fold): groups go to a test part (test_parts of `parts`) and a training part by the greedy rule of
    `grouped_folds`, training groups to `folds` folds by the same rule. Unlabelled nodes have the split `unlabelled`; labelled nodes of
    one group stay together. nodes: node_id, label, group_id."""
    labelled = nodes.where("label is not null")

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("group_id").agg(F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives"))

    part = written(grouped_folds(counted(labelled), parts), "parts")
    train = part.where(F.col("fold") >= test_parts).select("group_id")
    fold = written(grouped_folds(counted(labelled.join(train, "group_id", "left_semi")), folds).withColumnRenamed("fold", "cv_fold"), "folds")
    out = nodes.join(part, "group_id", "left").join(fold, "group_id", "left")
    known = F.col("label").isNotNull()
    split = F.when(~known, "unlabelled").when(F.col("fold") < test_parts, "test").otherwise("train")
    return out.select("node_id", "group_id", split.alias("split"), F.when(known, F.col("cv_fold")).alias("cv_fold"))


def covariance(vectors: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(means, population covariance) of the columns. Each task adds up a Gram matrix of its rows, centred on the means; nulls are
    left out. One small row a task reaches the driver's sum."""
    k = len(columns)
    first = vectors.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(k)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - mean
            there = np.isfinite(x).astype(np.float64)
            x = np.where(there > 0, x, 0.0)
            gram += x.T @ x
            n += there.T @ there
        yield pa.record_batch([pa.array(np.arange(k * k), pa.int32()), pa.array(gram.ravel()), pa.array(n.ravel())], ["place", "total", "n"])

    out = np.zeros((2, k * k))
    parts = vectors.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "place int, total double, n double")
    for r in parts.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[:, r.place] = r.total, r.n
    return mean, (out[0] / np.maximum(out[1], 1)).reshape(k, k)


def train_pca(vectors: DataFrame, id_col: str, columns: list[str], fit: F.Column, k: int) -> DataFrame:
    """(id, pc1..pck): projections on the k first components of the rows where `fit` holds, centred on these rows' means; the
    loading of largest size of each component is positive."""
    mean, cov = covariance(vectors.where(fit), columns)
    _, vectors_of = np.linalg.eigh(cov)
    load = vectors_of[:, ::-1][:, :k]
    load = load * np.sign(load[np.abs(load).argmax(0), range(load.shape[1])])
    return vectors.select(id_col, *[F.round(sum((F.col(c) - float(mean[i])) * float(load[i, j]) for i, c in enumerate(columns)), 6).alias(f"pc{j + 1}") for j in range(load.shape[1])])


def effective_rank(vectors: DataFrame, columns: list[str]) -> DataFrame:
    """(constant, numerical_rank, effective_rank, k90): of the centred columns."""
    _, cov = covariance(vectors, columns)
    power = np.clip(np.linalg.eigvalsh(cov)[::-1], 0, None)
    sigma = np.sqrt(power)
    share = sigma / max(sigma.sum(), 1e-300)
    entropy = -(share[share > 0] * np.log(share[share > 0])).sum()
    row = (int((np.diag(cov) <= 1e-12).sum()), int((sigma > sigma[:1].max(initial=0) * 1e-6).sum()), round(float(math.exp(entropy)), 4), int((np.cumsum(power) / max(power.sum(), 1e-300) < 0.9).sum() + 1))
    return vectors.sparkSession.createDataFrame([row], "constant int, numerical_rank int, effective_rank double, k90 int")


def fan_out(spark: SparkSession, jobs: list[tuple], work: Callable[..., list[tuple]], ddl: str) -> DataFrame:
    """The rows of work(*job) of all jobs, a task each. What `work` closes over (a bounded sample) goes to the tasks once."""
    columns = [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows = work(*jobs[i])
                if rows:
                    yield pa.record_batch([pa.array(list(c)) for c in zip(*rows, strict=True)], columns)

    return spark.range(len(jobs)).repartition(max(1, len(jobs)), "id").mapInArrow(run, ddl)


def probe(rows: DataFrame, columns: list[str], trees: int = 30) -> DataFrame:
    """(fold, ap): a fixed boosted-tree probe fitted outside each saved fold and scored on it. rows: node_id, columns, label, fold."""
    _, x, y, fold = forest.sampled(rows, columns)

    def work(k: int) -> list[tuple]:
        model = forest.fit(x[fold != k], y[fold != k], trees=trees)
        return [(k, round(forest.ranking_score(y[fold == k], model.margin(x[fold == k])), 6))]

    return fan_out(rows.sparkSession, [(int(k),) for k in np.unique(fold)], work, "fold long, ap double")


def permutation_importance(rows: DataFrame, columns: list[str], shuffles: int = 10, trees: int = 30) -> DataFrame:
    """(name, importance, sd, folds, place): for each fold a probe fitted outside it, and the mean loss of AP on the fold over
    `shuffles` shuffles of one column; then mean and deviation over the folds, and the place by mean."""
    _, x, y, fold = forest.sampled(rows, columns)

    def work(k: int) -> list[tuple]:
        held = fold == k
        model, hx, hy = forest.fit(x[~held], y[~held], trees=trees), x[held], y[held]
        whole, out = forest.ranking_score(hy, model.margin(hx)), []
        for j, name in enumerate(columns):
            drops = []
            for s in range(shuffles):
                moved = hx.copy()
                moved[:, j] = moved[np.random.default_rng([17, k, s]).permutation(len(moved)), j]
                drops.append(whole - forest.ranking_score(hy, model.margin(moved)))
            out.append((k, name, float(np.mean(drops))))
        return out

    found = fan_out(rows.sparkSession, [(int(k),) for k in np.unique(fold)], work, "fold long, name string, drop double")
    out = found.groupBy("name").agg(F.round(F.avg("drop"), 6).alias("importance"), F.round(F.stddev_samp("drop"), 6).alias("sd"), F.count("*").alias("folds"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "name")))  # one row for each column


def importance_of(model: forest.Forest, x: np.ndarray) -> np.ndarray:
    """Mean absolute Shapley value of each column over all rows."""
    return np.abs(model.shapley(x)).mean(0) if len(x) else np.zeros(x.shape[1])


def roar(rows: DataFrame, columns: list[str], players: dict[str, list[str]], top_ks: tuple[int, ...] = (1, 2, 4), draws: int = 5, trees: int = 20, seed: int = 0) -> DataFrame:
    """(fold, kind, name, k, draw, pr_auc, drop): AP on each held-out fold after removing columns and fitting again: each player, the
    k columns of highest attribution in the fold's own baseline model, and k random columns (the same draws in every fold)."""
    _, x, y, fold = forest.sampled(rows, columns)
    removals = [("baseline", "baseline", 0, 0)] + [("block", n, len(c), 0) for n, c in sorted(players.items()) if len(c) < len(columns)]
    for k in top_ks:
        if k < len(columns):
            removals += [("top_k", f"top {k}", k, 0), *[("random", f"random {k}", k, d) for d in range(draws)]]

    def work(of: int, kind: str, name: str, k: int, draw: int) -> list[tuple]:
        held = fold == of
        first = forest.fit(x[~held], y[~held], trees=trees, depth=3)
        base = forest.ranking_score(y[held], first.margin(x[held]))
        if kind == "baseline":
            return [(of, kind, name, k, draw, round(base, 6), 0.0)]
        if kind == "top_k":
            gone = set(np.argsort(-importance_of(first, x[~held]), kind="stable")[:k].tolist())
        elif kind == "block":
            gone = {columns.index(c) for c in players[name]}
        else:
            gone = set(np.random.default_rng([seed, k, draw]).choice(len(columns), size=k, replace=False).tolist())
        keep = [j for j in range(len(columns)) if j not in gone]
        model = forest.fit(x[~held][:, keep], y[~held], trees=trees, depth=3)
        value = forest.ranking_score(y[held], model.margin(x[held][:, keep]))
        return [(of, kind, name, k, draw, round(value, 6), round(base - value, 6))]

    jobs = [(int(f), *r) for f in np.unique(fold) for r in removals]
    return fan_out(rows.sparkSession, jobs, work, "fold long, kind string, name string, k long, draw long, pr_auc double, drop double")


def tree_shapley(rows: DataFrame, columns: list[str], trees: int = 20, depth: int = 3) -> DataFrame:
    """(node_id, base, margin, phi_<column>...): exact Shapley values of a boosted-tree model fitted on the training rows, for every
    row; base + the values is the margin."""
    _, x, y, _ = forest.sampled(rows, columns)
    model = forest.fit(x, y, trees=trees, depth=depth)
    base = model.expected()

    def score(values: np.ndarray) -> np.ndarray:
        parts = model.shapley(values)
        return np.round(np.column_stack([np.full(len(values), base), model.margin(values), parts]), 9)

    return forest.scored(rows, columns, ["base", "margin", *[f"phi_{c}" for c in columns]], score)


def untrained_encoder(block: DataFrame, weights: DataFrame, columns: list[str], dim: int = 4, seed: int = 19) -> DataFrame:
    """(node_id, z1..zdim): two rounds of propagation along (node_id, nb, w) with fixed random weights and a leaky rectifier, the
    control for trained encoders. Columns are projected before each join, so edges carry `dim` values."""
    rng = np.random.default_rng(seed)
    names = [f"z{i + 1}" for i in range(dim)]

    def projected(frame: DataFrame, inputs: list[str]) -> DataFrame:
        m = rng.normal(size=(len(inputs), dim)) / math.sqrt(len(inputs))
        return frame.select("node_id", *[sum(F.col(c) * float(m[i, j]) for i, c in enumerate(inputs)).alias(names[j]) for j in range(dim)])

    h = projected(block, columns)
    for layer in range(2):
        sums = weights.join(h.withColumnRenamed("node_id", "nb"), "nb").groupBy("node_id").agg(*[F.sum(F.col("w") * F.col(z)).alias(z) for z in names])
        h = written(sums.select("node_id", *[F.when(F.col(z) > 0, F.col(z)).otherwise(0.25 * F.col(z)).alias(z) for z in names]), "encoded")
        if layer == 0:
            h = projected(h, names)
    return h.select("node_id", *[F.round(z, 5).alias(z) for z in names])


def cross_fitted(rows: DataFrame, columns: list[str], nested: bool, trees: int) -> tuple[list[tuple[int | None, int]], list[forest.Forest]]:
    """((outer fold, fold) pairs, the forest of each) of `cross_fit`, on all training rows: up to forest.SAMPLE_ROWS of them in tasks, more in
    passes over blocks."""
    of = lambda folds: [(o, k) for o in folds for k in folds if o != k] if nested else [(None, k) for k in folds]
    own = forest.training(rows, columns)
    total = own.count()
    if total > forest.SAMPLE_ROWS:
        blocks = passes.packed(own, columns, total)
        sizes = passes.fold_sizes(blocks)
        pairs, specs = of(sorted(sizes)), []
        for outer, k in pairs:
            n, p = (sum(v[i] for f, v in sizes.items() if f not in (outer, k)) for i in (0, 1))
            share = p / n if n else 0.5
            specs.append(passes.Spec(tuple(sorted({k, k if outer is None else outer})), np.arange(len(columns)), trees, 3, up=(1 - share) / max(share, 1e-9)))
        return pairs, passes.forests(blocks, len(columns), specs)
    _, x, y, fold = forest.gathered(own, columns)
    pairs = of([int(k) for k in np.unique(fold)])

    def fitted(outer: int | None, k: int) -> forest.Forest:
        use = (fold != k) & (fold != (k if outer is None else outer))
        share = y[use].mean() if use.any() else 0.5
        return forest.fit(x[use], y[use], trees=trees, depth=3, weight=np.where(y[use] == 1, (1 - share) / max(share, 1e-9), 1.0))

    def work(i: int) -> list[tuple]:
        return [(i, pickle.dumps(fitted(*pairs[i])))]

    made = {r.i: pickle.loads(r.model) for r in fan_out(rows.sparkSession, [(i,) for i in range(len(pairs))], work, "i long, model binary").collect()}
    return pairs, [made[i] for i in range(len(pairs))]


def cross_fit(rows: DataFrame, columns: list[str], nested: bool = False, trees: int = 20) -> DataFrame:
    """(outer_fold, node_id, score): out-of-fold scores of training rows, and for rows without a fold the mean over the folds'
    models. nested: for each outer fold the rows outside it are scored by models that saw neither their own fold nor the outer
    one; else outer_fold is null. Positives weigh as negatives do together. All training rows count. rows: node_id, columns, label, fold."""
    pairs, made = cross_fitted(rows, columns, nested, trees)
    names = [f"s{i}" for i in range(len(pairs))]
    wide = forest.scored(rows, columns, names, lambda v: np.round(np.column_stack([made[i].probability(v) for i in range(len(pairs))]), 6)) if pairs else rows.select("node_id").limit(0)
    # An array of (outer fold, fold that the model has not seen, score): the entries that are for this row's fold stay.
    entries = F.array(*[F.struct(F.lit(o).cast("int").alias("outer_fold"), F.lit(k).alias("k"), F.col(n).alias("s")) for (o, k), n in zip(pairs, names, strict=True)])
    joined = wide.join(rows.select(F.col("node_id").cast("long").alias("node_id"), "fold", "label"), "node_id")
    known = F.col("fold").isNotNull() & F.col("label").isNotNull()
    own = joined.where(known).select("node_id", "fold", F.explode(entries).alias("e")).where("e.k = fold").select("e.outer_fold", "node_id", F.col("e.s").alias("score"))
    if nested:
        return own
    mean = F.round(sum(F.col(n) for n in names) / len(names), 6)
    return own.unionByName(joined.where(~known).select(F.lit(None).cast("int").alias("outer_fold"), "node_id", mean.alias("score")))


def split_thresholds(rows: DataFrame, columns: list[str], trees: int = 20) -> DataFrame:
    """(name, threshold) of every split of a boosted-tree model fitted on the training rows, distinct."""
    _, x, y, _ = forest.sampled(rows, columns)
    found = forest.fit(x, y, trees=trees, depth=3).thresholds()
    return rows.sparkSession.createDataFrame([(columns[f], t) for f, t in found], "name string, threshold double")


def spearman(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation of ranks, ties in the middle; NaN for constants."""
    ranks = []
    for v in (a, b):
        values, place, times = np.unique(v, return_inverse=True, return_counts=True)
        ranks.append((np.cumsum(times) - (times - 1) / 2)[place])
    return float(np.corrcoef(*ranks)[0, 1]) if min(r.std() for r in ranks) > 0 else float("nan")


def randomisation_check(rows: DataFrame, columns: list[str], permutations: int = 3, trees: int = 20) -> DataFrame:
    """(run, pr_auc, total_mean_abs, spearman_with_true, prevalence): models fitted outside the first fold with the true labels and
    with permuted ones, attributed and scored on that fold."""
    _, x, y, fold = forest.sampled(rows, columns)
    held = fold == (fold.min() if len(fold) else 0)

    def run_of(labels: np.ndarray) -> tuple[float, np.ndarray]:
        model = forest.fit(x[~held], labels, trees=trees, depth=3)
        return forest.ranking_score(y[held], model.margin(x[held])), importance_of(model, x[held])

    def work(i: int) -> list[tuple]:
        ap, true = run_of(y[~held])
        if i < 0:
            return [("true labels", round(ap, 6), round(float(true.sum()), 6), 1.0, round(float(y[held].mean()), 6))]
        ap, own = run_of(np.random.default_rng([0, i]).permutation(y[~held]))
        return [(f"permuted labels {i}", round(ap, 6), round(float(own.sum()), 6), round(spearman(true, own), 6), round(float(y[held].mean()), 6))]

    return fan_out(rows.sparkSession, [(i,) for i in range(-1, permutations)], work, "run string, pr_auc double, total_mean_abs double, spearman_with_true double, prevalence double")


def compare_classifiers(train: DataFrame, blocks: dict[str, DataFrame]) -> DataFrame:
    """(block, classifier, fold, ap): `pyspark.ml` pipelines (scaling, then a classifier) fitted outside each fold on each block, and
    the AP on the fold. train: node_id, label, fold."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    kinds = {
        "logistic": LogisticRegression(featuresCol="z", maxIter=30, regParam=1e-3), "forest": RandomForestClassifier(featuresCol="z", numTrees=10, maxDepth=6, seed=3),
        "tree": DecisionTreeClassifier(featuresCol="z", maxDepth=6, seed=3),
    }
    out = None
    for block, features in blocks.items():
        columns = [c for c in features.columns if c != "node_id"]
        data = written(train.join(features, "node_id").select(F.col("label").cast("double").alias("label"), "fold", *columns), "block")
        for k in sorted(r.fold for r in data.select("fold").distinct().where("fold is not null").collect()):
            for name, kind in kinds.items():
                steps = [VectorAssembler(inputCols=columns, outputCol="x"), StandardScaler(inputCol="x", outputCol="z", withMean=True), kind]
                model = Pipeline(stages=steps).fit(data.where(F.col("fold") != k))
                scores = model.transform(data.where(F.col("fold") == k)).select("label", F.round(vector_to_array("probability")[1], 4).alias("s"))
                curve = scores.groupBy("s").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
                own = curve.select(F.lit(block).alias("block"), F.lit(name).alias("classifier"), F.lit(k).cast("long").alias("fold"), "s", "n", "p")
                out = own if out is None else out.unionByName(own)
    # One row for each distinct rounded score.
    steps = Window.partitionBy("block", "classifier", "fold").orderBy(F.desc("s"))
    curve = out.select("block", "classifier", "fold", "p", F.sum("p").over(steps).alias("tp"), F.sum("n").over(steps).alias("taken"))
    return curve.groupBy("block", "classifier", "fold").agg(F.round(F.sum(F.col("p") * F.col("tp") / F.col("taken")) / F.sum("p"), 6).alias("ap"))


def nearest(vectors: DataFrame, queries: DataFrame, columns: list[str], k: int = 5, block: int = 4096) -> DataFrame:
    """(node_id, near, place): for each query the k nearest other vectors (squared distance rounded to 5 digits, then id), exactly, in
    blocks: blocks of queries meet blocks of vectors, each meeting keeps k for each query, and these few are ranked. Rows of
    a block go through the shuffle once for each block of queries."""
    count, groups = queries.count(), max(1, vectors.count() // (8 * block))
    parts = max(1, -(-count // block))
    packed = lambda f, b: f.select(F.pmod(F.xxhash64("node_id"), F.lit(b)).cast("int").alias("b"), F.struct(F.col("node_id").cast("long").alias("node_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v")).alias("s")).groupBy("b").agg(F.collect_list("s").alias("s"))
    q = packed(queries, parts).select(F.col("b").alias("qb"), F.col("s").alias("q"))
    v = packed(vectors, groups).select(F.col("b").alias("vb"), F.col("s").alias("v")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, other in zip(batch.column(0), batch.column(1), strict=True):
                own, other = own.values, other.values
                ids, to = own.field("node_id").to_numpy(), other.field("node_id").to_numpy()
                x, y = (f.field("v").flatten().to_numpy().reshape(len(f), -1) for f in (own, other))
                order = np.argsort(to, kind="stable")
                to, y = to[order], y[order]
                for i in range(0, len(ids), 256):
                    d = np.zeros((len(ids[i : i + 256]), len(to)))
                    for c in range(x.shape[1]):
                        d += (x[i : i + 256, None, c] - y[None, :, c]) ** 2
                    d = np.where(ids[i : i + 256, None] == to[None, :], np.inf, np.round(d, 5))
                    at = np.argsort(d, axis=1, kind="stable")[:, :k]
                    best = np.take_along_axis(d, at, 1)
                    real = np.isfinite(best)
                    yield pa.record_batch([pa.array(np.repeat(ids[i : i + 256], real.sum(1))), pa.array(to[at][real]), pa.array(best[real])], ["node_id", "near", "d"])

    few = q.join(v, "qb").select("q", "v").mapInArrow(run, "node_id long, near long, d double")
    return few.withColumn("place", F.row_number().over(Window.partitionBy("node_id").orderBy("d", "near"))).where(F.col("place") <= k).select("node_id", "near", "place")


def propagated(values: DataFrame, columns: list[str], weights: DataFrame, prefix: str = "p_") -> DataFrame:
    """(relation, node_id, prefix + columns): weighted sums of the neighbours' values. weights: relation, node_id, nb, w."""
    near = values.select(F.col("node_id").alias("nb"), *[F.col(c).alias(f"__{c}") for c in columns])
    return weights.join(near, "nb").groupBy("relation", "node_id").agg(*[F.sum(F.col("w") * F.col(f"__{c}")).alias(f"{prefix}{c}") for c in columns])


def dgi_inputs(values: DataFrame, columns: list[str], weights: DataFrame, seed: int = 29) -> DataFrame:
    """(relation, node_id, p_*, q_*): propagated values, and those of a graph whose nodes got the values of others (the corruption)."""
    moved = dealt(values, "node_id", seed).join(values.select(F.col("node_id").alias("from_node_id"), *columns), "from_node_id").select("node_id", *columns)
    return written(propagated(values, columns, weights).join(propagated(moved, columns, weights, "q_"), ["relation", "node_id"]), "dgi-inputs")


def removal_influence(h: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """(relation, target, neighbour, delta): exact change of a target's one-layer graph convolution of `column` when the edge to one
    neighbour goes: its degree changes, and so do the weights of all its other edges. h: node_id,
    column; edges: directed relation, node_id, nb, each once in both directions. The sum over the others comes from one aggregate."""
    degree = edges.groupBy("relation", "node_id").agg(F.count("*").alias("d"))
    known = degree.join(h.select("node_id", F.col(column).alias("v")), "node_id").select("relation", "node_id", "v", "d")
    near = known.select("relation", F.col("node_id").alias("nb"), F.col("v").alias("nv"), F.col("d").alias("nd"))
    each = edges.select("relation", "node_id", "nb").join(near, ["relation", "nb"]).withColumn("part", F.col("nv") / F.sqrt(F.col("nd") + 1.0))
    whole = each.groupBy("relation", "node_id").agg(F.sum("part").alias("total"))
    rows = each.join(whole, ["relation", "node_id"]).join(known, ["relation", "node_id"])
    before = F.col("total") / F.sqrt(F.col("d") + 1.0) + F.col("v") / (F.col("d") + 1.0)
    after = F.when(F.col("d") > 1, (F.col("total") - F.col("part")) / F.sqrt(F.col("d") * 1.0)).otherwise(0.0) + F.col("v") / F.col("d")
    return rows.select("relation", F.col("node_id").alias("target"), F.col("nb").alias("neighbour"), (F.round(before - after, 6) + 0.0).alias("delta"))


def predict(model_path: str, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(node_id, prob, predicted) of a saved boosted-tree model over a table: batch scoring where a request service was."""
    from pyspark.ml.classification import GBTClassificationModel

    model = GBTClassificationModel.load(model_path)
    data = VectorAssembler(inputCols=columns, outputCol="x").transform(rows)
    return model.transform(data).select("node_id", F.round(vector_to_array("probability")[1], 6).alias("prob"), F.col("prediction").cast("int").alias("predicted"))
