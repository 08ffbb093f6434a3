"""Attributions of a fitted margin: interventional values, interactions, blocks of columns, single neighbours, counterfactuals.

A model is any margin function of a matrix; the tree forms need a forest. Background rows and fitted forests are bounded and
travel with the tasks; rows, edges and orders of neighbours stay distributed, and what is asked of the model is evaluated batch by batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.operators import forest
from quillmesh.storage import written

Margin = Callable[[np.ndarray], np.ndarray]

#: Rows that stand for unknown columns, and rows that a batch asks the model for at once.
BACKGROUND = 64
ASKED = 200_000
MOST_PLAYERS = 12
#: Neighbours of one target in a stretch of an order; longer orders are added up stretch by stretch.
STRETCH = 4096
RANGE_SLACK = 1e-6


def players_of(columns: Sequence[str]) -> dict[str, list[int]]:
    """Players by column name: degrees of all relations together, neighbour means by relation, and other columns by their block."""
    out: dict[str, list[int]] = {}
    for i, name in enumerate(columns):
        block, _, rest = name.partition("__")
        player = "degree" if rest.endswith("log1p_degree") else f"{block}_{rest.split('_mean_')[0]}" if "_mean_" in rest else block
        out.setdefault(player, []).append(i)
    return out


def background_of(rows: DataFrame, columns: list[str], most: int = BACKGROUND) -> np.ndarray:
    """The values of the `most` rows with the smallest hashed ids."""
    found = rows.select(F.xxhash64("node_id", F.lit(7)).alias("h"), "node_id", *[F.col(c).cast("double") for c in columns]).orderBy("h", "node_id").limit(most).toPandas()
    return np.nan_to_num(found[columns].to_numpy(float))


def interventional_shapley(rows: DataFrame, columns: list[str], model: forest.Forest, background: np.ndarray) -> DataFrame:
    """(node_id, base, margin, phi_<column>...) of every row: base is the mean margin of the background, and base + values is the margin."""
    base = float(model.margin(background).mean())

    def score(x: np.ndarray) -> np.ndarray:
        return np.round(np.column_stack([np.full(len(x), base), model.margin(x), model.shapley_against(x, background)]), 9)

    return forest.scored(rows, columns, ["base", "margin", *[f"phi_{c}" for c in columns]], score)


def interactions(rows: DataFrame, columns: list[str], model: forest.Forest, top: int = 5) -> DataFrame:
    """(a, b, mean_abs_interaction, own_x_graph, n_rows) of pairs of the `top` columns by mean absolute Shapley value and all degree
    columns, over all rows. A pair's interaction is both of its halves together."""
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, k)), 0
        for batch in batches:
            x = np.nan_to_num(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])) if batch.num_rows else np.zeros((0, k))
            for i in range(0, len(x), 2000):
                own = model.interactions(x[i : i + 2000])
                pairs = 2 * np.abs(own)
                pairs[:, np.arange(k), np.arange(k)] = np.abs(own.sum(2))  # in the diagonal the columns' own values
                total += pairs.sum(0)
                n += len(own)
        yield pa.record_batch([pa.array(np.repeat(np.arange(k), k)), pa.array(np.tile(np.arange(k), k)), pa.array(total.ravel()), pa.array(np.full(k * k, n))], ["i", "j", "total", "n"])

    sums = rows.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "i long, j long, total double, n long").groupBy("i", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    found, n = {(r.i, r.j): r.total for r in sums}, sums[0].n if sums else 0
    ranked = sorted(range(k), key=lambda c: (-found.get((c, c), 0.0), c))[:top]
    chosen = list(dict.fromkeys(ranked + [i for i, c in enumerate(columns) if c.endswith("log1p_degree")]))
    out = []
    for p, a in enumerate(chosen):
        for b in chosen[p + 1 :]:
            kinds = {columns[c].startswith("own__") for c in (a, b)}
            out.append((columns[a], columns[b], round(found.get((a, b), 0.0) / max(n, 1), 9), len(kinds) == 2, n))
    return rows.sparkSession.createDataFrame(out, "a string, b string, mean_abs_interaction double, own_x_graph boolean, n_rows long")


def block_shapley(margin: Margin, x: np.ndarray, background: np.ndarray, players: Sequence[Sequence[int]]) -> np.ndarray:
    """rows x players: exact Shapley values with blocks of columns as players, where columns of unknown players are those of each
    background row in turn. All coalitions of a few rows are made as one matrix, so the model is asked for at most ASKED rows
    (or one row's) at a time."""
    p, m = len(players), len(background)
    if p > MOST_PLAYERS:
        raise ValueError(f"{p} players have {2**p} coalitions; put columns together")
    known = np.zeros((1 << p, x.shape[1]), bool)
    for i, own in enumerate(players):
        known[(np.arange(1 << p) >> i & 1).astype(bool)[:, None] & np.isin(np.arange(x.shape[1]), own)] = True
    out, step = np.zeros((len(x), p)), max(1, ASKED // (m << p))
    size = np.array([s.bit_count() for s in range(1 << p)])
    weight = np.array([math.factorial(s) * math.factorial(max(p - s - 1, 0)) / math.factorial(p) for s in range(p + 1)])
    for at in range(0, len(x), step):
        part = x[at : at + step]
        asked = np.where(known[None, :, None, :], part[:, None, None, :], background[None, None, :, :])
        value = margin(asked.reshape(-1, x.shape[1])).reshape(len(part), 1 << p, m).mean(2)
        for i in range(p):
            without = np.flatnonzero((np.arange(1 << p) >> i & 1) == 0)
            out[at : at + step, i] = (value[:, without | 1 << i] - value[:, without]) @ weight[size[without]]
    return out


def group_shapley(rows: DataFrame, columns: list[str], margin: Margin, background: np.ndarray, players: dict[str, list[int]] | None = None) -> DataFrame:
    """(node_id, base, margin, group_<player>...) of every row; base + values is the margin."""
    players = players_of(columns) if players is None else players
    base = float(margin(background).mean())

    def score(x: np.ndarray) -> np.ndarray:
        return np.round(np.column_stack([np.full(len(x), base), margin(x), block_shapley(margin, x, background, list(players.values()))]), 9)

    return forest.scored(rows, columns, ["base", "margin", *[f"group_{n}" for n in players]], score)


@dataclass
class Layout:
    """Where a relation's means and degree stand among the model's columns; `own` are the columns averaged, in the order of `means`."""

    means: list[int]
    own: list[str]
    degree: int | None


def layouts_of(columns: Sequence[str]) -> dict[str, Layout]:
    """The layouts of all relations, from columns nbr__<relation>_mean_<own> and nbr__<relation>_log1p_degree."""
    out: dict[str, Layout] = {}
    for i, name in enumerate(columns):
        if not name.startswith("nbr__"):
            continue
        relation, mean, own = name[5:].partition("_mean_")
        if mean:
            at = out.setdefault(relation, Layout([], [], None))
            at.means.append(i)
            at.own.append(f"own__{own}")
        elif relation.endswith("_log1p_degree"):
            out.setdefault(relation.removesuffix("_log1p_degree"), Layout([], [], None)).degree = i
    return out


def _around(targets: DataFrame, columns: list[str], own: DataFrame, edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """A row for each edge of a target: relation, target, neighbour, the neighbour's own columns v_*, and the target's model columns."""
    values = sorted({c for layout in layouts_of(columns).values() for c in layout.own})
    near = own.select(F.col("node_id").alias("neighbour"), *[F.col(c).cast("double").alias(f"v_{c}") for c in values])
    ends = edges.select("relation", F.col("node_id").alias("target"), F.col("nb").alias("neighbour"))
    mine = targets.select(F.col("node_id").alias("target"), *[F.col(c).cast("double") for c in columns])
    return ends.join(mine.select("target"), "target", "left_semi").join(near, "neighbour"), values


def _numbers(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]).astype(float)


def _with_means(x: np.ndarray, layout: Layout, values: list[str], sums: np.ndarray, count: np.ndarray, degree: bool) -> np.ndarray:
    """x with a relation's means made from sums over `count` neighbours (0 without any), and its degree if asked."""
    out = x.copy()
    at = [values.index(c) for c in layout.own]
    out[:, layout.means] = np.where(count[:, None] > 0, sums[:, at] / np.maximum(count, 1)[:, None], 0.0)
    if degree and layout.degree is not None:
        out[:, layout.degree] = np.log1p(count)
    return out


def neighbour_influence(targets: DataFrame, columns: list[str], own: DataFrame, edges: DataFrame, margin: Margin, ranges: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(relation, target, neighbour, degree, delta_margin, delta_prob, delta_prob_mean, out_of_range) for every neighbour of every target:
    how far the score falls without that neighbour; delta_prob_mean with the degree column held. edges: (relation, node_id, nb),
    both ways. ranges: least and largest training value of each column."""
    layouts = layouts_of(columns)
    near, values = _around(targets, columns, own, edges)
    sums = near.groupBy("relation", "target").agg(F.count("*").alias("degree"), *[F.sum(f"v_{c}").alias(f"s_{c}") for c in values])
    mine = targets.select(F.col("node_id").alias("target"), *[F.col(c).cast("double") for c in columns])
    rows = near.join(sums, ["relation", "target"]).join(mine, "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.nan_to_num(_numbers(batch, columns))
            v, s = _numbers(batch, [f"v_{c}" for c in values]), _numbers(batch, [f"s_{c}" for c in values])
            d, kinds = batch.column(2).to_numpy(zero_copy_only=False), np.array(batch.column(0).to_pylist(), object)
            mean, whole, beyond = x.copy(), x.copy(), np.zeros(len(x), bool)
            for relation, layout in layouts.items():
                at = np.flatnonzero(kinds == relation)
                if len(at):
                    mean[at] = _with_means(x[at], layout, values, (s - v)[at], d[at] - 1, False)
                    whole[at] = _with_means(x[at], layout, values, (s - v)[at], d[at] - 1, True)
                    used = layout.means + ([] if layout.degree is None else [layout.degree])
                    beyond[at] = ((whole[at][:, used] < ranges[0][used] - RANGE_SLACK) | (whole[at][:, used] > ranges[1][used] + RANGE_SLACK)).any(1)
            now, held, gone = margin(x), margin(mean), margin(whole)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), batch.column(2), pa.array(np.round(now - gone, 9)), pa.array(np.round(_chance(now) - _chance(gone), 9)), pa.array(np.round(_chance(now) - _chance(held), 9)), pa.array(beyond)], ["relation", "target", "neighbour", "degree", "delta_margin", "delta_prob", "delta_prob_mean", "out_of_range"])

    rows = rows.select("relation", "target", "degree", "neighbour", *columns, *[f"v_{c}" for c in values], *[f"s_{c}" for c in values])
    return rows.mapInArrow(run, "relation string, target long, neighbour long, degree long, delta_margin double, delta_prob double, delta_prob_mean double, out_of_range boolean")


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def neighbour_shapley(targets: DataFrame, columns: list[str], own: DataFrame, edges: DataFrame, margin: Margin, orders: int = 4, seed: int = 0) -> DataFrame:
    """(relation, target, neighbour, phi): sampled Shapley values, in units of the margin, of each target's neighbours in a relation: over
    `orders` orders (a hashed one and its reverse by turns) the mean of what a neighbour adds to the margin, where the means and
    the degree are those of the neighbours so far. They sum to f(all) - f(none). Orders of many neighbours are added up in stretches
    of about STRETCH, so no task holds a hub."""
    layouts = layouts_of(columns)
    near, values = _around(targets, columns, own, edges)
    near = written(near, "neighbours")
    sizes = near.groupBy("relation", "target").agg(F.count("*").alias("degree"))
    turn = F.explode(F.array(*[F.lit(i) for i in range(orders)])).alias("turn")
    rows = near.join(sizes, ["relation", "target"]).select("*", turn)
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.shiftright("turn", 1), "target", "neighbour"), 11) / F.lit(float(1 << 53))
    rows = rows.withColumn("place", F.when(F.col("turn") % 2 == 0, place).otherwise(1 - place)).withColumn("order", F.when(F.col("turn") % 2 == 0, F.col("neighbour")).otherwise(-F.col("neighbour")))
    rows = rows.withColumn("stretch", F.floor(F.col("place") * (1 + F.floor(F.col("degree") / STRETCH))))
    key = ["relation", "target", "turn"]
    # Earlier stretches of long orders; most targets have one stretch and need none.
    parts = rows.where(F.col("degree") >= STRETCH).groupBy(*key, "stretch").agg(F.count("*").alias("n"), *[F.sum(f"v_{c}").alias(f"v_{c}") for c in values])
    before = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), *[F.coalesce(F.sum(f"v_{c}").over(before), F.lit(0.0)).alias(f"b_{c}") for c in values])
    so_far = Window.partitionBy(*key, "stretch").orderBy("place", "order").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*key, "stretch", "neighbour", F.count("*").over(so_far).alias("n"), *[f"v_{c}" for c in values], *[F.sum(f"v_{c}").over(so_far).alias(f"s_{c}") for c in values])
    rows = rows.join(parts, [*key, "stretch"], "left").join(targets.select(F.col("node_id").alias("target"), *[F.col(c).cast("double") for c in columns]), "target")
    rows = rows.select("relation", "target", "neighbour", (F.col("n") + F.coalesce("n_before", F.lit(0))).alias("n"), *columns, *[f"v_{c}" for c in values], *[(F.col(f"s_{c}") + F.coalesce(f"b_{c}", F.lit(0.0))).alias(f"s_{c}") for c in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.nan_to_num(_numbers(batch, columns))
            v, s = _numbers(batch, [f"v_{c}" for c in values]), _numbers(batch, [f"s_{c}" for c in values])
            n, kinds = batch.column(3).to_numpy(zero_copy_only=False), np.array(batch.column(0).to_pylist(), object)
            now, was = x.copy(), x.copy()
            for relation, layout in layouts.items():
                at = np.flatnonzero(kinds == relation)
                if len(at):
                    now[at] = _with_means(x[at], layout, values, s[at], n[at], True)
                    was[at] = _with_means(x[at], layout, values, (s - v)[at], n[at] - 1, True)
            yield pa.record_batch([*batch.columns[:3], pa.array(margin(now) - margin(was))], ["relation", "target", "neighbour", "added"])

    added = rows.mapInArrow(run, "relation string, target long, neighbour long, added double")
    return added.groupBy("relation", "target", "neighbour").agg(F.round(F.avg("added"), 9).alias("phi"))


def counterfactuals(targets: DataFrame, columns: list[str], model: forest.Forest, background: np.ndarray, influence: DataFrame, threshold: float = 0.5, top: int = 5) -> DataFrame:
    """(node_id, prob, kind, name, to_value, new_prob, crosses_threshold) of every target: the largest change of its score that crosses
    the threshold (or the largest of all, if none does) among setting one of its `top` columns by attribution to the background's
    median and taking away one neighbour. Ties go to the smallest kind and name. A description of the model, not advice."""
    medians = np.median(background, axis=0) if len(background) else np.zeros(len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.nan_to_num(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(float))
            prob = np.round(_chance(model.margin(x)), 9)
            best = np.argsort(-np.abs(np.round(model.shapley(x), 12)), axis=1, kind="stable")[:, :top]
            at, column = np.repeat(np.arange(len(x)), best.shape[1]), best.ravel()
            changed = x[at]
            changed[np.arange(len(at)), column] = medians[column]
            new = np.round(_chance(model.margin(changed)), 9)
            yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(prob[at]), pa.array(["feature"] * len(at)), pa.array([columns[c] for c in column]), pa.array(medians[column]), pa.array(new)], ["node_id", "prob", "kind", "name", "to_value", "new_prob"])

    single = targets.select(F.col("node_id").cast("long"), *[F.col(c).cast("double") for c in columns]).mapInArrow(run, "node_id long, prob double, kind string, name string, to_value double, new_prob double")
    prob = forest.scored(targets, columns, ["prob"], lambda x: np.round(_chance(model.margin(x)), 9)[:, None])
    name = F.concat(F.col("neighbour").cast("string"), F.lit(" ("), F.col("relation"), F.lit(")"))
    gone = influence.join(prob, F.col("target") == F.col("node_id")).select("node_id", "prob", F.lit("neighbour").alias("kind"), name.alias("name"), F.lit(None).cast("double").alias("to_value"), F.round(F.col("prob") - F.col("delta_prob"), 9).alias("new_prob"))
    every = single.unionByName(gone).withColumn("crosses_threshold", (F.col("new_prob") >= threshold) != (F.col("prob") >= threshold))
    least = F.struct(~F.col("crosses_threshold"), -F.round(F.abs(F.col("new_prob") - F.col("prob")), 9), F.col("kind"), F.col("name"))
    picked = every.groupBy("node_id").agg(F.min_by(F.struct("prob", "kind", "name", "to_value", "new_prob", "crosses_threshold"), least).alias("c"))
    return picked.select("node_id", "c.*")
