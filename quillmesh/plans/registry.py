"""All registered queries of the reference's operators: templates with oracles, and operators without an SQL form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quillmesh.operators.explain
import quillmesh.operators.graph
import quillmesh.operators.metrics
import quillmesh.operators.resultsdb  # noqa: F401  these define the templates
from quillmesh.operators import attention, attributions, bootstraps, edge_removal, encoders, forest, infomax, models, networks, refits, search
from quillmesh.plans.dialect import LIBRARY
from quillmesh.sources import files, mat_source
from quillmesh.storage import commit, committed, run_dir, table, written


def _get(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Templates that share their built inputs."""
    built: dict = {}
    return [LIBRARY.apply(spark, n, lambda t: table(spark, sf_dir, t), None, built) for n in names]


OWN = [f"own__f0{i}" for i in range(7)]
RELATIONS = ["cdp", "cns", "cpm"]


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _get(spark, sf_dir, "node_table", "edges_canonical")
    return models.component_groups(nodes, edges)


def swap_rewire(spark: SparkSession, sf_dir: str) -> DataFrame:
    (edges,) = _get(spark, sf_dir, "edges_canonical")
    return models.swap_rewire(edges)[0]


def rewired_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every degree before and after: the two must be equal."""
    own = written(_get(spark, sf_dir, "edges_canonical")[0], "edges")
    count = lambda e, name: e.select("relation", F.col("src").alias("node_id")).unionByName(e.select("relation", F.col("dst").alias("node_id"))).groupBy("relation", "node_id").agg(F.count("*").alias(name))
    return count(own, "before").join(count(models.swap_rewire(own)[0], "after"), ["relation", "node_id"], "full")


def rewired_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    (edges,) = _get(spark, sf_dir, "edges_canonical")
    return models.rewired_report(edges)


def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    (nodes,) = _get(spark, sf_dir, "split_nodes")
    groups = nodes.where("label is not null").groupBy("group_id").agg(F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives"))
    return models.grouped_folds(groups, 5)


def stratified_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    (nodes,) = _get(spark, sf_dir, "node_table")
    return models.stratified_group_split(nodes)


def results_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked appends of result rows, an entry for each kind of model, read back with their run ids."""
    (rows,) = _get(spark, sf_dir, "combined_results")
    path, kept = f"{run_dir(spark)}/results-{uuid.uuid4().hex}", written(rows, "results")
    for model in ("gbt", "lr"):
        files.append_entry(kept.where(F.col("model") == model).groupBy("model").agg(F.count("*").alias("rows_in"), F.round(F.avg("cv_pr_auc"), 6).alias("cv_pr_auc")), path, f"run_{model}")
    return files.read_entries(spark, path).select("run_id", "model", "rows_in", "cv_pr_auc")


def edges_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written by relation; a read of one relation touches its folder only."""
    (edges,) = _get(spark, sf_dir, "edges_canonical")
    path = f"{run_dir(spark)}/edges-{uuid.uuid4().hex}"
    files.write_partitioned(edges, path)
    return spark.read.parquet(path).where("relation = 'cdp'").select("src", "dst")


def mat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations written as sparse variables of MAT files and read back: two of the three are asked for, the third is never read."""
    (directed,) = _get(spark, sf_dir, "adjacency_directed")
    directed = written(directed, "directed")
    size = (directed.agg(F.max("node_id")).first()[0] or 0) + 1
    path = f"{run_dir(spark)}/mat-{uuid.uuid4().hex}"
    mat_source.write_sparse(directed.select(F.col("relation").alias("name"), F.col("node_id").alias("row"), F.col("nb").alias("col"), F.lit(1.0).alias("value"), F.lit(size).alias("rows"), F.lit(size).alias("cols")), path)
    spark.dataSource.register(mat_source.MatSource)
    entries = spark.read.format("mat").option("path", path).option("variables", "cdp,cpm").load()
    return entries.where("row < col").select(F.col("name").alias("relation"), F.col("row").alias("src"), F.col("col").alias("dst"))


def committed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges committed, replaced by a second commit, and read back."""
    (edges,) = _get(spark, sf_dir, "edges_canonical")
    path = f"{run_dir(spark)}/committed-{uuid.uuid4().hex}"
    commit(edges.where("relation = 'cns'"), path)
    commit(edges, path)
    return committed(spark, path)


def changed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that differ between two digest tables: here one table's files against themselves and another's."""
    before = files.file_digests(spark, f"{sf_dir}/nation.parquet")
    after = before.unionByName(files.file_digests(spark, f"{sf_dir}/region.parquet"))
    return files.changed_files(before, after).groupBy("change").agg(F.count("*").alias("files"))


def _wide_embeddings(spark: SparkSession, sf_dir: str, places: int | None = None) -> DataFrame:
    """A column for each place of the vectors."""
    raw = table(spark, sf_dir, "embeddings")
    places = places or raw.agg(F.max(F.size("embedding"))).first()[0] or 0
    return raw.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"gnnraw__z{i + 1:02d}") for i in range(places)])


def pca_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _wide_embeddings(spark, sf_dir)
    return models.train_pca(z, "vec_id", z.columns[1:], F.col("vec_id") % 5 < 3, 4)


def projection_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components of standardised places, fitted on the training vectors."""
    z = _wide_embeddings(spark, sf_dir)
    fit = F.col("vec_id") % 5 < 3
    stats = z.where(fit).agg(*[f(c).alias(f"{n}_{c}") for c in z.columns[1:] for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = z.select("vec_id", *[((F.col(c) - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] or 1.0)).alias(c) for c in z.columns[1:]])
    return models.train_pca(scaled, "vec_id", z.columns[1:], fit, 2)


def raw_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_embeddings(spark, sf_dir, RAW_PLACES)


def embedding_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _wide_embeddings(spark, sf_dir)
    return models.effective_rank(z, z.columns[1:])


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    block, nodes = _get(spark, sf_dir, "own_block", "split_nodes")
    return block.join(nodes.where("split = 'train'").select("node_id", "label", F.col("cv_fold").alias("fold")), "node_id")


def _all_nodes(spark: SparkSession, sf_dir: str, block: DataFrame, nodes: DataFrame) -> DataFrame:
    return block.join(nodes.select("node_id", F.when(F.col("split") == "train", F.col("label")).alias("label"), F.col("cv_fold").alias("fold")), "node_id")


def gbt_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.probe(_training(spark, sf_dir), OWN)


def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.permutation_importance(_training(spark, sf_dir), OWN)


def roar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.roar(_training(spark, sf_dir), OWN, {"orders": OWN[1:4], "person": [OWN[0], *OWN[4:]]})


def _roar_scores(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"roar_scores": written(roar(spark, sf_dir).withColumnRenamed("drop", "fall"), "roar")}


def roar_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LIBRARY.apply(spark, "roar_summary", lambda t: table(spark, sf_dir, t), _roar_scores(spark, sf_dir))


def roar_top_or_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LIBRARY.apply(spark, "roar_top_or_random", lambda t: table(spark, sf_dir, t), _roar_scores(spark, sf_dir))


def tree_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    block, nodes = _get(spark, sf_dir, "own_block", "split_nodes")
    return models.tree_shapley(_all_nodes(spark, sf_dir, block, nodes), OWN)


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """Rows over own features and neighbour means, their columns, own features and edges."""
    own, near, nodes, edges = _get(spark, sf_dir, "own_block", "nbr_block", "split_nodes", "adjacency_directed")
    wide = written(own.join(near, "node_id").join(nodes.select("node_id", "split", "label", F.col("cv_fold").alias("fold")), "node_id"), "explained")
    return wide, [c for c in wide.columns if "__" in c], own, edges


def _explained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str], forest.Forest, DataFrame, DataFrame]:
    """Training rows and test rows over own features and neighbour means, their columns, a forest fitted on the former, own features
    and edges."""
    wide, columns, own, edges = _wide(spark, sf_dir)
    train = wide.where("split = 'train'")
    _, x, y, _ = forest.sampled(train, columns)
    return train, wide.where("split = 'test'"), columns, forest.fit(x, y, trees=20, depth=3), own, edges


def interventional_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every test row against training rows as background."""
    train, test, columns, model, *_ = _explained(spark, sf_dir)
    return attributions.interventional_shapley(test, columns, model, attributions.background_of(train, columns))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction values of the columns that count most and of the degrees, over all test rows."""
    _, test, columns, model, *_ = _explained(spark, sf_dir)
    return attributions.interactions(test, columns, model)


def group_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own features, the means of each relation and the degrees as five players."""
    train, test, columns, model, *_ = _explained(spark, sf_dir)
    return attributions.group_shapley(test, columns, model.margin, attributions.background_of(train, columns, GROUP_BACKGROUND))


def _influence(explained: tuple) -> DataFrame:
    train, test, columns, model, own, edges = explained
    found = train.agg(*[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"b_{c}") for c in columns]).first()
    ranges = tuple(np.array([found[f"{side}_{c}"] or 0.0 for c in columns], float) for side in "ab")
    return attributions.neighbour_influence(test, columns, own, edges, model.margin, ranges)


def forest_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each test node's score falls without each of its neighbours."""
    return _influence(_explained(spark, sf_dir))


def neighbour_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of every test node's neighbours in each relation."""
    _, test, columns, model, own, edges = _explained(spark, sf_dir)
    return attributions.neighbour_shapley(test, columns, own, edges, model.margin)


def counterfactual_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest single change for every test node, by the training rows' medians and its neighbours."""
    made = _explained(spark, sf_dir)
    train, test, columns, model, *_ = made
    return attributions.counterfactuals(test, columns, model, attributions.background_of(train, columns), _influence(made))


def near_best_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings within one standard deviation of the best, by scores over the saved folds."""
    train, _, columns, *_ = _explained(spark, sf_dir)
    return refits.near_best(written(refits.settings_scores(train, columns), "settings-scores"))


def _fits(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Importance of each column in the best setting's fits with three seeds and in those of the near-best settings."""
    train, test, columns, *_ = _explained(spark, sf_dir)
    chosen = refits.near_best(written(refits.settings_scores(train, columns), "settings-scores")).orderBy("setting").collect()
    names = [(f"seed {k}", refits.GRID[r.setting], k, -1) for r in chosen if r.role == "best" for k in (1, 2, 3)] + [(f"setting {r.setting}", refits.GRID[r.setting], 13, -1) for r in chosen if r.role == "near"]
    made = refits.importance_by_fit(test, columns, refits.fitted(train, columns, names), attributions.background_of(train, columns))
    return {"fit_importance": written(made, "fit-importance")}


def refit_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fits have each column among their first ten, and its mean rank."""
    return LIBRARY.apply(spark, "refit_recurrence", lambda t: table(spark, sf_dir, t), _fits(spark, sf_dir))


def block_share_across_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and largest share of each block in a fit's attributions."""
    return LIBRARY.apply(spark, "block_share_across_fits", lambda t: table(spark, sf_dir, t), _fits(spark, sf_dir))


def refit_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of each pair of refits."""
    return LIBRARY.apply(spark, "fit_agreement", lambda t: table(spark, sf_dir, t), _fits(spark, sf_dir))


def split_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of each pair of fits that leave out one saved fold."""
    train, test, columns, *_ = _explained(spark, sf_dir)
    folds = sorted(r.fold for r in train.select("fold").distinct().collect())
    made = refits.importance_by_fit(test, columns, refits.fitted(train, columns, [(f"split {k}", refits.Settings(), 13, int(k)) for k in folds]), attributions.background_of(train, columns))
    return LIBRARY.apply(spark, "fit_agreement", lambda t: table(spark, sf_dir, t), {"fit_importance": written(made, "split-importance")})


def null_graph_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the probe on own features alone, with degrees, with neighbour means, and with means over degree-keeping rewired graphs
    of several seeds: what of a gain is degree, what are columns of a random graph, what is structure."""
    own, near, degrees, nodes, edges = _get(spark, sf_dir, "own_block", "nbr_block", "deg_block", "split_nodes", "edges_canonical")
    own, edges = written(own, "own"), written(edges, "edges")
    train = written(nodes.where("split = 'train'").select("node_id", "label", F.col("cv_fold").alias("fold")), "train")
    parts = [("own", None, None, None), ("own_deg", degrees, None, None), ("own_nbr", near, None, None)]
    for seed in range(REWIRE_SEEDS):
        after = models.swap_rewire(edges, swaps_per_edge=REWIRE_SWAPS, seed=3 + 100 * seed)[0]
        kept = edges.join(after, ["relation", "src", "dst"], "left_semi").count() / max(edges.count(), 1)
        parts.append(("own_nbr_rewired", LIBRARY.apply(spark, "nbr_block", None, {"own_block": own, "edges_canonical": after}), 3 + 100 * seed, round(kept, 6)))
    out = None
    for name, block, seed, kept in parts:
        wide = own if block is None else own.join(block, "node_id")
        columns = wide.columns[1:]
        scored = models.probe(written(wide.join(train, "node_id"), "probe"), columns)
        row = scored.agg(F.lit(name).alias("block"), F.lit(seed).cast("int").alias("rewire_seed"), F.lit(len(columns)).alias("n_features"), F.round(F.avg("ap"), 6).alias("cv_pr_auc_mean"), F.round(F.stddev_samp("ap"), 6).alias("cv_pr_auc_sd"), F.lit(kept).cast("double").alias("edges_kept"))
        out = row if out is None else out.unionByName(row)
    return out


def sign_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops, nodes = _get(spark, sf_dir, "sign_hops", "split_nodes")
    wide = hops.groupBy("node_id").pivot("relation", ["cdp", "cns", "cpm"]).agg(*[F.first(f"h{k}_f0{i}").alias(f"h{k}_f0{i}") for k in range(3) for i in range(7)])
    columns = [f"cdp_h0_f0{i}" for i in range(7)] + [f"{r}_h{k}_f0{i}" for r in ("cdp", "cns", "cpm") for k in (1, 2) for i in range(7)]
    return encoders.cross_fit_mlp(_all_nodes(spark, sf_dir, wide, nodes), columns)[0]


def _standard(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Standardised own features (wide), weights of the relations and nodes."""
    weights, z, nodes = _get(spark, sf_dir, "gcn_weights", "standardise", "split_nodes")
    return written(z.groupBy("node_id").pivot("name", OWN).agg(F.first("z")), "wide"), weights, nodes


def _network_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int, list[int]]:
    """Blocks of own features and their propagation along each relation: (blocks, inputs, relations, folds)."""
    block, weights, nodes = _standard(spark, sf_dir)
    weights = written(weights, "weights")
    near = models.propagated(block, OWN, weights).groupBy("node_id").pivot("relation", RELATIONS).agg(*[F.first(f"p_{c}").alias(c) for c in OWN])
    columns = OWN + [f"{r}_{c}" for r in RELATIONS for c in OWN]
    own = nodes.where("split = 'train'").select("node_id", "label", F.col("cv_fold").alias("fold"))
    rows = block.join(near, "node_id", "left").fillna(0.0, columns).join(nodes.select("node_id", F.col("group_id").alias("group")), "node_id").join(own, "node_id", "left")
    folds = sorted(r.fold for r in own.select("fold").distinct().collect())
    return networks.packed_blocks(written(rows, "network-rows"), columns, weights, RELATIONS), len(columns), len(RELATIONS), folds


def rel_sage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of relational convolutions: a grid of settings, two seeds and all folds trained together, stopped early on whole
    groups; scores of the setting with the best mean validation score, over its seeds."""
    blocks, inputs, relations, folds = _network_blocks(spark, sf_dir)
    made = networks.train(blocks, inputs, relations, folds, networks.grid(), seeds=(0, 1), epochs=25, patience=5)
    best = networks.best_setting(made) if made else None
    return networks.scores(blocks, inputs, [m for m in made if m.setting == best])


def rel_sage_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with layer norm, residual and a head that reads both layers."""
    blocks, inputs, relations, folds = _network_blocks(spark, sf_dir)
    made = networks.train(blocks, inputs, relations, folds, [networks.Setting(dropout=0.3)], epochs=40, patience=6, norm=True, residual=True, jumping=True)
    return networks.scores(blocks, inputs, made)


def network_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each model of the grid reached: epochs run, its best epoch, and its average precision on the validation groups there."""
    blocks, inputs, relations, folds = _network_blocks(spark, sf_dir)
    made = networks.train(blocks, inputs, relations, folds, networks.grid(), epochs=40, patience=6)
    rows = [(m.setting.hidden, m.setting.dropout, m.setting.rate, m.fold, m.seed, len(m.losses), m.best_epoch + 1, round(m.best, 6), len(m.theta)) for m in made]
    return spark.createDataFrame(rows, "hidden int, dropout double, rate double, fold int, seed int, epochs_run int, best_epoch int, best_val_ap double, n_parameters int")


def dgi_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-supervised embeddings of 64 places, an encoder of two layers for each relation; test nodes count in no loss."""
    block, weights, nodes = _standard(spark, sf_dir)
    weights = written(weights, "weights")
    rows = models.dgi_inputs(block, OWN, weights).join(nodes.select("node_id", (F.col("split") != "test").alias("loss")), "node_id")
    return infomax.train_infomax(written(rows, "infomax-rows"), weights, RELATIONS, [f"p_{c}" for c in OWN], [f"q_{c}" for c in OWN], epochs=14)[0]


def _gat(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    block, _, nodes = _standard(spark, sf_dir)
    (edges,) = _get(spark, sf_dir, "adjacency_directed")
    rows = block.join(nodes.select("node_id", F.when(F.col("split") == "train", F.col("label")).alias("label")), "node_id")
    return attention.train_gat(rows, edges, OWN, ["cdp", "cns", "cpm"])[:2]


def gat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all nodes by a graph attention layer trained on the training nodes."""
    return _gat(spark, sf_dir)[0]


def gat_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How that layer spreads its attention, by relation and kind of target."""
    logits = written(_gat(spark, sf_dir)[1], "attention")
    return LIBRARY.apply(spark, "attention_summary", lambda t: table(spark, sf_dir, t), {"attention_logits": logits})


def untrained_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    block, weights, _ = _standard(spark, sf_dir)
    out = None
    for relation in ("cdp", "cns", "cpm"):
        z = models.untrained_encoder(block, weights.where(F.col("relation") == relation), OWN)
        own = z.select(F.lit(relation).alias("relation"), *z.columns)
        out = own if out is None else out.unionByName(own)
    return out


def cross_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    block, nodes = _get(spark, sf_dir, "own_block", "split_nodes")
    return models.cross_fit(_all_nodes(spark, sf_dir, block, nodes), OWN)


def nested_cross_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.cross_fit(_training(spark, sf_dir), OWN, nested=True)


def split_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.split_thresholds(_training(spark, sf_dir), OWN)


def randomisation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.randomisation_check(_training(spark, sf_dir), OWN)


def removal_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, edges = _get(spark, sf_dir, "own_block", "adjacency_directed")
    return models.removal_influence(own, edges, "own__f01")


def encoder_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(relation, target, neighbour, moved, delta): what each edge of a relation means to its target's embedding by that relation's trained
    encoder of two layers, and to a score on the embedding's principal components."""
    block, weights, nodes = _standard(spark, sf_dir)
    weights = written(weights, "weights")
    (edges,) = _get(spark, sf_dir, "adjacency_directed")
    edges, out = written(edges, "directed"), None
    rows = written(models.dgi_inputs(block, OWN, weights).join(nodes.select("node_id", (F.col("split") != "test").alias("loss")), "node_id"), "infomax-rows")
    z, _, theta = infomax.train_infomax(rows, weights, RELATIONS, [f"p_{c}" for c in OWN], [f"q_{c}" for c in OWN], hidden=16, dim=8, epochs=6)
    z, places = written(z, "embeddings"), [f"z{i + 1}" for i in range(8)]
    train = nodes.where("split = 'train'").select("node_id", "label", F.col("cv_fold").alias("fold"))
    for i, relation in enumerate(RELATIONS):
        _, x, y, _ = forest.sampled(z.where(F.col("relation") == relation).join(train, "node_id"), places)
        score = edge_removal.projected_score(x, y, 3, lambda v, t: search.logistic(v, t, 1e-3))
        encoder = infomax.parts(theta[i], len(OWN), 16, 8)
        own = edge_removal.removal_through_encoder(block, OWN, edges.where(F.col("relation") == relation), encoder, score).select(F.lit(relation).alias("relation"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def knn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest cards of every node whose id is divisible by 20, among all."""
    (made,) = _get(spark, sf_dir, "vectors")
    vectors = written(made, "vectors")
    return models.nearest(vectors, vectors.where("node_id % 20 = 0"), ["a", "b", "c"])


def _bootstrap(name: str, *scores: str) -> Callable[[SparkSession, str], DataFrame]:
    """A template over draws of groups, with what the draws add up to for each score made by `bootstraps`."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        test, order = (written(t, "drawn-from") for t in _get(spark, sf_dir, "test_scores", "group_order"))
        drawn = {f"drawn_{s}": bootstraps.drawn_scores(order, test, s) for s in scores}
        return LIBRARY.apply(spark, name, lambda t: table(spark, sf_dir, t), {"test_scores": test, "group_order": order, **drawn})

    query.__name__ = name
    return query


group_bootstrap, auroc_bootstrap, side_metrics = (_bootstrap(n, "pa") for n in ("group_bootstrap", "auroc_bootstrap", "side_metrics"))
paired_bootstrap, paired_auroc_bootstrap = (_bootstrap(n, "pa", "pb") for n in ("paired_bootstrap", "paired_auroc_bootstrap"))


def _drawn_importance(spark: SparkSession, sf_dir: str, name: str, draws: int) -> DataFrame:
    order, phi = (written(t, "drawn-from") for t in _get(spark, sf_dir, "group_order", "attributions"))
    by_group = LIBRARY.apply(spark, "group_attribution", None, {"attributions": phi})
    given = {"attributions": phi, "drawn_importance": bootstraps.drawn_importance(order, by_group, draws)}
    return LIBRARY.apply(spark, name, lambda t: table(spark, sf_dir, t), given)


def importance_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn_importance(spark, sf_dir, "importance_ci", bootstraps.DRAWS)


def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """It compares the first two draws, and reads no other."""
    return _drawn_importance(spark, sf_dir, "rank_agreement", 2)


def model_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking metrics of this library's own models: out-of-fold scores of boosted trees, SIGN and the relational convolution."""
    (nodes,) = _get(spark, sf_dir, "split_nodes")
    own = nodes.where("split = 'train'").select("node_id", F.col("label").alias("y"), F.col("cv_fold").alias("fold"))
    scores = cross_fit(spark, sf_dir).select("node_id", "score", F.lit("gbt").alias("model"))
    for name, made in (("sign", sign_mlp(spark, sf_dir)), ("sage", rel_sage(spark, sf_dir))):
        scores = scores.unionByName(made.select("node_id", "score", F.lit(name).alias("model")))
    predictions = scores.join(own, "node_id").select("model", F.lit("none").alias("selection"), F.lit("default").alias("settings"), "node_id", "y", "fold", F.round("score", 4).alias("prob"))
    return LIBRARY.apply(spark, "fold_scores", lambda t: table(spark, sf_dir, t), {"predictions": written(predictions, "predictions")})


def classifier_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, classifier, fold, ap): pipelines of several classifiers over feature blocks, fitted outside each saved fold."""
    own, near, nodes = _get(spark, sf_dir, "own_block", "nbr_block", "split_nodes")
    train = nodes.where("split = 'train'").select("node_id", "label", F.col("cv_fold").alias("fold"))
    return models.compare_classifiers(train, {"own": own, "own_nbr": own.join(near, "node_id")})


def classifier_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each classifier and selection within a budget of trials, beside its default, over the saved folds."""
    wide, columns, *_ = _wide(spark, sf_dir)
    return search.tuned_against_default(written(search.search(wide.where("split = 'train'"), columns), "trials"))


def saved_model_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits, saves to shared storage, loads and scores."""
    rows = _training(spark, sf_dir)
    path = f"{run_dir(spark)}/model-{uuid.uuid4().hex}"
    data = VectorAssembler(inputCols=OWN, outputCol="x").transform(rows).select("x", F.col("label").cast("double").alias("label"))
    GBTClassifier(featuresCol="x", maxIter=4, maxDepth=3, seed=11).fit(data).write().save(path)
    return models.predict(path, _get(spark, sf_dir, "own_block")[0], OWN)


def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the files of the small tables."""
    return files.file_digests(spark, f"{sf_dir}/nation.parquet").unionByName(files.file_digests(spark, f"{sf_dir}/region.parquet"))


#: Rewired graphs of the null-graph probe, and swaps tried for each edge.
REWIRE_SEEDS, REWIRE_SWAPS = 2, 2.0
#: Background rows of block Shapley values, which ask the model for each of them in each coalition.
GROUP_BACKGROUND = 16
#: Places of the embeddings in `raw_block`: all of them, named here as its oracle has to list them.
RAW_PLACES = 64

CUSTOM: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        components, swap_rewire, rewired_degrees, rewired_report, grouped_folds, pca_block, projection_2d, raw_block, embedding_rank, gbt_probe, permutation_importance, roar, roar_summary, roar_top_or_random, tree_shapley,
        interventional_shapley, interactions, group_shapley, forest_influence, neighbour_shapley, counterfactual_cards,
        near_best_settings, refit_recurrence, block_share_across_fits, refit_agreement, split_agreement, null_graph_probe,
        sign_mlp, rel_sage, rel_sage_deep, network_trials, dgi_embeddings, gat_scores, gat_attention, knn_cards, model_fold_scores, classifier_comparison, classifier_search, untrained_encoder, cross_fit, nested_cross_fit, split_thresholds, randomisation_check, removal_influence, encoder_removal, saved_model_predict, file_digests, stratified_group_split,
        results_sink, edges_sink, changed_tables, mat_round_trip, committed_edges,
        importance_ci, paired_auroc_bootstrap, paired_bootstrap, auroc_bootstrap, group_bootstrap, rank_agreement, side_metrics,
    )
}
#: Operators that stand for a template, whose oracle holds for them too.
AS_TEMPLATES = ("knn_cards", "importance_ci", "paired_auroc_bootstrap", "paired_bootstrap", "auroc_bootstrap", "group_bootstrap", "rank_agreement", "side_metrics")
#: The survey's rows that each operator without a template, or with one that is given its input, stands for.
COVERS = {
    "components": "O-GR2", "swap_rewire": "O-GR14", "rewired_report": "O-GR15", "grouped_folds": "O-SP1", "pca_block": "O-FT7", "projection_2d": "O-FT8", "embedding_rank": "O-AU12", "raw_block": "O-ST12", "gbt_probe": "O-EV19", "permutation_importance": "O-EV20",
    "tree_shapley": "O-EX25", "interventional_shapley": "O-EX25", "interactions": "O-EX27", "group_shapley": "O-EX16", "neighbour_shapley": "O-EX12", "forest_influence": "O-EX10 O-EX28", "counterfactual_cards": "O-EX29", "removal_influence": "O-EX15", "encoder_removal": "O-EX14 O-EX15", "randomisation_check": "O-EX19",
    "near_best_settings": "O-EX26", "refit_recurrence": "O-EX22", "block_share_across_fits": "O-EX22", "refit_agreement": "O-EX26", "split_agreement": "O-EX23", "roar": "O-EX17", "null_graph_probe": "O-ML16", "classifier_search": "O-ML13", "classifier_comparison": "O-ML13", "saved_model_predict": "O-ML15 O-IO16",
    "rel_sage": "O-ML3 O-ML7 O-ML9", "rel_sage_deep": "O-ML3", "network_trials": "O-ML9", "dgi_embeddings": "O-ML1 O-ST6", "untrained_encoder": "O-ML2", "sign_mlp": "O-ML4", "cross_fit": "O-ML8", "nested_cross_fit": "O-ML8", "split_thresholds": "O-ST15", "file_digests": "O-IO7",
    "results_sink": "O-IO10", "mat_round_trip": "O-IO1", "committed_edges": "O-IO5",
}
QUERIES = {n: LIBRARY.query(n) for n in LIBRARY.public} | CUSTOM
ORACLES = {n: LIBRARY.oracle(n) for n in LIBRARY.public if n not in CUSTOM or n in AS_TEMPLATES} | {
    "raw_block": "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS gnnraw__z{i + 1:02d}" for i in range(RAW_PLACES)) + " FROM embeddings",
    "edges_sink": LIBRARY.oracle("edges_canonical").replace("SELECT * FROM edges_canonical", "SELECT src, dst FROM edges_canonical WHERE relation = 'cdp'"),
    "mat_round_trip": LIBRARY.oracle("edges_canonical").replace("SELECT * FROM edges_canonical", "SELECT relation, src, dst FROM edges_canonical WHERE relation IN ('cdp', 'cpm')"),
    "committed_edges": LIBRARY.oracle("edges_canonical"),
    "results_sink": LIBRARY.oracle("combined_results").replace("SELECT * FROM combined_results", "SELECT 'run_' || model AS run_id, model, count(*) AS rows_in, round(avg(cv_pr_auc), 6) AS cv_pr_auc FROM combined_results GROUP BY model"),
    # Both sides of the removal, summed over all neighbours but one.
    "removal_influence": LIBRARY.oracle("adjacency_directed").replace("SELECT * FROM adjacency_directed", """, own AS (SELECT c.c_custkey AS node_id, CAST(coalesce(f.orders, 0) AS DOUBLE) AS v FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey) f ON f.o_custkey = CASE WHEN c.c_custkey % 9 IN (4, 5) THEN c.c_custkey - c.c_custkey % 9 + 3 ELSE c.c_custkey END),
        deg AS (SELECT relation, node_id, count(*) AS d FROM adjacency_directed GROUP BY relation, node_id),
        parts AS (SELECT a.relation, a.node_id, a.nb, o.v / sqrt(d.d + 1e0) AS part FROM adjacency_directed a JOIN own o ON o.node_id = a.nb JOIN deg d ON d.relation = a.relation AND d.node_id = a.nb),
        others AS (SELECT relation, node_id, nb, part, sum(part) OVER (PARTITION BY relation, node_id) AS every FROM parts)
        SELECT p.relation, p.node_id AS target, p.nb AS neighbour, round(p.every / sqrt(g.d + 1e0) + t.v / (g.d + 1e0) - CASE WHEN g.d > 1 THEN (p.every - p.part) / sqrt(g.d + 0e0) ELSE 0e0 END - t.v / g.d, 6) + 0e0 AS delta
        FROM others p JOIN own t ON t.node_id = p.node_id JOIN deg g ON g.relation = p.relation AND g.node_id = p.node_id""").replace(") , own AS", "), own AS"),
}
