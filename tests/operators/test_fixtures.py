"""Hand-checked numbers: operators applied to small DataFrames through their public interface."""

import math

import pytest

import quillmesh.plans.registry  # noqa: F401
from quillmesh.operators import models
from quillmesh.operators.components import connected_components
from quillmesh.plans.dialect import LIBRARY, expand


def apply(spark, name, **given):
    return LIBRARY.apply(spark, name, lambda t: pytest.fail(f"reads {t}"), given)


def test_canonical_edges(spark):
    rows = [("r", 0, 1, 1), ("r", 1, 0, 1), ("r", 2, 2, 1), ("r", 3, 1, 1), ("r", 1, 0, 1), ("r", 4, 0, 0), ("r", 1, None, 1)]
    got = apply(spark, "edges_canonical", entries=spark.createDataFrame(rows, "relation string, i long, j long, v int"))
    assert sorted((r.src, r.dst) for r in got.collect()) == [(0, 1), (1, 3)]


def five_nodes(spark):
    own = spark.createDataFrame([(0, 1.0, 10.0), (1, 2.0, 0.0), (2, 3.0, 0.0), (3, 4.0, 0.0), (4, 5.0, 0.0)], "node_id long, own__f01 double, own__f02 double").selectExpr("*", *[f"0e0 AS own__f0{i}" for i in (0, 3, 4, 5, 6)])
    edges = spark.createDataFrame([("cpm", 0, 1), ("cpm", 0, 2), ("cpm", 2, 3), ("cns", 0, 4)], "relation string, src long, dst long")
    return own, edges


def test_neighbour_means(spark):
    own, edges = five_nodes(spark)
    got = {r.node_id: r for r in apply(spark, "nbr_block", own_block=own, edges_canonical=edges).collect()}
    assert [got[i].nbr__cpm_mean_f01 for i in range(5)] == [2.5, 1, 2.5, 3, 0]
    assert [got[i].nbr__cpm_mean_f02 for i in range(5)] == [0, 10, 5, 0, 0]
    assert [got[i].nbr__cns_mean_f01 for i in range(5)] == [5, 0, 0, 0, 1]
    for name, degrees in (("cpm", [2, 1, 2, 1, 0]), ("cns", [1, 0, 0, 0, 1]), ("cdp", [0] * 5)):
        assert [got[i][f"nbr__{name}_log1p_degree"] for i in range(5)] == pytest.approx([math.log1p(d) for d in degrees], abs=1e-8)


def test_neighbour_means_ignore_row_order_and_partitions(spark):
    own, edges = five_nodes(spark)
    a = apply(spark, "nbr_block", own_block=own, edges_canonical=edges).collect()
    b = apply(spark, "nbr_block", own_block=own.orderBy("own__f01", ascending=False).repartition(3), edges_canonical=edges.repartition(2)).collect()
    assert sorted(a) == sorted(b)


def test_leaving_one_neighbour_out_is_the_block_of_the_smaller_graph(spark):
    own, edges = five_nodes(spark)
    for r in apply(spark, "loo_neighbour_means", own_block=own, edges_canonical=edges).collect():
        a, b = sorted((r.target, r.neighbour))
        rest = edges.where(f"not (relation = '{r.relation}' and src = {a} and dst = {b})")
        block = {x.node_id: x for x in apply(spark, "nbr_block", own_block=own, edges_canonical=rest).collect()}[r.target]
        assert r.mean_without == pytest.approx(block[f"nbr__{r.relation}_mean_f01"], abs=1e-4)
        assert r.log_degree_without == pytest.approx(block[f"nbr__{r.relation}_log1p_degree"], abs=1e-6)


def test_components_and_groups(spark):
    nodes = spark.range(6).withColumnRenamed("id", "node_id")
    edges = spark.createDataFrame([(0, 1), (3, 4)], "src long, dst long")
    assert sorted((r.node_id, r.group_id) for r in models.component_groups(nodes, edges).collect()) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 2), (5, 3)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(None, 3), (500, 500)], "a long, b long")
    found = {r.node: r.component for r in connected_components(chain).collect()}
    assert found.pop(500) == 500 and set(found.values()) == {0} and len(found) == 201
    assert connected_components(chain.limit(0)).collect() == []
    assert {r.node: r.component for r in connected_components(chain, one_task=0).collect()} == found | {500: 500}  # in rounds


def test_renumbered_duplicate_groups(spark):
    raw = spark.createDataFrame([(0, 1.0, 2.0), (1, 0.0, 0.0), (2, 1.0, 2.0), (3, 0.0, 0.0), (4, 5.0, 5.0)], "node_id long, own__f01 double, own__f04 double").selectExpr("*", *[f"CAST(NULL AS DOUBLE) AS own__f0{i}" for i in (0, 2)], *[f"0e0 AS own__f0{i}" for i in (3, 5, 6)])
    got = apply(spark, "renumber_groups", raw_features=raw)
    assert [r.group_id for r in got.orderBy("node_id").collect()] == [0, 1, 0, 1, 2]


def test_unlabelled_prefix(spark):
    labels = spark.createDataFrame([(i, y, 3) for i, y in enumerate((0, 0, 0, 1, 0, 1))], "node_id long, y int, prefix long")
    groups = spark.range(6).selectExpr("id AS node_id", "id AS group_id")
    got = apply(spark, "node_table", labels_raw=labels, renumber_groups=groups).orderBy("node_id").collect()
    assert [r.label for r in got] == [None, None, None, 1, 0, 1] and [r.split for r in got] == ["unlabelled"] * 3 + [None] * 3


def test_f1_threshold(spark):
    y, p = (1, 1, 0, 1, 0, 0, 0, 0), (0.9, 0.8, 0.7, 0.6, 0.3, 0.2, 0.1, 0.05)
    scored = spark.createDataFrame([(i, a, b, "train") for i, (a, b) in enumerate(zip(y, p, strict=True))], "node_id long, y int, pa double, split string")
    (r,) = apply(spark, "f1_threshold", scored=scored).collect()
    assert r.threshold == 0.6 and r.f1 == pytest.approx(6 / 7)


def test_holm(spark):
    for p, want in (((0.01, 0.04, 0.03), (0.03, 0.06, 0.06)), ((0.9, 0.9), (1, 1)), ((0.05,), (0.05,))):
        rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "contrast long, p double")
        assert [r.adjusted for r in apply(spark, "holm", p_values=rows).orderBy("contrast").collect()] == pytest.approx(want)


def test_average_precision_and_auroc_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.5), (0, 0.2), (1, 0.1)]
    pred = spark.createDataFrame([("m", "s", 0, i, y, p) for i, (y, p) in enumerate(rows)], "model string, settings string, fold long, node_id long, y int, prob double")
    want, seen = 0.0, []
    for cut in sorted({p for _, p in rows}, reverse=True):
        taken = [y for y, p in rows if p >= cut]
        new = sum(y for y, p in rows if p == cut)
        want += new / 3 * sum(taken) / len(taken)
        seen = taken
    assert len(seen) == 6
    assert apply(spark, "average_precision", predictions=pred).first().ap == pytest.approx(want)
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for y, a in rows if y for z, b in rows if not z]
    assert apply(spark, "auroc", predictions=pred).first().auroc == pytest.approx(sum(pairs) / len(pairs))


def test_verdicts(spark):
    rows = [(0, 3, 0.025, 0.005, 0.02, 0.01), (1, 3, 0.01, 0.02, -0.01, 0.01), (2, 3, 0.025, 0.005, 0.02, 0.2), (3, 3, -0.01, 0.02, -0.02, 0.01), (4, 3, 0.0, 0.01, -0.01, 1.0)]
    frame = spark.createDataFrame(rows, "contrast long, n long, mean double, sd double, least double, p double")
    got = [r.verdict for r in apply(spark, "verdicts", p_values=frame, contrast_stats=frame).orderBy("contrast").collect()]
    assert got == ["supported", "not distinguishable", "not distinguishable", "worse", "worse"]


def test_p_of_students_t(spark):
    """Against the integral of the density."""
    import math

    import numpy as np

    rows = [(i, float(t), df + 1, float(t), 1.0) for i, (t, df) in enumerate((t, df) for df in (1, 2, 3, 4, 5, 9, 10, 24) for t in (0.0, 0.3, -1.0, 2.5, 7.0))]
    frame = spark.createDataFrame([(i, n, m, sd, 0.0, t) for i, t, n, m, sd in rows], "contrast long, n long, mean double, sd double, least double, t double")
    got = {r.contrast: r.p for r in apply(spark, "p_values", contrast_stats=frame).collect()}
    for i, t, n, *_ in rows:
        df, x = n - 1, np.linspace(0, abs(t), 200_001)
        density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        assert got[i] == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-7)
    flat = spark.createDataFrame([(0, 3, 0.1, 0.0, 0.1, float("inf")), (1, 3, 0.0, 0.0, 0.0, 0.0), (2, 1, 0.1, 0.0, 0.1, None)], "contrast long, n long, mean double, sd double, least double, t double")
    assert {r.contrast: r.p for r in apply(spark, "p_values", contrast_stats=flat).collect()} == {0: 0.0, 1: 1.0}


def test_audit_of_training_nodes_only(spark):
    nodes = spark.createDataFrame([(0, 1, True, 5, "train", 0), (1, 1, True, 5, "train", 0), (2, 0, True, 5, "train", 1), (3, 0, True, 6, "test", None), (4, 1, True, 6, "test", None), (5, None, False, 6, "unlabelled", None), (6, 0, True, 7, "train", 1)], "node_id long, label int, is_labelled boolean, group_id long, split string, cv_fold long")
    (p,) = apply(spark, "group_purity", split_nodes=nodes).collect()
    assert (p.n, p.groups, p.purity) == (3, 1, pytest.approx(2 / 3))
    assert sorted((r.split, r.size, r.groups, r.n_nodes) for r in apply(spark, "group_table", split_nodes=nodes).collect()) == [("test", 2, 1, 2), ("train", 1, 1, 1), ("train", 3, 1, 3)]
    edges = spark.createDataFrame([("r", 0, 1), ("r", 0, 2), ("r", 3, 4), ("r", 1, 3), ("r", 2, 6)], "relation string, src long, dst long")
    (r,) = apply(spark, "relation_homophily", split_nodes=nodes, edges_canonical=edges).collect()
    assert (r.edges, r.train_train) == (5, 3) and r.homophily == pytest.approx(2 / 3) and r.positive_homophily == pytest.approx(2 / 3)
    assert r.mean_degree == pytest.approx(10 / 6) and r.isolated == 0


def test_columns_alone(spark):
    values = {"up": [0, 1, 2, 3, 4, 5], "down": [5, 4, 3, 2, 1, 0], "flat": [7] * 6, "mixed": [1, 0, 1, 0, 1, 1]}
    labels = [0, 0, 1, 0, 1, 1]
    long = spark.createDataFrame([(i, n, float(v), "train", y) for n, vs in values.items() for i, (v, y) in enumerate(zip(vs, labels, strict=True))], "node_id long, name string, v double, split string, label int")
    got = {r.name: r for r in apply(spark, "single_feature_check", own_long=long).collect()}
    for name, vs in values.items():
        pairs = [(a > b) + 0.5 * (a == b) for a, y in zip(vs, labels, strict=True) for b, z in zip(vs, labels, strict=True) if y > z]
        auroc = sum(pairs) / len(pairs)
        score = [v if auroc >= 0.5 else -v for v in vs]
        cuts = sorted(set(score), reverse=True)
        taken = [[y for s, y in zip(score, labels, strict=True) if s >= c] for c in cuts]
        ap = sum((sum(t) - before) / 3 * sum(t) / len(t) for t, before in zip(taken, [0, *[sum(t) for t in taken]], strict=False))
        best = max((sum(t) / 3 + 1 - (len(t) - sum(t)) / 3) / 2 for t in taken)
        r = got[name]
        assert r.auroc == pytest.approx(max(auroc, 1 - auroc)) and r.pr_auc == pytest.approx(ap) and r.best_balanced == pytest.approx(best) and r.direction == ("high" if auroc >= 0.5 else "low"), name
    assert {r.name: r.auroc for r in apply(spark, "oriented_auroc", own_long=long).collect()}["flat"] is None
    kinds = {r.name: r.kind for r in apply(spark, "column_spec", own_long=long).collect()}
    assert kinds == {"up": "ordinal", "down": "ordinal", "flat": "constant", "mixed": "binary"}


def test_plans_do_not_repeat_their_inputs(spark):
    from quillmesh.plans.registry import QUERIES

    # rank_agreement pairs its few columns with each other
    for name, most in (("feature_audit", 30), ("rank_agreement", 30), ("nbr_block", 30), ("aggregate_influence", 30)):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") + plan.count("RelationV2") <= 12, name
        physical = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert physical.count("CartesianProduct") <= (name == "rank_agreement") and physical.count("Join") <= most, name


def test_corrected_t(spark):
    d = (0.02, 0.01, 0.03, -0.01, 0.02, 0.015, 0.0, 0.025, 0.01, 0.02)
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(d)], "contrast long, split long, delta double")
    mean = sum(d) / 10
    var = sum((v - mean) ** 2 for v in d) / 9
    (r,) = apply(spark, "corrected_t", deltas=rows).collect()
    assert r.t == pytest.approx(mean / math.sqrt((0.1 + 0.25) * var), abs=1e-6) and r.df == 9
    flat = spark.createDataFrame([(0, i, v) for i, v in enumerate((0.5, 0.5, 0.5))] + [(1, 0, 0.1)], "contrast long, split long, delta double")
    assert {r.contrast: r.t for r in apply(spark, "corrected_t", deltas=flat).collect()} == {0: math.inf, 1: None}


def test_group_folds_keep_groups_and_balance(spark):
    groups = spark.createDataFrame([(g, g % 5 == 0 and 2 or 0, 1 + g % 4) for g in range(60)], "group_id long, positives long, negatives long")
    folds = {r.group_id: r.fold for r in models.grouped_folds(groups, 5).collect()}
    assert len(folds) == 60
    positives = [sum(2 for g, k in folds.items() if k == f and g % 5 == 0) for f in range(5)]
    assert max(positives) - min(positives) <= 2
    # One group after the other, as the rule says.
    kinds = sorted(((g % 5 == 0 and 2 or 0, 1 + g % 4) for g in range(60)), key=lambda c: (-abs(c[0] - c[1]) / 2, c[1], c[0]))
    held, total = [[0, 0] for _ in range(5)], [sum(k[i] for k in kinds) for i in (1, 0)]
    for p, n in kinds:
        def spread(f, p=p, n=n):
            after = [[h[0] + n * (i == f), h[1] + p * (i == f)] for i, h in enumerate(held)]
            shares = [[h[j] / total[j] for h in after] for j in (0, 1)]
            return round(sum((sum((v - sum(x) / 5) ** 2 for v in x) / 5) ** 0.5 for x in shares) / 2, 12), sum(after[f]), f
        f = min(map(spread, range(5)))[2]
        held[f] = [held[f][0] + n, held[f][1] + p]
    got = [[sum(1 + g % 4 for g, k in folds.items() if k == f), sum(2 for g, k in folds.items() if k == f and g % 5 == 0)] for f in range(5)]
    assert got == held
    many = spark.range(3000).selectExpr("id AS group_id", "id % 3 AS positives", "1L AS negatives")
    sizes = [r["count"] for r in models.grouped_folds(many, 5, exact=50).groupBy("fold").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) - min(sizes) < 100
    assert models.grouped_folds(many.limit(0), 5).collect() == []


def test_identical_scores_have_no_difference(spark):
    test = spark.createDataFrame([(i, int(i % 3 == 0), i // 2, (i % 7) / 10, (i % 7) / 10) for i in range(60)], "node_id long, y int, group_id long, pa double, pb double")
    (r,) = apply(spark, "paired_bootstrap", test_scores=test).collect()
    assert (r.low, r.high) == (0, 0) and r.kept == 1000
    draws = apply(spark, "draws", test_scores=test).groupBy("b").sum("times").collect()
    assert {v for _, v in draws} == {30}


def test_macros():
    assert expand("$DBL($Q(x, 0.5))", "duckdb") == "CAST(quantile_cont(x, 0.5) AS DOUBLE)"
    assert "conv(" in expand("$H(1, a, b)", "spark")


def test_every_order_is_a_fact(spark):
    customer = spark.createDataFrame([(1, "BUILDING", 3), (2, "MACHINERY", 20)], "c_custkey long, c_mktsegment string, c_nationkey int")
    orders = spark.createDataFrame([(k, 1 + k % 2, "1-URGENT", 10.0 + k) for k in range(1, 15)], "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").selectExpr("*", "DATE'1995-03-01' AS o_orderdate")
    found = apply(spark, "run_facts", orders=orders, customer=customer).collect()
    assert sorted((r.setup, r.n, r.cents, r.first_key) for r in found) == [("own", 7, sum(1000 + 100 * k for k in range(2, 15, 2)), 2), ("own_nbr", 7, sum(1000 + 100 * k for k in range(1, 15, 2)), 1)]


def test_whole_graph_and_log_are_read(spark):
    edges = spark.createDataFrame([(r, 0, i) for r in ("cpm", "cns") for i in range(1, 11)], "relation string, src long, dst long")
    nodes = spark.createDataFrame([(i, i % 2, "train") for i in range(11)], "node_id long, label int, split string")
    ego = apply(spark, "ego_network", edges_canonical=edges, split_nodes=nodes).collect()
    assert {(r.relation, r.node_id) for r in ego} == {(r, i) for r in ("cpm", "cns") for i in range(11)}
    assert {(r.degree, r.n_train, r.train_fraud) for r in ego if r.node_id == 0} == {(10, 10, 0.5)}
    soft = apply(spark, "edge_softmax", edges_canonical=edges).collect()
    assert len(soft) == 80 and {r.relation for r in soft} == {"cpm", "cns"}
    near = [f"nbr__{r}_{c}" for r in ("cpm", "cns", "cdp") for c in [*[f"mean_f0{i}" for i in range(7)], "log1p_degree"]]
    block = spark.createDataFrame([(i, *[1.0 if c == "nbr__cpm_mean_f01" else math.log(2) if c == "nbr__cpm_log1p_degree" else 0.0 for c in near]) for i in range(20)], "node_id long, " + ", ".join(f"{c} double" for c in near))
    sums = spark.createDataFrame([(i, "cpm", 1, *[1.0 + (i == 4) if j == 1 else 0.0 for j in range(7)]) for i in range(20)], "node_id long, relation string, degree long, " + ", ".join(f"mean_f0{i} double" for i in range(7)))
    assert {r.node_id: r.same for r in apply(spark, "layout_check", nbr_block=block, neighbour_sums=sums).collect()} == {i: i != 4 for i in range(20)}


def test_last_progress_of_each_section_and_why_it_stopped(spark):
    lines = ["9/10 trials in 5 of 60 s", "Tuning gbt with selection s0", "3/10 trials in 5 of 60 s", "7/10 trials in 20 of 60 s", "6/10 trials in 30 of 60 s", "Tuning lr with selection s1", "noise", "Tuning gbt with selection s2", "10/10 trials in 40 of 60 s", "Tuning knn with selection s0", "4/10 trials in 10 of 60 s", "4/10 trials in 59 of 60 s"]
    got = apply(spark, "tuning_budget_log", log_lines=spark.createDataFrame(list(enumerate(lines)), "line long, text string")).orderBy("section").collect()
    assert [tuple(r) for r in got] == [(1, "gbt", "s0", 7, 10, 20, 60, "early stop"), (5, "lr", "s1", None, None, None, None, "unknown"), (7, "gbt", "s2", 10, 10, 40, 60, "all trials"), (9, "knn", "s0", 4, 10, 59, 60, "time limit")]


def test_strata_and_agreement(spark):
    test = spark.createDataFrame([(0, 1, 0, 0.9, 0.1), (1, 0, 0, 0.8, 0.1), (2, 1, 1, 0.2, 0.1), (3, 0, 1, 0.1, 0.1)], "node_id long, y int, group_id long, pa double, pb double")
    cut = spark.createDataFrame([(0.7, 1.0)], "threshold double, f1 double")
    got = {r.stratum: r.n for r in apply(spark, "strata", test_scores=test, f1_threshold=cut).collect()}
    assert got == {"all": 4, "fraud": 2, "not_fraud": 2, "flagged": 2, "true_positive": 1, "false_positive": 1, "false_negative": 1}
    ranks = spark.createDataFrame([("a", 5.0, 1.0), ("b", 4.0, 2.0), ("c", 3.0, 3.0), ("d", 2.0, 4.0), ("e", 1.0, 0.0)], "name string, x double, z double")
    (r,) = apply(spark, "rank_agreement", two_rankings=ranks).collect()
    assert (r.jaccard, r.largest_move, r.n_columns) == (pytest.approx(2 / 4), 3, 5) and r.kendall == pytest.approx((4 - 6) / 10)


def test_influence_of_neighbours_is_summed_by_probability(spark):
    rows = [("r", 1, 9, 2, 0.3), ("r", 2, 9, 4, -0.1), ("r", 3, 8, 1, 0.2)]
    infl = spark.createDataFrame(rows, "relation string, target long, neighbour long, degree long, delta_prob double")
    test = spark.createDataFrame([(1, 1, 0, 0.9, 0.1), (2, 1, 0, 0.1, 0.1)], "node_id long, y int, group_id long, pa double, pb double")
    got = {r.neighbour: r for r in apply(spark, "aggregate_influence", influence=infl, test_scores=test).collect()}
    r = got[9]
    assert (r.n_targets, r.sum_abs, r.mean_abs, r.mean_abs_x_degree, r.towards_fraud, r.away_from_fraud, r.sum_abs_flagged) == (2, pytest.approx(0.4), pytest.approx(0.2), pytest.approx(0.5), pytest.approx(0.3), pytest.approx(0.1), pytest.approx(0.3))
    assert got[8].sum_abs_flagged == 0


def test_the_first_candidate_stays_unless_beaten(spark):
    ap = lambda gains: spark.createDataFrame([("dummy", "default", f, 0.5) for f in range(3)] + [("m", "tuned", f, 0.5 + g) for f, g in enumerate(gains)], "model string, settings string, fold long, ap double")
    pick = lambda gains: apply(spark, "best_gnn", average_precision=ap(gains)).collect()[0].pick
    assert pick((0.1, 0.12, 0.11)) == "m/tuned" and pick((0.1, -0.1, 0.02)) == "dummy/default" and pick((-0.1, -0.11, -0.1)) == "dummy/default"


def test_budgets_and_the_best_setup(spark):
    """The largest budget that has every setup of a variant; there the highest mean CV score among setups with a first split."""
    one = [("d", b, "", s, k, 0.6, cv, 0.1) for b, s, k, cv in [
        ("full", "own", 0, 0.70), ("full", "own", 1, 0.72), ("full", "own_nbr", 0, 0.71), ("full", "own_nbr", 1, 0.71), ("pilot", "own", 0, 0.9), ("pilot", "own_nbr", 0, 0.8), ("full", "gnn", 1, 0.99),
    ]]
    one += [("e", "full", "", "own", 0, 0.6, 0.5, 0.1), ("e", "pilot", "", "own", 0, 0.6, 0.5, 0.1), ("e", "pilot", "", "gnn", 0, 0.6, 0.5, 0.1)]
    runs = spark.createDataFrame([(f"r{i}", *r, 0.5) for i, r in enumerate(one)], "run_id string, dataset string, budget_read string, suffix string, base string, split long, test_pr_auc double, cv_pr_auc double, no_skill double, skill double")
    assert {r.dataset: r.budget for r in apply(spark, "budget_with_every_setup", one_run=runs).collect()} == {"d": "full", "e": "pilot"}
    best = {r.dataset: r for r in apply(spark, "best_setup", one_run=runs).collect()}
    assert (best["d"].top, best["d"].close_others) == ("own", 1)  # gnn has no first split; own_nbr ties and comes later
    assert best["e"].top == "own" and best["e"].close_others == 1


def test_same_test_nodes(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "node_id long, y int")
    b = spark.createDataFrame([(2, 1), (3, 0), (4, 0)], "node_id long, y int")
    (r,) = apply(spark, "same_test_nodes", test_scores=a, other_side=b).collect()
    assert (r.only_first, r.only_second, r.other_label) == (1, 1, 1)


def test_vote_ratios(spark):
    up, votes, y = [9, 8, 0, 1, 5, 0], [1, 1, 9, 9, 5, 0], [0, 0, 1, 1, 0, 1]
    long = spark.createDataFrame([(i, "own__f02", float(v), "train", y[i]) for i, v in enumerate(up)] + [(i, "own__f03", float(v) - 1, "train", y[i]) for i, v in enumerate(up)], "node_id long, name string, v double, split string, label int")
    own = spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "node_id long, own__f01 double")
    (r,) = apply(spark, "vote_ratio_check", own_long=long, own_block=own).collect()  # own__f03 has a negative value
    assert r.name == "own__f02" and r.ratio_auroc_benign == 1.0 and r.fraud_below_low == pytest.approx(2 / 3) and r.benign_above_high == pytest.approx(2 / 3) and r.min_total == 0


def test_replications_count_only_sound_runs(spark):
    rows = [("a", "failed", False, 1, "h0"), ("b", "ok", True, 2, "h1"), ("c", "ok", False, 3, "h2"), ("d", "ok", False, 4, "h2"), ("e", "ok", False, 5, "h3"), ("f", "ok", False, 6, None)]
    runs = spark.createDataFrame([(i, "d", "full", "own", "", 0, s, sup, t, h) for i, s, sup, t, h in rows], "run_id string, dataset string, budget_read string, base string, suffix string, split long, status string, superseded boolean, started long, hash_id string")
    got = {r.run_id: r.replication for r in apply(spark, "replications", runs_table=runs).collect()}
    assert got == {"a": False, "b": False, "c": False, "d": False, "e": True, "f": False}
    assert sorted(r.run_id for r in apply(spark, "usable_runs", runs_table=runs).collect()) == ["c", "d", "f"]
