"""Refits and near-best settings against loops."""

import itertools

import numpy as np
import pytest

from quillmesh.operators import forest, refits
from quillmesh.plans import registry  # noqa: F401  defines the templates
from quillmesh.plans.dialect import LIBRARY


def apply(spark, name, **given):
    return LIBRARY.apply(spark, name, None, given).collect()


def average_ranks(v):
    v = np.asarray(v, float)
    return np.array([(v > x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_ranks_shares_and_agreement(spark):
    rng = np.random.default_rng(2)
    names = [f"own__f{i:02d}" for i in range(8)] + [f"nbr__aaa_mean_f{i:02d}" for i in range(6)] + ["nbr__aaa_log1p_degree"]
    values = {f"fit {k}": rng.integers(0, 9, len(names)) / 10 for k in range(4)}
    given = spark.createDataFrame([(f, n, float(v)) for f, own in values.items() for n, v in zip(names, own, strict=True)], "fit string, name string, importance double")
    ranks = {f: average_ranks(v) for f, v in values.items()}
    got = {r.name: r for r in apply(spark, "refit_recurrence", fit_importance=given)}
    for i, n in enumerate(names):
        own = [ranks[f][i] for f in values]
        within = sum(p <= 10 for p in own)
        assert (n in got) == (within > 0)
        if within:
            assert (got[n].fits_in_top, got[n].n_fits, got[n].best_rank, got[n].worst_rank) == (within, 4, min(own), max(own))
            assert got[n].mean_rank == pytest.approx(np.mean(own), abs=1e-6)
    shares = {r.player: r for r in apply(spark, "block_share_across_fits", fit_importance=given)}
    for player, at in (("own", slice(0, 8)), ("nbr", slice(8, 14)), ("degree", slice(14, 15))):
        own = [v[at].sum() / v.sum() for v in values.values()]
        assert (shares[player].min_share, shares[player].max_share) == (pytest.approx(min(own), abs=1e-6), pytest.approx(max(own), abs=1e-6))
    pairs = {(r.a, r.b): r for r in apply(spark, "fit_agreement", fit_importance=given)}
    assert set(pairs) == set(itertools.combinations(values, 2))
    for (a, b), r in pairs.items():
        x, y = ranks[a], ranks[b]
        assert r.spearman == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
        i, j = np.triu_indices(len(x), 1)
        sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        assert r.kendall == pytest.approx((sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum()), abs=1e-6)
        first, second = set(np.flatnonzero(x <= 10)), set(np.flatnonzero(y <= 10))
        assert r.top_overlap == pytest.approx(len(first & second) / len(first | second), abs=1e-6)
        assert r.largest_move == max(abs(x[k] - y[k]) for k in first)


def rows(spark, n=600):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=n) > 0.4).astype(int)
    return x, y, spark.createDataFrame([(i, *map(float, r), int(v), i % 4) for i, (r, v) in enumerate(zip(x, y, strict=True))], "node_id long, a double, b double, c double, label int, fold int").repartition(3)


def test_settings_near_the_best(spark):
    x, y, df = rows(spark)
    grid = [refits.Settings(20, 3, 0.2), refits.Settings(1, 1, 0.01), refits.Settings(30, 3, 0.2)]
    scores = refits.settings_scores(df, ["a", "b", "c"], grid).collect()
    assert len(scores) == 12
    fold = np.arange(len(x)) % 4
    for r in scores:
        made = grid[r.setting].fit(x[fold != r.fold], y[fold != r.fold])
        assert r.ap == pytest.approx(forest.ranking_score(y[fold == r.fold], made.margin(x[fold == r.fold])), abs=1e-6)
    given = spark.createDataFrame([(s, f, v) for s, own in enumerate([[0.8, 0.9], [0.86, 0.8], [0.5, 0.5], [0.9, 0.8]]) for f, v in enumerate(own)], "setting long, fold long, ap double")
    assert {r.setting: r.role for r in refits.near_best(given).collect()} == {0: "best", 1: "near", 3: "near"}
    assert refits.near_best(given.limit(0)).collect() == []


def test_importance_of_several_fits_in_one_pass(spark):
    x, y, df = rows(spark, 300)
    fits = refits.fitted(df, ["a", "b", "c"], [("one", refits.Settings(), 1, -1), ("two", refits.Settings(), 2, -1), ("split", refits.Settings(), 1, 0)])
    assert [n for n, _ in fits] == ["one", "two", "split"]
    assert not np.allclose(fits[0][1].margin(x), fits[1][1].margin(x)) and not np.allclose(fits[0][1].margin(x), fits[2][1].margin(x))
    got = {(r.fit, r.name): r.importance for r in refits.importance_by_fit(df, ["a", "b", "c"], fits, x[:20]).collect()}
    for name, model in fits:
        want = np.abs(model.shapley_against(x, x[:20])).mean(0)
        assert [got[name, c] for c in "abc"] == pytest.approx(want.tolist(), abs=1e-8)
