"""Fits in passes over blocks against fits of all rows in one place."""

import numpy as np
import pytest

from quillmesh.operators import forest, models, passes


def many(spark, n=900, seed=3, parts=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = (x[:, 0] - x[:, 2] ** 2 + rng.normal(size=n) > 0).astype(int)
    fold = np.arange(n) % 3
    rows = spark.createDataFrame([(i, *map(float, r), int(v), int(f)) for i, (r, v, f) in enumerate(zip(x, y, fold, strict=True))], "node_id long, a double, b double, c double, label int, fold int")
    return rows.repartition(parts), x, y, fold


def test_forests_by_passes_are_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(passes, "BLOCK_ROWS", 200)
    monkeypatch.setattr(passes, "WALKED", 6)  # margins are written several times
    rows, x, y, fold = many(spark)
    own = forest.training(rows, list("abc"))
    specs = [passes.Spec((0,), np.arange(3), 7, 3), passes.Spec((1,), np.array([0, 2]), 4, 2, 0.3), passes.Spec((1, 2), np.arange(3), 5, 1, up=2.5)]
    made = passes.forests(passes.packed(own, list("abc"), len(x)), 3, specs, covers=True)
    for spec, got in zip(specs, made, strict=True):
        use = ~np.isin(fold, spec.outside)
        want = forest.fit(x[use][:, spec.columns], y[use], trees=spec.trees, depth=spec.depth, rate=spec.rate, weight=np.where(y[use] == 1, spec.up, 1.0))
        real = np.isfinite(want.cut)
        assert (spec.columns[want.column][real] == got.column[real]).all() and (want.cut == got.cut).all()
        assert got.leaf == pytest.approx(want.leaf, abs=1e-9) and got.cover == pytest.approx(want.cover) and got.base == pytest.approx(want.base)
    again = passes.forests(passes.packed(forest.training(many(spark, parts=2)[0], list("abc")), list("abc"), len(x)), 3, specs)
    assert all((a.leaf == b.leaf).all() for a, b in zip(made, again, strict=True))


@pytest.mark.parametrize("nested", [False, True])
def test_cross_fit_of_many_rows_counts_all_of_them(spark, monkeypatch, nested):
    rows = many(spark)[0]
    rows = rows.unionByName(rows.limit(20).selectExpr("node_id + 5000 AS node_id", "a", "b", "c", "CAST(NULL AS INT) AS label", "CAST(NULL AS INT) AS fold"))
    scores = lambda: {(r.outer_fold, r.node_id): r.score for r in models.cross_fit(rows, list("abc"), nested=nested, trees=4).collect()}
    want = scores()
    monkeypatch.setattr(forest, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(forest.sampled, "__defaults__", (300,))
    monkeypatch.setattr(passes, "BLOCK_ROWS", 250)
    assert scores() == pytest.approx(want, abs=2e-6)


def test_splits_of_a_whole_fit_are_chosen_on_all_rows():
    """They depended on the seed: the share of label 1 stood for the share of rows."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + rng.normal(size=400) > 0.8).astype(int)
    one, other = forest.fit(x, y, trees=6, depth=2, seed=1), forest.fit(x, y, trees=6, depth=2, seed=2)
    assert (one.cut == other.cut).all() and (one.column == other.column).all() and (one.leaf == other.leaf).all()
    some = [forest.fit(x, y, trees=6, depth=2, share=0.5, seed=s) for s in (1, 2)]
    assert (some[0].cut != some[1].cut).any()
