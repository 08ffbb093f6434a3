"""The search's fits against plain forms, and its choice."""

import numpy as np
import pytest

from quillmesh.operators import forest, search


def sample(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    return x, (x[:, 0] - x[:, 2] + 0.5 * rng.normal(size=n) > 0.3).astype(int)


def test_logistic_weights_solve_the_penalised_likelihood():
    x, y = sample()
    for l2 in (1e-3, 0.5):
        w = search.logistic(x, y, l2)
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        assert np.abs(x.T @ (p - y) + l2 * len(x) * w[:-1]).max() < 1e-5 and abs((p - y).sum()) < 1e-5


def test_neighbours_and_bayes_against_loops():
    x, y = sample(120)
    held = sample(30, 5)[0]
    z, h = (x - x.mean(0)) / x.std(0), (held - x.mean(0)) / x.std(0)
    want = [y[np.argsort(((z - q) ** 2).sum(1).round(9), kind="stable")[:7]].mean() for q in h]
    assert search.fitted_scores("neighbours", {"k": 7}, x, y, held) == pytest.approx(want)
    def density(q, own):
        v = own.var(0) + 1e-9 * x.var(0).max() + 1e-12
        return np.log(len(own)) - 0.5 * sum(np.log(v[j]) + (q[j] - own[:, j].mean()) ** 2 / v[j] for j in range(4))
    assert search.fitted_scores("bayes", {"smooth": 1e-9}, x, y, held) == pytest.approx([density(q, x[y == 1]) - density(q, x[y == 0]) for q in held])


def test_selections_keep_what_tells():
    x, y = sample(600)
    for selection in ("filter", "embed"):
        assert search.chosen_columns(selection, 0.5, x, y).tolist() == [0, 2]
    assert search.chosen_columns("none", 0.1, x, y).tolist() == [0, 1, 2, 3]


def test_trials_are_deterministic_and_the_best_is_chosen(spark):
    x, y = sample(240)
    df = spark.createDataFrame([(i, *map(float, r), int(v), i % 3) for i, (r, v) in enumerate(zip(x, y, strict=True))], "node_id long, a double, b double, c double, d double, label int, fold int")
    found = search.search(df, list("abcd"), trials=3, classifiers=("logistic", "trees"), selections=("none", "filter")).collect()
    assert len(found) == 2 * 2 * 3 * 3
    again = search.search(df.repartition(5), list("abcd"), trials=3, classifiers=("logistic", "trees"), selections=("none", "filter")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
    fold = np.arange(240) % 3
    for r in found:
        if r.classifier == "trees" and r.selection == "none" and r.trial == 0:
            made = forest.fit(x[fold != r.fold], y[fold != r.fold], trees=20, depth=3, rate=0.15)
            assert r.ap == pytest.approx(forest.ranking_score(y[fold == r.fold], made.margin(x[fold == r.fold])), abs=1e-6)
    best = search.tuned_against_default(spark.createDataFrame(found)).collect()
    assert len(best) == 4 and sorted(r.place for r in best) == [1, 2, 3, 4]
    for r in best:
        means = {t: np.mean([f.ap for f in found if (f.classifier, f.selection, f.trial) == (r.classifier, r.selection, t)]) for t in range(3)}
        assert r.cv_mean == pytest.approx(max(means.values()), abs=1e-6) and r.default_cv == pytest.approx(means[0], abs=1e-6) and r.gain >= 0


def test_nearest_labels_against_a_full_sort_with_ties_and_outliers():
    rng = np.random.default_rng(4)
    base = rng.integers(-2, 3, (1500, 3)).astype(float)  # hundreds of equally far rows
    base[7] = 1e4
    label, held = rng.integers(0, 2, 1500), np.concatenate([rng.integers(-2, 3, (40, 3)), rng.normal(size=(600, 3))]).astype(float)
    far = ((held[:, None, :] - base[None]) ** 2).sum(2).round(9)
    for k in (1, 9, 99, 1500):
        assert (search.nearest_labels(base, label, held, k) == label[np.argsort(far, axis=1, kind="stable")[:, :k]]).all()


def test_trials_share_ranks_and_neighbours(spark, monkeypatch):
    """Neighbours are looked for once for all trials with the same columns, and columns ranked once for a fold."""
    x, y = sample(240)
    df = spark.createDataFrame([(i, *map(float, r), int(v), i % 3) for i, (r, v) in enumerate(zip(x, y, strict=True))], "node_id long, a double, b double, c double, d double, label int, fold int")
    calls = []
    monkeypatch.setattr(search, "fan_out", lambda spark, jobs, work, ddl: spark.createDataFrame([r for j in jobs for r in work(*j)], ddl))
    monkeypatch.setattr(search, "nearest_labels", lambda *a, of=search.nearest_labels: calls.append("near") or of(*a))
    monkeypatch.setattr(search, "column_ranks", lambda *a, of=search.column_ranks: calls.append("rank") or of(*a))
    found = search.search(df, list("abcd"), trials=6, classifiers=("neighbours",), selections=("none",)).collect()
    assert len(found) == 18 and calls.count("near") == 3 and calls.count("rank") == 3
    for r in found:
        k, fold = search.drawn("neighbours", "none", r.trial, 1)["k"], np.arange(240) % 3
        want = search.fitted_scores("neighbours", {"k": k}, x[fold != r.fold], y[fold != r.fold], x[fold == r.fold])
        assert r.ap == pytest.approx(forest.ranking_score(y[fold == r.fold], want), abs=1e-6)


def test_neighbours_are_looked_for_among_all_rows():
    """The row asked for is the last of 30,000; they were looked for among the first 20,000."""
    x = np.random.default_rng(6).normal(size=(30_000, 2))
    y = np.zeros(30_000, int)
    y[25_000:] = 1
    assert search.neighbour_scores(x, y, x[-50:], [1])[0].tolist() == [1.0] * 50


def test_search_of_many_rows_fits_all_of_them(spark, monkeypatch):
    """By passes over blocks, against the search in one place."""
    x, y = sample(900)
    df = spark.createDataFrame([(i, *map(float, r), int(v), i % 3) for i, (r, v) in enumerate(zip(x, y, strict=True))], "node_id long, a double, b double, c double, d double, label int, fold int")
    want = sorted(map(tuple, search.search(df, list("abcd"), trials=2).collect()))
    monkeypatch.setattr(forest, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(forest.sampled, "__defaults__", (300,))
    monkeypatch.setattr(search.passes, "BLOCK_ROWS", 250)
    got = sorted(map(tuple, search.search(df.repartition(3), list("abcd"), trials=2).collect()))
    assert len(got) == 4 * 3 * 2 * 3 and [r[:6] for r in got] == [r[:6] for r in want]
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], abs=2e-6)
