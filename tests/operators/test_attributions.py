"""Attributions against sums over all coalitions, plain loops and the definitions."""

import itertools
import math

import numpy as np
import pytest

from quillmesh.operators import attributions, forest

OWN = ["own__f00", "own__f01"]
COLUMNS = [*OWN, "nbr__aaa_mean_f00", "nbr__aaa_mean_f01", "nbr__aaa_log1p_degree", "nbr__bbb_mean_f00", "nbr__bbb_log1p_degree"]


@pytest.fixture(scope="module")
def fitted():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, len(COLUMNS)))
    x[:, [4, 6]] = np.log1p(rng.integers(0, 6, (500, 2)))
    y = (x[:, 0] * x[:, 2] + x[:, 4] - 0.5 * x[:, 5] > 0.5).astype(int)
    return forest.fit(x, y, trees=8, depth=3), x


def coalition_values(value, n):
    out = np.zeros(n)
    for i in range(n):
        for size in range(n):
            for chosen in itertools.combinations([j for j in range(n) if j != i], size):
                mask = sum(1 << j for j in chosen)
                out[i] += math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n) * (value(mask | 1 << i) - value(mask))
    return out


def test_interventional_values_are_those_of_all_coalitions(fitted):
    model, x = fitted
    back = x[:23]
    got = model.shapley_against(x[100:112], back)
    for row, own in zip(x[100:112], got, strict=True):
        def value(mask, row=row):
            z = back.copy()
            for j in range(len(COLUMNS)):
                if mask >> j & 1:
                    z[:, j] = row[j]
            return model.margin(z).mean()
        assert own == pytest.approx(coalition_values(value, len(COLUMNS)), abs=1e-9)
    assert got.sum(1) == pytest.approx(model.margin(x[100:112]) - model.margin(back).mean(), abs=1e-9)
    assert not model.shapley_against(x[:3], back[:0]).any()


def path_value(model, row, mask):
    """The margin with the columns of `mask` known, straight from the trees."""
    def walk(t, node):
        inner = model.column.shape[1]
        if node >= inner:
            return model.leaf[t, node - inner]
        c, cut = model.column[t, node], model.cut[t, node]
        if not np.isfinite(cut):
            return walk(t, 2 * node + 1)
        if mask >> int(c) & 1:
            return walk(t, 2 * node + 1 + int(row[c] > cut))
        w = model.cover[t]
        return sum(w[k] / w[node] * walk(t, k) for k in (2 * node + 1, 2 * node + 2) if w[k] > 0)
    return model.base + sum(walk(t, 0) for t in range(len(model.column)))


def test_interaction_values_are_those_of_all_coalitions(fitted):
    model, x = fitted
    n = len(COLUMNS)
    rows = x[200:203]
    got = model.interactions(rows)
    assert got == pytest.approx(got.transpose(0, 2, 1))
    assert got.sum(2) == pytest.approx(model.shapley(rows), abs=1e-9)
    for row, own in zip(rows, got, strict=True):
        values = [path_value(model, row, mask) for mask in range(1 << n)]
        for i, j in itertools.combinations(range(n), 2):
            want = 0.0
            for mask in range(1 << n):
                if not mask >> i & 1 and not mask >> j & 1:
                    s = mask.bit_count()
                    want += math.factorial(s) * math.factorial(n - s - 2) / (2 * math.factorial(n - 1)) * (values[mask | 1 << i | 1 << j] - values[mask | 1 << i] - values[mask | 1 << j] + values[mask])
            assert own[i, j] == pytest.approx(want, abs=1e-9)


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, *map(float, r)) for i, r in enumerate(x)], "node_id long, " + ", ".join(f"{c} double" for c in COLUMNS)).repartition(3)


def test_interactions_over_rows(spark, fitted):
    model, x = fitted
    got = {(r.a, r.b): r for r in attributions.interactions(table(spark, x[:150]), COLUMNS, model, top=3).collect()}
    whole, own = model.interactions(x[:150]), np.abs(model.shapley(x[:150])).mean(0)
    top = [COLUMNS[i] for i in np.argsort(-own, kind="stable")[:3]]
    names = list(dict.fromkeys(top + [COLUMNS[4], COLUMNS[6]]))
    assert set(got) == set(itertools.combinations(names, 2))
    for (a, b), r in got.items():
        assert r.mean_abs_interaction == pytest.approx(np.abs(2 * whole[:, COLUMNS.index(a), COLUMNS.index(b)]).mean(), abs=1e-8)
        assert r.own_x_graph == (a.startswith("own") != b.startswith("own")) and r.n_rows == 150


def test_blocks_of_columns_for_any_margin(spark, fitted):
    model, x = fitted
    players = attributions.players_of(COLUMNS)
    assert players == {"own": [0, 1], "nbr_aaa": [2, 3], "degree": [4, 6], "nbr_bbb": [5]}
    for margin in (model.margin, lambda z: z[:, 0] * z[:, 2] - z[:, 4] ** 2 + np.sin(z[:, 5])):
        got = attributions.block_shapley(margin, x[:9], x[300:311], list(players.values()))
        assert got.sum(1) == pytest.approx(margin(x[:9]) - margin(x[300:311]).mean(), abs=1e-9)
        for row, own in zip(x[:9], got, strict=True):
            def value(mask, row=row, margin=margin):
                z = x[300:311].copy()
                for i, cols in enumerate(players.values()):
                    if mask >> i & 1:
                        z[:, cols] = row[cols]
                return margin(z).mean()
            assert own == pytest.approx(coalition_values(value, 4), abs=1e-9)
    rows = attributions.group_shapley(table(spark, x[:40]), COLUMNS, model.margin, x[300:311]).collect()
    for r in rows:
        assert r.base + sum(r[f"group_{p}"] for p in players) == pytest.approx(r.margin, abs=1e-6)
    with pytest.raises(ValueError):
        attributions.block_shapley(model.margin, x[:1], x[:1], [[i] for i in range(13)])


@pytest.fixture(scope="module")
def graph(spark):
    """Model rows that are what the graph gives: node 0 has neighbours 1, 2, 3; node 29 a single one; others are random."""
    rng = np.random.default_rng(8)
    own = rng.normal(size=(30, 2))
    pairs = {"aaa": {(0, 1), (0, 2), (0, 3), (28, 29)} | {tuple(sorted(p)) for p in rng.integers(1, 28, (40, 2)).tolist() if p[0] != p[1]}, "bbb": {tuple(sorted(p)) for p in rng.integers(0, 29, (25, 2)).tolist() if p[0] != p[1]}}
    near = {r: {i: [b if a == i else a for a, b in sorted(e) if i in (a, b)] for i in range(30)} for r, e in pairs.items()}
    x = np.array([model_row(own, near, i) for i in range(30)])
    edges = spark.createDataFrame([(r, i, j) for r, all_ in near.items() for i, js in all_.items() for j in js], "relation string, node_id long, nb long")
    return own, near, x, edges, spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(own)], "node_id long, own__f00 double, own__f01 double")


def model_row(own, near, i, without=None, only=None):
    row = [*own[i]]
    for relation, columns in (("aaa", [0, 1]), ("bbb", [0])):
        js = [j for j in near[relation][i] if (relation, j) != without]
        if only and only[0] == relation:
            js = list(only[1])
        row += [*(own[js][:, columns].mean(0) if js else np.zeros(len(columns))), math.log1p(len(js))]
    return row


def test_influence_is_the_margin_of_the_smaller_graph(spark, fitted, graph):
    model, _ = fitted
    own, near, x, edges, own_table = graph
    targets = table(spark, x).where("node_id % 2 = 0 or node_id = 29")
    low, high = x.min(0), x.max(0)
    got = attributions.neighbour_influence(targets, COLUMNS, own_table, edges, model.margin, (low, high)).collect()
    assert len(got) == sum(len(near[r][i]) for r in near for i in range(30) if i % 2 == 0 or i == 29)
    chance = lambda m: 1 / (1 + np.exp(-m))
    for r in got:
        gone = np.array([model_row(own, near, r.target, without=(r.relation, r.neighbour))])
        held = gone.copy()
        at = COLUMNS.index(f"nbr__{r.relation}_log1p_degree")
        held[0, at] = x[r.target, at]
        now = model.margin(x[[r.target]])[0]
        assert r.degree == len(near[r.relation][r.target])
        assert r.delta_margin == pytest.approx(now - model.margin(gone)[0], abs=1e-7)
        assert r.delta_prob == pytest.approx(chance(now) - chance(model.margin(gone)[0]), abs=1e-7)
        assert r.delta_prob_mean == pytest.approx(chance(now) - chance(model.margin(held)[0]), abs=1e-7)
        used = [i for i, c in enumerate(COLUMNS) if c.startswith(f"nbr__{r.relation}_")]
        assert r.out_of_range == bool(((gone[0, used] < low[used] - 1e-6) | (gone[0, used] > high[used] + 1e-6)).any())


@pytest.mark.parametrize("stretch", [4096, 2])
def test_neighbours_share_what_they_add(spark, fitted, graph, monkeypatch, stretch):
    model, _ = fitted
    own, near, x, edges, own_table = graph
    monkeypatch.setattr(attributions, "STRETCH", stretch)
    smooth = lambda z: z[:, 2] * z[:, 4] + 2 * z[:, 5] - z[:, 6] + z[:, 0]
    for margin in (model.margin, smooth):
        got = {(r.relation, r.target, r.neighbour): r.phi for r in attributions.neighbour_shapley(table(spark, x), COLUMNS, own_table, edges, margin, orders=4).collect()}
        for relation in near:
            for i, js in near[relation].items():
                ends = [margin(np.array([model_row(own, near, i, only=(relation, s))]))[0] for s in (js, [])]
                assert sum(got[relation, i, j] for j in js) == pytest.approx(ends[0] - ends[1], abs=1e-6)
    # Two neighbours: an order and its reverse are all orders, so the values are exact.
    i = next(i for i, js in near["bbb"].items() if len(js) == 2)
    f = lambda *s: smooth(np.array([model_row(own, near, i, only=("bbb", s))]))[0]
    a, b = near["bbb"][i]
    assert got["bbb", i, a] == pytest.approx(0.5 * (f(a) - f()) + 0.5 * (f(a, b) - f(b)), abs=1e-6)


def test_counterfactuals_against_a_loop(spark, fitted, graph):
    model, x0 = fitted
    own, near, x, edges, own_table = graph
    back = x0[:31]
    influence = attributions.neighbour_influence(table(spark, x), COLUMNS, own_table, edges, model.margin, (x.min(0), x.max(0)))
    found = {(r.target, f"{r.neighbour} ({r.relation})"): r.delta_prob for r in influence.collect()}
    got = attributions.counterfactuals(table(spark, x), COLUMNS, model, back, influence, threshold=0.4, top=3).collect()
    assert len(got) == 30
    chance = lambda m: float(np.round(1 / (1 + np.exp(-m)), 9))
    phi = np.round(model.shapley(x), 12)
    for r in got:
        i, prob, pool = r.node_id, chance(model.margin(x[[r.node_id]])[0]), []
        for j in np.argsort(-np.abs(phi[i]), kind="stable")[:3]:
            z = x[[i]].copy()
            z[0, j] = np.median(back[:, j])
            pool.append(("feature", COLUMNS[j], chance(model.margin(z)[0])))
        pool += [("neighbour", n, round(prob - d, 9)) for (t, n), d in found.items() if t == i]
        crossing = [c for c in pool if (c[2] >= 0.4) != (prob >= 0.4)]
        best = max(abs(c[2] - prob) for c in crossing or pool)
        assert r.crosses_threshold == bool(crossing)
        assert abs(r.new_prob - r.prob) == pytest.approx(best, abs=1e-7)
        assert any((r.kind, r.name) == c[:2] and abs(c[2] - prob) == pytest.approx(best, abs=1e-7) for c in crossing or pool)


def test_the_sample_does_not_depend_on_partitions(spark):
    rows = spark.range(4000).selectExpr("id AS node_id", "double(id % 17) AS a", "int(id % 2) AS label", "int(id % 5) AS fold")
    one = forest.sampled(rows.repartition(3), ["a"], most=500)
    other = forest.sampled(rows.repartition(11), ["a"], most=500)
    assert len(one[0]) == 500 and all((p == q).all() for p, q in zip(one, other, strict=True))
