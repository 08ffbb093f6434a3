"""Removal of an edge against a whole new pass over the smaller graph."""

import numpy as np
import pytest

from quillmesh.operators import edge_removal


def weights(adjacent):
    a = adjacent + np.eye(len(adjacent))
    d = a.sum(1)
    return a / np.sqrt(np.outer(d, d))


def encode(encoder, a, x):
    w1, b1, a1, w2, b2, a2 = encoder
    h = edge_removal._rectified(a @ x @ w1 + b1, a1)
    return edge_removal._rectified(a @ h @ w2 + b2, a2)


def test_every_edge_against_a_new_pass(spark):
    rng = np.random.default_rng(3)
    n, k, hidden, dim = 24, 3, 5, 4
    adjacent = np.triu(rng.random((n, n)) < 0.25, 1).astype(float)
    adjacent[:, 23] = adjacent[23, :] = 0  # an isolated node
    adjacent[0, 22], adjacent[1:22, 22] = 1, 0  # node 22 has one neighbour
    adjacent = np.maximum(adjacent, adjacent.T)
    x = rng.normal(size=(n, k))
    encoder = [rng.normal(size=(k, hidden)), rng.normal(size=hidden), rng.random(hidden), rng.normal(size=(hidden, dim)), rng.normal(size=dim), rng.random(dim)]
    score = lambda z: 1 / (1 + np.exp(-z.sum(1)))
    values = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "node_id long, a double, b double, c double").repartition(3)
    edges = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(adjacent), strict=True)], "node_id long, nb long")
    got = {(r.target, r.neighbour): r for r in edge_removal.removal_through_encoder(values, ["a", "b", "c"], edges, encoder, score).collect()}
    assert set(got) == set(zip(*[v.tolist() for v in np.nonzero(adjacent)], strict=True))
    whole = encode(encoder, weights(adjacent), x)
    for (t, u), r in got.items():
        less = adjacent.copy()
        less[t, u] = less[u, t] = 0
        z = encode(encoder, weights(less), x)
        assert r.moved == pytest.approx(np.linalg.norm(whole[t] - z[t]), abs=1e-7)
        assert r.delta == pytest.approx(score(whole[[t]])[0] - score(z[[t]])[0], abs=1e-7)


def test_triangles_in_all_orders(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4), (4, 5)]
    edges = spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "t long, u long")
    degrees = edges.groupBy("t").count().withColumnRenamed("t", "node_id").withColumnRenamed("count", "d")
    import itertools

    want = sorted(p for own in ((0, 1, 2), (2, 3, 4)) for p in itertools.permutations(own))
    assert sorted(map(tuple, edge_removal.triangles(edges, degrees).select("t", "n", "u").collect())) == want


def test_blocks_of_any_size_give_the_same_and_nothing_wide_is_written(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n, k, hidden, dim = 30, 3, 5, 4
    adjacent = np.triu(rng.random((n, n)) < 0.3, 1)
    encoder = [rng.normal(size=(k, hidden)), rng.normal(size=hidden), rng.random(hidden), rng.normal(size=(hidden, dim)), rng.normal(size=dim), rng.random(dim)]
    values = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(n, k)))], "node_id long, a double, b double, c double")
    edges = spark.createDataFrame([p for i, j in zip(*np.nonzero(adjacent), strict=True) for p in ((int(i), int(j)), (int(j), int(i)))], "node_id long, nb long")
    wrote, of = [], edge_removal.written
    monkeypatch.setattr(edge_removal, "written", lambda df, name, **kw: wrote.append((name, len(df.columns))) or of(df, name, **kw))
    made = [sorted(map(tuple, edge_removal.removal_through_encoder(values, ["a", "b", "c"], edges, encoder, lambda z: z.sum(1), block_nodes=size).collect())) for size in (4, 1000)]
    assert len(made[0]) == 2 * adjacent.sum() and np.array(made[0]) == pytest.approx(np.array(made[1]), abs=1e-8)
    # Of edges and triangles nothing but ids is written.
    assert {name for name, width in wrote if width > 2} == {"seen"}
