import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest

from quillmesh.operators import attention, encoders, forest, models
from quillmesh.plans.dialect import LIBRARY
from quillmesh.plans import registry  # noqa: F401
from quillmesh.sources import files, mat
from quillmesh.streaming import scoring


def planted(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.35)
        rows.append((i, y * 2.0 + rng.gauss(0, 0.7), rng.gauss(0, 1), y, i % 4))
    return spark.createDataFrame(rows, "node_id long, signal double, noise double, label int, fold int")


def test_probe_ignores_labels_of_the_scored_fold_when_fitting(spark):
    rows = planted(spark)
    found = models.cross_fit(rows, ["signal", "noise"], trees=3)
    garbled = rows.selectExpr("node_id", "signal", "noise", "CASE WHEN fold = 0 THEN 1 - label ELSE label END AS label", "fold")
    again = models.cross_fit(garbled, ["signal", "noise"], trees=3)
    own = lambda d: sorted((r.node_id, r.score) for r in d.collect() if r.node_id % 4 == 0)
    assert own(found) == own(again) and len(own(found)) == 100


def test_importance_finds_the_signal(spark):
    rows = planted(spark)
    found = {r.name: r for r in models.permutation_importance(rows, ["signal", "noise"], shuffles=3, trees=8).collect()}
    assert found["signal"].importance > 0.2 > abs(found["noise"].importance) and found["signal"].folds == 4
    assert [found[n].place for n in ("signal", "noise")] == [1, 2]
    assert {r.name for r in models.split_thresholds(rows, ["signal", "noise"], trees=2).collect()} >= {"signal"}
    assert len(models.probe(rows, ["signal", "noise"]).collect()) == 4


def test_nested_scores_come_from_models_that_saw_neither_fold(spark):
    rows = planted(spark, 200)
    got = {(r.outer_fold, r.node_id): r.score for r in models.cross_fit(rows, ["signal", "noise"], nested=True, trees=3).collect()}
    assert len(got) == 200 * 3 and all(o != n % 4 for o, n in got)
    garbled = rows.selectExpr("node_id", "signal", "noise", "CASE WHEN fold IN (0, 2) THEN 1 - label ELSE label END AS label", "fold")
    again = {(r.outer_fold, r.node_id): r.score for r in models.cross_fit(garbled, ["signal", "noise"], nested=True, trees=3).collect()}
    assert all(got[o, n] == again[o, n] for o, n in got if {o, n % 4} == {0, 2})
    extra = rows.unionByName(spark.createDataFrame([(999, 2.0, 0.0, None, None)], rows.schema))
    (r,) = [r for r in models.cross_fit(extra, ["signal", "noise"], trees=3).collect() if r.node_id == 999]
    assert r.outer_fold is None and 0.5 < r.score <= 1


def test_tree_shapley_values_are_exact():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=300)) > 0).astype(int)
    model = forest.fit(x, y, trees=4, depth=3, weight=rng.uniform(0.5, 2, 300))
    inner = model.column.shape[1]

    def value(row, known):
        def below(t, node):
            if node >= inner:
                return model.leaf[t, node - inner]
            if not np.isfinite(model.cut[t, node]):
                return below(t, 2 * node + 1)
            if model.column[t, node] in known:
                return below(t, 2 * node + 1 + (row[model.column[t, node]] > model.cut[t, node]))
            shares = [model.cover[t, 2 * node + s] / model.cover[t, node] for s in (1, 2)]
            return sum(p * below(t, 2 * node + s) for s, p in zip((1, 2), shares, strict=True))

        return model.base + sum(below(t, 0) for t in range(len(model.column)))

    got = model.shapley(x[:12])
    for i in range(12):
        for j in range(4):
            want = 0.0
            for size in range(4):
                for known in itertools.combinations([c for c in range(4) if c != j], size):
                    want += math.factorial(size) * math.factorial(3 - size) / 24 * (value(x[i], {*known, j}) - value(x[i], set(known)))
            assert got[i, j] == pytest.approx(want, abs=1e-9)
    assert np.allclose(model.expected() + model.shapley(x).sum(1), model.margin(x))


def test_roar_removes_and_fits_again(spark):
    rows = planted(spark, 600).withColumn("other", models.hashed(3, "node_id") % 100)
    got = models.roar(rows, ["signal", "noise", "other"], {"good": ["signal"], "bad": ["noise", "other"]}, top_ks=(1, 2), draws=3, trees=8).collect()
    assert len(got) == 4 * (1 + 2 + 2 * (1 + 3))
    of = lambda name: np.mean([r["drop"] for r in got if r.name == name])
    assert of("good") > 0.2 and of("top 1") == pytest.approx(of("good")) and abs(of("bad")) < 0.1
    assert {(r.k, r.draw): 0 for r in got if r.kind == "random"}.keys() == {(k, d) for k in (1, 2) for d in range(3)}
    scores = spark.createDataFrame(got).withColumnRenamed("drop", "fall")
    summary = {(r.kind, r.k, r.name): r for r in LIBRARY.apply(spark, "roar_summary", lambda t: None, {"roar_scores": scores}).collect()}
    falls = [np.mean([r["drop"] for r in got if r.kind == "random" and r.k == 1 and r.fold == f]) for f in range(4)]
    one = summary["random", 1, "random 1"]
    assert one.mean_drop == pytest.approx(np.mean(falls), abs=1e-5) and one.sd_drop == pytest.approx(np.std(falls, ddof=1), abs=1e-5) and one.n_folds == 4
    versus = {r.k: r for r in LIBRARY.apply(spark, "roar_top_or_random", lambda t: None, {"roar_scores": scores}).collect()}
    assert versus[1].top_k_hurts_more and versus[1].gap == pytest.approx(summary["top_k", 1, "top 1"].mean_drop - one.mean_drop, abs=1e-5)


def test_permuted_labels_lose_the_signal(spark):
    got = {r.run: r for r in models.randomisation_check(planted(spark), ["signal", "noise"], permutations=2).collect()}
    assert set(got) == {"true labels", "permuted labels 0", "permuted labels 1"}
    assert got["true labels"].pr_auc > 0.8 > got["permuted labels 0"].pr_auc and got["true labels"].spearman_with_true == 1.0


def test_rewiring_keeps_degrees_and_counts_swaps(spark):
    rng = random.Random(4)
    edges = {(r, *sorted(rng.sample(range(60), 2))) for r in "ab" for _ in range(150)}
    frame = spark.createDataFrame(sorted(edges), "relation string, src long, dst long")
    after, swaps = models.swap_rewire(frame, swaps_per_edge=2.0)
    got = [(r.relation, r.src, r.dst) for r in after.collect()]
    assert len(got) == len(set(got)) == len(edges) and all(s < d for _, s, d in got)
    degree = lambda es: sorted((r, v) for r, s, d in es for v in (s, d))
    assert degree(got) == degree(edges) and all(swaps[r] >= 2 * sum(e[0] == r for e in edges) for r in "ab")
    report = {r.relation: r for r in models.rewired_report(frame, swaps_per_edge=2.0).collect()}
    assert all(report[r].surviving < 0.6 and report[r].swaps == swaps[r] for r in "ab")


def test_rewiring_between_many_classes(spark):
    """Edges of many class pairs: degrees stay, the swaps asked for are made in few rounds, and edges reach other class pairs."""
    rng = random.Random(6)
    edges = {("a", *sorted(rng.sample(range(300), 2))) for _ in range(3000)}
    edges |= {("a", 0, i) for i in range(1, 200)}
    frame = spark.createDataFrame(sorted(edges), "relation string, src long, dst long")
    after, swaps = models.swap_rewire(frame, swaps_per_edge=10.0, max_rounds=8, pair_edges=100)
    got = {(r.relation, r.src, r.dst) for r in after.collect()}
    degree = lambda es: sorted((r, v) for r, s, d in es for v in (s, d))
    assert len(got) == after.count() == len(edges) and all(s < d for _, s, d in got) and degree(got) == degree(edges)
    assert swaps["a"] >= 10 * len(edges) and len(got & edges) < 0.25 * len(edges)
    again, _ = models.swap_rewire(frame.repartition(3), swaps_per_edge=10.0, max_rounds=8, pair_edges=100)
    assert {(r.relation, r.src, r.dst) for r in again.collect()} == got
    ring = spark.createDataFrame([("r", 0, 1), ("r", 1, 2), ("r", 0, 2)], "relation string, src long, dst long")
    assert models.swap_rewire(ring)[1] == {"r": 0} and models.swap_rewire(ring.limit(0))[1] == {}


def numeric(f, theta, eps=1e-5):
    return np.array([(f(theta + eps * e) - f(theta - eps * e)) / (2 * eps) for e in np.eye(len(theta))])


def test_network_gradients():
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(30, 3)), (rng.random(30) < 0.4).astype(float), rng.uniform(0.5, 2, 30)
    theta = rng.normal(size=3 * 4 + 2 * 4 + 1)
    got = encoders.mlp_gradient(theta, x, y, w, 4)
    assert np.allclose(got[:-1], numeric(lambda t: encoders.mlp_gradient(t, x, y, w, 4)[-1], theta), atol=1e-4)
    noise, dim = x[rng.permutation(30)], 2
    theta = rng.normal(size=3 * dim + 2 * dim + dim * dim)

    def loss(t):
        mean = encoders.dgi_encode(t, x, dim)[0].mean(0)
        return encoders.dgi_gradient(t, x, noise, mean, dim)[-1] / 30

    mean = encoders.dgi_encode(theta, x, dim)[0].mean(0)
    found = encoders.dgi_gradient(theta, x, noise, mean, dim) / 30
    s = 1 / (1 + np.exp(-mean))
    whole = found[: len(theta)] + encoders.dgi_through_summary(theta, x, found[len(theta) : -1] * s * (1 - s), dim) / 30
    assert np.allclose(whole, numeric(loss, theta), atol=1e-6)


def test_networks_learn_without_their_own_fold(spark):
    rows = planted(spark)
    out, losses = encoders.cross_fit_mlp(rows, ["signal", "noise"], epochs=60)
    got = {r.node_id: r.score for r in out.collect()}
    truth = {r.node_id: r.label for r in rows.collect()}
    assert (losses[-1] < 0.7 * losses[0]).all()
    assert forest.ranking_score(np.array([truth[i] for i in got]), np.array(list(got.values()))) > 0.85
    garbled = rows.selectExpr("node_id", "signal", "noise", "CASE WHEN fold = 0 THEN 1 - label ELSE label END AS label", "fold")
    again = {r.node_id: r.score for r in encoders.cross_fit_mlp(garbled, ["signal", "noise"], epochs=60)[0].collect()}
    assert all(got[i] == pytest.approx(again[i], abs=1e-5) for i in got if i % 4 == 0)
    blank = rows.selectExpr("node_id", "signal", "noise", "CAST(NULL AS INT) AS label", "CAST(NULL AS INT) AS fold").limit(3)
    assert len(encoders.cross_fit_mlp(rows.unionByName(blank.selectExpr("node_id + 5000 AS node_id", "signal", "noise", "label", "fold")), ["signal", "noise"], epochs=2)[0].where("fold is null and score is not null").collect()) == 3


def test_infomax_tells_the_graph_from_the_corrupted_one(spark):
    rng = np.random.default_rng(7)
    side = np.repeat([1.0, -1.0], 60)
    x = side[:, None] * np.array([1.5, -1.0]) + 0.5 * rng.normal(size=(120, 2))
    edges = [(int(a), int(b)) for a in range(120) for b in rng.choice(60, 4) + 60 * (a >= 60) if a != b]
    both = sorted({(a, b) for a, b in edges} | {(b, a) for a, b in edges} | {(a, a) for a in range(120)})
    degree = {i: sum(a == i for a, _ in both) for i in range(120)}
    weights = spark.createDataFrame([("r", a, b, 1 / math.sqrt(degree[a] * degree[b])) for a, b in both], "relation string, node_id long, nb long, w double")
    values = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "node_id long, a double, b double")
    made = models.dgi_inputs(values, ["a", "b"], weights)
    a_hat = np.zeros((120, 120))
    for a, b in both:
        a_hat[a, b] = 1 / math.sqrt(degree[a] * degree[b])
    got = {r.node_id: r for r in made.collect()}
    assert np.allclose([[got[i].p_a, got[i].p_b] for i in range(120)], a_hat @ x)
    moved = {r.node_id: r.from_node_id for r in models.dealt(values, "node_id", 29).collect()}
    assert sorted(moved.values()) == list(range(120))
    assert np.allclose([[got[i].q_a, got[i].q_b] for i in range(120)], a_hat @ x[[moved[i] for i in range(120)]])
    rows = made.selectExpr("relation", "node_id", "p_a", "p_b", "q_a", "q_b", "node_id % 10 <> 0 AS loss")
    z, losses = encoders.train_dgi(rows.unionByName(rows.selectExpr("'s' AS relation", "node_id", "q_a AS p_a", "q_b AS p_b", "p_a AS q_a", "p_b AS q_b", "loss")), ["r", "s"], ["p_a", "p_b"], ["q_a", "q_b"], dim=2, epochs=25)
    assert losses[:, 0].min() < 0.8 * losses[0, 0] and z.count() == 240
    alone, one = encoders.train_dgi(rows, ["r"], ["p_a", "p_b"], ["q_a", "q_b"], dim=2, epochs=25)
    assert np.allclose(one[:, 0], losses[:, 0])
    assert {(r.node_id, r.z1, r.z2) for r in alone.collect()} == {(r.node_id, r.z1, r.z2) for r in z.where("relation = 'r'").collect()}


def test_pca_is_fitted_on_training_rows_only(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ np.array([[3, 0, 0], [0, 1, 0], [1, 0, 0.2]])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows + [(1000 + i, 1e6, 1e6, 1e6) for i in range(5)], "id long, a double, b double, c double")
    got = {r.id: r for r in models.train_pca(frame, "id", ["a", "b", "c"], frame.id < 200, 2).collect()}
    centred = x - x.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    for j in range(2):
        load = vt[j] * np.sign(vt[j][np.abs(vt[j]).argmax()])
        assert np.allclose([got[i][f"pc{j + 1}"] for i in range(200)], centred @ load, atol=1e-4)


def test_effective_rank(spark):
    frame = spark.createDataFrame([(math.cos(i), math.sin(i), 5.0) for i in range(1000)], "a double, b double, c double")
    (r,) = models.effective_rank(frame, ["a", "b", "c"]).collect()
    assert r.constant == 1 and r.numerical_rank == 2 and r.effective_rank == pytest.approx(2, abs=0.01)


def test_removing_a_neighbour_matches_recomputing(spark):
    edges = [(0, 1), (0, 2), (2, 3), (0, 4), (1, 2)]
    both = edges + [(b, a) for a, b in edges]
    v = {i: float(i * i + 1) for i in range(5)}

    def layer(pairs, t):
        d = {i: sum(a == i for a, _ in pairs) for i in range(5)}
        return sum(v[b] / math.sqrt((d[a] + 1) * (dict_full[b] + 1)) for a, b in pairs if a == t) + v[t] / (d[t] + 1)

    dict_full = {i: sum(a == i for a, _ in both) for i in range(5)}
    got = models.removal_influence(spark.createDataFrame(list(v.items()), "node_id long, x double"), spark.createDataFrame([("r", *e) for e in both], "relation string, node_id long, nb long"), "x").collect()
    assert len(got) == len(both)
    for r in got:
        assert r.delta == pytest.approx(layer(both, r.target) - layer([p for p in both if p != (r.target, r.neighbour)], r.target), abs=1e-5)


def test_numbering_has_no_gaps(spark):
    frame = spark.createDataFrame([(i * 7 % 501,) for i in range(501)], "k long").repartition(5)
    assert sorted((r.k, r.n) for r in models.numbered(frame, "k", "n").collect()) == [(i, i) for i in range(501)]


def test_neighbour_block_plan(spark):
    """The edge side is joined and aggregated by node once; the scan reads only the columns that are used."""
    own = spark.range(1000).selectExpr("id AS node_id", *[f"1e0 AS own__f0{i}" for i in range(7)])
    edges = spark.range(1000).selectExpr("'cpm' AS relation", "id AS src", "id + 1 AS dst")
    plan = LIBRARY.apply(spark, "neighbour_sums", lambda t: None, {"own_block": own, "edges_canonical": edges})._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "ArrowEvalPython" not in plan


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "m.coo").write_bytes(b"% comment\n1 2 0.5\n3 1 2\n2 2\n" + b"".join(b"%d %d 1\n" % (i, i + 1) for i in range(1, 400)))
    found = {r.path: r for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert found["a.txt"].sha256 == hashlib.sha256(b"one").hexdigest() and found["a.txt"].bytes == 3
    before = spark.createDataFrame(list(found.values()))
    (tmp_path / "a.txt").write_bytes(b"two")
    (tmp_path / "b.txt").write_bytes(b"new")
    changes = {r.path: r.change for r in files.changed_files(before, files.file_digests(spark, str(tmp_path))).collect()}
    assert changes == {"a.txt": "changed", "b.txt": "added"}
    rows = files.read_coordinates(spark, str(tmp_path / "m.coo")).collect()
    assert len(rows) == 402 and sorted((r.row, r.col, r.value) for r in rows)[:2] == [(0, 1, 0.5), (0, 1, 1.0)]
    db = str(tmp_path / "db")
    files.append_entry(spark.createDataFrame([("gbt", 0.5)], "model string, ap double"), db, "r1")
    files.append_entry(spark.createDataFrame([("lr", 0.4, "x")], "model string, ap double, note string"), db, "r2")
    assert sorted((r.run_id, r.note) for r in files.read_entries(spark, db).collect()) == [("r1", None), ("r2", "x")]
    with pytest.raises(ValueError):
        files.append_entry(spark.createDataFrame([(1,)], "node_id long"), db, "r3")
    with pytest.raises(Exception):
        files.append_entry(spark.createDataFrame([("lr",)], "model string"), db, "r2")
    assert files.exactly_one(spark, f"{db}/r2").count() == 1
    edges = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "relation string, src long, dst long")
    files.write_partitioned(edges, str(tmp_path / "edges"))
    assert spark.read.parquet(str(tmp_path / "edges")).where("relation = 'b'").count() == 1


def test_components_and_rank_of_whole_vectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    x = np.array([v for _, v in rows], float)
    assert x.shape[1] == 64
    (r,) = registry.embedding_rank(spark, sf).collect()
    sigma = np.linalg.svd(x - x.mean(0), compute_uv=False)
    share = sigma / sigma.sum()
    assert r.numerical_rank == (sigma > sigma[0] * 1e-6).sum() > 16
    assert r.effective_rank == pytest.approx(math.exp(-(share[share > 0] * np.log(share[share > 0])).sum()), abs=1e-3)
    assert r.k90 == (np.cumsum(sigma**2) / (sigma**2).sum() < 0.9).sum() + 1
    fit = x[[i % 5 < 3 for i, _ in rows]]
    _, _, vt = np.linalg.svd(fit - fit.mean(0), full_matrices=False)
    got = {r.vec_id: r for r in registry.pca_block(spark, sf).collect()}
    for j in range(4):
        load = vt[j] * np.sign(vt[j][np.abs(vt[j]).argmax()])
        assert np.allclose([got[i][f"pc{j + 1}"] for i, _ in rows], (x - fit.mean(0)) @ load, atol=1e-4)


def mat_file(path, variables, deflate=True):
    """A small MAT file: dense arrays, or (rows, columns, values, shape) for sparse ones."""
    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, v in variables.items():
        sparse = isinstance(v, tuple)
        shape = v[3] if sparse else v.shape
        body = element(6, struct.pack("<II", 5 if sparse else 6, len(v[0]) if sparse else 0)) + element(5, struct.pack("<ii", *shape)) + (struct.pack("<HH", 1, len(name)) + name.encode().ljust(4, b"\0") if len(name) <= 4 else element(1, name.encode()))
        if sparse:
            order = np.lexsort((v[0], v[1]))
            starts = np.concatenate([[0], np.cumsum(np.bincount(np.array(v[1])[order], minlength=shape[1]))])
            body += element(5, np.array(v[0], "<i4")[order].tobytes()) + element(5, starts.astype("<i4").tobytes()) + element(9, np.array(v[2], "<f8")[order].tobytes())
        else:
            small = (v == np.round(v)).all() and abs(v).max() < 100
            body += element(1, v.T.astype("i1").tobytes()) if small else element(9, v.T.astype("<f8").tobytes())
        whole = element(14, body)
        if deflate:
            packed = zlib.compress(whole)
            whole = struct.pack("<II", 15, len(packed)) + packed
        out += whole
    path.write_bytes(out)


@pytest.mark.parametrize("deflate", [False, True])
def test_graph_of_a_mat_file(spark, tmp_path, deflate):
    x = np.array([[1.5, 2, 0], [0, 1, 3], [7, 0, 0], [0, 0, 0.25]])
    rows, cols = [0, 1, 1, 2, 3], [1, 0, 2, 1, 3]
    mat_file(tmp_path / "g.mat", {"features": x, "label": np.array([[0, 1, 1, 0]]), "net": (rows, cols, [1, 1, 2, 2, 1], (4, 4))}, deflate)
    nodes, labels, entries = mat.read_graph(spark, str(tmp_path / "g.mat"), {"rur": "net"})
    assert [tuple(r)[1:] for r in nodes.orderBy("node_id").collect()] == [tuple(v) for v in x.tolist()] and nodes.columns[1] == "own__f00"
    assert [r.y for r in labels.orderBy("node_id").collect()] == [0, 1, 1, 0]
    assert sorted((r.relation, r.i, r.j, r.v) for r in entries.collect()) == [("rur", i, j, v) for i, j, v in zip(rows, cols, (1, 1, 2, 2, 1), strict=True)]
    edges = LIBRARY.apply(spark, "edges_canonical", lambda t: None, {"entries": entries}).collect()
    assert sorted((r.src, r.dst) for r in edges) == [(0, 1), (1, 2)]
    with pytest.raises(mat.MatError, match="has no other"):
        mat.read_graph(spark, str(tmp_path / "g.mat"), {"r": "other"})
    mat_file(tmp_path / "b.mat", {"features": x, "label": np.array([[0, 2, 1, 0]]), "net": (rows, cols, [1] * 5, (4, 4))})
    with pytest.raises(mat.MatError, match="neither 0 nor 1"):
        mat.read_graph(spark, str(tmp_path / "b.mat"), {"r": "net"})
    for broken in (b"", b"x" * 200, (tmp_path / "g.mat").read_bytes()[:150]):
        with pytest.raises(mat.MatError):
            list(mat.variables(broken))


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 2)), 1)  # many ties
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "node_id long, a double, b double")
    for block in (7, 4096):
        got = models.nearest(frame, frame.where("node_id % 5 = 0"), ["a", "b"], k=4, block=block).collect()
        want = []
        for q in range(0, 300, 5):
            near = sorted((round(float(((x[q] - x[o]) ** 2).sum()), 5), o) for o in range(300) if o != q)[:4]
            want += [(q, o, i + 1) for i, (_, o) in enumerate(near)]
        assert sorted((r.node_id, r.near, r.place) for r in got) == sorted(want)


def test_classifiers_over_blocks(spark):
    rows = planted(spark)
    got = models.compare_classifiers(rows.select("node_id", "label", "fold"), {"both": rows.select("node_id", "signal", "noise"), "noise": rows.select("node_id", "noise")}).collect()
    assert len(got) == 2 * 3 * 4
    mean = {b: np.mean([r.ap for r in got if r.block == b]) for b in ("both", "noise")}
    assert mean["both"] > 0.85 > 0.6 > mean["noise"]


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    model = forest.fit(x, (x[:, 0] > 0).astype(int), trees=5, depth=2)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(200, None, None)], "node_id long, a double, b double")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = scoring.score_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), model, ["a", "b"])
    run = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = {r.node_id: r.prob for r in scoring.score_stream(rows, model, ["a", "b"]).collect()}
    assert {r.node_id: r.prob for r in spark.table("scored").collect()} == batch and len(batch) == 201
    times = [("2024-01-01 10:05:00", "a"), ("2024-01-01 10:55:00", "a"), ("2024-01-01 11:05:00", "b")]
    events = spark.createDataFrame(times, "t string, kind string").selectExpr("CAST(t AS TIMESTAMP) AS t", "kind")
    events.write.parquet(str(tmp_path / "ev"))
    counts = scoring.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "t", "kind")
    run = counts.writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", str(tmp_path / "check2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((str(r.start), r.kind, r.n) for r in spark.table("counts").collect()) == [("2024-01-01 10:00:00", "a", 2), ("2024-01-01 11:00:00", "b", 1)]


def test_stratified_group_split(spark):
    rng = random.Random(6)
    rows = [(i, None if i < 40 else int(rng.random() < 0.2), rng.randrange(150)) for i in range(600)]
    got = models.stratified_group_split(spark.createDataFrame(rows, "node_id long, label int, group_id long")).collect()
    label = {n: y for n, y, _ in rows}
    assert len(got) == 600 and all((r.split == "unlabelled") == (label[r.node_id] is None) for r in got)
    known = [r for r in got if r.split != "unlabelled"]
    for of in ("split", "cv_fold"):
        assert len({(r.group_id, r[of]) for r in known}) == len({r.group_id for r in known})
    assert all((r.cv_fold is not None) == (r.split == "train") for r in known)
    share = lambda part: np.mean([label[r.node_id] for r in known if part(r)])
    whole = share(lambda r: True)
    assert abs(share(lambda r: r.split == "test") - whole) < 0.03 and 0.35 < np.mean([r.split == "test" for r in known]) < 0.45
    assert all(abs(share(lambda r, k=k: r.cv_fold == k) - whole) < 0.06 for k in range(5))


def gat_graph():
    rng = np.random.default_rng(9)
    n, k = 40, 3
    x = rng.normal(size=(n, k))
    edges = sorted({(r, int(a), int(b)) for r in range(2) for a, b in rng.integers(0, n, (90, 2)) if a != b})
    edges = sorted({(r, *p) for r, a, b in edges for p in ((a, b), (b, a))})
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0.3).astype(float)
    y[::5] = np.nan
    return x, edges, y


def plain_gat(shape, theta, x, edges, y, up):
    """Loss and margins by plain loops over nodes and their edges."""
    root, b, v, c = shape.root(theta)
    margins, loss, weights = [], 0.0, 0.0
    for i in range(len(x)):
        out = x[i] @ root + b
        for r in range(shape.relations):
            w, src, dst = shape.relation(theta, r)
            near = [j for q, t, j in edges if q == r and t == i]
            for h in range(shape.heads):
                at = slice(h * shape.channels, (h + 1) * shape.channels)
                if near:
                    u = np.array([x[i] @ w[:, at] @ dst[h] + x[j] @ w[:, at] @ src[h] for j in near])
                    e = np.exp(np.where(u > 0, u, 0.2 * u))
                    out[at] = out[at] + sum(p * (x[j] @ w[:, at]) for p, j in zip(e / e.sum(), near, strict=True))
        m = float(np.maximum(out, 0) @ v + c[0])
        margins.append(m)
        if not np.isnan(y[i]):
            weight = up if y[i] == 1 else 1.0
            loss, weights = loss + weight * (np.logaddexp(0, m) - y[i] * m), weights + weight
    return loss / weights, np.array(margins)


def test_attention_layer_against_plain_loops_and_differences():
    x, edges, y = gat_graph()
    shape = attention.Shape(3, 2, 2, 2)
    rng = np.random.default_rng(1)
    theta = rng.normal(size=shape.size) * 0.5
    r, t, nb = (np.array(c) for c in zip(*edges, strict=True))
    known = ~np.isnan(y)
    up = (known.sum() - np.nansum(y)) / np.nansum(y)
    weight = np.where(known, np.where(y == 1, up, 1.0), 0.0)
    weight = weight / weight.sum()

    def forward(now):
        sums = np.zeros((len(x), 2 * (2 + 4)))
        np.add.at(sums, t, attention.edge_sums(shape, now, r, x[t], x[nb]))
        return sums

    sums = forward(theta)
    total, below, loss = attention.node_gradient(shape, theta, x, sums, np.nan_to_num(y), weight)
    want, margins = plain_gat(shape, theta, x, edges, y, up)
    assert loss == pytest.approx(want) and np.allclose(attention.node_out(shape, theta, x, sums)[0], margins)
    got = total + attention.edge_gradient(shape, theta, r, x[t], x[nb], sums[t], below[t])
    assert np.allclose(got, numeric(lambda now: attention.node_gradient(shape, now, x, forward(now), np.nan_to_num(y), weight)[2], theta), atol=1e-6)


def test_attention_over_blocks_is_that_over_edges(spark):
    """The gradient summed over blocks of several sizes against the passes over edges and nodes."""
    from quillmesh.operators import networks

    x, edges, y = gat_graph()
    x = x.astype("f4").astype(float)
    shape, theta = attention.Shape(3, 2, 2, 2), np.random.default_rng(2).normal(size=attention.Shape(3, 2, 2, 2).size) * 0.5
    r, t, nb = (np.array(c) for c in zip(*edges, strict=True))
    known = ~np.isnan(y)
    up = (known.sum() - np.nansum(y)) / np.nansum(y)
    weight = np.where(known, np.where(y == 1, up, 1.0), 0.0)
    sums = np.zeros((len(x), 2 * (2 + 4)))
    np.add.at(sums, t, attention.edge_sums(shape, theta, r, x[t], x[nb]))
    total, below, loss = attention.node_gradient(shape, theta, x, sums, np.nan_to_num(y), weight / weight.sum())
    want = np.append(total + attention.edge_gradient(shape, theta, r, x[t], x[nb], sums[t], below[t]), loss)
    for spread in (1, 1000):  # ids close together are dealt by ranges, others by hash
        nodes = spark.createDataFrame([(i * spread, *map(float, v), None if np.isnan(y[i]) else int(y[i])) for i, v in enumerate(x)], "node_id long, a double, b double, c double, label long")
        frame = spark.createDataFrame([("pq"[q], a * spread, b * spread, 1.0) for q, a, b in edges], "relation string, node_id long, nb long, w double")
        for size in (7, 100, None):
            blocks = networks.packed_blocks(nodes, ["a", "b", "c"], frame, ["p", "q"], facts=("label",), block_nodes=size)
            assert blocks.count() == (6 if size == 7 and spread == 1 else blocks.count()) and blocks.agg({"own": "sum"}).first()[0] == len(x)
            got = networks.over_blocks(blocks, shape.size + 1, lambda b: attention.block_gradient(shape, theta, b, up, weight.sum()), 3, 1)
            assert np.allclose(got, want)


def test_attention_layer_is_trained(spark):
    x, edges, y = gat_graph()
    nodes = spark.createDataFrame([(i, *map(float, v), None if np.isnan(y[i]) else int(y[i])) for i, v in enumerate(x)] + [(99, 0.0, 0.0, 0.0, None)], "node_id long, a double, b double, c double, label int")
    frame = spark.createDataFrame([("pq"[r], t, j) for r, t, j in edges], "relation string, node_id long, nb long")
    scores, logits, losses = attention.train_gat(nodes, frame, ["a", "b", "c"], ["p", "q"], heads=2, channels=2, epochs=12)
    assert min(losses) < 0.8 * losses[0]
    probs = {r.node_id: r.prob for r in scores.collect()}
    assert len(probs) == 41
    known = [i for i in range(40) if not np.isnan(y[i])]
    assert forest.ranking_score(y[known].astype(int), np.array([probs[i] for i in known])) > 0.8
    assert logits.count() == 2 * len(edges)
    alpha = LIBRARY.apply(spark, "edge_softmax", lambda t: None, {"attention_logits": logits}).groupBy("relation", "target", "head").sum("alpha").collect()
    assert all(r[3] == pytest.approx(1, abs=1e-6) for r in alpha)
