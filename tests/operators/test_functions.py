import math
import random

import pytest

from quillmesh import functions as Q


def test_neighbour_block_of_five_nodes(spark):
    own = spark.createDataFrame([(0, 1.0, 10.0), (1, 2.0, 0.0), (2, 3.0, 0.0), (3, 4.0, 0.0), (4, 5.0, 0.0)], "node_id long, own__f00 double, own__f01 double")
    edges = spark.createDataFrame([("aaa", 0, 1), ("aaa", 0, 2), ("aaa", 2, 3), ("bbb", 0, 4)], "relation string, src long, dst long")
    got = {r.node_id: r for r in Q.neighbour_block(own, edges, ["own__f00", "own__f01"]).collect()}
    assert [got[i].nbr__aaa_mean_f00 for i in range(5)] == [2.5, 1, 2.5, 3, 0] and [got[i].nbr__aaa_mean_f01 for i in range(5)] == [0, 10, 5, 0, 0]
    assert [got[i].nbr__bbb_mean_f00 for i in range(5)] == [5, 0, 0, 0, 1]
    assert [got[i].nbr__aaa_log1p_degree for i in range(5)] == pytest.approx([math.log1p(d) for d in (2, 1, 2, 1, 0)])


def test_curves_by_group(spark):
    rng = random.Random(2)
    rows = [(k, int(rng.random() < 0.4), round(rng.random(), 1)) for k in (0, 1, 2) for _ in range(40)] + [(3, 1, 0.5)]
    df = spark.createDataFrame(rows, "fold long, y int, prob double")
    ap = {r.fold: r.ap for r in Q.average_precision(df, ["fold"]).collect()}
    roc = {r.fold: r.auroc for r in Q.auroc(df, ["fold"]).collect()}
    for k in (0, 1, 2):
        own = [(y, p) for f, y, p in rows if f == k]
        pos = sum(y for y, _ in own)
        want = sum(sum(y for y, p in own if p == c) / pos * sum(y for y, p in own if p >= c) / sum(p >= c for _, p in own) for c in {p for _, p in own})
        pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for y, a in own if y for z, b in own if not z]
        assert ap[k] == pytest.approx(want) and roc[k] == pytest.approx(sum(pairs) / len(pairs))
    assert ap[3] == 1 and roc[3] is None


def test_wrappers(spark):
    scores = spark.createDataFrame([(0, 1, 0.9, 0.2), (1, 0, 0.8, 0.1), (2, 1, 0.1, 0.7)], "node_id long, y int, pa double, pb double")
    assert [r.outcome for r in Q.outcome_table(scores).orderBy("node_id").collect()] == ["broken fraud", "rescued benign", "rescued fraud"]
    assert Q.f1_threshold(scores, "pa").first().threshold == 0.1
    assert [r.adjusted for r in Q.holm(spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "i long, p double"), "i").orderBy("i").collect()] == pytest.approx([0.03, 0.06, 0.06])
    with pytest.raises(ValueError):
        Q.operator("holm", other=scores)
