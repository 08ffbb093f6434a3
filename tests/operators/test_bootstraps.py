import hashlib

import numpy as np
import pytest

from quillmesh.operators import bootstraps
from quillmesh.plans import registry
from quillmesh.plans.dialect import LIBRARY

NAMES = ("importance_ci", "paired_auroc_bootstrap", "paired_bootstrap", "auroc_bootstrap", "group_bootstrap", "rank_agreement", "side_metrics")


def test_hashes_are_the_templates_hash():
    for seed, draw, first, last in ((61, 0, 0, 1200), (61, 999, 99_990, 100_020), (5, 7, 8_180, 8_200)):
        want = [int(hashlib.md5(f"{seed}|{draw}|{i}".encode()).hexdigest()[:8], 16) for i in range(first, last)]
        assert bootstraps.hashes(seed, draw, first, last).tolist() == want


@pytest.mark.parametrize(("ranges", "slice_rows"), [(4096, 1 << 20), (7, 11)])
def test_sums_are_those_of_the_draws(spark, ranges, slice_rows):
    """Over the template's rows of every draw, with ranges and slices of places as in one piece."""
    test = spark.createDataFrame([(i, int(i % 3 == 0), i // 2 * 5, (i * 7 % 11) / 10, (i % 7) / 10) for i in range(80)], "node_id long, y int, group_id long, pa double, pb double")
    source = {"test_scores": test}
    draws = LIBRARY.apply(spark, "draws", None, source).where("b < 9").collect()
    order = LIBRARY.apply(spark, "group_order", None, source)
    groups: dict = {}
    for r in test.collect():
        groups.setdefault(r.group_id, []).append((r.pa, r.y))
    want: dict = {}
    for b, g, times in draws:
        for s, y in groups[g]:
            n, p = want.get((b, s), (0, 0))
            want[b, s] = n + times, p + times * y
    rows = test.selectExpr("group_id", "pa AS s", "1 AS n", "y AS p").groupBy("group_id", "s").sum("n", "p").toDF("group_id", "s", "n", "p")
    got = {(r.b, r.s): (r.n, r.p) for r in bootstraps.drawn_sums(order, rows, "s", ["n", "p"], 9, ranges, slice_rows).where("n > 0").collect()}
    assert got == want


def test_counts_of_one_group_and_of_none(spark):
    """Every draw takes as many groups as there are; counts beyond a byte (kept in four) do not come up here."""
    order = spark.range(600).selectExpr("id AS group_id", "id AS place")
    found = bootstraps.counts_of_draws(order, 2, ranges=1000).collect()
    assert [np.frombuffer(r.counts, np.uint8).sum() for r in found] == [600, 600]
    one = order.where("place = 0")
    assert bootstraps.drawn_sums(one, one.selectExpr("group_id", "'a' AS name", "2D AS total"), "name", ["total"], 3).orderBy("b").collect() == [(0, "a", 2.0), (1, "a", 2.0), (2, "a", 2.0)]
    assert bootstraps.drawn_sums(order.limit(0), one.selectExpr("group_id", "'a' AS name", "2D AS total"), "name", ["total"], 3).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_no_query_lists_the_draws(spark, monkeypatch, name):
    """The template `draws` has a row for each draw and group: these queries no longer build it."""
    asked = []
    apply = LIBRARY.apply
    monkeypatch.setattr(LIBRARY, "apply", lambda s, n, source, given=None, built=None: asked.append(LIBRARY.needed(n, given)) or apply(s, n, source, given, built))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001").schema  # noqa: B018
    assert asked and not any("draws" in order for order in asked) and name in registry.ORACLES
