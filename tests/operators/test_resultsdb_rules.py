"""Rules of the results database on small tables worked out by hand."""

import pytest

from quillmesh.plans import registry  # noqa: F401  defines the templates
from quillmesh.plans.dialect import LIBRARY


def apply(spark, name, **given):
    return LIBRARY.apply(spark, name, None, given).collect()


def stored(spark, rows):
    """Stored contrasts: (run, dataset, a, b, description, started, n, mean, sd, pr_a, p, verdict)."""
    made = [(r, d, "", a, b, a.split("_")[1], b.split("_")[1], a.split("_")[0], b.split("_")[0], text, s, n, m, sd, pa, pa + m, -1.0, 5 * n, m, p, v) for r, d, a, b, text, s, n, m, sd, pa, p, v in rows]
    return spark.createDataFrame(made, "run_id string, dataset string, suffix string, a string, b string, a_base string, b_base string, a_budget string, b_budget string, description string, started long, n_splits long, mean double, sd double, pr_a double, pr_b double, least double, cv_folds long, cv_delta double, p double, verdict string")


ROWS = [
    ("e1", "first", "pilot_own", "pilot_nbr", "the primary family", 10, 3, 0.05, 0.01, 0.8, 0.01, "supported"),
    ("e1", "first", "pilot_own", "pilot_ssl", "the primary family", 10, 3, -0.02, 0.01, 0.8, 0.04, "worse"),
    ("e1", "first", "pilot_nbr", "pilot_ssl", "the primary family", 10, 3, 0.01, 0.02, 0.85, 0.03, "not distinguishable"),
    ("e2", "first", "pilot_own", "pilot_nbr", "a look", 20, 2, 0.04, 0.01, 0.8, 0.2, "not distinguishable"),
    ("e3", "first", "pilot_own", "pilot_ssl", "a look", 30, 3, -0.01, 0.01, 0.8, 0.5, "worse"),
    ("e4", "second", "pilot_own", "pilot_nbr", "a look", 5, 2, 0.03, 0.01, 0.6, 0.01, "supported"),
    ("e4", "second", "pilot_own", "pilot_ssl", "a look", 5, 1, 0.03, None, 0.6, 1.0, "not distinguishable"),
    ("e5", "first", "pilot_own", "full_own", "a look", 5, 3, 0.02, 0.01, 0.8, 0.3, "not distinguishable"),
]


def test_stored_rows_families_and_kinds(spark):
    got = {(r.run_id, r.a, r.b): r for r in apply(spark, "all_contrasts", stored_contrasts=stored(spark, ROWS))}
    assert len(got) == len(ROWS)
    family = [got["e1", a, b].holm_p for a, b in (("pilot_own", "pilot_nbr"), ("pilot_nbr", "pilot_ssl"), ("pilot_own", "pilot_ssl"))]
    assert family == [0.03, 0.06, 0.06] and all(r.holm_p is None for k, r in got.items() if k[0] != "e1")
    kinds = {k: r.kind for k, r in got.items()}
    assert kinds["e1", "pilot_own", "pilot_nbr"] == "supported" and kinds["e1", "pilot_own", "pilot_ssl"] == "worse, significant"
    assert kinds["e3", "pilot_own", "pilot_ssl"] == "worse, mean only" and kinds["e4", "pilot_own", "pilot_ssl"] == "descriptive"
    assert got["e4", "pilot_own", "pilot_nbr"].headroom == pytest.approx(0.03 / 0.4)


def test_more_splits_replace_fewer_then_the_latest(spark):
    every = stored(spark, ROWS)
    got = {(r.dataset, r.a, r.b): r for r in apply(spark, "current_contrasts", stored_contrasts=every)}
    assert len(got) == 6
    assert (got["first", "pilot_own", "pilot_nbr"].run_id, got["first", "pilot_own", "pilot_nbr"].replaced, got["first", "pilot_own", "pilot_nbr"].replaced_splits) == ("e1", 1, 2)
    assert (got["first", "pilot_own", "pilot_ssl"].run_id, got["first", "pilot_own", "pilot_ssl"].replaced_splits) == ("e3", 3)
    buckets = {(r.dataset, r.a, r.b): r.bucket for r in apply(spark, "contrast_families", stored_contrasts=every)}
    assert buckets["first", "pilot_own", "pilot_nbr"] == "primary" and buckets["first", "pilot_own", "pilot_ssl"] == "other"
    assert buckets["second", "pilot_own", "pilot_ssl"] == "descriptive" and buckets["first", "pilot_own", "full_own"] == "descriptive"


def test_agreement_is_that_of_kinds(spark):
    (r,) = apply(spark, "agreement", stored_contrasts=stored(spark, ROWS))  # the other pair has one split on one side
    assert (r.contrast, r.first_kind, r.second_kind, r.agrees) == ("own to nbr", "supported", "supported", True)
    changed = [(*x[:-1], "worse") if x[:4] == ("e4", "second", "pilot_own", "pilot_nbr") else x for x in ROWS]
    (r,) = apply(spark, "agreement", stored_contrasts=stored(spark, changed))
    assert r.first_mean > 0 < r.second_mean and not r.agrees


def test_only_deltas_of_replications_are_marked(spark):
    options = spark.createDataFrame([("d", "own", 0, 0.80, None, 0), ("d", "own", 0, 0.82, "laptop", 1), ("d", "nbr", 0, 0.85, None, 0), ("d", "nbr", 0, 0.90, "desktop", 1), ("d", "own", 1, 0.7, None, 0), ("d", "nbr", 1, 0.8, None, 0), ("d", "own", 2, 0.7, "laptop", 1), ("d", "nbr", 2, 0.8, None, 0)], "dataset string, feature_set string, split int, v double, device string, place long")

    def deltas(*rows):
        return spark.createDataFrame([("e", "d", "own", "nbr", k, v) for k, v in rows], "run_id string, dataset string, a string, b string, split int, delta double")

    def marked(*rows):
        return [(r.split, r.setups, r.devices) for r in apply(spark, "replication_splits", entry_deltas=deltas(*rows), run_options=options)]

    assert marked((0, 0.05), (1, 0.1)) == []  # what the counted runs give
    assert marked((0, 0.10)) == [(0, "nbr", "desktop")]
    assert marked((0, 0.03)) == [(0, "own", "laptop")]
    assert marked((0, 0.08)) == [(0, "own,nbr", "desktop,laptop")]
    assert marked((0, 0.5), (2, 0.1)) == []  # no recorded run gives it; a side is not counted


def test_gaps_settings_and_labels(spark):
    runs = spark.createDataFrame([("first", "", b, s, "pilot") for b, n in (("own", 3), ("nbr", 3), ("ssl", 2)) for s in range(n)] + [("first", "", "own", 9, "full"), ("second", "x", "own", 0, "pilot")], "dataset string, suffix string, base string, split int, budget_read string")
    assert [(r.dataset, r.variant, r.base, r.n_splits, r.most) for r in apply(spark, "split_gaps", usable_runs=runs)] == [("first", "", "ssl", 2, 3)]
    scores = spark.createDataFrame([("d", "own", 0, "tuned", 0.9, 0.8), ("d", "own", 0, "default", 0.85, 0.78), ("d", "own", 1, "tuned", 0.8, 0.7), ("d", "nbr", 0, "tuned", 0.8, 0.7)], "dataset string, base string, split int, settings string, test_pr_auc double, cv_pr_auc double")
    assert [(r.base, r.tuned_cv, r.default_cv) for r in apply(spark, "tuned_vs_default", settings_scores=scores)] == [("own", 0.75, 0.78)]
    (r,) = apply(spark, "default_settings_check", settings_scores=scores)
    assert (r.base, r.n_splits, r.test_tuned, r.test_default, r.cv_default, r.delta_mean, r.delta_sd) == ("own", 1, 0.9, 0.85, 0.78, 0.05, None)
    metrics = spark.createDataFrame(
        [("ok", "own", "pilot", 0.8, 0.8, 0.1, 0.9, 0.5, 0.7, 0.9, 10, 3, 0.7, "gbt (none)"), ("bad", "own", "full", 0.8, 1.1, 0.85, 0.9, None, 0.81, 0.9, 10, 3, 1.2, "gbt (none)"), ("rung", "gnn", "full", 0.8, 0.8, 0.1, 0.9, 0.5, None, None, 1, 1, 0.8, "lr (filter)")],
        "run_id string, base string, budget_read string, test_pr_auc double, cv_pr_auc double, no_skill double, test_auroc double, threshold double, low double, high double, trials int, n_classifiers int, other_cv double, model_a string",
    )
    assert sorted((r.run_id, r.metric) for r in apply(spark, "metric_ranges", run_metrics=metrics)) == [("bad", "cv_pr_auc"), ("bad", "not above no skill"), ("bad", "outside its interval"), ("bad", "threshold")]
    assert [r.run_id for r in apply(spark, "budget_labels", run_metrics=metrics)] == ["bad"]
    assert {r.run_id: (r.best, r.wrong) for r in apply(spark, "model_a_check", run_metrics=metrics)} == {"ok": ("gbt (none)", False), "bad": ("lr (filter)", True), "rung": (None, False)}
