"""Analytics over a results database: runs, replications, setups, contrasts, coverage and integrity checks (template operators).

Entries are derived from the test tables: an entry is a customer segment's orders of one part of the calendar and priority.
"""

from __future__ import annotations

import quillmesh.operators.metrics  # noqa: F401  defines the inputs
from quillmesh.operators.graph import add_ranks
from quillmesh.plans.dialect import LIBRARY

add = LIBRARY.add

add("facts", """
    SELECT c.c_mktsegment AS seg, c.c_nationkey AS nat, o.o_orderkey AS k, o.o_orderpriority AS prio, o.o_orderdate AS d, CAST(round(o.o_totalprice * 100) AS BIGINT) AS cents
    FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey""", public=False)
add("run_facts", """
    SELECT CASE WHEN nat < 13 THEN 'first' ELSE 'second' END AS dataset, CASE WHEN substr(prio, 1, 1) IN ('1', '2') THEN 'full' ELSE 'pilot' END AS budget, CASE seg WHEN 'BUILDING' THEN 'own' WHEN 'MACHINERY' THEN 'own_nbr' WHEN 'AUTOMOBILE' THEN 'own_ssl' WHEN 'FURNITURE' THEN 'gnn' ELSE 'own_nbr_ssl' END AS setup,
        CASE WHEN substr(prio, 1, 1) = '5' THEN 'no19' ELSE '' END AS variant, CAST(month(d) % 4 AS BIGINT) AS split, CAST(year(d) % 3 AS BIGINT) AS attempt, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS cents, CAST(min(k) AS BIGINT) AS first_key, CAST(sum(cents % 1000) AS BIGINT) AS odd
    FROM {facts} GROUP BY 1, 2, 3, 4, 5, 6""".replace("GROUP BY 1, 2, 3, 4, 5, 6", """GROUP BY CASE WHEN nat < 13 THEN 'first' ELSE 'second' END, CASE WHEN substr(prio, 1, 1) IN ('1', '2') THEN 'full' ELSE 'pilot' END, CASE seg WHEN 'BUILDING' THEN 'own' WHEN 'MACHINERY' THEN 'own_nbr' WHEN 'AUTOMOBILE' THEN 'own_ssl' WHEN 'FURNITURE' THEN 'gnn' ELSE 'own_nbr_ssl' END,
        CASE WHEN substr(prio, 1, 1) = '5' THEN 'no19' ELSE '' END, CAST(month(d) % 4 AS BIGINT), CAST(year(d) % 3 AS BIGINT)"""), public=False)
add("meta", """
    SELECT dataset || '_' || budget || '_' || setup || variant || '_' || CAST(split AS VARCHAR(4)) || '_' || CAST(attempt AS VARCHAR(4)) AS run_id, CASE WHEN variant = '' THEN budget || '_' || setup ELSE budget || '_' || setup || '_' || variant END AS feature_set,
        CASE WHEN first_key % 11 = 3 THEN 'compare' ELSE 'pipeline' END AS kind, CASE WHEN first_key % 13 = 5 THEN 'failed' ELSE 'ok' END AS status, dataset, budget, setup, variant, split, 1000000 * attempt + first_key AS started, 1000000 * attempt + first_key + odd % 7200 AS finished,
        CASE WHEN first_key % 2 = 0 THEN 'desktop' ELSE 'laptop' END AS device, CASE WHEN attempt = 2 AND first_key % 17 < 6 THEN dataset || '_' || budget || '_' || setup || variant || '_' || CAST(split AS VARCHAR(4)) || '_0' END AS supersedes,
        CASE WHEN first_key % 19 <> 4 THEN 'h' || CAST(first_key % 5 AS VARCHAR(4)) END AS hash_id, round((cents % 4000) / 10000e0 + 0.5e0, 4) AS test_pr_auc, round((odd % 3000) / 10000e0 + 0.55e0, 4) AS cv_pr_auc, CASE WHEN dataset = 'first' THEN 0.095e0 ELSE 0.145e0 END AS no_skill, n AS n_test, 'tag' || CAST(split AS VARCHAR(4)) || ', ' || setup AS tags
    FROM {run_facts}""", public=False)
add("check_meta", """
    SELECT run_id, CASE WHEN status NOT IN ('ok') THEN 'status' WHEN finished < started THEN 'time' WHEN length(run_id) > 40 THEN 'length' END AS problem, round((finished - started) / 60e0, 1) AS minutes FROM {meta}""", "O-DB1 O-DB2")
add("check_db", "SELECT problem, CAST(count(*) AS BIGINT) AS n FROM (SELECT run_id, 'not ok' AS problem FROM {meta} WHERE status <> 'ok' UNION ALL SELECT m.run_id, 'supersedes nothing' FROM {meta} m LEFT JOIN {meta} o ON o.run_id = m.supersedes WHERE m.supersedes IS NOT NULL AND o.run_id IS NULL UNION ALL SELECT run_id, 'no hash' FROM {meta} WHERE hash_id IS NULL) p GROUP BY problem", "O-DB3 O-DB34 O-IO9")
add_ranks("entry_places", "meta", "run_id, dataset, feature_set, device, tags, test_pr_auc", "CAST(floor(started / 65536e0) AS BIGINT)", "started, run_id")
add("index_table", "SELECT CAST(place + 1 AS BIGINT) AS place, run_id, dataset, feature_set, device || ' / ' || split_part(tags, ', ', 1) AS where_run, test_pr_auc FROM {entry_places}", "O-DB4",
    oracle="SELECT CAST(row_number() OVER (ORDER BY started, run_id) AS BIGINT) AS place, run_id, dataset, feature_set, device || ' / ' || split_part(tags, ', ', 1) AS where_run, test_pr_auc FROM {meta}")
add("combined_results", "SELECT run_id, model, selection, pr_auc, cv_pr_auc FROM (SELECT run_id, 'gbt' AS model, CAST(NULL AS VARCHAR(9)) AS selection, test_pr_auc AS pr_auc, cv_pr_auc FROM {meta} WHERE kind = 'pipeline' UNION ALL SELECT run_id, 'lr', 'filter', CAST(NULL AS DOUBLE), cv_pr_auc - 0.01e0 FROM {meta} WHERE kind <> 'pipeline') r", "O-DB5 O-IO14 O-IO15 O-DB6")
add("run_slugs", "SELECT run_id, $RX(lower(run_id || ' ' || device), '[^a-z0-9]+', '-') || '-' || substr(md5(run_id), 1, 6) AS slug FROM {meta}", "O-DB7")
add("filtered_entries", "SELECT run_id FROM {meta} WHERE dataset = 'first' AND ', ' || tags || ',' LIKE '%, tag1,%' AND run_id LIKE 'first_p%'", "O-DB8")
add("superseded", "SELECT m.run_id, s.supersedes IS NOT NULL AS superseded FROM {meta} m LEFT JOIN (SELECT DISTINCT supersedes FROM {meta} WHERE supersedes IS NOT NULL) s ON s.supersedes = m.run_id", "O-DB9")
add("setups", "SELECT 'own' AS base, 'B' AS letter, 1 AS position UNION ALL SELECT 'own_nbr', 'E1', 2 UNION ALL SELECT 'own_ssl', 'E2', 3 UNION ALL SELECT 'gnn', 'E5', 4 UNION ALL SELECT 'own_nbr_ssl', 'E7', 5", public=False)
add("runs_table", """
    SELECT run_id, dataset, budget_read, base, letter, suffix, split, started, hash_id, test_pr_auc, cv_pr_auc, round((test_pr_auc - no_skill) / (1e0 - no_skill), 9) AS skill, status, superseded, n_test, no_skill FROM (
        SELECT m.*, p.superseded, split_part(m.feature_set, '_', 1) AS budget_read, s.base, s.letter, substr(m.feature_set, length(split_part(m.feature_set, '_', 1)) + length(s.base) + 3) AS suffix,
            row_number() OVER (PARTITION BY m.run_id ORDER BY length(s.base) DESC) AS rn
        FROM {meta} m JOIN {superseded} p ON p.run_id = m.run_id JOIN {setups} s ON substr(m.feature_set, length(split_part(m.feature_set, '_', 1)) + 2) || '_' LIKE replace(s.base, '_', '_') || '_%' WHERE m.kind = 'pipeline') r WHERE rn = 1""", "O-DB10 O-DB12 O-DB16")
add("replications", """
    SELECT r.run_id, r.hash_id, t.first_hash, coalesce(t.first_hash IS NOT NULL AND t.hash_id IS NOT NULL AND t.hash_id <> t.first_hash AND t.nth = 1, false) AS replication FROM {runs_table} r LEFT JOIN (
        SELECT run_id, hash_id, max(CASE WHEN rn = 1 THEN hash_id END) OVER (PARTITION BY dataset, budget_read, base, suffix, split) AS first_hash, row_number() OVER (PARTITION BY dataset, budget_read, base, suffix, split, hash_id ORDER BY started, run_id) AS nth
        FROM (SELECT u.*, row_number() OVER (PARTITION BY dataset, budget_read, base, suffix, split ORDER BY started, run_id) AS rn FROM {runs_table} u WHERE u.status = 'ok' AND NOT u.superseded) s) t ON t.run_id = r.run_id""", "O-DB11")
add("usable_runs", "SELECT r.* FROM {runs_table} r JOIN {replications} p ON p.run_id = r.run_id WHERE r.status = 'ok' AND NOT r.superseded AND NOT p.replication", "O-DB13")
add("duplicate_runs", "SELECT dataset, budget_read, base, suffix, split, CAST(count(*) AS BIGINT) AS n FROM {usable_runs} GROUP BY dataset, budget_read, base, suffix, split HAVING count(*) > 1", "O-DB14")
add("one_run", "SELECT * FROM (SELECT u.*, row_number() OVER (PARTITION BY dataset, budget_read, base, suffix, split ORDER BY started DESC, run_id) AS latest FROM {usable_runs} u) l WHERE latest = 1", public=False)
add("setup_summary", "SELECT dataset, budget_read, suffix, base, CAST(count(*) AS BIGINT) AS n, round(avg(test_pr_auc), 7) AS test_mean, round(stddev_samp(test_pr_auc), 7) AS test_sd, round(avg(cv_pr_auc), 7) AS cv_mean, round(stddev_samp(cv_pr_auc), 7) AS cv_sd, round(avg(skill), 7) AS skill_mean, round(stddev_samp(skill), 7) AS skill_sd, max(no_skill) AS no_skill, max(CASE WHEN split = 0 THEN 1 ELSE 0 END) AS has_first, $JOIN(CAST(split AS VARCHAR(4)), split) AS splits FROM {one_run} GROUP BY dataset, budget_read, suffix, base", "O-DB15 O-DQ7")
add("normalised_skill", "SELECT run_id, skill FROM {runs_table}", "O-DB16")
add("budget_setups", "SELECT dataset, suffix, budget_read, CASE budget_read WHEN 'full' THEN 2 ELSE 1 END AS size, count(DISTINCT base) AS n FROM {one_run} GROUP BY dataset, suffix, budget_read", public=False)
add("budget_with_every_setup", """
    SELECT a.dataset, a.suffix, max_by(CASE WHEN b.n = a.n THEN b.budget_read END, CASE WHEN b.n = a.n THEN b.size ELSE 0 END) AS budget
    FROM (SELECT dataset, suffix, count(DISTINCT base) AS n FROM {one_run} GROUP BY dataset, suffix) a JOIN {budget_setups} b ON b.dataset = a.dataset AND b.suffix = a.suffix GROUP BY a.dataset, a.suffix""", "O-DB17",
    oracle="""WITH every AS (SELECT dataset, suffix, list_sort(list(DISTINCT base)) AS wanted FROM {one_run} GROUP BY ALL), own AS (SELECT dataset, suffix, budget_read, list_sort(list(DISTINCT base)) AS got FROM {one_run} GROUP BY ALL)
        SELECT e.dataset, e.suffix, CASE WHEN EXISTS (SELECT 1 FROM own o WHERE o.dataset = e.dataset AND o.suffix = e.suffix AND o.budget_read = 'full' AND o.got = e.wanted) THEN 'full'
            WHEN EXISTS (SELECT 1 FROM own o WHERE o.dataset = e.dataset AND o.suffix = e.suffix AND o.budget_read = 'pilot' AND o.got = e.wanted) THEN 'pilot' END AS budget FROM every e""")
add("setup_places", """
    SELECT s.dataset, s.suffix, s.budget_read, s.base, s.cv_mean, s.cv_sd, row_number() OVER (PARTITION BY s.dataset, s.suffix ORDER BY s.cv_mean DESC, k.position) AS place
    FROM {setup_summary} s JOIN {budget_with_every_setup} b ON b.dataset = s.dataset AND b.suffix = s.suffix AND b.budget = s.budget_read JOIN {setups} k ON k.base = s.base WHERE s.has_first = 1""", public=False)
add("best_setup", """
    SELECT t.dataset, t.suffix, t.budget_read AS budget, t.base AS top, CAST(sum(CASE WHEN o.place > 1 AND t.cv_mean - o.cv_mean <= coalesce(t.cv_sd, 0e0) THEN 1 ELSE 0 END) AS BIGINT) AS close_others
    FROM {setup_places} t JOIN {setup_places} o ON o.dataset = t.dataset AND o.suffix = t.suffix WHERE t.place = 1 GROUP BY t.dataset, t.suffix, t.budget_read, t.base""", "O-DB18")
add("holm", "SELECT contrast, p, max(least(1e0, (m - rn + 1) * p)) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adjusted FROM (SELECT contrast, p, row_number() OVER (ORDER BY p, contrast) AS rn, count(*) OVER () AS m FROM {p_values}) r", "O-DB19")
add("verdict_kind", "SELECT v.contrast, CASE WHEN s.n = 1 THEN 'descriptive' WHEN v.verdict = 'supported' THEN 'supported' WHEN v.verdict = 'worse' AND v.p < 0.05e0 THEN 'significant' WHEN v.verdict = 'worse' THEN 'mean only' ELSE 'open' END AS kind FROM {verdicts} v JOIN {contrast_stats} s ON s.contrast = v.contrast", "O-DB20")
add("wide_deltas", "SELECT contrast, " + ", ".join(f"max(CASE WHEN split = {k} THEN delta END) AS d{k}" for k in range(5)) + " FROM {deltas} GROUP BY contrast", public=False)
add("split_deltas", "SELECT contrast, split, delta FROM (" + " UNION ALL ".join(f"SELECT contrast, {k} AS split, d{k} AS delta FROM {{wide_deltas}}" for k in range(5)) + ") u WHERE delta IS NOT NULL", "O-DB21")
add("pairs", "SELECT a.dataset, a.budget_read, a.suffix, a.base AS a, b.base AS b, a.split, a.test_pr_auc AS va, b.test_pr_auc AS vb, b.test_pr_auc - a.test_pr_auc AS delta, CASE WHEN a.base = 'own' THEN 'graph' ELSE 'other' END AS family FROM {one_run} a JOIN {one_run} b ON b.dataset = a.dataset AND b.budget_read = a.budget_read AND b.suffix = a.suffix AND b.split = a.split AND a.base < b.base", public=False)
# Recorded contrasts: an entry compares two feature sets on the runs that it saw, an early one on two splits, a late one on all
add("run_scores", "SELECT r.run_id, r.dataset, r.budget_read, r.suffix, r.base, r.split, r.started, r.test_pr_auc, r.cv_pr_auc, m.device, p.replication FROM {runs_table} r JOIN {meta} m ON m.run_id = r.run_id JOIN {replications} p ON p.run_id = r.run_id WHERE r.status = 'ok' AND NOT r.superseded", public=False)
add("entry_sides", """
    SELECT e, dataset, budget_read, suffix, base, budget_read || '_' || base || CASE WHEN suffix = '' THEN '' ELSE '_' || suffix END AS feature_set, split, test_pr_auc, cv_pr_auc
    FROM (SELECT s.*, t.k AS e, row_number() OVER (PARTITION BY t.k, s.dataset, s.budget_read, s.suffix, s.base, s.split ORDER BY $H(61, t.k, s.run_id), s.run_id) AS rn FROM {run_scores} s $TWICE(t)) x WHERE rn = 1 AND (e = 1 OR split < 2)""", public=False)
add("entry_deltas", """
    SELECT 'compare_' || x.dataset || '_' || CASE WHEN x.budget_read = y.budget_read THEN x.budget_read ELSE 'cross' END || x.suffix || '_' || CAST(x.e AS VARCHAR(4)) AS run_id, x.e, x.dataset, x.suffix, x.feature_set AS a, y.feature_set AS b, x.base AS a_base, y.base AS b_base,
        x.budget_read AS a_budget, y.budget_read AS b_budget, x.split, x.test_pr_auc AS va, y.test_pr_auc AS vb, y.test_pr_auc - x.test_pr_auc AS delta, y.cv_pr_auc - x.cv_pr_auc AS cv_gap
    FROM {entry_sides} x JOIN {entry_sides} y ON y.e = x.e AND y.dataset = x.dataset AND y.suffix = x.suffix AND y.split = x.split AND (y.budget_read = x.budget_read AND x.base < y.base OR y.base = x.base AND x.budget_read = 'pilot' AND y.budget_read = 'full')""", public=False)
add("entry_folds", "SELECT d.run_id, d.a, d.b, d.split, f.b AS fold, d.cv_gap + ($H(67, d.run_id, d.a, d.b, d.split, f.b) % 2001 - 1000) / 50000e0 AS diff FROM {entry_deltas} d CROSS JOIN $SERIES(5) f", public=False)
add("entry_tests", """
    SELECT run_id, a, b, CAST(n AS BIGINT) AS cv_folds, round(m, 9) AS cv_delta, round(CASE WHEN v > 0 THEN $P(m / sqrt((1e0 / n + 0.25e0) * v), (n - 1)) WHEN m = 0 THEN 1e0 ELSE 0e0 END, 9) AS p
    FROM (SELECT run_id, a, b, CAST(count(*) AS BIGINT) AS n, avg(diff) AS m, var_samp(diff) AS v FROM {entry_folds} GROUP BY run_id, a, b) f""", public=False)
# A stored verdict is that of the rule, but for a few that the checks are to find.
add("stored_contrasts", """
    SELECT d.*, t.cv_folds, t.cv_delta, t.p, CASE WHEN $H(71, d.run_id, d.a, d.b) % 41 = 0 THEN 'supported' WHEN d.least > 0 AND d.mean > coalesce(d.sd, 0e0) AND t.p < 0.05e0 THEN 'supported' WHEN d.mean > 0 THEN 'not distinguishable' ELSE 'worse' END AS verdict
    FROM (SELECT run_id, dataset, suffix, a, b, a_base, b_base, a_budget, b_budget, CASE WHEN e = 1 THEN 'all pairs, primary family' ELSE 'first look' END AS description, 1000 * e + $H(73, run_id) % 1000 AS started, CAST(count(*) AS BIGINT) AS n_splits, round(avg(delta), 9) AS mean, round(stddev_samp(delta), 9) AS sd,
        round(avg(va), 9) AS pr_a, round(avg(vb), 9) AS pr_b, min(delta) AS least FROM {entry_deltas} GROUP BY run_id, dataset, suffix, a, b, a_base, b_base, a_budget, b_budget, e) d JOIN {entry_tests} t ON t.run_id = d.run_id AND t.a = d.a AND t.b = d.b""", public=False)
_KIND = "CASE WHEN n_splits < 2 THEN 'descriptive' WHEN verdict = 'supported' THEN 'supported' WHEN verdict = 'not distinguishable' THEN 'not distinguishable' WHEN p < 0.05e0 THEN 'worse, significant' ELSE 'worse, mean only' END"
add("all_contrasts", f"""
    SELECT run_id, dataset, suffix, a, b, a_base, b_base, a_budget, b_budget, family, started, n_splits, mean, sd, pr_a, pr_b, cv_folds, cv_delta, p, CASE WHEN family = 'primary' THEN round(max(least(1e0, (m - rn + 1) * p)) OVER (PARTITION BY run_id, family ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 7) END AS holm_p,
        verdict, {_KIND} AS kind, round(mean / (1e0 - pr_a), 7) AS headroom
    FROM (SELECT c.*, CASE WHEN description LIKE '%primary family%' THEN 'primary' ELSE 'other' END AS family, row_number() OVER (PARTITION BY run_id ORDER BY p, a, b) AS rn, count(*) OVER (PARTITION BY run_id) AS m FROM {{stored_contrasts}} c) r""", "O-DB22 O-EV23",
    oracle=f"""WITH ranked AS (SELECT run_id, list(struct_pack(p := p, a := a, b := b) ORDER BY p, a, b) AS every FROM {{stored_contrasts}} GROUP BY run_id)
        SELECT c.run_id, dataset, suffix, a, b, a_base, b_base, a_budget, b_budget, CASE WHEN contains(description, 'primary family') THEN 'primary' ELSE 'other' END AS family, started, n_splits, mean, sd, pr_a, pr_b, cv_folds, cv_delta, p,
        CASE WHEN contains(description, 'primary family') THEN round(list_max(list_transform(every[1:list_position(every, struct_pack(p := p, a := a, b := b))], lambda x, i: least(1e0, (len(every) - i + 1) * x.p))), 7) END AS holm_p, verdict, {_KIND} AS kind, round(mean / (1e0 - pr_a), 7) AS headroom
        FROM {{stored_contrasts}} c JOIN ranked r ON r.run_id = c.run_id""")
add("current_contrasts", """
    SELECT dataset, a, b, suffix, a_base, b_base, a_budget, b_budget, family, run_id, n_splits, mean, sd, p, kind, replaced, replaced_splits FROM (
        SELECT c.*, row_number() OVER (PARTITION BY dataset, a, b ORDER BY n_splits DESC, started DESC, run_id) AS rn, CAST(count(*) OVER (PARTITION BY dataset, a, b) - 1 AS BIGINT) AS replaced, lead(n_splits) OVER (PARTITION BY dataset, a, b ORDER BY n_splits DESC, started DESC, run_id) AS replaced_splits FROM {all_contrasts} c) r WHERE rn = 1""", "O-DB23",
    oracle="""WITH g AS (SELECT dataset, a, b, list(c ORDER BY n_splits DESC, started DESC, run_id) AS every FROM {all_contrasts} c GROUP BY dataset, a, b)
        SELECT dataset, a, b, every[1].suffix AS suffix, every[1].a_base AS a_base, every[1].b_base AS b_base, every[1].a_budget AS a_budget, every[1].b_budget AS b_budget, every[1].family AS family, every[1].run_id AS run_id, every[1].n_splits AS n_splits, every[1].mean AS mean, every[1].sd AS sd, every[1].p AS p, every[1].kind AS kind, CAST(len(every) - 1 AS BIGINT) AS replaced, every[2].n_splits AS replaced_splits FROM g""")
# Which recorded runs can stand for a feature set on a split: the counted one first, then its replications.
add("run_options", """
    SELECT dataset, budget_read || '_' || base || CASE WHEN suffix = '' THEN '' ELSE '_' || suffix END AS feature_set, split, test_pr_auc AS v, CAST(NULL AS VARCHAR(9)) AS device, CAST(0 AS BIGINT) AS place FROM {one_run}
    UNION ALL SELECT dataset, budget_read || '_' || base || CASE WHEN suffix = '' THEN '' ELSE '_' || suffix END, split, test_pr_auc, device, CAST(row_number() OVER (PARTITION BY dataset, budget_read, base, suffix, split ORDER BY started, run_id) AS BIGINT) FROM {run_scores} WHERE replication""", public=False)
add("replication_splits", """
    SELECT run_id, a, b, split, CASE WHEN da IS NULL THEN b WHEN db IS NULL THEN a ELSE a || ',' || b END AS setups, CASE WHEN da IS NULL THEN db WHEN db IS NULL OR da = db THEN da WHEN da < db THEN da || ',' || db ELSE db || ',' || da END AS devices FROM (
        SELECT d.run_id, d.a, d.b, d.split, x.device AS da, y.device AS db, row_number() OVER (PARTITION BY d.run_id, d.a, d.b, d.split ORDER BY x.place, y.place) AS rn
        FROM {entry_deltas} d JOIN {run_options} ca ON ca.dataset = d.dataset AND ca.feature_set = d.a AND ca.split = d.split AND ca.place = 0 JOIN {run_options} cb ON cb.dataset = d.dataset AND cb.feature_set = d.b AND cb.split = d.split AND cb.place = 0
        JOIN {run_options} x ON x.dataset = d.dataset AND x.feature_set = d.a AND x.split = d.split JOIN {run_options} y ON y.dataset = d.dataset AND y.feature_set = d.b AND y.split = d.split
        WHERE abs((cb.v - ca.v) - d.delta) > 1e-6 AND abs((y.v - x.v) - d.delta) <= 1e-6) m WHERE rn = 1""", "O-DB24",
    oracle="""WITH o AS (SELECT dataset, feature_set, split, list(struct_pack(v := v, device := device) ORDER BY place) AS every, bool_or(place = 0) AS counted FROM {run_options} GROUP BY ALL),
        m AS (SELECT d.run_id, d.a, d.b, d.split, d.delta, x.every AS xs, y.every AS ys FROM {entry_deltas} d JOIN o x ON x.dataset = d.dataset AND x.feature_set = d.a AND x.split = d.split AND x.counted JOIN o y ON y.dataset = d.dataset AND y.feature_set = d.b AND y.split = d.split AND y.counted
            WHERE abs((y.every[1].v - x.every[1].v) - d.delta) > 1e-6),
        f AS (SELECT run_id, a, b, split, list_filter(flatten(list_transform(xs, lambda x: list_transform(ys, lambda y: struct_pack(da := x.device, db := y.device, gap := abs((y.v - x.v) - delta))))), lambda q: q.gap <= 1e-6)[1] AS hit FROM m)
        SELECT run_id, a, b, split, array_to_string(list_filter([CASE WHEN hit.da IS NOT NULL THEN a END, CASE WHEN hit.db IS NOT NULL THEN b END], lambda x: x IS NOT NULL), ',') AS setups, array_to_string(list_sort(list_distinct(list_filter([hit.da, hit.db], lambda x: x IS NOT NULL))), ',') AS devices FROM f WHERE hit IS NOT NULL""")
add("contrast_families", """
    SELECT dataset, suffix AS variant, CASE WHEN n_splits < 2 OR a_budget <> b_budget THEN 'descriptive' ELSE family END AS bucket, a, b, n_splits, mean, p, kind FROM {current_contrasts}""", "O-DB25",
    oracle="SELECT dataset, suffix AS variant, family AS bucket, a, b, n_splits, mean, p, kind FROM {current_contrasts} WHERE n_splits >= 2 AND a_budget = b_budget UNION ALL SELECT dataset, suffix, 'descriptive', a, b, n_splits, mean, p, kind FROM {current_contrasts} WHERE NOT (n_splits >= 2 AND a_budget = b_budget)")
add("questions", "SELECT 'do neighbour means help' AS question, 'own_nbr' AS b, 'own' AS a UNION ALL SELECT 'do embeddings help', 'own_ssl', 'own' UNION ALL SELECT 'do embeddings add to means', 'own_nbr_ssl', 'own_nbr' UNION ALL SELECT 'are own features enough', 'own', 'gnn'", public=False)
add("key_questions", f"""
    SELECT dataset, variant, question, {", ".join(f"max(CASE WHEN a_budget = '{b}' THEN {c} END) AS {b}_{c}" for b in ("pilot", "full") for c in ("mean", "p", "n_splits", "kind"))}
    FROM (SELECT c.dataset, c.suffix AS variant, q.question, c.a_budget, c.mean, c.p, c.n_splits, c.kind FROM {{current_contrasts}} c JOIN {{questions}} q ON q.a = c.a_base AND q.b = c.b_base WHERE c.a_budget = c.b_budget) x GROUP BY dataset, variant, question""", "O-DB25",
    oracle="""WITH k AS (SELECT c.*, q.question FROM {current_contrasts} c JOIN {questions} q ON q.a = c.a_base AND q.b = c.b_base WHERE c.a_budget = c.b_budget)
        SELECT coalesce(p.dataset, f.dataset) AS dataset, coalesce(p.suffix, f.suffix) AS variant, coalesce(p.question, f.question) AS question, p.mean AS pilot_mean, p.p AS pilot_p, p.n_splits AS pilot_n_splits, p.kind AS pilot_kind, f.mean AS full_mean, f.p AS full_p, f.n_splits AS full_n_splits, f.kind AS full_kind
        FROM (SELECT * FROM k WHERE a_budget = 'pilot') p FULL JOIN (SELECT * FROM k WHERE a_budget = 'full') f ON f.dataset = p.dataset AND f.suffix = p.suffix AND f.question = p.question""")
# The check of settings: every other attempt of a run took the default ones.
add("settings_scores", "SELECT dataset, base, split, CASE WHEN CAST(floor(started / 1000000e0) AS BIGINT) % 2 = 0 THEN 'tuned' ELSE 'default' END AS settings, test_pr_auc, cv_pr_auc FROM {runs_table} WHERE status = 'ok' AND suffix = '' AND budget_read = 'pilot'", public=False)
add("tuned_vs_default", """
    SELECT dataset, base, round(avg(CASE WHEN settings = 'tuned' THEN cv_pr_auc END), 7) AS tuned_cv, round(avg(CASE WHEN settings = 'default' THEN cv_pr_auc END), 7) AS default_cv FROM {settings_scores} GROUP BY dataset, base HAVING count(DISTINCT settings) = 2""", "O-DB26",
    oracle="SELECT t.dataset, t.base, round(t.cv, 7) AS tuned_cv, round(d.cv, 7) AS default_cv FROM (SELECT dataset, base, avg(cv_pr_auc) AS cv FROM {settings_scores} WHERE settings = 'tuned' GROUP BY ALL) t JOIN (SELECT dataset, base, avg(cv_pr_auc) AS cv FROM {settings_scores} WHERE settings = 'default' GROUP BY ALL) d USING (dataset, base)")
add("settings_by_split", "SELECT dataset, base, split, avg(CASE WHEN settings = 'tuned' THEN test_pr_auc END) AS tuned, avg(CASE WHEN settings = 'default' THEN test_pr_auc END) AS plain, avg(CASE WHEN settings = 'default' THEN cv_pr_auc END) AS plain_cv FROM {settings_scores} GROUP BY dataset, base, split HAVING count(DISTINCT settings) = 2", public=False)
add("default_settings_check", """
    SELECT dataset, base, CAST(count(*) AS BIGINT) AS n_splits, round(avg(tuned), 7) AS test_tuned, round(avg(plain), 7) AS test_default, round(avg(plain_cv), 7) AS cv_default, round(avg(tuned - plain), 7) AS delta_mean, round(stddev_samp(tuned - plain), 7) AS delta_sd FROM {settings_by_split} GROUP BY dataset, base""", "O-DB26")
add("graph_gain", "SELECT dataset, budget_read, b, CAST(count(*) AS BIGINT) AS n, round(avg(delta), 7) AS mean, round(stddev_samp(delta), 7) AS sd, round(min(delta), 7) AS low, round(max(delta), 7) AS high FROM {pairs} WHERE a = 'own' AND suffix = '' GROUP BY dataset, budget_read, b", "O-DB27")
add("agreement", """
    SELECT f.a_base || ' to ' || f.b_base AS contrast, f.mean AS first_mean, f.p AS first_p, f.n_splits AS first_splits, f.kind AS first_kind, g.mean AS second_mean, g.p AS second_p, g.n_splits AS second_splits, g.kind AS second_kind, f.kind = g.kind AS agrees
    FROM {current_contrasts} f JOIN {current_contrasts} g ON g.a = f.a AND g.b = f.b WHERE f.dataset = 'first' AND g.dataset = 'second' AND f.suffix = '' AND f.a_budget = 'pilot' AND f.b_budget = 'pilot' AND f.n_splits >= 2 AND g.n_splits >= 2""", "O-DB28",
    oracle="""SELECT any_value(a_base) || ' to ' || any_value(b_base) AS contrast, max(mean) FILTER (dataset = 'first') AS first_mean, max(p) FILTER (dataset = 'first') AS first_p, max(n_splits) FILTER (dataset = 'first') AS first_splits, max(kind) FILTER (dataset = 'first') AS first_kind,
        max(mean) FILTER (dataset = 'second') AS second_mean, max(p) FILTER (dataset = 'second') AS second_p, max(n_splits) FILTER (dataset = 'second') AS second_splits, max(kind) FILTER (dataset = 'second') AS second_kind, count(DISTINCT kind) = 1 AS agrees
        FROM {current_contrasts} WHERE suffix = '' AND a_budget = 'pilot' AND b_budget = 'pilot' AND n_splits >= 2 GROUP BY a, b HAVING count(DISTINCT dataset) = 2""")
add("cross_dataset", """
    SELECT x.base, x.budget_read, x.test_mean AS first_mean, x.test_sd AS first_sd, x.skill_mean AS first_skill, x.skill_sd AS first_skill_sd, x.n AS first_n, y.test_mean AS second_mean, y.test_sd AS second_sd, y.skill_mean AS second_skill, y.skill_sd AS second_skill_sd, y.n AS second_n,
        g.mean AS first_gain, h.mean AS second_gain, z.test_mean AS variant_mean, z.skill_mean AS variant_skill
    FROM {setup_summary} x JOIN {setup_summary} y ON y.base = x.base AND y.budget_read = x.budget_read AND y.suffix = '' AND y.dataset = 'second'
    LEFT JOIN {setup_summary} z ON z.base = x.base AND z.budget_read = x.budget_read AND z.suffix = 'no19' AND z.dataset = 'first'
    LEFT JOIN {graph_gain} g ON g.dataset = 'first' AND g.budget_read = x.budget_read AND g.b = x.base LEFT JOIN {graph_gain} h ON h.dataset = 'second' AND h.budget_read = x.budget_read AND h.b = x.base
    WHERE x.dataset = 'first' AND x.suffix = ''""", "O-DB29")
add("overview", """
    SELECT 'entries' AS what, 'all' AS value, CAST(count(*) AS BIGINT) AS n FROM {meta} UNION ALL SELECT 'kind', kind, CAST(count(*) AS BIGINT) FROM {meta} GROUP BY kind
    UNION ALL SELECT 'runs', 'usable', CAST(count(*) AS BIGINT) FROM {usable_runs} UNION ALL SELECT 'budget', budget_read, CAST(count(*) AS BIGINT) FROM {usable_runs} GROUP BY budget_read UNION ALL SELECT 'dataset', dataset, CAST(count(*) AS BIGINT) FROM {usable_runs} GROUP BY dataset
    UNION ALL SELECT 'device', m.device || ' ' || u.budget_read, CAST(count(*) AS BIGINT) FROM {usable_runs} u JOIN {meta} m ON m.run_id = u.run_id GROUP BY m.device, u.budget_read UNION ALL SELECT 'seed', seed, CAST(count(*) AS BIGINT) FROM (SELECT CAST(split * 100 AS VARCHAR(9)) AS seed FROM {meta} WHERE kind = 'pipeline') s GROUP BY seed
    UNION ALL SELECT 'started', 'first', min(started) FROM {usable_runs} UNION ALL SELECT 'started', 'last', max(started) FROM {usable_runs}
    UNION ALL SELECT 'runs', 'replications', CAST(count(*) AS BIGINT) FROM {replications} p JOIN {runs_table} r ON r.run_id = p.run_id WHERE p.replication AND r.status = 'ok'
    UNION ALL SELECT 'full split', dataset || ' ' || CAST(split AS VARCHAR(4)), CAST(count(*) AS BIGINT) FROM {usable_runs} WHERE budget_read = 'full' GROUP BY dataset, split""", "O-DB30")
add("failed_entries", "SELECT run_id, status, kind FROM {meta} WHERE status <> 'ok'", "O-DB31")
# Every setup and variant at both budgets is in the plan; what has no run there is listed as not run.
add("planned_sets", "SELECT d.dataset, d.suffix, b.budget_read, s.base FROM (SELECT DISTINCT dataset, suffix FROM {usable_runs}) d CROSS JOIN (SELECT DISTINCT budget_read FROM {usable_runs}) b CROSS JOIN {setups} s", public=False)
add("coverage", """
    SELECT p.dataset, p.suffix, p.budget_read, p.base, coalesce(c.splits, 0) AS splits, t.most, CASE WHEN c.splits IS NULL THEN 'not run' WHEN c.splits < t.most THEN 'fewer splits' ELSE 'complete' END AS state
    FROM {planned_sets} p LEFT JOIN (SELECT dataset, suffix, budget_read, base, CAST(count(DISTINCT split) AS BIGINT) AS splits FROM {usable_runs} GROUP BY dataset, suffix, budget_read, base) c ON c.dataset = p.dataset AND c.suffix = p.suffix AND c.budget_read = p.budget_read AND c.base = p.base
    LEFT JOIN (SELECT dataset, budget_read, max(n) AS most FROM (SELECT dataset, budget_read, suffix, base, CAST(count(DISTINCT split) AS BIGINT) AS n FROM {usable_runs} GROUP BY dataset, budget_read, suffix, base) g GROUP BY dataset, budget_read) t ON t.dataset = p.dataset AND t.budget_read = p.budget_read""", "O-DB32",
    oracle="""WITH have AS (SELECT dataset, suffix, budget_read, base, len(list_distinct(list(split))) AS n FROM {usable_runs} GROUP BY ALL)
        SELECT p.dataset, p.suffix, p.budget_read, p.base, CAST(coalesce(h.n, 0) AS BIGINT) AS splits, CAST((SELECT max(n) FROM have x WHERE x.dataset = p.dataset AND x.budget_read = p.budget_read) AS BIGINT) AS most,
            CASE WHEN h.n IS NULL THEN 'not run' WHEN h.n < (SELECT max(n) FROM have x WHERE x.dataset = p.dataset AND x.budget_read = p.budget_read) THEN 'fewer splits' ELSE 'complete' END AS state FROM {planned_sets} p LEFT JOIN have h USING (dataset, suffix, budget_read, base)""")
add("budget_gaps", """
    SELECT dataset, suffix, base, CASE WHEN base = 'gnn' THEN 'gnn rung' ELSE 'pilot only' END AS kind FROM {usable_runs} GROUP BY dataset, suffix, base
    HAVING max(CASE WHEN budget_read = 'pilot' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN budget_read = 'full' THEN 1 ELSE 0 END) = 0""", "O-DB33")
add("split_gaps", """
    SELECT dataset, suffix AS variant, base, n_splits, most FROM (SELECT dataset, suffix, base, n_splits, max(n_splits) OVER (PARTITION BY dataset, suffix) AS most
        FROM (SELECT dataset, suffix, base, CAST(count(DISTINCT split) AS BIGINT) AS n_splits FROM {usable_runs} WHERE budget_read = 'pilot' GROUP BY dataset, suffix, base) c) m WHERE n_splits < most""", "O-DB33",
    oracle="""WITH c AS (SELECT dataset, suffix, base, len(list_distinct(list(split))) AS n FROM {usable_runs} WHERE budget_read = 'pilot' GROUP BY ALL), t AS (SELECT dataset, suffix, max(n) AS most FROM c GROUP BY ALL)
        SELECT c.dataset, c.suffix AS variant, c.base, CAST(c.n AS BIGINT) AS n_splits, CAST(t.most AS BIGINT) AS most FROM c JOIN t USING (dataset, suffix) WHERE c.n <> t.most""")
# What a run's entry holds besides: scores and settings, of which a few are wrong for the checks to find.
add("run_metrics", """
    SELECT u.run_id, u.dataset, u.base, u.budget_read, u.test_pr_auc, u.cv_pr_auc, u.no_skill, CASE WHEN $H(83, u.run_id) % 29 = 0 THEN 1.2e0 ELSE round(0.5e0 + u.test_pr_auc / 2, 6) END AS test_auroc, CASE WHEN $H(84, u.run_id) % 31 <> 0 THEN ($H(85, u.run_id) % 1000) / 1000e0 END AS threshold,
        u.test_pr_auc - 0.03e0 AS low, u.test_pr_auc + CASE WHEN $H(86, u.run_id) % 23 = 0 THEN -0.01e0 ELSE 0.03e0 END AS high, CASE WHEN $H(87, u.run_id) % 19 = 0 THEN 20 WHEN u.budget_read = 'pilot' THEN 10 ELSE 100 END AS trials, CASE WHEN u.budget_read = 'pilot' THEN 3 ELSE 6 END AS n_classifiers,
        u.cv_pr_auc + ($H(88, u.run_id) % 7 - 3) / 100e0 AS other_cv, CASE WHEN $H(88, u.run_id) % 7 > 3 AND $H(89, u.run_id) % 13 > 0 THEN 'lr (filter)' ELSE 'gbt (none)' END AS model_a FROM {usable_runs} u""", public=False)
_RANGED = ("test_pr_auc", "cv_pr_auc", "test_auroc", "no_skill", "threshold")
add("metric_ranges", " UNION ALL ".join(f"SELECT run_id, '{c}' AS metric, {c} AS value FROM {{run_metrics}} WHERE {c} IS NULL OR {c} < 0 OR {c} > 1" for c in _RANGED) + """ UNION ALL SELECT run_id, 'outside its interval', test_pr_auc FROM {run_metrics} WHERE low IS NOT NULL AND high IS NOT NULL AND NOT (low <= test_pr_auc AND test_pr_auc <= high)
    UNION ALL SELECT run_id, 'not above no skill', test_pr_auc FROM {run_metrics} WHERE test_pr_auc <= no_skill""", "O-DB35",
    oracle=f"""WITH u AS (UNPIVOT (SELECT run_id, {", ".join(f"coalesce({c}, -1e0) AS {c}" for c in _RANGED)} FROM {{run_metrics}}) ON {", ".join(_RANGED)} INTO NAME metric VALUE value)
        SELECT run_id, metric, nullif(value, -1e0) AS value FROM u WHERE value NOT BETWEEN 0 AND 1 UNION ALL SELECT run_id, CASE WHEN k = 0 THEN 'outside its interval' ELSE 'not above no skill' END, test_pr_auc FROM {{run_metrics}}, (SELECT unnest([0, 1]) AS k) WHERE k = 0 AND test_pr_auc NOT BETWEEN low AND high OR k = 1 AND test_pr_auc <= no_skill""")
add("budget_labels", "SELECT run_id, budget_read, trials, n_classifiers FROM {run_metrics} WHERE base <> 'gnn' AND NOT (trials = CASE WHEN budget_read = 'pilot' THEN 10 ELSE 100 END AND n_classifiers = CASE WHEN budget_read = 'pilot' THEN 3 ELSE 6 END)", "O-DB35",
    oracle="SELECT run_id, budget_read, trials, n_classifiers FROM {run_metrics} WHERE base <> 'gnn' AND (budget_read, trials, n_classifiers) NOT IN (('pilot', 10, 3), ('full', 100, 6))")
add("model_a_check", "SELECT run_id, model_a, CASE WHEN other_cv > cv_pr_auc THEN 'lr (filter)' WHEN other_cv < cv_pr_auc THEN 'gbt (none)' END AS best, NOT (other_cv > cv_pr_auc AND model_a = 'lr (filter)' OR other_cv < cv_pr_auc AND model_a = 'gbt (none)' OR other_cv = cv_pr_auc) AS wrong FROM {run_metrics}", "O-DB36",
    oracle="""WITH t AS (SELECT run_id, model_a, unnest([struct_pack(name := 'gbt (none)', cv := cv_pr_auc), struct_pack(name := 'lr (filter)', cv := other_cv)]) AS m FROM {run_metrics}), b AS (SELECT run_id, any_value(model_a) AS model_a, list(m.name) FILTER (m.cv = top) AS names FROM (SELECT *, max(m.cv) OVER (PARTITION BY run_id) AS top FROM t) GROUP BY run_id)
        SELECT run_id, model_a, CASE WHEN len(names) = 1 THEN names[1] END AS best, NOT list_contains(names, model_a) AS wrong FROM b""")
add("verdicts_recomputed", "SELECT c.run_id, c.a, c.b, c.verdict AS stored, CASE WHEN d.least > 0 AND d.mean > coalesce(d.sd, 0e0) AND c.p < 0.05e0 THEN 'supported' WHEN d.mean > 0 THEN 'not distinguishable' ELSE 'worse' END AS again FROM {stored_contrasts} c JOIN (SELECT run_id, a, b, min(delta) AS least, avg(delta) AS mean, stddev_samp(delta) AS sd FROM {entry_deltas} GROUP BY run_id, a, b) d ON d.run_id = c.run_id AND d.a = c.a AND d.b = c.b", "O-DB36")
add("deltas_in_runs", """
    SELECT d.run_id, d.a, d.b, d.split, min(abs((y.test_pr_auc - x.test_pr_auc) - d.delta)) <= 1e-6 AS found FROM {entry_deltas} d JOIN {run_scores} x ON x.dataset = d.dataset AND x.budget_read = d.a_budget AND x.suffix = d.suffix AND x.base = d.a_base AND x.split = d.split
    JOIN {run_scores} y ON y.dataset = d.dataset AND y.budget_read = d.b_budget AND y.suffix = d.suffix AND y.base = d.b_base AND y.split = d.split GROUP BY d.run_id, d.a, d.b, d.split""", public=False)
add("contrasts_recomputed", """
    SELECT 'model A by cross-validation' AS name, CAST(count(*) AS BIGINT) AS checked, CAST(sum(CASE WHEN wrong THEN 1 ELSE 0 END) AS BIGINT) AS problems FROM {model_a_check} UNION ALL SELECT 'verdicts follow the rule', CAST(count(*) AS BIGINT), CAST(sum(CASE WHEN stored <> again THEN 1 ELSE 0 END) AS BIGINT) FROM {verdicts_recomputed}
    UNION ALL SELECT 'arithmetic', CAST(count(*) AS BIGINT), CAST(sum(CASE WHEN abs(s.mean - d.mean) > 1e-6 OR abs(s.sd - d.sd) > 1e-6 OR abs((s.pr_b - s.pr_a) - s.mean) > 1e-6 OR s.p < 0 OR s.p > 1 OR s.cv_folds <> 5 * s.n_splits THEN 1 ELSE 0 END) AS BIGINT)
        FROM {stored_contrasts} s JOIN (SELECT run_id, a, b, avg(delta) AS mean, stddev_samp(delta) AS sd FROM {entry_deltas} GROUP BY run_id, a, b) d ON d.run_id = s.run_id AND d.a = s.a AND d.b = s.b
    UNION ALL SELECT 'deltas of recorded runs', CAST(count(*) AS BIGINT), CAST(sum(CASE WHEN found THEN 0 ELSE 1 END) AS BIGINT) FROM {deltas_in_runs} UNION ALL SELECT 'replaced by no fewer splits', CAST(sum(replaced) AS BIGINT), CAST(sum(CASE WHEN replaced_splits > n_splits THEN 1 ELSE 0 END) AS BIGINT) FROM {current_contrasts}""", "O-DB36")
add("frozen_test_set", "SELECT dataset, split, CAST(count(DISTINCT n_test) AS BIGINT) AS sizes, CAST(count(DISTINCT no_skill) AS BIGINT) AS rates FROM {usable_runs} GROUP BY dataset, split HAVING count(DISTINCT n_test) > 1 OR count(DISTINCT no_skill) > 1", "O-DB35")
add("run_all_checks", """
    SELECT name, bad = 0 AS ok, bad FROM (SELECT 'ranges' AS name, CAST(count(*) AS BIGINT) AS bad FROM {metric_ranges} UNION ALL SELECT 'frozen', CAST(count(*) AS BIGINT) FROM {frozen_test_set} UNION ALL SELECT 'duplicates', CAST(count(*) AS BIGINT) FROM {duplicate_runs} UNION ALL SELECT 'budget labels', CAST(count(*) AS BIGINT) FROM {budget_labels}
    UNION ALL SELECT name, problems FROM {contrasts_recomputed}) c""", "O-ST21 O-DB34")
add("report_rows", "SELECT budget_read, base, round(avg(test_mean), 7) AS mean, round(max(test_sd), 7) AS largest_sd FROM {setup_summary} GROUP BY budget_read, base", "O-DB37")
add("scores_by_variant", "SELECT base, max(CASE WHEN suffix = '' THEN v END) AS plain, max(CASE WHEN suffix = 'no19' THEN v END) AS no19 FROM (SELECT base, suffix, max_by(test_mean, n * 10 + CASE WHEN dataset = 'first' THEN 1 ELSE 0 END + CASE WHEN budget_read = 'full' THEN 2 ELSE 0 END) AS v FROM {setup_summary} GROUP BY base, suffix) s GROUP BY base", "O-DB38")
add("split_ranges", "SELECT dataset, base, min(split) AS low, max(split) AS high FROM (SELECT dataset, base, split, split - row_number() OVER (PARTITION BY dataset, base ORDER BY split) AS island FROM (SELECT DISTINCT dataset, base, split FROM {one_run}) d) g GROUP BY dataset, base, island", "O-DB39")
add("display_names", "SELECT run_id, CASE WHEN dataset = 'first' THEN 'First' ELSE 'Second' END || ' ' || letter || CASE WHEN suffix = '' THEN '' ELSE ' without f19' END AS label, CASE WHEN test_pr_auc >= 0.7e0 THEN 'strong' ELSE 'weak' END AS outcome FROM {runs_table}", "O-ST22")
