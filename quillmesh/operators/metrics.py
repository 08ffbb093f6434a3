"""Audits, ranking metrics, thresholds, group bootstraps and side-by-side comparison (template operators).

Scores are reduced to distinct (score, label counts) before any window, so a window holds one row for each distinct score.
"""

from __future__ import annotations

from quillmesh.operators.graph import add_ranks
from quillmesh.plans.dialect import LIBRARY

add = LIBRARY.add
#: Draws of a group bootstrap.
DRAWS = 1_000

# Scores of two models for labelled nodes, rounded so that ties occur; predictions in the long layout

add("scored", """
    SELECT node_id, label AS y, split, cv_fold, group_id, least(100, $H(21, node_id) % 71 + label * 25) / 100e0 AS pa,
        least(100, $H(22, node_id) % 61 + label * 35) / 100e0 AS pb FROM {split_nodes} WHERE label IS NOT NULL""", public=False)
add("test_scores", "SELECT node_id, y, group_id, pa, pb FROM {scored} WHERE split = 'test'", public=False)
add("predictions", """
    SELECT m.model, m.selection, m.settings, s.node_id, s.y, s.cv_fold AS fold, least(100, greatest(0, CAST(round(s.pa * 100) AS BIGINT) + $H(23, m.model, m.settings, s.node_id) % 41 - 20)) / 100e0 AS prob
    FROM {scored} s CROSS JOIN (SELECT 'gbt' AS model, 'none' AS selection, 'tuned' AS settings UNION ALL SELECT 'gbt', 'none', 'default' UNION ALL SELECT 'lr', 'filter', 'tuned' UNION ALL SELECT 'lr', 'filter', 'default'
        UNION ALL SELECT 'dummy', 'none', 'default') m WHERE s.split = 'train'""", public=False)

# Audit

add("labelled_values", "SELECT name, v, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS p FROM {own_long} WHERE split = 'train' AND v IS NOT NULL GROUP BY name, v", public=False)
add("value_ranges", """
    SELECT name, b, coalesce(sum(n) OVER (PARTITION BY name ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before, coalesce(sum(p) OVER (PARTITION BY name ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p_before,
        sum(n) OVER (PARTITION BY name) AS total, sum(p) OVER (PARTITION BY name) AS pos FROM (SELECT name, CAST(floor(sign(v) * ln(1e0 + abs(v)) * 256e0) AS BIGINT) AS b, sum(n) AS n, sum(p) AS p FROM {labelled_values} GROUP BY name, CAST(floor(sign(v) * ln(1e0 + abs(v)) * 256e0) AS BIGINT)) g""", public=False)
add("value_ranks", """
    SELECT r.name, r.v, r.n, r.p, r.n_upto - r.n - (r.p_upto - r.p) AS neg_below, r.pos - r.p_upto + r.p AS tp_from, (r.total - r.pos) - (r.n_upto - r.p_upto) + (r.n - r.p) AS fp_from, r.p_upto AS tp_upto, r.n_upto - r.p_upto AS fp_upto, r.total, r.pos
    FROM (SELECT l.name, l.v, l.n, l.p, g.n_before + sum(l.n) OVER (PARTITION BY l.name, g.b ORDER BY l.v) AS n_upto, g.p_before + sum(l.p) OVER (PARTITION BY l.name, g.b ORDER BY l.v) AS p_upto, g.total, g.pos
        FROM {labelled_values} l JOIN {value_ranges} g ON g.name = l.name AND g.b = CAST(floor(sign(l.v) * ln(1e0 + abs(l.v)) * 256e0) AS BIGINT)) r""", public=False)
add("value_auroc", "SELECT name, CASE WHEN count(*) > 1 THEN CAST(sum(p * (neg_below + 0.5e0 * (n - p))) AS DOUBLE) / nullif(max(pos) * (max(total) - max(pos)), 0) END AS auroc FROM {value_ranks} GROUP BY name", public=False,
    oracle="""WITH ranked AS (SELECT name, label, v, rank() OVER (PARTITION BY name ORDER BY v) + (count(*) OVER (PARTITION BY name, v) - 1) / 2e0 AS r FROM {own_long} WHERE split = 'train' AND v IS NOT NULL),
        sums AS (SELECT name, sum(r) FILTER (WHERE label = 1) AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q, count(DISTINCT v) AS k FROM ranked GROUP BY name)
        SELECT name, CASE WHEN k > 1 AND p > 0 AND q > 0 THEN (s - p * (p + 1) / 2e0) / (p * q) END AS auroc FROM sums""")
add("oriented_auroc", "SELECT name, round(greatest(auroc, 1e0 - auroc), 9) AS auroc, auroc < 0.5e0 AS flipped FROM {value_auroc}", "O-AU1")
add("feature_audit", """
    SELECT s.name, s.kind, s.n_unique, r.low, r.high, r.nulls, s.kind = 'constant' AS constant, round(greatest(a.auroc, 1e0 - a.auroc), 9) AS auroc, coalesce(greatest(a.auroc, 1e0 - a.auroc) >= 0.95e0, false) AS shortcut
    FROM {column_spec} s JOIN (SELECT name, min(v) AS low, max(v) AS high, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM {own_long} WHERE split = 'train' GROUP BY name) r ON r.name = s.name
    LEFT JOIN {value_auroc} a ON a.name = s.name""", "O-AU2 O-ST4")
_ALL = "own__f01, own__f02, own__f03, own__f04, own__f05"
add("split_rows", f"SELECT s.split, {_ALL} FROM {{own_block}} o JOIN {{split_nodes}} s ON s.node_id = o.node_id", public=False)
add("duplicate_counts", f"""
    SELECT 'within_' || split AS what, CAST(sum(n - 1) AS BIGINT) AS rows_found FROM (SELECT split, {_ALL}, count(*) AS n FROM {{split_rows}} WHERE split <> 'unlabelled' GROUP BY split, {_ALL}) g GROUP BY split
    UNION ALL SELECT 'test_in_train', CAST(count(*) AS BIGINT) FROM {{split_rows}} t WHERE t.split = 'test' AND EXISTS (SELECT 1 FROM {{split_rows}} r WHERE r.split = 'train' AND {" AND ".join(f"r.{c} = t.{c}" for c in _ALL.split(", "))})""", "O-AU3")
add("group_sizes", "SELECT split, group_id, count(*) AS size FROM {split_nodes} WHERE is_labelled GROUP BY split, group_id", public=False)
add("group_table", "SELECT split, CAST(size AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS groups, CAST(size * count(*) AS BIGINT) AS n_nodes FROM {group_sizes} GROUP BY split, size", "O-AU4",
    oracle="WITH sized AS (SELECT split, count(*) OVER (PARTITION BY split, group_id) AS size FROM {split_nodes} WHERE label IS NOT NULL) SELECT split, CAST(size AS BIGINT) AS size, CAST(count(*) // size AS BIGINT) AS groups, CAST(count(*) AS BIGINT) AS n_nodes FROM sized GROUP BY split, size")
add("group_purity", """
    SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS groups, round(sum(CASE WHEN 2 * p >= n THEN p ELSE n - p END) / nullif($DBL(sum(n)), 0), 9) AS purity
    FROM (SELECT group_id, count(*) AS n, sum(label) AS p FROM {split_nodes} WHERE split = 'train' GROUP BY group_id) g WHERE n > 1""", "O-AU5",
    oracle="""WITH train AS (SELECT label, group_id, avg(label) OVER (PARTITION BY group_id) AS share, count(*) OVER (PARTITION BY group_id) AS size FROM {split_nodes} WHERE split = 'train')
        SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT group_id) AS BIGINT) AS groups, round(avg(CASE WHEN (share >= 0.5) = (label = 1) THEN 1e0 ELSE 0e0 END), 9) AS purity FROM train WHERE size > 1""")
add("edge_labels", "SELECT e.relation, a.label AS ya, b.label AS yb, a.split AS sa, b.split AS sb FROM {edges_canonical} e JOIN {split_nodes} a ON a.node_id = e.src JOIN {split_nodes} b ON b.node_id = e.dst", public=False)
add("labelled_degrees", """
    SELECT r.relation, n.node_id, coalesce(d.degree, 0) AS degree FROM {split_nodes} n CROSS JOIN (SELECT DISTINCT relation FROM {edges_canonical}) r
    LEFT JOIN {degree_by_relation} d ON d.node_id = n.node_id AND d.relation = r.relation WHERE n.label IS NOT NULL""", public=False)
add("relation_homophily", """
    SELECT e.relation, e.edges, round(d.mean_degree, 9) AS mean_degree, round(d.isolated, 9) AS isolated, e.train_train, round(e.homophily, 9) AS homophily, round(e.positive_homophily, 9) AS positive_homophily
    FROM (SELECT relation, CAST(count(*) AS BIGINT) AS edges, CAST(sum(inside) AS BIGINT) AS train_train, sum(CASE WHEN inside = 1 AND ya = yb THEN 1 ELSE 0 END) / nullif($DBL(sum(inside)), 0) AS homophily,
            2e0 * sum(CASE WHEN inside = 1 AND ya + yb = 2 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN inside = 1 THEN ya + yb ELSE 0 END), 0) AS positive_homophily
        FROM (SELECT relation, ya, yb, CASE WHEN sa = 'train' AND sb = 'train' THEN 1 ELSE 0 END AS inside FROM {edge_labels}) l GROUP BY relation) e
    JOIN (SELECT relation, avg($DBL(degree)) AS mean_degree, avg(CASE WHEN degree = 0 THEN 1e0 ELSE 0e0 END) AS isolated FROM {labelled_degrees} GROUP BY relation) d ON d.relation = e.relation""", "O-AU6",
    oracle="""WITH inside AS (SELECT e.relation, a.label AS x, b.label AS y FROM {edges_canonical} e JOIN {split_nodes} a ON a.node_id = e.src AND a.split = 'train' JOIN {split_nodes} b ON b.node_id = e.dst AND b.split = 'train'),
        ends AS (SELECT relation, unnest([src, dst]) AS node_id FROM {edges_canonical}), sizes AS (SELECT relation, node_id, count(*) AS d FROM ends GROUP BY ALL),
        labelled AS (SELECT r.relation, coalesce(s.d, 0) AS d FROM {split_nodes} n CROSS JOIN (SELECT DISTINCT relation FROM {edges_canonical}) r LEFT JOIN sizes s ON s.node_id = n.node_id AND s.relation = r.relation WHERE n.is_labelled)
        SELECT r.relation, r.edges, (SELECT round(avg(d), 9) FROM labelled l WHERE l.relation = r.relation) AS mean_degree, (SELECT round(avg(CASE WHEN d = 0 THEN 1e0 ELSE 0e0 END), 9) FROM labelled l WHERE l.relation = r.relation) AS isolated,
            (SELECT count(*) FROM inside i WHERE i.relation = r.relation) AS train_train, (SELECT round(avg(CASE WHEN x = y THEN 1e0 ELSE 0e0 END), 9) FROM inside i WHERE i.relation = r.relation) AS homophily,
            (SELECT round(2e0 * count(*) FILTER (WHERE x = 1 AND y = 1) / nullif(sum(x) + sum(y), 0), 9) FROM inside i WHERE i.relation = r.relation) AS positive_homophily
        FROM (SELECT relation, count(*) AS edges FROM {edges_canonical} GROUP BY relation) r""")
add("oriented_ranks", """
    SELECT r.name, r.p, CASE WHEN coalesce(a.auroc, 0.5e0) >= 0.5e0 THEN 'high' ELSE 'low' END AS direction, coalesce(a.auroc, 0.5e0) AS auroc, CASE WHEN coalesce(a.auroc, 0.5e0) >= 0.5e0 THEN r.tp_from ELSE r.tp_upto END AS tp,
        CASE WHEN coalesce(a.auroc, 0.5e0) >= 0.5e0 THEN r.fp_from ELSE r.fp_upto END AS fp, r.total, r.pos FROM {value_ranks} r JOIN {value_auroc} a ON a.name = r.name""", public=False)
add("single_feature_check", """
    SELECT name, direction, round(greatest(max(auroc), 1e0 - max(auroc)), 9) AS auroc, round(sum(p / nullif($DBL(pos), 0) * (tp / $DBL(tp + fp))), 9) AS pr_auc,
        round(max((tp / nullif($DBL(pos), 0) + 1e0 - fp / nullif($DBL(total - pos), 0)) / 2e0), 9) AS best_balanced, CAST(count(*) AS BIGINT) AS n_unique, CAST(max(total) AS BIGINT) AS n_train
    FROM {oriented_ranks} GROUP BY name, direction""", "O-AU9",
    oracle="""WITH signs AS (SELECT name, coalesce(auroc, 0.5e0) AS auroc, CASE WHEN coalesce(auroc, 0.5e0) >= 0.5e0 THEN 1 ELSE -1 END AS sign FROM {value_auroc}),
        scores AS (SELECT l.name, s.auroc, s.sign, s.sign * l.v AS score, l.label FROM {own_long} l JOIN signs s ON s.name = l.name WHERE l.split = 'train' AND l.v IS NOT NULL),
        steps AS (SELECT name, auroc, sign, score, sum(label) AS p, count(*) AS n FROM scores GROUP BY ALL),
        cuts AS (SELECT name, auroc, sign, p, sum(p) OVER w AS tp, sum(n) OVER w AS taken, sum(p) OVER (PARTITION BY name) AS pos, sum(n) OVER (PARTITION BY name) AS total FROM steps WINDOW w AS (PARTITION BY name ORDER BY score DESC))
        SELECT name, CASE sign WHEN 1 THEN 'high' ELSE 'low' END AS direction, round(greatest(auroc, 1 - auroc), 9) AS auroc, round(sum(p / CAST(pos AS DOUBLE) * tp / taken), 9) AS pr_auc,
            round(max((tp / CAST(pos AS DOUBLE) + 1 - (taken - tp) / CAST(total - pos AS DOUBLE)) / 2), 9) AS best_balanced, CAST(count(*) AS BIGINT) AS n_unique, CAST(max(total) AS BIGINT) AS n_train FROM cuts GROUP BY name, sign, auroc""")
add("vote_ratios", """
    SELECT l.name, l.label, l.v + o.own__f01 AS total, l.v / nullif(l.v + o.own__f01, 0) AS ratio FROM {own_long} l JOIN {own_block} o ON o.node_id = l.node_id
    JOIN (SELECT name FROM {own_long} WHERE split = 'train' GROUP BY name HAVING min(v) >= 0) k ON k.name = l.name WHERE l.split = 'train' AND l.name <> 'own__f01'""", public=False)
add("ratio_steps", """
    SELECT name, n, q, coalesce(sum(n - q) OVER (PARTITION BY name ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fraud_below, sum(n) OVER (PARTITION BY name) AS total, sum(q) OVER (PARTITION BY name) AS benign
    FROM (SELECT name, round(ratio, 9) AS ratio, count(*) AS n, sum(1 - label) AS q FROM {vote_ratios} WHERE ratio IS NOT NULL GROUP BY name, round(ratio, 9)) g""", public=False)
add("vote_ratio_check", """
    SELECT r.name, round(a.auroc, 9) AS ratio_auroc_benign, round(r.fraud_below, 9) AS fraud_below_low, round(r.benign_above, 9) AS benign_above_high, round(r.no_votes, 9) AS share_with_no_votes, r.min_total, r.n_train
    FROM (SELECT name, sum(CASE WHEN label = 1 AND ratio < 0.2e0 THEN 1 ELSE 0 END) / nullif($DBL(sum(label)), 0) AS fraud_below, sum(CASE WHEN label = 0 AND ratio > 0.8e0 THEN 1 ELSE 0 END) / nullif($DBL(sum(1 - label)), 0) AS benign_above, min(total) AS min_total, avg(CASE WHEN total = 0 THEN 1e0 ELSE 0e0 END) AS no_votes, CAST(count(*) AS BIGINT) AS n_train FROM {vote_ratios} GROUP BY name) r
    LEFT JOIN (SELECT name, sum(q * (fraud_below + 0.5e0 * (n - q))) / nullif($DBL(max(benign) * (max(total) - max(benign))), 0) AS auroc FROM {ratio_steps} GROUP BY name) a ON a.name = r.name""", "O-AU10",
    oracle="""WITH ranked AS (SELECT name, 1 - label AS y, rank() OVER (PARTITION BY name ORDER BY round(ratio, 9)) + (count(*) OVER (PARTITION BY name, round(ratio, 9)) - 1) / 2e0 AS r FROM {vote_ratios} WHERE ratio IS NOT NULL),
        a AS (SELECT name, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auroc FROM ranked GROUP BY name)
        SELECT v.name, round(any_value(a.auroc), 9) AS ratio_auroc_benign, round(coalesce(avg(CASE WHEN v.ratio < 0.2e0 THEN 1e0 ELSE 0e0 END) FILTER (WHERE v.label = 1), NULL), 9) AS fraud_below_low, round(avg(CASE WHEN v.ratio > 0.8e0 THEN 1e0 ELSE 0e0 END) FILTER (WHERE v.label = 0), 9) AS benign_above_high, round(count(*) FILTER (WHERE v.total = 0) / $DBL(count(*)), 9) AS share_with_no_votes, min(v.total) AS min_total, count(*) AS n_train
        FROM {vote_ratios} v LEFT JOIN a ON a.name = v.name GROUP BY v.name""")
add("identity_checks", """
    SELECT round(avg(CASE WHEN own__f04 <= own__f01 THEN 1e0 ELSE 0e0 END), 9) AS distinct_at_most_all, round(avg(CASE WHEN abs(own__f03 * own__f01 - round(own__f03 * own__f01)) <= 1e-9 THEN 1e0 ELSE 0e0 END), 9) AS share_times_count_whole,
        round(avg(CASE WHEN own__f02 >= own__f01 THEN 1e0 ELSE 0e0 END), 9) AS cents_at_least_orders,
        round(avg(CASE WHEN own__f03 > 0 AND own__f03 < 1 THEN -own__f03 * ln(own__f03) - (1e0 - own__f03) * ln(1e0 - own__f03) ELSE 0e0 END), 6) AS entropy
    FROM {own_block} o JOIN {ids_table} i ON i.node_id = o.node_id""", "O-AU11 O-ST20")
add("feature_set_rows", "SELECT substr(name, 1, 3) AS block, CAST(count(*) AS BIGINT) AS given, CAST(sum(CASE WHEN kind <> 'constant' THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM {column_spec} GROUP BY substr(name, 1, 3)", "O-AU13")
add("exported", "SELECT node_id, own__f01 AS ours, least(1.5e0, greatest(-1.5e0, (own__f01 - 10e0) / 4e0)) AS theirs FROM {own_block}", public=False)
add("monotone_affine", """
    SELECT bool_and(coalesce(theirs >= before, true)) AS monotone, round(max(CASE WHEN theirs > -1.5e0 AND theirs < 1.5e0 THEN abs(theirs - (slope * ours + base)) ELSE 0e0 END), 6) AS residual, round(max(slope), 6) AS slope
    FROM (SELECT ours, theirs, lag(theirs) OVER (ORDER BY ours, theirs) AS before FROM (SELECT DISTINCT ours, theirs FROM {exported}) d) e
    CROSS JOIN (SELECT regr_slope(theirs, ours) AS slope, regr_intercept(theirs, ours) AS base FROM {exported} WHERE theirs > -1.5e0 AND theirs < 1.5e0) r""", "O-AU14 O-ST9")
add("inferred_types", """
    SELECT coalesce(a.name, b.name) AS name, a.kind AS ours, b.kind AS theirs, CASE WHEN a.name IS NULL THEN 'extra' WHEN b.name IS NULL THEN 'dropped' WHEN a.kind = b.kind THEN 'same' ELSE 'differs' END AS verdict
    FROM {column_spec} a FULL OUTER JOIN (SELECT CASE WHEN name = 'own__f06' THEN 'own__f99' ELSE name END AS name, CASE WHEN kind = 'ordinal' THEN 'continuous' ELSE kind END AS kind FROM {column_spec}) b ON b.name = a.name""", "O-AU15")
add("log_lines", """
    SELECT event_id AS line, CASE WHEN event_id % 40 = 5 THEN 'Tuning ' || event_type || ' with selection s' || CAST(event_id % 3 AS VARCHAR(4)) WHEN event_id % 40 > 30 AND event_id % 80 > 40 THEN 'noise' WHEN event_id % 7 = 3 THEN CAST($H(47, event_id) % 101 AS VARCHAR(10)) || '/100 trials in ' || CAST($H(48, event_id) % 601 AS VARCHAR(10)) || ' of 600 s' ELSE 'noise' END AS text
    FROM {events}""", public=False)
add("log_ranges", "SELECT b, max(last) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM (SELECT CAST(floor(line / 1024e0) AS BIGINT) AS b, max(CASE WHEN text LIKE 'Tuning %' THEN line END) AS last FROM {log_lines} GROUP BY CAST(floor(line / 1024e0) AS BIGINT)) r", public=False)
add("log_sections", """
    SELECT l.line, l.text, coalesce(max(CASE WHEN l.text LIKE 'Tuning %' THEN l.line END) OVER (PARTITION BY r.b ORDER BY l.line), r.earlier) AS section FROM {log_lines} l JOIN {log_ranges} r ON r.b = CAST(floor(l.line / 1024e0) AS BIGINT)""", public=False)
add("log_progress", """
    SELECT section, done, asked, elapsed, time_limit FROM (SELECT section, done, asked, elapsed, time_limit, row_number() OVER (PARTITION BY section ORDER BY done DESC, line DESC) AS rn FROM (
        SELECT section, line, CAST(split_part(split_part(text, ' ', 1), '/', 1) AS BIGINT) AS done, CAST(split_part(split_part(text, ' ', 1), '/', 2) AS BIGINT) AS asked, CAST(split_part(text, ' ', 4) AS BIGINT) AS elapsed, CAST(split_part(text, ' ', 6) AS BIGINT) AS time_limit FROM {log_sections} WHERE section IS NOT NULL AND text LIKE '%/% trials in % of % s') p) q WHERE rn = 1""", public=False)
add("tuning_budget_log", """
    SELECT h.line AS section, split_part(h.text, ' ', 2) AS model, split_part(h.text, ' ', 5) AS selection, p.done AS trials_completed, p.asked AS trials_requested, p.elapsed AS elapsed_s, p.time_limit AS time_limit_s,
        CASE WHEN p.section IS NULL THEN 'unknown' WHEN p.done >= p.asked THEN 'all trials' WHEN p.elapsed >= 0.98e0 * p.time_limit THEN 'time limit' ELSE 'early stop' END AS stopped_by
    FROM (SELECT line, text FROM {log_lines} WHERE text LIKE 'Tuning %') h LEFT JOIN {log_progress} p ON p.section = h.line""", "O-AU16",
    oracle="""WITH heads AS (SELECT line, text, lead(line) OVER (ORDER BY line) AS upto FROM {log_lines} WHERE starts_with(text, 'Tuning ')),
        seen AS (SELECT h.line AS section, list(struct_pack(done := CAST(regexp_extract(l.text, '^(\\d+)/', 1) AS BIGINT), line := l.line, asked := CAST(regexp_extract(l.text, '/(\\d+) ', 1) AS BIGINT), elapsed := CAST(regexp_extract(l.text, 'in (\\d+) of', 1) AS BIGINT), budget := CAST(regexp_extract(l.text, 'of (\\d+) s', 1) AS BIGINT))) AS every
            FROM heads h JOIN {log_lines} l ON l.line > h.line AND (h.upto IS NULL OR l.line < h.upto) AND regexp_matches(l.text, '^\\d+/\\d+ trials') GROUP BY h.line), last AS (SELECT section, list_last(list_sort(every)) AS p FROM seen)
        SELECT h.line AS section, regexp_extract(h.text, 'Tuning (\\S+)', 1) AS model, regexp_extract(h.text, 'selection (\\S+)', 1) AS selection, p.done AS trials_completed, p.asked AS trials_requested, p.elapsed AS elapsed_s, p.budget AS time_limit_s,
            CASE WHEN p IS NULL THEN 'unknown' WHEN p.done >= p.asked THEN 'all trials' WHEN p.elapsed >= 0.98e0 * p.budget THEN 'time limit' ELSE 'early stop' END AS stopped_by FROM heads h LEFT JOIN last ON last.section = h.line""".replace("\\\\", "\\"))
# Ranking metrics

_CURVE = "sum(p) OVER (PARTITION BY {k} ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY {k} ORDER BY s DESC) AS taken, sum(p) OVER (PARTITION BY {k}) AS pos, sum(n) OVER (PARTITION BY {k}) AS total"
add("curve", "SELECT model, settings, fold, s, n, p, " + _CURVE.replace("{k}", "model, settings, fold") + " FROM (SELECT model, settings, fold, prob AS s, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS p FROM {predictions} GROUP BY model, settings, fold, prob) g", public=False)
add("average_precision", "SELECT model, settings, fold, round(sum(p / nullif($DBL(pos), 0) * (tp / $DBL(taken))), 9) AS ap FROM {curve} GROUP BY model, settings, fold", "O-EV1 O-ST18")
add("auroc", "SELECT model, settings, fold, round(sum(p * ((total - pos) - (taken - tp) + 0.5e0 * (n - p))) / nullif($DBL(max(pos) * (max(total) - max(pos))), 0), 9) AS auroc FROM {curve} GROUP BY model, settings, fold", "O-EV2")
_CONFUSION = "CAST(sum(CASE WHEN y = 1 AND {s} >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN y = 0 AND {s} >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN y = 1 AND {s} < {t} THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN y = 0 AND {s} < {t} THEN 1 ELSE 0 END) AS BIGINT) AS tn"


def _confusion(s: str, t: str) -> str:
    return _CONFUSION.replace("{s}", s).replace("{t}", t)


_FROM = """round(coalesce(tp / nullif($DBL(tp + fp), 0), 0e0), 9) AS prec, round(coalesce(tp / nullif($DBL(tp + fn), 0), 0e0), 9) AS recall, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0), 9) AS f1,
    round((tp + tn) / $DBL(tp + fp + fn + tn), 9) AS accuracy, round((coalesce(tp / nullif($DBL(tp + fn), 0), 0e0) + coalesce(tn / nullif($DBL(tn + fp), 0), 0e0)) / 2e0, 9) AS balanced"""
add("binary_metrics", f"SELECT model, settings, tp, fp, fn, tn, {_FROM} FROM (SELECT model, settings, {_confusion('prob', '0.5e0')} FROM {{predictions}} GROUP BY model, settings) c", "O-EV2 O-ML10")


def _f1(name: str, score: str) -> None:
    """Counts of distinct training scores, of ranges of scores, and the running counts from the top: only ranges meet in one window."""
    add(f"f1_steps{name}", f"SELECT {score} AS s, CAST(floor({score} * 4096e0) AS BIGINT) AS b, count(*) AS n, sum(y) AS p FROM {{scored}} WHERE split = 'train' GROUP BY {score}", public=False)
    add(f"f1_ranges{name}", f"""
        SELECT b, coalesce(sum(n) OVER (ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_above, coalesce(sum(p) OVER (ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p_above, sum(p) OVER () AS pos
        FROM (SELECT b, sum(n) AS n, sum(p) AS p FROM {{f1_steps{name}}} GROUP BY b) r""", public=False)
    add(f"f1_curve{name}", f"SELECT x.s, x.n, x.p, r.p_above + sum(x.p) OVER (PARTITION BY x.b ORDER BY x.s DESC) AS tp, r.n_above + sum(x.n) OVER (PARTITION BY x.b ORDER BY x.s DESC) AS taken, r.pos FROM {{f1_steps{name}}} x JOIN {{f1_ranges{name}}} r ON r.b = x.b", public=False)


_f1("", "pa")
add("f1_threshold", "SELECT s AS threshold, round(2e0 * tp / (taken + pos), 9) AS f1 FROM {f1_curve} ORDER BY 2e0 * tp / (taken + pos) DESC, s DESC LIMIT 1", "O-EV4")
_f1("_b", "pb")
add("f1_threshold_b", "SELECT s AS threshold, round(2e0 * tp / (taken + pos), 9) AS f1 FROM {f1_curve_b} ORDER BY 2e0 * tp / (taken + pos) DESC, s DESC LIMIT 1", public=False)
add("test_metrics", f"""
    SELECT cut, tp, fp, fn, tn, {_FROM} FROM (SELECT 'chosen' AS cut, {_confusion('t.pa', 'h.threshold')} FROM {{test_scores}} t CROSS JOIN {{f1_threshold}} h UNION ALL SELECT 'half', {_confusion('pa', '0.5e0')} FROM {{test_scores}}) c""", "O-EV3 O-EV9")
add("test_groups", "SELECT group_id, CAST(count(*) AS BIGINT) AS rows_in FROM {test_scores} GROUP BY group_id", public=False)
add_ranks("group_order", "test_groups", "group_id", "CAST(floor(group_id / 1024e0) AS BIGINT)", "group_id")
add("draws", f"""
    SELECT d.b, k.group_id, CAST(count(*) AS BIGINT) AS times FROM (SELECT r.b, i.place, i.total FROM {{group_order}} i CROSS JOIN $SERIES({DRAWS}) r) d
    JOIN {{group_order}} k ON k.place = $H(61, d.b, d.place) % d.total GROUP BY d.b, k.group_id""", public=False)


def _drawn(score: str) -> str:
    return f"SELECT b, s, n, p, {_CURVE.replace('{k}', 'b')} FROM (SELECT d.b, t.s, CAST(sum(d.times * t.n) AS BIGINT) AS n, CAST(sum(d.times * t.p) AS BIGINT) AS p FROM {{draws}} d JOIN (SELECT group_id, {score} AS s, count(*) AS n, sum(y) AS p FROM {{test_scores}} GROUP BY group_id, {score}) t ON t.group_id = d.group_id GROUP BY d.b, t.s) g"


for _score in ("pa", "pb"):
    add(f"drawn_{_score}", _drawn(_score), public=False)
    add(f"draw_ap_{_score}", f"SELECT b, sum(p / $DBL(pos) * (tp / $DBL(taken))) AS ap FROM {{drawn_{_score}}} WHERE pos > 0 AND pos < total GROUP BY b", public=False)
add("group_bootstrap", "SELECT CAST(count(*) AS BIGINT) AS kept, round($Q(ap, 0.025), 7) AS low, round($Q(ap, 0.975), 7) AS high, round(avg(ap), 7) AS mean FROM {draw_ap_pa}", "O-EV5 O-EV8")
add("paired_bootstrap", "SELECT CAST(count(*) AS BIGINT) AS kept, round($Q(b.ap - a.ap, 0.025), 7) AS low, round($Q(b.ap - a.ap, 0.975), 7) AS high, round(avg(CASE WHEN b.ap > a.ap THEN 1e0 ELSE 0e0 END), 7) AS better FROM {draw_ap_pa} a JOIN {draw_ap_pb} b ON b.b = a.b", "O-EV5 O-EV8")
for _score in ("pa", "pb"):
    add(f"draw_auroc_{_score}", f"SELECT b, sum(p * ((total - pos) - (taken - tp) + 0.5e0 * (n - p))) / ($DBL(max(pos)) * (max(total) - max(pos))) AS auroc FROM {{drawn_{_score}}} WHERE pos > 0 AND pos < total GROUP BY b", public=False)
add("auroc_bootstrap", "SELECT CAST(count(*) AS BIGINT) AS kept, round($Q(auroc, 0.025), 7) AS low, round($Q(auroc, 0.975), 7) AS high, round(avg(auroc), 7) AS mean FROM {draw_auroc_pa}", "O-EV8",
    oracle="""WITH one AS (SELECT d.b, sum(d.times * t.p) AS pos, sum(d.times * (t.n - t.p)) AS neg, list(struct_pack(s := t.s, p := d.times * t.p, q := d.times * (t.n - t.p))) AS every FROM {draws} d JOIN (SELECT group_id, pa AS s, count(*) AS n, sum(y) AS p FROM {test_scores} GROUP BY group_id, pa) t ON t.group_id = d.group_id GROUP BY d.b),
        flat AS (SELECT b, pos, neg, unnest(every) AS e FROM one WHERE pos > 0 AND neg > 0), sums AS (SELECT b, any_value(pos) AS pos, any_value(neg) AS neg, e.s AS s, sum(e.p) AS p, sum(e.q) AS q FROM flat GROUP BY b, e.s),
        a AS (SELECT b, sum(p * (below + q / 2)) / any_value($DBL(pos) * neg) AS auroc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sums) GROUP BY b)
        SELECT CAST(count(*) AS BIGINT) AS kept, round($Q(auroc, 0.025), 7) AS low, round($Q(auroc, 0.975), 7) AS high, round(avg(auroc), 7) AS mean FROM a""")
add("paired_auroc_bootstrap", "SELECT CAST(count(*) AS BIGINT) AS kept, round($Q(b.auroc - a.auroc, 0.025), 7) AS low, round($Q(b.auroc - a.auroc, 0.975), 7) AS high, round(avg(CASE WHEN b.auroc > a.auroc THEN 1e0 ELSE 0e0 END), 7) AS better FROM {draw_auroc_pa} a JOIN {draw_auroc_pb} b ON b.b = a.b", "O-EV8")
# All that a comparison shows of one side: intervals of both metrics, recall among as many as there are positives, counts at its threshold.
add("side_metrics", f"""
    SELECT a.low AS pr_auc_low, a.high AS pr_auc_high, u.low AS auroc_low, u.high AS auroc_high, r.k, r.recall AS recall_at_k, h.threshold, c.tp, c.fp, c.fn, c.tn, c.tp + c.fp AS n_flagged, {_FROM.replace("recall,", "recall_at_threshold,").replace("AS recall_at_threshold", "AS recall")}
    FROM {{group_bootstrap}} a CROSS JOIN {{auroc_bootstrap}} u CROSS JOIN {{recall_at_k}} r CROSS JOIN {{f1_threshold}} h CROSS JOIN (SELECT {_confusion('t.pa', 'h.threshold')} FROM {{test_scores}} t CROSS JOIN {{f1_threshold}} h) c""", "O-EV8")
add("sanity_band", "SELECT model, settings, fold, ap, CASE WHEN ap < 0.35e0 - 0.05e0 THEN 'below the band' ELSE 'ok' END AS verdict FROM {average_precision}", "O-EV6 O-ST8")
add_ranks("score_places", "test_scores", "node_id, y", "CAST(floor(-pa * 4096e0) AS BIGINT)", "pa DESC, node_id")
add("recall_at_k", """
    SELECT CAST(max(k.k) AS BIGINT) AS k, round(sum(CASE WHEN s.place < k.k THEN s.y ELSE 0 END) / nullif($DBL(max(k.k)), 0), 9) AS recall FROM {score_places} s CROSS JOIN (SELECT sum(y) AS k FROM {test_scores}) k""", "O-EV7",
    oracle="SELECT CAST(max(k) AS BIGINT) AS k, round(sum(CASE WHEN rn <= k THEN y ELSE 0 END) / nullif($DBL(max(k)), 0), 9) AS recall FROM (SELECT y, row_number() OVER (ORDER BY pa DESC, node_id) AS rn, sum(y) OVER () AS k FROM {test_scores}) s")
add("fold_scores", "SELECT p.model, p.settings, p.fold, round(avg((p.y - p.prob) * (p.y - p.prob)), 9) AS brier, round((avg(CASE WHEN p.y = 1 THEN CASE WHEN p.prob >= 0.5e0 THEN 1e0 ELSE 0e0 END END) + avg(CASE WHEN p.y = 0 THEN CASE WHEN p.prob >= 0.5e0 THEN 0e0 ELSE 1e0 END END)) / 2e0, 9) AS balanced, max(a.ap) AS ap, max(u.auroc) AS auroc FROM {predictions} p JOIN {average_precision} a ON a.model = p.model AND a.settings = p.settings AND a.fold = p.fold JOIN {auroc} u ON u.model = p.model AND u.settings = p.settings AND u.fold = p.fold GROUP BY p.model, p.settings, p.fold", "O-EV10")
add("nested_scores", "SELECT s.node_id, f.fold AS outer_fold, round(s.pa + f.fold / 100e0, 4) AS score FROM {scored} s CROSS JOIN (SELECT DISTINCT fold FROM {folds_table}) f WHERE s.split = 'train' AND s.cv_fold <> f.fold", public=False)
add("nested_coverage", "SELECT f.fold AS outer_fold, CAST(count(s.node_id) AS BIGINT) AS covered, CAST(sum(CASE WHEN s.node_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM (SELECT x.fold, i.node_id FROM {folds_table} i CROSS JOIN (SELECT DISTINCT fold FROM {folds_table}) x WHERE i.fold <> x.fold) f LEFT JOIN {nested_scores} s ON s.node_id = f.node_id AND s.outer_fold = f.fold GROUP BY f.fold", "O-EV11 O-IO13")
add("nested_overlay", "SELECT s.node_id, x.fold AS outer_fold, coalesce(n.score, s.pa) AS score FROM {scored} s CROSS JOIN (SELECT DISTINCT fold FROM {folds_table}) x LEFT JOIN {nested_scores} n ON n.node_id = s.node_id AND n.outer_fold = x.fold WHERE s.split = 'train'", "O-EV11 O-FT10")
add("logit_block", "SELECT node_id, round(ln(greatest(1e-6, least(1e0 - 1e-6, pa)) / (1e0 - greatest(1e-6, least(1e0 - 1e-6, pa)))), 6) AS gnnsup__score, round(1e0 / (1e0 + exp(-pa)), 9) AS sig FROM {scored}", "O-FT10 O-FT11")
add("config_cv", "SELECT model, CASE WHEN model = 'lr' THEN 'filter' ELSE 'none' END AS selection, settings, avg(ap) AS cv_mean, stddev_samp(ap) AS cv_sd, CAST(count(*) AS BIGINT) AS folds FROM {average_precision} GROUP BY model, settings", public=False)
add("metrics_table", """
    SELECT CAST(row_number() OVER (ORDER BY t.cv_mean DESC, t.cv_sd, t.model, t.selection) AS BIGINT) AS place, t.model, t.selection, round(t.cv_mean, 9) AS cv_mean, round(t.cv_sd, 9) AS cv_sd, round(t.cv_mean - d.cv_mean, 9) AS tuning_gain
    FROM {config_cv} t LEFT JOIN {config_cv} d ON d.model = t.model AND d.settings = 'default' WHERE t.settings = 'tuned'""", "O-EV12 O-ML12")
add("best_default_row", "SELECT model, selection, round(cv_mean, 9) AS cv_mean FROM {config_cv} WHERE settings = 'default' AND model <> 'dummy' ORDER BY cv_mean DESC, model LIMIT 1", "O-EV13 O-ST17")
add("configuration_oof", "SELECT p.node_id, p.fold, p.prob FROM {predictions} p JOIN {best_default_row} b ON b.model = p.model AND coalesce(b.selection, '') = coalesce(p.selection, '') WHERE p.settings = 'default'", "O-EV13 O-IO12 O-EV26")
add("deltas", "SELECT CAST(o_custkey % 12 AS BIGINT) AS contrast, CAST(o_orderkey % 5 AS BIGINT) AS split, round((avg(o_totalprice) - 150000e0) / 1e6, 6) AS delta FROM {orders} WHERE o_custkey % 12 <> 7 OR o_orderkey % 5 < 1 GROUP BY o_custkey % 12, o_orderkey % 5", public=False)
add("contrast_stats", """
    SELECT contrast, n, mean, coalesce(sd, 0e0) AS sd, least, CASE WHEN n < 2 THEN NULL WHEN sd > 0 THEN mean / sqrt((1e0 / n + 0.25e0) * sd * sd) WHEN mean = 0 THEN 0e0 ELSE CAST('Infinity' AS DOUBLE) END AS t
    FROM (SELECT contrast, CAST(count(*) AS BIGINT) AS n, avg(delta) AS mean, stddev_samp(delta) AS sd, min(delta) AS least FROM {deltas} GROUP BY contrast) d""", public=False)
add("corrected_t", "SELECT contrast, n, round(mean, 9) AS mean, round(t, 6) AS t, n - 1 AS df FROM {contrast_stats}", "O-EV14 O-EV22")
add("p_values", "SELECT contrast, n, mean, sd, least, round(CASE WHEN sd > 0 THEN $P(t, (n - 1)) WHEN mean = 0 THEN 1e0 ELSE 0e0 END, 9) AS p FROM {contrast_stats} WHERE n > 1", public=False)
add("corrected_p", "SELECT contrast, p FROM {p_values}", "O-EV14")
add("verdicts", """
    SELECT s.contrast, p.p, CASE WHEN s.least > 0 AND s.mean > s.sd AND coalesce(p.p < 0.05e0, false) THEN 'supported' WHEN s.mean > 0 THEN 'not distinguishable' ELSE 'worse' END AS verdict
    FROM {contrast_stats} s LEFT JOIN {p_values} p ON p.contrast = s.contrast""", "O-EV15 O-EV23")
add("repeat_summary", "SELECT metric, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd FROM (SELECT fold, 'ap' AS metric, ap AS v FROM {fold_scores} WHERE model = 'gbt' AND settings = 'tuned' UNION ALL SELECT fold, 'auroc', auroc FROM {fold_scores} WHERE model = 'gbt' AND settings = 'tuned' UNION ALL SELECT fold, 'brier', brier FROM {fold_scores} WHERE model = 'gbt' AND settings = 'tuned') m GROUP BY metric", "O-EV16")
add("candidate_gains", "SELECT b.model || '/' || b.settings AS pick, avg(b.ap - a.ap) AS gain, stddev_samp(b.ap - a.ap) / sqrt($DBL(count(*))) AS se FROM {average_precision} a JOIN {average_precision} b ON b.fold = a.fold WHERE a.model = 'dummy' AND b.model <> 'dummy' GROUP BY b.model, b.settings", public=False)
add("best_gnn", """
    SELECT pick, round(gain, 9) AS gain FROM (SELECT pick, gain FROM {candidate_gains} WHERE gain > se AND gain > 0 UNION ALL SELECT 'dummy/default', 0e0 FROM (SELECT count(*) AS n FROM {candidate_gains}) c) g ORDER BY gain DESC, pick LIMIT 1""", "O-EV17 O-ML9")
add("choose_k", "SELECT min(k) AS k FROM (SELECT CASE model WHEN 'dummy' THEN 1 WHEN 'lr' THEN 8 ELSE 16 END AS k, cv_mean, max(cv_mean) OVER () AS top, max_by(cv_sd / sqrt($DBL(folds)), cv_mean) OVER () AS se FROM {config_cv} WHERE settings = 'default') c WHERE cv_mean >= top - se", "O-EV18")
add("best_rows", "SELECT settings, model, round(cv_mean, 9) AS cv_mean FROM (SELECT settings, model, cv_mean, row_number() OVER (PARTITION BY settings ORDER BY cv_mean DESC, model) AS rn FROM {config_cv}) r WHERE rn = 1", "O-EV21")
add("confidence_table", "SELECT node_id, y, CASE WHEN pa >= 0.5e0 THEN 1 ELSE 0 END AS predicted, round(CASE WHEN pa >= 0.5e0 THEN pa ELSE 1e0 - pa END, 4) AS confidence FROM {test_scores}", public=False)
add("most_and_least_confident", "SELECT * FROM (SELECT 'most' AS which, node_id, y, predicted, confidence FROM {confidence_table} ORDER BY confidence DESC, node_id LIMIT 10) a UNION ALL SELECT * FROM (SELECT 'least' AS which, node_id, y, predicted, confidence FROM {confidence_table} ORDER BY confidence, node_id LIMIT 10) b", "O-EV24")
add("percentiles", "SELECT node_id, name, v, split, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY v) / nullif($DBL(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) OVER (PARTITION BY name)), 0) AS pct FROM {own_long} WHERE split <> 'unlabelled'", public=False)
add("top_features_ecdf", "SELECT node_id, $JOIN(name, rn) AS names, round(max(pct), 9) AS top FROM (SELECT node_id, name, pct, row_number() OVER (PARTITION BY node_id ORDER BY pct DESC, name) AS rn FROM {percentiles} WHERE split = 'test') r WHERE rn <= 3 GROUP BY node_id", "O-EV25 O-ST9")

# Comparison of two sides

add("other_side", "SELECT node_id, label AS y FROM {split_nodes} WHERE split = 'test'", public=False)
add("same_test_nodes", """
    SELECT CAST(sum(CASE WHEN a.node_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_second, CAST(sum(CASE WHEN b.node_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_first, CAST(sum(CASE WHEN a.y <> b.y THEN 1 ELSE 0 END) AS BIGINT) AS other_label
    FROM {test_scores} a FULL OUTER JOIN {other_side} b ON b.node_id = a.node_id""", "O-CP2")
add("node_outcomes", """
    SELECT node_id, y, pa, pb, CASE WHEN fa = fb AND fa = y THEN 'both right' WHEN fa = fb THEN 'both wrong' WHEN fb = y THEN 'rescued' ELSE 'broken' END || CASE WHEN y = 1 THEN ' fraud' ELSE ' benign' END AS outcome, round(abs(pa - pb), 4) AS gap
    FROM (SELECT t.node_id, t.y, t.pa, t.pb, CASE WHEN t.pa >= a.threshold THEN 1 ELSE 0 END AS fa, CASE WHEN t.pb >= b.threshold THEN 1 ELSE 0 END AS fb FROM {test_scores} t CROSS JOIN {f1_threshold} a CROSS JOIN {f1_threshold_b} b) s""", "O-CP3 O-CP1")
add("outcome_counts", """
    SELECT a.kind || b.who AS outcome, CAST(count(n.node_id) AS BIGINT) AS n FROM (SELECT 'both right' AS kind UNION ALL SELECT 'both wrong' UNION ALL SELECT 'rescued' UNION ALL SELECT 'broken') a
    CROSS JOIN (SELECT ' fraud' AS who UNION ALL SELECT ' benign') b LEFT JOIN {node_outcomes} n ON n.outcome = a.kind || b.who GROUP BY a.kind, b.who""", "O-CP4 O-CP7")
add("gallery_topk", "SELECT outcome, node_id, gap FROM (SELECT outcome, node_id, gap, row_number() OVER (PARTITION BY outcome ORDER BY gap DESC, node_id) AS rn FROM {node_outcomes}) r WHERE rn <= 5", "O-CP5 O-CP8")
add("blocks_used", "SELECT split_part(name, '__', 1) AS block, CAST(count(DISTINCT name) AS BIGINT) AS columns_used FROM {own_long} GROUP BY split_part(name, '__', 1)", "O-CP6")
