"""Explanation aggregates: attributions, neighbour influence, attention read-outs, cards (template operators).

Attributions are those of a linear model over standardised own features, whose exact Shapley values are weight times z.
"""

from __future__ import annotations

import quillmesh.operators.metrics  # noqa: F401  defines the inputs
from quillmesh.plans.dialect import LIBRARY

add = LIBRARY.add

add("weights", "SELECT name, CAST($H(71, name) % 21 - 10 AS BIGINT) / 10e0 AS w FROM {column_spec}", public=False)
add("attributions", "SELECT z.node_id, z.name, round(z.z * w.w, 6) AS phi, s.group_id, s.y, s.pa FROM {standardise} z JOIN {weights} w ON w.name = z.name JOIN {test_scores} s ON s.node_id = z.node_id", public=False)
add("column_names", "SELECT 'own__f0' || CAST(r_regionkey AS VARCHAR(4)) AS name FROM {region} UNION ALL SELECT 'nbr__cpm_mean_f0' || CAST(r_regionkey AS VARCHAR(4)) FROM {region} UNION ALL SELECT 'deg__' || substr(lower(r_name), 1, 3) || '_log1p_degree' FROM {region} UNION ALL SELECT 'nbr_no19__cns_log1p_degree' FROM {region} WHERE r_regionkey = 0", public=False)
add("parse_columns", """
    SELECT name, split_part(split_part(name, '__', 1), '_', 1) AS kind, CASE WHEN split_part(name, '__', 1) LIKE '%\\_%' ESCAPE '\\' THEN split_part(split_part(name, '__', 1), '_', 2) END AS variant, CASE WHEN name LIKE 'own%' THEN NULL ELSE split_part(split_part(name, '__', 2), '_', 1) END AS relation,
        CASE WHEN name LIKE '%mean%' THEN 'mean' WHEN name LIKE '%degree' THEN 'degree' ELSE 'own' END AS stat, CASE WHEN name LIKE '%f0_' THEN substr(name, length(name) - 2, 3) END AS feature FROM {column_names}""".replace("LIKE '%\\_%' ESCAPE '\\'", "LIKE '%no19'"), "O-EX1")
add("summed_by_group", "SELECT node_id, player, round(sum(phi), 6) AS total FROM (SELECT node_id, phi, CASE WHEN name IN ('own__f01', 'own__f02', 'own__f03') THEN 'orders' ELSE 'person' END AS player FROM {attributions}) a GROUP BY node_id, player", "O-EX2 O-EX3")
add("strata", """
    SELECT m.stratum, CAST(count(*) AS BIGINT) AS n FROM (SELECT t.y, t.pa >= h.threshold AS flagged FROM {test_scores} t CROSS JOIN {f1_threshold} h) t
    CROSS JOIN (SELECT 'all' AS stratum UNION ALL SELECT 'fraud' UNION ALL SELECT 'not_fraud' UNION ALL SELECT 'flagged' UNION ALL SELECT 'true_positive' UNION ALL SELECT 'false_positive' UNION ALL SELECT 'false_negative') m
    WHERE m.stratum = 'all' OR m.stratum = CASE WHEN y = 1 THEN 'fraud' ELSE 'not_fraud' END OR m.stratum = CASE WHEN flagged THEN 'flagged' END OR m.stratum = CASE WHEN flagged AND y = 1 THEN 'true_positive' WHEN flagged THEN 'false_positive' WHEN y = 1 THEN 'false_negative' END GROUP BY m.stratum""", "O-EX4",
    oracle="""WITH f AS (SELECT t.y, t.pa >= (SELECT threshold FROM {f1_threshold}) AS flagged FROM {test_scores} t)
        SELECT * FROM (SELECT 'all' AS stratum, count(*) AS n FROM f UNION ALL SELECT 'fraud', count(*) FROM f WHERE y = 1 UNION ALL SELECT 'not_fraud', count(*) FROM f WHERE y = 0 UNION ALL SELECT 'flagged', count(*) FROM f WHERE flagged
            UNION ALL SELECT 'true_positive', count(*) FROM f WHERE flagged AND y = 1 UNION ALL SELECT 'false_positive', count(*) FROM f WHERE flagged AND y = 0 UNION ALL SELECT 'false_negative', count(*) FROM f WHERE NOT flagged AND y = 1) x WHERE n > 0""")
add("group_attribution", "SELECT group_id, name, sum(abs(phi)) AS total, CAST(count(*) AS BIGINT) AS n FROM {attributions} GROUP BY group_id, name", public=False)
add("importance", "SELECT name, round(sum(total) / sum(n), 6) AS importance FROM {group_attribution} GROUP BY name", "O-EX30 O-EX20")
add("drawn_importance", "SELECT d.b, g.name, round(sum(d.times * g.total) / sum(d.times * g.n), 7) AS importance FROM {draws} d JOIN {group_attribution} g ON g.group_id = d.group_id GROUP BY d.b, g.name", public=False)
add("drawn_ranks", "SELECT b, name, importance, rank() OVER (PARTITION BY b ORDER BY importance DESC, name) AS place FROM {drawn_importance}", public=False)
add("importance_signed", "SELECT name, avg(abs(phi)) AS importance, avg(phi) AS signed_mean FROM {attributions} GROUP BY name", public=False)
add("importance_ci", """
    SELECT i.name, round(i.importance, 6) AS importance, round(i.signed_mean, 6) + 0e0 AS signed_mean, CAST(row_number() OVER (ORDER BY round(i.importance, 6) DESC, i.name) AS BIGINT) AS place, d.low, d.high, d.rank_low, d.rank_high, d.rank_high - d.rank_low > 5 AS unstable
    FROM {importance_signed} i JOIN (SELECT name, round($Q(importance, 0.025), 6) AS low, round($Q(importance, 0.975), 6) AS high, round($Q($DBL(place), 0.025), 4) AS rank_low, round($Q($DBL(place), 0.975), 4) AS rank_high FROM {drawn_ranks} GROUP BY name) d ON d.name = i.name""", "O-EX5 O-EX20")
add("two_rankings", "SELECT a.name, a.importance AS x, b.importance AS z FROM {drawn_importance} a JOIN {drawn_importance} b ON b.name = a.name AND b.b = a.b + 1 WHERE a.b = 0", public=False)
add("placed_rankings", "SELECT name, x, z, row_number() OVER (ORDER BY x DESC, name) AS rx, row_number() OVER (ORDER BY z DESC, name) AS rz FROM {two_rankings}", public=False)
add("rank_agreement", """
    SELECT round((c.concordant - c.discordant) / nullif(sqrt($DBL(c.concordant + c.discordant + c.tx) * (c.concordant + c.discordant + c.tz)), 0), 6) AS kendall, round(j.jaccard, 6) AS jaccard, j.largest_move, j.n_columns
    FROM (SELECT sum(CASE WHEN (a.x - b.x) * (a.z - b.z) > 0 THEN 1 ELSE 0 END) AS concordant, sum(CASE WHEN (a.x - b.x) * (a.z - b.z) < 0 THEN 1 ELSE 0 END) AS discordant, sum(CASE WHEN a.x = b.x AND a.z <> b.z THEN 1 ELSE 0 END) AS tz, sum(CASE WHEN a.z = b.z AND a.x <> b.x THEN 1 ELSE 0 END) AS tx
        FROM {two_rankings} a JOIN {two_rankings} b ON a.name < b.name) c
    CROSS JOIN (SELECT sum(CASE WHEN rx <= 3 AND rz <= 3 THEN 1 ELSE 0 END) / $DBL(sum(CASE WHEN rx <= 3 OR rz <= 3 THEN 1 ELSE 0 END)) AS jaccard, CAST(max(CASE WHEN rx <= 3 THEN abs(rx - rz) END) AS BIGINT) AS largest_move, CAST(count(*) AS BIGINT) AS n_columns FROM {placed_rankings}) j""", "O-EX6 O-EX26")
add("margins", "SELECT node_id, round(sum(phi), 6) AS margin FROM {attributions} GROUP BY node_id", public=False)
add("additivity", """
    SELECT e.error, 1e-4 * greatest(1e0, m.largest) AS tolerance FROM (SELECT abs(m.margin - a.total) AS error FROM {margins} m JOIN (SELECT node_id, sum(total) AS total FROM {summed_by_group} GROUP BY node_id) a ON a.node_id = m.node_id) e
    CROSS JOIN (SELECT max(abs(margin)) AS largest FROM {margins}) m""", public=False)
add("implementation_check", """
    SELECT CAST(count(*) AS BIGINT) AS n, round(max(tolerance), 9) AS tolerance, CAST(sum(CASE WHEN error > tolerance THEN 1 ELSE 0 END) AS BIGINT) AS n_excluded, round(max(CASE WHEN error <= tolerance THEN error END), 6) AS largest_error,
        round(max(CASE WHEN error > tolerance THEN error ELSE 0e0 END), 6) AS largest_excluded, avg(CASE WHEN error > tolerance THEN 1e0 ELSE 0e0 END) > 0.01e0 AS broken FROM {additivity}""", "O-EX7 O-ML14 O-ST16 O-ST19")
_GAPS = [(f"n.nbr__{r}_mean_f0{i}", f"coalesce({r}.mean_f0{i}, 0e0)") for r in ("cpm", "cns", "cdp") for i in range(7)] + [(f"n.nbr__{r}_log1p_degree", f"ln(1e0 + coalesce({r}.degree, 0))") for r in ("cpm", "cns", "cdp")]
# A block's columns are rounded: means of whole numbers of nine digits to whole numbers, all others to four places.
add("layout_check", f"""SELECT n.node_id, {" AND ".join(f"abs({a} - {b}) <= 1e-4 + {'0.5e0' if a.endswith('f02') else '1e-6'} * greatest(1e0, abs({b}) * 1e-6)" for a, b in _GAPS)} AS same
    FROM {{nbr_block}} n {" ".join(f"LEFT JOIN {{neighbour_sums}} {r} ON {r}.node_id = n.node_id AND {r}.relation = '{r}'" for r in ("cpm", "cns", "cdp"))}""", "O-EX8")
add("edge_values", "SELECT a.relation, a.node_id AS target, a.nb AS neighbour, o.own__f01 AS v, sum(o.own__f01) OVER (PARTITION BY a.relation, a.node_id) AS total, count(*) OVER (PARTITION BY a.relation, a.node_id) AS degree FROM {adjacency_directed} a JOIN {own_block} o ON o.node_id = a.nb", public=False)
add("loo_neighbour_means", "SELECT relation, target, neighbour, CAST(degree AS BIGINT) AS degree, round(CASE WHEN degree > 1 THEN (total - v) / (degree - 1e0) ELSE 0e0 END, 7) AS mean_without, round(ln($DBL(degree)), 7) AS log_degree_without FROM {edge_values}", "O-EX9")
add("mean_ranges", "SELECT relation, min(m) AS low, max(m) AS high FROM (SELECT relation, target, max(total / degree) AS m FROM {edge_values} e JOIN {ids_table} i ON i.node_id = e.target GROUP BY relation, target) t GROUP BY relation", public=False)
_SIGMOID = "1e0 / (1e0 + exp(-({m})))"
add("influence_margins", """
    SELECT l.relation, l.target, l.neighbour, l.degree, l.mean_without < r.low OR l.mean_without > r.high AS out_of_range, 0.05e0 * (e.total / e.degree - 10e0) + 0.2e0 * ln(1e0 + e.degree) AS now,
        0.05e0 * (l.mean_without - 10e0) + 0.2e0 * ln(1e0 + e.degree) AS without_mean, 0.05e0 * (l.mean_without - 10e0) + 0.2e0 * l.log_degree_without AS without
    FROM {loo_neighbour_means} l JOIN {edge_values} e ON e.relation = l.relation AND e.target = l.target AND e.neighbour = l.neighbour JOIN {mean_ranges} r ON r.relation = l.relation""", public=False)
add("influence", f"""
    SELECT relation, target, neighbour, degree, out_of_range, round(now - without, 7) AS delta_margin, round({_SIGMOID.replace("{m}", "now")} - {_SIGMOID.replace("{m}", "without")}, 7) AS delta_prob,
        round({_SIGMOID.replace("{m}", "now")} - {_SIGMOID.replace("{m}", "without_mean")}, 7) AS delta_prob_mean FROM {{influence_margins}}""", "O-EX10 O-EX11 O-EX28")
add("aggregate_influence", """
    SELECT i.relation, i.neighbour, CAST(count(*) AS BIGINT) AS n_targets, round(sum(abs(i.delta_prob)), 7) AS sum_abs, $R(avg(abs(i.delta_prob)), 6) AS mean_abs, $R(avg(abs(i.delta_prob) * i.degree), 6) AS mean_abs_x_degree,
        round(sum(greatest(i.delta_prob, 0e0)), 7) AS towards_fraud, round(sum(greatest(-i.delta_prob, 0e0)), 7) AS away_from_fraud, round(sum(CASE WHEN f.node_id IS NOT NULL THEN abs(i.delta_prob) ELSE 0e0 END), 7) AS sum_abs_flagged
    FROM {influence} i LEFT JOIN (SELECT node_id FROM {test_scores} WHERE pa >= 0.5e0) f ON f.node_id = i.target GROUP BY i.relation, i.neighbour""", "O-EX13",
    oracle="""WITH w AS (SELECT relation, neighbour, target, degree, delta_prob, abs(delta_prob) AS a FROM {influence}), flagged AS (SELECT w.relation, w.neighbour, sum(w.a) AS s FROM w WHERE w.target IN (SELECT node_id FROM {test_scores} WHERE pa >= 0.5) GROUP BY ALL)
        SELECT w.relation, w.neighbour, count(*) AS n_targets, round(sum(a), 7) AS sum_abs, $R(sum(a) / count(*), 6) AS mean_abs, $R(sum(a * degree) / count(*), 6) AS mean_abs_x_degree, round(sum((a + delta_prob) / 2), 7) AS towards_fraud, round(sum((a - delta_prob) / 2), 7) AS away_from_fraud,
            round(coalesce(any_value(f.s), 0), 7) AS sum_abs_flagged FROM w LEFT JOIN flagged f ON f.relation = w.relation AND f.neighbour = w.neighbour GROUP BY w.relation, w.neighbour""")
add("neighbour_tables", """
    SELECT relation, CAST(count(DISTINCT target) AS BIGINT) AS n_targets, CAST(count(*) AS BIGINT) AS n_influences, $R(avg(abs(delta_prob)), 6) AS mean_abs_delta_prob, $R(avg(abs(delta_prob_mean)), 6) AS mean_abs_mean_part,
        $R(avg(abs(delta_prob - delta_prob_mean)), 6) AS mean_abs_degree_part, $R(avg(abs(delta_prob) * degree), 6) AS mean_abs_x_degree, $R(avg(CASE WHEN out_of_range THEN 1e0 ELSE 0e0 END), 6) AS share_out_of_range FROM {influence} GROUP BY relation""", "O-EX21")
add("top_influencers", "SELECT relation, neighbour, place FROM (SELECT relation, neighbour, row_number() OVER (PARTITION BY relation ORDER BY sum_abs DESC, neighbour) AS place FROM {aggregate_influence}) r WHERE place <= 10", "O-EX21 O-EX29")
# Removal and retraining, from its rows (see models.roar; `fall` is its drop): given as the input `roar_scores`.
add("roar_by_fold", "SELECT kind, name, k, fold, avg(fall) AS fall FROM {roar_scores} GROUP BY kind, name, k, fold", public=False)
add("roar_summary", "SELECT kind, name, k, round(avg(fall), 6) AS mean_drop, round(stddev_samp(fall), 6) AS sd_drop, CAST(count(*) AS BIGINT) AS n_folds FROM {roar_by_fold} GROUP BY kind, name, k", "O-EX18 O-EX17 O-ST14")
add("roar_top_or_random", """
    SELECT t.k, t.mean_drop AS top_k_drop, r.mean_drop AS random_drop, round(t.mean_drop - r.mean_drop, 6) AS gap, t.mean_drop > r.mean_drop AS top_k_hurts_more
    FROM {roar_summary} t JOIN {roar_summary} r ON r.k = t.k WHERE t.kind = 'top_k' AND r.kind = 'random'""", "O-EX18 O-EX24")
add("vectors", "SELECT node_id, max(CASE WHEN name = 'own__f01' THEN phi END) AS a, max(CASE WHEN name = 'own__f02' THEN phi END) AS b, max(CASE WHEN name = 'own__f04' THEN phi END) AS c FROM {attributions} GROUP BY node_id", public=False)
add("knn_cards", "SELECT node_id, near, place FROM (SELECT q.node_id, v.node_id AS near, row_number() OVER (PARTITION BY q.node_id ORDER BY round((q.a - v.a) * (q.a - v.a) + (q.b - v.b) * (q.b - v.b) + (q.c - v.c) * (q.c - v.c), 5), v.node_id) AS place FROM (SELECT * FROM {vectors} WHERE node_id % 20 = 0) q JOIN {vectors} v ON v.node_id <> q.node_id) n WHERE place <= 5", "O-EX29 O-DQ4")
add("contribution_cards", "SELECT node_id, $JOIN(CASE WHEN rn <= 3 THEN name END, rn) AS top, round(sum(CASE WHEN rn > 3 THEN phi ELSE 0e0 END), 6) AS rest FROM (SELECT node_id, name, phi, row_number() OVER (PARTITION BY node_id ORDER BY abs(phi) DESC, name) AS rn FROM {attributions}) r GROUP BY node_id", "O-DQ4 O-EX29")

# Attention: edge softmax, read-outs, integrity

add("attention_logits", "SELECT a.relation, a.node_id AS target, a.nb AS neighbour, h.head, ($H(101, h.head, a.node_id, a.nb) % 2000 - 1000) / 500e0 AS e FROM {adjacency_directed} a CROSS JOIN (SELECT 0 AS head UNION ALL SELECT 1) h", public=False)
add("edge_softmax", "SELECT relation, target, neighbour, head, round(x / sum(x) OVER (PARTITION BY relation, target, head), 9) AS alpha FROM (SELECT relation, target, neighbour, head, exp(e - max(e) OVER (PARTITION BY relation, target, head)) AS x FROM {attention_logits}) s", "O-ML5 O-ML6")
add("attention_edges", "SELECT relation, target, neighbour, avg(alpha) AS alpha FROM {edge_softmax} GROUP BY relation, target, neighbour", public=False)
add("gat_aggregate", "SELECT e.relation, e.target, round(sum(e.alpha * o.own__f01), 5) AS out FROM {attention_edges} e JOIN {own_block} o ON o.node_id = e.neighbour GROUP BY e.relation, e.target", "O-ML3 O-ML5")
add("attention_targets", "SELECT e.relation, e.target, CAST(count(*) AS BIGINT) AS degree, round(sum(-alpha * ln(alpha)) / nullif(ln($DBL(count(*))), 0), 6) AS entropy_ratio, max(alpha) AS largest, round(sum(CASE WHEN s.label = 1 THEN alpha ELSE 0e0 END), 6) AS fraud_attention, round(avg(CASE WHEN s.label = 1 THEN 1e0 ELSE 0e0 END), 6) AS fraud_share FROM {attention_edges} e JOIN {split_nodes} s ON s.node_id = e.neighbour GROUP BY e.relation, e.target", "O-ML11")
add("attention_summary", "SELECT a.relation, CASE WHEN s.label = 1 THEN 'fraud' WHEN s.label = 0 THEN 'benign' ELSE 'none' END AS who, round(avg(a.entropy_ratio), 5) AS focus, round($Q(a.largest, 0.5), 6) AS median_largest, round(avg(a.fraud_attention), 5) AS fraud_attention FROM {attention_targets} a JOIN {split_nodes} s ON s.node_id = a.target GROUP BY a.relation, CASE WHEN s.label = 1 THEN 'fraud' WHEN s.label = 0 THEN 'benign' ELSE 'none' END", "O-DQ1")
add("attention_top_edges", "SELECT relation, target, neighbour, place FROM (SELECT relation, target, neighbour, row_number() OVER (PARTITION BY relation, target ORDER BY round(alpha, 8) DESC, neighbour) AS place FROM {attention_edges}) r WHERE place <= 3", "O-ML11 O-DQ2")
add("attention_checks", "SELECT e.relation, CAST(count(*) AS BIGINT) AS targets, CAST(sum(CASE WHEN abs(total - 1e0) > 1e-5 THEN 1 ELSE 0 END) AS BIGINT) AS sum_off, CAST(sum(CASE WHEN e.n <> d.degree THEN 1 ELSE 0 END) AS BIGINT) AS lists_short FROM (SELECT relation, target, sum(alpha) AS total, count(*) AS n FROM {attention_edges} GROUP BY relation, target) e LEFT JOIN {degree_by_relation} d ON d.relation = e.relation AND d.node_id = e.target GROUP BY e.relation", "O-DQ3")
add("influence_checks", "SELECT 'target not in test' AS problem, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT target FROM {influence}) t LEFT JOIN {test_scores} s ON s.node_id = t.target WHERE s.node_id IS NULL UNION ALL SELECT 'no such edge', CAST(count(*) AS BIGINT) FROM {influence} i LEFT JOIN {adjacency_directed} a ON a.relation = i.relation AND a.node_id = i.target AND a.nb = i.neighbour WHERE a.node_id IS NULL", "O-DQ5")
add("classify_card", "SELECT t.node_id, CASE WHEN pa >= 0.5e0 AND y = 1 THEN 'caught' WHEN pa >= 0.5e0 THEN 'false alarm' WHEN y = 1 THEN 'missed' ELSE 'passed' END AS outcome, f.names, coalesce(d.degree, 0) AS degree FROM {test_scores} t JOIN {top_features_ecdf} f ON f.node_id = t.node_id LEFT JOIN {degree_by_relation} d ON d.node_id = t.node_id AND d.relation = 'cns' ORDER BY $H(111, t.node_id), t.node_id LIMIT 20", "O-DQ6 O-ST13")

# What survives refitting, from the importance of each column in each fit (fit, name, importance): given as the input `fit_importance`.
TOP = 10
add("fit_ranks", "SELECT fit, name, importance, rank() OVER (PARTITION BY fit ORDER BY importance DESC) + (count(*) OVER (PARTITION BY fit, importance) - 1) / 2e0 AS place FROM {fit_importance}", public=False)
add("refit_recurrence", f"""
    SELECT name, CAST(sum(CASE WHEN place <= {TOP} THEN 1 ELSE 0 END) AS BIGINT) AS fits_in_top, CAST(count(*) AS BIGINT) AS n_fits, round(avg(place), 6) AS mean_rank, min(place) AS best_rank, max(place) AS worst_rank
    FROM {{fit_ranks}} GROUP BY name HAVING sum(CASE WHEN place <= {TOP} THEN 1 ELSE 0 END) > 0""", "O-EX22", public=False)
add("fit_shares", """
    SELECT i.fit, CASE WHEN name LIKE 'own\\_\\_%' THEN 'own' WHEN name LIKE '%log1p\\_degree' THEN 'degree' ELSE 'nbr' END AS player, sum(i.importance) / max(t.total) AS share
    FROM {fit_importance} i JOIN (SELECT fit, sum(importance) AS total FROM {fit_importance} GROUP BY fit) t ON t.fit = i.fit GROUP BY i.fit, CASE WHEN name LIKE 'own\\_\\_%' THEN 'own' WHEN name LIKE '%log1p\\_degree' THEN 'degree' ELSE 'nbr' END""".replace(r"LIKE 'own\\_\\_%'", "LIKE 'own%'").replace(r"LIKE '%log1p\\_degree'", "LIKE '%log1p%'"), public=False)
add("block_share_across_fits", "SELECT player, round(min(share), 6) AS min_share, round(max(share), 6) AS max_share, CAST(count(*) AS BIGINT) AS n_fits FROM {fit_shares} GROUP BY player", "O-EX22", public=False)
# Agreement of each pair of fits: Spearman and Kendall of all columns, and of the TOP first ones their overlap and the largest move.
add("fit_agreement", f"""
    SELECT s.a, s.b, round(s.spearman, 6) AS spearman, round(k.tau, 6) AS kendall, round(s.overlap, 6) AS top_overlap, s.largest_move FROM (
        SELECT x.fit AS a, y.fit AS b, corr(x.place, y.place) AS spearman, sum(CASE WHEN x.place <= {TOP} AND y.place <= {TOP} THEN 1 ELSE 0 END) / nullif($DBL(sum(CASE WHEN x.place <= {TOP} OR y.place <= {TOP} THEN 1 ELSE 0 END)), 0) AS overlap, max(CASE WHEN x.place <= {TOP} THEN abs(x.place - y.place) END) AS largest_move
        FROM {{fit_ranks}} x JOIN {{fit_ranks}} y ON y.name = x.name AND x.fit < y.fit GROUP BY x.fit, y.fit) s
    JOIN (SELECT a, b, sum(sx * sy) / nullif(sqrt($DBL(sum(sx * sx)) * sum(sy * sy)), 0) AS tau FROM (
        SELECT x.fit AS a, y.fit AS b, sign(x.place - u.place) AS sx, sign(y.place - v.place) AS sy FROM {{fit_ranks}} x JOIN {{fit_ranks}} u ON u.fit = x.fit AND u.name < x.name JOIN {{fit_ranks}} y ON y.name = x.name AND x.fit < y.fit JOIN {{fit_ranks}} v ON v.fit = y.fit AND v.name = u.name) p GROUP BY a, b) k ON k.a = s.a AND k.b = s.b""", "O-EX23 O-EX26", public=False)
