"""Graph construction, node tables and neighbour features (template operators), over the customer graph of the test tables.

The adapters link each customer to a bounded number of followers within a group, so edges grow with the nodes.
"""

from __future__ import annotations

from quillmesh.plans.dialect import LIBRARY

add = LIBRARY.add



def add_ranks(name: str, source: str, keep: str, bucket: str, order: str, within: str = "") -> None:
    """`name`_buckets and `name`: the rows of `source` with a 0-based `place` by `order` (within groups of `within`), and `total`.

    Only counts of buckets meet in one window; rows are sorted bucket by bucket. `bucket` must be monotone in the order."""
    part, comma = (f"PARTITION BY {within} ", f"{within}, ") if within else ("", "")
    add(f"{name}_buckets", f"""SELECT {comma}b, CAST(sum(n) OVER ({part}ORDER BY b) - n AS BIGINT) AS earlier, CAST(sum(n) OVER ({part.strip()}) AS BIGINT) AS total
        FROM (SELECT {comma}{bucket} AS b, count(*) AS n FROM {{{source}}} GROUP BY {comma}{bucket}) g""", public=False)
    match = "".join(f" AND k.{w.strip()} = r.{w.strip()}" for w in within.split(",") if w.strip())
    add(name, f"""SELECT {", ".join("r." + c.strip() for c in keep.split(","))}, k.earlier + r.rn - 1 AS place, k.total
        FROM (SELECT {keep}, {bucket} AS b, row_number() OVER (PARTITION BY {comma}{bucket} ORDER BY {order}) AS rn FROM {{{source}}}) r JOIN {{{name}_buckets}} k ON k.b = r.b{match}""", public=False)


# Adapters: relations, nodes and own features of customers

add("bought", """
    SELECT DISTINCT o.o_custkey AS node_id, l.l_partkey AS part, year(o.o_orderdate) * 100 + month(o.o_orderdate) AS month
    FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey""", public=False)
add("entries", """
    SELECT 'cpm' AS relation, node_id AS i, CASE WHEN k = 0 THEN j1 ELSE j2 END AS j, 1 AS v
    FROM (SELECT node_id, lead(node_id, 1) OVER (PARTITION BY part, month ORDER BY node_id) AS j1, lead(node_id, 2) OVER (PARTITION BY part, month ORDER BY node_id) AS j2 FROM {bought}) b $TWICE(t)
    UNION ALL SELECT 'cns', CASE WHEN k = 0 THEN j1 ELSE c_custkey END, CASE WHEN k = 0 THEN c_custkey ELSE j3 END, 1
    FROM (SELECT c_custkey, lead(c_custkey, 1) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS j1, lead(c_custkey, 3) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS j3 FROM {customer}) c $TWICE(t)
    UNION ALL SELECT 'cdp', o_custkey, lead(o_custkey, 1) OVER (PARTITION BY o_orderdate, o_orderpriority ORDER BY o_custkey, o_orderkey), 1 FROM {orders}
    UNION ALL SELECT 'cdp', o_custkey, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 1 END FROM {orders} WHERE o_orderkey % 50 = 0""", public=False)
add("customer_facts", """
    SELECT o_custkey AS node_id, CAST(count(*) AS BIGINT) AS orders, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS priorities,
        CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS filled, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM {orders} GROUP BY o_custkey""", public=False)
# Of nine customers in a row the fifth and sixth have the features of the fourth, so there are groups of identical rows.
add("raw_features", """
    SELECT c.c_custkey AS node_id, $DBL(s.c_acctbal) AS own__f00, $DBL(coalesce(f.orders, 0)) AS own__f01, $DBL(coalesce(f.cents, 0)) AS own__f02,
        coalesce($DBL(f.filled) / f.orders, 0e0) AS own__f03, $DBL(coalesce(f.priorities, 0)) AS own__f04,
        CASE s.c_mktsegment WHEN 'BUILDING' THEN 1e0 WHEN 'MACHINERY' THEN 2e0 WHEN 'AUTOMOBILE' THEN 3e0 ELSE 0e0 END AS own__f05, $DBL(s.c_custkey % 2) AS own__f06
    FROM {customer} c JOIN {customer} s ON s.c_custkey = CASE WHEN c.c_custkey % 9 IN (4, 5) THEN c.c_custkey - c.c_custkey % 9 + 3 ELSE c.c_custkey END LEFT JOIN {customer_facts} f ON f.node_id = s.c_custkey""", public=False)
add("labels_raw", "SELECT c_custkey AS node_id, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y, n.prefix FROM {customer} c CROSS JOIN (SELECT CAST(floor(0.1e0 * count(*)) AS BIGINT) AS prefix FROM {customer}) n", public=False)

# Graph construction

add("edges_canonical", """
    SELECT DISTINCT relation, least(i, j) AS src, greatest(i, j) AS dst FROM {entries} WHERE v <> 0 AND i <> j AND i IS NOT NULL AND j IS NOT NULL""", "O-GR1 O-IO3 O-ST1")
add("adjacency_directed", "SELECT relation, CASE WHEN k = 0 THEN src ELSE dst END AS node_id, CASE WHEN k = 0 THEN dst ELSE src END AS nb FROM {edges_canonical} e $TWICE(t)", "O-GR9 O-GR10 O-GR11")
add("degree_by_relation", "SELECT relation, node_id, CAST(count(*) AS BIGINT) AS degree FROM {adjacency_directed} GROUP BY relation, node_id", "O-GR11")
_OWN = [f"own__f0{i}" for i in range(7)]
add("duplicate_groups", f"""
    SELECT r.node_id, g.first_node FROM {{raw_features}} r JOIN (SELECT {", ".join(_OWN)}, min(node_id) AS first_node FROM {{raw_features}} GROUP BY {", ".join(_OWN)}) g
        ON {" AND ".join(f"g.{c} IS NOT DISTINCT FROM r.{c}" for c in _OWN)}""", "O-GR3 O-GR5",
    oracle=f"SELECT node_id, min(node_id) OVER (PARTITION BY {', '.join(_OWN)}) AS first_node FROM {{raw_features}}")
add("group_numbers", "SELECT first_node, CAST(count(*) AS BIGINT) AS size FROM {duplicate_groups} GROUP BY first_node", public=False)
add_ranks("group_places", "group_numbers", "first_node", "CAST(floor(first_node / 1024e0) AS BIGINT)", "first_node")
add("renumber_groups", "SELECT d.node_id, g.place AS group_id FROM {duplicate_groups} d JOIN {group_places} g ON g.first_node = d.first_node", "O-GR4")
add("node_table", """
    SELECT l.node_id, CASE WHEN l.node_id >= l.prefix THEN l.y END AS label, l.node_id >= l.prefix AS is_labelled, g.group_id,
        CASE WHEN l.node_id < l.prefix THEN 'unlabelled' END AS split
    FROM {labels_raw} l JOIN {renumber_groups} g ON g.node_id = l.node_id""", "O-GR6")
add("observed_counts", """
    SELECT 'nodes' AS what, CAST(count(*) AS BIGINT) AS found FROM {node_table} UNION ALL SELECT 'positive', CAST(coalesce(sum(label), 0) AS BIGINT) FROM {node_table}
    UNION ALL SELECT 'unlabelled', CAST(sum(CASE WHEN is_labelled THEN 0 ELSE 1 END) AS BIGINT) FROM {node_table}
    UNION ALL SELECT 'edges_' || relation, CAST(count(*) AS BIGINT) FROM {edges_canonical} GROUP BY relation""", "O-GR7")
add("expected_counts", """
    SELECT 'nodes' AS what, CAST(count(*) AS BIGINT) AS expected FROM {customer} UNION ALL SELECT 'positive', CAST(coalesce(sum(y), 0) AS BIGINT) FROM {labels_raw} WHERE node_id >= prefix
    UNION ALL SELECT 'unlabelled', max(prefix) FROM {labels_raw} UNION ALL SELECT 'features', 7
    UNION ALL SELECT 'edges_' || relation, CAST(count(*) AS BIGINT) FROM (SELECT relation, i + j AS both_ends, abs(i - j) AS apart FROM {entries} WHERE v > 0 AND i IS NOT NULL AND j IS NOT NULL AND i <> j GROUP BY relation, i + j, abs(i - j)) e GROUP BY relation""", public=False)
add("count_table", """
    SELECT coalesce(f.what, e.what) AS what, f.found, e.expected, CASE WHEN f.found = e.expected THEN true ELSE false END AS same
    FROM {observed_counts} f FULL OUTER JOIN {expected_counts} e ON e.what = f.what""", "O-GR7 O-AU7")
add("edges_out_of_range", """
    SELECT e.relation, CAST(sum(CASE WHEN src < 0 OR dst >= n.n THEN 1 ELSE 0 END) AS BIGINT) AS bad
    FROM {edges_canonical} e CROSS JOIN (SELECT count(*) AS n FROM {node_table}) n GROUP BY e.relation""", "O-GR8")
add("edge_hashes", "SELECT relation, src, dst, $H(5, src, dst) AS h FROM {edges_canonical}", public=False)
add_ranks("edge_places", "edge_hashes", "relation, src, dst", "CAST(floor(h / 1048576e0) AS BIGINT)", "h, src, dst", "relation")
add("sample_edges", "SELECT relation, src, dst FROM {edge_places} WHERE place < round(0.3e0 * total)", "O-GR12")
add("stub_hashes", """
    SELECT relation, node_id, k, side, $H(9, node_id, k, side) AS h
    FROM (SELECT relation, CASE WHEN t.k = 0 THEN src ELSE dst END AS node_id, CASE WHEN t.k = 0 THEN dst ELSE src END AS k, t.k AS side FROM {edges_canonical} e $TWICE(t)) s""", public=False)
add_ranks("stubs", "stub_hashes", "relation, node_id", "CAST(floor(h / 1048576e0) AS BIGINT)", "h, node_id, k, side", "relation")
add("rewire_edges", """
    SELECT DISTINCT a.relation, least(a.node_id, b.node_id) AS src, greatest(a.node_id, b.node_id) AS dst
    FROM {stubs} a JOIN {stubs} b ON b.relation = a.relation AND b.place = a.place + 1 WHERE a.place % 2 = 0 AND a.node_id <> b.node_id""", "O-GR13")
add("normalised_adjacency", """
    SELECT a.relation, a.node_id, a.nb, 1e0 / d.degree AS w_mean, 1e0 / sqrt($DBL(d.degree) * e.degree) AS w_sym
    FROM {adjacency_directed} a JOIN {degree_by_relation} d ON d.relation = a.relation AND d.node_id = a.node_id
    JOIN {degree_by_relation} e ON e.relation = a.relation AND e.node_id = a.nb""", "O-GR16")
add("gcn_weights", """
    SELECT s.relation, s.node_id, s.nb, round(1e0 / sqrt((coalesce(d.degree, 0) + 1e0) * (coalesce(e.degree, 0) + 1e0)), 9) AS w
    FROM (SELECT relation, node_id, nb FROM {adjacency_directed} UNION ALL SELECT r.relation, n.node_id, n.node_id FROM {node_table} n CROSS JOIN (SELECT DISTINCT relation FROM {edges_canonical}) r) s
    LEFT JOIN {degree_by_relation} d ON d.relation = s.relation AND d.node_id = s.node_id LEFT JOIN {degree_by_relation} e ON e.relation = s.relation AND e.node_id = s.nb""", "O-GR17")
_COLUMNS = [f"f0{i}" for i in range(7)]
_DIGITS = {c: 0 if c == "f02" else 4 for c in _COLUMNS}  # f02 has nine digits before the point
add("hop_one", "SELECT a.node_id, a.relation, " + ", ".join(f"sum(o.own__{c} * a.w_mean) AS h1_{c}" for c in _COLUMNS) + " FROM {normalised_adjacency} a JOIN {raw_features} o ON o.node_id = a.nb GROUP BY a.node_id, a.relation", public=False)
add("hop_two", "SELECT a.node_id, a.relation, " + ", ".join(f"sum(h.h1_{c} * a.w_mean) AS h2_{c}" for c in _COLUMNS) + " FROM {normalised_adjacency} a JOIN {hop_one} h ON h.relation = a.relation AND h.node_id = a.nb GROUP BY a.node_id, a.relation", public=False)
add("sign_hops", "SELECT n.node_id, r.relation, " + ", ".join(f"n.own__{c} AS h0_{c}, $R(coalesce(h.h1_{c}, 0e0), {_DIGITS[c]}) AS h1_{c}, $R(coalesce(k.h2_{c}, 0e0), {_DIGITS[c]}) AS h2_{c}" for c in _COLUMNS) + """
    FROM {raw_features} n CROSS JOIN (SELECT DISTINCT relation FROM {edges_canonical}) r LEFT JOIN {hop_one} h ON h.node_id = n.node_id AND h.relation = r.relation
    LEFT JOIN {hop_two} k ON k.node_id = n.node_id AND k.relation = r.relation""", "O-GR18")
add("gcn_propagate", "SELECT w.node_id, w.relation, " + ", ".join(f"$R(sum(w.w * o.own__{c}), {_DIGITS[c]}) AS z_{c}" for c in _COLUMNS) + " FROM {gcn_weights} w JOIN {raw_features} o ON o.node_id = w.nb GROUP BY w.node_id, w.relation", "O-EX14 O-GR17")

# Features

add("own_block", "SELECT node_id, own__f00, own__f01, own__f02, own__f03, own__f04, own__f05, own__f06 FROM {raw_features}", "O-FT1 O-IO2")
_RELATIONS = ("cpm", "cns", "cdp")
add("neighbour_sums", f"""
    SELECT a.node_id, a.relation, CAST(count(*) AS BIGINT) AS degree, {", ".join(f"sum(o.own__{f}) / count(*) AS mean_{f}" for f in _COLUMNS)}
    FROM {{adjacency_directed}} a JOIN {{own_block}} o ON o.node_id = a.nb GROUP BY a.node_id, a.relation""", public=False)
add("nbr_block", f"""
    SELECT n.node_id, {", ".join(f"$R(coalesce(max(CASE WHEN s.relation = '{r}' THEN s.mean_{f} END), 0e0), {_DIGITS[f]}) AS nbr__{r}_mean_{f}" for r in _RELATIONS for f in _COLUMNS)},
        {", ".join(f"round(ln(1e0 + coalesce(max(CASE WHEN s.relation = '{r}' THEN s.degree END), 0)), 9) AS nbr__{r}_log1p_degree" for r in _RELATIONS)}
    FROM {{own_block}} n LEFT JOIN {{neighbour_sums}} s ON s.node_id = n.node_id GROUP BY n.node_id""", "O-FT2 O-ST5",
    oracle=f"""WITH ends AS (SELECT relation, src AS node_id, dst AS nb FROM {{edges_canonical}} UNION ALL SELECT relation, dst, src FROM {{edges_canonical}}),
        seen AS (SELECT e.node_id, e.relation, list(o) AS near FROM ends e JOIN {{own_block}} o ON o.node_id = e.nb GROUP BY e.node_id, e.relation)
        SELECT n.node_id, {", ".join(f"$R(coalesce(list_avg(list_transform({r}.near, lambda x: x.own__{f})), 0e0), {_DIGITS[f]}) AS nbr__{r}_mean_{f}" for r in _RELATIONS for f in _COLUMNS)},
        {", ".join(f"round(ln(1e0 + coalesce(len({r}.near), 0)), 9) AS nbr__{r}_log1p_degree" for r in _RELATIONS)} FROM {{own_block}} n {" ".join(f"LEFT JOIN seen {r} ON {r}.node_id = n.node_id AND {r}.relation = '{r}'" for r in _RELATIONS)}""")
add("deg_block", f"""
    SELECT n.node_id, {", ".join(f"round(ln(1e0 + coalesce(max(CASE WHEN d.relation = '{r}' THEN d.degree END), 0)), 9) AS deg__{r}_log1p_degree" for r in _RELATIONS)}
    FROM {{own_block}} n LEFT JOIN {{degree_by_relation}} d ON d.node_id = n.node_id GROUP BY n.node_id""", "O-FT3")
add("own_matrix_check", "SELECT count(*) = count(DISTINCT node_id) AND min(node_id) = 0 AND max(node_id) = count(*) - 1 AS sound, CAST(count(*) AS BIGINT) AS nodes FROM {own_block}", "O-FT4 O-ST10")

# Splits

add("split_nodes", """
    SELECT n.node_id, n.label, n.is_labelled, n.group_id, CASE WHEN n.split = 'unlabelled' THEN n.split WHEN $H(11, n.group_id) % 5 < 2 THEN 'test' ELSE 'train' END AS split,
        CASE WHEN n.split IS NULL AND $H(11, n.group_id) % 5 >= 2 THEN $H(12, n.group_id) % 5 END AS cv_fold FROM {node_table} n""", "O-SP2 O-ST2 O-IO4")
add("split_check", """
    SELECT CAST(sum(CASE WHEN label IS NOT NULL AND split = 'unlabelled' THEN 1 ELSE 0 END) AS BIGINT) AS labelled_outside, CAST(sum(CASE WHEN label IS NULL AND split <> 'unlabelled' THEN 1 ELSE 0 END) AS BIGINT) AS unlabelled_inside,
        CAST(sum(CASE WHEN split = 'train' AND cv_fold IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_fold, CAST(sum(CASE WHEN split <> 'train' AND cv_fold IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS fold_outside,
        (SELECT CAST(count(*) AS BIGINT) FROM (SELECT group_id FROM {split_nodes} WHERE split <> 'unlabelled' GROUP BY group_id HAVING count(DISTINCT split) > 1) g) AS groups_across,
        (SELECT CAST(count(*) AS BIGINT) FROM (SELECT group_id FROM {split_nodes} WHERE cv_fold IS NOT NULL GROUP BY group_id HAVING count(DISTINCT cv_fold) > 1) g) AS folds_across
    FROM {split_nodes}""", "O-SP3")
add("ids_table", "SELECT node_id, label, group_id FROM {split_nodes} WHERE split = 'train'", "O-SP4")
add("folds_table", "SELECT node_id, cv_fold AS fold FROM {split_nodes} WHERE split = 'train'", "O-SP4")
add("split_summary", """
    SELECT part, fold, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg($DBL(label)), 9) AS rate, CAST(count(DISTINCT group_id) AS BIGINT) AS groups
    FROM (SELECT split AS part, CAST(NULL AS BIGINT) AS fold, label, group_id FROM {split_nodes} UNION ALL SELECT split, cv_fold, label, group_id FROM {split_nodes} WHERE split = 'train') s GROUP BY part, fold""", "O-SP5")
add("saved_ids_check", """
    SELECT 'missing' AS problem, node_id FROM (SELECT node_id FROM {ids_table} EXCEPT SELECT node_id FROM {ids_table} WHERE node_id % 97 <> 5) a
    UNION ALL SELECT 'extra', node_id FROM (SELECT node_id FROM {ids_table} WHERE node_id % 97 <> 5 EXCEPT SELECT node_id FROM {ids_table}) b""", "O-SP6")
add_ranks("id_places", "ids_table", "node_id, label, group_id", "CAST(floor(node_id / 1024e0) AS BIGINT)", "node_id")
add("folds_in_order", "SELECT i.place AS row_at, i.node_id, f.fold, f.fold IS NULL AS missing FROM {id_places} i LEFT JOIN {folds_table} f ON f.node_id = i.node_id", "O-SP7")
add("label_hashes", "SELECT node_id, label, $H(31, node_id) AS h FROM {ids_table}", public=False)
add_ranks("label_places", "label_hashes", "node_id, label", "CAST(floor(h / 1048576e0) AS BIGINT)", "h, node_id", "label")
add("stratified_sample", """
    SELECT s.node_id, s.label FROM {label_places} s CROSS JOIN (SELECT count(*) AS n FROM {ids_table}) a WHERE s.place < greatest(1, floor(200e0 * s.total / a.n + 0.5e0))""", "O-SP8",
    oracle="""SELECT node_id, label FROM (SELECT node_id, label, row_number() OVER (PARTITION BY label ORDER BY $H(31, node_id), node_id) AS rn,
        count(*) OVER (PARTITION BY label) AS ny, count(*) OVER () AS n FROM {ids_table}) s WHERE rn <= greatest(1, floor(200e0 * ny / n + 0.5e0))""")
add("draw_row", "SELECT node_id, label FROM {split_nodes} WHERE split = 'test' AND label = 1 ORDER BY $H(77, 3, node_id), node_id LIMIT 1", "O-SP9")
add("split_masks", "SELECT node_id, split = 'train' AS fit, split <> 'test' AS loss FROM {split_nodes}", "O-FT9")
add("gnn_data", "SELECT i.node_id, i.label, f.fold, i.group_id, 'train' AS part FROM {ids_table} i JOIN {folds_table} f ON f.node_id = i.node_id UNION ALL SELECT node_id, NULL, NULL, NULL, 'test' FROM {split_nodes} WHERE split = 'test'", "O-ST7")

# Feature blocks

_OWN = [f"own__f0{i}" for i in range(7)]
_VALUE = "CASE c.b " + " ".join(f"WHEN {i} THEN o.{c}" for i, c in enumerate(_OWN)) + " END"
add("own_long", f"SELECT o.node_id, 'own__f0' || CAST(c.b AS VARCHAR(2)) AS name, {_VALUE} AS v, s.split, s.label FROM {{own_block}} o JOIN {{split_nodes}} s ON s.node_id = o.node_id CROSS JOIN $SERIES({len(_OWN)}) c", public=False,
    oracle=" UNION ALL ".join(f"SELECT o.node_id, '{c}' AS name, o.{c} AS v, s.split, s.label FROM {{own_block}} o JOIN {{split_nodes}} s ON s.node_id = o.node_id" for c in _OWN))
add("column_spec", """
    SELECT name, CAST(count(DISTINCT v) AS BIGINT) AS n_unique, CASE WHEN count(DISTINCT v) <= 1 THEN 'constant' WHEN count(DISTINCT v) = 2 THEN 'binary'
        WHEN bool_and(v = round(v)) THEN 'ordinal' ELSE 'continuous' END AS kind FROM {own_long} WHERE split = 'train' GROUP BY name""", "O-FT5 O-ST3 O-FB7",
    oracle="""WITH kinds AS (SELECT name, len(list(DISTINCT v)) AS n, count(*) FILTER (WHERE v <> trunc(v)) AS parts FROM {own_long} WHERE split = 'train' AND v IS NOT NULL GROUP BY name)
        SELECT name, CAST(n AS BIGINT) AS n_unique, CASE WHEN n < 2 THEN 'constant' WHEN n = 2 THEN 'binary' WHEN parts = 0 THEN 'ordinal' ELSE 'continuous' END AS kind FROM kinds""")
add("own_view", "SELECT node_id, own__f01, own__f02, own__f04 FROM {own_block}", "O-FB3 O-FB1 O-FB2")
add("feature_join", "SELECT o.*, d.deg__cpm_log1p_degree, d.deg__cns_log1p_degree, d.deg__cdp_log1p_degree FROM {own_view} o JOIN {deg_block} d ON d.node_id = o.node_id", "O-FB4")
add("validate_block", f"""
    SELECT CAST(count(*) - count(DISTINCT node_id) AS BIGINT) AS repeated, CAST(sum({" + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in _OWN)}) AS BIGINT) AS nulls FROM {{own_block}}""", "O-FB5")
add("model_table", "SELECT i.place AS row_at, f.*, i.label AS target FROM {id_places} i JOIN {feature_join} f ON f.node_id = i.node_id", "O-FB6 O-FB9")
add("sanitise_names", """
    SELECT name, clean, count(*) OVER (PARTITION BY clean) > 1 AS collides
    FROM (SELECT DISTINCT name, $RX($RX(lower(name), '[^a-z0-9]+', '_'), '^_+|_+$', '') AS clean FROM (SELECT p_type AS name FROM {part} UNION ALL SELECT p_brand FROM {part}) p) c""", "O-FB8")
add("train_moments", "SELECT name, avg(v) AS mean, stddev_pop(v) AS sd FROM {own_long} WHERE split = 'train' GROUP BY name", public=False)
add("standardise", "SELECT o.node_id, o.name, round((o.v - m.mean) / CASE WHEN m.sd = 0 THEN 1e0 ELSE m.sd END, 6) AS z FROM {own_long} o JOIN {train_moments} m ON m.name = o.name", "O-FT6")
add("all_node_matrix", """
    SELECT o.node_id, o.own__f01, b.nbr__cpm_mean_f01, b.nbr__cpm_log1p_degree, CASE WHEN abs(o.own__f05 - 1e0) <= 1e-9 THEN 1 ELSE 0 END AS "own__f05_1", CASE WHEN abs(o.own__f05 - 2e0) <= 1e-9 THEN 1 ELSE 0 END AS "own__f05_2"
    FROM {own_block} o JOIN {nbr_block} b ON b.node_id = o.node_id""".replace('"own__f05_1"', "own__f05_1").replace('"own__f05_2"', "own__f05_2"), "O-FT12")
add("ego_network", """
    SELECT e.relation, e.node_id, e.nb, e.degree, CAST(e.n_train AS BIGINT) AS n_train, round(e.train_fraud, 6) AS train_fraud, e.kind FROM (
        SELECT a.relation, a.node_id, a.nb, count(*) OVER (PARTITION BY a.relation, a.node_id) AS degree, sum(CASE WHEN s.split = 'train' THEN 1 ELSE 0 END) OVER (PARTITION BY a.relation, a.node_id) AS n_train, avg(CASE WHEN s.split = 'train' THEN $DBL(s.label) END) OVER (PARTITION BY a.relation, a.node_id) AS train_fraud,
            CASE WHEN s.split = 'train' AND s.label = 1 THEN 'train fraud' WHEN s.split = 'train' THEN 'train benign' ELSE s.split END AS kind, row_number() OVER (PARTITION BY a.relation, a.node_id ORDER BY $H(41, a.relation, a.node_id, a.nb), a.nb) AS rn
        FROM {adjacency_directed} a JOIN {split_nodes} s ON s.node_id = a.nb) e WHERE e.rn <= 12""", "O-GR19 O-ST13")
add("ego_links", """
    SELECT a.relation, a.node_id, a.nb AS first_nb, b.nb AS second_nb FROM {ego_network} a JOIN {edges_canonical} e ON e.relation = a.relation AND e.src = a.nb
    JOIN {ego_network} b ON b.relation = a.relation AND b.node_id = a.node_id AND b.nb = e.dst""", "O-GR19")
add("fold_sizes", "SELECT CAST(cv_fold AS BIGINT) AS fold, count(*) AS n FROM {split_nodes} WHERE split = 'train' GROUP BY cv_fold", public=False)
# Each fit of nested cross-fitting on the saved folds: its seed, and the rows outside its outer and inner fold.
add("fit_seeds", """
    SELECT s.b AS seed, f.outer_fold, f.inner_fold, s.b * 100 + f.outer_fold * 10 + coalesce(f.inner_fold, 9) AS fit_seed, CAST(t.total - f.held AS BIGINT) AS n_fit FROM (
        SELECT fold AS outer_fold, CAST(NULL AS BIGINT) AS inner_fold, n AS held FROM {fold_sizes} UNION ALL SELECT o.fold, i.fold, o.n + i.n FROM {fold_sizes} o JOIN {fold_sizes} i ON i.fold <> o.fold) f
    CROSS JOIN (SELECT sum(n) AS total FROM {fold_sizes}) t CROSS JOIN $SERIES(5) s""", "O-ST11",
    oracle="""WITH rows AS (SELECT cv_fold FROM {split_nodes} WHERE split = 'train'), k AS (SELECT DISTINCT CAST(cv_fold AS BIGINT) AS fold FROM rows), p AS (SELECT o.fold AS outer_fold, i.fold AS inner_fold FROM k o JOIN (SELECT fold FROM k UNION ALL SELECT NULL) i ON i.fold IS DISTINCT FROM o.fold)
        SELECT s.b AS seed, outer_fold, inner_fold, s.b * 100 + outer_fold * 10 + CASE WHEN inner_fold IS NULL THEN 9 ELSE inner_fold END AS fit_seed, CAST((SELECT count(*) FROM rows r WHERE r.cv_fold <> p.outer_fold AND (p.inner_fold IS NULL OR r.cv_fold <> p.inner_fold)) AS BIGINT) AS n_fit FROM p CROSS JOIN $SERIES(5) s""")
