import random
import re

import numpy as np

import corpus_pipeline as P
from quillmesh.llm import hdc_language, quality_trees
from quillmesh.llm.packing import binary_cuts, byte_bpe
from quillmesh.storage import table
from tests.llm.test_metric_join import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in quality_trees.quality_of_documents(docs, table(spark, SF, "labels")).collect()}
    good = [r for d, r in sorted(rows.items()) if scores[d]]
    got = P.quality(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [r.doc_id for r in good]
    langs = {r.doc_id: r for r in hdc_language.identify(got, hdc_language.learn(hdc_language.training_rows(got))).collect()}
    known = [r for r in good if langs[r.doc_id].lang_pred != "und" and langs[r.doc_id].score >= P.LEAST_COSINE]
    got = P.language(spark, got, SF)
    assert sorted(r.doc_id for r in got.collect()) == [r.doc_id for r in known]
    found = brute([(r.doc_id, r.text) for r in known], 5, 80, 100)
    kept = [r for r in known if found[r.doc_id][1] == r.doc_id]
    assert 0 < len(kept) < len(known)
    got = P.near_duplicates(spark, got, SF)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [r.doc_id for r in kept]
    want = sorted((r.doc_id, s, n) for r in kept for s, n in binary_cuts(len(byte_bpe()(r.text)) + 1))
    assert sorted((r.doc_id, r.start, r.length) for r in P.run(spark, SF).collect()) == want


def test_clean_documents_stay(spark):
    docs = table(spark, SF, "documents")
    clean = [r.doc_id for r in docs.collect() if len(r.text.split()) > 30 and not re.search(r"###|\$\$\$|!!| \| ", r.text) and len(set(r.text.split())) > 0.4 * len(r.text.split())]
    kept = {r.doc_id for r in P.language(spark, P.quality(spark, docs, SF), SF).collect()}
    assert np.mean([d in kept for d in clean]) > 0.98


def test_unlearnt_scripts_and_random_letters_go(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rng = random.Random(3)
    scripts = {"greek": (0x3B1, 0x3CA), "cyrillic": (0x430, 0x450), "arabic": (0x627, 0x64B), "hangul": (0xAC00, 0xB000), "cjk": (0x4E00, 0x5E00), "latin": (97, 123)}
    alphabets = {k: [chr(c) for c in range(*v)] for k, v in scripts.items()} | {"base64": list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}
    planted = [" ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 9))) for _ in range(n)) for a in alphabets.values() for n in (30, 200) for _ in range(20)]
    rows = spark.createDataFrame([(8_000_000 + i, t, None, "planted", len(t)) for i, t in enumerate(planted)], docs.schema)
    kept = {r.doc_id for r in P.language(spark, docs.unionByName(rows), SF).collect()}
    assert [d for d in kept if d >= 8_000_000] == []
    clean = [r.doc_id for r in docs.collect() if len(r.text.split()) > 10]
    assert np.mean([d in kept for d in clean]) > 0.995


def test_repeated_and_odd_rows(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, "no id " * 30, "en", "s", 1), (7_000_001, None, None, None, None), (7_000_002, "", "en", "s", 0)], docs.schema)
    both = docs.unionByName(docs.where("doc_id < 20")).unionByName(odd)
    kept = P.near_duplicates(spark, both, SF).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {7_000_001, 7_000_002} <= set(ids) and sum(r.doc_id is None for r in kept) == 1
    assert P.STAGES[-1][1](spark, P.language(spark, P.quality(spark, both, SF), SF), SF).count() > 0
    none = docs.limit(0)
    for _, stage in P.STAGES[:-1]:
        none = stage(spark, none, SF)
    assert P.pack(spark, none, SF).collect() == []


def test_clashing_names_and_long_texts(spark):
    """Columns named as the operators' own inner ones are carried through."""
    docs = table(spark, SF, "documents")
    names = ["id", "component_id", "count", "__id", "of", "y", "score", "lang_pred", "h", "tie", "one"]
    long = spark.createDataFrame([(7_100_000, " ".join(r.text for r in docs.limit(60).collect()) * 20, "en", "s", 1), (7_100_001, "word " * 300_000, "en", "s", 1)], docs.schema)
    wide = docs.unionByName(long).selectExpr("*", *[f"doc_id + {i} AS `{n}`" for i, n in enumerate(names)])
    plain = docs.unionByName(long)
    for _, stage in P.STAGES[:-1]:
        wide, plain = stage(spark, wide, SF), stage(spark, plain, SF)
        found = wide.collect()
        assert wide.columns == [*docs.columns, *names] and sorted(r.doc_id for r in found) == sorted(r.doc_id for r in plain.collect())
        assert all(r[n] == r.doc_id + i for r in found for i, n in enumerate(names))
    assert 7_100_000 in {r.doc_id for r in plain.select("doc_id").collect()}
    assert P.pack(spark, wide, SF).count() == P.pack(spark, plain, SF).count()


def test_oracles_of_the_corpus_queries(spark):
    import duckdb

    from quillmesh.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in ("documents", "pages", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in ORACLES.items():
        mine = QUERIES[name](spark, SF)
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(mine.columns)
        assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in mine.collect()), name
