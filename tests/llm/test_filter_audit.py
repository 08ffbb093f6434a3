import itertools
import re
from collections import Counter

from quillmesh.llm.filter_audit import FILTERS, audit_filters, flagged, survivors

DOCS = "doc_id long, text string, source string, part string, n long, A string"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {f for f, bad in zip("ABCD", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text))), strict=True) if bad}


def brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = [(s or "", fails(t) | ({"E"} if d is not None and d > least[t or ""] else set()), d in good, d in toxic) for d, t, s, *_ in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own, shares = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, itertools.permutations(FILTERS)):
            alive = own
            for step, f in enumerate(order, 1):
                gone, alive = [r for r in alive if f in r[1]], [r for r in alive if f not in r[1]]
                shares[f] += len(gone)
                out[part, order, step] = [len(alive), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shares[v[6]] if isinstance(v[6], str) else v[6]
    return out


def sample():
    long = " ".join(f"word{i}" for i in range(80))
    texts = [long, "short", None, "", "A B C", long + " $", "same word " * 60, "SHOUT " + long, long + "\xa0é", "x # y", " ".join(f"w{i}" for i in range(20_000)), "Ab" * 30_000]
    docs = [(i, texts[i % 12 if i % 5 else 0], [None, "", "hot", "b"][min(i % 7, 3)], "x", 1, "y") for i in range(150)]
    docs += [(3, "short", "b", "x", 1, "y"), (3, "short", "b", "x", 1, "y"), (None, "short", "c", "x", 1, "y"), (None, long, "c", "x", 1, "y")]
    labels = [(i, i % 3 % 2, int(i % 4 == 0)) for i in range(0, 150, 2)] + [(4, 0, 1), (4, 1, 0), (999, 1, 1), (None, 1, 1), (6, None, None)]
    return docs, labels


def test_every_order_against_brute_force(spark):
    docs, labels = sample()
    got = audit_filters(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(docs, labels)
    assert len(got) == len(want) == 600 * 4
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step], r
    assert any(r.good_lost for r in got) and any(r.toxic_lost for r in got) and any(r.unique_fails for r in got)


def test_survivors_of_each_subset(spark):
    docs, labels = sample()
    counts = flagged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    n = {(r.part, r.passed): r.n for r in survivors(counts).collect()}
    assert sum(n[p, 0] for p in {p for p, _ in n}) == len(docs)
    assert all(n[p, s] <= n[p, 0] for p, s in n)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit_filters(spark.createDataFrame([], DOCS), none).collect() == []
    got = audit_filters(spark.createDataFrame([(1, None, None, None, None, None)], DOCS), none).collect()
    assert len(got) == 600 and sum(r.removed for r in got) == 120 and {r.part for r in got} == {""}
