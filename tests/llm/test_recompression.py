import hashlib
import random
import re

import numpy as np
import pytest

from quillmesh.llm import recompression
from quillmesh.llm.recompression import deduplicated_documents, remove_repeats, signs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, kept string, version int, doc string"


def brute(rows, width):
    """(id, n_words, n_removed, kept) of each row, straight from the definition."""
    last = 1 << 62
    docs = [(last if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            first[key] = min((d, s), first.get(key, (d, s)))
    out = []
    for (d, w), (real, _) in zip(docs, rows, strict=True):
        gone = {p for s in range(len(w) - width + 1) if first[tuple(w[s : s + width])] < (d, s) for p in range(s, s + width)}
        out.append((real, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def compare(spark, rows, width, parts=3, slots=recompression.SLOTS):
    df = spark.createDataFrame([(d, t, "x", "y", 1, "z") for d, t in rows], SCHEMA).repartition(parts)
    got = remove_repeats(df, width=width, slots=slots).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, width)))
    return got


def corpus(seed, words):
    """Texts with shared passages, copies, near copies, and repeats within a text."""
    rng = random.Random(seed)
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [pick(rng.randint(5, 60)) for _ in range(6)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randint(1, 5)):
            t += rng.choice([*passages, pick(rng.randint(0, 40))])
        texts.append(t)
    for _ in range(20):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, 2)):
            if t:
                t[rng.randrange(len(t))] = "edit"
        texts.append(t)
    rng.shuffle(texts)
    return [(i, rng.choice([" ", "\n", " \t "]).join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "words", "width"), [(1, [f"w{i}" for i in range(500)], 20), (2, ["a", "b"], 6), (3, ["a", "b", "c", "dé"], 20), (4, ["x"], 20), (5, [f"v{i}" for i in range(30)], 4), (6, ["p", "q"], 63)])
def test_against_brute_force(spark, seed, words, width):
    got = compare(spark, corpus(seed, words), width)
    assert any(r.n_removed for r in got)


def test_regular_texts(spark):
    morse = ["a"]
    while len(morse) < 600:
        morse += ["b" if x == "a" else "a" for x in morse]
    rows = [(0, "a " * 500), (1, "a b " * 300), (2, "a b c a b " * 90), (3, " ".join(morse)), (4, " ".join(morse[5:])), (5, "a " * 19), (6, "a " * 20), (7, "a " * 30 + "b " * 30 + "a " * 30)]
    compare(spark, rows, 20)


def test_many_false_hints_change_nothing(spark):
    compare(spark, corpus(7, [f"w{i}" for i in range(40)]), 20, slots=3)


def test_several_chunks_and_partitions(spark, monkeypatch):
    rows = corpus(8, [f"w{i}" for i in range(60)]) + [(1000 + i, t) for i, (_, t) in enumerate(corpus(8, [f"w{i}" for i in range(60)]))]
    one = compare(spark, rows, 20, parts=1)
    many = compare(spark, list(reversed(rows)), 20, parts=9)
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"u{i % 7001}" for i in range(30_000))
    rows = [(None, None), (1, ""), (2, " \n\t "), (3, text), (3, text), (3, "start " + text), (4, text), (None, text), (None, text), (None, "other " + text), (5, "x\xa0y " * 20), (-1, long), (6, "w1 " * 19)]
    compare(spark, rows, 20)


def test_query_and_empty_table(spark):
    schema = "doc_id long, text string"
    assert deduplicated_documents(spark.createDataFrame([], schema)).collect() == []
    rows = corpus(9, [f"w{i}" for i in range(200)])
    want = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows, 20)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in deduplicated_documents(spark.createDataFrame(rows, schema)).collect()} == want


def test_equal_windows_have_the_same_sign():
    rng = np.random.default_rng(3)
    for symbols in (2, 3, 50):
        part = rng.integers(1, symbols + 1, 120).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        one = np.concatenate([rng.integers(1, 9, 37).astype(np.uint64), part, part[:3]])
        two = np.concatenate([part[-5:], part, rng.integers(1, 9, 11).astype(np.uint64)])
        both = np.concatenate([one, two])
        starts, name, first, length = signs(both, np.array([0, len(one), len(both)]))
        at = {s: (n, f - s, k) for s, n, f, k in zip(starts.tolist(), name.tolist(), first.tolist(), length.tolist(), strict=True)}
        for i in range(101):
            assert at[37 + i] == at[len(one) + 5 + i]
        assert all(f >= s and f + k <= s + 20 for s, f, k in zip(starts, first, length, strict=True))


def test_signs_are_sparse():
    words = np.random.default_rng(4).integers(1, 1 << 63, 50_000).astype(np.uint64)
    _, _, first, length = signs(words, np.array([0, len(words)]))
    assert len(np.unique(first * 64 + length)) < len(words) / 6


def test_texts_are_shuffled_once(spark):
    df = spark.createDataFrame(corpus(10, ["a", "b", "c"]), "doc_id long, text string")
    out = remove_repeats(df)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_packed_places():
    for places in ([], [0, 5, (1 << 32) - 1], [3, 1 << 32, 1 << 40]):
        assert recompression._places(recompression._packed(np.array(places, np.int64))).tolist() == places
