import random
import re

import pytest

from quillmesh.llm import metric_join as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    pairs = {(a, b) for v in index.values() for n, a in enumerate(v) for b in v[n + 1 :]}
    for a, b in pairs:
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = find(rows[a][0]), find(rows[b][0])
            up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for (d, _), s in zip(rows, sets, strict=True)}


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocab) for _ in range(40)]
    texts = [None, "", " \n\t ", "One", "one", "two words", "Two  WORDS", "a b c d", "A B c d", "a b c d e", "naïve Été x y", "naïve été x y"]
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([8, 30, 120, 600]))]
        if rng.random() < 0.5:
            base += shared
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    base = [rng.choice(vocab) for _ in range(150)]
    for _ in range(90):  # a group of near copies whose links form chains
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
@pytest.mark.parametrize("small", [False, True])
def test_components_match_brute_force(spark, monkeypatch, k, num, den, small):
    if small:
        monkeypatch.setattr(M, "LOCAL_DOCS", 30)  # the distributed rounds
        monkeypatch.setattr(M, "PIVOTS", 4)
    rows = corpus()
    hot = {"hot_cell": 5} if small else {}  # cells with more go to the rounds as they are
    got = M.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, num, den, **hot).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, num, den)
    assert len(got) == len(rows)


def test_every_link_shares_a_cell():
    import numpy as np

    rng = np.random.default_rng(0)
    for num, den in ((85, 100), (80, 100)):
        for n in (1, 2, 5, 6, 7, 13, 40, 200, 1000):
            for _ in range(30):
                x = np.unique(rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
                y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.08], rng.integers(0, (1 << 64) - 1, rng.integers(0, 1 + n // 10), dtype=np.uint64)]))
                inter = len(np.intersect1d(x, y))
                if inter and not np.array_equal(x, y) and den * inter >= num * (len(x) + len(y) - inter):
                    a, b = (np.concatenate([M.cells_of(v, c, num, den) for c in M.registers(len(v), num, den)]) for v in (x, y))
                    assert len(np.intersect1d(a, b))


def test_empty_repeated_and_clashing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.jaccard_components(none).collect() == []
    rows = [(5, "a b c d e f", "k"), (5, "a b c d e f", "k"), (2, "a b c d e f", "n"), (None, "a b c d", "n"), (9, None, None)]
    got = M.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(5, 3, 2), (5, 3, 2), (2, 3, 2), (None, None, None), (9, 0, 9)], key=str)


def planted(seed, groups=6, size=70, words=160):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"v{rng.randrange(3000)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(3000)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


def brute_roots(links):
    roots = list(range(len(links)))
    for i in range(len(links)):
        for j in range(i):
            if links[i][j] and roots[i] != roots[j]:
                a, b = max(roots[i], roots[j]), min(roots[i], roots[j])
                roots = [b if r == a else r for r in roots]
    return roots


def test_links_come_from_pivots_and_regions():
    import numpy as np
    import pyarrow as pa

    from quillmesh.llm.textscan import shingle_sets

    sets = [own for _, own, _ in shingle_sets(pa.array(planted(4)), 4)]
    full = [set(s.tolist()) for s in sets]
    links = [[100 * len(x & y) >= 85 * len(x | y) for y in full] for x in full]
    counts = {}
    got = M.voronoi_join(M.SetSpace(sets, 85, 100), counts)
    assert got == brute_roots(links)
    assert counts["pivots"] > 4 * counts.get("blocks", 0) and counts["regions"] > 5
    sketches = [M.sketch_of(s) for s in sets]
    near, far = M.SketchSpace(sketches, 85, 100), M.SetSpace(sets, 85, 100)
    every = np.arange(len(sets))
    for p in range(0, len(sets), 37):
        (a, may), (b, must) = near.measured(p, every), far.measured(p, every)
        assert (a <= b + 1e-9).all() and (may | ~must).all()
    assert M.voronoi_join(near) == brute_roots(near.linked(every))


def test_regular_strings_are_not_taken_for_equal(spark):
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    texts = [t, t.translate(str.maketrans("ab", "ba")), t[:1024], t[1024:], t]
    got = M.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.component_id for r in got) == [0, 0, 1, 2, 3]


def test_one_document_of_long_text(spark):
    rng = random.Random(3)
    words = [f"x{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:190_000])), (3, " ".join(words[:150_000]))]
    got = M.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_sketches_of_very_large_sets_stay_lower_bounds():
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, (1 << 64) - 1, 6_000_000, dtype=np.uint64))
    sets = [x, x[rng.random(len(x)) > 0.05], np.unique(rng.integers(0, (1 << 64) - 1, 1000, dtype=np.uint64))]
    sketches = [M.sketch_of(v) for v in sets]
    assert [s[0] for s in sketches] == [4, 4, 1] and [M.counts_of(s).sum() for s in sketches] == [len(v) for v in sets]
    every = np.arange(3)
    (near, may), (far, must) = M.SketchSpace(sketches, 85, 100).measured(0, every), M.SetSpace(sets, 85, 100).measured(0, every)
    assert (near <= far + 1e-9).all() and must[1] and (may | ~must).all()
