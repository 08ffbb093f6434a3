import itertools
import random

import numpy as np
import pyarrow as pa

from quillmesh.llm import line_crf as L
from quillmesh.llm.textscan import chunks
from tests.llm.test_classifiers import brute_counts, messy, prose


def brute_path(field, x):
    best = None
    for labels in itertools.product((0, 1), repeat=len(x)):
        s = field.start[labels[0]] + sum(float((v * field.weight).sum()) for v, y in zip(x, labels, strict=True) if y) + sum(field.step[a, b] for a, b in itertools.pairwise(labels))
        best = max(best or (-1e9, labels), (s, labels))
    return best


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 5, 3, 0, 8, 2, 8]
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(size=(first[-1], len(L.FEATURES))).astype(np.float32)
    field = L.Field(rng.normal(size=len(L.FEATURES)).astype(np.float32).astype(float), rng.normal(size=(2, 2)), rng.normal(size=2))
    got = L.viterbi(field, x, first)
    for i, n in enumerate(sizes):
        if n:
            assert tuple(got[first[i] : first[i + 1]]) == brute_path(field, x[first[i] : first[i + 1]])[1]


def test_fitting_matches_brute_force_likelihood():
    """The fitted weights are where the penalised likelihood, summed over all labellings, is highest."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 5, 40)
    first = np.concatenate([[0], np.cumsum(sizes)])
    y = (rng.random(first[-1]) < 0.5).astype(int)
    for i in range(1, len(y)):  # labels that tend to stay
        y[i] = y[i - 1] if rng.random() < 0.6 else y[i]
    x = rng.normal(size=(first[-1], 3))
    x[:, 1] += y
    field = L.fit_field(x, first, y, rounds=400, rate=0.05)

    def likelihood(theta):
        weight, step, start = theta[:3], theta[3:7].reshape(2, 2), theta[7:]
        total = 0.0
        for a, b in itertools.pairwise(first):
            of = lambda z: start[z[0]] + sum(x[a + i] @ weight for i, v in enumerate(z) if v) + sum(step[u, v] for u, v in itertools.pairwise(z))  # noqa: B023,E731
            every = [of(z) for z in itertools.product((0, 1), repeat=int(b - a))]
            total += of(tuple(y[a:b])) - np.logaddexp.reduce(every)
        return total / len(x) - 0.001 * theta @ theta

    theta = np.concatenate([field.weight, field.step.reshape(-1), field.start])
    best = likelihood(theta)
    for i in range(len(theta)):
        for d in (-0.05, 0.05):
            moved = theta.copy()
            moved[i] += d
            assert likelihood(moved) < best + 1e-5


def taught(spark, rng):
    lined = lambda junk: "\n".join(prose(rng, junk) for _ in range(5))
    docs = spark.createDataFrame([(i, lined(i % 4 == 0)) for i in range(300)], "doc_id long, text string")
    return L.learn(docs, spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)], "doc_id long, quality int"))


def test_mixed_documents_get_mixed_labels(spark):
    rng = random.Random(21)
    field = taught(spark, rng)
    assert abs(field.step[0, 1]) > 0.05 and abs(field.step[1, 0]) > 0.05
    texts, want = [], []
    for i in range(120):
        lines = [(prose(rng, False), 1) for _ in range(rng.randint(1, 5))]
        at = rng.randint(0, len(lines))
        other = [(t, 0) for t in (L.furniture(rng.randint(1, 4), 1000 + i) if i % 2 else [prose(rng, True) for _ in range(rng.randint(1, 3))])]
        lines[at:at] = other
        texts.append("\n".join(t for t, _ in lines))
        want += [y for _, y in lines]
    (_, _, data, offsets), = list(chunks(pa.array(texts)))
    x, words, first = L.line_features(data, offsets)
    got = L.viterbi(field, x, first)
    assert (got == want).mean() > 0.9
    mixed = [len(set(got[a:b].tolist())) == 2 for a, b in itertools.pairwise(first)]
    assert np.mean(mixed) > 0.7
    share = [r.content_share for r in L.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).collect()]
    assert np.mean([0 < s < 1 for s in share]) > 0.7


def test_ties_and_long_texts(spark):
    zero = L.Field(np.zeros(len(L.FEATURES)), np.zeros((2, 2)), np.zeros(2))
    rows = [(1, "a b c\nd e f"), (2, "word " * 300_000), (3, "\n".join(f"line {i} has its own words." for i in range(60_000)))]
    got = {r.doc_id: r for r in L.judge(spark.createDataFrame(rows, "doc_id long, text string"), zero).collect()}
    assert all(r.content_share == 1 for r in got.values())  # every path ties: content
    assert got[2].n_words == 300_000 == got[2].n_repeat_words and got[2].base_failed
    assert got[3].n_words == 360_000 and got[3].n_dup_lines == 0


def test_line_features_do_not_depend_on_neighbours():
    texts = messy(4, 40)
    (_, _, data, offsets), = list(chunks(pa.array(texts, pa.string())))
    x, words, first = L.line_features(data, offsets)
    assert np.isfinite(x).all() and len(x) == first[-1] == len(words)
    for i in (8, 12, 20, 33):
        (_, _, d, o), = list(chunks(pa.array([texts[i]], pa.string())))
        assert np.allclose(L.line_features(d, o)[0], x[first[i] : first[i + 1]])


def test_documents(spark):
    rng = random.Random(8)
    lined = lambda junk: "\n".join(prose(rng, junk) for _ in range(4))
    texts = [lined(i % 4 == 0) for i in range(400)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(400 + i, t, "x") for i, t in enumerate(messy(5, 60))] + [(None, "a\nb", "x"), (7, texts[7], "x"), (900, "same line of words here " * 30, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = L.quality_rules(df, labels).collect()
    assert len(got) == len(rows)
    text_of = {d: t for d, t, _ in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text_of[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    right = [r.kept == (r.doc_id % 4 != 0) for r in got if r.doc_id is not None and 200 <= r.doc_id < 400]
    assert np.mean(right) > 0.97
    assert next(r for r in got if r.doc_id == 900).base_failed
    assert L.quality_rules(df.limit(0), labels.limit(0)).collect() == []
    assert len(L.quality_rules(df, labels.limit(0)).collect()) == len(rows)


def test_regular_lines_are_not_taken_for_equal():
    from quillmesh.llm.docstats import base_counts

    t = "a"
    while len(t) < 1024:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    rows = [f"{t}\n{u}", f"{t}\n{u}\n{t}", " ".join([t, *"bcdefgh", u, *"bcdefgh"])]
    assert list(base_counts(pa.array(rows))) == [brute_counts(r) for r in rows]
