import random

import numpy as np

from quillmesh.llm import hdc_language, quality_trees
from quillmesh.llm.docstats import FEATURES, base_counts, feature_rows
from quillmesh.operators import forest as forests
import pyarrow as pa
import re


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(int)
    forest = forests.fit(x[:2000], y[:2000])
    p = forest.probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.97
    for i in range(20):  # one row, one tree at a time
        total = forest.base
        for t in range(len(forest.leaf)):
            node = 0
            for _ in range(4):
                node = 2 * node + 1 + int(x[i, forest.column[t, node]] > forest.cut[t, node])
            total += forest.leaf[t, node - 15]
        assert abs(total - forest.margin(x[i : i + 1])[0]) < 1e-9


def test_trees_without_two_labels():
    assert 0 < forests.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3)))[0] < 1
    assert forests.fit(np.ones((4, 3)), np.ones(4)).probability(np.zeros((1, 3)))[0] > 0.7


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def messy(seed, n=120):
    rng = random.Random(seed)
    alphabet = ["a", "b", "Ça", "über", "#", "|x|", "\n", "\n", "\t", " ", "\r\n", "end.", "\x0b", " nb", "😀", "$$", "a b c d e f g h", "line one\n"]
    out = [None, "", "\n", "\n\n", " ", "a", "x\n", "\nx", "same line\nsame line\n\nsame line"]
    return out + [rng.choice(["", " "]).join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(n)]


def test_base_counts_match_brute_force():
    texts = messy(1)
    assert list(base_counts(pa.array(texts, pa.string()))) == [brute_counts(t) for t in texts]
    assert list(base_counts(pa.array(texts, pa.string()).slice(7, 30))) == [brute_counts(t) for t in texts[7:37]]


def test_features_are_finite_and_local():
    texts = messy(2)
    every = np.concatenate(list(feature_rows(pa.array(texts, pa.string()))))
    assert every.shape == (len(texts), len(FEATURES)) and np.isfinite(every).all()
    for i in (0, 1, 8, 20, 50):
        alone = np.concatenate(list(feature_rows(pa.array([texts[i]], pa.string()))))
        assert np.allclose(alone[0], every[i])


def prose(rng, junk):
    words = [rng.choice(["the", "and", "of"]) if rng.random() < 0.4 else "".join(rng.choice("abdeilnorst") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(20, 200))]
    return " ".join(w + "###" if junk and rng.random() < 0.6 else w for w in words) + "."


def test_quality_held_out(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, i % 4 == 0), "x") for i in range(600)] + [(600, None, "x"), (601, "", "x"), (None, "a b", "x"), (5, "twice", "x")]
    labels = [(i, int(i % 4 != 0), "z") for i in range(500)] + [(3, None, "z"), (None, 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = quality_trees.quality_of_documents(df, spark.createDataFrame(labels, "doc_id long, quality int, stats string")).collect()
    assert len(got) == len(rows)
    import zlib

    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    judged = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out and r.doc_id != 5]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in judged]) > 0.95
    none = quality_trees.quality_of_documents(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert none == []
    assert len(quality_trees.quality_of_documents(df, spark.createDataFrame([], "doc_id long, quality int")).collect()) == len(rows)


def test_labels_of_held_out_rows_change_nothing(spark):
    import zlib

    rng = random.Random(6)
    df = spark.createDataFrame([(i, prose(rng, i % 3 == 0)) for i in range(300)], "doc_id long, text string")
    out = []
    for flip in (False, True):
        labels = [(i, int((i % 3 != 0) != (flip and zlib.crc32(str(i).encode()) % 4 == 2))) for i in range(300)]
        out.append(sorted((r.doc_id, r.score) for r in quality_trees.quality_of_documents(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()))
    assert out[0] == out[1]


def test_languages_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hdc_language.language_of_documents(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and held and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    again = {r.doc_id: (r.lang_pred, r.score) for r in hdc_language.language_of_documents(df.repartition(5)).collect()}
    assert all(again[r.doc_id][0] == r.lang_pred and abs(again[r.doc_id][1] - r.score) < 1e-5 for r in got)


def test_trigram_counts_match_brute_force():
    texts = ["Ab, c", None, "", "12!", "été  x"]
    codes, counts = hdc_language.trigram_counts(texts)
    kinds = hdc_language.letter_classes()
    for text, row in zip(texts, counts, strict=True):
        marked = []
        for c in " " + (text or "").lower() + " ":
            k = int(kinds[ord(c)])
            if k or not marked or marked[-1]:
                marked.append(k)
        want = {}
        for i in range(len(marked) - 2):
            if any(marked[i : i + 3]):
                code = marked[i] << 12 | marked[i + 1] << 6 | marked[i + 2]
                want[code] = want.get(code, 0) + 1
        assert {int(c): int(n) for c, n in zip(codes, row, strict=True) if n} == want


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "fr"), (3, "42 !!", "en"), (4, "hello there friend", None), (None, "hello", "en"), (6, "x" * 200000, "en")] + [(10 + i, "the house and the garden of the king", "en") for i in range(30)] + [(50 + i, "la maison et le jardin du roi sont ici", "fr") for i in range(30)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in hdc_language.language_of_documents(df).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[3].score == 0
    assert got[12].lang_pred == "en" and got[52].lang_pred == "fr" and got[None].held_out is False
    nothing = hdc_language.identify(df, ([], np.zeros((0, hdc_language.DIMENSION)))).collect()
    assert len(nothing) == len(rows) and {r.lang_pred for r in nothing} == {"und"}
    assert hdc_language.language_of_documents(df.limit(0)).collect() == []


def test_runs_of_many_trigrams_are_halved(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300)) for _ in range(40)] + [None, "abc"]
    whole = hdc_language._nearest(texts, ["a", "b"], np.random.default_rng(1).normal(size=(hdc_language.DIMENSION, 2)).astype(np.float32))
    monkeypatch.setattr(hdc_language, "COUNT_CELLS", 20_000)
    runs = [(i, j) for i, j, *_ in hdc_language.counted(texts)]
    assert len(runs) > 4 and runs[0][0] == 0 and runs[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    halved = hdc_language._nearest(texts, ["a", "b"], np.random.default_rng(1).normal(size=(hdc_language.DIMENSION, 2)).astype(np.float32))
    assert halved[0] == whole[0] and np.allclose(halved[1], whole[1], atol=1e-5)


def brute_features(text):
    """FEATURES of one text, a value at a time."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = raw.split(b"\n")
    full = [x for x in lines if re.search(rb"[^\x20\x09-\x0D]", x)]
    share = lambda of: sum(b in of for b in raw) / max(len(raw), 1)
    n, sizes = max(len(words), 1), [len(w) for w in words]
    mean = sum(sizes) / n
    fours = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
    marks = b".,;:?"
    lower, upper = set(range(97, 123)), set(range(65, 91))
    in_line = [len(re.findall(rb"[^\x20\x09-\x0D]+", x)) for x in lines]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), mean, (sum(s * s for s in sizes) / n - mean**2) ** 0.5 if words else 0, np.log1p(max(sizes, default=0)), share(b"\t\x0b\x0c\r "), share(lower), share(upper),
        share(b"0123456789"), share(marks), share(b"#*$%&<>"), share(b"|"), share(b"!"), share(b"'\"()-_/\\@+=~^`[]{}"), share(range(192, 256)), len(lines) / n, len(words) / len(lines), sum(b in marks for b in raw) / n,
        sum(any(b in b"#*$%&|<>" for b in w) for w in words) / n, sum(sum(b in upper for b in w) > 1 and not any(b in lower for b in w) for w in words) / n, len(set(words)) / n if words else 0,
        max((words.count(w) for w in set(words)), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / max(len(words) - 1, 1), (len(fours) - len(set(fours))) / max(len(fours), 1),
        (len(full) - len(set(full))) / max(len(full), 1), sum(0 < c < 4 for c in in_line) / max(len(full), 1), float(bool(words) and words[-1][-1] in marks + b"!"),
    ]


def test_statistics_match_brute_force():
    texts = [*messy(3, 60), "One two. Two two!\nTHE END | x", "é" * 30 + " a"]
    got = np.concatenate(list(feature_rows(pa.array(texts, pa.string()))))
    for text, row in zip(texts, got, strict=True):
        want = np.array(brute_features(text))
        assert np.allclose(row, want, atol=1e-4), (text, [(n, a, b) for n, a, b in zip(FEATURES, row, want, strict=True) if abs(a - b) > 1e-4])


def test_a_long_text_is_scored_whole(spark):
    forest = forests.fit(np.concatenate(list(feature_rows(pa.array([prose(random.Random(i), i % 2) for i in range(200)])))).astype(float), np.arange(200) % 2 == 0)
    text = " ".join(prose(random.Random(i), False) for i in range(5000))
    junk = " ".join(prose(random.Random(i), True) for i in range(5000))
    rows = spark.createDataFrame([(1, text), (2, text[:5000] + " " + junk)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_trees.score(rows, forest).collect()}
    assert got[1] > 0.9 and got[2] < 0.1


def test_hyperdimensional_vectors_match_brute_force():
    texts, langs = ["Ab ab, été", "ba ba", "été ici", "AB-ab"], ["x", "x", "y", "x"]
    letters, kinds = hdc_language.letter_vectors().astype(int), hdc_language.letter_classes()

    def bundle(text):
        marked = []
        for c in " " + text.lower() + " ":
            k = int(kinds[ord(c)])
            if k or not marked or marked[-1]:
                marked.append(k)
        out, n = np.zeros(hdc_language.DIMENSION, int), 0
        for a, b, c in zip(marked, marked[1:], marked[2:]):
            if a or b or c:
                out, n = out + np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c], n + 1
        return out, n

    prototypes = {}
    for text, lang in zip(texts, langs, strict=True):
        v, n = bundle(text)
        prototypes[lang] = prototypes.get(lang, 0) + v * (hdc_language.DOCUMENT_WEIGHT // n)
    batch = pa.record_batch([pa.array(texts), pa.array(langs)], ["text", "lang"])
    got = {}
    for b in hdc_language._bundles(iter([batch])):
        for lang, place, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got.setdefault(lang, np.zeros(hdc_language.DIMENSION, int))[place] += total
    assert got.keys() == prototypes.keys() and all((got[k] == prototypes[k]).all() for k in got)
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).T
    found = hdc_language._nearest(["ab été", "ba"], names, matrix.astype(np.float32))
    for text, name, score in zip(["ab été", "ba"], *found, strict=True):
        v, _ = bundle(text)
        cosines = v @ matrix / np.linalg.norm(v)
        assert name == names[int(cosines.argmax())] and abs(score - cosines.max()) < 1e-5


def test_languages_of_one_script_are_told_apart(spark):
    """Invented languages that share a script and differ in which letters are common."""
    rng = random.Random(12)
    rows = []
    for script, (low, high) in {"cyrillic": (0x430, 0x450), "greek": (0x3B1, 0x3CA), "arabic": (0x627, 0x64B), "cjk": (0x4E00, 0x4E80), "latin": (97, 123), "hangul": (0xAC00, 0xAC60)}.items():
        for lang in "abc":
            weights = {c: rng.random() ** 3 for c in range(low, high)}
            stems = ["".join(chr(c) for c in rng.choices(list(weights), list(weights.values()), k=rng.randint(2, 6))) for _ in range(150)]
            rows += [(len(rows) + i, " ".join(rng.choice(stems) for _ in range(40)), f"{script}-{lang}") for i in range(40)]
    got = hdc_language.language_of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {d: lang for d, _, lang in rows}
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_language_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(1, "la casa"), (2, "la casa")], "doc_id long, text string")
    v = hdc_language.bundled(*hdc_language.trigram_counts(["la casa"]), np.float64)[0]
    model = (["aa", "bb"], np.array([v, v]) / np.linalg.norm(v))
    assert [r.lang_pred for r in hdc_language.identify(rows, model).collect()] == ["aa", "aa"]
