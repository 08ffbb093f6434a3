import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmesh.llm import infill
from quillmesh.llm.textscan import chunks

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
SCHEMA = "doc_id long, text string, n long, form string, output string, restored string"
TEXTS = [
    None, "", "a", "é", "two words", "naïve café\n\tΩmega — 𝒳yz  ", "x<P>y", "<M>", "a<S", "<<S>>", "P>", "<" * 40, "<P" * 9, "S>" * 9 + "<", "ab" * 4000, "\x00a\x00", "\r\n" * 5,
    "one, two; three " * 300, "中文字 mixed テキスト " * 50, "a<s>b<m>c", "end<", "<>", "<P >", "Q" * 70_000 + "é" + "1" * 5,
]


def brute(doc, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    w = TOKEN.findall(text)
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(w), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(w), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_whole_table_against_brute_force(spark):
    rows = [(i, t, 7, "x", "y", "z") for i, t in enumerate(TEXTS * 12)] + [(3, "again", 0, None, None, None)] * 2 + [(None, "no id", 0, None, None, None), (-5, "negative id", 0, None, None, None)]
    got = infill.restored(infill.fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()
    assert len(got) == len(rows)
    want = sorted(repr((d, *brute(d, t), t or "")) for d, t, *_ in rows)
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_digests_of_the_query(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for r in infill.fim_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.restored_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(brute(r.doc_id, TEXTS[r.doc_id])[4].encode()).hexdigest()


def test_empty_table_and_null_outputs(spark):
    assert infill.fim_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = infill.restored(spark.createDataFrame([(None, None), ("ab", None), ("<P>a<S>c<M>b", "psm")], "output string, form string")).collect()
    assert sorted(r.restored for r in got) == ["", "ab", "abc"]


def test_every_cut_of_one_chunk():
    texts = pa.array(["ab, cd", "é", "", "z9"])
    (_, _, data, offsets), = chunks(texts)
    start = infill.token_starts(data, offsets)
    for r, text in enumerate(texts.to_pylist()):
        w = TOKEN.findall(text)
        assert int(start[offsets[r] : offsets[r + 1]].sum()) == len(w)
        for k in range(len(w) + 1):
            units = np.zeros((4, 1), np.int64)
            units[r] = k
            assert bytes(data[offsets[r] : infill.cuts(start, offsets, units)[r, 0]]).decode() == "".join(w[:k])


def test_hashes_of_a_key(spark):
    got = spark.range(3).select(*infill.hashes_of(F.col("id"), 9)).collect()
    for i, r in enumerate(got):
        x = hashlib.sha256(f"9:{i}".encode()).hexdigest()
        assert list(r) == [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
