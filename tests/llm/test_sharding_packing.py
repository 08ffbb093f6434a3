import zlib
from collections import Counter

import numpy as np
import pytest

from quillmesh.llm.packing import binary_cuts, byte_bpe, pack_power_of_two
from quillmesh.llm.sharding import shard_documents


def docs(spark):
    rows = [(i, None if i % 41 == 0 else f"text {i % 50} " * (i % 7), ["hot", "b", "c", None][min(i % 9, 3)] if i % 3 else "hot", "x") for i in range(500)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")


def test_shards_follow_the_mixture(spark):
    rows, df = docs(spark)
    got = shard_documents(df).collect()
    assert sorted(r.doc_id for r in got) == list(range(500))
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    mixture = Counter(r[2] for r in rows)
    for (source, s), n in Counter((r.source, r.shard) for r in got).items():
        assert abs(n - mixture[source] / 8) < 1.5, (source, s, n)
    for r in got:
        raw = (rows[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    again = shard_documents(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in got)


def test_interleaving_matches_brute_force(spark):
    rows, df = docs(spark)
    from pyspark.sql import functions as F

    h = {r.doc_id: (r.h, r.s) for r in df.select("doc_id", F.xxhash64(F.col("doc_id"), F.lit(17)).alias("h"), F.xxhash64(F.col("source"), F.lit(17)).alias("s")).collect()}
    order = []
    for source in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == source), key=lambda r: h[r[0]][0])
        order += [((i + 0.5) / len(own), h[r[0]][1], i, r[0]) for i, r in enumerate(own)]
    order.sort()
    want = {d: p * 8 // 500 for p, (*_, d) in enumerate(order)}
    assert {r.doc_id: r.shard for r in shard_documents(df).collect()} == want


def test_shards_of_few_repeated_and_no_rows(spark):
    schema = "doc_id long, text string, source string"
    assert shard_documents(spark.createDataFrame([], schema)).collect() == []
    got = shard_documents(spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (None, None, None)], schema)).collect()
    assert len(got) == 3 and max(Counter(r.shard for r in got).values()) == 1


def test_binary_cuts():
    for n in (0, 1, 2, 3, 1023, 1024, 1025, 5000):
        cuts = binary_cuts(n)
        at = 0
        for start, length in cuts:
            assert start == at and length & (length - 1) == 0 and length <= 1024
            at += length
        assert at == n


def test_packing_against_the_public_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows, df = docs(spark)
    long = "Ça va? " * 3000 + "naïve <|endoftext|> 12345\n\n\t  x" + "a" * 5000
    df = df.unionByName(spark.createDataFrame([(500, long, "b", "x")], df.schema))
    rows.append((500, long, "b", "x"))
    marked = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y <|endoftext|", "<|endoftext |> <| endoftext|>"]
    df = df.unionByName(spark.createDataFrame([(600 + i, t, "b", "x") for i, t in enumerate(marked)], df.schema))
    rows += [(600 + i, t, "b", "x") for i, t in enumerate(marked)]
    assert byte_bpe()("a <|endoftext|> b") == [64, 220, 50256, 275]
    got = pack_power_of_two(df).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert all(r.offset == 0 for r in got)
    by_length = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert by_length == sorted(by_length, reverse=True)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert len(pieces) == len(rows)
    for doc, text, *_ in rows:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[doc], key=lambda r: r.start)
        assert [(r.start, r.length) for r in own] == binary_cuts(len(ids))
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_packing_edge_tables(spark):
    schema = "doc_id long, text string"
    assert pack_power_of_two(spark.createDataFrame([], schema)).collect() == []
    got = pack_power_of_two(spark.createDataFrame([(None, None), (3, ""), (3, "")], schema)).collect()
    assert sorted((r.doc_id or 0, r.length, r.doc_tokens) for r in got) == [(0, 1, 1), (3, 1, 1), (3, 1, 1)]
    assert byte_bpe()("") == []
