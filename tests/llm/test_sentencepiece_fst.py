import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")

from quillmesh.llm.sentencepiece_fst import PieceMachine, encode_documents, machine  # noqa: E402

TEXTS = ["", " ", "Hello world", "  Hello   world\n\tx ", "é中😀", "▁a", "<s>a</s><unk><0x41>", "aaaaaaaaaaaa", "Thntblere of then, edtioner\nin inea", "ÉTÉ ß 12345", "a" * 300, "\n\n", "x\n", " lead", "trail ", "won't stop-now", "\x00​﻿"]


def reference():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_the_shortest_path_is_the_library_encoding():
    lib, own = reference(), machine()
    for t in TEXTS:
        assert own.encode(t).tolist() == lib.encode(t), t
        assert own.decode(own.encode(t)) == lib.decode(lib.encode(t)), t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabcdehilnorstuéü ▁ .,\n#1中"), max_size=60))
def test_random_texts(text):
    assert machine().encode(text).tolist() == reference().encode(text)


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "y"), (3, TEXTS[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    full = encode_documents(df).collect()
    lib = reference()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in full) == sorted((str(d), lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for d, t, _ in rows)
    for r in encode_documents(df, digest=True).collect():
        text = TEXTS[r.doc_id] if r.doc_id is not None else ""
        assert r.n_ids == len(lib.encode(text)) and r.decoded_crc32 == zlib.crc32(lib.decode(lib.encode(text)).encode())
        assert r.round_trip == ("▁" not in text)
    assert encode_documents(df.limit(0)).collect() == []


def test_whole_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = reference()
    for r in encode_documents(df).join(df, "doc_id").collect():
        assert r.ids == lib.encode(r.text) and r.decoded == r.text


# Unigram models, with and without a character map: built by hand, held against the library


def _number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    return _number(number << 3) + _number(value)


def unigram(byte_fallback, squeeze=1, charsmap=b"", seed=1):
    rng = random.Random(seed)
    pieces = {"▁", *"abcdeé中", "▁a", "ab", "abc", "▁ab", "bc", "cd", "▁▁", "de", "cde", "▁cde", "aa", "aaaa", "éa", ".", "▁.", "bcde", "fi"}
    own = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    own += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    own += [(p, -round(rng.uniform(1, 9), 2), 1) for p in sorted(pieces)]
    out = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in own)
    out += _field(2, _field(3, 1) + (_field(35, 1) if byte_fallback else b""))
    return out + _field(3, (_field(2, charsmap) if charsmap else b"") + _field(3, 1) + _field(4, squeeze) + _field(5, 1))


def nfkc():
    import sentencepiece

    from quillmesh.llm.sentencepiece_fst import _fields

    spec = dict(_fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    return dict(_fields(spec))[2]


@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("mapped", [False, True])
def test_unigram_paths_are_the_cheapest_and_the_library_encoding(byte_fallback, squeeze, mapped):
    import sentencepiece

    raw = unigram(byte_fallback, squeeze, nfkc() if mapped else b"")
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=raw), PieceMachine(raw)
    rng = random.Random(5)
    texts = ["", " ", "   ", "a  b ", " abcde", "xyz", "x y", "a\nb", "ﬁ ａｂ　c", "é é", "abcde" * 40, "中中 q", "\tabc  cd", "a x"]
    texts += ["".join(rng.choice("aaabcde é中x.\nﬁ") for _ in range(rng.randint(1, 70))) for _ in range(400)]
    price_of = lambda ids: sum(-own.floor if i in own.byte_of or i == own.unknown else float(own.cost[i]) for i in ids)
    same = 0
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        want = lib.encode(text)
        same += ids.tolist() == want
        # Orders of the same pieces tie; the library's rounding then decides by what came before.
        assert sorted(ids.tolist()) == sorted(want) or abs(price_of(ids.tolist()) - price_of(want)) < 1e-4, text
        assert own.decode(ids) == lib.decode(want)
    assert same > 0.9 * len(texts)
    if not mapped and not squeeze and byte_fallback:
        price = lambda ids: sum(-own.floor if i in own.byte_of else own.cost[i] for i in ids)
        for text in texts[:60]:
            norm = own.normalise(text)
            best = [0.0] + [float("inf")] * len(norm)
            for j in range(1, len(norm) + 1):
                best[j] = min([best[i] + own.cost[own.lexicon[norm[i:j]]] for i in range(j) if norm[i:j] in own.lexicon] + ([] if norm[j - 1] in own.lexicon else [best[j - 1] - own.floor]))
            ids = own.encode(text).tolist()
            spelt = sum((len(c.encode()) - 1) * -own.floor for c in norm if c not in own.lexicon)
            assert abs(price(ids) - spelt - best[-1]) < 1e-3


def test_long_stretches_take_the_same_paths():
    own = machine()
    for text in ("▁" + "therefore" * 20, "▁x" + "中é" * 40, "▁" + "ab" * 24):
        assert own._paths([text[:48]]) == [np.array(own._path(text[:48]), "<i4").tobytes()]
    lib, rng = reference(), random.Random(2)
    texts = ["".join(rng.choice("etaoinshr中é") for _ in range(rng.randint(49, 400))) for _ in range(60)]
    assert [i.tolist() for i in own.encode_all(texts)] == lib.encode(texts)


def test_pairs_of_pieces_as_by_the_rule():
    own, rng = machine(), random.Random(8)
    pieces = list(own.right)
    p, q = (np.array([rng.choice(pieces) for _ in range(3000)]) for _ in range(2))
    for _ in range(2):  # the second time from the table of known steps
        assert own._stay(p, q).tolist() == [own.stays(int(a), int(b)) for a, b in zip(p, q, strict=True)]
