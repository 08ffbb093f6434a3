import hashlib
import struct
import zlib

import numpy as np

from quillmesh.llm import telephony as T


def one_mulaw(code):
    """The coding rule, one value at a time."""
    code = ~code & 0xFF
    t = (((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)
    return 0x84 - t if code & 0x80 else t - 0x84


def one_alaw(code):
    code ^= 0x55
    t, seg = (code & 0x0F) << 4, (code & 0x70) >> 4
    t = t + 8 if seg == 0 else (t + 0x108) << max(seg - 1, 0)
    return t if code & 0x80 else -t


def test_tables_and_companding():
    assert [int(x) for x in T.TABLES[T.MULAW]] == [one_mulaw(i) for i in range(256)]
    assert [int(x) for x in T.TABLES[T.ALAW]] == [one_alaw(i) for i in range(256)]
    for tag, table in T.TABLES.items():
        assert (table[T.compand(table, tag)] == table).all()


def one_block(block):
    value, index = int(np.int16(int.from_bytes(block[:2], "little", signed=True))), block[2]
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(T.STEP_SIZES[index])
            d = step >> 3
            d += step if code & 4 else 0
            d += step >> 1 if code & 2 else 0
            d += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - d if code & 8 else value + d))
            index = max(0, min(88, index + int(T.INDEX_CHANGE[code])))
            out.append(value)
    return out


def test_adpcm_blocks_decode_together():
    t = np.arange(4000)
    pcm = (9000 * np.sin(t / 9) + 3000 * np.sin(t / 2.3)).astype("<i2")
    blocks = T.adpcm_encode(pcm)
    got = T.adpcm_decode(blocks)
    assert got.tolist() == [one_block(bytes(b)) for b in blocks]
    back = got.reshape(-1)[: len(pcm)].astype(float)
    assert 10 * np.log10((pcm.astype(float) ** 2).mean() / ((back - pcm) ** 2).mean()) > 20


def test_resampling_keeps_a_tone():
    for rate, to in ((8000, 16000), (8000, 12000), (16000, 8000), (11025, 16000)):
        pcm = (10000 * np.sin(2 * np.pi * 440 * np.arange(rate) / rate)).astype("<i2")
        got = T.resample(pcm, rate, to)
        want = 10000 * np.sin(2 * np.pi * 440 * np.arange(len(got)) / to)
        assert len(got) == -(-rate * to // rate)
        assert np.abs(got - want)[200:-200].max() < 200, (rate, to)


def test_whole_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a" * 64, "x"), (4, "é" * 33, "y"), (5, "long " * 60000, "y"), (6, "a" * 64, "z"), (None, "a", "z"), (3, "a" * 64, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = T.store_audio(df, digest=True).collect()
    assert len(got) == len(rows)
    full = {r.doc_id: r for r in T.store_audio(df).collect()}
    for r in got:
        text = next((t for d, t, _ in rows if d == r.doc_id), "")
        raw = (text or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert r.n_bytes == len(raw) and r.payload_bytes == len(payload) and r.payload_bytes % 64 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        f = full[r.doc_id]
        assert T.read_wave(bytes(f.media))["data"] == payload
        assert r.media_sha256 == hashlib.sha256(f.media).hexdigest() and r.media_bytes == len(f.media)
        tag = T.coding_of(payload, None)
        assert T.read_wave(bytes(f.media))["tag"] == tag and f.feature == r.feature and f.feature.startswith(T.NAMES[tag])
        assert len(f.pcm) == (4 * 121 * len(payload) // 64 if tag == T.IMA_ADPCM else 4 * len(payload))
        if tag == T.IMA_ADPCM and len(payload) < 1000:
            plain = np.concatenate([one_block([*payload[i : i + 2], min(payload[i + 2], 88), *payload[i + 3 : i + 64]]) for i in range(0, len(payload), 64)])
            assert np.frombuffer(f.pcm, "<i2").tolist() == T.resample(plain.astype("<i2"), 8000, 16000).tolist()
    assert len({(r.payload_sha256, r.feature, r.media_sha256) for r in got if r.doc_id in (3, 6)}) == 1
    assert T.store_audio(df.limit(0)).collect() == []


def test_decoding_column(spark):
    pcm = (5000 * np.sin(np.arange(1200) / 5)).astype("<i2")
    blocks = T.adpcm_encode(pcm)
    rows = [(1, T.write_wave(T.compand(pcm, T.ALAW).tobytes(), T.ALAW)), (2, T.write_wave(blocks.tobytes(), T.IMA_ADPCM, bits=4, align=256, samples=1200)), (3, T.write_wave(pcm.tobytes(), T.PCM, bits=16, align=2)), (4, b"junk"), (5, None)]
    got = {r.id: r for r in T.decode_audio(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()}
    for i in (1, 2, 3):
        assert got[i].samples == 2400 and got[i].error is None
        assert np.abs(np.frombuffer(got[i].pcm, "<i2")[::2].astype(int) - pcm).max() < 1000
    assert got[4].error and got[4].pcm is None and got[5].error is None and got[5].samples is None


def test_all_codings_are_met(spark):
    df = spark.createDataFrame([(i, f"text {i} " * (i + 1)) for i in range(60)], "doc_id long, text string")
    assert {r.feature.split()[0] for r in T.store_audio(df, digest=True).collect()} == {"mulaw", "alaw", "adpcm"}
    assert {r.feature.split()[0] for r in T.store_audio(df, law=T.ALAW).collect()} == {"alaw"}


def test_broken_files_say_why(spark):
    good = T.write_wave(b"abcd" * 40, T.MULAW)
    head = lambda tag, channels, rate, align, bits: b"RIFF" + struct.pack("<I", 44) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, channels, rate, rate, align, bits) + b"data" + struct.pack("<I", 8) + b"12345678"
    bad = [good[:20], good[:11], b"", head(T.IMA_ADPCM, 1, 8000, 0, 4), head(T.IMA_ADPCM, 1, 8000, 4, 4), head(T.MULAW, 1, 0, 1, 8), head(T.MULAW, 2, 8000, 1, 8), head(3, 1, 8000, 4, 32), head(T.PCM, 1, 8000, 1, 12), head(T.MULAW, 1, 2**32 - 1, 1, 8), b"RIFF\0\0\0\0WAVEfmt \x02\0\0\0\x01\0"]
    fine = [good, good[: len(good) // 2], head(T.PCM, 1, 8000, 2, 16), head(T.IMA_ADPCM, 1, 8000, 8, 4)]
    rows = [(i, b) for i, b in enumerate(bad)] + [(100 + i, b) for i, b in enumerate(fine)] + [(None, None)]
    got = {r.id: r for r in T.decode_audio(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()}
    assert len(got) == len(rows)
    assert all(got[i].error and got[i].pcm is None for i in range(len(bad)))
    assert all(got[100 + i].error is None and got[100 + i].samples is not None for i in range(len(fine)))
