"""Telephony audio in binary media columns: G.711 mu-law and A-law, IMA ADPCM, resampled 16-bit PCM, RIFF/WAVE containers.

Companded bytes are expanded by 256-entry tables, built from the coding rules. ADPCM is decoded block by block in its
nature, but its blocks are independent, so one numpy step decodes the same sample of all blocks of a file (and of all files
of a batch with one block size) at once. Decoded sound is resampled by a polyphase windowed-sinc filter to 16-bit PCM.
Media are written to a table and read back from it: what is computed rests on stored bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.textscan import small_batches
from quillmesh.storage import written

#: Format tags of the WAVE container.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 0x11
NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", IMA_ADPCM: "adpcm"}

#: Rates of files that are decoded, and blocks of ADPCM that are decoded at once.
LEAST_RATE, MOST_RATE = 1_000, 192_000
BLOCKS = 1 << 15
#: Bytes of media that are worked on at once.
HELD_BYTES = 4 << 20
#: ADPCM blocks of stored payloads: these are multiples of it.
UNIT = 64

#: Fixed values of the IMA ADPCM coding: index changes by code, and step sizes by index.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8])
STEP_SIZES = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])


def mulaw_table() -> np.ndarray:
    """16-bit values of the mu-law codes: inverted bits, sign, 3 bits of segment, 4 bits of step; bias 132."""
    code = ~np.arange(256, dtype=np.int64) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype("<i2")


def alaw_table() -> np.ndarray:
    """16-bit values of the A-law codes: even bits inverted; segments 0 and 1 are linear."""
    code = np.arange(256, dtype=np.int64) ^ 0x55
    segment, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(segment > 0, size + 256 << np.maximum(segment - 1, 0), size)
    return np.where(code & 128, size, -size).astype("<i2")


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def compand(pcm: np.ndarray, tag: int) -> np.ndarray:
    """The code with the nearest value for each 16-bit sample."""
    values = TABLES[tag].astype(np.int64)
    order = np.argsort(values, kind="stable")
    edges = (values[order][1:] + values[order][:-1] + 1) // 2
    return order[np.searchsorted(edges, pcm.astype(np.int64), "right")].astype(np.uint8)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """int16 samples (blocks x samples) of mono IMA ADPCM blocks (blocks x bytes): a 4-byte header holds the first sample and
    the step index, then two 4-bit codes a byte, low first. One numpy step for each sample, across all blocks."""
    blocks = np.ascontiguousarray(blocks, np.uint8)
    n = 2 * (blocks.shape[1] - 4) + 1
    out = np.empty((len(blocks), n), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), len(STEP_SIZES) - 1)
    out[:, 0] = value
    for i in range(1, n):
        byte = blocks[:, 4 + (i - 1) // 2]
        code = (byte >> 4 if (i - 1) & 1 else byte & 15).astype(np.int64)
        step = STEP_SIZES[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, len(STEP_SIZES) - 1)
        out[:, i] = value
    return out


def adpcm_encode(pcm: np.ndarray, block_bytes: int = 256) -> np.ndarray:
    """Mono IMA ADPCM blocks of 16-bit samples (padded with the last sample), all blocks at once."""
    n = 2 * (block_bytes - 4) + 1
    count = max(1, -(-len(pcm) // n))
    held = np.full(count * n, pcm[-1] if len(pcm) else 0, np.int64)
    held[: len(pcm)] = pcm
    held = held.reshape(count, n)
    out = np.zeros((count, block_bytes), np.uint8)
    value, index = held[:, 0].copy(), np.searchsorted(STEP_SIZES, np.minimum(np.abs(held[:, 1] - held[:, 0]), STEP_SIZES[-1]))
    out[:, :2] = value.astype("<i2").view(np.uint8).reshape(count, 2)
    out[:, 2] = index
    for i in range(1, n):
        step, gap = STEP_SIZES[index], held[:, i] - value
        code, left, change = np.where(gap < 0, 8, 0), np.abs(gap), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = left >= part
            code, left, change = code + np.where(hit, bit, 0), left - np.where(hit, part, 0), change + np.where(hit, part, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, len(STEP_SIZES) - 1)
        out[:, 4 + (i - 1) // 2] |= (code << (4 if (i - 1) & 1 else 0)).astype(np.uint8)
    return out


def resample(pcm: np.ndarray, rate: int, to: int, taps: int = 16) -> np.ndarray:
    """16-bit PCM at another rate: for each of the `up` phases one dot product with a Hann-windowed sinc."""
    if rate == to or not len(pcm):
        return pcm.astype("<i2")
    shared = int(np.gcd(rate, to))
    up, down = to // shared, rate // shared
    n = -(-len(pcm) * up // down)
    cut = min(1.0, to / rate)
    reach = int(np.ceil(taps / 2 / cut))
    padded = np.concatenate([np.zeros(reach, np.float32), pcm.astype(np.float32), np.zeros(reach + 1, np.float32)])
    out = np.zeros(n, np.float32)
    for phase in range(min(up, n)):
        at = np.arange(phase, n, up, dtype=np.int64) * down
        whole, part = at // up, (at[0] % up) / up
        offsets = np.arange(-reach + 1, reach + 1)
        x = (offsets - part) * cut
        kernel = np.sinc(x) * cut * (0.5 + 0.5 * np.cos(np.pi * np.clip((offsets - part) / (reach + 1), -1, 1)))
        kernel /= kernel.sum()
        if down == 1:
            out[phase::up] = np.convolve(padded[1 : len(at) + 2 * reach], kernel[::-1].astype(np.float32), "valid")[: len(at)]
        else:
            out[phase::up] = padded[whole[:, None] + 1 + np.arange(2 * reach)[None, :]] @ kernel.astype(np.float32)
    return np.clip(np.rint(out), -32768, 32767).astype("<i2")


def write_wave(data: bytes, tag: int, rate: int = 8000, bits: int = 8, align: int = 1, samples: int | None = None) -> bytes:
    """A mono RIFF/WAVE file; formats other than PCM carry a fact chunk with the number of samples."""
    extra = struct.pack("<H", 0) if tag in (ALAW, MULAW) else struct.pack("<HH", 2, 2 * (align - 4) + 1) if tag == IMA_ADPCM else b""
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * align if tag != IMA_ADPCM else rate * align // (2 * (align - 4) + 1), align, bits) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(data) if samples is None else samples)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(blob: bytes) -> dict:
    """{tag, rate, align, bits, samples or None, data} of a mono WAVE file; ValueError, saying why, if it is none that can be
    decoded."""
    if len(blob) < 12 or blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    out, at = {"samples": None, "data": b""}, 12
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        body = blob[at + 8 : at + 8 + size]
        if name == b"fmt ":
            if len(body) < 16:
                raise ValueError("short format chunk")
            out["tag"], channels, out["rate"], _, out["align"], out["bits"] = struct.unpack_from("<HHIIHH", body)
            if channels != 1:
                raise ValueError("only mono files are telephony audio")
        elif name == b"fact" and len(body) >= 4:
            out["samples"] = struct.unpack_from("<I", body)[0]
        elif name == b"data":
            out["data"] = body
        at += 8 + size + (size & 1)
    if "tag" not in out:
        raise ValueError("no format chunk")
    if not LEAST_RATE <= out["rate"] <= MOST_RATE:
        raise ValueError(f"a rate of {out['rate']} is not telephony audio")
    if out["tag"] == IMA_ADPCM and out["align"] <= 4:
        raise ValueError(f"blocks of {out['align']} bytes hold no samples")
    if out["tag"] not in TABLES and out["tag"] != IMA_ADPCM and (out["tag"], out["bits"]) not in ((PCM, 8), (PCM, 16)):
        raise ValueError(f"format {out['tag']} with {out['bits']} bits is not telephony audio")
    return out


def decode_waves(waves: list[dict]) -> list[np.ndarray]:
    """16-bit samples of read files; ADPCM blocks of one size decode together, whichever files they are from."""
    out: list[np.ndarray | None] = [None] * len(waves)
    blocks: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, wave in enumerate(waves):
        raw = np.frombuffer(wave["data"], np.uint8)
        if wave["tag"] in TABLES:
            out[i] = TABLES[wave["tag"]][raw]
        elif wave["tag"] == IMA_ADPCM:
            whole = raw[: len(raw) - len(raw) % wave["align"]].reshape(-1, wave["align"])
            blocks.setdefault(wave["align"], []).append((i, whole))
        elif wave["bits"] == 16:
            out[i] = np.frombuffer(wave["data"][: len(raw) & ~1], "<i2")
        else:
            out[i] = ((raw.astype(np.int16) - 128) << 8).astype("<i2")
    for own in blocks.values():
        cat, at = np.concatenate([b for _, b in own]), 0
        decoded = np.concatenate([adpcm_decode(cat[k : k + BLOCKS]) for k in range(0, max(len(cat), 1), BLOCKS)])
        for i, b in own:
            out[i] = decoded[at : at + len(b)].reshape(-1)[: waves[i]["samples"]]
            at += len(b)
    return out


def decode_wave(wave: dict) -> np.ndarray:
    return decode_waves([wave])[0]


def padded_payload(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """(UTF-8 with zero bytes appended up to a positive multiple of `unit`, its length without them)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % unit if raw else unit), len(raw)


def describe(pcm: np.ndarray, stored: np.ndarray, rate: int) -> str:
    """Level, peak, zero crossings and the checksum of the stored PCM."""
    wide = pcm.astype(np.int64)
    energy = int(np.dot(wide, wide)) // max(1, len(wide))
    crossings = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"pcm16@{rate} n={len(stored)} ms={energy} peak={int(np.abs(wide).max(initial=0))} zc={crossings} crc={zlib.crc32(stored.tobytes()):08x}"


_MEDIA = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FULL = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("pcm", pa.binary()), ("feature", pa.string())])
_DIGEST = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pcm_bytes", pa.int64())])
_KINDS = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _runs(blobs: Iterator) -> Iterator[list]:
    """Runs of (row, bytes) with about HELD_BYTES, at least one each."""
    out, held = [], 0
    for row, blob in blobs:
        out.append((row, blob))
        held += len(blob or b"")
        if held > HELD_BYTES:
            yield out
            out, held = [], 0
    if out:
        yield out


def coding_of(payload: bytes, law: int | None) -> int:
    """`law`, or without one mu-law, A-law or ADPCM by the payload's checksum."""
    return (MULAW, ALAW, IMA_ADPCM)[zlib.crc32(payload) % 3] if law is None else law


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", law: int | None = None, rate: int = 8000) -> DataFrame:
    """(id, n_bytes, media) of every row, written to the shared folder: the text's padded payload, byte for byte, as mu-law or A-law
    samples or as ADPCM blocks of UNIT bytes in a WAVE file. Null and empty texts are 64 zero bytes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((doc, text.as_py()) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            for part in _runs(texts):
                rows = []
                for doc, text in part:
                    payload, n = padded_payload(text, UNIT)
                    tag = coding_of(payload, law)
                    media = write_wave(payload, tag, rate, 4, UNIT, len(payload) // UNIT * (2 * (UNIT - 4) + 1)) if tag == IMA_ADPCM else write_wave(payload, tag, rate)
                    rows.append((doc, n, media))
                yield _batch(rows, _MEDIA)

    return written(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _ddl(_MEDIA)), "media")


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", law: int | None = None, rate: int = 8000, to_rate: int = 16000, digest: bool = False) -> DataFrame:
    """Each text's payload as a stored telephony file, read back from the table, decoded and resampled to 16-bit PCM:
    (id, n_bytes, media, pcm, feature), or with digest=True the checksums of what was read back in place of the bytes.

    Null and empty texts are 64 zero bytes. Files are worked on in runs of about HELD_BYTES, so memory follows the longest text.
    Equal texts give equal values; null ids and repeated rows pass through; an empty table gives no row; other columns, those named
    as results too, are not read.
    """
    schema = _DIGEST if digest else _FULL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _runs((i, blob.as_py()) for i, blob in enumerate(batch.column(2))):
                waves, rows = [read_wave(blob) for _, blob in part], []
                for (i, media), wave, pcm in zip(part, waves, decode_waves(waves), strict=True):
                    back = wave["data"]
                    stored = resample(pcm, wave["rate"], to_rate)
                    feature = f"{NAMES[wave['tag']]} {describe(pcm, stored, to_rate)}"
                    if digest:
                        rows.append((ids[i], sizes[i], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, stored.nbytes))
                    else:
                        rows.append((ids[i], sizes[i], media, stored.tobytes(), feature))
                yield _batch(rows, schema)

    media = store_media(docs, id_col, text_col, law, rate)
    return media.select("id", "n_bytes", "media").mapInArrow(run, _ddl(schema)).withColumnRenamed("id", id_col)


def decode_audio(media: DataFrame, id_col: str, media_col: str, to_rate: int = 16000) -> DataFrame:
    """(id, rate, samples, pcm, error) of a column of WAVE files: mu-law, A-law, IMA ADPCM, 8- and 16-bit PCM. A null or broken
    file gives null samples and pcm, and says why in error (null for null); null ids and repeated rows pass through."""
    small_batches(media.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("rate", pa.int64()), ("samples", pa.int64()), ("pcm", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in _runs((i, blob.as_py()) for i, blob in enumerate(batch.column(1))):
                rows = {i: (ids[i], None, None, None, None) for i, _ in part}
                waves = {}
                for i, blob in part:
                    if blob is not None:
                        try:
                            waves[i] = read_wave(blob)
                        except ValueError as e:
                            rows[i] = (ids[i], None, None, None, str(e))
                for (i, wave), pcm in zip(waves.items(), decode_waves(list(waves.values())), strict=True):
                    sound = resample(pcm, wave["rate"], to_rate)
                    rows[i] = (ids[i], to_rate, len(sound), sound.tobytes(), None)
                yield _batch(list(rows.values()), schema)

    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(run, _ddl(schema)).withColumnRenamed("id", id_col)
