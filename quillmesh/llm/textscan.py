"""Vectorised scans over the UTF-8 bytes of whole Arrow string columns.

Words are the maximal runs of bytes other than space and \\t \\n \\v \\f \\r, so no Unicode decoding is needed. Chunks bound
the memory: numpy work arrays exist for at most CHUNK_BYTES of text, or for one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.default_rng(20240607)
_KEYS = _rng.integers(1, 1 << 63, (2, 16), dtype=np.uint64) * U64(2) + U64(1)
_STEP = (_rng.integers(1, 1 << 63, 16, dtype=np.uint64) * U64(2)) + U64(1)
#: Words and lines above this size are hashed one by one.
LONG_BYTES = 64
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in these bytes); null texts have no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary()) if texts.type != pa.large_binary() else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(texts))
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (with one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each place, as one number; bytes after the end are zero."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each stretch: equal bytes, equal hash. Eight bytes at a time go through keyed bijections, so no linear
    structure is left that regular texts could meet; the two families are independent."""
    if not len(starts):
        return np.zeros(0, U64)
    keys, size = _KEYS[family], ends - starts
    out = mix(size.astype(U64) * keys[15])
    eights = _eights(data)
    left = np.flatnonzero((size > 0) & (size <= LONG_BYTES))
    for turn in range(LONG_BYTES // 8):
        if not len(left):
            break
        rest = np.minimum(size[left] - 8 * turn, 8)
        block = eights[starts[left] + 8 * turn] & _TAIL[rest]
        out[left] = mix((out[left] + block) ^ keys[turn])
        left = left[size[left] > 8 * (turn + 1)]
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > LONG_BYTES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], seed=family + 1)
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether stretch i and stretch j hold the same bytes, for each pair."""
    size = ends[i] - starts[i]
    out = size == ends[j] - starts[j]
    eights = _eights(data)
    left, turn = np.flatnonzero(out & (size > 0)), 0
    while len(left):
        if 8 * turn >= LONG_BYTES:
            raw = memoryview(np.ascontiguousarray(data))
            for x in left.tolist():
                out[x] = raw[starts[i[x]] : ends[i[x]]] == raw[starts[j[x]] : ends[j[x]]]
            break
        mask = _TAIL[np.minimum(size[left] - 8 * turn, 8)]
        same = (eights[starts[i[left]] + 8 * turn] & mask) == (eights[starts[j[left]] + 8 * turn] & mask)
        out[left[~same]] = False
        turn += 1
        left = left[same & (size[left] > 8 * turn)]
    return out


def verified(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The hashes, with those of stretches that share a hash but not the bytes told apart: within `data`, equal values mean equal
    bytes."""
    order = np.argsort(hashes, kind="stable")
    again = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    if not len(again):
        return hashes
    if same_bytes(data, starts, ends, order[again], order[again + 1]).all():
        return hashes
    raw, known, out = data.tobytes(), {}, hashes.copy()
    for i in range(len(hashes)):
        key = raw[starts[i] : ends[i]]
        out[i] = known.setdefault(key, mix(np.array([len(known)], U64) + U64(1 << 40))[0])
    return out


def windows(words: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """The hash of each run of k words; its length is len(words) - k + 1 (none if fewer words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = mix((out + words[i : i + n]) ^ _STEP[(i + 7 * family) % 14])
    return out


def gather(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches [first, last) of each row, one after another, and the offsets of the rows in the result."""
    size = (last - first).ravel()
    ends = np.cumsum(size)
    index = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(first.ravel() - (ends - size), size)
    return data[index], np.concatenate([[0], ends.reshape(first.shape)[:, -1]])


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Bytes and offsets as an Arrow column of texts."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def shingle_sets(texts: pa.Array, k: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, sorted distinct hashes of its k-word shingles, a second hash of the set), A-Z in lower case; a text with fewer words
    has its whole sequence as one shingle; without words the set is empty. The second hash is the sum of shingle hashes that
    rest on the other family of word hashes."""
    for i, _, data, offsets in chunks(texts, limit):
        data = LOWER[data]
        starts, ends, at = spans(data, offsets)
        words, others = word_hashes(data, starts, ends), word_hashes(data, starts, ends, 1)
        every, second = windows(words, k), windows(others, k, 1)
        for r in range(len(offsets) - 1):
            a, b = int(at[r]), int(at[r + 1])
            if b - a >= k:
                own = every[a : b - k + 1]
                order = np.argsort(own)
                own = own[order]
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield i + r, own[keep], int(np.add.reduce(second[a : b - k + 1][order[keep]]))
            elif b > a:
                yield i + r, windows(words[a:b], b - a) + U64(b - a), int(windows(others[a:b], b - a, 1)[0])
            else:
                yield i + r, np.zeros(0, U64), 0


#: Bounds of an Arrow batch, where the session has the library's own: rows, and bytes, so that a batch of long texts fits a worker.
BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def small_batches(spark) -> None:
    """Arrow batches that fit a Python worker. The same bounds for every operator; a session's own settings stay."""
    for name, (usual, ours) in BATCH_SETTINGS.items():
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, ours)
