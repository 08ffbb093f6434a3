"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A trigram's vector binds its letters' vectors, the first rotated by two
places, the second by one (elementwise product). A document bundles (adds) the vectors of its trigrams; a language's prototype
bundles the documents of that language. A document gets the language whose prototype has the largest cosine with it.

Prototypes come from all training rows: each task adds up integer vectors, Spark sums them for each language and place, and
only languages x DIMENSION numbers reach the driver. Integer sums make the result independent of the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.textscan import small_batches

#: The cosine of unrelated vectors has deviation 1 / sqrt(DIMENSION), 0.016.
DIMENSION = 4096
CLASSES = 64
SEED = 11
UNKNOWN = "und"
CHUNK_CHARS = 1 << 19
#: Trigrams whose vectors are made at once.
BLOCK = (1 << 23) // DIMENSION
#: Texts times trigrams that are counted at once.
COUNT_CELLS = 1 << 23
#: Languages whose counts a learning task holds at once, 2 MB each.
HELD_LANGS = 32
#: A training document's trigrams are weighted to this sum, so that long documents don't outweigh many short ones.
DOCUMENT_WEIGHT = 1 << 16

_kept: dict[str, np.ndarray] = {}


def letter_classes() -> np.ndarray:
    """Class of each code point: 0 for all but letters, 1 to 26 for a to z, other letters hashed to 27 to 63."""
    if "classes" not in _kept:
        out = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
                out[cp] = 27 + (cp * 2654435761 >> 7) % (CLASSES - 27)
        out[97:123] = np.arange(1, 27)
        _kept["classes"] = out
    return _kept["classes"]


def letter_vectors() -> np.ndarray:
    if "letters" not in _kept:
        _kept["letters"] = (np.random.default_rng(SEED).integers(0, 2, (CLASSES, DIMENSION), np.int8) * 2 - 1).astype(np.int8)
    return _kept["letters"]


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes (6 bits for each letter)."""
    v = letter_vectors()
    return np.roll(v, 2, 1)[codes >> 12] * np.roll(v, 1, 1)[codes >> 6 & 63] * v[codes & 63]


def trigram_counts(texts: list[str | None], cells: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(codes, counts): the trigram codes that occur and, for each text, how often each does; None if there are several texts
    and counts would have more than `cells` cells. Runs of other characters are one
    word boundary; every text starts and ends with one; a trigram holds a letter."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in lowered])
    raw = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = letter_classes()[raw]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    keep = kinds != 0
    keep[1:] |= (kinds[:-1] != 0) | (doc[1:] != doc[:-1])
    keep[0] = True
    kinds, doc = kinds[keep].astype(np.int32), doc[keep]
    code = (kinds[:-2] << 12) | (kinds[1:-1] << 6) | kinds[2:]
    fits = (doc[:-2] == doc[2:]) & ((kinds[:-2] | kinds[1:-1] | kinds[2:]) > 0)
    code, doc = code[fits], doc[:-2][fits]
    there = np.zeros(CLASSES**3, bool)
    there[code] = True
    codes = np.flatnonzero(there).astype(np.int32)
    if cells is not None and len(texts) > 1 and len(texts) * len(codes) > cells:
        return None
    place = np.zeros(CLASSES**3, np.int32)
    place[codes] = np.arange(len(codes))
    counts = np.bincount(doc.astype(np.int64) * len(codes) + place[code], minlength=len(texts) * len(codes))
    return codes, counts.reshape(len(texts), len(codes))


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK_CHARS, at least one text each."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK_CHARS or i - first >= 255:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def counted(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, after the last, codes, counts) of runs of texts; a run whose counts would exceed COUNT_CELLS is halved."""
    todo = list(_runs(texts))[::-1]
    while todo:
        i, j = todo.pop()
        found = trigram_counts(texts[i:j], COUNT_CELLS)
        if found is None:
            todo += [((i + j) // 2, j), (i, (i + j) // 2)]
        else:
            yield i, j, *found


def bundled(codes: np.ndarray, counts: np.ndarray, kind: type) -> np.ndarray:
    """counts @ trigram vectors, by blocks of trigrams."""
    out = np.zeros((len(counts), DIMENSION), kind)
    for k in range(0, len(codes), BLOCK):
        out += counts[:, k : k + BLOCK].astype(kind) @ trigram_vectors(codes[k : k + BLOCK]).astype(kind)
    return out


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, total) of a task's training rows (text, lang). Weighted counts are added up first and bundled once for each
    language; with HELD_LANGS languages at hand they are given out, and later rows of a language give another total."""
    held: dict[str, np.ndarray] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for lang, count in held.items():
            codes = np.flatnonzero(count).astype(np.int32)
            total = bundled(codes, count[codes][None], np.float64)[0].astype(np.int64)
            yield pa.record_batch([pa.array([lang] * DIMENSION, pa.string()), pa.array(np.arange(DIMENSION, dtype=np.int32)), pa.array(total)], ["lang", "place", "total"])
        held.clear()

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, j, codes, counts in counted(texts):
            if not len(codes):
                continue
            every = counts.sum(1)
            weight = np.where(every > 0, DOCUMENT_WEIGHT // np.maximum(every, 1), 0)
            own = np.array(langs[i:j], object)
            for lang in set(langs[i:j]):
                if lang not in held and len(held) >= HELD_LANGS:
                    yield from given()
                rows = own == lang
                held.setdefault(lang, np.zeros(CLASSES**3, np.int64))[codes] += (counts[rows] * weight[rows, None]).sum(0)
    yield from given()


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order, their prototypes of length 1). Rows without a language are left out."""
    small_batches(rows.sparkSession)
    sums = rows.where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col)).mapInArrow(_bundles, "lang string, place int, total long")
    found = sums.groupBy("lang", "place").agg(F.sum("total").alias("total")).collect()
    langs = sorted({r.lang for r in found})
    out = np.zeros((len(langs), DIMENSION))
    at = {lang: i for i, lang in enumerate(langs)}
    for r in found:
        out[at[r.lang], r.place] = r.total
    norms = np.linalg.norm(out, axis=1)
    kept = norms > 0
    return [lang for lang, k in zip(langs, kept, strict=True) if k], out[kept] / norms[kept, None]


_SCORED = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _nearest(texts: list[str | None], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and cosine of each text."""
    names: list[str] = []
    scores = [np.zeros(0)]
    for i, j, codes, counts in counted(texts):
        bundle = bundled(codes, counts, np.float32)
        norms = np.linalg.norm(bundle, axis=1) if langs else np.zeros(j - i)
        cosines = bundle @ prototypes / np.maximum(norms, 1e-9)[:, None] if langs else np.zeros((j - i, 1))
        # Cosines of at most 1e-6 apart are equal, so the order of float sums doesn't decide.
        best = (cosines >= cosines.max(1)[:, None] - 1e-6).argmax(1)
        names += [langs[b] if n > 0 else UNKNOWN for b, n in zip(best, norms, strict=True)]
        scores.append(np.where(norms > 0, np.clip(cosines.max(1), 0, 1), 0))
    return names, np.round(np.concatenate(scores).astype(np.float64), 6)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: the nearest language, first in order on a tie, and its cosine, at least 0. Null
    texts, texts without a letter and models without languages give `und` and 0. Null ids and repeated rows pass through."""
    small_batches(docs.sparkSession)
    langs, prototypes = model[0], model[1].T.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _nearest(batch.column(1).to_pylist(), langs, prototypes)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], schema=_SCORED)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns (whatever their names), that have a language with a cosine of at least `least`; one pass
    without a shuffle. Null, empty and letterless texts go; an empty table stays empty."""
    small_batches(docs.sparkSession)
    langs, prototypes = model[0], model[1].T.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _nearest(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), langs, prototypes)
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that languages are learnt from: the crc32 of doc_id as text is no multiple of 5."""
    return docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull()).select("text", "lang")


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. Null, empty and letterless texts are `und` with score 0; whole texts count,
    however long; of languages that tie the first in order is taken; repeated rows and null ids (never held out, never learnt from)
    pass through; an empty table gives no row; other columns are not read."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = identify(docs, learn(training_rows(docs)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
