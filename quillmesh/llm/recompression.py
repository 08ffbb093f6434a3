"""Exact removal of repeated passages by recompression.

A window is `width` consecutive words of one document; a word goes if a window over it has a word sequence that also starts
earlier (in a smaller id, or earlier in the same document).

Recompression turns a text into ever fewer symbols by alternate stages: a stage of runs names each maximal run of one symbol, a
stage of pairs splits all symbols into a left and a right half by a keyed bit and names each left symbol followed by a right one. A
name is a keyed hash of what it stands for, so all tasks give equal runs and pairs one name. Whether a boundary between two
symbols lasts depends on these two symbols alone, so two equal stretches of words get the same symbols inside, and differ only
near their edges. `signs` follows, for the edges of every window, how far inside the symbols are sure. The sign of a
window is, among the sure symbols of the last stage that has any, the one with the least hash, long ones first: equal windows
have the same sign at the same place, and neighbouring windows share theirs, so there is one sign for seven words, and it is five
words long on average. The whole document is the symbol of the last stage of all.

Spark's rounds:
1. The scan names symbols and sends each sign once, with its place. A shuffle by name finds those that occur again, anywhere,
   and the documents whose last symbol occurs with a smaller id: whole copies, which go without another look.
2. Places go back to their documents by id; windows under a shared sign are hashed (a sign is only a hint, so nothing rests on
   its hash alone) and grouped by 88 bits of two independent families. Those that don't start first are repeats.
3. Places of repeats go back to their documents, and the words under them go.
Texts are shuffled once: both returns read the same exchange. Hot names and hot passages are met by what a task knows already: of a
name it sends the first place and one row to say that there are more (later ones are shared for sure), of a window the least place
in an Arrow batch (later ones are repeats for sure). So one key never has more rows than there are batches, and nothing is capped.

Defined results: a null text has no words; texts with fewer words than a window lose none; a text of any length is read whole;
a row without an id ranks after all ids; rows that repeat an id are versions of one document, none of which repeats another
at the same place; an empty table gives no row; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.llm.textscan import U64, chunks, gather, mix, small_batches, spans, strings, windows, word_hashes

WIDTH = 20
#: A stage of pairs leaves three quarters of the symbols. As many are made as leave every window some sure symbols, and stages of
#: runs before the first and after every fourth.
LEAST_SURE = 6.5
#: How far longer symbols go before shorter ones as signs, as a shift of their hash for each further word: they are rarer.
SHIFT = 3
#: Slots (log2) of what a task remembers of its names. A slot may stand for several: then a sign counts as shared in vain.
SLOTS = 25
#: Slots (log2) of the names that a task has told to be shared; a name that another has driven out is told again.
TOLD = 22
#: Bits of a text's hash that tell rows of one id apart, and bits of a symbol's length.
VERSION, LENGTH = 24, 6
#: The 48 bits of a sign's name that are sent: it is a hint, and zeros take no room in a shuffle.
NAMED = U64(0xFFFFFFFFFFFF0000)
#: Bits of a window's key beside the 64 of its hash: from its sign, in another family of word hashes.
MORE = 24
LAST = (1 << 63) - 1

_RUN, _PAIR, _SIDE, _ROOT = (U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def stages(width: int) -> list[str]:
    """The stages of recompression for windows of so many words."""
    pairs = max(1, round(math.log(max(width / LEAST_SURE, 1)) / math.log(4 / 3)))
    return [x for i in range(pairs) for x in (["runs"] if i % 4 == 0 else []) + ["pairs"]]


def _next(bounds: np.ndarray, lasting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the next lasting boundary after it and the last one before it; places without one get the far end."""
    at = np.flatnonzero(lasting)
    up = np.searchsorted(at, bounds, "right")
    down = np.searchsorted(at, bounds, "left") - 1
    return np.append(at, len(lasting))[up], np.where(down >= 0, at[np.maximum(down, 0)], -1)


def _runs(names: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, whether each old boundary lasts) after a stage of runs."""
    lasts = first[at].copy()
    lasts[1:] |= names[1:] != names[:-1]
    begin = np.flatnonzero(lasts)
    times = np.diff(np.append(begin, len(names)))
    out = names[begin]
    many = times > 1
    out[many] = mix(mix(out[many] + _RUN) + times[many].astype(U64))
    return out, lasts


def _pairs(names: np.ndarray, left: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, whether each old boundary lasts) after a stage of pairs; left: which symbols are of the left half."""
    lasts = np.ones(len(names), bool)
    lasts[1:] = first[at][1:] | ~left[:-1] | left[1:]
    begin = np.flatnonzero(lasts)
    two = np.diff(np.append(begin, len(names))) == 2
    out = names[begin]
    out[two] = mix(mix(out[two] + _PAIR) * U64(3) + names[begin[two] + 1])
    return out, lasts


def signs(words: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows, and of each window its sign's name, first word and length) for documents whose first words are at[:-1]; at[-1] is the
    number of words. Windows don't cross documents, nor do symbols."""
    n = len(words)
    starts = np.flatnonzero(np.arange(n) + width <= np.repeat(at[1:], np.diff(at))) if n else np.zeros(0, np.int64)
    name, first_word, length = np.zeros(len(starts), U64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    if not len(starts):
        return starts, name, first_word, length
    fresh = np.zeros(n + 1, bool)
    fresh[at] = True
    names, place = words, np.arange(n)
    lo, hi = starts, starts + width
    open_ = np.arange(len(starts))  # windows that still have a sure symbol
    plan = stages(width)
    for turn in range(len(plan) + 1):
        if turn < len(plan):
            if plan[turn] == "runs":
                new, lasts = _runs(names, place, fresh)
                keep_lo = keep_hi = np.zeros(len(names), bool)
            else:
                left = (mix((names ^ U64(turn + 1)) + _SIDE) & U64(1)).astype(bool)
                new, lasts = _pairs(names, left, place, fresh)
                keep_lo, keep_hi = left, ~left
            # A boundary at the edge of what is sure lasts for sure if the symbol inside forbids a pair; else the next one inside.
            symbol = np.cumsum(np.bincount(place, minlength=n + 1)) - 1
            lasting = np.zeros(n + 1, bool)
            lasting[place[lasts]] = True
            lasting[n] = True
            up, _ = _next(lo, lasting)
            _, down = _next(hi, lasting)
            lo2 = np.where(keep_lo[symbol[lo]], lo, up)
            hi2 = np.where(keep_hi[symbol[hi - 1]], hi, down)
            sure = lo2 < hi2
        else:
            sure = np.zeros(len(open_), bool)
        done = ~sure
        if done.any():
            index = np.cumsum(np.bincount(place, minlength=n + 1)) - 1
            a, b = index[lo[done]], index[hi[done] - 1]
            ends = np.append(place, n)
            rank = mix(names + _ROOT) >> np.minimum(SHIFT * (np.diff(ends) - 1), 63).astype(U64)
            best = a.copy()
            for k in range(1, int((b - a).max()) + 1):
                other = np.minimum(a + k, b)
                best = np.where(rank[other] < rank[best], other, best)
            name[open_[done]], first_word[open_[done]], length[open_[done]] = names[best], place[best], ends[best + 1] - place[best]
        if not sure.any():
            break
        open_, lo, hi = open_[sure], lo2[sure], hi2[sure]
        names, place = new, place[lasts]
    return starts, name, first_word, length


def roots(words: np.ndarray, at: np.ndarray, family: int = 0) -> np.ndarray:
    """The name of each whole document."""
    if not len(words):
        return np.zeros(len(at) - 1, U64)
    size = np.diff(at)
    own = np.arange(len(words)) - np.repeat(at[:-1], size)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(words ^ mix((own + family * (1 << 40)).astype(U64) + _ROOT)))])
    return mix(sums[at[1:]] - sums[at[:-1]] + size.astype(U64) * _RUN)


_SIGNS = pa.schema([("name", pa.int64()), ("second", pa.int64()), ("doc", pa.int64()), ("code", pa.int64()), ("weight", pa.int32()), ("codes", pa.binary())])
_SIGN_ROWS = "name long, second long, doc long, code long, weight int, codes binary"


def _batch(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    none = [pa.nulls(size, f.type) if f.name not in columns else pa.array(columns[f.name], f.type) for f in schema]
    return pa.record_batch(none, schema=schema)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)


def _own(docs: np.ndarray, versions: np.ndarray) -> np.ndarray:
    """A key for what is sent about one document alone."""
    return _signed(mix(docs.astype(U64) * _PAIR + versions.astype(U64)))


def _packed(places: np.ndarray) -> bytes:
    """Places (first word and length of a sign) in 4 bytes each, or in 8 where a text is too long for that; the first byte says which."""
    wide = len(places) and int(places.max()) >= 1 << 32
    return (b"\x08" + places.astype("<i8").tobytes()) if wide else (b"\x04" + places.astype("<u4").tobytes())


def _places(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<i8" if packed[0] == 8 else "<u4", offset=1).astype(np.int64)


def _name(width: int, slots: int):
    """Round 1: rows (name, second, doc, code, weight, codes). A sign's first place in the task: weight 1 and its code; a name that
    the task has met before: one row of weight 2 without a place; the places met so, and those named twice in a chunk, packed in one
    row of weight 2 for each document, under a name of its own; a document as a whole: weight 0 and a second hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, told = np.zeros(1 << slots, bool), np.zeros(1 << TOLD, U64)
        for batch in batches:
            docs, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, offsets in chunks(batch.column(2)):
                doc, version = docs[i:j], versions[i:j]
                begin, end, at = spans(data, offsets)
                words = word_hashes(data, begin, end)
                enough = np.flatnonzero(np.diff(at) >= width)
                if not len(enough):
                    continue
                one, two = roots(words, at), roots(word_hashes(data, begin, end, 1), at, 1)
                yield _batch(_SIGNS, len(enough), name=_signed(one[enough]), second=_signed(two[enough] | U64(1)), doc=doc[enough], code=version[enough], weight=np.zeros(len(enough), np.int32))
                _, name, first, length = signs(words, at, width)
                code, which = np.unique(first << LENGTH | length, return_index=True)
                name = name[which] & NAMED
                row = np.searchsorted(at, code >> LENGTH, "right") - 1
                code = ((code - (at[row] << LENGTH)) << VERSION) | version[row]
                slot = (name >> U64(64 - slots)).astype(np.int64)
                _, back, times = np.unique(name, return_inverse=True, return_counts=True)
                again = seen[slot] | (times[back] > 1)
                seen[slot] = True
                once = ~again
                yield _batch(_SIGNS, int(once.sum()), name=_signed(name[once]), second=np.zeros(int(once.sum()), np.int64), doc=doc[row[once]], code=code[once], weight=np.ones(int(once.sum()), np.int32))
                news = np.unique(name[again])
                slot = (news >> U64(64 - TOLD)).astype(np.int64)
                news, slot = news[told[slot] != news], slot[told[slot] != news]
                told[slot] = news
                yield _batch(_SIGNS, len(news), name=_signed(news), second=np.zeros(len(news), np.int64), weight=np.full(len(news), 2, np.int32))
                at2 = np.flatnonzero(again)
                owners, cut = np.unique(row[at2], return_index=True)
                packed = [_packed(x) for x in np.split(code[at2] >> VERSION, cut[1:])] if len(owners) else []
                yield _batch(_SIGNS, len(owners), name=_own(doc[owners], version[owners]), second=np.full(len(owners), -2, np.int64), doc=doc[owners], code=version[owners], weight=np.full(len(owners), 2, np.int32), codes=packed)

    return run


_WINDOWS = pa.schema([("h", pa.int64()), ("k", pa.int32()), ("doc", pa.int64()), ("place", pa.int64()), ("starts", pa.binary())])
_WINDOW_ROWS = "h long, k int, doc long, place long, starts binary"


def _look(width: int):
    """Round 2: rows (h, k, doc, place, starts) of the windows under shared signs: of equal ones in a batch the first, and the starts
    of the others packed by document. A whole copy has no text here and one row without starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            singles, packs, copies = batch.column(3), batch.column(4), np.flatnonzero(batch.column(5).to_numpy(zero_copy_only=False))
            yield _batch(_WINDOWS, len(copies), h=_own(docs[copies], versions[copies]), k=np.full(len(copies), -1, np.int32), doc=docs[copies], place=versions[copies], starts=[b""] * len(copies))
            found: list[tuple] = []
            for i, j, data, offsets in chunks(batch.column(2)):
                begin, end, at = spans(data, offsets)
                wanted = []
                for r in range(i, j):
                    known = [np.asarray(singles[r].values, np.int64) >> VERSION, *[_places(x.as_py()) for x in packs[r].values]]
                    wanted.append(np.concatenate(known) + (at[r - i] << LENGTH))
                wanted = np.unique(np.concatenate(wanted))
                if not len(wanted):
                    continue
                words, others = word_hashes(data, begin, end), word_hashes(data, begin, end, 1)
                starts, name, first, length = signs(words, at, width)
                code = first << LENGTH | length
                near = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
                shared = wanted[near] == code
                starts, name = starts[shared], name[shared]
                row = np.searchsorted(at, starts, "right") - 1
                found.append((windows(others, width, 1)[starts], (mix(name) >> U64(64 - MORE)).astype(np.int64), docs[i:j][row], starts - at[row], versions[i:j][row]))
            if not found:
                continue
            h, k, doc, start, version = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((version, start, doc, k, h))
            same = (h[order[1:]] == h[order[:-1]]) & (k[order[1:]] == k[order[:-1]])
            first = order[np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(h)), 0))]
            least = np.empty(len(h), np.int64)
            least[order] = first
            # In the order of the texts, so that neighbouring rows of a shuffle block have bytes in common.
            fresh, again = least == np.arange(len(h)), (doc != doc[least]) | (start != start[least])
            yield _batch(_WINDOWS, int(fresh.sum()), h=_signed(h[fresh]), k=k[fresh].astype(np.int32), doc=doc[fresh], place=start[fresh] << VERSION | version[fresh])
            doc, start, version = doc[again], start[again], version[again]
            order = np.lexsort((start, version, doc))
            doc, start, version = doc[order], start[order], version[order]
            cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])])) if len(doc) else np.zeros(0, np.int64)
            packed = [x.astype("<i4").tobytes() for x in np.split(start, cut[1:])] if len(cut) else []
            yield _batch(_WINDOWS, len(cut), h=_own(doc[cut], version[cut]), k=np.full(len(cut), -1, np.int32), doc=doc[cut], place=version[cut], starts=packed)

    return run


def _keep(width: int):
    """Round 3: (id, n_words, n_removed, kept) of each document, from its text and the starts of its repeats (packed ones that are
    empty: it is a whole copy)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            singles, packs = batch.column(2), batch.column(3)
            for i, j, data, offsets in chunks(batch.column(1)):
                begin, end, at = spans(data, offsets)
                edge = np.zeros(len(begin) + 1, np.int64)
                for r in range(i, j):
                    a, b = at[r - i], at[r - i + 1]
                    if b - a < width:
                        continue
                    known = [] if not singles[r].is_valid else [np.asarray(singles[r].values, np.int64)]
                    raw = [] if not packs[r].is_valid else packs[r].as_py()
                    if b"" in raw:
                        edge[a] += 1
                        edge[b] -= 1
                    elif known or raw:
                        starts = np.concatenate([*known, *[np.frombuffer(x, "<i4") for x in raw]]).astype(np.int64) + a
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                n = np.diff(at)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[at])
                left = np.flatnonzero(~gone)
                # The buffer is followed by a space: each kept word is one stretch, and the space before it (unless it is the first) another.
                whole = np.append(data, np.uint8(32))
                row = np.searchsorted(at, left, "right") - 1
                later = np.zeros(len(left), bool)
                later[1:] = row[1:] == row[:-1]
                first = np.stack([np.full(len(left), len(data)), begin[left]], 1)
                last = np.stack([len(data) + later, end[left]], 1)
                text, ends = gather(whole, first, last)
                cuts = ends[np.concatenate([[0], np.cumsum(n - removed)])]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), strings(text, cuts)], ["id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, slots: int = SLOTS) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: kept holds the words that stay, joined by one space. A window has 4 to 63 words.
    Edge cases: see the module."""
    if not 4 <= width < 1 << LENGTH:
        raise ValueError("a window has 4 to 63 words")
    small_batches(docs.sparkSession)
    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("id"), F.coalesce(key, F.lit(LAST)).alias("doc"), F.coalesce(F.xxhash64(F.col(text_col)).bitwiseAND(F.lit((1 << VERSION) - 1)), F.lit(0)).alias("version"), F.col(text_col).alias("t"))
    named = rows.select("doc", "version", "t").mapInArrow(_name(width, slots), _SIGN_ROWS)
    same = Window.partitionBy("name", "second")
    named = named.withColumn("times", F.sum("weight").over(same)).withColumn("least", F.min("doc").over(same))
    whole = (F.col("weight") == 0) & (F.col("doc") > F.col("least"))
    hints = named.where(F.col("doc").isNotNull() & ((F.col("times") >= 2) | whole))
    version = F.col("code").bitwiseAND(F.lit((1 << VERSION) - 1))
    hints = hints.groupBy("doc", version.alias("version")).agg(F.max(F.col("weight") == 0).alias("copy"), F.collect_list(F.when((F.col("weight") > 0) & F.col("codes").isNull(), F.col("code"))).alias("single"), F.collect_list("codes").alias("packs"))
    # `id` is not looked at here: with it both joins read one exchange of the texts.
    under = rows.join(hints, ["doc", "version"]).select("doc", "version", F.when(~F.col("copy"), F.col("t")), "single", "packs", "copy", "id")
    looked = under.mapInArrow(_look(width), _WINDOW_ROWS)
    start = F.shiftright("place", VERSION)
    order = F.struct(F.col("doc"), start)
    looked = looked.withColumn("least", F.min(order).over(Window.partitionBy("h", "k")))
    repeats = looked.where(F.col("starts").isNotNull() | (order > F.col("least")))
    version = F.col("place").bitwiseAND(F.lit((1 << VERSION) - 1))
    repeats = repeats.groupBy("doc", version.alias("version")).agg(F.collect_list(F.when(F.col("starts").isNull(), start)).alias("single"), F.collect_list("starts").alias("packs"))
    marked = rows.join(repeats, ["doc", "version"], "left").select("id", "t", "single", "packs")
    kept = marked.mapInArrow(_keep(width), "id long, n_words long, n_removed long, kept string")
    return kept.withColumnRenamed("id", id_col)


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """The registered query: doc_id, n_words, n_removed and the digest of the kept words."""
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
