"""Statistics of whole documents, from their bytes: character classes, words, lines and repetition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillmesh.llm.textscan import chunks, spans, verified, windows, word_hashes

#: Byte classes: 0 other, 1 white space, 2 a-z, 3 A-Z, 4 digit, 5 sentence mark, 6 symbol, 7 bar, 8 exclamation, 9 other
#: punctuation, 10 UTF-8 lead byte, 11 UTF-8 continuation, 12 line end.
BYTE_CLASS = np.zeros(256, np.int64)
BYTE_CLASS[[9, 11, 12, 13, 32]] = 1
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58] = 2, 3, 4
BYTE_CLASS[[*b".,;:?"]], BYTE_CLASS[[*b"#*$%&<>"]], BYTE_CLASS[ord("|")], BYTE_CLASS[ord("!")] = 5, 6, 7, 8
BYTE_CLASS[[*b"'\"()-_/\\@+=~^`[]{}"]] = 9
BYTE_CLASS[192:], BYTE_CLASS[128:192], BYTE_CLASS[10] = 10, 11, 12
KINDS = 13
#: The symbols of the base rules.
SYMBOL = np.zeros(256, bool)
SYMBOL[[*b"#*$%&|<>"]] = True

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "longest_word", "space", "lower", "upper", "digit", "mark", "symbol", "bar",
    "exclamation", "punctuation", "non_ascii", "lines_per_word", "line_words", "marks_per_word", "symbol_words", "upper_words",
    "distinct_words", "top_word", "same_as_before", "repeated_fours", "duplicate_lines", "short_lines", "ends_with_mark",
]


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines, and for each row its first line (with one more entry at the end). A row without
    bytes has one empty line."""
    ends_at = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], ends_at + 1])
    ends = np.concatenate([offsets[1:], ends_at])
    starts, ends = np.sort(starts, kind="stable"), np.sort(ends, kind="stable")
    # Each row has as many lines as line ends, and one more; in both lists rows follow one another.
    count = np.searchsorted(ends_at, offsets[1:]) - np.searchsorted(ends_at, offsets[:-1]) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(count)])


def repeated_words(hashes: np.ndarray, k: int) -> int:
    """Words in k-word windows that occur twice or more, first ones included."""
    w = windows(hashes, k)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(w), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicates(values: np.ndarray) -> int:
    """How many are equal to an earlier one."""
    return len(values) - len(np.unique(values))


def feature_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows x FEATURES, in the order of the texts; a text without words has zeros where nothing can be measured."""
    for _, _, data, offsets in chunks(texts):
        rows = len(offsets) - 1
        out = np.zeros((rows, len(FEATURES)), np.float32)
        size = np.diff(offsets)
        starts, ends, first = spans(data, offsets)
        words = np.diff(first)
        doc = np.repeat(np.arange(rows), size)
        kind = np.bincount(doc * KINDS + BYTE_CLASS[data], minlength=rows * KINDS).reshape(rows, KINDS).astype(float)
        per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
        width = (ends - starts).astype(float)
        owner = np.repeat(np.arange(rows), words)
        mean = np.bincount(owner, width, rows) * per_word
        out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(words), mean
        out[:, 3] = np.sqrt(np.maximum(np.bincount(owner, width**2, rows) * per_word - mean**2, 0))
        longest = np.zeros(rows)
        np.maximum.at(longest, owner, width)
        out[:, 4] = np.log1p(longest)
        for column, kinds in ((5, 1), (6, 2), (7, 3), (8, 4), (9, 5), (10, 6), (11, 7), (12, 8), (13, 9), (14, 10)):
            out[:, column] = kind[:, kinds] * per_byte
        line_starts, line_ends, line_first = line_spans(data, offsets)
        in_line = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
        lines = np.diff(line_first)
        out[:, 15], out[:, 16] = lines * per_word, words / lines
        out[:, 17] = kind[:, 5] * per_word
        marks = np.concatenate([[0], np.cumsum(SYMBOL[data])])
        out[:, 18] = np.bincount(owner, marks[ends] > marks[starts], rows) * per_word
        small = np.concatenate([[0], np.cumsum(BYTE_CLASS[data] == 2)])
        large = np.concatenate([[0], np.cumsum(BYTE_CLASS[data] == 3)])
        out[:, 19] = np.bincount(owner, (large[ends] - large[starts] > 1) & (small[ends] == small[starts]), rows) * per_word
        hashes = word_hashes(data, starts, ends)
        line_hash = word_hashes(data, line_starts, line_ends)
        for r in range(rows):
            a, b = first[r], first[r + 1]
            own = hashes[a:b]
            if b - a:
                _, times = np.unique(own, return_counts=True)
                out[r, 20], out[r, 21] = len(times) / (b - a), times.max() / (b - a)
                out[r, 22] = (own[1:] == own[:-1]).mean() if b - a > 1 else 0
                fours = windows(own, 4)
                out[r, 23] = duplicates(fours) / len(fours) if len(fours) else 0
                last = data[ends[b - 1] - 1]
                out[r, 26] = float(BYTE_CLASS[last] in (5, 8))
            la, lb = line_first[r], line_first[r + 1]
            full = in_line[la:lb] > 0
            if full.any():
                out[r, 24] = duplicates(line_hash[la:lb][full]) / full.sum()
                out[r, 25] = (in_line[la:lb][full] < 4).mean()
        yield out


def base_counts(texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each text. Words and lines count as
    equal only if their bytes are."""
    for _, _, data, offsets in chunks(texts):
        starts, ends, first = spans(data, offsets)
        hashes = verified(data, starts, ends, word_hashes(data, starts, ends))
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        in_words = np.concatenate([[0], np.cumsum(chars[ends] - chars[starts])])
        symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
        line_starts, line_ends, line_first = line_spans(data, offsets)
        full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_hash = verified(data, line_starts, line_ends, word_hashes(data, line_starts, line_ends))
        for r in range(len(offsets) - 1):
            a, b = int(first[r]), int(first[r + 1])
            la, lb = line_first[r], line_first[r + 1]
            lines = line_hash[la:lb][full[la:lb]]
            yield (b - a, int(in_words[b] - in_words[a]), int(symbols[offsets[r + 1]] - symbols[offsets[r]]), duplicates(lines) if len(lines) else 0, repeated_words(hashes[a:b], 8))


