"""Power-of-two packing: each document is cut into pieces of binary lengths, and equal lengths share a bucket.

A document of n tokens is cut from its front into n // longest pieces of the longest length and then, for the rest, one piece
for each set bit, longest first. Every piece is a sequence of its own, so no sequence crosses documents and none is padded.
Sequences are numbered bucket by bucket, longest lengths first, and within a bucket in a seeded hash order, so batches of
one length are contiguous. Only narrow piece rows are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.sharding import _ranked
from quillmesh.llm.textscan import small_batches
from quillmesh.storage import written

LONGEST = 1024
#: Ranges of one length: their counts are added up in one task, so the number is bounded.
RANGE_ROWS = 20_000
LEAST_RANGES = 64
MOST_RANGES = 1 << 13

_PIECES = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("tie", pa.int64())])


_encoders: dict[str, object] = {}


def byte_bpe(vocabulary: str = "byte_bpe_50k"):
    """text -> ids of the public tokenizers file `vocabulary`.json, without special tokens added. A text that holds none of the
    file's added tokens goes through the rank file with the same merges, which gives the same ids several times as fast; a text
    that holds one (it becomes that token's id), and one that the fast engine can't take, goes through the file itself. Kept for
    the life of the worker."""
    if vocabulary not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        added = [t.content for t in whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def encode(text: str) -> list[int]:
            if not any(t in text for t in added):
                try:
                    return fast(text)
                except BaseException as e:  # its regex engine panics on runs of millions of equal characters
                    if type(e).__name__ != "PanicException":
                        raise
            return whole.encode(text, add_special_tokens=False).ids

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def binary_cuts(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; longest is a power of two."""
    out = [(i, longest) for i in range(0, n - longest + 1, longest)]
    at, bit = n - n % longest, longest >> 1
    while bit:
        if n & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def _pieces(longest: int, end_id: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = np.array([*encode(text), end_id], np.uint32)
                raw, n = memoryview(ids.astype("<u4").tobytes()), len(ids)
                tie = zlib.crc32(raw)
                out += [(doc, s, k, zlib.crc32(raw[4 * s : 4 * (s + k)]), n, tie) for s, k in binary_cuts(n, longest)]
                if len(out) > 50_000:
                    yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)
                    out = []
            if out:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def pack_power_of_two(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", longest: int = LONGEST, end_id: int = 0, seed: int = 5) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    A null or empty text has only the end id: one piece of length 1. Repeated rows give their pieces again, in sequences of
    their own (pieces equal in all columns are interchangeable). A null id stays null. An empty table gives no piece. A very long
    text has more pieces of the longest length; ties of the hash order are broken by id, place and checksum. Columns of the input
    other than the two named, those with names of the result too, are not read.
    """
    small_batches(docs.sparkSession)
    pieces = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_pieces(longest, end_id, vocabulary), "id long, start long, length long, ids_crc32 long, doc_tokens long, tie long")
    pieces = written(pieces.withColumn("h", F.xxhash64("id", "start", "tie", F.lit(seed))), "pieces")
    total = pieces.count()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-total // RANGE_ROWS)))
    # Buckets lie in the order of lengths; a length's ranges in the order of the top 20 bits of its hash.
    bucket = (longest - F.col("length")) * MOST_RANGES * 2 + F.floor(F.shiftrightunsigned("h", 44) * ranges / (1 << 20)).cast("long")
    one = pieces.withColumn("one", F.lit(0))
    order = [F.shiftrightunsigned("h", 1), F.col("h"), F.col("id"), F.col("start"), F.col("tie")]
    placed = _ranked(one, ["one"], bucket, order, "sequence_id")
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long"), F.lit(0).cast("long").alias("offset"))
