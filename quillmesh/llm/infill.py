"""Fill-in-middle transformation: each text is cut at two token boundaries and its parts are put into another order.

A token is a run of letters A-Z, a-z or one other character. One numpy kernel works on the UTF-8 buffer of a whole chunk of
rows: a lookup gives each byte its class, a mask over adjacent bytes marks where tokens start, cumulative sums that restart with
each document rank the starts, and one searchsorted finds the byte of every cut of all rows. The outputs, and the texts that
`restored` rebuilds from them, are gathered from the buffers by one index array. Rows never leave their partition, so
there is no shuffle, and memory is bounded by textscan.CHUNK_BYTES or by the longest text.

Defined results: a null text counts as empty and is plain; an id that is null is hashed as the empty string; rows that repeat an
id are cut alike where their texts are; an empty table gives no row; long texts are cut as wholes; other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmesh.llm.textscan import chunks, gather, small_batches, strings

#: Marks before the prefix, the suffix and the middle. A text that holds one of them stays plain, so outputs can be undone.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
FORMS = np.array([PLAIN, PSM, SPM])
#: Of 100 hashes, those at or above PLAIN_FROM leave a text plain; of 100 others, those below SPM_BELOW put the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20

_LETTER, _OTHER, _INNER = 0, 1, 2
#: Class of a byte: a letter, the first byte of another character, or a further byte of one.
KIND = np.full(256, _OTHER, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
KIND[0x80:0xC0] = _INNER


def hashes_of(key: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n groups of eight hexadecimal digits of sha256('seed:key'), as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A mask over the bytes: where a token starts."""
    kind = KIND[data]
    start = kind == _OTHER
    letter = kind == _LETTER
    fresh = letter.copy()
    fresh[1:] &= ~letter[:-1]
    inside = offsets[:-1][np.diff(offsets) > 0]
    fresh[inside] = letter[inside]
    return start | fresh


def cuts(start: np.ndarray, offsets: np.ndarray, units: np.ndarray) -> np.ndarray:
    """For each row the byte after its first units[row] tokens; units has one or more columns."""
    ranks = np.cumsum(start)
    before = np.concatenate([[0], ranks])[offsets]
    n = np.diff(before)
    found = np.searchsorted(ranks, (before[:-1, None] + units + 1).ravel()).reshape(units.shape)
    return np.where(units >= n[:, None], offsets[1:, None], found)


def marked(data: np.ndarray) -> np.ndarray:
    """The places where a mark starts."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    names = np.frombuffer("".join(m[1] for m in MARKS).encode(), np.uint8)
    return np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], names))


def cut_rows(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens, form, code points of prefix and middle, bytes and offsets of the outputs) of the rows of one chunk; h has the
    four hashes of each row."""
    start, size = token_starts(data, offsets), np.diff(offsets)
    ranks = np.concatenate([[0], np.cumsum(start)])[offsets]
    n = np.diff(ranks)
    found = marked(data)
    row = np.searchsorted(offsets, found, "right") - 1
    holds = np.zeros(len(n), bool)
    holds[row[found + 3 <= offsets[row + 1]]] = True
    form = np.where((size == 0) | holds | (h[:, 2] % 100 >= PLAIN_FROM), 0, np.where(h[:, 3] % 100 < SPM_BELOW, 2, 1))
    at = cuts(start, offsets, np.sort(h[:, :2] % (n[:, None] + 1), axis=1))
    points = np.concatenate([[0], np.cumsum(KIND[data] != _INNER)])
    prefix, middle = points[at[:, 0]] - points[offsets[:-1]], points[at[:, 1]] - points[at[:, 0]]
    # The buffer is followed by the three marks; each row is six stretches of it, which are empty where a plain row has none.
    whole = np.concatenate([data, np.frombuffer("".join(MARKS).encode(), np.uint8)])
    p, s, m = (np.stack([np.full(len(n), len(data) + 3 * i), np.full(len(n), len(data) + 3 * i + 3)], 1) for i in range(3))
    pre, mid, suf = np.stack([offsets[:-1], at[:, 0]], 1), at, np.stack([at[:, 1], offsets[1:]], 1)
    none, text = np.zeros((len(n), 2), np.int64), np.stack([offsets[:-1], offsets[1:]], 1)
    plain, psm, spm = (np.stack(x, 1) for x in ([text, none, none, none, none, none], [p, pre, s, suf, m, mid], [s, suf, p, pre, m, mid]))
    parts = np.choose(form[:, None, None], [plain, psm, spm])
    return n, form, prefix, middle, *gather(whole, parts[:, :, 0], parts[:, :, 1])


def undo_rows(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of which `data` holds the outputs. A row that is not plain holds three marks, as its text has
    none and no mark can arise at the edge of a part."""
    found = marked(data)
    row = np.searchsorted(offsets, found, "right") - 1
    found = found[(form[row] > 0) & (found + 3 <= offsets[row + 1])].reshape(-1, 3)
    first, last = np.zeros((len(form), 3), np.int64), np.zeros((len(form), 3), np.int64)
    first[:, 0], last[:, 0] = offsets[:-1], offsets[1:]
    moved, second = np.flatnonzero(form > 0), form[form > 0] == 2
    part = [np.stack([found[:, i] + 3, found[:, i + 1] if i < 2 else offsets[moved + 1]], 1) for i in range(3)]
    order = [np.where(second[:, None], part[1], part[0]), part[2], np.where(second[:, None], part[0], part[1])]
    for i, x in enumerate(order):
        first[moved, i], last[moved, i] = x[:, 0], x[:, 1]
    return gather(data, first, last)


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)], 1)
        for i, j, data, offsets in chunks(batch.column(1)):
            n, form, prefix, middle, out, at = cut_rows(data, offsets, hashes[i:j])
            plain = form == 0
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(FORMS[form].tolist(), pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), strings(out, at)], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form = np.select([np.asarray(batch.column(1).to_pylist(), object) == f for f in (PSM, SPM)], [1, 2], 0)
        for i, j, data, offsets in chunks(batch.column(0)):
            text = strings(*undo_rows(data, offsets, form[i:j]))
            rest = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns)]
            yield pa.record_batch([*rest, text], [*batch.schema.names, "restored"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row: the number of tokens, `plain`, `psm` or `spm`, the code
    points of prefix and middle (null if plain) and the whole transformed text. Edge cases: see the module."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col), *hashes_of(F.col(id_col), seed))
    out = rows.mapInArrow(_transform, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(outputs: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """Adds `restored`, the exact text rebuilt from the output and its form alone, in place of a column of that name. A null
    output gives an empty text, and so does a null form with it."""
    rows = outputs.drop("restored") if "restored" in outputs.columns else outputs
    rest = [c for c in rows.columns if c not in (output_col, form_col)]
    rows = rows.select(output_col, form_col, *rest)
    return rows.mapInArrow(_undo, StructType([*rows.schema.fields, StructField("restored", StringType())]))


def fim_documents(docs: DataFrame) -> DataFrame:
    """The registered query: digests of the outputs and of the texts rebuilt from them."""
    both = restored(fill_in_middle(docs))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)
