"""Quality rules with line labels from a linear-chain conditional random field.

The \\n-split lines of a document that hold a word form a chain; each line has features of its bytes, words and neighbours, and
Viterbi decoding marks it as content or boilerplate. A document is kept if it passes the base rules and content lines hold
at least CONTENT_SHARE of its words.

No table labels lines, so the field is trained on chains whose lines are labelled by where they come from: runs of lines of good
documents are content; runs of lines of bad documents and generated page furniture (`furniture`: menus, notices, credits, dates) are
boilerplate. Half of the chains are of one kind, half change between them, so the field learns when a label changes. The lines
come from at most TRAIN_DOCS labelled documents (smallest seeded hash of doc_id), of each a seeded stretch of at most
TRAIN_LINES lines. Weights maximise the penalised conditional likelihood. Training and decoding run over all chains at once,
one numpy step for each line position; whole texts are decoded.

Defined results: a null, empty or blank text has no words, fails the base rules and has content share 0; equal lines of one text
count from the second on; of label paths that tie the one with content later in the text is taken; repeated rows and null
ids pass through; an empty table gives no row; without labels of both kinds every line is content; other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.docstats import BYTE_CLASS, SYMBOL, base_counts, line_spans
from quillmesh.llm.quality_trees import smallest_hashes
from quillmesh.llm.textscan import chunks, small_batches, spans, word_hashes

TRAIN_DOCS = 2_000
TRAIN_LINES = 100
#: Chains that are made for training, and their greatest length.
CHAINS, CHAIN_LINES = 2_000, 40
CONTENT_SHARE = 0.5
#: Base rules: fewest words, and the largest share of words in repeated 8-word windows, in hundredths.
LEAST_WORDS, MOST_REPEATED = 20, 30

FEATURES = ["one", "words", "few_words", "symbols", "symbol_words", "bars", "upper_words", "exclamations", "digits", "ends_with_mark", "as_earlier", "same_word_again", "every_second_word", "long_words", "starts_small", "marks"]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x FEATURES, words of each line, first line of each row) of the lines with a word."""
    starts, ends, _ = spans(data, offsets)
    line_starts, line_ends, line_first = line_spans(data, offsets)
    low, high = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = high > low
    first = np.concatenate([[0], np.cumsum(full)])[line_first]
    a, b, ls, le = low[full], high[full], line_starts[full], line_ends[full]
    out = np.zeros((len(a), len(FEATURES)), np.float32)
    if not len(a):
        return out, np.zeros(0, np.int64), first
    words, size = b - a, np.maximum(le - ls, 1)

    def summed(flags: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[high] - total[low]

    kinds = BYTE_CLASS[data]
    in_words = lambda flags: summed(flags, starts, ends)
    symbol_words, small, large = in_words(SYMBOL[data]) > 0, in_words(kinds == 2), in_words(kinds == 3)
    hashes = word_hashes(data, starts, ends)
    again = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    second = np.concatenate([[False, False], hashes[2:] == hashes[:-2]])[: len(hashes)]
    inner = lambda flags, skip: summed(flags, np.minimum(a + skip, b), b)
    out[:, 0] = 1
    out[:, 1] = np.minimum(words, 40) / 40
    out[:, 2] = words <= 2
    out[:, 3] = np.minimum(1, 8 * summed(SYMBOL[data], ls, le) / size)
    out[:, 4] = inner(symbol_words, 0) / words
    out[:, 5] = np.minimum(1, 2 * summed(kinds == 7, ls, le) / words)
    out[:, 6] = inner((large > 1) & (small == 0), 0) / words
    out[:, 7] = np.minimum(1, summed(kinds == 8, ls, le) / words)
    out[:, 8] = np.minimum(1, 4 * summed(kinds == 4, ls, le) / size)
    last = data[ends[b - 1] - 1]
    out[:, 9] = np.isin(last, np.frombuffer(b".?!:;\"')", np.uint8))
    line_hash = word_hashes(data, ls, le)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.lexsort((np.arange(len(a)), line_hash, owner))
    same = (line_hash[order][1:] == line_hash[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out[order[1:][same], 10] = 1
    out[:, 11] = inner(again, 1) / words
    out[:, 12] = inner(second, 2) / words
    out[:, 13] = np.minimum(1, summed(ends - starts, a, b) / words / 20)
    out[:, 14] = BYTE_CLASS[data[starts[a]]] == 2
    out[:, 15] = np.minimum(1, 3 * summed(kinds == 5, ls, le) / words)
    return out, words, first


@dataclass
class Field:
    weight: np.ndarray  # FEATURES: content against boilerplate
    step: np.ndarray  # 2 x 2: from label, to label (0 boilerplate, 1 content)
    start: np.ndarray  # 2


def _padded(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains in falling order of length, and how many have more than t lines, for each t."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    longest = int(length.max(initial=0))
    return order, np.searchsorted(-length[order], -np.arange(longest), "left")


def viterbi(field: Field, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The likeliest labels of all lines; content on a tie."""
    emit = np.zeros((len(x), 2))
    emit[:, 1] = (x * field.weight.astype(np.float32)).astype(np.float64).sum(1)
    order, alive = _padded(first)
    begin, labels = first[:-1][order], np.zeros(len(x), np.int64)
    if not len(alive):
        return labels
    came = np.zeros((len(x), 2), np.int8)
    score = field.start + emit[begin[: alive[0]]]
    for t in range(1, len(alive)):
        n = alive[t]
        at = begin[:n] + t
        reach = score[:n, :, None] + field.step[None]
        came[at] = (reach[:, 1] >= reach[:, 0]).astype(np.int8)
        score[:n] = np.maximum(reach[:, 0], reach[:, 1]) + emit[at]
    now = (score[:, 1] >= score[:, 0]).astype(np.int64)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = came[at, now[:n]]
    return labels


def fit_field(x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, l2: float = 0.002) -> Field:
    """Maximum likelihood by gradient steps with running moments; y: label of each line."""
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros(2))
    if not len(x) or y.min() == y.max():
        field.weight[0] = 1.0
        return field
    order, alive = _padded(first)
    chains = int(alive[0])
    begin, length = first[:-1][order], np.diff(first)[order][:chains]
    x, y = x.astype(float), y.astype(int)
    head = np.zeros(len(x), bool)
    head[begin[:chains]] = True
    later = np.flatnonzero(~head)
    end = begin[:chains] + length - 1
    chain_of = np.cumsum(head) - 1  # chains in the order of their lines
    true_weight = y @ x
    true_step = np.zeros((2, 2))
    np.add.at(true_step, (y[later - 1], y[later]), 1)
    true_start = np.bincount(y[head], minlength=2).astype(float)
    by_place = np.argsort(begin[:chains], kind="stable")
    theta, moments = np.zeros(x.shape[1] + 6), [np.zeros(x.shape[1] + 6), np.zeros(x.shape[1] + 6)]
    for turn in range(1, rounds + 1):
        field = Field(theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:])
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ field.weight
        forward, backward = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        forward[begin[:chains]] = field.start + emit[begin[:chains]]
        for t in range(1, len(alive)):
            at = begin[: alive[t]] + t
            forward[at] = emit[at] + np.logaddexp(forward[at - 1, 0, None] + field.step[0], forward[at - 1, 1, None] + field.step[1])
        for t in range(len(alive) - 2, -1, -1):
            n = alive[t + 1]
            at = begin[:n] + t
            after = emit[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(after[:, 0, None] + field.step[:, 0], after[:, 1, None] + field.step[:, 1])
        whole = np.logaddexp(forward[end, 0], forward[end, 1])[by_place][chain_of]
        p = np.exp(forward + backward - whole[:, None])
        joint = np.exp(forward[later - 1][:, :, None] + field.step[None] + (emit[later] + backward[later])[:, None, :] - whole[later][:, None, None])
        g = [true_weight - p[:, 1] @ x, (true_step - joint.sum(0)).reshape(-1), true_start - p[head].sum(0)]
        g = np.concatenate(g) / len(x) - l2 * theta
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        theta = theta + rate * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.99**turn)) + 1e-8)
    theta = np.round(theta, 6)
    return Field(theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:])


def furniture(count: int, seed: int = 1) -> list[str]:
    """Generated lines of page furniture, in words of many looks."""
    rng = random.Random(seed)

    def word() -> str:
        out = "".join(rng.choice("abcdefghilmnoprstuvéüñд") for _ in range(rng.randint(2, 9)))
        return out.capitalize() if rng.random() < 0.5 else out

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high)))

    kinds = [
        lambda: rng.choice([" | ", " » ", " > ", " · ", " / "]).join(words(1, 2) for _ in range(rng.randint(3, 12))),
        lambda: f"{rng.choice(['©', '(c)', 'Copyright'])} {rng.randint(1995, 2025)} {words(1, 3)}. {rng.choice(['All rights reserved.', words(2, 4), ''])}",
        lambda: f"{word()}: {', '.join(words(1, 2) for _ in range(rng.randint(2, 8)))}",
        lambda: f"{words(1, 3)} {rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1995, 2025)} {rng.randint(0, 23)}:{rng.randint(10, 59)}",
        lambda: f"{words(1, 3)} ({rng.randint(0, 999)}) | {words(1, 2)} ({rng.randint(0, 99)})",
        lambda: f">> {words(1, 4)} <<",
        lambda: f"*** {words(1, 5).upper()} ***",
        lambda: f"[{word()}] [{word()}] [{rng.randint(1, 40)}]",
        lambda: f"{words(2, 5).upper()}!!! {words(1, 4).upper()}!",
        lambda: f"$ {rng.randint(1, 999)}.{rng.randint(10, 99)} | {rng.randint(1, 90)} % | {words(1, 2)}",
        lambda: f"{word()} {rng.randint(1, 9)} / {rng.randint(10, 99)}",
    ]
    return [rng.choice(kinds)() for _ in range(count)]


def mixed_chains(good: list[np.ndarray], bad: list[np.ndarray], chains: int = CHAINS, longest: int = CHAIN_LINES, seed: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, first line of each chain, label of each line) of chains made of runs of consecutive lines of good (label 1) and bad
    documents; half of the chains are of one kind."""
    rng = np.random.default_rng(seed)
    lines, labels, first = [], [], [0]
    for _ in range(chains):
        size, label, pure = int(rng.integers(1, longest + 1)), int(rng.random() < 0.5), rng.random() < 0.5
        left = size
        while left:
            pool = good if label else bad
            own = pool[rng.integers(len(pool))]
            run = left if pure else min(left, int(rng.geometric(0.2)))
            at = int(rng.integers(len(own)))
            part = own[at : at + run]
            lines.append(part)
            labels.append(np.full(len(part), label))
            left -= len(part)
            label = label if pure else 1 - label
        first.append(first[-1] + size)
    return np.concatenate(lines), np.array(first), np.concatenate(labels)


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """The field of lines of at most `train_docs` labelled documents; without both labels every line is content."""
    small_batches(docs.sparkSession)
    own = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("y"))
    chosen = smallest_hashes(own, train_docs, "doc_id", 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j, data, offsets in chunks(batch.column(1)):
                x, _, first = line_features(data, offsets)
                for r in range(j - i):
                    own = x[first[r] : first[r + 1]]
                    if len(own):
                        at = (ids[i + r] * 2654435761 >> 7) % max(1, len(own) - TRAIN_LINES + 1)
                        own = np.ascontiguousarray(own[at : at + TRAIN_LINES])
                        yield pa.record_batch([pa.array([ids[i + r]], pa.int64()), pa.array([ys[i + r]], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["doc_id", "y", "lines"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    found = sorted(rows.mapInArrow(run, "doc_id long, y int, lines binary").collect(), key=lambda r: (r.doc_id, bytes(r.lines)))
    good, bad = ([np.frombuffer(r.lines, np.float32).reshape(-1, len(FEATURES)) for r in found if r.y == y] for y in (1, 0))
    if not good or not bad:
        return fit_field(np.zeros((0, len(FEATURES))), np.zeros(1, np.int64), np.zeros(0))
    made = furniture(600)
    for i in range(0, len(made), 6):
        (_, _, data, offsets), = chunks(pa.array(["\n".join(made[i : i + 6])]))
        bad.append(line_features(data, offsets)[0])
    return fit_field(*mixed_chains(good, bad))


_RULES = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())])


def judge(docs: DataFrame, field: Field, least_share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and content_share of every row. A null or blank text has no words and fails the base
    rules. Null ids and repeated rows pass through."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = np.array(list(base_counts(batch.column(1))), np.int64)
            shares = []
            for _, _, data, offsets in chunks(batch.column(1)):
                x, words, first = line_features(data, offsets)
                content = np.concatenate([[0], np.cumsum(words * viterbi(field, x, first))])
                every = np.concatenate([[0], np.cumsum(words)])
                shares.append((content[first[1:]] - content[first[:-1]]) / np.maximum(1, every[first[1:]] - every[first[:-1]]))
            share = np.concatenate(shares)
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            columns = [batch.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (share >= least_share)), pa.array(np.round(share, 9))]
            yield pa.record_batch(columns, schema=_RULES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, learn(docs, labels))
