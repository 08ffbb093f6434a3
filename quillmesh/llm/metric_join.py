"""Exact n-gram Jaccard similarity join as a metric-space join.

Jaccard distance d is a metric, so pivots with Voronoi regions and triangle-inequality windows give an exact join. In the whole
space this degenerates on text: almost all documents are at distance 1 from every pivot, so every window holds everything. The
join therefore goes through projections of the space in which near documents stay near, each joined by regions:

1. Projections to hash ranges. Shingle hashes are dealt into m ranges. |x ^ y|, the size of the symmetric difference, is the sum
   over the ranges of their own differences (each a metric). A link bounds the sum by tau, so with m = tau + 1 + slack ranges
   more than `slack` ranges are at distance 0: one of them is not empty, or slack + 1 empty ones are shared (the few documents
   with as many empty ranges register their combinations). In such a projection every point is a pivot, and its region, of radius
   0, is a cell. m depends on the size class; a document registers in its own class and in the next if it may link there.
2. Projections to sketches. A sketch counts a set's hashes in equal ranges; the Soergel distance of sketches is a metric and at
   most the Jaccard distance. Within a cell, pivots are drawn, Voronoi regions with windows made, and regions joined
   recursively in this metric (`voronoi_join`); what it links may link. The components of these pairs are the groups: they hold
   all links. Copies (equal sets) are one class from here on.
3. The sets themselves. Within a group the same recursive join runs in the Jaccard metric, and its links are the result. Each
   document goes to its nearest pivot's region; with eps the largest linked distance, y is copied to the region of q if
   d(y,q) <= d1(y) + 2 eps. Documents farther than a radius from all pivots form a region of their own (its inner edge widened by
   eps). Groups larger than LOCAL_DOCS are split so by Spark jobs, smaller ones in one task; a region that pivots can't shrink
   is dealt into pairs of blocks.

Nothing is capped: limits only choose who joins a region. Shingles are compared by keyed 64-bit hashes, whole sets by their size and two
independent hashes. Defined results: null or blank text has an empty set, links with nothing and is its own component; a
text of fewer than k words is one shingle; repeated rows appear as often as in the input, ties and copies have one component; a row
without an id keeps nulls in all result columns; an empty table gives no row; very long texts are cut nowhere. Other columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.llm.textscan import U64, mix, small_batches, shingle_sets
from quillmesh.operators.components import FOREST_NODES, SpanningForest, connected_components
from quillmesh.storage import written

LOCAL_DOCS = 1000
#: Documents times shingles of a region that one task joins.
LOCAL_WORK = 400_000_000
#: Pivots split a region only if the squares of its parts' sizes come to at most this share of its own.
WORTH = 0.6
BROADCAST_BYTES = 8 << 20
PIVOTS = 12
#: Members of a region for each pivot drawn in one task, and the least region that is compared whole where pivots don't shrink it.
PER_PIVOT = 8
BLOCK = 48
#: Above so many documents a cell is one group as it is, which the rounds of pivots split: no task gathers it.
HOT_CELL = 4096
#: Size classes grow by GROW[0] / GROW[1].
GROW = (3, 2)
#: Bound of the size classes whose cells are pairs of hashes.
SMALL = 44
#: Documents farther than this from all pivots form the outer region.
RADIUS = 0.6


def class_bound(c: int) -> int:
    """The largest size in class c."""
    hi = 1
    for _ in range(c):
        hi = max(hi + 1, hi * GROW[0] // GROW[1])
    return hi


def size_class(n: int) -> int:
    c = 0
    while n > class_bound(c):
        c += 1
    return c


def registers(n: int, num: int, den: int) -> list[int]:
    """The classes of a set of n: its own, and the next if a larger set there may link with it. Linked sizes differ by a factor of
    den / num at most, which is less than the growth of a class."""
    c = size_class(n)
    out = [c]
    while den * n >= num * (class_bound(out[-1]) + 1):
        out.append(out[-1] + 1)
    return out


def ranges_of(c: int, num: int, den: int) -> tuple[int, int]:
    """(m, slack) for sets registered in class c: |x ^ y| <= (den - num) / (den + num) * (|x| + |y|). slack is well above the
    number of empty ranges that the class's smallest sets have by chance."""
    tau = (den - num) * 2 * class_bound(c) // (den + num)
    if not tau or class_bound(c) <= SMALL:
        return tau + 1, 0
    least, slack = num * (class_bound(c - 1) + 1) // den, 1
    for _ in range(4):
        m = tau + 1 + slack
        empty = m * math.exp(-least / m)
        slack = 1 + math.ceil(empty + 5 * math.sqrt(empty))
    return tau + 1 + slack, slack


def cells_of(own: np.ndarray, c: int, num: int, den: int) -> np.ndarray:
    """The cells of one sorted set in size class c. Linked sets agree in more than `slack` ranges: if all of these are empty,
    the sets share slack + 1 empty ranges, so sets with as many register each choice of that many as a cell. Sets of up to
    SMALL are too small for ranges: of the first |x| - (least overlap) + 2 hashes of each, linked sets share two, and each
    pair of these is a cell. Where a link means equality, there is none."""
    m, slack = _ranges(c, num, den)
    if m == 1 or len(own) < 2:
        return np.zeros(0, np.uint64)
    if class_bound(c) <= SMALL:
        head = own[: len(own) - (num * len(own) + den - 1) // den + 2]
        i, j = np.triu_indices(len(head), 1)
        return mix(mix(head[i]) * U64(3) + head[j] + U64(c))
    part = ((own >> U64(32)) * U64(m)) >> U64(32)
    first = np.empty(len(part), bool)
    first[0] = True
    np.not_equal(part[1:], part[:-1], out=first[1:])
    at = np.flatnonzero(first)
    total = np.add.reduceat(mix(own), at)
    tag = U64((c * 0x2545F4914F6CDD1D + 0x1234567) & (2**64 - 1))
    out = mix(total ^ mix(part[at] + tag))
    if m - len(at) > slack:
        empty = mix(np.setdiff1d(np.arange(m, dtype=np.uint64), part[at], assume_unique=True) + tag)
        chosen = np.array([np.add.reduce(empty[list(x)]) for x in itertools.combinations(range(len(empty)), slack + 1)], np.uint64)
        out = np.concatenate([out, mix(U64(0x5851F42D4C957F2D) ^ chosen)])
    return out


_known: dict[tuple[int, int, int], tuple[int, int]] = {}


def _ranges(c: int, num: int, den: int) -> tuple[int, int]:
    if (c, num, den) not in _known:
        _known[c, num, den] = ranges_of(c, num, den)
    return _known[c, num, den]


_SCAN = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("x", pa.binary())])
_FOUND = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def set_hashes(own: np.ndarray, second: int) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set; `second` comes from the other family of word hashes."""
    if not len(own):
        return 0, 0
    return int(np.add.reduce(mix(own))), second ^ (len(own) * 0x9E3779B9)


def sketch_of(own: np.ndarray) -> bytes:
    """Counts of a sorted set's hashes in equal ranges, 4 to 8 in each on average, in at most 2**14 ranges (more in each for sets
    above 100,000): a byte with the width of a count, then the counts. Twice as few ranges: add neighbours."""
    bits = min(14, max(7, (len(own) // 4).bit_length()))
    counts = np.bincount((own >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return b"\1" + counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"\4" + counts.astype("<u4").tobytes()


def counts_of(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, np.uint8 if sketch[0] == 1 else "<u4", offset=1).astype(np.int64)


def _scan(k: int, num: int, den: int, hot_cell: int):
    """Rows (key, a, x): of each document (x: id, second hash, size, sketch) and of its cells (x null). If a batch has many
    documents in one cell they are combined before the shuffle: edges to one of them (x: the other end), which stands in the
    cell for all with an empty x."""
    classes: dict[int, list[int]] = {}

    def flush(cells, nodes):
        cell, node = np.concatenate(cells), np.concatenate(nodes)
        order = np.argsort(cell, kind="stable")
        cell, node = cell[order], node[order]
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        times = np.diff(np.concatenate([at, [len(cell)]]))
        hot = times > hot_cell
        plain = np.repeat(~hot, times)
        yield pa.record_batch([pa.array(_signed(cell[plain])), pa.array(_signed(node[plain])), pa.nulls(int(plain.sum()), pa.binary())], schema=_SCAN)
        for i in np.flatnonzero(hot):
            own = np.unique(node[at[i] : at[i] + times[i]])
            yield pa.record_batch([pa.array(_signed(cell[at[i] : at[i] + 1])), pa.array(_signed(own[:1])), pa.array([b""], pa.binary())], schema=_SCAN)
            yield pa.record_batch([pa.array(_signed(mix(own[1:]))), pa.array(_signed(np.full(len(own) - 1, own[0]))), pa.array([v.tobytes() for v in own[1:]], pa.binary())], schema=_SCAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            docs, cells, nodes, held, seen = [], [], [], 0, set()
            for r, own, second in shingle_sets(batch.column(1), k):
                h1, h2 = set_hashes(own, second)
                known = (h1, h2) in seen
                seen.add((h1, h2))
                docs.append((int(ids[r]), h1, h2, len(own), b"" if known or not len(own) else sketch_of(own)))
                if known or not len(own):
                    continue
                if len(own) not in classes:
                    classes[len(own)] = registers(len(own), num, den)
                new = np.concatenate([cells_of(own, c, num, den) for c in classes[len(own)]])
                if not len(new):
                    continue
                cells.append(new)
                nodes.append(np.full(len(new), h1, np.uint64))
                held += len(new)
                if held > 400_000:
                    yield from flush(cells, nodes)
                    cells, nodes, held = [], [], 0
            if cells:
                yield from flush(cells, nodes)
            if docs:
                packed = [np.array([d & (2**64 - 1), h2, n], np.uint64).tobytes() + s for d, _, h2, n, s in docs]
                key = mix(np.array([d[0] & (2**64 - 1) for d in docs], np.uint64))
                yield pa.record_batch([pa.array(_signed(key)), pa.array(_signed(np.array([d[1] for d in docs], np.uint64))), pa.array(packed, pa.binary())], schema=_SCAN)

    return run


def _found(batches: Iterator[pa.RecordBatch], hot_cell: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: documents (kind 0); edges (kind 1) from one document to the others of a cell with many; and the
    documents (kind 2: cell, document) of other cells with more than one. Cells of the same documents get the same name."""

    def batch_of(kind, a, b, c=None, n=None, sketch=None):
        size = len(a)
        none = pa.nulls(size, pa.int64())
        return pa.record_batch([pa.array(np.full(size, kind, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none if c is None else pa.array(c, pa.int64()), none if n is None else pa.array(n, pa.int64()), pa.nulls(size, pa.binary()) if sketch is None else pa.array(sketch, pa.binary())], schema=_FOUND)

    def closed(cell, node, star):
        """Whole cells, sorted: edges and members."""
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        times = np.diff(np.concatenate([at, [len(cell)]]))
        many = (times > hot_cell) | (np.add.reduceat(star.astype(np.int64), at) > 0)
        for i in np.flatnonzero(many):
            own = np.unique(node[at[i] : at[i] + times[i]])
            starred(own)
        few = np.repeat((times > 1) & ~many, times)
        cell, node = cell[few], node[few]
        if len(cell):
            order = np.lexsort((node, cell))
            cell, node = cell[order], node[order]
            keep = np.concatenate([[True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])])
            cell, node = cell[keep], node[keep]
            at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            times = np.diff(np.concatenate([at, [len(cell)]]))
            name = np.add.reduceat(mix(node.view(np.uint64)), at)
            wide = np.repeat(times > 1, times)
            name = np.repeat(mix(name), times)
            pairs = np.unique(np.stack([_signed(name[wide]), node[wide]], 1), axis=0)
            if len(pairs):
                yield batch_of(2, pairs[:, 0], pairs[:, 1])

    forest = SpanningForest()

    def starred(own):
        for v in own[1:].tolist():
            forest.join(int(own[0]), v)

    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    for batch in batches:
        if len(forest.up) > FOREST_NODES:
            yield batch_of(1, *zip(*forest.taken(), strict=True))
        key, a, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        size = pc.fill_null(pc.binary_length(x), 0).to_numpy()
        docs = []
        edges = np.flatnonzero(size == 8)
        for r in np.flatnonzero(size > 8):
            v = x[int(r)].as_py()
            docs.append((*np.frombuffer(v[:24], np.int64).tolist(), v[24:], int(a[r])))
        if docs:
            d, h2, n, sketch, h1 = zip(*docs, strict=True)
            yield batch_of(0, d, h1, h2, n, [v or None for v in sketch])
        for r in edges:
            forest.join(int(a[r]), int(np.frombuffer(x[int(r)].as_py(), np.int64)[0]))
        cells = size == 0
        cell, node, star = (np.concatenate([h, v]) for h, v in zip(held, (key[cells], a[cells], x.is_valid().to_numpy(zero_copy_only=False)[cells]), strict=True))
        if not len(cell):
            continue
        last = int(np.searchsorted(cell, cell[-1]))
        if last:
            yield from closed(cell[:last], node[:last], star[:last])
        cell, node, star = cell[last:], node[last:], star[last:]
        if len(cell) > 2 * hot_cell:  # a cell with many: its documents go out as edges to one of them
            own = np.unique(node)
            starred(own)
            cell, node, star = cell[:1], own[:1], np.ones(1, bool)
        held = (cell, node, star)
    if len(held[0]):
        yield from closed(*held)
    if forest.up:
        yield batch_of(1, *zip(*forest.taken(), strict=True))


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def overlaps(pivot: np.ndarray, cat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """|pivot & x| for each of the concatenated sets x (none is empty)."""
    pos = np.searchsorted(pivot, cat)
    pos[pos == len(pivot)] = 0
    return np.add.reduceat((pivot[pos] == cat).astype(np.int64), at)


class SketchSpace:
    """Sketches of one cell under the Soergel distance, which is at most the Jaccard distance of the sets."""

    def __init__(self, sketches: list[bytes], num: int, den: int) -> None:
        counts = [counts_of(s) for s in sketches]
        least = min(map(len, counts))
        v = np.stack([c.reshape(least, -1).sum(1) for c in counts])
        self.v = v.astype(np.int16) if v.max() < 1 << 14 else v
        self.n, self.num, self.den = self.v.sum(1, dtype=np.int64), num, den

    def measured(self, pivot: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the pivot, and who may link with it."""
        apart, both = np.abs(self.v[members] - self.v[pivot]).sum(1, dtype=np.int64), self.n[members] + self.n[pivot]
        return 2 * apart / (both + apart), (self.den + self.num) * apart <= (self.den - self.num) * both

    def linked(self, members: np.ndarray) -> np.ndarray:
        return np.stack([self.measured(int(x), members)[1] for x in members])


class SetSpace:
    """Sets (sorted hashes, none empty) under the Jaccard distance."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int) -> None:
        self.sets, self.n, self.num, self.den = sets, np.array([len(s) for s in sets]), num, den

    def measured(self, pivot: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.n[members]
        cat, at = np.concatenate([self.sets[x] for x in members]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inter = overlaps(self.sets[pivot], cat, at)
        union = len(self.sets[pivot]) + sizes - inter
        return 1 - inter / union, self.den * inter >= self.num * union

    def linked(self, members: np.ndarray) -> np.ndarray:
        """All intersections at once, as products of 0/1 matrices over the shared shingles."""
        sizes = self.n[members]
        values, column, times = np.unique(np.concatenate([self.sets[x] for x in members]), return_inverse=True, return_counts=True)
        at = np.cumsum(times > 1) - 1
        row, keep = np.repeat(np.arange(len(members)), sizes), times[column] > 1
        row, column = row[keep], at[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        inter = np.zeros((len(members), len(members)), np.float32)
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            i, j = np.searchsorted(column, [low, low + 4096])
            held = np.zeros((len(members), 4096), np.float32)
            held[row[i:j], column[i:j] - low] = 1
            inter += held @ held.T
        linked = np.empty(inter.shape, bool)
        for low in range(0, len(members), 128):
            part = inter[low : low + 128].astype(np.int64)
            linked[low : low + 128] = self.den * part >= self.num * (sizes[low : low + 128, None] + sizes[None, :] - part)
        return linked


def voronoi_join(space: SketchSpace | SetSpace, counts: dict[str, int] | None = None) -> list[int]:
    """For each point the first one of its component under links; exact, by recursive Voronoi regions: pivots are measured against
    their whole region and leave it, and the others go on in the regions of their nearest pivots, with windows. `counts` gets how
    many components were joined at pivots and in blocks, and how many regions were made."""
    uf, eps, tiny = _Union(len(space.n)), 1 - space.num / space.den, 1e-9
    counts = {} if counts is None else counts
    stack = [np.arange(len(space.n))]

    def joined(where: str, x: int, others: np.ndarray) -> None:
        for y in others.tolist():
            counts[where] = counts.get(where, 0) + uf.join(x, y)

    while stack:
        members = stack.pop()
        roots = [uf.find(int(x)) for x in members]
        if len(set(roots)) < 2:
            continue
        firsts = list(dict(zip(reversed(roots), reversed(range(len(members))), strict=True)).values())
        count = min(PIVOTS, -(-len(members) // PER_PIVOT))
        chosen = sorted(firsts[:: max(1, len(firsts) // count)][:count])
        distances = []
        for p in chosen:
            d, linked = space.measured(int(members[p]), members)
            joined("pivots", int(members[p]), members[linked])
            distances.append(d)
        d = np.stack(distances)
        nearest, least = d.argmin(0), d.min(0)
        near, rest = least <= RADIUS + tiny, np.ones(len(members), bool)
        rest[chosen] = False
        parts = [rest & near & (d[q] <= least + 2 * eps + tiny) for q in range(len(chosen)) if (rest & near & (nearest == q)).any()]
        parts.append(rest & (least > RADIUS - eps - tiny))
        now = np.array([uf.find(int(x)) for x in members])
        parts = [p for p in parts if (now[p] != now[p][:1]).any()]  # others are connected already
        if sum(int(p.sum()) ** 2 for p in parts) > WORTH * len(members) ** 2 and len(members) < BLOCK:
            parts = [rest]  # the windows hold nearly all: one region, without the pivots
        if len(members) < BLOCK or sum(int(p.sum()) ** 2 for p in parts) <= WORTH * len(members) ** 2:
            counts["regions"] = counts.get("regions", 0) + len(parts)
            stack.extend(members[p] for p in parts)
            continue
        linked = space.linked(members)
        left = np.ones(len(members), bool)
        for start in range(len(members)):
            front = np.array([start]) if left[start] else np.zeros(0, int)
            while len(front):
                left[front] = False
                joined("blocks", int(members[start]), members[front])
                front = np.flatnonzero(linked[front].any(0) & left)
    return [uf.find(i) for i in range(len(space.n))]


def _plausible(num: int, den: int):
    """Edges between the documents of a cell that may link; rows (cell, node, sketch) sorted by cell. Only the components of these
    edges matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, sketches, forest = None, [], [], SpanningForest()

        def done():
            if len(nodes) > 1:
                for i, root in enumerate(voronoi_join(SketchSpace(sketches, num, den))):
                    if root != i:
                        forest.join(nodes[root], nodes[i])

        for batch in batches:
            for cell, node, sketch in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if cell != last:
                    done()
                    last, nodes, sketches = cell, [], []
                nodes.append(node)
                sketches.append(sketch)
            if len(forest.up) > FOREST_NODES:
                full = forest.taken()
                yield pa.record_batch([pa.array([v[i] for v in full], pa.int64()) for i in (0, 1)], schema=_LINK)
        done()
        out = forest.taken()
        yield pa.record_batch([pa.array([v[i] for v in out], pa.int64()) for i in (0, 1)], schema=_LINK)

    return run


def _local(num: int, den: int):
    """Links (a, b) within each region; rows (rg, rep, blob) come sorted by rg."""

    def done(reps, sets):
        root = voronoi_join(SetSpace(sets, num, den)) if len(sets) > 1 else [0]
        return [(reps[r], reps[i]) for i, r in enumerate(root) if r != i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reps, sets, out = None, [], [], []
        for batch in batches:
            for rg, rep, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if rg != at:
                    out += done(reps, sets)
                    at, reps, sets = rg, [], []
                reps.append(rep)
                sets.append(np.frombuffer(blob.as_buffer(), np.uint64))
            if len(out) > 10_000:
                yield pa.record_batch([pa.array([v[i] for v in out], pa.int64()) for i in (0, 1)], schema=_LINK)
                out = []
        out += done(reps, sets)
        yield pa.record_batch([pa.array([v[i] for v in out], pa.int64()) for i in (0, 1)], schema=_LINK)

    return run


_ROUND = pa.schema([("rg", pa.int64()), ("rep", pa.int64()), ("other", pa.int64()), ("parent", pa.int64()), ("core", pa.int8()), ("d", pa.float64())])


def _split(num: int, den: int, turn: int):
    """Distances of each member to its region's pivots: links (rg null) and memberships of the next regions."""
    eps, tiny = 1 - num / den, 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last, pivots = [], None, []
            for rg, rep, blob, ps in zip(batch.column("rg").to_pylist(), batch.column("rep").to_pylist(), batch.column("blob"), batch.column("pivots"), strict=True):
                own = np.frombuffer(blob.as_buffer(), np.uint64)
                if rg != last:
                    last, pivots = rg, [(p["rep"], np.frombuffer(p["blob"], np.uint64)) for p in ps.as_py()]
                at = np.concatenate([[0], np.cumsum([len(s) for _, s in pivots])[:-1]])
                inter = overlaps(own, np.concatenate([s for _, s in pivots]), at)
                union = np.array([len(s) for _, s in pivots]) + len(own) - inter
                d, linked = 1 - inter / union, den * inter >= num * union
                out += [(None, rep, pivots[q][0], rg, 1, 0.0) for q in np.flatnonzero(linked) if pivots[q][0] != rep]
                least = d.min()
                if least > RADIUS - eps - tiny:
                    out.append((int(_signed(mix(np.array([rg & (2**64 - 1)], np.uint64) ^ U64(turn * 977 + 13)))[0]), rep, None, rg, 0, 0.0))
                if least <= RADIUS + tiny:
                    for q in np.flatnonzero(d <= least + 2 * eps + tiny):
                        new = mix(np.array([rg & (2**64 - 1)], np.uint64) ^ mix(np.array([pivots[q][0] & (2**64 - 1)], np.uint64) + U64(turn)))
                        out.append((int(_signed(new)[0]), rep, None, rg, int(linked[q]), float(d[q])))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, _ROUND, strict=True)], schema=_ROUND)

    return run


def _sets(k: int):
    schema = pa.schema([("rep", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, held = batch.column(0).to_pylist(), [], 0
            for r, own, second in shingle_sets(batch.column(1), k):
                if len(own):
                    out.append((ids[r], *(int(v) for v in _signed(np.array(set_hashes(own, second), np.uint64))), own.tobytes()))
                    held += len(own)
                if held > 500_000:
                    yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _regions(members: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Links of all groups. members: (rg, rep, n, blob); regions above the local limits are split by pivots, round by round. A round
    leaves at most WORTH of the pairs, or deals blocks below the limits, so rounds end."""
    links, sets, eps = [], members.select("rep", "n", "blob").dropDuplicates(["rep"]), 1 - num / den
    at = members
    fits = f"docs <= {LOCAL_DOCS} and docs * shingles <= {LOCAL_WORK}"
    for turn in itertools.count():
        sizes = at.groupBy("rg").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
        big = written(sizes.where(f"docs > 2 and not ({fits})"), "big")
        regions = big.count()
        local = at.join(big.select("rg"), "rg", "left_anti") if regions else at
        links.append(written(local.select("rg", "rep", "blob").repartition("rg").sortWithinPartitions("rg").mapInArrow(_local(num, den), "a long, b long"), "links"))
        if not regions:
            return links
        large = at.join(F.broadcast(big.select("rg")) if regions * 16 <= BROADCAST_BYTES else big.select("rg"), "rg", "left_semi")
        order = Window.partitionBy("rg").orderBy(F.xxhash64("rep", F.lit(turn)), "rep")
        few = large.select("rg", "rep").withColumn("i", F.row_number().over(order)).where(f"i <= {PIVOTS}").select("rg", "rep")
        few = few.join(sets, "rep").groupBy("rg").agg(F.sort_array(F.collect_list(F.struct("rep", "blob"))).alias("pivots"))
        few = written(few, "pivots")
        weight = few.select(F.sum(F.aggregate("pivots", F.lit(0), lambda s, p: s + F.length(p.blob) + 16))).first()[0] or 0
        dealt = large.join(F.broadcast(few) if weight <= BROADCAST_BYTES else few, "rg").select("rg", "rep", "blob", "pivots")
        found = written(dealt.mapInArrow(_split(num, den, turn), "rg long, rep long, other long, parent long, core byte, d double"), "round")
        links.append(found.where("rg is null").select(F.col("other").alias("a"), F.col("rep").alias("b")))
        nxt = found.where("rg is not null")
        # A region whose members are all linked to its pivot is done; else members linked to it stay if a link may cross.
        edge = nxt.groupBy("rg", "parent").agg(F.min("core").alias("least"), F.min(F.when(F.col("core") == 0, F.col("d"))).alias("inner"))
        nxt = nxt.join(edge.where("least = 0").select("rg", "inner"), "rg").where(f"core = 0 or d >= inner - {eps} - 1e-9")
        parts = nxt.groupBy("parent", "rg").agg(F.count("*").alias("m")).groupBy("parent").agg(F.sum(F.col("m") * F.col("m")).alias("work"))
        stuck = parts.join(big.withColumnRenamed("rg", "parent"), "parent").where(f"work > {WORTH} * docs * docs")
        share = F.greatest(F.col("docs") / LOCAL_DOCS, F.sqrt(F.col("docs") * F.col("shingles") / LOCAL_WORK))
        stuck = written(stuck.select(F.col("parent").alias("rg"), F.ceil(share * 2.2).cast("int").alias("b")), "stuck")
        free = nxt.join(stuck.select(F.col("rg").alias("parent")), "parent", "left_anti").select("rg", "rep")
        # Regions that pivots don't shrink: pairs of blocks of half the local limit, each block chosen by hash.
        blocks = large.join(stuck, "rg").withColumn("i", F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("b")).cast("int"))
        blocks = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select(F.xxhash64("rg", F.least("i", "j"), F.greatest("i", "j"), F.lit(turn)).alias("rg"), "rep")
        at = written(free.unionByName(blocks).join(sets, "rep").select("rg", "rep", "n", "blob"), "members")


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", hot_cell: int = HOT_CELL) -> DataFrame:
    """(id, n_shingles, class_id, component_id) of every row: documents link when den * |x & y| >= num * |x | y| over their
    distinct k-word shingles; class_id is the smallest id with an equal set, component_id the smallest id reachable."""
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    found = text.where("id is not null").mapInArrow(_scan(k, num, den, hot_cell), "key long, a long, x binary")
    found = found.repartition("key").sortWithinPartitions("key").mapInArrow(lambda rows: _found(rows, hot_cell), "kind byte, a long, b long, c long, n long, sketch binary")
    found = written(found, "found")
    rows = found.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("h1"), F.col("c").alias("h2"), "n")
    classes = written(rows.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")), "classes")
    sketches = found.where("kind = 0 and sketch is not null").groupBy(F.col("b").alias("node")).agg(F.max("sketch").alias("sketch"))
    cells = found.where("kind = 2").select(F.col("a").alias("cell"), F.col("b").alias("node")).distinct().join(sketches, "node")
    cells = cells.select("cell", "node", "sketch").repartition("cell").sortWithinPartitions("cell")
    edges = written(found.where("kind = 1").select("a", "b").unionByName(cells.mapInArrow(_plausible(num, den), "a long, b long")).distinct(), "plausible")
    groups = connected_components(edges).select(F.col("node").alias("h1"), F.col("component").alias("rg"))
    wanted = written(classes.join(groups, "h1"), "wanted")
    ids = wanted.select("rep")
    ids = F.broadcast(ids) if wanted.count() * 16 <= BROADCAST_BYTES else ids
    sets = text.join(ids, text.id == ids.rep, "left_semi").mapInArrow(_sets(k), "rep long, h1 long, h2 long, blob binary")
    members = sets.join(wanted, ["rep", "h1", "h2"]).select("rg", "rep", "n", "blob")
    links = None
    for part in _regions(written(members, "members"), num, den):
        links = part if links is None else links.unionByName(part)
    merged = connected_components(links.distinct()).select(F.col("node").alias("rep"), F.col("component").alias("to"))
    named = classes.join(merged, "rep", "left").select("h1", "h2", "n", "rep", F.coalesce("to", "rep").alias("to"))
    out = rows.join(named, ["h1", "h2", "n"], "left")
    out = out.unionByName(text.where("id is null").select("id"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("to", "id").alias("component_id"))


def keep_representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns (whatever their names), of one document of each component: that with the smallest id. Of rows
    that repeat its id one stays. Rows without an id have no component and stay, as do documents without words; an empty table
    stays empty."""
    found = written(jaccard_components(docs, k, num, den, id_col, text_col).select(F.col(id_col).alias("id"), "component_id"), "components")
    gone = written(found.where("component_id <> id").select("id").distinct(), "gone")
    again = written(found.where("component_id = id").groupBy("id").count().where("count > 1").select("id"), "again")

    def joined(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        few = F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids
        return rows.join(few, rows[id_col].cast("long") == ids["id"], how)

    kept = joined(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    return joined(kept, again, "left_anti").unionByName(joined(kept, again, "left_semi").dropDuplicates([id_col]))
