"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model is compiled to arrays. The normaliser N is a transducer over two classes of characters (space and others), before it, where
the model has one, a longest-match rewriting trie (its character map). The lexicon L is a trie of pieces over numbered
characters, each with an arc that ends a piece and goes back to the root; a character outside it has an arc that spells it in byte
pieces (or as the unknown piece). For BPE models the merge-order acceptor M over pieces follows: the step from piece p to
piece q costs 0 if byte-pair merging leaves the boundary between p and q alone and infinity if some merge crosses it; its rules
are tables too (`edges` of the merge trees, ranks of merges).

A text is composed with N, cut into stretches that no piece crosses, and the distinct new stretches of about a megabyte of text are
composed with L and M at once: the trie walks all places of all stretches in parallel and gives the arcs of the lattice, and
the tropical-semiring (min, +) shortest path is relaxed place by place for all stretches together. Unigram arcs cost the
negative scores. With BPE models arcs cost 0, and exactly one path of each prefix is finite. Paths of stretches are kept in a
bounded cache. Stretches above LONG characters are searched alone, in the same semiring.

Decoding runs the inverse machines: pieces to characters, byte pieces to UTF-8, U+2581 to space, the dummy prefix dropped.
Tested against the public library.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.textscan import small_batches

#: Escaped space of the public format, and the surface that decoding gives for an unknown piece.
SPACE_MARK = "▁"
UNKNOWN_SURFACE = " ⁇ "
#: Piece kinds in the public model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Stretches whose paths are kept, the longest that are, and the longest that are searched together.
CACHED_WORDS = 400_000
CACHED_LENGTH = 64
LONG = 48
#: Characters of text whose new stretches are searched together, and the entries of the table of known steps of M.
RUN_CHARS = 1 << 20
KNOWN_STEPS = 1 << 21
INFINITY = float("inf")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, raw[at : at + n]
            at += n


def rewriting_of(charsmap: bytes) -> dict[str, str]:
    """The rules of a precompiled character map: a double-array trie of UTF-8 keys (32-bit units: a leaf flag, a label, an
    offset; the public format of such tries) before a block of null-ended outputs."""
    size = struct.unpack_from("<I", charsmap)[0]
    units, outputs = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist(), charsmap[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    out: dict[str, str] = {}
    stack = [(offset(units[0]), b"")]
    while stack:
        base, key = stack.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at < len(units) and units[at] & 0x800000FF == byte:
                longer = key + bytes([byte])
                below = at ^ offset(units[at])
                if units[at] >> 8 & 1:
                    value = units[below] & 0x7FFFFFFF
                    out[longer.decode()] = outputs[value : outputs.index(b"\0", value)].decode()
                stack.append((below, longer))
    return out


class PieceMachine:
    """A compiled model: encode(text) -> int32 ids, decode(ids) -> text."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.kind, self.byte_fallback, self.unknown = UNIGRAM, False, 0
        self.dummy_prefix, self.squeeze, self.escape, charsmap = True, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                self.kind, self.byte_fallback, self.unknown = own.get(3, UNIGRAM), bool(own.get(35, 0)), own.get(40, 0)
            elif number == 3:
                own = dict(_fields(value))
                charsmap = own.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have a shortest path")
        if USER in kinds:
            raise ValueError("user-defined pieces are not supported")
        self.rewriting = rewriting_of(charsmap) if charsmap else {}
        self.rewrites = re.compile("|".join(map(re.escape, sorted(self.rewriting, key=len, reverse=True)))) if self.rewriting else None
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.surface = [UNKNOWN_SURFACE if k == UNKNOWN else "" if k == CONTROL else p.replace(SPACE_MARK, " ") for p, k in zip(self.pieces, kinds, strict=True)]
        self.lexicon = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        self.floor = min((self.scores[i] for i in self.lexicon.values()), default=0.0) - 10.0
        if self.kind == BPE:
            self._compile_merge_order()
        self.split_words = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.lexicon)
        self.widest = max(map(len, self.lexicon), default=1)
        self.split_lines = not any("\n" in p for p in self.lexicon)
        self._compile_lexicon()
        self.words: dict[str, bytes] = {}

    # The lexicon's trie

    def _compile_lexicon(self) -> None:
        letters = sorted({c for p in self.lexicon for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number, arcs, ends = {c: i + 1 for i, c in enumerate(letters)}, {}, {}
        for text, piece in self.lexicon.items():
            state = 0
            for c in text:
                state = arcs.setdefault(state << 24 | number[c], len(arcs) + 1)
            ends[state] = piece
        self.arc_key = np.array(sorted(arcs), np.int64)
        self.arc_to = np.array([arcs[k] for k in self.arc_key.tolist()], np.int64)
        self.ends = np.full(len(arcs) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.cost = np.zeros(len(self.pieces), np.float32) if self.kind == BPE else -np.array(self.scores, np.float32)
        self.alone = np.zeros(len(letters) + 1, bool)  # letters that are pieces themselves
        self.alone[[number[c] for c in self.lexicon if len(c) == 1]] = True

    def _lattice(self, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of every arc: all pieces that start at each place; left: characters from there to the end of the
        stretch."""
        place, state = np.arange(len(code)), np.zeros(len(code), np.int64)
        found = []
        for depth in range(self.widest):
            ok = left[place] > depth
            place, state = place[ok], state[ok]
            key = state << 24 | code[place + depth]
            at = np.searchsorted(self.arc_key, key)
            at[at == len(self.arc_key)] = 0
            ok = self.arc_key[at] == key if len(self.arc_key) else np.zeros(len(key), bool)
            place, state = place[ok], self.arc_to[at[ok]]
            piece = self.ends[state]
            full = piece >= 0
            found.append((place[full], np.full(int(full.sum()), depth + 1), piece[full]))
            if not len(place):
                break
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _paths(self, stretches: list[str]) -> list[bytes]:
        """The shortest paths of stretches of at most LONG characters, all at once."""
        sizes = np.array([len(w) for w in stretches])
        first = np.concatenate([[0], np.cumsum(sizes)])
        code = self.letter[np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.arange(len(code)) - first[word]
        place, length, piece = self._lattice(code, sizes[word] - inner)
        odd = np.flatnonzero(~self.alone[code])  # spelt in byte pieces
        none = len(self.pieces)
        penalty = np.float32(0 if self.kind == BPE else -self.floor)
        place, length = np.concatenate([place, odd]), np.concatenate([length, np.ones(len(odd), np.int64)])
        weight = np.concatenate([self.cost[piece], np.full(len(odd), penalty, np.float32)])
        piece = np.concatenate([piece, np.full(len(odd), none)])
        order = np.lexsort((length, inner[place]))
        place, length, piece, weight = place[order], length[order], piece[order], weight[order]
        starts = np.searchsorted(inner[place], np.arange(int(sizes.max(initial=0)) + 1))
        # One state for each place of each stretch: place p of stretch w is first[w] + w + p.
        state = place + word[place]
        cost = np.full(len(code) + len(sizes), np.inf, np.float32)
        last, back = np.full(len(cost), none), np.zeros(len(cost), np.int64)
        cost[first[:-1] + np.arange(len(sizes))] = 0
        for i in range(len(starts) - 1):
            a, b = starts[i], starts[i + 1]
            here, q = state[a:b], piece[a:b]
            to, total = here + length[a:b], cost[here] + weight[a:b]
            if self.kind == BPE:
                p = last[here]
                pairs = np.flatnonzero((p < none) & (q < none) & (total < cost[to]))
                total[pairs[~self._stay(p[pairs], q[pairs])]] = np.inf
            better = total < cost[to]
            to = to[better]
            cost[to], last[to], back[to] = total[better], q[better], here[better]
        # Back from the ends, all stretches together.
        at, taken = first[1:] + np.arange(len(sizes)), []
        alive = np.flatnonzero(sizes > 0)
        while len(alive):
            own = at[alive]
            taken.append((alive, last[own], back[own]))
            at[alive] = back[own]
            alive = alive[at[alive] > first[alive] + alive]
        out: list[list[int]] = [[] for _ in stretches]
        for owners, pieces, froms in taken:
            for w, q, f in zip(owners.tolist(), pieces.tolist(), froms.tolist(), strict=True):
                out[w] += [q] if q < none else self._spelt(stretches[w][f - first[w] - w])[::-1]
        return [np.array(ids[::-1], "<i4").tobytes() for ids in out]

    # The merge-order acceptor

    def _compile_merge_order(self) -> None:
        """For each piece the pieces at its right (left) edge while it is merged together, each with the rank of the merge
        that ends it. Ranks follow the scores; single characters are there from the start."""
        order = sorted(self.lexicon.values(), key=lambda i: (-self.scores[i], i))
        self.rank = {p: r for r, p in enumerate(order)}
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        for text, piece in self.lexicon.items():
            parts = self._merged(text)
            if parts is None:
                continue
            right, left = [(piece, INFINITY)], [(piece, INFINITY)]
            for found, side in ((right, 1), (left, 0)):
                at = piece
                while at in parts:
                    found.append((parts[at][side], self.rank[at]))
                    at = parts[at][side]
            self.right[piece], self.left[piece] = right, left
        self.lexicon = {t: p for t, p in self.lexicon.items() if p in self.right}
        self.steps: dict[int, bool] = {}
        #: The trie of the reversed pieces: ending -> piece, or -1 if it only ends one.
        self.endings = {t[i:]: -1 for t in self.lexicon for i in range(1, len(t))} | self.lexicon
        # The same as tables: edges[side][piece, level] and the rank that ends each; pairs of pieces that merge, with their ranks.
        never, size = len(self.lexicon) + 1, len(self.pieces)
        levels = max((len(e) for side in (self.right, self.left) for e in side.values()), default=1)
        self.edges, self.until = np.full((2, size, levels), -1, np.int64), np.full((2, size, levels), -1, np.int64)
        for side, every in enumerate((self.right, self.left)):
            for piece, found in every.items():
                self.edges[side, piece, : len(found)] = [e for e, _ in found]
                self.until[side, piece, : len(found)] = [never if r == INFINITY else r for _, r in found]
        merges = {self.lexicon[t[:i]] * size + self.lexicon[t[i:]]: self.rank[self.lexicon[t]] for t in self.lexicon for i in range(1, len(t)) if t[:i] in self.lexicon and t[i:] in self.lexicon}
        self.merge_key = np.array(sorted(merges) or [-1], np.int64)
        self.merge_rank = np.array([merges.get(k, never) for k in self.merge_key.tolist()], np.int64)
        self.known, self.stay_of = np.full(KNOWN_STEPS, -1, np.int64), np.zeros(KNOWN_STEPS, bool)

    def _merged(self, text: str) -> dict[int, tuple[int, int]] | None:
        """How merging builds this piece from its characters: piece -> (left part, right part); None if it never does."""
        every = self.lexicon
        now = [every.get(c) for c in text]
        if None in now:
            return None
        spelt, parts = list(text), {}
        while len(now) > 1:
            best = None
            for i in range(len(now) - 1):
                m = every.get(spelt[i] + spelt[i + 1])
                if m is not None and (best is None or self.rank[m] < best[0]):
                    best = (self.rank[m], i, m)
            if best is None:
                return None
            _, i, m = best
            parts[m] = (now[i], now[i + 1])
            spelt[i : i + 2], now[i : i + 2] = [spelt[i] + spelt[i + 1]], [m]
        return parts

    def stays(self, p: int, q: int) -> bool:
        """Does M let q follow p? Not if pieces that meet at the boundary at some time are merged there before their own
        merges end them; of merges of one rank the leftmost comes first."""
        for a, ends_a in self.right[p]:
            for b, ends_b in self.left[q]:
                m = self.lexicon.get(self.pieces[a] + self.pieces[b])
                if m is not None and (r := self.rank[m]) < ends_a and r <= ends_b:
                    return False
        return True

    def _stay(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """`stays` for arrays of pairs, by the tables; a table of fixed size keeps pairs that were met."""
        size = len(self.pieces)
        key = p * size + q
        slot = (key * 0x9E3779B1 >> 13) & (KNOWN_STEPS - 1)
        out = self.stay_of[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            fresh, where = np.unique(key[new], return_inverse=True)
            a, b = fresh // size, fresh % size
            ok = np.ones(len(fresh), bool)
            for i in range(self.edges.shape[2]):
                there = np.flatnonzero(self.edges[0, a, i] >= 0)
                if not len(there):
                    break
                for j in range(self.edges.shape[2]):
                    both = there[self.edges[1, b[there], j] >= 0]
                    if not len(both):
                        break
                    pair = self.edges[0, a[both], i] * size + self.edges[1, b[both], j]
                    at = np.minimum(np.searchsorted(self.merge_key, pair), len(self.merge_key) - 1)
                    rank = self.merge_rank[at]
                    ok[both] &= ~((self.merge_key[at] == pair) & (rank < self.until[0, a[both], i]) & (rank <= self.until[1, b[both], j]))
            out[new] = ok[where]
            slot = (fresh * 0x9E3779B1 >> 13) & (KNOWN_STEPS - 1)
            self.known[slot] = -1  # of pairs that share a slot none is kept
            _, group, times = np.unique(slot, return_inverse=True, return_counts=True)
            single = times[group] == 1
            self.known[slot[single]], self.stay_of[slot[single]] = fresh[single], ok[single]
        return out

    # Composition and shortest path

    def _spelt(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_fallback else [self.unknown]

    def _path(self, text: str) -> list[int]:
        """The shortest path of one stretch of normalised text."""
        if self.kind == UNIGRAM:
            return self._cheapest(text)
        lexicon, endings, steps, size, widest = self.lexicon, self.endings, self.steps, len(self.pieces), self.widest
        n = len(text)
        last, back = [-1] * (n + 1), [-1] * (n + 1)
        last[0] = size  # the start: any piece may follow
        for j in range(1, n + 1):
            for i in range(j - 1, j - widest - 1 if j > widest else -1, -1):
                q = endings.get(text[i:j])
                if q is None:
                    break  # no piece ends so
                if q < 0:
                    continue
                p = last[i]
                if p < size:
                    if p < 0:
                        continue
                    key = p * size + q
                    ok = steps.get(key)
                    if ok is None:
                        ok = steps[key] = self.stays(p, q)
                    if not ok:
                        continue
                last[j], back[j] = q, i
                break
            if last[j] < 0 and text[j - 1] not in lexicon:
                last[j], back[j] = size, j - 1  # byte pieces are never merged: any piece may follow
        out: list[int] = []
        while n:
            out += [last[n]] if last[n] < size else reversed(self._spelt(text[n - 1]))
            n = back[n]
        return out[::-1]

    def _cheapest(self, text: str) -> list[int]:
        lexicon, cost_of, widest, n = self.lexicon, self.cost, self.widest, len(text)
        cost, back = [np.float32(0)] + [np.float32(np.inf)] * n, [(0, -1)] * (n + 1)
        penalty = np.float32(-self.floor)
        for i in range(n):
            for j in range(i + 1, min(n, i + widest) + 1):
                q = lexicon.get(text[i:j])
                if q is not None and cost[i] + cost_of[q] < cost[j]:
                    cost[j], back[j] = cost[i] + cost_of[q], (i, q)
            if text[i] not in lexicon and cost[i] + penalty < cost[i + 1]:
                cost[i + 1], back[i + 1] = cost[i] + penalty, (i, -1)
        out: list[int] = []
        while n:
            i, q = back[n]
            out += [q] if q >= 0 else reversed(self._spelt(text[i]))
            n = i
        return out[::-1]

    def normalise(self, text: str) -> str:
        """The text composed with the normaliser. Its states are: at the start, after a space, after another character; each
        character's output depends on the state and on whether it is a space."""
        if self.rewrites is not None:
            text = self.rewrites.sub(lambda m: self.rewriting[m[0]], text)
        if self.squeeze and (text[:1] == " " or text[-1:] == " " or "  " in text):
            raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            space = raw == 32
            state = np.concatenate([[0], np.where(space, 1, 2)])[:-1]
            emits = np.array([[True, False], [True, False], [True, True]])  # state x is a space
            kept = raw[emits[state, space.astype(int)]]
            if len(kept) and kept[-1] == 32:
                kept = kept[:-1]
            text = kept.tobytes().decode("utf-32-le", "surrogatepass")
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE_MARK) if self.escape else text

    def _stretches(self, text: str) -> list[str]:
        """The normalised text, cut where no piece crosses: before runs of U+2581 and around line ends (which are spelt)."""
        norm = self.normalise(text)
        if not self.split_words:
            return [norm] if norm else []
        doubled, lines = SPACE_MARK + SPACE_MARK, self.split_lines
        if doubled not in norm:
            norm = norm.replace(SPACE_MARK, " " + SPACE_MARK) if " " not in norm else None
            if norm is not None:
                return (norm.replace("\n", " \n ") if lines else norm).split(" ")
            norm = self.normalise(text)
        line = "\n" if lines else ""
        return re.findall(f"{SPACE_MARK}+[^{SPACE_MARK}{line}]*|[^{SPACE_MARK}{line}]+" + ("|\n" if lines else ""), norm)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; stretches that are new are searched together."""
        words, i = self.words, 0
        if len(words) > CACHED_WORDS:
            words.clear()
        while i < len(texts):
            parts, held = [], 0
            while i < len(texts) and (not parts or held + len(texts[i]) <= RUN_CHARS):
                parts.append(self._stretches(texts[i]))
                held += len(texts[i])
                i += 1
            fresh = set().union(*parts).difference(words)
            short = [w for w in fresh if len(w) <= LONG]
            own = {w: np.array(self._path(w), "<i4").tobytes() for w in fresh if len(w) > LONG} if len(short) < len(fresh) else {}
            for k in range(0, len(short), 50_000):
                own.update(zip(short[k : k + 50_000], self._paths(short[k : k + 50_000]), strict=True))
            for p in parts:
                ids = np.frombuffer(b"".join([words[w] if w in words else own[w] for w in p]), "<i4")
                if not self.byte_fallback and len(ids):  # unknown pieces in a row are one
                    ids = ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])]
                yield ids
            words.update({w: v for w, v in own.items() if len(w) <= CACHED_LENGTH})
            if self.kind == BPE and len(self.steps) > 4 * CACHED_WORDS:
                self.steps.clear()

    def encode(self, text: str) -> np.ndarray:
        return next(iter(self.encode_all([text])))

    def decode(self, ids: np.ndarray) -> str:
        surface, byte_of, ids = self.surface, self.byte_of, ids.tolist()
        if byte_of and not byte_of.keys().isdisjoint(ids):
            out, held = [], bytearray()
            for i in ids:
                b = byte_of.get(i)
                if b is not None:
                    held.append(b)
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held = bytearray()
                out.append(surface[i])
            out.append(held.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            text = "".join([surface[i] for i in ids])
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


_machines: dict[str, PieceMachine] = {}


def machine(vocabulary: str = "piece_bpe_32k.model", path: str | None = None) -> PieceMachine:
    """The compiled model of a public vocabulary file (or of the file at `path`), kept for the life of the worker."""
    key = path or vocabulary
    if key not in _machines:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        with open(path, "rb") as f:
            _machines[key] = PieceMachine(f.read())
    return _machines[key]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", path: str | None = None, digest: bool = False) -> DataFrame:
    """(id, ids array<int>, decoded string) of every row; with digest=True (id, n_ids, ids_crc32, decoded_bytes,
    decoded_crc32, round_trip), the checksums of little-endian int32 ids and of the decoded UTF-8.

    Null and empty texts have no ids and decode to an empty text. round_trip: the decoded text is the text itself; it is not
    where the text holds U+2581, which decodes to a space. Ids, null ones too, and repeated rows pass through; an empty table gives
    no row; very long texts are encoded whole; of paths that tie the one with the longer first pieces is taken, as in the library.
    Other columns, those named as results too, are not read.
    """
    small_batches(docs.sparkSession)
    if digest:
        ddl = "id long, n_ids long, ids_crc32 long, decoded_bytes long, decoded_crc32 long, round_trip boolean"
        schema = pa.schema([("id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_bytes", pa.int64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_())])
    else:
        ddl = "id long, ids array<int>, decoded string"
        schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = machine(vocabulary, path)
        for batch in batches:
            out, held = [], 0
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, text, ids in zip(batch.column(0).to_pylist(), texts, model.encode_all(texts), strict=True):
                decoded = model.decode(ids)
                if digest:
                    raw = decoded.encode()
                    out.append((doc, len(ids), zlib.crc32(ids.tobytes()), len(raw), zlib.crc32(raw), decoded == text))
                else:
                    out.append((doc, ids, decoded))
                    held += len(ids)
                if held > 1_000_000:
                    yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ddl).withColumnRenamed("id", id_col)
