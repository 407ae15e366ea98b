"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into a lexicon machine (a trie of pieces, closed under
concatenation) with byte fallback for characters outside it. The normaliser (prefix,
space escapes, optional folding of spaces) is vectorised code over the input, not a
machine. An encoding is the tropical-semiring shortest path of the normalised input
through the lexicon.

Unigram models weigh a piece by its negated score. A merge (BPE) model has no
additive weights that give its result, so its lexicon is composed with one more
machine, an acceptor over neighbouring pieces: (a, b) is accepted if merging the
text a+b leaves exactly a and b. Every text has one path through that composition,
the model's own encoding, and paths to a position can be cut to the best one, so
the search is the usual Viterbi pass with arcs that the acceptor removes.

Texts are cut where no piece spans two neighbouring characters, which no path
crosses; equal cuts of a batch are searched once, all of them in step (one
position further at a time), and results of frequent cuts are kept in a table of
bounded size between batches.

Only the identity character map is supported (others raise). Defined results: null
and empty texts have no tokens and round-trip. Texts with U+2581 decode to spaces
there and don't round-trip. Other columns are passed through by `encode_column`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BATCH_BYTES = 1 << 18
KEPT_CHUNKS = 100_000
#: Parts after which freed memory goes back to the system.
TRIMMED = 4
KEPT_PAIRS = 100_000
LONG = 400
MAX_MODEL_BYTES = 64 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, raw[i : i + n]
            i += n


class Model:
    """The compiled transducer."""

    def __init__(self, raw: bytes):
        pieces, kind_of_model = [], 1
        self.prefix, self.fold, self.escape = True, True, True
        for number, value in _fields(raw):
            if number == 1:
                one = dict(_fields(value))
                pieces.append((one[1].decode(), struct.unpack("<f", one[2])[0] if 2 in one else 0.0, one.get(3, NORMAL)))
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(2):
                    raise ValueError("only the identity character map is supported")
                self.prefix, self.fold, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        if kind_of_model not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.merges = kind_of_model == 2
        self.pieces = pieces
        self.bytes = np.full(256, -1, np.int32)
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.id: dict[str, int] = {}
        self.score = np.array([p[1] for p in pieces])
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
            elif kind in (NORMAL, USER):
                self.id.setdefault(text, i)
        if any(p[2] == USER for p in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.fallback = bool((self.bytes >= 0).all())
        worst = self.score[list(self.id.values())].min() if self.id else 0.0
        self.unknown_cost = 10.0 - worst
        self._lexicon()
        self._events: dict[int, tuple] = {}
        self._pairs: dict[int, bool] = {}
        self.seen_key = np.full(1 << 20, -1, np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.kept: pa.Array | None = None
        self.kept_ids, self.kept_ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        raw_pieces = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else t.replace(SPACE, " ").encode() for t, _, k in pieces]
        self.out_ends = np.concatenate(([0], np.cumsum([len(p) for p in raw_pieces])))
        self.out_data = np.frombuffer(b"".join(raw_pieces), np.uint8)

    def _lexicon(self) -> None:
        """The trie of the pieces: moves by code point, and the piece of a node."""
        inner = {""} | {t[:k] for t in self.id for k in range(1, len(t))}
        ordered = sorted(inner, key=lambda t: (len(t), t))
        number = {t: i for i, t in enumerate(ordered)}
        leaves = sorted(set(self.id) - inner)
        number |= {t: len(ordered) + i for i, t in enumerate(leaves)}
        self.inner = len(ordered)
        self.piece = np.full(len(number), -1, np.int32)
        keys, to, spans = [], [], set()
        for t, node in number.items():
            if t:
                keys.append(number[t[:-1]] << 21 | ord(t[-1]))
                to.append(node)
                if len(t) > 1:
                    spans.add(ord(t[-2]) << 21 | ord(t[-1]))
            if t in self.id:
                self.piece[node] = self.id[t]
        self.root = np.full(0x110001, -1, np.int32)
        for key, node in zip(keys, to, strict=True):
            if key >> 21 == 0:
                self.root[key] = node
        order = np.argsort(keys)
        self.moves = Table(np.array(keys, np.int64)[order], np.array(to, np.int32)[order])
        self.spans = Table(np.array(sorted(spans), np.int64), np.ones(len(spans), np.int32))
        self.longest = max(map(len, self.id), default=1)

    # the acceptor of neighbouring pieces

    def _merged(self, a: str, b: str) -> float | None:
        i = self.id.get(a + b)
        return None if i is None else self.score[i]

    def events(self, piece: int) -> tuple:
        """Merges that build a piece's text on its own, in order: (score, place, first symbol after it, last symbol after it), and whether they end in the piece."""
        got = self._events.get(piece)
        if got is None:
            text = self.pieces[piece][0]
            parts, out = list(text), []
            while len(parts) > 1:
                best = None
                for k in range(len(parts) - 1):
                    s = self._merged(parts[k], parts[k + 1])
                    if s is not None and (best is None or s > best[0]):
                        best = (s, k)
                if best is None:
                    break
                s, k = best
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                out.append((s, parts[0], parts[-1]))
            got = self._events[piece] = (text[0], text[-1], out, len(parts) == 1)
        return got

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b leaves exactly these two pieces."""
        key = a << 20 | b
        got = self._pairs.get(key)
        if got is None:
            got = self._neighbours(a, b)
            if len(self._pairs) < KEPT_PAIRS:
                self._pairs[key] = got
        return got

    def _neighbours(self, a: int, b: int) -> bool:
        _, right, of_a, whole_a = self.events(a)
        left, _, of_b, whole_b = self.events(b)
        if not (whole_a and whole_b):
            return False
        i = j = 0
        none = float("-inf")
        while True:
            across = self._merged(right, left)
            next_a = of_a[i][0] if i < len(of_a) else none
            next_b = of_b[j][0] if j < len(of_b) else none
            if across is not None and across > next_a and across >= next_b:
                return False
            if i == len(of_a) and j == len(of_b):
                return across is None
            if i < len(of_a) and next_a >= next_b:
                right = of_a[i][2]
                i += 1
            else:
                left = of_b[j][1]
                j += 1

    def accepted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """neighbours() of arrays; a < 0 is the start of a text."""
        out = a < 0
        at = np.flatnonzero(~out)
        if not self.merges:
            return np.ones(len(a), bool)
        key = a[at].astype(np.int64) << 20 | b[at]
        slot = (key * 0x9E3779B97F4A7C1) >> 20 & (len(self.seen_key) - 1)
        known = self.seen_key[slot] == key
        out[at[known]] = self.seen[slot[known]]
        if not known.all():
            late = at[~known]
            fresh, back = np.unique(key[~known], return_inverse=True)
            value = np.array([self.neighbours(k >> 20, k & 0xFFFFF) for k in fresh.tolist()], bool)
            out[late] = value[back]
            where = (fresh * 0x9E3779B97F4A7C1) >> 20 & (len(self.seen_key) - 1)
            self.seen_key[where] = fresh
            self.seen[where] = value  # of keys that share a slot the last one stays, in both
        return out

    # shortest paths

    def fallback_ids(self, code: int) -> list[int]:
        if not self.fallback:
            return [self.unknown]
        return [int(self.bytes[b]) for b in chr(code).encode("utf-8", "replace")]

    def path(self, codes: np.ndarray) -> list[int]:
        """The shortest path of one input, position by position."""
        text = "".join(map(chr, codes.tolist()))
        n = len(text)
        cost, back = [0.0] + [float("inf")] * n, [None] * (n + 1)
        for i in range(n):
            if cost[i] == float("inf"):
                continue
            last = back[i][1] if back[i] else -1
            if text[i] not in self.id and cost[i] + self.unknown_cost < cost[i + 1]:
                cost[i + 1], back[i + 1] = cost[i] + self.unknown_cost, (i, -1)
            for size in range(1, min(self.longest, n - i) + 1):
                piece = self.id.get(text[i : i + size])
                if piece is None:
                    continue
                weight = 0.0 if self.merges else -self.score[piece]
                if cost[i] + weight < cost[i + size] and (not self.merges or last < 0 or self.neighbours(last, piece)):
                    cost[i + size], back[i + size] = cost[i] + weight, (i, piece)
        out: list[list[int]] = []
        i = n
        while i:
            if back[i] is None:
                raise ValueError("no path")
            j, piece = back[i]
            out.append([piece] if piece >= 0 else self.fallback_ids(ord(text[j])))
            i = j
        return [x for step in reversed(out) for x in step]

    def paths(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortest paths of many inputs (codes[first:first+size]) in step: (token ids, ends)."""
        lanes = len(size)
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        deepest = int(size[0]) if lanes else 0
        # last[i, lane]: piece that ends the best path to position i (-1 start or fallback, -2 none); cost of that path
        last = np.full((deepest + 1, lanes), -2, np.int32)
        come = np.zeros((deepest + 1, lanes), np.int32)
        cost = np.full((deepest + 1, lanes), np.inf, np.float32 if self.merges else np.float64)
        last[0], cost[0] = -1, 0
        live_lane = np.zeros(0, np.int32)
        live_start = np.zeros(0, np.int32)
        live_node = np.zeros(0, np.int32)
        for i in range(deepest):
            n = int(np.searchsorted(-size, -i, "left"))  # lanes with a character at i
            code = codes[first[:n] + i]
            keep = live_lane < n
            live_lane, live_start, live_node = live_lane[keep], live_start[keep], live_node[keep]
            node = self.moves.get(live_node.astype(np.int64) << 21 | code[live_lane])
            keep = node >= 0
            open_ = np.flatnonzero(last[i, :n] > -2).astype(np.int32)
            begin = self.root[code[open_]]
            have = begin >= 0
            lane = np.concatenate([live_lane[keep], open_[have]])
            start = np.concatenate([live_start[keep], np.full(int(have.sum()), i, np.int32)])
            node = np.concatenate([node[keep], begin[have]])
            piece = self.piece[node]
            arc = np.flatnonzero(piece >= 0)
            a_lane, a_start, a_piece = lane[arc], start[arc], piece[arc]
            fine = self.accepted(last[a_start, a_lane], a_piece)
            a_lane, a_start, a_piece = a_lane[fine], a_start[fine], a_piece[fine]
            if self.merges:  # one path: whatever is accepted is it
                last[i + 1, a_lane], come[i + 1, a_lane], cost[i + 1, a_lane] = a_piece, a_start, 0
            else:
                total = cost[a_start, a_lane] - self.score[a_piece]
                by = np.lexsort((-a_start, -total))  # the best is written last
                last[i + 1, a_lane[by]], come[i + 1, a_lane[by]], cost[i + 1, a_lane[by]] = a_piece[by], a_start[by], total[by]
            odd = open_[(begin < 0) | (self.piece[begin] < 0)]
            odd = odd[~np.isin(code[odd], self.single)] if len(odd) else odd
            if len(odd):
                worse = cost[i, odd] + self.unknown_cost < cost[i + 1, odd]
                odd = odd[worse]
                last[i + 1, odd], come[i + 1, odd], cost[i + 1, odd] = -1, i, 0 if self.merges else cost[i, odd] + self.unknown_cost
            more = node < self.inner
            live_lane, live_start, live_node = lane[more], start[more], node[more]
        return self._trace(codes, first, size, order, last, come)

    @property
    def single(self) -> np.ndarray:
        if not hasattr(self, "_single"):
            self._single = np.array([ord(t) for t in self.id if len(t) == 1])
        return self._single

    def _trace(self, codes, first, size, order, last, come) -> tuple[np.ndarray, np.ndarray]:
        lane = np.arange(len(size))
        at = size.copy()
        lanes_out, place_out, ids_out = [], [], []
        while len(lane):
            piece, start = last[at, lane], come[at, lane]
            if (piece == -2).any():
                raise ValueError("no path")
            whole = piece >= 0
            lanes_out.append(lane[whole])
            place_out.append(start[whole].astype(np.int64) * 4)
            ids_out.append(piece[whole])
            for x, s in zip(lane[~whole], start[~whole], strict=True):
                for k, b in enumerate(self.fallback_ids(int(codes[first[x] + s]))):
                    lanes_out.append(np.array([x]))
                    place_out.append(np.array([int(s) * 4 + k]))
                    ids_out.append(np.array([b], np.int32))
            more = start > 0
            lane, at = lane[more], start[more]
        lanes_all = order[np.concatenate(lanes_out)] if lanes_out else np.zeros(0, np.int64)
        by = np.lexsort((np.concatenate(place_out), lanes_all)) if lanes_out else np.zeros(0, np.int64)
        ids = np.concatenate(ids_out)[by].astype(np.int32) if lanes_out else np.zeros(0, np.int32)
        return ids, np.concatenate(([0], np.cumsum(np.bincount(lanes_all, minlength=len(size)))))

    # batches

    def normalise(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points after the normaliser, and where texts begin."""
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        begin = chars[offsets]
        if len(codes) != begin[-1]:  # invalid UTF-8 somewhere: text by text
            each = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            begin = np.concatenate(([0], np.cumsum([len(t) for t in each])))
            codes = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32)
        if self.fold:
            space = codes == 32
            keep = np.ones(len(codes), bool)
            keep[1:] = ~space[1:] | ~space[:-1]
            lead = begin[:-1][begin[:-1] < len(codes)]
            keep[lead] = ~space[lead]
            total = np.concatenate(([0], np.cumsum(keep)))
            codes, begin = codes[keep], total[begin]
            tail = begin[1:] - 1
            tail = tail[(np.diff(begin) > 0) & (tail >= 0)]
            tail = tail[codes[tail] == 32]
            if len(tail):
                keep = np.ones(len(codes), bool)
                keep[tail] = False
                total = np.concatenate(([0], np.cumsum(keep)))
                codes, begin = codes[keep], total[begin]
        if self.prefix:
            some = np.flatnonzero(np.diff(begin) > 0)
            codes = np.insert(codes, begin[some], 32)
            begin = begin + np.concatenate(([0], np.cumsum(np.diff(begin) > 0)))
        codes = codes.astype(np.int64)
        return (np.where(codes == 32, ord(SPACE), codes) if self.escape else codes), begin

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, ends) of a string column."""
        codes, begin = self.normalise(*tx.utf8(column))
        n = len(codes)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(begin), np.int64)
        cut = np.ones(n + 1, bool)
        if n > 1:
            cut[1:-1] = self.spans.get(codes[:-1] << 21 | codes[1:]) < 0
        cut[begin] = True
        edge = np.flatnonzero(cut)
        wide = codes.astype(np.uint32)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge * 4), pa.py_buffer(wide)])
        coded = chunks.dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        ids, ends = self.look_up(distinct)
        size = np.diff(ends)[which]
        total = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(total[-1]) - np.repeat(total[:-1] - ends[which], size)
        return ids[at], total[np.searchsorted(edge, begin)]

    def look_up(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Paths of distinct cuts, from the kept table or by search."""
        found = pc.index_in(distinct, value_set=self.kept).fill_null(-1).to_numpy(zero_copy_only=False) if self.kept is not None else np.full(len(distinct), -1)
        new = np.flatnonzero(found < 0)
        fresh = distinct.take(pa.array(new))
        ids, ends = self.solve(fresh)
        n_old = np.diff(self.kept_ends)
        size = np.empty(len(distinct), np.int64)
        size[new] = np.diff(ends)
        old = np.flatnonzero(found >= 0)
        size[old] = n_old[found[old]]
        start = np.empty(len(distinct), np.int64)
        start[new] = ends[:-1] + len(self.kept_ids)
        start[old] = self.kept_ends[:-1][found[old]]
        pool = np.concatenate([self.kept_ids, ids])
        total = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(total[-1]) - np.repeat(total[:-1] - start, size)
        out = pool[at]
        room = KEPT_CHUNKS - (len(self.kept) if self.kept is not None else 0)
        if room > 0 and len(new):
            take = np.arange(min(room, len(new)))
            short = take[np.diff(ends)[take] <= 64]
            add = fresh.take(pa.array(short))
            at = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in short]) if len(short) < 1000 else _ranges(ends[:-1][short], np.diff(ends)[short])
            self.kept = pa.concat_arrays([self.kept, add]) if self.kept is not None else add
            self.kept_ids = np.concatenate([self.kept_ids, ids[at.astype(np.int64)]])
            self.kept_ends = np.concatenate([self.kept_ends, self.kept_ends[-1] + np.cumsum(np.diff(ends)[short])])
        return out, total

    def solve(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = tx.utf8(chunks)
        codes = np.frombuffer(data.tobytes(), np.uint32).astype(np.int64)
        first, size = offsets[:-1] // 4, np.diff(offsets) // 4
        slow = np.flatnonzero(size > LONG)
        quick = np.flatnonzero(size <= LONG)
        ids, ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        counts = np.zeros(len(size), np.int64)
        parts = []
        by = quick[np.argsort(size[quick], kind="stable")]
        step = 1 << 16
        at = 0
        while at < len(by):  # blocks of like lengths, so that the tables of a block stay small
            width = max(1, min(step, (1 << 19) // int(size[by[min(at + step, len(by)) - 1]] + 1)))
            block = by[at : at + width]
            ids, ends = self.paths(codes, first[block], size[block])
            parts.append((block, ids, ends))
            counts[block] = np.diff(ends)
            at += width
        for k in slow:
            ids = np.array(self.path(codes[first[k] : first[k] + size[k]]), np.int32)
            parts.append((np.array([k]), ids, np.array([0, len(ids)])))
            counts[k] = len(ids)
        total = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(total[-1], np.int32)
        for block, ids, ends in parts:
            out[_ranges(total[block], np.diff(ends))] = ids
        return out, total

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of token lists; the prefix's space is taken off."""
        size = np.diff(self.out_ends)[ids]
        data = self.out_data[_ranges(self.out_ends[:-1][ids], size)]
        total = np.concatenate(([0], np.cumsum(size)))
        offsets = total[ends]
        if self.prefix:
            lead = offsets[:-1][np.diff(offsets) > 0]
            lead = lead[data[lead] == 32]
            keep = np.ones(len(data), bool)
            keep[lead] = False
            moved = np.concatenate(([0], np.cumsum(keep)))
            return data[keep], moved[offsets]
        return data, offsets


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - size - start, size)


class Table:
    """int64 -> int32 from 0 by open addressing, read for whole arrays; -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(2 * len(keys) + 1).bit_length() + 1)
        self.key = np.zeros(1 << self.bits, np.int64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.value[slot[todo]] < 0
            _, one = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][one]
            self.key[slot[put]], self.value[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.value[slot]
        open_ = np.flatnonzero((self.key[slot] != keys) & (out >= 0))
        out[(self.key[slot] != keys)] = -1
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            value = self.value[slot]
            hit = (value >= 0) & (self.key[slot] == keys[open_])
            out[open_[hit]] = value[hit]
            more = ~hit & (value >= 0)
            open_, slot = open_[more], slot[more]
        return out


@lru_cache(maxsize=2)
def compiled(raw: bytes) -> Model:
    return Model(raw)


def load(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"a model of more than {MAX_MODEL_BYTES} bytes is not broadcast")
    return raw


def _run_encode(held, column: int, keep: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = compiled(held.value)
        for n, part in enumerate(tx.slices(batches, column, BATCH_BYTES)):
            if n % TRIMMED == 0:
                tx.release()
            ids, ends = model.encode(part.column(column))
            data, offsets = tx.utf8(part.column(column))
            back, at = model.decode(ids, ends)
            same = np.diff(at) == np.diff(offsets)
            if len(back) == len(data) and (at == offsets).all():
                wrong = np.concatenate(([0], np.cumsum(back != data)))
                same &= np.diff(wrong[offsets]) == 0
            else:
                for k in np.flatnonzero(same):
                    same[k] = back[at[k] : at[k + 1]].tobytes() == data[offsets[k] : offsets[k + 1]].tobytes()
            low, high = model.bytes.min(), model.bytes.max()
            fallen = np.concatenate(([0], np.cumsum((ids >= low) & (ids <= high)))) if model.fallback else np.zeros(len(ids) + 1, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(np.diff(ends)), pa.array(np.diff(fallen[ends])), lists, pa.array(same)], names=names)

    return run


def encode_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids, round_trip) of every text; round_trip: decoding gives the text again."""
    held = docs.sparkSession.sparkContext.broadcast(load(model_path))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    names = ["doc_id", "n_tokens", "n_byte_tokens", "ids", "round_trip"]
    return rows.mapInArrow(_run_encode(held, 1, [0], names), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, n_byte_tokens long, ids array<int>, round_trip boolean")


def decode_column(rows: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) of token lists; a null list decodes to an empty text."""
    held = rows.sparkSession.sparkContext.broadcast(load(model_path))
    some = rows.select(rows[id_col].alias("doc_id"), F.coalesce(rows[ids_col], F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = compiled(held.value)
        for batch in batches:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets).astype(np.int64)
            ids = np.asarray(lists.values)[ends[0] : ends[-1]]
            data, at = model.decode(ids, ends - ends[0])
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return some.mapInArrow(run, f"doc_id {dict(some.dtypes)['doc_id']}, text string")
