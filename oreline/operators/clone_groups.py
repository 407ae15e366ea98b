"""All clones, and the greedy choice of them, within one group of files that share windows, in memory.

Runs of shared windows are sorted by their suffixes (prefix doubling); a content that
two places have is an interval of that order whose least common prefix is its length.
Contents are visited longest first. Of each length all contents meet in one heap of
pairs in order, and a pair is taken if both ranges are free. A place knows how far it
is free, so a visit is one comparison of a slice; no pair that isn't looked at is made.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np

FREE = 1 << 40
LOOKS = 16
BLOCK = 1 << 18


class Suffixes:
    """Order of all suffixes of `runs` of codes, each up to the end of its run, which is like no other."""

    def __init__(self, runs: list[np.ndarray], others: np.ndarray):
        """others: codes that are named too, as `named`."""
        lengths = np.array([len(r) for r in runs])
        self.begin = np.cumsum(lengths + 1) - lengths - 1
        codes, ids = np.unique(np.concatenate([*runs, others]), return_inverse=True)
        self.named = ids[len(ids) - len(others) :]
        n = int(lengths.sum()) + len(runs)
        rank = np.full(n, -1, np.int64)
        inside = np.ones(n, bool)
        inside[self.begin + lengths] = False
        rank[inside] = ids[: len(ids) - len(others)]
        rank[~inside] = len(codes) + np.arange(len(runs))
        self.run = np.repeat(np.arange(len(runs)), lengths + 1)
        self.left = (self.begin + lengths)[self.run] - np.arange(n)  # tokens from here to the end of the run
        self.ids, self.levels, width = rank, [rank.astype(np.int32)], 1
        while width <= int(lengths.max()):
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            rank = np.unique(rank * (max(n, len(codes) + len(runs)) + 1) + after, return_inverse=True)[1]
            self.levels.append(rank.astype(np.int32))
            width *= 2
        self.rank = rank

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and at y, other than x."""
        x, y = x.copy(), y.copy()
        total = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][x] == self.levels[k][y]).astype(np.int64) << k
            x += step
            y += step
            total += step
        return total


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(length, first, end) of the intervals whose least common prefix is `length`, at least `least`; lcp[i] is of i - 1 and i."""
    out, stack = [], []
    for i in range(1, len(lcp) + 1):
        common, first = lcp[i] if i < len(lcp) else 0, i - 1
        while stack and stack[-1][0] > common:
            length, first = stack.pop()
            out.append((length, first, i))
        if common >= least and (not stack or stack[-1][0] < common):
            stack.append((common, first))
    return out


class Content:
    """Free places of one content, in order of path and start."""

    def __init__(self, g: Group, rows: np.ndarray, child: np.ndarray, length: int):
        o = np.lexsort((g.pos[rows], g.order[rows]))
        self.g, self.length, self.rows, self.child = g, length, rows[o], child[o]
        self.prev, self.fid, self.order = g.prev[self.rows], g.fid[self.rows], g.order[self.rows]
        self.misses = 0

    def partner(self, x: int, first: int) -> int:
        """First place from `first` on that is a match of place x, or -1; those of equal files match as a whole only."""
        g, width = self.g, 64
        whole = g.size[self.rows[x]] == self.length
        while first < len(self.rows):
            s = slice(first, first + width)
            fine = (g.free[self.rows[s]] >= self.length) & (self.child[s] != self.child[x]) & (self.prev[s] != self.prev[x]) & (self.order[s] > self.order[x])
            if not whole:
                fine &= self.fid[s] != self.fid[x]
            k = int(fine.argmax())
            if fine[k]:
                return first + k
            first, width = first + width, width * 4
        return -1

    def open(self, first: int) -> bool:
        """Whether places from `first` on may be matches: neither all tokens before nor all behind are the same."""
        some = np.flatnonzero(self.g.free[self.rows[first:]] >= self.length) + first
        return len(some) > 1 and (self.prev[some] != self.prev[some[0]]).any() and (self.child[some] != self.child[some[0]]).any()


class Places:
    """Where matches may start, in order of their suffixes, from runs of shared windows (fid, first place, token before or None, codes) of files of sizes[fid]."""

    def __init__(self, runs: list[tuple], sizes: dict[int, int], window: int):
        befores = np.array([r[2] or 0 for r in runs], np.int64)
        s = Suffixes([r[3] for r in runs], befores)
        prev = np.empty(len(s.ids), np.int64)
        prev[1:] = s.ids[:-1]
        prev[s.begin] = np.where([r[2] is None for r in runs], -1 - np.arange(len(runs)), s.named)  # null is like no other
        at = np.flatnonzero(s.left >= window)
        at = at[np.argsort(s.rank[at])]
        lcp = np.zeros(len(at), np.int64)
        lcp[1:] = s.common(at[:-1], at[1:])
        heads = np.flatnonzero(lcp < window)
        several = np.minimum.reduceat(prev[at], heads) < np.maximum.reduceat(prev[at], heads)
        keep = np.repeat(several, np.diff(np.append(heads, len(at))))  # places with one window and one token before it start no match
        at, self.lcp = at[keep], lcp[keep]
        self.fid, self.pos = np.array([r[0] for r in runs])[s.run[at]], np.array([r[1] for r in runs])[s.run[at]] + at - s.begin[s.run[at]]
        self.size = np.array([sizes[r[0]] for r in runs])[s.run[at]]
        self.prev, self.left = prev[at], s.left[at]


def every(runs: list[tuple], files: dict[int, tuple], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(left, right, lstart, rstart, length) of all maximal matches of two paths of files fid: (size, paths), left and right as numbers in the order of all paths; in parts.

    Not the whole matches of equal files.
    """
    p = Places(runs, {f: x[0] for f, x in files.items()}, window)
    of, number = {}, 0
    paths = sorted((path, f) for f, x in files.items() for path in x[1])
    mine: dict[int, list[int]] = {f: [] for f in files}
    for n, (_, f) in enumerate(paths):
        mine[f].append(n)
    for f, own in mine.items():
        of[f] = (number, len(own))
        number += len(own)
    names = np.array([n for own in mine.values() for n in own], np.int64)
    first, times = (np.array([of[f][k] for f in p.fid.tolist()], np.int64) for k in (0, 1))
    parts, ready = [], 0
    for length, a, b in intervals(p.lcp.tolist(), window):
        cuts = [*(np.flatnonzero(p.lcp[a + 1 : b] == length) + a + 1).tolist(), b]
        for c, d in zip(cuts[:-1], cuts[1:], strict=True):
            step = max(1, BLOCK // (c - a))
            for e in range(c, d, step):  # places from e on, of one child, with all of the children before
                x, y = np.arange(a, c), np.arange(e, min(e + step, d))[:, None]
                fine = (p.prev[x] != p.prev[y]) & ((p.fid[x] != p.fid[y]) | ((times[x] > 1) & (p.pos[x] != p.pos[y])))
                y, x = np.nonzero(fine)
                for part in _expanded(x + a, y + e, first, times):
                    x, y, l, r = part  # noqa: E741
                    l, r = names[l], names[r]  # noqa: E741
                    some = l != r
                    x, y, l, r = x[some], y[some], l[some], r[some]  # noqa: E741
                    turn = l > r
                    parts.append((np.where(turn, r, l), np.where(turn, l, r), np.where(turn, p.pos[y], p.pos[x]), np.where(turn, p.pos[x], p.pos[y]), np.full(len(x), length)))
                    ready += len(x)
                    if ready >= BLOCK:
                        yield tuple(map(np.concatenate, zip(*parts, strict=True)))
                        parts, ready = [], 0
    if ready:
        yield tuple(map(np.concatenate, zip(*parts, strict=True)))


def _expanded(x: np.ndarray, y: np.ndarray, first: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, left, right) for each member of x with each of y, in parts."""
    n = times[x] * times[y]
    ends = np.cumsum(n)
    begin = 0
    while begin < len(x):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        for k in range(0, int(ends[end - 1]) - done, BLOCK):
            place = np.arange(done + k, min(done + k + BLOCK, int(ends[end - 1])))
            i = np.searchsorted(ends, place, "right")
            within = place - (ends[i] - n[i])
            yield x[i], y[i], first[x[i]] + within // times[y[i]], first[y[i]] + within % times[y[i]]
        begin = end


class Group:
    """What the greedy scan keeps of runs, as in Places, of files fid: (size, paths, whether it is one class of copies covered by a run)."""

    def __init__(self, runs: list[tuple], files: dict[int, tuple], window: int):
        self.window, self.taken = window, []
        p = Places(runs, {f: x[0] for f, x in files.items()}, window)
        lcp, fid, pos, size, prev, left = p.lcp, p.fid, p.pos, p.size, p.prev, p.left
        both = np.maximum(lcp, np.append(lcp[1:], 0))
        held = set(fid[(pos == 1) & (left == size) & (both == size)].tolist())
        self.paths, self.pairs, of = [], [], {}
        for f, (length, paths, covered) in files.items():
            paths = sorted(paths)
            if covered and f not in held:
                self.pairs += [(x[1], y[1], 1, 1, length) for x, y in zip(paths[::2], paths[1::2], strict=False)]
                paths = paths[len(paths) // 2 * 2 :]
            of[f] = (len(self.paths), len(paths))
            self.paths += paths
        first, times = (np.array([of[f][k] for f in fid.tolist()], np.int64) for k in (0, 1))
        some = np.flatnonzero(times)
        if not len(some):
            return
        lcp = np.minimum.reduceat(lcp[: some[-1] + 1], np.append(0, some[:-1] + 1))
        left, prev, fid, pos, size, first, times = (x[some] for x in (left, prev, fid, pos, size, first, times))
        row = np.repeat(np.arange(len(fid)), times)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        self.lcp = np.where(nth == 0, lcp[row], left[row])
        self.fid, self.pos, self.size, own = fid[row], pos[row], size[row], first[row] + nth
        self.prev = prev[row]
        self.prev = np.where(self.prev < 0, -1 - np.arange(len(row)), self.prev)
        rank = np.empty(len(self.paths), np.int64)
        rank[sorted(range(len(self.paths)), key=self.paths.__getitem__)] = np.arange(len(self.paths))
        self.path = sorted(self.paths)
        self.order = rank[own]
        self.free = np.full(len(row), FREE)
        self.by_file = np.lexsort((self.pos, self.order))
        self.file_at = np.searchsorted(self.order[self.by_file], np.arange(len(self.path) + 1))
        self.pos_by_file = self.pos[self.by_file]
        self._choose()

    def _take(self, row: int, length: int) -> None:
        """Lengths don't grow, so only places that begin within `length` of the range are told."""
        a, b = self.file_at[self.order[row]], self.file_at[self.order[row] + 1]
        start = int(self.pos[row])
        x, y = np.searchsorted(self.pos_by_file[a:b], (start - length + 1, start + length)) + a
        rows = self.by_file[x:y]
        self.free[rows] = np.minimum(self.free[rows], np.maximum(start - self.pos_by_file[x:y], 0))

    def _choose(self) -> None:
        found = sorted(intervals(self.lcp.tolist(), self.window), key=lambda x: -x[0])
        for length, level in groupby(found, key=lambda x: x[0]):
            contents, heap = [], []
            for _, a, b in level:
                rows = np.flatnonzero(self.free[a:b] >= length)
                if len(rows) < 2:
                    continue
                own = self.prev[a:b][rows]
                if not (own != own[0]).any():
                    continue
                own = self.fid[a:b][rows]
                if not (own != own[0]).any() and self.size[a + rows[0]] != length:
                    continue
                child = np.cumsum(self.lcp[a:b] == length)[rows]  # what follows differs between two of them
                if not (child != child[0]).any():
                    continue
                contents.append(c := Content(self, rows + a, child, length))
                heapq.heappush(heap, (int(c.order[0]), -1, int(self.pos[c.rows[0]]), -1, len(contents) - 1, 0, -1))
            while heap:
                *_, n, x, y = heapq.heappop(heap)
                c = contents[n]
                if y < 0:  # the first time that x is looked at: the next one is to come
                    if x + 1 < len(c.rows) and (c.misses < LOOKS or c.open(x + 1)):
                        c.misses = 0 if c.misses >= LOOKS else c.misses
                        heapq.heappush(heap, (int(c.order[x + 1]), -1, int(self.pos[c.rows[x + 1]]), -1, n, x + 1, -1))
                if self.free[c.rows[x]] < length:
                    continue
                if y >= 0 and self.free[c.rows[y]] >= length:
                    for r in (c.rows[x], c.rows[y]):
                        self._take(r, length)
                    self.taken.append((int(c.rows[x]), int(c.rows[y]), length))
                    continue
                y = c.partner(x, max(x, y) + 1)
                if y < 0:
                    c.misses += 1
                    continue
                heapq.heappush(heap, (int(c.order[x]), int(c.order[y]), int(self.pos[c.rows[x]]), int(self.pos[c.rows[y]]), n, x, y))

    def spans(self) -> list[tuple[str, str, int, int, int]]:
        """(left, right, lstart, rstart, length) of the taken pairs."""
        name = lambda r: self.path[self.order[r]][1]
        return self.pairs + [(name(x), name(y), int(self.pos[x]), int(self.pos[y]), n) for x, y, n in self.taken]
