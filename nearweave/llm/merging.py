"""Pair merging for many short pieces at once: each distinct piece of a pass is merged once, all of them together."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np

from .common import U64, passes, word_hashes

NONE = np.int32(2**31 - 1)
#: Pieces with more symbols than this are merged one at a time with a heap.
WIDE = 32


class PairTable:
    """Ranks of symbol pairs in an open-addressing table that is probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        """``rank``: the lower, the sooner a pair is merged; ``made[rank]``: the symbol that it becomes."""
        self.made = made
        bits = max(12, int(len(left) * 8 - 1).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        todo, probe = np.arange(len(key)), 0
        while len(todo):
            slot = (self._home(key[todo]) + probe) & self.mask
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[slot[took]] = key[todo[took]]
            self.ranks[slot[took]] = rank[todo[took]]
            todo, probe = np.delete(todo, took), probe + 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        slot = self._home(key)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], NONE)
        todo = np.flatnonzero((held != key) & (held != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[slot[todo]]
            out[todo] = np.where(held == key[todo], self.ranks[slot[todo]], NONE)
            todo = todo[(held != key[todo]) & (held != -1)]
        return out


def _merge_one(symbols: list[int], table: PairTable) -> list[int]:
    """One long piece: lowest rank first, leftmost first among equals; n log n."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    first = table(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)) if n > 1 else np.zeros(0, np.int32)
    heap = [(int(r), i, symbols[i], symbols[i + 1]) for i, r in enumerate(first) if r != NONE]
    heapify(heap)
    known: dict[tuple[int, int], int] = {}
    while heap:
        r, i, a, b = heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], symbols[j] = int(table.made[r]), -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0 and y < n:
                pair = symbols[x], symbols[y]
                if pair not in known:
                    known[pair] = int(table(np.array([pair[0]], np.int64), np.array([pair[1]], np.int64))[0])
                if known[pair] != NONE:
                    heappush(heap, (known[pair], x, *pair))
    return [s for s in symbols if s >= 0]


def _merge_rows(ids: np.ndarray, table: PairTable) -> None:
    """Rows of symbols, closed by -1: in place, a merged pair leaves its symbol at the left place and -1 at the right."""
    n, width = ids.shape
    flat = ids.reshape(-1)
    after = np.tile(np.arange(1, width + 1, dtype=np.int16), n)
    before = np.tile(np.arange(-1, width - 1, dtype=np.int16), n)
    ranks = np.full((n, width), NONE, np.int32)
    real = (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
    ranks[:, :-1][real] = table(ids[:, :-1][real], ids[:, 1:][real])
    base = np.arange(n, dtype=np.int64) * width
    while len(base):
        k = ranks.argmin(1)
        best = ranks[np.arange(len(base)), k]
        live = best != NONE
        if not live.all():
            ranks, base, k, best = ranks[live], base[live], k[live], best[live]
            if not len(base):
                break
        own = np.arange(len(base), dtype=np.int64) * width
        cells = ranks.reshape(-1)
        at = base + k
        j = after[at].astype(np.int64)
        made = table.made[best]
        flat[at] = made
        flat[base + j] = -1
        cells[own + j] = NONE
        k2 = after[base + j].astype(np.int64)
        after[at] = k2
        inner = k2 < width
        right = np.full(len(base), -1, np.int64)
        right[inner] = flat[(base + k2)[inner]]
        inner &= right >= 0
        before[(base + k2)[inner]] = k[inner]
        new = np.full(len(base), NONE, np.int32)
        new[inner] = table(made[inner], right[inner])
        cells[own + k] = new
        p = before[at].astype(np.int64)
        inner = p >= 0
        cells[(own + p)[inner]] = table(flat[(base + p)[inner]], made[inner])


def merge(symbols: np.ndarray, bounds: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge consecutive pieces of ``symbols`` with the given bounds (one more than pieces): ids, and bounds of ids."""
    size = np.diff(bounds)
    counts = np.zeros(len(size), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low, high in ((0, 4), (4, 8), (8, 12), (12, 18), (18, WIDE)):
        rows = np.flatnonzero((size > low) & (size <= high))
        if len(rows):
            ids = np.full((len(rows), high), -1, np.int32)
            place = np.arange(high)[None, :] < size[rows][:, None]
            ids[place] = symbols[ragged(bounds[rows], size[rows])]
            _merge_rows(ids, table)
            alive = ids >= 0
            counts[rows] = alive.sum(1)
            found.append((rows, ids[alive], counts[rows]))
    for row in np.flatnonzero(size > WIDE):
        got = np.array(_merge_one(symbols[bounds[row] : bounds[row + 1]].tolist(), table), np.int32)
        counts[row] = len(got)
        found.append((np.array([row]), got, np.array([len(got)])))
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    out = np.empty(ends[-1], np.int32)
    for rows, ids, n in found:
        out[ragged(ends[rows], n)] = ids
    return out, ends


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of consecutive runs: starts[0], starts[0] + 1, ..., starts[1], ..."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    full = sizes > 0
    starts, sizes = starts[full], sizes[full]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    heads = np.cumsum(sizes[:-1])
    step[heads] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(step)


def distinct(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one slice for each distinct slice, and for every slice the number of its distinct one.

    Slices meet by a 64-bit hash; their bytes are then compared with those of the distinct one, and slices that differ
    in spite of equal hashes get numbers of their own.
    """
    h = np.empty(len(starts), np.uint64)
    for a, b in passes(np.concatenate([[0], ends])) if len(starts) else ():
        lo, hi = int(starts[a]), int(ends[b - 1])
        h[a:b] = word_hashes(body[lo:hi], starts[a:b] - lo, ends[a:b] - lo)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    size = ends - starts
    same = size == size[first][number]
    if not same.all():
        return _apart(first, number, np.flatnonzero(~same))
    differ = np.zeros(0, np.int64)
    odd = []
    for a, b in passes(np.concatenate([[0], np.cumsum(size)])) if len(starts) else ():
        mine = ragged(starts[a:b], size[a:b])
        theirs = ragged(starts[first[number[a:b]]], size[a:b])
        wrong = np.flatnonzero(body[mine] != body[theirs])
        if len(wrong):
            odd.append(a + np.unique(np.searchsorted(np.cumsum(size[a:b]), wrong, "right")))
    if odd:
        differ = np.concatenate(odd)
    return _apart(first, number, differ) if len(differ) else (first, number)


def _apart(first: np.ndarray, number: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number = number.copy()
    number[which] = len(first) + np.arange(len(which))
    return np.concatenate([first, which]), number


def encode_slices(
    body: np.ndarray, starts: np.ndarray, ends: np.ndarray, fill: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all slices in order and their bounds; ``fill`` gives ids and bounds for given distinct slices."""
    first, number = distinct(body, starts, ends)
    ids, bounds = fill(starts[first], ends[first])
    size = np.diff(bounds)[number]
    out = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return ids[ragged(bounds[:-1][number], size)], out
