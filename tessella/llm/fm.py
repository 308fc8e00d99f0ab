"""A compressed FM-index over words: the Burrows-Wheeler transform in a wavelet tree of bit vectors."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SIX = np.uint64(6)
_LOW = np.uint64(63)


class FMIndex:
    """text: symbols from 1; 0 is the end of a segment. Suffixes are ordered by their first depth symbols at
    least; weights says how often the text at each place counts."""

    def __init__(self, text: np.ndarray, weights: np.ndarray, depth: int) -> None:
        n = len(text)
        rank = text.astype(np.int64)
        span = 1
        while True:
            later = np.zeros(n, np.int64)
            later[: n - span] = rank[span:] + 1
            key = rank * (int(rank.max(initial=0)) + 2 + n) + later
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
            rank, span = new, 2 * span
            if span >= depth or (n and rank[order[-1]] == n - 1):
                break
        last = text[order - 1]  # the symbol before each suffix; the first suffix's is the text's last
        self.n = n
        self.weight = np.concatenate(([0], np.cumsum(weights[order])))
        self.symbols = int(text.max(initial=0)) + 1
        counts = np.bincount(text, minlength=self.symbols)
        self.levels = max(1, (self.symbols - 1).bit_length())
        # A wavelet tree without pointers: at each level the zeros move to the front.
        self.words, self.sums, self.zeros = [], [], []
        row = last
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            packed = np.zeros(((n >> 6) + 1) * 8, np.uint8)
            small = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(small)] = small
            words = packed.view("<u8").astype(np.uint64)
            sums = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=sums[1:])
            self.words.append(words)
            self.sums.append(sums)
            self.zeros.append(int(n - bit.sum()))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        before = np.concatenate(([0], np.cumsum(counts)[:-1]))
        every = np.arange(self.symbols)
        self.shift = before - self._walk(np.zeros(self.symbols, np.int64), every)

    def _walk(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for k, (words, sums, zeros) in enumerate(zip(self.words, self.sums, self.zeros)):
            i = at.astype(np.uint64)
            cell = (i >> _SIX).astype(np.int64)
            ones = sums[cell] + np.bitwise_count(words[cell] & ((_U(1) << (i & _LOW)) - _U(1)))
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of suffixes that start with symbol and then with what low and high hold."""
        both = self._walk(np.concatenate((low, high)), np.concatenate((symbol, symbol))) + np.tile(self.shift[symbol], 2)
        return both[: len(low)], both[len(low) :]


def repeated_windows(segments: list[np.ndarray], weights: np.ndarray, width: int) -> list[int]:
    """For each segment of symbols from 1, the windows of width that weigh 2 or more in all segments: a bit mask.

    weights: how often each segment counts. A segment has at most 64 windows. Backward search from
    some end down to the lowest window that is not yet settled either gets there, which settles
    all windows between, or stops where the match weighs less than 2, which rules out the windows
    that hold that stretch.
    """
    out = np.zeros(len(segments), np.uint64)
    todo = np.arange(len(segments))
    if not len(todo):
        return out.tolist()
    sizes = np.array([len(s) for s in segments], np.int64)
    offset = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    for o, s in zip(offset.tolist(), segments, strict=True):
        text[o : o + len(s)] = s
    index = FMIndex(text, np.repeat(weights, sizes + 1), int(sizes.max()))
    n = index.n
    base, last = offset[todo], sizes[todo] - 1
    first = np.zeros(len(todo), np.int64)
    end = last.copy()
    at = end.copy()
    low, high = np.zeros(len(todo), np.int64), np.full(len(todo), n, np.int64)
    live = np.arange(len(todo))
    while len(live):
        low[live], high[live] = index.step(low[live], high[live], text[base[live] + at[live]])
        unique = index.weight[high[live]] - index.weight[low[live]] < 2
        there = ~unique & (at[live] == first[live])
        at[live] -= 1
        u, g = live[unique], live[there]
        if len(u):
            stop = at[u] + 1  # words stop..end are not repeated
            shorter = np.maximum(stop - 1, first[u] + width - 1)
            settled = end[u] == first[u] + width - 1
            first[u[settled]] = stop[settled] + 1
            end[u] = np.where(settled, last[u], np.minimum(shorter, end[u] - 1))
            end[u] = np.maximum(end[u], first[u] + width - 1)
        if len(g):
            k = end[g] - width + 2 - first[g]  # windows settled at once
            run = np.where(k >= 64, ~_U(0), (_U(1) << np.minimum(k, 63).astype(np.uint64)) - _U(1))
            out[todo[g]] |= run << first[g].astype(np.uint64)
            first[g] += k
            end[g] = np.maximum(last[g], first[g] + width - 1)
        fresh = live[unique | there]
        at[fresh], low[fresh], high[fresh] = end[fresh], 0, n
        live = live[first[live] + width - 1 <= last[live]]
    return out.tolist()
