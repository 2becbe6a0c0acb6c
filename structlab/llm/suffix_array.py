"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Mean suffixes of a symbol from which its bucket is induced as an array; below, a plain loop is faster.
ARRAY_SUFFIXES = 100


def shared_symbols(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols t[a:] and t[b:] share at their starts, ``most`` at most, for each pair of places.

    Pairs that still agree are compared in blocks that double, so the work is
    in proportion to what is shared.
    """
    out = np.zeros(len(a), np.int64)
    open_, width, last = np.flatnonzero(most > 0), 8, len(t) - 1
    while len(open_):
        have = out[open_]
        step = np.arange(width)
        left = np.minimum((a[open_] + have)[:, None] + step, last)
        right = np.minimum((b[open_] + have)[:, None] + step, last)
        differ = t[left] != t[right]
        agreed = np.where(differ.any(1), differ.argmax(1), width)
        out[open_] = np.minimum(have + agreed, most[open_])
        open_ = open_[(agreed == width) & (out[open_] < most[open_])]
        width = min(2 * width, max(8, (1 << 22) // max(1, len(open_))))
    return out


class _Buckets:
    """Places in the suffix array by first symbol, and the two inductions over them."""

    def __init__(self, t: np.ndarray, small: np.ndarray, alphabet: int):
        self.t, self.small, self.n = t, small, len(t)
        self.sizes = np.bincount(t, minlength=alphabet)
        self.ends = np.cumsum(self.sizes)
        self.heads = self.ends - self.sizes

    def induce(self, ordered: np.ndarray) -> np.ndarray:
        """All suffixes, from the leftmost-smaller ones in ``ordered``; a bucket at a time, as arrays or by a plain loop."""
        return self._by_arrays(ordered) if self.n >= ARRAY_SUFFIXES * len(self.sizes) else np.array(self._by_loop(ordered.tolist()))

    def _deal(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes by first symbol (order kept), these symbols, each one's rank among its symbol, and counts by symbol."""
        symbol = self.t[suffixes]
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        counts = np.bincount(symbol, minlength=len(self.sizes))
        return suffixes[order], symbol, np.arange(len(symbol)) - (np.cumsum(counts) - counts)[symbol], counts

    def _by_arrays(self, ordered: np.ndarray) -> np.ndarray:
        t, small = self.t, self.small
        out = np.empty(self.n, np.int64)
        seeds, symbol, rank, counts = self._deal(ordered)
        seed_heads = self.ends - counts
        out[seed_heads[symbol] + rank] = seeds
        head = self.heads.copy()
        out[head[t[-1]]] = self.n - 1
        head[t[-1]] += 1
        used = np.flatnonzero(self.sizes)
        for c in used.tolist():
            wave = out[self.heads[c] : head[c]]
            waves = [wave]
            while len(wave):  # a run of one symbol gives a wave for each symbol of it
                wave = wave[wave > 0] - 1
                wave = wave[(t[wave] == c) & ~small[wave]]
                waves.append(wave)
            every = np.concatenate(waves)
            out[self.heads[c] : self.heads[c] + len(every)] = every
            head[c] = self.heads[c] + len(every)
            every = np.concatenate((every, out[seed_heads[c] : self.ends[c]]))
            every = every[every > 0] - 1
            every = every[(t[every] > c) & ~small[every]]
            if len(every):
                suffixes, symbol, rank, counts = self._deal(every)
                out[head[symbol] + rank] = suffixes
                head += counts
        tail = self.ends.copy()
        for c in used[::-1].tolist():
            wave = out[tail[c] : self.ends[c]][::-1]
            waves = [wave]
            while len(wave):
                wave = wave[wave > 0] - 1
                wave = wave[(t[wave] == c) & small[wave]]
                waves.append(wave)
            every = np.concatenate(waves)
            out[self.ends[c] - len(every) : self.ends[c]] = every[::-1]
            every = np.concatenate((every, out[self.heads[c] : head[c]][::-1]))
            every = every[every > 0] - 1
            every = every[(t[every] < c) & small[every]]
            if len(every):
                suffixes, symbol, rank, counts = self._deal(every)
                out[tail[symbol] - 1 - rank] = suffixes
                tail -= counts
        return out

    def _by_loop(self, ordered: list[int]) -> list[int]:
        n, symbols, is_small, ends = self.n, self.t.tolist(), self.small.tolist(), self.ends.tolist()
        out, tail = [-1] * n, ends[:]
        for i in reversed(ordered):
            c = symbols[i]
            tail[c] -= 1
            out[tail[c]] = i
        head = self.heads.tolist()
        c = symbols[n - 1]
        out[head[c]] = n - 1
        head[c] += 1
        for i in out:  # grows under the loop: larger suffixes from the left
            if i > 0:
                i -= 1
                if not is_small[i]:
                    c = symbols[i]
                    out[head[c]] = i
                    head[c] += 1
        tail = ends[:]
        for k in range(n - 1, -1, -1):
            i = out[k]
            if i > 0:
                i -= 1
                if is_small[i]:
                    c = symbols[i]
                    tail[c] -= 1
                    out[tail[c]] = i
        return out


def suffix_array(text, alphabet: int) -> list[int]:
    """``suffix_order`` as a list."""
    return suffix_order(text, alphabet).tolist()


def suffix_order(text, alphabet: int) -> np.ndarray:
    """Suffix array of ``text`` (integers below ``alphabet``) in linear time.

    Suffixes are classified as smaller (S) or larger (L) than their right
    neighbour.  Leftmost-smaller substrings are sorted by one induction, named
    by rank, and their order is settled recursively if names repeat; a second
    induction then fills in all other suffixes.  The end of the text counts as
    smaller than any symbol.
    """
    t = np.asarray(text, np.uint16 if alphabet < 1 << 16 else np.int64)
    n = len(t)
    if n < 2:
        return np.arange(n)
    # S where the next differing symbol is larger; the last suffix is L (the empty end is smaller).
    differs = np.flatnonzero(t[1:] != t[:-1])
    small = np.zeros(n, bool)
    if len(differs):
        grows = t[differs + 1] > t[differs]
        small[: differs[-1] + 1] = np.repeat(grows, np.diff(np.concatenate(([-1], differs))))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    buckets = _Buckets(t, small, alphabet)
    if len(lms) < 2:
        return buckets.induce(lms)
    rough = buckets.induce(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = rough[is_lms[rough]]
    stop = np.zeros(n, np.int64)
    stop[lms] = np.concatenate((lms[1:] + 1, [n]))
    size = stop[ranked] - ranked
    # Neighbours of equal length are compared; the substring that the end cuts off is like no other.
    alike = (size[1:] == size[:-1]) & (stop[ranked[1:]] < n) & (stop[ranked[:-1]] < n)
    same = np.zeros(len(ranked) - 1, bool)
    at = np.flatnonzero(alike)
    same[at] = shared_symbols(t, ranked[at], ranked[at + 1], size[at]) == size[at]
    names = np.concatenate(([0], np.cumsum(~same)))
    if names[-1] + 1 == len(ranked):
        return buckets.induce(ranked)
    named = np.zeros(n, np.int64)
    named[ranked] = names
    return buckets.induce(lms[suffix_order(named[lms], int(names[-1]) + 1)])


def permuted_common_prefixes(symbols, order, most: int) -> np.ndarray:
    """For each suffix, in text order, the common prefix with its predecessor in the suffix array, counted up to ``most``.

    Where a suffix and its predecessor follow one symbol, they share one symbol
    less than the suffix before them did; only the others are compared.
    """
    t, order = np.asarray(symbols), np.asarray(order, np.int64)
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    follows = (place > 0) & (before > 0)
    follows[follows] = t[place[follows] - 1] == t[before[follows] - 1]
    starts = np.flatnonzero(~follows)
    real = starts[before[starts] >= 0]
    common = np.zeros(n, np.int64)
    common[real] = shared_symbols(t, real, before[real], n - np.maximum(real, before[real]))
    begin = np.maximum.accumulate(np.where(follows, 0, place))
    return np.minimum(np.maximum(common[begin] - (place - begin), 0), most)
