"""A run-length index of many short texts: run-compressed Burrows-Wheeler transform with sampled run ends, and matching statistics over it.

Rows are the suffixes of all texts, each closed by an end mark below all bytes; end marks order by their text's place. Kept are
the runs of equal preceding symbols (where each starts, its symbol, the row that its first row comes from), the text places
of each run's first and last row, and, for each set of rows that begin with the same `least` bytes, the smallest owner of such a
row. All of these grow with what the texts have that is not repeated.
"""

from __future__ import annotations

import numpy as np

#: Symbols packed to one sort key; 257 ** 7 fits 64 bits.
PACK = 7


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row as symbols (byte + 1, end mark 0), and where each one starts."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.zeros(int(starts[-1]), np.int16)
    at = np.arange(int(size.sum())) + np.repeat(np.arange(len(texts)), size)
    out[at] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    return out, starts


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of keys and each key's rank among the distinct ones, from 1."""
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def suffix_order(symbols: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' places in the text, by doubling within texts, and which rows begin with other `least` symbols than the row before.

    A suffix that has ended is told apart by its text's place, so no two rows stay equal.
    """
    n, m = len(symbols), len(starts) - 1
    size = np.diff(starts)
    text = np.repeat(np.arange(m), size)
    left = starts[1:][text] - np.arange(n)  # symbols up to the end mark, itself included

    def then(x: np.ndarray, h: int) -> np.ndarray:
        out = text.copy()
        if h < n:
            out[: n - h] = np.where(left[: n - h] > h, x[h:], text[: n - h])
        return out

    key = np.zeros(n, np.uint64)
    wide = symbols.astype(np.uint64)
    for k in range(PACK):
        key *= np.uint64(257)
        key[: max(n - k, 0)] += np.where(left[: max(n - k, 0)] > k, wide[k:], np.uint64(0))
    order, rank = _dense(key)
    seen, first = PACK, None
    longest = int(size.max(initial=0))
    told = rank * (m + 1) + np.where(left <= PACK, text, m)  # as rank, but ended suffixes apart
    while True:
        wide = int(told.max(initial=0)) + m + 1
        if first is None and 2 * seen >= least:
            first = rank, then(told, least - seen)
        order, rank = _dense(rank * wide + then(told, seen))
        told = rank
        seen *= 2
        if seen >= longest and first is not None:
            break
    new = np.ones(n, bool)
    a, b = (x[order] for x in first)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


class RunIndex:
    """The index of texts, each with an owner (an integer); least is above PACK."""

    def __init__(self, texts: list[bytes], owners: np.ndarray, least: int):
        if least <= PACK:
            raise ValueError(f"least must be above {PACK}")
        self.least = least
        self.symbols, self.starts = joined(texts)
        order, other = suffix_order(self.symbols, self.starts, least)
        n = self.n = len(order)
        size = np.diff(self.starts)
        text = np.repeat(np.arange(len(texts)), size)
        before = np.where(order == self.starts[:-1][text[order]], 0, self.symbols[np.maximum(order - 1, 0)])
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if n else np.zeros(0, np.int64)
        self.run, self.of = head, before[head]
        length = np.diff(np.append(head, n))
        # the row of a run's first row's preceding place: all smaller symbols, then this symbol's earlier runs
        by = np.argsort(self.of, kind="stable")
        came = np.cumsum(length[by]) - length[by]
        self.lead = np.empty(len(head), np.int64)
        self.lead[by] = came
        self.first, self.last = order[head], order[np.append(head[1:], n) - 1] if n else order
        # runs of each symbol, in order, for the jumps
        self._by, self._bounds = by, np.searchsorted(self.of[by], np.arange(258))
        self.group = np.flatnonzero(other)
        self.oldest = np.minimum.reduceat(owners[text[order]], self.group) if n else owners[:0]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal symbols from text places a and b on, before an end mark, up to most."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            ok = (x < self.n) & (y < self.n)
            sx, sy = self.symbols[np.minimum(x, self.n - 1)], self.symbols[np.minimum(y, self.n - 1)]
            live = live[ok & (sx == sy) & (sx > 0)]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def statistics(self, queries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of all places of all queries, which are read backwards side by side: length of the longest match that starts there,
        a row that begins with it, and where each query starts in these arrays.

        A symbol that the row's run lacks moves it to the nearer end, by common symbols, of the symbol's next runs above and
        below; their sampled places tell how much of the match stays.
        """
        size = np.fromiter((len(q) for q in queries), np.int64, len(queries))
        starts = np.concatenate([[0], np.cumsum(size)])
        symbols = np.frombuffer(b"".join(queries), np.uint8).astype(np.int64) + 1
        length, rows = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        row, place, now = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        if self.n:
            place[:] = self.first[0]
        by_size = np.argsort(-size, kind="stable")
        live_of = np.searchsorted(-size[by_size], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        for k in range(1, int(size.max(initial=0)) + 1 if self.n else 0):
            q = by_size[: live_of[k - 1]]
            at = starts[q + 1] - k
            c = symbols[at]
            run = np.searchsorted(self.run, row[q], side="right") - 1
            off = np.flatnonzero(self.of[run] != c)
            if len(off):
                w, cc, rr = q[off], c[off], run[off]
                lo, hi = self._bounds[cc], self._bounds[cc + 1]
                # the symbol's runs are in the order of rows; the first one beyond this run
                key = self._keys()
                nxt = np.searchsorted(key, cc * (len(self.run) + 1) + rr)
                up, down = nxt - 1, nxt
                has_up, has_down = up >= lo, down < hi
                u, d = self._by[np.clip(up, 0, len(key) - 1)], self._by[np.clip(down, 0, len(key) - 1)]
                most = now[w]
                lu = np.where(has_up, self.common(self.last[u], place[w], np.where(has_up, most, 0)), -1)
                ld = np.where(has_down, self.common(self.first[d], place[w], np.where(has_down, most, 0)), -1)
                above = lu >= ld
                none = (lu < 0) & (ld < 0)
                to = np.where(above, u, d)
                end = np.append(self.run[1:], self.n)
                row[w] = np.where(none, row[w], np.where(above, end[to] - 1, self.run[to]))
                place[w] = np.where(none, place[w], np.where(above, self.last[to], self.first[to]))
                now[w] = np.where(none, -1, np.maximum(lu, ld))
                run[off] = np.where(none, rr, to)
            ok = now[q] >= 0
            stepped = self.lead[run] + row[q] - self.run[run]
            row[q] = np.where(ok, stepped, row[q])
            place[q] = np.where(ok, place[q] - 1, place[q])
            now[q] = np.where(ok, now[q] + 1, 0)  # a symbol that no text has ends the match
            length[at], rows[at] = now[q], row[q]
        return length, rows, starts

    def _keys(self) -> np.ndarray:
        if not hasattr(self, "_key"):
            self._key = self.of[self._by].astype(np.int64) * (len(self.run) + 1) + self._by
        return self._key

    def oldest_owner(self, rows: np.ndarray) -> np.ndarray:
        """The smallest owner of the rows that begin with the same `least` symbols."""
        return self.oldest[np.searchsorted(self.group, rows, side="right") - 1]
