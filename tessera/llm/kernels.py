"""Vectorised text kernels on numpy: word boundaries and 64-bit hashes over whole batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator, Sequence

import numpy as np

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in pieces of about so many bytes, cut at white space.
PIECE_BYTES = 1 << 21
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            made = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _BASE_INVERSE)]
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class SpanHashes:
    """64-bit hashes of byte spans of a buffer; equal spans hash alike wherever they stand."""

    def __init__(self, buf: np.ndarray):
        power, self._inverse = _power_tables(len(buf) + 1)
        self._total = np.zeros(len(buf) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=self._total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self._total[ends] - self._total[starts]) * self._inverse[starts]
            return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def sliding(self, width: int) -> np.ndarray:
        """The hashes of all spans of width bytes."""
        with np.errstate(over="ignore"):
            raw = (self._total[width:] - self._total[: len(self._total) - width]) * self._inverse[: len(self._total) - width]
            return mix(raw + np.uint64(width * 0xD6E8FEB86659FD93 % (1 << 64)))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SpanHashes for one use."""
    return SpanHashes(buf)(starts, ends)


class HashTable:
    """Places of 64-bit hashes in a list: a direct look-up by leading bits and a few probes."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self._sorted = np.append(hashes[self.order], np.uint64(0))
        self._bits = np.uint64(64 - max(8, int(len(hashes)).bit_length() + 2))
        slots = np.arange((1 << (64 - int(self._bits))) + 1, dtype=np.uint64)
        self._first = np.append(np.searchsorted(hashes[self.order], slots[:-1] << self._bits), len(hashes)).astype(np.int32)
        self._probes = int(np.diff(self._first).max(initial=0))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of hashes are in the list, and their places in it."""
        at = self._first[hashes >> self._bits]
        hit = np.flatnonzero(self._sorted[at] == hashes)
        which, where = [hit], [at[hit]]
        left = None
        for k in range(1, self._probes):
            if left is None:
                slot = hashes >> self._bits
                left = np.flatnonzero(self._first[slot + np.uint64(1)] > at + k)
            else:
                left = left[self._first[(hashes[left] >> self._bits) + np.uint64(1)] > at[left] + k]
            ok = self._sorted[at[left] + k] == hashes[left]
            which.append(left[ok])
            where.append(at[left[ok]] + k)
        which, where = np.concatenate(which), np.concatenate(where)
        real = where < len(self.order)
        return which[real], self.order[where[real]]


def spans(buf: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer that ends with white space; `between` marks the bytes that part words."""
    space = between[buf]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    return starts, ends


def pieces(texts: Sequence[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Joins texts, each ended by a newline, to pieces of about limit bytes; yields the piece, the texts in it and their first offsets. Longer texts are cut at white space."""
    held: list[bytes] = []
    which: list[int] = []
    at: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        rest = text
        while True:
            if size and size + len(rest) > limit:
                yield b"\n".join(held) + b"\n", which, at
                held, which, at, size = [], [], [], 0
            part = rest
            if len(rest) > limit:
                cut = limit
                while cut < len(rest) and not _IS_SPACE[rest[cut]]:
                    cut += 1
                part, rest = rest[:cut], rest[cut:]
            else:
                rest = b""
            held.append(part)
            which.append(i)
            at.append(size)
            size += len(part) + 1
            if not rest:
                break
    if held:
        yield b"\n".join(held) + b"\n", which, at


class Words:
    """All words of a batch of texts: hashes, offsets of each text's first word (one more at the end), and their bytes on demand."""

    def __init__(self, texts: Sequence[bytes], between: np.ndarray = _IS_SPACE):
        counts = np.zeros(len(texts) + 1, np.int64)
        found = []
        self._parts: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        for piece, which, at in pieces(texts):
            buf = np.frombuffer(piece, np.uint8)
            starts, ends = spans(buf, between)
            found.append(hash_spans(buf, starts, ends))
            self._parts.append((piece, starts, ends))
            first = np.searchsorted(starts, at + [len(buf)])
            np.add.at(counts, np.asarray(which) + 1, np.diff(first))
        self.hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.first = np.cumsum(counts)
        self._part_first = np.cumsum([0] + [len(x) for x in found])

    def word(self, index: np.ndarray) -> list[bytes]:
        """The bytes of the words at the given places."""
        part = np.searchsorted(self._part_first, index, side="right") - 1
        out = []
        for i, p in zip(index.tolist(), part.tolist(), strict=True):
            piece, starts, ends = self._parts[p]
            i -= int(self._part_first[p])
            out.append(piece[starts[i] : ends[i]])
        return out


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offset of each text's first word (one more offset at the end)."""
    found = Words(texts)
    return found.hashes, found.first


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers live on between tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 of the same bits."""
    return x.view(np.int64)
