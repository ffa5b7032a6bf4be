"""Vectorised byte-level tokenising shared by the training-data operators.

A batch of texts is laid end to end in one byte array; word borders, word hashes
and rolling window hashes are then array expressions over the whole batch, so no
Python loop runs per word.  Hashes are 64 bits, fixed across processes and runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(0x70CE)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_MASK = 2**64 - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of `[^\x20\x09-\x0D]+`.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (a bijection)."""
    x = x.astype(np.uint64)
    x ^= x >> _U(31)
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * _U(pow(base, done, 2**64))
        done += take
    return out[:n]


_POW = _INV = np.zeros(0, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for positions up to n; kept for up to 2**20 positions."""
    global _POW, _INV
    if n > len(_POW):
        if n > 2**20:
            return _powers(_BASE, n), _powers(_BASE_INV, n)
        _POW, _INV = _powers(_BASE, 2**20), _powers(_BASE_INV, 2**20)
    return _POW[:n], _INV[:n]


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each pair; equal bytes give equal hashes.

    Works in slabs of about a million bytes, so that the eight-byte prefix sums
    stay in the cache and memory doesn't grow with the batch.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at, slab = 0, 2**19
    while at < len(starts):
        first = int(starts[at])
        to = max(int(np.searchsorted(ends, first + slab, side="right")), at + 1)
        last = int(ends[to - 1])
        pow_, inv = _tables(last - first + 1)
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[first:last]] * pow_[: last - first], out=sums[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = (sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


@dataclass
class Batch:
    """Words of a batch of texts.

    starts, ends: byte borders in data; doc: the text's number for each word;
    first: for each text the number of its first word, and the total at the end;
    text_at: for each text its first byte in data, and the length at the end (one
    separator byte, a newline, stands after each text).
    """

    data: np.ndarray
    text_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.starts, self.ends)

    def words(self, i: int) -> list[bytes]:
        lo, hi = self.first[i], self.first[i + 1]
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[lo:hi], self.ends[lo:hi])]


#: Runs of letters and digits (1) and runs of other characters (2), for lower-cased text.
SHAPES = NOT_BLANK * np.uint8(2)
SHAPES[ALNUM] = 1


def split(texts: list[bytes | None], lower: bool = True, inside: np.ndarray = NOT_BLANK) -> Batch:
    """Splits texts (None: empty) into runs of bytes that `inside` gives the same value, other than 0."""
    texts = [x or b"" for x in texts]
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    text_at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=text_at[1:])
    if lower:
        data = _LOWER[data]
    kind = inside.astype(np.int8)[data]
    step = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    step = np.concatenate([np.zeros(min(len(data), 1), np.int64), step])
    some = kind[step] != 0  # a newline, of kind 0, ends the data
    starts = step[some]
    ends = step[np.flatnonzero(some) + 1]
    return Batch(data, text_at, starts, ends, np.searchsorted(starts, text_at))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes; one entry for each start that has n hashes after it."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out += hashes[k : k + len(out)] * _U(pow(_BASE, k + 1, 2**64))
    return mix(out)


def batches(texts, most: int = 4_000_000):
    """Slices (lo, hi) of texts with about `most` bytes each, one text at least."""
    lo, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x or b"") + 1
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
