"""Vectorised work on Arrow batches of texts: chunks, byte n-gram codes, word hashes, look-ups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 600_000
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pows: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "pow"
    have = _pows.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, _PINV if inverse else _P, np.uint64)
        p[0] = 1
        _pows[key] = have = np.cumprod(p, dtype=np.uint64)
    return have[:n]


@dataclass
class Chunk:
    """Rows [first, last) of a batch: their bytes, where each row begins, and which rows are null."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    null: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of about `limit` bytes; a longer text is a chunk of its own, always whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    null = column.is_null().to_numpy(zero_copy_only=False)
    _, offs, body = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Chunk(i, j, data[offs[i] : offs[j]], (offs[i : j + 1] - offs[i]), null[i:j])
        i = j


def byte_codes(c: Chunk, depth: int) -> np.ndarray:
    """For each byte, the `depth` bytes before it in its text (0 before the beginning) and itself, oldest highest."""
    n, docs = len(c.data), len(c.starts) - 1
    out = c.data.astype(np.uint64)
    at = np.arange(n, dtype=np.int64) - np.repeat(c.starts[:-1], c.lengths)
    for k in range(1, depth + 1):
        if k >= n + 1:
            break
        prev = np.zeros(n, np.uint64)
        prev[k:] = c.data[:-k]
        prev[at < k] = 0
        out |= prev << np.uint64(8 * k)
    return out


def run_sums(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their weights (their number without)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(weights[order], first)


class Tally:
    """Sums by key, merged as they come, handed out when there are many."""

    def __init__(self, most: int = 1_500_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(run_sums(keys))
        self.size += len(self.parts[-1][0])
        if self.size > self.most and len(self.parts) > 1:
            self._merge()

    def _merge(self) -> None:
        k, w = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = [run_sums(k, w)]
        self.size = len(self.parts[0][0])

    def full(self) -> bool:
        return self.size > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._merge()
        out, self.parts, self.size = self.parts[0], [], 0
        return out


class HashIndex:
    """Values by 64-bit key: keys scrambled and sorted, found through a table of their leading bits."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        h = mix(keys)
        order = np.argsort(h)
        self.h, self.values = h[order], [v[order] for v in values]
        self.start: np.ndarray | None = None

    def __getstate__(self):
        return {"h": self.h, "values": self.values, "start": None}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is missing."""
        n = len(self.h)
        if not n:
            return np.full(len(keys), -1, np.int64)
        if self.start is None:
            bits = max(1, int(n - 1).bit_length())
            self.shift = np.uint64(64 - bits)
            counts = np.bincount((self.h >> self.shift).astype(np.int64), minlength=1 << bits)
            self.start = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)
        q = mix(keys)
        at = self.start[(q >> self.shift).astype(np.int64)].astype(np.int64)
        got = self.h[np.minimum(at, n - 1)]
        todo = np.flatnonzero(got < q)
        while len(todo):
            at[todo] += 1
            inside = at[todo] < n
            todo = todo[inside]
            todo = todo[self.h[at[todo]] < q[todo]]
        ok = at < n
        at[~ok] = 0
        at[~ok | (self.h[at] != q)] = -1
        return at


@dataclass
class Words:
    """Words (runs of bytes above 0x20) of a chunk: 64-bit hashes, byte ranges, and each row's range of words."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row_starts: np.ndarray


def words(c: Chunk, fold: bool = False) -> Words:
    n = len(c.data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(len(c.starts), np.int64))
    data = c.data
    if fold:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = data > 32
    edge = np.zeros(n + 1, bool)
    edge[c.starts] = True
    is_begin = inside.copy()
    is_begin[1:] &= ~inside[:-1] | edge[1:n]
    is_end = inside.copy()
    is_end[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(is_begin), np.flatnonzero(is_end) + 1
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=prefix[1:])
    h = (prefix[end] - prefix[begin]) * powers(n, inverse=True)[begin]
    return Words(mix(h), begin, end, np.searchsorted(begin, c.starts))


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions without k words are left out."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * powers(len(w)), out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * powers(n, inverse=True)[:n])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, … (counts[0] of them), starts[1], …"""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)
