"""Code points of a chunk of texts, and results kept by distinct unit (a word with its space, a run of signs)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ._batch import Chunk, mix, powers, spread


def code_points(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the chunk's texts, and where each text begins; bytes that aren't UTF-8 become U+FFFD."""
    raw = c.data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.r_[0, np.cumsum((c.data & 0xC0) != 0x80)]
        return points, lead[c.starts]
    except UnicodeDecodeError:
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(c.starts[:-1], c.starts[1:])]
        return np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum([len(x) for x in parts])]


def range_hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return hasher(points)(begin, end)


def hasher(points: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """`range_hashes` of many ranges of the same points."""
    n = len(points)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(n), out=prefix[1:])
    inverse = powers(n + 1, inverse=True)

    def hashes(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    return hashes


_kept: dict[int, dict] = {}


def kept(state: dict) -> None:
    """Note what a kernel keeps in this worker from task to task."""
    _kept[id(state)] = state


def forget() -> None:
    """Let go of it, as a kernel of another kind begins."""
    for state in _kept.values():
        state.clear()
    _kept.clear()


class UnitCache:
    """For each distinct unit an array of integers, made once by `make` and kept up to `most` units or `values` integers.

    Units are known again by a 64-bit hash; their texts aren't kept.  What is kept only saves time.  When it is full,
    the units stay that came in more than one call, if they are at most half of it.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, ...]], columns: int, most: int = 250_000, values: int = 8_000_000):
        self.make, self.columns, self.most, self.values = make, columns, most, values
        self.generation = 0
        self.clear()

    def clear(self) -> None:
        self.generation += 1
        self.known: dict[int, int] = {}
        self.flat, self.used, self.count = np.zeros(1 << 20, np.int32), 0, 0
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.extra = [np.zeros(1 << 16) for _ in range(self.columns)]
        self.again = np.zeros(1 << 16, bool)

    def _tidy(self) -> None:
        """Forget the units that came in one call only."""
        stay = np.flatnonzero(self.again[: self.count])
        size = self.size[stay]
        if 2 * len(stay) > self.most or 2 * size.sum() > self.values:
            return self.clear()
        keys = list(self.known)  # in the order of their places
        flat, extra = self.flat[spread(self.start[stay], size)], [x[stay] for x in self.extra]
        self.clear()
        self._grow(len(flat), len(stay))
        self.flat[: len(flat)] = flat
        self.start[: len(stay)], self.size[: len(stay)] = np.cumsum(size) - size, size
        for have, x in zip(self.extra, extra):
            have[: len(stay)] = x
        self.known = {keys[i]: k for k, i in enumerate(stay.tolist())}
        self.used, self.count = len(flat), len(stay)

    def places(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place in the cache of each unit points[begin:end]."""
        if len(self.known) > self.most or self.used > self.values:
            self._tidy()
        keys, first, back = np.unique(range_hashes(points, begin, end), return_index=True, return_inverse=True)
        got = np.array([self.known.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(got < 0)
        self.again[got[got >= 0]] = True
        if len(new):
            b, e = begin[first[new]], end[first[new]]
            text = points[spread(b, e - b)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            at = np.r_[0, np.cumsum(e - b)].tolist()
            flat, sizes, *extra = self.make([text[i:j] for i, j in zip(at[:-1], at[1:])])
            self._grow(len(flat), len(new))
            self.flat[self.used : self.used + len(flat)] = flat
            here = slice(self.count, self.count + len(new))
            self.start[here] = self.used + np.cumsum(sizes) - sizes
            self.size[here] = sizes
            for have, x in zip(self.extra, extra):
                have[here] = x
            got[new] = np.arange(self.count, self.count + len(new))
            self.known.update(zip(keys[new].tolist(), got[new].tolist()))
            self.used += len(flat)
            self.count += len(new)
        return got[back]

    def _grow(self, values: int, units: int) -> None:
        if self.used + values > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(max(values, len(self.flat)), np.int32)]
        if self.count + units > len(self.start):
            more = max(units, len(self.start))
            self.start, self.size = (np.r_[x, np.zeros(more, np.int64)] for x in (self.start, self.size))
            self.extra = [np.r_[x, np.zeros(more)] for x in self.extra]
            self.again = np.r_[self.again, np.zeros(more, bool)]
