"""Substring dedup: relative Lempel-Ziv factors of documents against indexed reference blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._batch import gram_hashes, powers
from .passages import WINDOW, load_segments, shared_spans, spans_table

BLOCK_SEGMENTS = 5_000


class Block:
    """An index of a reference block: where each 48-word window begins, in its first and its last document."""

    def __init__(self, key: np.ndarray, at: np.ndarray, doc: np.ndarray):
        order = np.lexsort((at, doc, key))
        k = key[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        self.key = k[first]
        self.low, self.high = at[order[first]], at[order[np.r_[first[1:], len(k)] - 1]] if len(k) else first

    def other(self, key: np.ndarray, doc: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
        """A place of each window in another document, -1 without."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        a, b = self.low[i], self.high[i]
        place = np.where(doc_at[a] != doc, a, np.where(doc_at[b] != doc, b, -1))
        return np.where(self.key[i] == key, place, -1)


def _kernel(t: pa.Table) -> pa.Table:
    hashes, row_starts, doc, s0, r = load_segments(t)
    n = len(hashes)
    seg_of = np.repeat(np.arange(len(doc)), np.diff(row_starts))
    end_of = row_starts[1:][seg_of]
    doc_at = doc[seg_of]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(n), out=prefix[1:])
    inv = powers(n + 1, inverse=True)

    def same(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (prefix[a + k] - prefix[a]) * inv[a] == (prefix[b + k] - prefix[b]) * inv[b]

    def extent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on, within both segments."""
        lo, hi = np.full(len(a), WINDOW), np.minimum(end_of[a] - a, end_of[b] - b)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = same(a, b, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    key = gram_hashes(hashes, WINDOW)
    owned = np.flatnonzero(np.arange(len(key)) + WINDOW <= end_of[: len(key)])
    blocks = []
    for a in range(0, len(doc), BLOCK_SEGMENTS):
        lo, hi = np.searchsorted(owned, row_starts[[a, min(len(doc), a + BLOCK_SEGMENTS)]])
        blocks.append(Block(key[owned[lo:hi]], owned[lo:hi], doc_at[owned[lo:hi]]))
    places = [np.full(n + 1, -1, np.int64) for _ in blocks]
    any_ = np.zeros(n + 1, bool)
    for p, b in zip(places, blocks):
        p[owned] = b.other(key[owned], doc_at[owned], doc_at)
        any_ |= p >= 0
    hit = np.where(any_, np.arange(n + 1), n + 1)
    next_hit = np.minimum.accumulate(hit[::-1])[::-1]
    last_hit = np.maximum.accumulate(np.where(any_, np.arange(n + 1), -1))
    at, seg = row_starts[:-1].copy(), np.arange(len(doc))
    found_b, found_e, found_s = [], [], []
    while len(at):
        # literals up to the next place that a block holds, then the longest factor from there
        at = next_hit[np.minimum(at, n)]
        live = at < row_starts[1:][seg]
        at, seg = at[live], seg[live]
        if not len(at):
            break
        size = np.zeros(len(at), np.int64)
        for p in places:
            some = np.flatnonzero(p[at] >= 0)
            if len(some):
                size[some] = np.maximum(size[some], extent(at[some], p[at[some]]))
        stop = at + size
        found_b.append(at)
        found_e.append(stop)
        found_s.append(seg)
        # at the boundary: does a factor that begins inside this one reach beyond it?
        inside = last_hit[np.minimum(stop, n) - 1]
        at = np.where((inside > at) & (inside + WINDOW > stop), inside, stop)
    if not found_b:
        z = np.zeros(0, np.int64)
        return spans_table(z, z, z)
    b, e, s = (np.concatenate(x) for x in (found_b, found_e, found_s))
    return spans_table(doc[s], s0[s] + b - row_starts[s], s0[s] + e - row_starts[s])


def shared_factors(docs: DataFrame) -> DataFrame:
    """(doc_id, begin_word, end_word): maximal stretches covered by factors of at least 48 words that another
    document holds too; words are numbered from 0 and `end_word` is one past the last.

    Every document is a reference for every other.  Anchors (see `passages`) bring each stretch of a document
    together with all reference blocks that could hold 48 words of it; there it is factored greedily: literals
    up to the next indexed place, then the longest factor among the blocks.  At the end of a factor the index is
    asked for one that begins inside it and reaches beyond it, so that no shared window is lost between factors.

    Nulls: rows with a null doc_id or text, and texts under 48 words, give nothing.  Repeated rows of one doc_id
    don't repeat each other; repeats within one document only don't count.  Further columns are ignored, and an
    empty table gives an empty result.
    """
    return shared_spans(docs, _kernel)
