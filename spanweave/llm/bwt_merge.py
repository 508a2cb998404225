"""Suffix-array dedup: Burrows-Wheeler transforms of shards, merged by refining their interleave."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._batch import gram_hashes
from .passages import WINDOW, load_segments, runs, shared_spans, spans_table

STRIDE = 16
ROUNDS = WINDOW // STRIDE
SHARDS = 4


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable order of nonnegative integers below 2**32, by two counting sorts on 16 bits."""
    x = x.astype(np.uint32)
    order = np.argsort((x & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    high = (x >> np.uint32(16)).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def shard_transform(x: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and transform of a shard's strings, each ended by a 0 of its own.

    `x` are the symbols of all strings in turn, ends included; equal suffixes go in the order of their strings.
    """
    n = len(x)
    end = x == 0
    rank = np.where(end, np.cumsum(end), x.astype(np.int64) + int(end.sum()))
    order = stable_order(rank)
    step = 1
    while True:
        sorted_ = rank[order]
        change = np.r_[True, sorted_[1:] != sorted_[:-1]]
        if change.all():
            break
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(change)
        # a suffix that ended within `step` symbols is unique by now; what follows it doesn't matter
        after = np.zeros(n, np.int64)
        after[:-step] = dense[step:] if step < n else 0
        second = stable_order(after)
        order = second[stable_order(dense[second])]
        both = np.r_[True, (dense[order[1:]] != dense[order[:-1]]) | (after[order[1:]] != after[order[:-1]])]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(both)
        step *= 2
        if step >= n:
            break
    first = np.r_[True, string[1:] != string[:-1]]
    before = np.r_[np.uint32(0), x[:-1]]
    before[first] = 0
    return order, before[order]


def merge(shards: list[tuple[np.ndarray, np.ndarray]], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged suffix order of the shards and common prefixes, from their transforms alone.

    Round h orders the rows by their first h symbols: going through the interleave of the round before, each row
    sends its shard to the next place of its preceding symbol.  A row differs from the one above it in the h-th
    symbol if the two came from different blocks or symbols; h - 1 is then their common prefix.  Rows that share
    `rounds` symbols have that number.
    """
    sizes = [len(b) for _, b in shards]
    total = sum(sizes)
    shard_of = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    symbols = np.concatenate([b for _, b in shards])
    z, block = shard_of, np.zeros(total, np.int64)
    common = np.full(total, rounds, np.int16)
    for h in range(1, rounds + 1):
        in_order = np.empty(total, symbols.dtype)
        in_order[np.argsort(z, kind="stable")] = symbols
        place = stable_order(in_order)
        ends = int((in_order == 0).sum())
        z = np.concatenate([np.sort(z[place[:ends]], kind="stable"), z[place[ends:]]])
        was, sym = block[place], in_order[place]
        new = np.r_[True, (sym[1:] != sym[:-1]) | (was[1:] != was[:-1])]
        new[:ends] = True
        if ends < total:
            new[ends] = True
        common[new & (common == rounds)] = h - 1
        block = np.cumsum(new)
    order = np.empty(total, np.int64)
    base = np.cumsum([0, *sizes[:-1]])
    order[np.argsort(z, kind="stable")] = np.concatenate([o + b for (o, _), b in zip(shards, base)])
    return order, common


def _kernel(t: pa.Table) -> pa.Table:
    hashes, row_starts, doc, s0, r = load_segments(t)
    syms = gram_hashes(hashes, STRIDE)
    # each segment gives STRIDE strings of 16-word symbols, one for each phase
    count = r + WINDOW - STRIDE
    phases = np.tile(np.arange(STRIDE), len(doc))
    seg = np.repeat(np.arange(len(doc)), STRIDE)
    per = np.maximum(0, (count[seg] - phases + STRIDE - 1) // STRIDE)
    lengths = per + 1
    string = np.repeat(np.arange(len(seg)), lengths)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    local = phases[string] + offset * STRIDE
    ended = offset == per[string]
    at = row_starts[seg[string]] + local
    _, dense = np.unique(syms[at[~ended]], return_inverse=True)
    x = np.zeros(len(string), np.uint32)
    x[~ended] = dense + 1
    cuts = np.searchsorted(string, [len(seg) // STRIDE * k // SHARDS * STRIDE for k in range(SHARDS + 1)])
    bounds = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
    shards = [shard_transform(x[a:b], string[a:b]) for a, b in bounds]
    order, common = merge(shards, ROUNDS)
    # intervals of rows that share a window: where the common prefix stays at ROUNDS symbols
    head = np.flatnonzero(common < ROUNDS)
    owner = doc[seg[string[order]]]
    low, high = np.minimum.reduceat(owner, head), np.maximum.reduceat(owner, head)
    shared = np.repeat(low < high, np.diff(np.r_[head, len(order)]))
    hits = order[shared]
    base = np.cumsum(r) - r
    flag = np.zeros(int(r.sum()), bool)
    flag[base[seg[string[hits]]] + local[hits]] = True
    part = np.repeat(np.arange(len(doc)), r)
    first, last = runs(flag, part)
    p = part[first]
    return spans_table(doc[p], s0[p] + first - base[p], s0[p] + last - base[p] + WINDOW)


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, begin_word, end_word): maximal stretches whose every word lies in a 48-word window that at least
    one other document holds too; words are numbered from 0 and `end_word` is one past the last.

    Words are runs of bytes above 0x20, compared exactly as written.  Equal windows are brought together by
    anchors (see `passages`).  In each group the segments are split into shards, whose Burrows-Wheeler
    transforms over 16-word symbols are built apart and merged by refining their interleave for three rounds,
    48 words; intervals of rows with a common prefix of three symbols from two documents or more are repeats.

    Nulls: rows with a null doc_id or text, and texts under 48 words, give nothing.  Repeated rows of one doc_id
    don't repeat each other.  Repeats within one document only don't count.  Further columns are ignored, and an
    empty table gives an empty result.
    """
    return shared_spans(docs, _kernel)
