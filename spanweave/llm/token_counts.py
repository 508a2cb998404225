"""Token counts at every prefix of a text, for a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batch import chunks, spread
from ._session import arrow_map, doc_view
from ._units import UnitCache, code_points, kept

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = {"'re", "'ve", "'ll"}
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_state: dict = {}


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def classes() -> np.ndarray:
    if "classes" not in _state:
        kind = {"L": _LETTER, "N": _NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[_SPACES] = _SPACE
        _state["classes"] = table
    return _state["classes"]


class PrefixCounter:
    """Exact counts at every prefix of a piece, by dynamic programming over its bytes.

    The encoding of a prefix ends in the one token t before which the encoding of the rest, ending in token u,
    stays as it is: the pair u t must encode to itself.  So count[i] = count[i - |t|] + 1.  The tokens that end
    at each byte come from one pass of an Aho-Corasick automaton, so the work is linear in the piece.
    """

    def __init__(self, path: str):
        import ahocorasick

        self.enc, self.ranks = encoding(path)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (r, len(t)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def stays(self, u: int, t: int) -> bool:
        """Whether token t stays itself after token u (-1: at the beginning)."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        want = [t] if u < 0 else [u, t]
        ok = self.enc._encode_single_piece(b"".join(self.tokens[x] for x in want)) == want
        self.pairs[u << 20 | t] = ok
        return ok

    def counts(self, piece: str) -> list[int]:
        if len(piece) == 3 and piece in CONTRACTIONS:  # before its last letter it is two pieces
            sign, letter = self.counts(piece[0])[-1], self.counts(piece[1])[-1]
            return [sign, sign + letter, self._programme(piece.encode())[-1]]
        data = piece.encode()
        count = self._programme(data)
        if len(data) == len(piece):
            return count[1:]
        ends = np.flatnonzero((np.frombuffer(data, np.uint8)[1:] & 0xC0) != 0x80) + 1
        return [count[i] for i in [*ends.tolist(), len(data)]]

    def _programme(self, data: bytes) -> list[int]:
        last, count, pairs = [-1] * (len(data) + 1), [0] * (len(data) + 1), self.pairs
        for end, (t, size) in self.automaton.iter(data.decode("latin-1")):
            i = end + 1
            if not count[i]:
                u = last[i - size]
                ok = pairs.get(u << 20 | t)
                if ok or ok is None and self.stays(u, t):
                    last[i], count[i] = t, count[i - size] + 1
        return count

    def make(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.counts(x) for x in pieces]
        return np.array([y for x in found for y in x], np.int32), np.array([len(x) for x in found], np.int64)


def pieces(p: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of the texts begin, and the runs of white space: their first and last places."""
    n = len(p)
    kind = classes()[p]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[n] = True
    new = edge[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], n]
    space = kind[begin] == _SPACE
    sb, se = begin[space], end[space]
    mark = new.copy()
    inner = ~edge[se]  # something follows: the last white space is a piece of its own or belongs to what follows
    mark[se[inner] - 1] = True
    joins = inner & (p[se - 1] == 32)
    mark[se[joins]] = False
    # contractions begin at an apostrophe that stands alone and joined to no space
    lone = begin[(end - begin == 1) & (p[begin] == 39)]
    lone = lone[mark[lone] & (lone + 1 < n)]
    lone = lone[~edge[lone + 1]]
    a = p[lone + 1]
    b = np.where(lone + 2 < n, p[np.minimum(lone + 2, n - 1)], 0)
    b = np.where(edge[np.minimum(lone + 2, n)], 0, b)
    one = np.isin(a, [ord(x) for x in "stmd"])
    two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    for at, size in ((lone[one], 2), (lone[two], 3)):
        mark[at + 1] = False
        if size == 3:
            mark[at + 2] = False
        after = at + size
        after = after[after < n]
        mark[after] = True
    return np.flatnonzero(mark), sb, se


def prefix_counts(c, cache: UnitCache) -> tuple[np.ndarray, np.ndarray]:
    """For each code point of a chunk the number of tokens of the text up to and with it; where texts begin."""
    p, starts = code_points(c)
    n = len(p)
    if not n:
        return np.zeros(0, np.int64), starts
    begin, sb, se = pieces(p, starts)
    end = np.r_[begin[1:], n]
    at = cache.places(p, np.r_[begin, sb], np.r_[end, se])
    piece, run = at[: len(begin)], at[len(begin) :]
    total = cache.flat[cache.start[piece] + cache.size[piece] - 1].astype(np.int64)
    before = np.cumsum(total) - total
    text = np.searchsorted(starts, begin, "right") - 1
    first = np.searchsorted(begin, starts[:-1])
    base = np.r_[before, total.sum()][first][text]
    before = before - base
    out = np.repeat(before, end - begin) + cache.flat[spread(cache.start[piece], end - begin)]
    # a prefix that ends in white space ends in one piece, the run so far
    if len(sb):
        head = before[np.searchsorted(begin, sb, "right") - 1]
        out[spread(sb, se - sb)] = np.repeat(head, se - sb) + cache.flat[spread(cache.start[run], se - sb)]
    return out, starts


def pack(counts: np.ndarray) -> bytes:
    """Counts as steps from one to the next: one byte each if they fit, else a byte 0x80 and four bytes."""
    step = np.diff(counts, prepend=0)
    small = np.abs(step) < 128
    if small.all():
        return step.astype(np.int8).tobytes()
    out = np.zeros(len(step), object)
    return b"".join(int(s).to_bytes(1, "little", signed=True) if k else b"\x80" + int(s).to_bytes(4, "little", signed=True) for s, k in zip(step, small)) if len(out) else b""


def unpack(data: bytes) -> np.ndarray:
    """The counts that `pack` stored: element i is the number of tokens of the first i + 1 characters."""
    raw = np.frombuffer(data, np.int8)
    if not (raw == -128).any():
        return np.cumsum(raw.astype(np.int64))
    steps, i = [], 0
    while i < len(raw):
        wide = raw[i] == -128
        steps.append(int.from_bytes(data[i + 1 : i + 5], "little", signed=True) if wide else int(raw[i]))
        i += 5 if wide else 1
    return np.cumsum(np.array(steps, np.int64))


def tokens_at(data: bytes, characters: int) -> int:
    """Tokens of the first `characters` characters."""
    return int(unpack(data)[characters - 1]) if characters and data else 0


def truncate_at(data: bytes, budget: int) -> int:
    """The most characters from the beginning whose tokens are at most `budget`."""
    fit = np.flatnonzero(unpack(data) <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


def worker_cache(path: str) -> UnitCache:
    """Counts by distinct piece, kept by this worker from task to task."""
    kept(_state)
    if _state.get("path") != path:
        _state["path"], _state["cache"] = path, UnitCache(PrefixCounter(path).make, 0)
    return _state["cache"]


def token_counts(docs: DataFrame, tokenizer_path: str, budgets: tuple[int, ...] = (512, 2048)) -> DataFrame:
    """(doc_id, n_chars, n_tokens, prefix_counts, cut_<budget>…) for each row of `docs`.

    `prefix_counts` holds the exact number of tokens of every prefix of the text, as steps (`unpack` reads it;
    `tokens_at` and `truncate_at` answer from it without encoding again).  cut_<budget> is the most characters
    whose tokens fit the budget.  Counts are those of encoding the prefix itself, also where it ends within a
    word or within white space; they aren't monotone.  Pieces (words, runs of signs) are counted once each
    and known again by a 64-bit hash and not by comparison; very long texts, with spaces or without, are counted
    whole, in time linear in their length.

    Nulls: a null text has null results, the empty text 0 tokens and empty counts; a null doc_id stays.
    Repeated rows are rows like others.  Further columns are ignored; an empty table gives an empty result.
    """
    view = doc_view(docs, "doc_id", "text")
    fields = ["n_chars", "n_tokens", "prefix_counts", *[f"cut_{b}" for b in budgets]]
    kinds = view.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kinds}, n_chars long, n_tokens long, prefix_counts binary, " + ", ".join(f"cut_{b} long" for b in budgets)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(tokenizer_path)
        for batch in it:
            for c in chunks(batch.column(1)):
                counts, starts = prefix_counts(c, cache)
                m = len(starts) - 1
                size = np.diff(starts)
                full = np.flatnonzero(size > 0)
                total = np.zeros(m, np.int64)
                total[full] = counts[starts[1:][full] - 1]
                packed = [None if z else pack(counts[a:b]) for z, a, b in zip(c.null, starts[:-1], starts[1:])]
                cuts = []
                for b in budgets:
                    place = np.where(counts <= b, np.arange(1, len(counts) + 1), 0)
                    best = np.zeros(m, np.int64)
                    if len(full):
                        best[full] = np.maximum(0, np.maximum.reduceat(place, starts[:-1][full]) - starts[:-1][full])
                    cuts.append(pa.array(best, mask=c.null))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.last - c.first), pa.array(size.astype(np.int64), mask=c.null), pa.array(total, mask=c.null), pa.array(packed, pa.binary()), *cuts], ["doc_id", *fields])

    return arrow_map(view, run, schema)
