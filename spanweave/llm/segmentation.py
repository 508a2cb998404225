"""SentencePiece encoding and decoding with the N best segmentations of each text."""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._batch import HashIndex, chunks, spread
from ._session import arrow_map, doc_view
from ._units import UnitCache, code_points, hasher, kept, range_hashes

NBEST = 4
LONG = 2048
SPACE = 0x2581
_state: dict = {}


class Lattice:
    """The pieces of a SentencePiece model with their log probabilities, and lattices over units of text.

    A unit is a run of spaces with the text up to the next space; no piece has a space after another sign, so
    the best path of a text is that of its units, and so are the model's own ids.  Models of merges give ranks
    instead of probabilities; Zipf's law makes them -ln((rank + 1) · H).  A sign without a piece costs 10 more than
    the worst piece and is written as its bytes.  Scores are rounded to multiples of 2^-20, so that sums are exact
    and equal paths tie.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = sp
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.names = {i: sp.id_to_piece(i) for i in ids}
        if any("▁" in p.lstrip("▁") for p in self.names.values()):
            raise ValueError("the model has pieces with a space inside")
        raw = np.array([sp.get_score(i) for i in ids])
        if (raw == np.round(raw)).all():
            order = np.argsort(-raw, kind="stable")
            rank = np.empty(len(ids))
            rank[order] = np.arange(1, len(ids) + 1)
            raw = -np.log(rank * (math.log(len(ids)) + 0.5772156649))
        raw = np.round(raw * 2.0**20) / 2.0**20
        self.score = {self.names[i]: (float(s), i) for i, s in zip(ids, raw)}
        self.unknown = float(raw.min()) - 10.0
        self.byte_id = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.longest = max(map(len, self.score))
        texts = list(self.score)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for x in texts])
        self.index = HashIndex(range_hashes(points, ends - [len(x) for x in texts], ends), np.array([self.score[x][0] for x in texts]), np.array([self.score[x][1] for x in texts]))
        size = sp.get_piece_size()
        body = [b""] * size
        for i, x in self.names.items():
            body[i] = x.replace("▁", " ").encode()
        for b, i in self.byte_id.items():
            body[i] = bytes([b])
        self.body = np.frombuffer(b"".join(body), np.uint8)
        self.body_size = np.array([len(x) for x in body], np.int64)
        self.body_start = np.cumsum(self.body_size) - self.body_size

    def fallback(self, sign: str) -> list[int]:
        return [self.byte_id[b] for b in sign.encode("utf-8", "replace")]

    def own(self, units: list[str]) -> list[list[int]]:
        """The model's own ids of each unit; the library puts the first space there itself."""
        done = self.model.encode([u[1:] for u in units], num_threads=1)
        return [x if len(u) > 1 else [self.score["▁"][1]] for u, x in zip(units, done)]

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each unit its own ids and then the best path's, the number of both, the best path's score, what the
        second best loses, and the number of own ids."""
        own, ((paths, size), score, gap) = self.own(units), self.best(units)
        first = np.array([len(x) for x in own], np.int64)
        begin = np.cumsum(first + size) - first - size
        flat = np.empty(first.sum() + size.sum(), np.int32)
        flat[spread(begin, first)] = np.fromiter(chain.from_iterable(own), np.int32)
        flat[spread(begin + first, size)] = paths
        return flat, first + size, score, gap, first

    def best(self, units: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """Token ids of the best paths of all units in turn, the number of each, its score, and how much the second best loses.

        Forward and backward Viterbi over many units at once; the second best path is the best one through an
        edge that the best path doesn't use.  Among equal paths that with the longest last piece wins, and so
        on towards the beginning.  Units of more than LONG signs are searched one by one, in linear space.
        """
        flat, used = [], 0
        start, count = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        score, gap = np.zeros(len(units)), np.zeros(len(units))
        by_size: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            n = len(u)
            if n > LONG:
                found = self.nbest(u, 2)
                flat.append(np.array(found[0][1], np.int32))
                start[k], count[k], score[k] = used, len(flat[-1]), found[0][0]
                used += count[k]
                gap[k] = found[0][0] - found[1][0] if len(found) > 1 else np.inf
                continue
            by_size.setdefault(n if n <= 24 else 1 << (n - 1).bit_length(), []).append(k)
        for size, members in by_size.items():
            step = max(1, 400_000 // (size * self.longest))
            for a in range(0, len(members), step):
                some = members[a : a + step]
                ids, n, score[some], gap[some] = self._viterbi([units[k] for k in some], size)
                start[some], count[some] = used + np.cumsum(n) - n, n
                flat.append(ids)
                used += len(ids)
        return (np.concatenate(flat or [np.zeros(0, np.int32)])[spread(start, count)], count), score, gap

    def _viterbi(self, units: list[str], size: int):
        """As `best`, over units of at most `size` signs; edges by length, begin and unit, so that units lie side by side."""
        m, longest = len(units), min(self.longest, size)
        lens = np.array([len(u) for u in units])
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        points[points == 32] = SPACE
        row = np.repeat(np.arange(m), lens)
        col = np.arange(len(points)) - np.repeat(np.cumsum(lens) - lens, lens)
        edge = np.full((longest, size, m), -np.inf)
        ids = np.full((longest, size, m), -1, np.int32)
        left, hashes = lens[row] - col, hasher(points)
        for k in range(1, longest + 1):
            at = np.flatnonzero(left >= k)
            if not len(at):
                break
            hit = self.index.find(hashes(at, at + k))
            ok = hit >= 0
            r, c_ = row[at[ok]], col[at[ok]]
            edge[k - 1, c_, r] = self.index.values[0][hit[ok]]
            ids[k - 1, c_, r] = self.index.values[1][hit[ok]]
        bare = np.isneginf(edge[0, col, row])
        edge[0, col[bare], row[bare]] = self.unknown
        every = np.arange(m)
        fwd = np.full((size + 1, m), -np.inf)
        fwd[0] = 0
        back = np.zeros((size + 1, m), np.int64)
        for t in range(1, size + 1):
            w = min(longest, t)
            cand = fwd[t - w : t] + edge[np.arange(w - 1, -1, -1), np.arange(t - w, t)]
            pick = np.argmax(cand, axis=0)
            fwd[t] = cand[pick, every]
            back[t] = w - pick
        bwd = np.full((size + 1, m), -np.inf)
        bwd[lens, every] = 0
        for s in range(size - 1, -1, -1):
            w = min(longest, size - s)
            np.maximum(bwd[s], (edge[:w, s] + bwd[s + 1 : s + 1 + w]).max(axis=0), out=bwd[s])
        total = fwd[lens, every]
        at, live, steps = lens.copy(), every, []
        while len(live):
            k = back[at[live], live]
            s = at[live] - k
            steps.append((live, s, ids[k - 1, s, live]))
            edge[k - 1, s, live] = -np.inf  # what is left are the edges that the best path doesn't use
            at[live] = s
            live = live[s > 0]
        second = np.full(m, -np.inf)
        for k in range(1, longest + 1):
            np.maximum(second, (fwd[: size - k + 1] + edge[k - 1, : size - k + 1] + bwd[k:]).max(axis=0), out=second)
        row, begin, path = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(row * (size + 1) + begin)
        row, begin, path = row[order], begin[order], path[order]
        if len(bare := np.flatnonzero(path < 0)):
            spelt = [self.fallback(units[r][s]) for r, s in zip(row[bare].tolist(), begin[bare].tolist())]
            n = np.ones(len(path), np.int64)
            n[bare] = [len(x) for x in spelt]
            path, row = np.repeat(path, n), np.repeat(row, n)
            path[spread((np.cumsum(n) - n)[bare], n[bare])] = [i for x in spelt for i in x]
        return path, np.bincount(row, minlength=m), total, np.maximum(total - second, 0.0)

    def nbest(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths of a unit, best first: A* from its end, led by the exact forward Viterbi scores.

        A path waits with the next best way into the place that it came from, so that a step adds two paths to the
        queue and not one for each piece; among equal scores the path that is nearer to the beginning goes on.
        Every path taken from the queue completes to one of its score: at most n times the length are taken.
        """
        u, known, longest = unit.replace(" ", "▁"), self.score, self.longest
        fwd = array("d", [-math.inf]) * (len(u) + 1)
        fwd[0] = 0.0
        for t in range(1, len(u) + 1):
            top = -math.inf if u[t - 1] in known else fwd[t - 1] + self.unknown
            for s in range(max(0, t - longest), t):
                if (e := known.get(u[s:t])) is not None and fwd[s] + e[0] > top:
                    top = fwd[s] + e[0]
            fwd[t] = top
        kids: dict[int, list[tuple[float, int]]] = {}

        def ways(t: int) -> list[tuple[float, int]]:
            """Where the pieces into `t` begin, the best first and the longest first among equals."""
            if t not in kids:
                found = [(fwd[s] + e[0], s) for s in range(max(0, t - longest), t) if (e := known.get(u[s:t])) is not None]
                if u[t - 1] not in known:
                    found.append((fwd[t - 1] + self.unknown, t - 1))
                kids[t] = sorted(found, key=lambda x: (-x[0], x[1]))
            return kids[t]

        out: list[tuple[float, list[int]]] = []
        if not u:
            return [(0.0, [])]
        heap, made = [], 0

        def push(t: int, done: float, tail, k: int) -> None:
            nonlocal made
            if k < len(way := ways(t)):
                made += 1
                heapq.heappush(heap, (-(done + way[k][0]), way[k][1], made, t, done, tail, k))

        push(len(u), 0.0, None, 0)
        while heap and len(out) < n:
            _, s, _, t, done, tail, k = heapq.heappop(heap)
            push(t, done, tail, k + 1)
            e = known.get(u[s:t])
            after = (s, t, tail)
            if s:
                push(s, done + (e[0] if e else self.unknown), after, 0)
                continue
            ids: list[int] = []
            while after:
                a, b, after = after
                ids += [e[1]] if (e := known.get(u[a:b])) is not None else self.fallback(unit[a])
            out.append((done + (known[u[s:t]][0] if u[s:t] in known else self.unknown), ids))
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of several texts in turn, each without its first space, and the number of bytes of each."""
        size = self.body_size[ids]
        data = self.body[spread(self.body_start[ids], size)]
        ends = np.r_[0, np.cumsum(size)]
        sizes = np.diff(ends[np.r_[0, np.cumsum(counts)]])
        keep = np.ones(len(data), bool)
        first = np.cumsum(sizes) - sizes
        keep[first[sizes > 0]] = False
        return data[keep], np.maximum(sizes - 1, 0)


def decode(ids: list[int], model_path: str) -> str:
    """The text of token ids: pieces joined, bytes put together, the added first space taken off."""
    data, _ = lattice(model_path).decode(np.array(ids, np.int64), np.array([len(ids)]))
    return data.tobytes().decode("utf-8", "replace")


def lattice(path: str) -> Lattice:
    if _state.get("path") != path:
        _state["path"], _state["lattice"] = path, Lattice(path)
        _state["cache"] = UnitCache(_state["lattice"].segment, 3)
        _state["more"] = {}
    return _state["lattice"]


def worker_state(path: str) -> tuple[Lattice, UnitCache, dict]:
    """The model, the units and the alternatives found so far, kept by this worker from task to task."""
    kept(_state)
    return lattice(path), _state["cache"], _state["more"]


def combine(total: float, places: list[tuple[int, list[tuple[float, list[int]]]]], n: int) -> list[tuple[float, list[tuple[int, list[int]]]]]:
    """The n best texts from the alternatives of some of its units: (unit, paths best first); the others stay."""
    loss = lambda choice: sum(places[i][1][0][0] - places[i][1][j][0] for i, j in choice)
    heap, seen, out = [(0.0, ())], {()}, []
    while heap and len(out) < n:
        cost, choice = heapq.heappop(heap)
        out.append((total - cost, [(places[i][0], places[i][1][j][1]) for i, j in choice]))
        have = dict(choice)
        for i, (_, paths) in enumerate(places):
            if (j := have.get(i, 0) + 1) < len(paths):
                after = tuple(sorted({**have, i: j}.items()))
                if after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (loss(after), after))
    return out


def encode_chunk(c, lat: Lattice, cache: UnitCache, more: dict, n: int):
    """The model's token ids and their number by text, those of the best path alike, its score, and the N best by text."""
    p, starts = code_points(c)
    m = len(starts) - 1
    size = np.diff(starts)
    full = size > 0
    # the text with the space that goes before it
    at = starts[:-1][full]
    q = np.insert(p, at, 32)
    begin_text = starts[:-1] + np.r_[0, np.cumsum(full)[:-1]] if m else starts[:-1]
    edge = np.zeros(len(q) + 1, bool)
    edge[begin_text[full]] = True
    blank = q == 32
    unit = edge[:-1] | (blank & np.r_[True, ~blank[:-1]])
    begin = np.flatnonzero(unit)
    end = np.r_[begin[1:], len(q)]
    place = cache.places(q, begin, end)
    text_of = np.searchsorted(begin_text[full], begin, "right") - 1
    row = np.flatnonzero(full)[text_of] if len(begin) else text_of
    first = np.searchsorted(row, np.arange(m + 1))
    scores, gaps, own = cache.extra[0][place], cache.extra[1][place], cache.extra[2][place].astype(np.int64)
    found = []
    for a, k in ((cache.start[place], own), (cache.start[place] + own, cache.size[place] - own)):
        counts = np.zeros(m, np.int64)
        np.add.at(counts, row, k)
        found += [cache.flat[spread(a, k)], counts]
    total, best = np.zeros(m), []
    for k in range(m):
        a, b = first[k], first[k + 1]
        if a == b:
            best.append([(0.0, [])] if not c.null[k] else None)
            continue
        total[k] = math.fsum(scores[a:b])
        g = gaps[a:b]
        near = np.arange(b - a) if b - a < n else np.sort(np.argsort(g, kind="stable")[: n - 1])
        places = []
        for i in near.tolist():
            key = int(place[a + i]), cache.generation
            if (paths := more.get(key)) is None:
                if len(more) > 30_000:
                    more.clear()
                paths = lat.nbest(q[begin[a + i] : end[a + i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), n)
                if end[a + i] - begin[a + i] <= 256:
                    more[key] = paths
            places.append((i, paths))
        best.append(combine(float(total[k]), places, n))
    return *found, total, best


def encode(docs: DataFrame, model_path: str, n: int = NBEST) -> DataFrame:
    """(doc_id, ids, n_tokens, best_ids, score, n_best, round_trip) for each row of `docs`.

    `ids` are the model's own token ids of the whole text, those that its library gives.  `best_ids` is the best
    path over the piece lattice and `score` its log probability; `n_best` lists the `n` best ones, best first, each
    with its score and the units in which it differs from `best_ids` (edits: number of the unit, its ids).  A unit's
    alternatives come from A* search backward over its lattice; a text's from the units whose second best path
    loses least.  `round_trip` says that decoding `ids` and `best_ids` gives the text again (the sign U+2581 counts
    as the space that it stands for).

    Very long texts are encoded whole; a stretch without a space is one unit, searched in time linear in its
    length.  Units are known again by a 64-bit hash.

    Nulls: a null text has null results; the empty text has no ids, score 0, and itself as only segmentation; a
    null doc_id stays.  Among equal scores the longest last piece wins in `best_ids`, and the order in `n_best` is
    that of the search.  Repeated rows are rows like others.  Further columns are ignored; an empty table gives
    an empty result.
    """
    view = doc_view(docs, "doc_id", "text")
    kind = view.schema["doc_id"].dataType.simpleString()
    best_type = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("unit", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
    schema = f"doc_id {kind}, ids array<int>, n_tokens long, best_ids array<int>, score double, n_best array<struct<score double, edits array<struct<unit int, ids array<int>>>>>, round_trip boolean"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, cache, more = worker_state(model_path)
        for batch in it:
            for c in chunks(batch.column(1)):
                ids, counts, best_ids, best_counts, total, best = encode_chunk(c, lat, cache, more, n)
                same, lists = ~c.null, []
                for i, k in ((ids, counts), (best_ids, best_counts)):
                    same = same & _round_trip(c, lat, i, k)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(k)].astype(np.int32)), pa.array(i, pa.int32()), mask=pa.array(c.null)))
                rows = [None if x is None else [{"score": round(s, 6), "edits": [{"unit": u, "ids": i} for u, i in e]} for s, e in x] for x in best]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.last - c.first), lists[0], pa.array(counts, mask=c.null), lists[1], pa.array(np.round(total, 6), mask=c.null), pa.array(rows, best_type), pa.array(same, mask=c.null)],
                    ["doc_id", "ids", "n_tokens", "best_ids", "score", "n_best", "round_trip"],
                )

    return arrow_map(view, run, schema)


def _round_trip(c, lat: Lattice, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether the ids of each text give it again."""
    data, sizes = lat.decode(ids.astype(np.int64), counts)
    raw = c.data.tobytes()
    if b"\xe2\x96\x81" not in raw and np.array_equal(sizes, c.lengths):
        unequal = np.flatnonzero(data != c.data)
        same = np.ones(len(sizes), bool)
        same[np.searchsorted(c.starts, unequal, "right") - 1] = False
        return same
    ends, out = np.r_[0, np.cumsum(sizes)], data.tobytes()
    return np.array([out[a:b] == raw[s:e].replace(b"\xe2\x96\x81", b" ") for a, b, s, e in zip(ends[:-1], ends[1:], c.starts[:-1], c.starts[1:])], bool)
