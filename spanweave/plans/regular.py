"""Phrases and paths that are regular over token tests and edge labels, for all sentences of an Arrow batch at once.

Tests are made once for each distinct token.  A phrase becomes an automaton that all tokens of the batch enter side
by side; a path is walked by sets of (first token, token reached).  Results are those of `Engine`; what these
forms can't express (coordinators, lexicons, roots inside phrases) is left to it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .engine import MAX_PHRASE, Engine, Sentence
from .lang import Node, RuleError, RuleSet

KEPT = 300_000  # distinct tokens whose tests are remembered from batch to batch
LEAVES = 60
SIZE = "_tokens"  # a column with the number of tokens, where nobody looks at them
LAYER = "_layer_"  # and with the outcome of the tests on a layer for each token, as bits


class Other(Exception):
    """Not regular."""


def regular(rules: RuleSet, name: str) -> "Phrase | Path | None":
    """The rule in its regular form, or None."""
    try:
        engine = Engine(rules)
        name, rule, home, env = engine.rule(name, (), rules)
        if rule is None:
            return None
        if rule.kind == "phrase":
            return Phrase(engine, name, rule, home, env)
        return Path(engine, name, rule, home, env) if rule.kind == "parse" else None
    except (Other, RuleError):
        return None


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values and bounds of a list column; null lists are empty."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def sizes(batch: pa.RecordBatch) -> np.ndarray:
    """Bounds of the sentences, from their tokens or the number of them."""
    if SIZE in batch.schema.names:
        size = np.maximum(pc.fill_null(batch.column(SIZE), 0).to_numpy(zero_copy_only=False), 0)
        return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return flat(batch.column("tokens"))[1]


def coded(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A code for each value, and the distinct values."""
    d = values.dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


class Phrase:
    """An automaton over the tests of a phrase."""

    def __init__(self, engine: Engine, name, rule, home, env):
        self.engine, self.name, self.key = engine, name, (id(rule.expr), id(home), env)
        self.moves: list[list] = []
        self.leaves: list[tuple] = []
        self.layers: list[tuple[str, frozenset]] = []
        self.lexical = False  # whether any test looks at tokens
        self.first, self.last = self._build(rule.expr, home, env, rule.fold, 0)
        if len(self.leaves) > LEAVES or len(self.layers) > 30:
            raise Other("many tests")
        self.known: dict[str, int] = {}
        self.layered = [k for k, x in enumerate(self.leaves) if x[0] == "test" and self._layers(x[1], x[2], x[3])]
        # state 0 is dead; a state's set is closed but for END
        self.states: list[frozenset] = [frozenset()]
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.masks: dict[int, int] = {}
        self.table = np.zeros((1, 0), np.int32)
        self.whole, self.at_end = [False], [False]
        self.begin = self._state(self._closed({self.first}, start=True)), self._state(self._closed({self.first}))

    # -- the automaton

    def _new(self) -> int:
        self.moves.append([])
        return len(self.moves) - 1

    def _leaf(self, leaf: tuple) -> int:
        if leaf not in self.leaves:
            self.leaves.append(leaf)
        return self.leaves.index(leaf)

    def _build(self, x: Node, home, env, fold, depth: int) -> tuple[int, int]:
        if depth > 40:
            raise Other("deep")
        a, b = self._new(), self._new()
        if x.op == "lit":
            self.lexical = True
            self.moves[a].append((self._leaf(("lit", x.value[0].lower() if fold else x.value[0], fold)), b))
        elif x.op in ("test", "call"):
            name, rule, there, below = self.engine.rule(x.value[0], env, home)
            if rule is None:
                if name not in ("START", "END", "ANY"):
                    raise Other(name)
                self.moves[a].append((name, b))
            elif rule.kind == "test":
                self._layers(rule.expr, there, below)
                self.moves[a].append((self._leaf(("test", rule.expr, there, below)), b))
            elif rule.kind == "phrase" and x.op == "call":
                c, d = self._build(rule.expr, there, below, rule.fold, depth + 1)
                if d in self._closed({c}, True, True):
                    raise Other("a call that may be empty")
                self.moves[a].append((None, c))
                self.moves[d].append((None, b))
            else:
                raise Other(rule.kind)
        elif x.op == "alt":
            for y in x.args:
                c, d = self._build(y, home, env, fold, depth + 1)
                self.moves[a].append((None, c))
                self.moves[d].append((None, b))
        elif x.op == "seq":
            at = a
            for y in x.args:
                c, d = self._build(y, home, env, fold, depth + 1)
                self.moves[at].append((None, c))
                at = d
            self.moves[at].append((None, b))
        elif x.op in ("?", "*", "+"):
            c, d = self._build(x.args[0], home, env, fold, depth + 1)
            self.moves[a].append((None, c))
            self.moves[d].append((None, b))
            if x.op in "?*":
                self.moves[a].append((None, b))
            if x.op in "*+":
                self.moves[d].append((None, c))
        else:
            raise Other(x.op)
        return a, b

    def _layers(self, n: Node, home, env, depth: int = 0) -> bool:
        """Whether a test asks for layers; their labels are noted."""
        if depth > 40:
            raise Other("deep")
        if n.op == "layer":
            if n.value not in self.layers:
                self.layers.append(n.value)
            return True
        if n.op == "member" and n.value[2]:
            raise Other("lemmas")
        if n.op == "ref":
            name, rule, there, below = self.engine.rule(n.value, env, home)
            if rule is None and name == "ANY":
                return False
            if rule is None or rule.kind != "test":
                raise Other("no test")
            return self._layers(rule.expr, there, below, depth + 1)
        self.lexical |= not n.args
        return any([self._layers(a, home, env, depth + 1) for a in n.args])

    def _closed(self, states, start: bool = False, end: bool = False) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for cond, to in self.moves[todo.pop()]:
                if to not in out and (cond is None or (start and cond == "START") or (end and cond == "END")):
                    out.add(to)
                    todo.append(to)
        return frozenset(out)

    def _state(self, closed: frozenset) -> int:
        if closed not in self.number:
            self.number[closed] = len(self.states)
            self.states.append(closed)
            self.whole.append(self.last in closed)
            self.at_end.append(self.last in self._closed(closed, end=True))
            self.table = np.vstack([self.table, np.full((1, self.table.shape[1]), -1, np.int32)])
        return self.number[closed]

    def _step(self, state: np.ndarray, sign: np.ndarray) -> np.ndarray:
        out = self.table[state, sign]
        new = out < 0
        if new.any():
            masks = list(self.masks)
            for s, m in {*zip(state[new].tolist(), sign[new].tolist())}:
                mask = masks[m]
                to = {t for q in self.states[s] for cond, t in self.moves[q] if cond == "ANY" or (isinstance(cond, int) and mask >> cond & 1)}
                got = self._state(self._closed(to)) if to else 0
                self.table[s, m] = got
            out = self.table[state, sign]
        return out

    # -- tokens

    def _token_masks(self, tokens: list[str]) -> np.ndarray:
        """For each distinct token the tests without layers that it meets, as bits."""
        if len(self.known) > KEPT:
            self.known = {}
        new = [t for t in tokens if t not in self.known]
        if new:
            self.engine.start_sentence(Sentence(new))
            for i, t in enumerate(new):
                m = 0
                for k, leaf in enumerate(self.leaves):
                    if k not in self.layered and ((t.lower() if leaf[2] else t) == leaf[1] if leaf[0] == "lit" else self.engine.test(leaf[1], i, leaf[2], leaf[3])):
                        m |= 1 << k
                self.known[t] = m
        return np.fromiter((self.known[t] for t in tokens), np.int64, len(tokens))

    def _layer(self, batch: pa.RecordBatch, bounds: np.ndarray, asked: tuple) -> np.ndarray:
        """For each token, whether its layer has one of the wanted values."""
        out = np.zeros(bounds[-1], bool)
        done = LAYER + asked[0]
        if done in batch.schema.names:
            values, at = flat(batch.column(done))
            row, any_of = np.arange(batch.num_rows), (pc.fill_null(values, 0).to_numpy(zero_copy_only=False) >> self.layers.index(asked) & 1).astype(bool)
        elif "ann" in batch.schema.names:
            ann, (label, wanted) = batch.column("ann"), asked
            offs, items = ann.offsets.to_numpy(), ann.items
            hit = np.flatnonzero(pc.fill_null(pc.equal(ann.keys, label), False).to_numpy(zero_copy_only=False)[offs[0] : offs[-1]]) + offs[0]
            row = np.searchsorted(offs, hit, "right") - 1
            valid = ann.is_valid().to_numpy(zero_copy_only=False)[row]
            hit, row = hit[valid], row[valid]
            last = np.append(row[1:] != row[:-1], True)[: len(row)]  # of a repeated label the last one counts
            hit, row = hit[last], row[last]
            per_token, at = flat(items.take(pa.array(hit)))
            nested = pa.types.is_list(per_token.type) or pa.types.is_large_list(per_token.type)
            values, below = flat(per_token) if nested else (per_token, np.arange(len(per_token) + 1))
            met = pc.fill_null(pc.is_in(values, pa.array(sorted(wanted), values.type)), False).to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(met, dtype=np.int64)])
            any_of = sums[below[1:]] > sums[below[:-1]]
        else:
            return out
        n = np.minimum(at[1:] - at[:-1], bounds[row + 1] - bounds[row])
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(bounds[row], n) + step] = any_of[np.repeat(at[:-1], n) + step]
        return out

    def _value(self, n: Node, home, env, batch, bounds, codes, tokens) -> np.ndarray:
        """A test with layers, for each token."""
        if n.op in ("or", "and"):
            parts = [self._value(a, home, env, batch, bounds, codes, tokens) for a in n.args]
            return np.logical_or.reduce(parts) if n.op == "or" else np.logical_and.reduce(parts)
        if n.op == "not":
            return ~self._value(n.args[0], home, env, batch, bounds, codes, tokens)
        if n.op == "layer":
            return self._layer(batch, bounds, n.value)
        if n.op == "ref":
            name, rule, there, below = self.engine.rule(n.value, env, home)
            return np.ones(bounds[-1], bool) if rule is None else self._value(rule.expr, there, below, batch, bounds, codes, tokens)
        self.engine.start_sentence(Sentence(tokens))
        return np.array([self.engine.test(n, i, home, env) for i in range(len(tokens))], bool)[codes]

    def longest(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(bounds of sentences, for each token the length of the longest phrase that begins with it)."""
        bounds = sizes(batch)
        n = int(bounds[-1])
        out = np.zeros(n, np.int64)
        if not n:
            return bounds, out
        codes, tokens, mask = np.zeros(0, np.int64), [], np.zeros(1 if self.layered else 0, np.int64)
        if "tokens" in batch.schema.names:
            codes, tokens = coded(batch.column("tokens").flatten())
            mask = self._token_masks(tokens)
        if self.layered:
            mask = mask[codes] if len(codes) else np.zeros(n, np.int64)
            for k in self.layered:
                _, expr, home, env = self.leaves[k]
                mask |= self._value(expr, home, env, batch, bounds, codes, tokens).astype(np.int64) << k
        every, sign = np.unique(mask, return_inverse=True)
        for m in every.tolist():
            self.masks.setdefault(m, len(self.masks))
        grown = len(self.masks) - self.table.shape[1]
        if grown:
            self.table = np.hstack([self.table, np.full((len(self.table), grown), -1, np.int32)])
            self.table[0] = 0
        sign = np.array([self.masks[m] for m in every.tolist()])[sign]
        sign = sign if self.layered else sign[codes]
        end = np.repeat(bounds[1:], bounds[1:] - bounds[:-1])
        state = np.full(n, self.begin[1])
        full = bounds[1:] > bounds[:-1]
        state[bounds[:-1][full]] = self.begin[0]
        act = np.arange(n)
        state = self._step(state, sign)
        for k in range(1, MAX_PHRASE + 1):
            alive = state > 0
            act, state = act[alive], state[alive]
            if not len(act):
                break
            at, stop = act + k, end[act]
            out[act[np.array(self.whole)[state] | (np.array(self.at_end)[state] & (at == stop))]] = k
            more = at < stop
            act, state = act[more], state[more]
            state = self._step(state, sign[at[more]])
        return bounds, out

    def spans(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, begin, end) of the matches: leftmost, longest, one after the other."""
        bounds, size = self.longest(batch)
        at = np.flatnonzero(size)
        if (at[1:] < at[:-1] + size[at[:-1]]).any():
            kept, last = [], -1
            for i, e in zip(at.tolist(), (at + size[at]).tolist()):
                if i >= last:
                    kept.append(i)
                    last = e
            at = np.array(kept, np.int64)
        row = np.searchsorted(bounds, at, "right") - 1
        return row, at - bounds[row], at + size[at] - bounds[row]

    inclusive = False

    def columns(self, have: list[str], deep: bool) -> dict[str, Column]:
        """What a batch needs; `deep` if the values of layers are lists."""
        out = {"tokens": F.col("tokens")} if self.lexical or not self.layers else {SIZE: F.size("tokens")}
        if "ann" in have:
            for label in {x for x, _ in self.layers}:
                sets = [(k, sorted(w)) for k, (x, w) in enumerate(self.layers) if x == label]
                bits = lambda v: reduce(Column.__add__, [F.when(F.exists(v, lambda y: y.isin(w)) if deep else v.isin(w), 1 << k).otherwise(0) for k, w in sets])  # noqa: B023, E731
                out[LAYER + label] = F.transform(F.col("ann")[label], bits)
        return out


class Path:
    """A path over edge labels."""

    def __init__(self, engine: Engine, name, rule, home, env):
        self.engine, self.name = engine, name
        self.moves, self.start, self.final = engine._nfa(rule.expr, home, env)
        self.known: dict[tuple, bool] = {}
        # free moves taken out: from a state by a condition to a state
        self.reach = {s: self._free(s) for s in self.moves}
        self.steps = {s: [(c, to) for q in self.reach[s] for c, to in self.moves[q] if c is not None] for s in self.moves}
        for moves in self.steps.values():
            for (kind, what, _), _ in moves:
                if kind == "test":
                    self._check(what[0], what[1], what[2])

    def _free(self, s: int) -> set[int]:
        out, todo = {s}, [s]
        while todo:
            for cond, to in self.moves[todo.pop()]:
                if cond is None and to not in out:
                    out.add(to)
                    todo.append(to)
        return out

    def _check(self, n: Node, home, env, depth: int = 0) -> None:
        if depth > 40 or n.op == "layer" or (n.op == "member" and n.value[2]):
            raise Other(n.op)
        if n.op == "ref":
            name, rule, there, below = self.engine.rule(n.value, env, home)
            if rule is None and name == "ANY":
                return
            if rule is None or rule.kind != "test":
                raise Other("no test")
            self._check(rule.expr, there, below, depth + 1)
        for a in n.args:
            self._check(a, home, env, depth + 1)

    def _holds(self, cond: tuple, labels: list[str]) -> np.ndarray:
        kind, what, _ = cond
        if kind == "any":
            return np.ones(len(labels), bool)
        if kind == "label":
            return np.array([x == what for x in labels], bool)
        return np.array([self.engine.test(what[0], 0, what[1], what[2], x) for x in labels], bool)

    def spans(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, begin, end): the first and the last token of each path, each pair once."""
        bounds = sizes(batch)
        size = bounds[1:] - bounds[:-1]
        n = int(bounds[-1])
        deps, edges = flat(batch.column("deps"))
        child, parent = (deps.field(f) for f in ("child", "parent"))
        if deps.null_count or any(deps.field(f).null_count for f in ("child", "parent", "label")):
            raise Other("null")
        child, parent = child.to_numpy(zero_copy_only=False).astype(np.int64), parent.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(size)), edges[1:] - edges[:-1])
        codes, labels = coded(deps.field("label"))
        there = parent >= 0  # others are roots
        child, parent, row, codes = child[there], parent[there], row[there], codes[there]
        if ((child < 0) | (child >= size[row]) | (parent >= size[row])).any():
            raise Other("edges beyond the sentence")
        child, parent = child + bounds[row], parent + bounds[row]
        ways: dict[tuple, tuple] = {}

        def along(cond: tuple) -> tuple[np.ndarray, np.ndarray]:
            """Edges that meet the condition, from and to, in order of `from`."""
            if cond not in ways:
                ok = self._holds(cond, labels)[codes] if len(labels) else np.zeros(0, bool)
                c, p = child[ok], parent[ok]
                a = np.concatenate([c if cond[2] in ("", "/") else c[:0], p if cond[2] in ("", "\\") else p[:0]])
                b = np.concatenate([p if cond[2] in ("", "/") else p[:0], c if cond[2] in ("", "\\") else c[:0]])
                order = np.argsort(a, kind="stable")
                ways[cond] = a[order], b[order]
            return ways[cond]

        ends, seen, todo = [], {}, []

        def arrive(state: int, keys: np.ndarray) -> None:
            if self.final in self.reach[state]:
                ends.append(keys)
            if self.steps[state]:
                keys = np.unique(keys)
                have = seen.get(state)
                if have is not None:
                    keys = np.setdiff1d(keys, have, assume_unique=True)
                    seen[state] = np.union1d(have, keys)
                else:
                    seen[state] = keys
                if len(keys):
                    todo.append((state, keys))

        for cond, to in self.steps[self.start]:
            a, b = along(cond)
            arrive(to, a * n + b)
        while todo:
            state, keys = todo.pop()
            first, at = keys // n, keys % n
            for cond, to in self.steps[state]:
                a, b = along(cond)
                lo, hi = np.searchsorted(a, at, "left"), np.searchsorted(a, at, "right")
                many = hi - lo
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                arrive(to, np.repeat(first, many) * n + b[np.repeat(lo, many) + step])
        keys = np.unique(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
        first, last = (keys // n, keys % n) if n else (keys, keys)
        first, last = first[first != last], last[first != last]
        row = np.searchsorted(bounds, first, "right") - 1
        return row, first - bounds[row], last - bounds[row]

    inclusive = True

    def columns(self, have: list[str], deep: bool) -> dict[str, Column]:
        return {SIZE: F.size("tokens"), "deps": F.col("deps")}
