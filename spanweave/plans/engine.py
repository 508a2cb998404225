"""Evaluation of rules on one sentence: the kernel that runs inside Arrow batches.

Rules are evaluated in scopes [sb, se) of a sentence, with results kept by (rule, bindings, scope).  Phrases are
sets of reachable ends with one derivation each, so that their cost is bounded by length times states.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from .lang import Node, Rule, RuleError, RuleSet

MAX_PHRASE = 300
Env = tuple  # sorted (name, name) pairs


class Span:
    """A match: extent, the rule's name, and the matches it is made of."""

    __slots__ = ("name", "kind", "begin", "end", "inclusive", "kids", "fields", "hull")

    def __init__(self, name, kind, begin, end, kids=(), inclusive=False, fields=None, hull=()):
        self.name, self.kind, self.begin, self.end = name, kind, begin, end
        self.kids, self.inclusive, self.fields, self.hull = list(kids), inclusive, fields, hull

    @property
    def extent(self) -> tuple[int, int]:
        if self.inclusive:
            return min(self.begin, self.end), max(self.begin, self.end) + 1
        return self.begin, self.end

    def named(self, name: str | None, kind: str | None = None) -> "Span":
        return Span(name, kind or self.kind, self.begin, self.end, self.kids, self.inclusive, self.fields, self.hull)

    def children(self) -> list["Span"]:
        seen: dict[int, Span] = {}
        for k in self.kids:
            seen.setdefault(id(k), k)
        return list(seen.values())

    def all_named(self, name: str) -> list["Span"]:
        """Matches below this one by name, once for each way down to them; fields of frames too."""
        out = []
        if self.fields is not None:
            out += [v for k, vs in self.fields if k == name for v in vs]
        for k in self.children():
            if answers(name, k.name):
                out.append(k)
            out += k.all_named(name)
        return out

    def query(self, names: tuple[str, ...]) -> Iterable["Span"]:
        """Matches at the end of a path of names, gaps allowed, this match included."""
        if not names:
            return
        if answers(names[0], self.name):
            names = names[1:]
            if not names:
                yield self
                return
        if self.fields is not None:
            for key, values in self.fields:
                if key == names[0]:
                    for v in values:
                        if len(names) == 1:
                            yield v
                        else:
                            yield from v.query(names[1:])
                    return
        for k in self.children():
            yield from k.query(names)

    def frame(self) -> "Span | None":
        """The frame that this match is or wraps."""
        if self.fields is not None:
            return self
        return self.kids[0].frame() if self.kind == "coord" and self.kids and self.kids[0].extent == self.extent else None


def answers(asked: str, name: str | None) -> bool:
    return name is not None and (name == asked or name.endswith("." + asked))


class Sentence:
    def __init__(self, tokens: list[str], layers: dict | None = None, deps=(), roots=()):
        self.tokens, self.layers, self.deps, self.roots = list(tokens), layers or {}, list(deps or ()), set(roots or ())
        self.edges: dict[int, list[tuple[int, str, str]]] = {}
        for child, parent, label in self.deps:
            if parent < 0:
                self.roots.add(child)
            else:
                self.edges.setdefault(child, []).append((parent, label, "/"))
                self.edges.setdefault(parent, []).append((child, label, "\\"))

    def layer(self, label: str, i: int) -> set[str]:
        values = self.layers.get(label)
        v = values[i] if values is not None and i < len(values) else None
        return set() if v is None else {v} if isinstance(v, str) else {x for x in v if x is not None}

    def paths(self, a: int, b: int) -> list[list[str]]:
        """Label paths from one token to another, each token at most once; upward labels begin with /."""
        out: list[list[str]] = []

        def walk(at: int, seen: tuple, path: list[str]) -> None:
            if at == b:
                out.append(path)
                return
            for to, label, way in self.edges.get(at, ()):
                if to not in seen:
                    walk(to, (*seen, to), [*path, way + label])

        walk(a, (a,), [])
        return out


class Engine:
    """The rules of a set, applied to sentences; `record` state of `when` is kept until `start_document`."""

    def __init__(self, rules: RuleSet):
        self.rules, self.heard = rules, set()
        self.compiled: dict = {}
        self.start_sentence(Sentence([]))

    def start_document(self) -> None:
        self.heard = set()

    def start_sentence(self, s: Sentence) -> None:
        """`viable` may be set afterwards: where phrases can begin in the sentence, of those for which it is known."""
        self.s, self.memo, self.ends_memo, self.viable = s, {}, {}, {}

    # -- names and bindings

    def resolve(self, name: str, env: Env) -> str:
        bound, seen = dict(env), {name}
        while name in bound:
            name = bound[name]
            if name in seen:
                raise RuleError(f"bindings of {name!r} run in a circle")
            seen.add(name)
        return name

    def rule(self, name: str, env: Env, at: RuleSet) -> tuple[str, Rule | None, RuleSet, Env]:
        """The rule behind a name, where its names are looked up, and the bindings below it: outer ones win."""
        name = self.resolve(name, env)
        if name in ("ANY", "START", "END", "ROOT"):
            return name, None, at, env
        try:
            rule, home = at.lookup(name)
        except RuleError:
            rule, home = self.rules.lookup(name)
        below = tuple(sorted({**rule.bindings, **dict(env)}.items()))
        return name, rule, home, below

    # -- rules in a scope

    def scan(self, name: str, sb: int, se: int, env: Env = (), at: RuleSet | None = None) -> list[Span]:
        at = at or self.rules
        name, rule, home, below = self.rule(name, env, at)
        key = (id(home), name, below, sb, se)
        if key not in self.memo:
            if key in getattr(self, "running", set()):
                raise RuleError(f"{name!r} refers to itself")
            self.running = getattr(self, "running", set()) | {key}
            try:
                self.memo[key] = [m.named(name) if m.name != name else m for m in self._scan(name, rule, home, below, sb, se)]
            finally:
                self.running = self.running - {key}
        return self.memo[key]

    def _scan(self, name, rule, home, env, sb, se) -> list[Span]:
        if rule is None:
            if name == "ANY":
                return [Span(name, "test", i, i + 1) for i in range(sb, se)]
            if name == "ROOT":
                return self._phrase(Node("call", value=("ROOT", "")), name, home, env, False, sb, se)
            raise RuleError(f"{name} can't be searched for")
        if rule.kind == "test":
            return [Span(name, "test", i, i + 1) for i in range(sb, se) if self.test(rule.expr, i, home, env)]
        if rule.kind in ("phrase", "lexicon"):
            return self._phrase(rule.expr, name, home, env, rule.fold, sb, se)
        if rule.kind == "parse":
            return self._paths(rule.expr, name, home, env, sb, se)
        if rule.kind == "coord":
            return [Span(name, "coord", m.begin, m.end, m.kids, m.inclusive, m.fields, m.hull) for m in self.feed(rule.expr, home, env, sb, se)]
        return self._frames(rule.expr, name, home, env, sb, se)

    # -- token tests

    def test(self, n: Node, i: int, home: RuleSet, env: Env, label: str | None = None) -> bool:
        tok = self.s.tokens[i] if label is None else label
        if n.op == "or":
            return any(self.test(a, i, home, env, label) for a in n.args)
        if n.op == "and":
            return all(self.test(a, i, home, env, label) for a in n.args)
        if n.op == "not":
            return not self.test(n.args[0], i, home, env, label)
        if n.op == "regex":
            if n not in self.compiled:
                self.compiled[n] = re.compile(n.value[0], re.I if n.value[1] else 0)
            return self.compiled[n].search(tok) is not None
        if n.op == "member":
            members, fold, stem = n.value
            if stem:
                return any((x.lower() if fold else x) in members for x in self.s.layer("lemma", i))
            return (tok.lower() if fold else tok) in members
        if n.op == "substring":
            return n.value[0] in (tok.lower() if n.value[1] else tok)
        if n.op == "layer":
            if label is not None:
                raise RuleError("edge labels have no layers")
            return bool(n.value[1] & self.s.layer(n.value[0], i))
        if n.op == "radius":
            anchors, radius, every = n.value
            near = [tok == a or tok in self.rules.radius.get((a, radius), ()) for a in anchors]
            return all(near) if every else any(near)
        if n.op == "ref":
            name, rule, there, below = self.rule(n.value, env, home)
            if rule is None and name == "ANY":
                return True
            if rule is None or rule.kind != "test":
                raise RuleError(f"{name!r} is no token test")
            return self.test(rule.expr, i, there, below, label)
        raise RuleError(n.op)

    # -- phrases: leftmost, longest, one after the other

    def _phrase(self, expr, name, home, env, fold, sb, se) -> list[Span]:
        out, at = [], sb
        viable = self.viable.get((id(expr), id(home), env))
        while at < se:
            if viable is not None and at not in viable:
                at += 1
                continue
            found = self.ends(expr, at, se, home, env, fold)
            end = max(found, default=at)
            if end > at:
                out.append(Span(name, "phrase", at, end, found[end]))
                at = end
            else:
                at += 1
        return out

    def ends(self, n: Node, at: int, se: int, home, env, fold) -> dict[int, tuple]:
        """Every end that `n` can reach from `at`, with the submatches of the first way to it."""
        key = (id(n), at, se, id(home), env, fold)
        if key not in self.ends_memo:
            # `n` is kept with its result, so that its id stays its own
            self.ends_memo[key] = ({e: k for e, k in self._ends(n, at, se, home, env, fold).items() if e - at <= MAX_PHRASE}, n)
        return self.ends_memo[key][0]

    def _ends(self, n, at, se, home, env, fold) -> dict[int, tuple]:
        if n.op == "lit":
            tok = self.s.tokens[at] if at < se else None
            want = n.value[0]
            return {at + 1: ()} if tok is not None and (tok.lower() == want.lower() if fold else tok == want) else {}
        if n.op in ("test", "call"):
            return self._callout(n, at, se, home, env)
        if n.op == "trie":
            out, toks = {}, tuple(t.lower() if fold else t for t in self.s.tokens[at : min(se, at + MAX_PHRASE)])
            for k in range(1, len(toks) + 1):
                if toks[:k] in n.value:
                    out[at + k] = ()
            return out
        if n.op == "alt":
            out = {}
            for a in n.args:
                for e, kids in self.ends(a, at, se, home, env, fold).items():
                    out.setdefault(e, kids)
            return out
        if n.op == "seq":
            now: dict[int, tuple] = {at: ()}
            for a in n.args:
                after: dict[int, tuple] = {}
                for e, kids in now.items():
                    for f, more in self.ends(a, e, se, home, env, fold).items():
                        after.setdefault(f, more + kids)
                now = after
            return now
        inner = n.args[0]
        out = {} if n.op == "+" else {at: ()}
        if n.op == "?":
            for e, kids in self.ends(inner, at, se, home, env, fold).items():
                out.setdefault(e, kids)
            return out
        now, seen = {at: ()}, {at}
        while now:
            after = {}
            for e, kids in now.items():
                for f, more in self.ends(inner, e, se, home, env, fold).items():
                    out.setdefault(f, more + kids)
                    if f not in seen and f - at <= MAX_PHRASE:
                        seen.add(f)
                        after[f] = more + kids
            now = after
        return out

    def _callout(self, n, at, se, home, env) -> dict[int, tuple]:
        name, rule, there, below = self.rule(n.value[0], env, home)
        if rule is None:
            if name == "START":
                return {at: ()} if at == 0 else {}
            if name == "END":
                return {at: ()} if at == len(self.s.tokens) else {}
            if name == "ANY":
                return {at + 1: (Span(name, "test", at, at + 1),)} if at < se else {}
            end = at
            while end < se and end in self.s.roots:
                end += 1
            return {end: ()} if at < end < se else {}
        if rule.kind == "test":
            ok = at < se and self.test(rule.expr, at, there, below)
            return {at + 1: (Span(name, "test", at, at + 1),)} if ok else {}
        if n.op == "test":
            raise RuleError(f"{name!r} is no token test")
        if rule.kind in ("phrase", "lexicon"):
            found = self.ends(rule.expr, at, se, there, below, rule.fold)
            return {e: (Span(name, "phrase", at, e, kids),) for e, kids in found.items() if e > at}
        if rule.kind == "parse":
            raise RuleError(f"a phrase can't call the parse rule {name!r}")
        return {m.extent[1]: (m,) for m in reversed(self.scan(n.value[0], at, se, env, home)) if m.extent[0] == at and m.extent[1] > at}

    # -- paths over the dependency graph

    def _nfa(self, n: Node, home, env) -> tuple[dict, int, int]:
        """States with (condition, next) moves; condition None moves freely."""
        key = (id(n), id(home), env)
        if key in self.compiled:
            return self.compiled[key][0]
        moves: dict[int, list] = {}
        new = lambda: moves.setdefault(len(moves), []) is None or len(moves) - 1

        def build(x: Node, home, env) -> tuple[int, int]:
            a, b = new(), new()
            if x.op == "lit":
                moves[a].append((("label", *x.value), b))
            elif x.op in ("test", "call"):
                name, rule, there, below = self.rule(x.value[0], env, home)
                if rule is None and name == "ANY":
                    moves[a].append((("any", "", x.value[1]), b))
                elif rule is not None and rule.kind == "test":
                    moves[a].append((("test", (rule.expr, there, below), x.value[1]), b))
                elif rule is not None and rule.kind == "parse" and x.op == "call":
                    c, d = build(rule.expr, there, below)
                    moves[a].append((None, c))
                    moves[d].append((None, b))
                else:
                    raise RuleError(f"a parse rule can't use {name!r}")
            elif x.op == "alt":
                for y in x.args:
                    c, d = build(y, home, env)
                    moves[a].append((None, c))
                    moves[d].append((None, b))
            elif x.op == "seq":
                at = a
                for y in x.args:
                    c, d = build(y, home, env)
                    moves[at].append((None, c))
                    at = d
                moves[at].append((None, b))
            else:
                c, d = build(x.args[0], home, env)
                moves[a].append((None, c))
                moves[d].append((None, b))
                if x.op in "?*":
                    moves[a].append((None, b))
                if x.op in "*+":
                    moves[d].append((None, c))
            return a, b

        start, final = build(n, home, env)
        self.compiled[key] = ((moves, start, final), n)
        return self.compiled[key][0]

    def _paths(self, expr, name, home, env, sb, se) -> list[Span]:
        moves, start, final = self._nfa(expr, home, env)
        out = []
        for first in range(sb, se):
            seen, todo, ends = {(start, first)}, [(start, first)], {}
            while todo:
                state, at = todo.pop()
                if state == final and at != first and at < se:
                    ends[at] = True
                for cond, to in moves[state]:
                    if cond is None:
                        steps = [at]
                    else:
                        kind, what, way = cond
                        steps = []
                        for there, label, direction in self.s.edges.get(at, ()):
                            if way and way != direction:
                                continue
                            ok = kind == "any" or (label == what if kind == "label" else self.test(what[0], at, what[1], what[2], label))
                            if ok:
                                steps.append(there)
                    for there in steps:
                        if (to, there) not in seen:
                            seen.add((to, there))
                            todo.append((to, there))
            out += [Span(name, "parse", first, e, inclusive=True) for e in sorted(ends)]
        return out

    # -- coordinators

    def feed(self, n: Node, home, env, sb, se) -> list[Span]:
        make = lambda m, kids, hull=(): Span(None, "coord", m.begin, m.end, kids, m.inclusive, None, hull)
        if n.op == "scope":
            return [Span("_", "coord", sb, se)] if se > sb else []
        if n.op == "match":
            out = []
            for f in self.feed(n.args[0], home, env, sb, se):
                b, e = f.extent
                out += [make(p, (p, f)) for p in self.scan(n.value, b, e, env, home)]
            return out
        if n.op == "select":
            out = []
            name = self.resolve(n.value, env)
            for f in self.feed(n.args[0], home, env, 0, se):
                picked = sorted(f.all_named(name), key=lambda m: m.extent)
                out += [make(p, (p, f)) for p in picked if p.extent[0] >= sb and p.extent[1] <= se]
            return out
        if n.op in ("filter", "prefix", "suffix", "near", "precedes", "follows", "count"):
            return self._proximity(n, home, env, sb, se, make)
        if n.op in ("union", "inter", "diff"):
            feeds = [self.feed(a, home, env, sb, se) for a in n.args]
            extents = [{m.extent for m in f} for f in feeds]
            pool = feeds[0] if n.op == "diff" else [m for f in feeds for m in f]
            groups: dict[tuple, list[Span]] = {}
            for m in pool:
                groups.setdefault(m.extent, []).append(m)
            if n.op == "inter":
                groups = {k: v for k, v in groups.items() if all(k in x for x in extents)}
            if n.op == "diff":
                groups = {k: v for k, v in groups.items() if not any(k in x for x in extents[1:])}
            out = []
            for (b, e), members in groups.items():
                frames = [x for x in (m.frame() for m in members) if x is not None]
                merged = merge_frames(frames) if frames else None
                out.append(Span(None, "coord", b, e, members, fields=merged.fields if merged else None))
            return out
        if n.op in ("overlaps", "contains", "contained_by"):
            left, right = (self.feed(a, home, env, sb, se) for a in n.args)
            out = []
            for x in left:
                a, b = x.extent
                for y in right:
                    c, d = y.extent
                    ok = {"overlaps": a < d and c < b, "contains": a <= c and d <= b, "contained_by": c <= a and b <= d}[n.op]
                    if ok:
                        out.append(make(x, (x, y), (x, y)))
            return out
        if n.op == "connects":
            left, right = (self.feed(a, home, env, sb, se) for a in n.args)
            whole = self.scan(n.value, 0, len(self.s.tokens), env, home) if left and right else []
            out = []
            for x in left:
                for y in right:
                    c, d = y.extent
                    out += [Span(None, "coord", p.begin, p.end, (x, y, p), p.inclusive, None, (x, y)) for p in whole if x.extent[0] <= p.begin < x.extent[1] and c <= p.end < d]
            return out
        if n.op == "when":
            ok = self._heard(n.value, env)
            found = self.feed(n.args[0], home, env, sb, se) if ok else []
            return [make(f, (f,)) for f in found]
        if n.op == "widen":
            out = []
            for f in self.feed(n.args[0], home, env, sb, se):
                parts = [x.extent for x in (f.hull or f.children())] or [f.extent]
                out.append(Span(None, "coord", min(b for b, _ in parts), max(e for _, e in parts), (f,)))
            return out
        if n.op == "merge":
            out: list[Span] = []
            for f in sorted(self.feed(n.args[0], home, env, sb, se), key=lambda m: m.extent):
                b, e = f.extent
                if out and b < out[-1].end:
                    out[-1].end = max(out[-1].end, e)
                    out[-1].kids.append(f)
                else:
                    out.append(Span(None, "coord", b, e, (f,)))
            return out
        raise RuleError(n.op)

    def _proximity(self, n, home, env, sb, se, make) -> list[Span]:
        p_name, k, invert = n.value
        out = []
        for f in self.feed(n.args[0], home, env, sb, se):
            b, e = f.extent
            lo, hi = {"filter": (b, e), "count": (b, e), "prefix": (sb, b), "precedes": (sb, b), "suffix": (e, se), "follows": (e, se), "near": (sb, se)}[n.op]
            found = self.scan(p_name, lo, hi, env, home) if hi > lo else []
            if n.op == "prefix":
                found = [p for p in found if p.extent[1] == b]
            elif n.op == "suffix":
                found = [p for p in found if p.extent[0] == e]
            elif n.op == "precedes":
                found = [p for p in found if 0 <= b - p.extent[1] <= k]
            elif n.op == "follows":
                found = [p for p in found if 0 <= p.extent[0] - e <= k]
            elif n.op == "near":
                found = [p for p in found if 0 <= b - p.extent[1] <= k or 0 <= p.extent[0] - e <= k]
            if n.op == "count":
                if (len(found) >= k) != invert:
                    out.append(make(f, (*found, f) if not invert else (f,)))
            elif invert:
                if not found:
                    out.append(make(f, (f,)))
            elif n.op in ("filter", "prefix", "suffix"):
                if found:
                    out.append(make(f, (f, found[0])))
            else:
                out += [make(f, (f, p), (f, p)) for p in found]
        return out

    def _heard(self, n: Node, env: Env) -> bool:
        if n.op == "or":
            return any(self._heard(a, env) for a in n.args)
        if n.op == "and":
            return all(self._heard(a, env) for a in n.args)
        if n.op == "not":
            return not self._heard(n.args[0], env)
        return self.resolve(n.value, env) in self.heard

    def conditions(self) -> list[str]:
        """Names that `when` conditions of the set ask for."""
        found: list[str] = []

        def walk(n: Node) -> None:
            if n.op == "seen":
                found.append(n.value)
            if n.op == "when":
                walk(n.value)
            for a in n.args:
                walk(a)

        for s in (self.rules, *self.rules.children.values()):
            for r in s.rules.values():
                walk(r.expr)
        return list(dict.fromkeys(found))

    def end_sentence(self, names: list[str]) -> None:
        """Note which of the rules matched in this sentence, for the sentences after it."""
        for name in names:
            if name not in self.heard and self.scan(name, 0, len(self.s.tokens)):
                self.heard.add(name)

    # -- frames

    def _frames(self, n: Node, name, home, env, sb, se) -> list[Span]:
        if n.op == "reduce":
            return self._reduce(self.scan(n.value, 0, len(self.s.tokens), env, home), name)
        anchor, fields = n.value
        paths: dict[tuple, list[str]] = {}
        for key, path in fields:
            paths.setdefault(tuple(self.resolve(x, env) for x in path), []).append(key)
        frames: dict[tuple, Span] = {}
        for m in self.scan(anchor, sb, se, env, home):
            values: dict[str, list[Span]] = {}
            for path, keys in paths.items():
                for k, v in enumerate(m.query(path)):
                    have = values.setdefault(keys[min(k, len(keys) - 1)], [])
                    if all(v.extent != x.extent for x in have):
                        have.append(v)
            made = Span(name, "frame", m.begin, m.end, (m,), m.inclusive, [(k, values[k]) for k, _ in fields if k in values])
            made.fields = list(dict(made.fields).items())
            frames[m.extent] = merge_frames([frames[m.extent], made]) if m.extent in frames else made
        return list(frames.values())

    def _reduce(self, matches: list[Span], name: str) -> list[Span]:
        frames: dict[tuple, Span] = {}
        for m in matches:
            f = m.frame()
            if f is not None:
                frames[f.extent] = merge_frames([frames[f.extent], f]) if f.extent in frames else merge_frames([f])
        inner: set[int] = set()
        for extent, f in frames.items():
            f.fields = [(k, [frames[v.extent] if v.fields is None and v.extent in frames and v.extent != extent else v for v in vs]) for k, vs in f.fields]
            inner |= {id(v) for _, vs in f.fields for v in vs if v.fields is not None}

        def straight(f: Span, above: tuple) -> Span:
            kept = []
            for k, vs in f.fields:
                kept.append((k, [v.kids[0] if id(v) in (*above, id(f)) else straight(v, (*above, id(f))) if v.fields is not None else v for v in vs]))
            return Span(f.name, "frame", f.begin, f.end, f.kids, f.inclusive, kept)

        return [straight(f, ()) for f in frames.values() if id(f) not in inner]


def merge_frames(frames: list[Span]) -> Span:
    """One frame with the fields of all, values once by extent; name and extent of the first."""
    first, fields = frames[0], {}
    for f in frames:
        for k, vs in f.fields:
            have = fields.setdefault(k, [])
            have += [v for v in vs if all(v.extent != x.extent for x in have)]
    return Span(first.name, "frame", first.begin, first.end, first.kids, first.inclusive, list(fields.items()))
