"""The rule language: statements, expressions and rule sets."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

LIBRARY = Path(__file__).resolve().parent.parent / "rules"


class RuleError(ValueError):
    """A rule that can't be read or compiled."""


@dataclass(frozen=True)
class Node:
    """An expression: `op`, its operands, and whatever else the operator needs."""

    op: str
    args: tuple = ()
    value: object = None


@dataclass
class Rule:
    name: str
    kind: str  # test, phrase, lexicon, parse, coord, frame
    expr: Node
    bindings: dict[str, str] = field(default_factory=dict)
    fold: bool = False


_STATEMENT = re.compile(r"(?P<name>[\w]+)\s*(?P<delim><-|i?->|L[a-z0-9]*->|[:^~$])\s*(?:\[(?P<bind>[^\]\[]*=[^\]\[]*)\]\s*)?(?P<expr>.*)", re.S)


@dataclass
class Statement:
    name: str
    delim: str
    bindings: str
    expr: str
    block: list[str]


def statements(text: str) -> tuple[list[Statement], list[str]]:
    """Statements of a rule text, and the lines that are none.  Deeper lines go on with the expression."""
    found, broken, current, base = [], [], None, 0
    for raw in text.splitlines():
        line = raw.rstrip()
        bare = line.strip()
        if not bare or bare.startswith("#"):
            if current and not (current.delim == "<-" and not current.expr.strip()):
                current = None
            continue
        depth = len(line) - len(line.lstrip())
        if current and depth > base:
            current.block.append(line)
            continue
        m = _STATEMENT.fullmatch(bare)
        if not m:
            broken.append(bare)
            current = None
            continue
        current, base = Statement(m["name"], m["delim"], m["bind"] or "", m["expr"], []), depth
        found.append(current)
    return found, broken


class Tokens:
    def __init__(self, pattern: str, text: str):
        self.items, at = [], 0
        rx = re.compile(pattern, re.S)
        while at < len(text):
            if text[at].isspace():
                at += 1
                continue
            m = rx.match(text, at)
            if not m or m.end() == at:
                raise RuleError(f"unexpected {text[at:at + 10]!r}")
            self.items.append((m.lastgroup, m.group()))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, *texts: str) -> str | None:
        if self.peek()[1] in texts and self.peek()[0] != "end":
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise RuleError(f"expected {text!r}, found {self.peek()[1]!r}")

    def finish(self) -> None:
        if self.at < len(self.items):
            raise RuleError(f"unexpected {self.peek()[1]!r}")


_TEST = r"""(?P<regex>/(?:\\.|[^/\s\\])+/i?)|(?P<file>f\{[^}]*\}[is]*)|(?P<set>\{[^}]*\}(?:\d*\.?\d+a?|[is]*))|(?P<sub><[^>\s]*>i?)
|(?P<layer>[A-Za-z_]\w*\[[^\]]*\])|(?P<ref>[&@][\w.]+)|(?P<word>\w+)|(?P<sign>[()])"""


def parse_test(text: str, files: "RuleSet | None" = None) -> Node:
    t = Tokens(_TEST.replace("\n", ""), text)

    def either() -> Node:
        parts = [both()]
        while t.take("or"):
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both() -> Node:
        parts = [inverted()]
        while t.take("and"):
            parts.append(inverted())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def inverted() -> Node:
        if t.take("not"):
            return Node("not", (inverted(),))
        return atom()

    def atom() -> Node:
        kind, s = t.peek()
        t.at += 1
        if s == "(":
            inner = either()
            t.need(")")
            return inner
        if kind == "regex":
            fold = s.endswith("i")
            body = s[1 : -2 if fold else -1]
            try:
                re.compile(body)
            except re.error as e:
                raise RuleError(str(e)) from e
            return Node("regex", value=(body, fold))
        if kind in ("set", "file"):
            body, _, flags = s[s.index("{") + 1 :].partition("}")
            if kind == "file":
                path = files.find(body.strip()) if files else Path(body.strip())
                members = [x.strip() for x in path.read_text().splitlines() if x.strip()]
            else:
                members = body.split()
            if m := re.fullmatch(r"(\d*\.?\d+)(a?)", flags):
                return Node("radius", value=(tuple(members), float(m[1]), bool(m[2])))
            fold = "i" in flags
            return Node("member", value=(frozenset(x.lower() if fold else x for x in members), fold, "s" in flags))
        if kind == "sub":
            fold = s.endswith("i")
            body = s[1 : -2 if fold else -1]
            return Node("substring", value=(body.lower() if fold else body, fold))
        if kind == "layer":
            label, body = s[:-1].split("[", 1)
            return Node("layer", value=(label, frozenset(body.split())))
        if kind == "ref":
            return Node("ref", value=s[1:])
        raise RuleError(f"no token test: {s!r}")

    out = either()
    t.finish()
    return out


_PHRASE = r"(?P<ref>[&@][\w.]+)|(?P<sign>[()|?*+])|(?P<word>\w+)|(?P<other>[^\w\s])"
_PARSE = r"(?P<ref>[&@][/\\]?[\w.]+)|(?P<sign>[()|?*+])|(?P<word>[/\\]?[\w:]+)|(?P<other>[^\w\s])"


def parse_regex(text: str, path: bool = False) -> Node:
    """Alternation, sequence, ? * + over literals and references."""
    t = Tokens(_PARSE if path else _PHRASE, text)

    def alternation() -> Node:
        parts = [sequence()]
        while t.take("|"):
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else Node("alt", tuple(parts))

    def sequence() -> Node:
        parts = []
        while t.peek()[0] != "end" and t.peek()[1] not in ("|", ")"):
            parts.append(repeated())
        return parts[0] if len(parts) == 1 else Node("seq", tuple(parts))

    def repeated() -> Node:
        node = atom()
        while sign := t.take("?", "*", "+"):
            node = Node(sign, (node,))
        return node

    def atom() -> Node:
        kind, s = t.peek()
        t.at += 1
        if s == "(" and kind == "sign":
            inner = alternation()
            t.need(")")
            return inner
        if kind == "ref":
            way = s[1] if path and s[1] in "/\\" else ""
            return Node("test" if s[0] == "&" else "call", value=(s[1 + len(way) :], way))
        if kind in ("word", "other"):
            way = s[0] if path and s[0] in "/\\" and len(s) > 1 else ""
            return Node("lit", value=(s[len(way) :], way))
        raise RuleError(f"unexpected {s!r}")

    out = alternation()
    t.finish()
    return out


_COORD = r'(?P<string>"[^"]*")|(?P<number>\d+)|(?P<name>[A-Za-z_][\w.]*)|(?P<sign>[(),=\[\]])|(?P<ref>[&@][\w.]+)'
_FILTERS = {"filter": 2, "prefix": 2, "suffix": 2, "near": 3, "precedes": 3, "follows": 3, "count": 3}
_MANY = {"union", "inter", "diff"}
_PAIRS = {"overlaps", "contains", "contained_by"}


def parse_coord(text: str) -> Node:
    t = Tokens(_COORD, text)

    def feed() -> Node:
        kind, s = t.peek()
        if kind not in ("name", "ref"):
            raise RuleError(f"unexpected {s!r}")
        t.at += 1
        if s == "_":
            return Node("scope")
        if not t.take("("):
            return Node("match", (Node("scope"),), value=s.lstrip("&@"))
        return operator(s)

    def name() -> str:
        kind, s = t.peek()
        if kind not in ("name", "ref"):
            raise RuleError(f"expected a rule name, found {s!r}")
        t.at += 1
        return s.lstrip("&@")

    def number() -> int:
        kind, s = t.peek()
        if kind != "number":
            raise RuleError(f"expected a number, found {s!r}")
        t.at += 1
        return int(s)

    def inverted() -> bool:
        if t.take(","):
            if not t.take("invert", "inverted"):
                raise RuleError("expected invert")
            return True
        return False

    def operator(s: str) -> Node:
        if s in ("match", "select"):
            p = name()
            t.need(",")
            node = Node(s, (feed(),), value=p)
        elif s in _FILTERS:
            p, k = name(), 0
            t.need(",")
            if _FILTERS[s] == 3:
                k = number()
                t.need(",")
            node = Node(s, (feed(),), value=(p, k, inverted() if s not in ("precedes", "follows") else False))
        elif s in _MANY or s in _PAIRS:
            parts = [feed()]
            while t.take(","):
                parts.append(feed())
            if s in _PAIRS and len(parts) != 2:
                raise RuleError(f"{s} takes two arguments")
            node = Node(s, tuple(parts))
        elif s == "connects":
            p = name()
            t.need(",")
            left = feed()
            t.need(",")
            node = Node(s, (left, feed()), value=p)
        elif s == "when":
            cond = condition()
            t.need(",")
            node = Node(s, (feed(),), value=cond)
        elif s in ("widen", "merge"):
            node = Node(s, (feed(),))
        else:
            raise RuleError(f"no operator {s!r}")
        t.need(")")
        return node

    def condition() -> Node:
        parts = [conjunction()]
        while t.take("or"):
            parts.append(conjunction())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def conjunction() -> Node:
        parts = [negation()]
        while t.take("and"):
            parts.append(negation())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def negation() -> Node:
        if t.take("not"):
            return Node("not", (negation(),))
        if t.take("("):
            inner = condition()
            t.need(")")
            return inner
        return Node("seen", value=name())

    out = feed()
    t.finish()
    return out


def parse_frame(text: str) -> Node:
    """frame(anchor, field=path, …) or reduce(rule); a path is a sequence of names, outermost first."""
    m = re.fullmatch(r"\s*(frame|reduce)\s*\((.*)\)\s*", text, re.S)
    if not m:
        raise RuleError("expected frame(…) or reduce(…)")
    if m[1] == "reduce":
        return Node("reduce", value=m[2].strip().lstrip("&@"))
    anchor, *rest = [x.strip() for x in m[2].split(",")]
    fields = []
    for part in rest:
        key, eq, path = part.partition("=")
        if not eq or not path.split():
            raise RuleError(f"no field: {part!r}")
        fields.append((key.strip(), tuple(path.split())))
    return Node("frame", value=(anchor.lstrip("&@"), tuple(fields)))


class RuleSet:
    """Named rules with imports below and a parent above.

    Rules that can't be read are skipped and listed in `errors`, or raise with `strict`.  The first of several
    rules of one name wins unless `redefine` is set.
    """

    def __init__(self, text: str = "", parent: "RuleSet | None" = None, base: Path | None = None, strict: bool = False, redefine: bool = False):
        self.rules: dict[str, Rule] = {}
        self.children: dict[str, RuleSet] = {}
        self.parent, self.base, self.strict, self.redefine = parent, base, strict, redefine
        self.errors: list[str] = []
        self.radius: dict[tuple, frozenset] = parent.radius if parent else {}
        if text:
            self.load(text)

    @classmethod
    def from_file(cls, path: str | Path, **options) -> "RuleSet":
        path = Path(path)
        return cls(path.read_text(), base=path.parent, **options)

    def find(self, name: str) -> Path:
        for place in (Path(name), Path.cwd() / name, (self.base or Path.cwd()) / name, LIBRARY / name):
            if place.is_file():
                return place
        raise RuleError(f"no file {name!r}")

    def load(self, text: str) -> None:
        found, broken = statements(text)
        for line in broken:
            self._fail(f"no statement: {line}")
        for s in found:
            try:
                self._add(s)
            except (RuleError, OSError, ValueError, IndexError) as e:
                self._fail(f"{s.name}: {e}")

    def _fail(self, message: str) -> None:
        if self.strict:
            raise RuleError(message)
        self.errors.append(message)

    def _add(self, s: Statement) -> None:
        if (s.name in self.rules or s.name in self.children) and not self.redefine:
            raise RuleError("there is a rule of this name")
        if s.delim == "<-":
            self._import(s)
            return
        text = " ".join([s.expr, *[x.strip() for x in s.block if not x.strip().startswith("#")]]).strip()
        bindings = {}
        for part in filter(None, (x.strip() for x in s.bindings.split(","))):
            a, _, b = part.partition("=")
            bindings[a.strip().lstrip("&@")] = b.strip().lstrip("&@")
        if s.delim == ":":
            rule = Rule(s.name, "test", parse_test(text, self), bindings)
        elif s.delim in ("->", "i->"):
            rule = Rule(s.name, "phrase", parse_regex(text), bindings, s.delim == "i->")
        elif s.delim.startswith("L"):
            rule = Rule(s.name, "lexicon", self._lexicon(s.delim[1:-2], text), bindings, "i" in s.delim)
        elif s.delim == "^":
            rule = Rule(s.name, "parse", parse_regex(text, path=True), bindings)
        elif s.delim == "~":
            rule = Rule(s.name, "coord", parse_coord(text), bindings)
        else:
            rule = Rule(s.name, "frame", parse_frame(text), bindings)
        self.rules[s.name] = rule

    def _lexicon(self, flags: str, text: str) -> Node:
        import csv

        path, column = self.find(text.strip()), re.search(r"c(\d+)", flags)
        if "c" in flags and not column:
            raise RuleError("which column?")
        if column:
            with open(path, newline="") as f:
                rows = [r[int(column[1])] for r in list(csv.reader(f))[1:] if len(r) > int(column[1])]
        else:
            rows = path.read_text().splitlines()
        rx = re.compile(r"[A-Za-z]+|[0-9]+|[^\s]")
        fold = str.lower if "i" in flags else str
        entries = {tuple(fold(t) for t in rx.findall(x)): x for x in rows}
        entries.pop((), None)
        return Node("trie", value=entries)

    def _import(self, s: Statement) -> None:
        text = s.expr.strip()
        block = [x for x in s.block]
        if not text and block:
            cut = min(len(x) - len(x.lstrip()) for x in block)
            self.children[s.name] = RuleSet("\n".join(x[cut:] for x in block), self, self.base, self.strict, self.redefine)
        elif m := re.fullmatch(r"c\{([^;}]*);([^}]*)\}", text):
            labels, clusters = (self.find(x.strip()).read_text().splitlines() for x in m.groups())
            groups: dict[str, set] = {}
            for a, b in zip(labels, clusters):
                groups.setdefault(b.strip(), set()).add(a.strip())
            self._members(s.name, groups, False)
        elif m := re.fullmatch(r"j\{([^}]*)\}(i?)", text):
            self._members(s.name, json.loads(self.find(m[1].strip()).read_text()), bool(m[2]))
        elif m := re.fullmatch(r"(f?\{[^}]*\})([is]*)", text):
            flags = m[2]
            members = self.find(m[1].strip("f{} ")).read_text().split("\n")
            members = [x.strip() for x in members if x.strip()]
            value = (frozenset(x.lower() if "i" in flags else x for x in members), "i" in flags, "s" in flags)
            self.rules[s.name] = Rule(s.name, "test", Node("member", value=value))
        else:
            path = self.find(text if Path(text).suffix else text + ".rules") if text else None
            if path is None:
                raise RuleError("nothing to import")
            child = RuleSet(parent=self, base=path.parent, strict=self.strict, redefine=self.redefine)
            child.load(path.read_text())
            self.children[s.name] = child

    def _members(self, name: str, groups: dict, fold: bool) -> None:
        child = RuleSet(parent=self)
        for key, words in groups.items():
            child.rules[str(key)] = Rule(str(key), "test", Node("member", value=(frozenset(w.lower() if fold else w for w in words), fold, False)))
        self.children[name] = child

    def lookup(self, name: str) -> tuple[Rule, "RuleSet"]:
        """The rule of a dotted name and the set that holds it; outer sets are asked after inner ones."""
        *path, last = name.split(".")
        at: RuleSet | None = self
        while at is not None:
            here: RuleSet | None = at
            for p in path:
                here = here.children.get(p) if here else None
            if here and last in here.rules:
                return here.rules[last], here
            at = at.parent
        raise RuleError(f"no rule {name!r}")

    def names(self) -> list[str]:
        return [*self.rules, *(f"{c}.{n}" for c, s in self.children.items() for n in s.names())]

    def without(self, *names: str) -> "RuleSet":
        """A copy without some rules."""
        out = RuleSet(parent=self.parent, base=self.base, strict=self.strict, redefine=self.redefine)
        out.rules = {n: r for n, r in self.rules.items() if n not in names}
        out.children, out.radius = dict(self.children), self.radius
        return out

    def references(self, name: str) -> list[str]:
        """Names that a rule refers to itself."""
        rule, _ = self.lookup(name)
        found: list[str] = []

        def walk(n) -> None:
            if n.op in ("ref", "seen"):
                found.append(n.value)
            elif n.op in ("test", "call", "match", "select", "connects", "reduce"):
                found.append(n.value[0] if isinstance(n.value, tuple) else n.value)
            elif n.op in _FILTERS:
                found.append(n.value[0])
            elif n.op == "frame":
                found.append(n.value[0])
            elif n.op == "when":
                walk(n.value)
            for a in n.args:
                walk(a)

        walk(rule.expr)
        return list(dict.fromkeys(rule.bindings.get(x, x) for x in found))

    def requirements(self, name: str, seen: frozenset = frozenset()) -> set[str]:
        """Annotation layers that a rule needs, with those of the rules it refers to."""
        if name in seen or name in ("ANY", "START", "END"):
            return set()
        if name == "ROOT":
            return {"deps"}
        try:
            rule, _ = self.lookup(name)
        except RuleError:
            return set()
        need = {"deps"} if rule.kind == "parse" else set()

        def walk(n) -> None:
            if n.op == "layer":
                need.add(n.value[0])
            if n.op == "member" and n.value[2]:
                need.add("lemma")
            for a in n.args:
                walk(a)

        walk(rule.expr)
        for r in self.references(name):
            need.update(self.requirements(r, seen | {name}))
        return need

    def tree(self, name: str, depth: int = 0, seen: tuple = ()) -> list[str]:
        """The references of a rule, indented by depth."""
        lines = ["  " * depth + name]
        if name not in seen:
            try:
                for r in self.references(name):
                    lines += self.tree(r, depth + 1, (*seen, name))
            except RuleError:
                pass
        return lines

    def unreferenced(self) -> list[str]:
        used = {r for n in self.rules for r in self.references(n)}
        return [n for n in self.rules if n not in used]
