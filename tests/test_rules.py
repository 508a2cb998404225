"""Rules on single sentences: the kernel's semantics, without a session."""

import re

import pytest

from spanweave.plans.engine import Engine, Sentence
from spanweave.plans.lang import RuleError, RuleSet

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\s]")


def run(rules, text, name, sets=None, **sentence):
    rules = RuleSet(rules, strict=True) if isinstance(rules, str) else rules
    e = Engine(rules)
    e.start_sentence(Sentence(TOKEN.findall(text), **sentence))
    return e.scan(name, 0, len(e.s.tokens))


def extents(*a, **k):
    return [m.extent for m in run(*a, **k)]


@pytest.mark.parametrize(
    "rule,text,want",
    [
        ("x -> a | a b | a b c", "a b c d", [(0, 3)]),
        ("x -> a | b | c", "a b c d", [(0, 1), (1, 2), (2, 3)]),
        ("n : /^[0-9]+$/\nx -> @START &n+ @END", "1 23 456", [(0, 3)]),
        ("n : /^[0-9]+$/\nx -> @START &n+ @END", "1 bc 456", []),
        ("n : /^[0-9]+$/\nx -> @START &n+ @END", "a 23", []),
        ("n : /^[0-9]+$/\nx -> @START &n+ @END", "23 def", []),
        ("i : {a}\nx i-> A b?", "a B a", [(0, 2), (2, 3)]),
        ("w : /\\w/\np : {(}\nq : {)}\nx -> &p &w* &q", "( a b ) ( ) (", [(0, 4), (4, 6)]),
        ("x : {a}i and not {A}", "a A b", [(0, 1)]),
        ("x : <ou>i or {b}", "OUT b c", [(0, 1), (1, 2)]),
    ],
)
def test_phrases_and_tests(rule, text, want):
    assert extents(rule, text, "x") == want


def test_submatches():
    found = run("t : {a}\nx -> &t", "a b a", "x")
    assert len(found) == 2 and all([k.name for k in m.kids] == ["t"] for m in found)
    (one,) = run("x -> &ANY+", "a b a", "x")
    assert len(one.kids) == 3


def test_precedence():
    assert extents("x : {a} or {b} and not {b}", "a b", "x") == [(0, 1)]


COORD = """
w : /^[a-z]+$/i
n : /^[0-9]+$/
eq : {=}
pair -> &w
all ~ _
"""


@pytest.mark.parametrize(
    "rule,text,want",
    [
        ("x ~ match(n, _)", "a 1 2", [(1, 2), (2, 3)]),
        ("x ~ filter(n, _)", "a 1 2", [(0, 3)]),
        ("x ~ filter(n, _, invert)", "a 1 2", []),
        ("x ~ filter(n, _, invert)", "a b", [(0, 2)]),
        ("x ~ prefix(eq, w)", "a = b", [(2, 3)]),
        ("x ~ suffix(eq, w)", "a = b", [(0, 1)]),
        ("x ~ prefix(eq, w, invert)", "a = b", [(0, 1)]),
        ("x ~ near(n, 1, w)", "a = 1 b 2", [(0, 1), (3, 4), (3, 4)]),
        ("x ~ precedes(n, 0, w)", "1 a b 2", [(1, 2)]),
        ("x ~ follows(n, 0, w)", "1 a b 2", [(2, 3)]),
        ("x ~ count(n, 2, _)", "1 a 2", [(0, 3)]),
        ("x ~ count(n, 3, _)", "1 a 2", []),
        ("x ~ count(n, 3, _, invert)", "1 a 2", [(0, 3)]),
        ("x ~ union(w, n)", "a 1", [(0, 1), (1, 2)]),
        ("x ~ inter(w, pair)", "a 1", [(0, 1)]),
        ("x ~ diff(w, pair)", "a 1", []),
        ("x ~ contains(_, n)", "a 1 2", [(0, 3), (0, 3)]),
        ("x ~ contained_by(n, _)", "a 1 2", [(1, 2), (2, 3)]),
        ("x ~ overlaps(_, n)", "a 1", [(0, 2)]),
        ("s -> &w &n\nx ~ select(n, s)", "a 1 b 2", [(1, 2), (3, 4)]),
        ("x ~ widen(near(n, 1, w))", "a = 1", [(0, 3)]),
    ],
)
def test_coordinators(rule, text, want):
    assert sorted(extents(COORD + rule, text, "x")) == want


def test_select_keeps_every_way_down():
    rules = "a : {1}\np -> &a\nx ~ select(p, p)\ny ~ select(a, x)"
    assert len(run(rules, "1", "y")) == 2


def test_bindings_outer_wins():
    rules = "a : {a}\nb : {b}\nc : {c}\nt : {t}\nx -> [t=a] &t\ny -> [t=b] @x"
    assert extents(rules, "a b c", "x") == [(0, 1)] and extents(rules, "a b c", "y") == [(1, 2)]
    with pytest.raises(RuleError):
        run("a : {a}\nx -> [a=b, b=a] &a", "a", "x")


def test_namespaces_and_errors():
    rules = RuleSet("ns <-\n  t : {b}\n  x -> &t\nt : {a}\nx -> &t\nz -> @ns.x")
    assert extents(rules, "a b", "x") == [(0, 1)] and extents(rules, "a b", "z") == [(1, 2)]
    loose = RuleSet("t : /(/\nnonsense here\nt : {a}\nt : {b}")
    assert len(loose.errors) == 3 and extents(loose, "a b", "t") == [(0, 1)]


def test_when_looks_back():
    e = Engine(RuleSet("a : {a}\nb : {b}\nx ~ when(a and not b, _)", strict=True))
    e.start_document()
    got = []
    for text in ("a", "c", "b c", "c"):
        e.start_sentence(Sentence(text.split()))
        got.append(len(e.scan("x", 0, len(e.s.tokens))))
        e.end_sentence(e.conditions())
    assert got == [0, 1, 1, 0]


DEPS = [(0, 1, "nsubj"), (1, -1, "root"), (3, 1, "dobj"), (2, 3, "det")]


@pytest.mark.parametrize(
    "rule,want",
    [
        ("x ^ /nsubj", {(0, 1)}),
        ("x ^ \\dobj", {(1, 3)}),
        ("x ^ nsubj", {(0, 1), (1, 0)}),
        ("x ^ /nsubj \\dobj", {(0, 3)}),
        ("x ^ /nsubj \\dobj? ", {(0, 1), (0, 3)}),
        ("s : /subj/\nx ^ &/s \\dobj \\det", {(0, 2)}),
        ("y ^ \\dobj\nx ^ /nsubj @y", {(0, 3)}),
    ],
)
def test_paths(rule, want):
    assert {(m.begin, m.end) for m in run(rule, "Rita bought an apple", "x", deps=DEPS)} == want


def test_connects_and_root():
    base = "r : {Rita}\na : {apple}\np ^ /nsubj \\dobj\n"
    (m,) = run(base + "x ~ connects(p, r, a)", "Rita bought an apple", "x", deps=DEPS)
    assert (m.begin, m.end, m.extent) == (0, 3, (0, 4))
    assert extents("x -> @ROOT", "Rita bought an apple", "x", deps=DEPS) == [(1, 2)]


FRAME = """
d : /^[0-9]+$/
comma : {,}
dot : {.}
cash : {$}
whole -> &d ( &comma &d )*
part -> &d
num -> &cash @whole ( &dot @part )?
f $ frame(num, whole=whole, decimal=part)
"""


def test_frames():
    (f,) = run(FRAME, "$12,345.67", "f")
    assert {k: [v.extent for v in vs] for k, vs in f.fields} == {"whole": [(1, 4)], "decimal": [(5, 6)]}
    assert RuleSet(FRAME).references("num") == ["cash", "whole", "dot", "part"]


def test_repeated_fields_and_reduce():
    rules = "d : /[0-9]/\np -> &d &d &d?\nf $ frame(p, a=d, b=d)\ng $ frame(d, self=d)\nu ~ union(f, g)\nr $ reduce(u)"
    (f,) = run(rules, "1 2", "f")
    assert [k for k, _ in f.fields] == ["a", "b"]
    reduced = run(rules, "1 2", "r")
    assert [m.extent for m in reduced] == [(0, 2)] and all(v.fields is not None for _, vs in reduced[0].fields for v in vs)


def test_layers_and_requirements():
    rules = "n : pos[NN NNS] and not ner[O]\nx -> &n+"
    layers = {"pos": ["NN", None, "NNS"], "ner": ["B-X", "O", None]}
    assert extents(rules, "a b c", "x", layers=layers) == [(0, 1), (2, 3)]
    assert RuleSet(rules).requirements("x") == {"pos", "ner"}
