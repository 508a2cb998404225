"""Regular rules over whole batches give what the evaluator gives sentence by sentence, without it."""

import random

import pyarrow as pa
import pytest

from spanweave import queries as Q
from spanweave import queries_files as QF
from spanweave.plans.engine import Engine, Sentence
from spanweave.plans.extract import anchor, extents, extract
from spanweave.plans.lang import RuleSet
from spanweave.plans.regular import Other, regular

RULES = """
a : {a}
u : /^[A-Z]$/
ab : &a or {b}i
n : pos[N X] and not {c}
q : /^p/
run -> &a+
fix -> a ( b | B &u )* c?
many -> ( &a | &ab &ab | &u )+ c
ends -> &ab* &u @END
begins -> @START &ab &ab?
fold i-> a b | B c d
calls -> @run b | @fix &u
tagged -> &n+ c?
any -> &ANY c
two -> ( a? b? )+ c
up ^ /p
loop ^ ( \\p | /r )+ s
test ^ &\\q r*
both ^ p q? | @up r
"""
DEPS = pa.list_(pa.struct([("child", pa.int32()), ("parent", pa.int32()), ("label", pa.string())]))
ANN = pa.map_(pa.string(), pa.list_(pa.list_(pa.string())))


def sentences(seed: int, n: int = 300) -> pa.RecordBatch:
    rng, rows = random.Random(seed), []
    for _ in range(n):
        size = rng.choice([0, 1, 2, 5, 9, 15])
        layer = [rng.choice([None, [], ["N"], ["X", None], ["V"]]) for _ in range(max(0, size - rng.choice([0, 0, 2])))]
        deps = [(rng.randrange(size), rng.randrange(-1, size), rng.choice("pqrs")) for _ in range(size + 2)] if size else None
        rows.append(([rng.choice("aabBcdUV") for _ in range(size)] if size or rng.random() < 0.5 else None, rng.choice([None, [], [("pos", layer)], [("x", layer), ("pos", layer[:1])]]), deps))
    rows.append((["a"] * 700 + ["c"], None, None))
    cols = list(zip(*rows))
    fields = {"tokens": pa.list_(pa.string()), "ann": ANN, "deps": DEPS}
    deps = [None if x is None else [dict(zip(("child", "parent", "label"), e)) for e in x] for x in cols[2]]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], fields["tokens"]), pa.array(cols[1], ANN), pa.array(deps, DEPS)], names=list(fields))


def by_kernel(rules: RuleSet, batch: pa.RecordBatch, name: str) -> list[tuple]:
    engine, out = Engine(rules), []
    for i, r in enumerate(batch.to_pylist()):
        engine.start_sentence(Sentence(r["tokens"] or [], dict(r["ann"]) if r["ann"] else None, [(d["child"], d["parent"], d["label"]) for d in r["deps"] or []]))
        out += [(i, m.begin, m.end) for m in engine.scan(name, 0, len(engine.s.tokens))]
    return out


@pytest.mark.parametrize("name", "run fix many ends begins fold calls tagged any two up loop test both".split())
def test_as_the_kernel(monkeypatch, name):
    rules = RuleSet(RULES, strict=True)
    want = [by_kernel(rules, sentences(seed), name) for seed in range(4)]
    monkeypatch.setattr(Engine, "scan", None)
    rule = regular(rules, name)
    for seed in range(4):
        whole = sentences(seed)
        parts = [whole.slice(0, 120), whole.slice(120)]
        got = [(i + k * 120, b, e) for k, p in enumerate(parts) for i, b, e in zip(*[x.tolist() for x in rule.spans(p)])]
        assert got == want[seed] and got


def test_what_stays_with_the_kernel():
    rules = RuleSet("a : {a}\ne -> b?\nx -> @e a\ny ~ near(a, 1, x)\nz : &a\nr -> @ROOT a", strict=True)
    assert [regular(rules, n) for n in ("x", "y", "z", "r")] == [None] * 4
    odd = pa.RecordBatch.from_arrays([pa.array([["a"]], pa.list_(pa.string())), pa.array([[{"child": 0, "parent": 4, "label": "p"}]], DEPS)], names=["tokens", "deps"])
    with pytest.raises(Other):
        regular(RuleSet(RULES, strict=True), "up").spans(odd)


def test_queries_have_regular_rules():
    assert all(regular(Q.RULES, n) for n in ("caps", "pair", "three", "optional", "longest", "marks", "begins", "closes"))
    assert all(regular(QF.LAYERS, n) for n in [*QF._PATHS, "titled", "ns.x"])
    assert anchor(Q.RULES, "sequel").name == "pair" and anchor(Q.RULES, "f").name == "three"


def test_over_frames(spark, data):
    """Extents, and trees of rules over a phrase, as without any pruning."""
    sents = Q._sents(spark, data).cache()
    for name in ("longest", "closes"):
        want = extract(sents, Q.RULES, [name], prune=False).select("doc_id", "sent_id", "begin", "end", "ext_b", "ext_e")
        assert sorted(extents(sents, Q.RULES, name).collect()) == sorted(want.collect()) != []
    want = extract(sents, Q.RULES, ["sequel", "f"], prune=False).drop("subs")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(extract(sents, Q.RULES, ["sequel", "f"]).drop("subs").collect(), key=key) == sorted(want.collect(), key=key) != []
    sents.unpersist()
