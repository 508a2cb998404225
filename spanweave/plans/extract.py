"""Rules over DataFrames of sentences."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .engine import Engine, Sentence, Span
from .lang import Node, RuleError, RuleSet
from .regular import SIZE, Other, Path, Phrase, regular

PART = 10_000  # sentences that are worked on at once
SPANS = "doc_id {id}, sent_id int, rule string, begin int, end int, inclusive boolean, ext_b int, ext_e int, text string, subs array<struct<id int, parent int, name string, kind string, begin int, end int>>, fields string"


def flatten(m: Span) -> list[dict]:
    """A match's tree in pre-order with the numbers of parents."""
    out: list[dict] = []

    def walk(x: Span, parent: int) -> None:
        me = len(out)
        b, e = x.extent
        out.append({"id": me, "parent": parent, "name": x.name, "kind": x.kind, "begin": b, "end": e})
        for k in x.children():
            walk(k, me)

    for k in m.children():
        walk(k, -1)
    return out


def frame_record(f: Span, tokens: list[str], offsets: list[int] | None = None) -> dict:
    """A frame as a record: one value as it is, several as a list, frames inside as records of their own."""

    def value(v: Span):
        if v.fields is not None:
            return frame_record(v, tokens, offsets)
        b, e = v.extent
        if offsets is None:
            return " ".join(tokens[b:e])
        return {"text": " ".join(tokens[b:e]), "start": offsets[b] if b < len(offsets) else None, "end": offsets[e - 1] + len(tokens[e - 1]) if e else None}

    out: dict = {"_type": f.name}
    for k, vs in f.fields or []:
        got = [value(v) for v in vs]
        out[k] = got[0] if len(got) == 1 else got
    return out


def literals(rules: RuleSet, name: str, depth: int = 0) -> set[str] | None:
    """Tokens of which any sentence with a match must have one; None if there is no such set."""
    if depth > 20:
        return None
    try:
        rule, home = rules.lookup(name)
    except RuleError:
        return None
    if rule.bindings or rule.fold:
        return None

    def of(n: Node) -> set[str] | None:
        if n.op == "member" and not n.value[1] and not n.value[2]:
            return set(n.value[0])
        if n.op == "lit":
            return {n.value[0]}
        if n.op in ("or", "alt", "union"):
            parts = [of(a) for a in n.args]
            return None if any(p is None for p in parts) else set().union(*parts)
        if n.op in ("and", "seq", "inter", "overlaps", "contains", "contained_by"):
            parts = [p for p in map(of, n.args) if p is not None]
            return min(parts, key=len) if parts else None
        if n.op in ("+", "diff"):
            return of(n.args[0])
        if n.op in ("ref", "test", "call"):
            return literals(home, n.value if isinstance(n.value, str) else n.value[0], depth + 1)
        if n.op in ("match", "select"):
            return literals(home, n.value, depth + 1) or of(n.args[0])
        if n.op in ("filter", "prefix", "suffix", "near", "precedes", "follows", "count"):
            return of(n.args[0]) or (None if n.value[2] or (n.op == "count" and n.value[1] < 1) else literals(home, n.value[0], depth + 1))
        if n.op == "frame":
            return literals(home, n.value[0], depth + 1)
        return None

    return of(rule.expr) if rule.kind != "parse" else None


def anchor(rules: RuleSet, name: str, depth: int = 0) -> Phrase | None:
    """A regular phrase that any sentence with a match must have too, if there is one."""
    try:
        rule, home = rules.lookup(name)
    except RuleError:
        return None
    if depth > 20 or rule.bindings:
        return None
    if rule.kind == "phrase":
        got = regular(rules, name)
        return got if isinstance(got, Phrase) else None

    def of(n: Node) -> Phrase | None:
        if n.op == "match":
            return anchor(home, n.value, depth + 1) or of(n.args[0])
        if n.op in ("select", "filter", "prefix", "suffix", "near", "precedes", "follows", "count", "diff", "widen", "merge"):
            return of(n.args[0])
        if n.op == "frame":
            return anchor(home, n.value[0], depth + 1)
        return None

    return of(rule.expr) if rule.kind in ("coord", "frame") else None


def extract(sents: DataFrame, rules: RuleSet | str, names: list[str], id_type: str = "bigint", offsets: bool = False, prune: bool = True) -> DataFrame:
    """All matches of the named rules: one row each, with the match tree flattened and frames as JSON.

    `sents` has doc_id, sent_id, tokens and, where rules need them, ann (map of arrays of arrays) and deps.  All
    rules run in one pass over the sentences, without a shuffle; sentences that lack every token that a match
    would need never reach Python, and those without a regular phrase that a match would need never reach the
    evaluator.  Rules with `when` need the sentences of a document in order: then, and only
    then, sentences are grouped by document.  Every sentence counts for `when`, and each document begins anew.
    """
    rules = RuleSet(rules) if isinstance(rules, str) else rules
    for n in names:
        rules.lookup(n)
    have = sents.columns
    cols = ["doc_id", "sent_id", "tokens", *[c for c in ("ann", "deps") if c in have]]
    view = sents.select(*cols)
    asked = Engine(rules).conditions()
    schema = SPANS.format(id=id_type)
    if prune and not asked:
        need = [literals(rules, n) for n in names]
        if all(x is not None for x in need):
            every = sorted(set().union(*need))
            view = view.where(F.arrays_overlap("tokens", F.array(*[F.lit(x) for x in every]))) if every else view.limit(0)

    need_phrases = prune and not asked and all(anchor(rules, n) is not None for n in names)

    def rows(engine: Engine, r: dict, out: dict, viable: dict | None = None) -> None:
        s = Sentence(r["tokens"] or [], dict(r["ann"]) if r.get("ann") else None, [(d["child"], d["parent"], d["label"]) for d in r.get("deps") or []])
        engine.start_sentence(s)
        engine.viable = viable or {}
        at = None
        if offsets:
            at, n = [], 0
            for t in s.tokens:
                at.append(n)
                n += len(t) + 1
        for name in names:
            for m in engine.scan(name, 0, len(s.tokens)):
                b, e = m.extent
                f = m.frame()
                for k, v in zip(out, (r["doc_id"], r["sent_id"], name, m.begin, m.end, m.inclusive, b, e, " ".join(s.tokens[b:e]), flatten(m), json.dumps(frame_record(f, s.tokens, at), ensure_ascii=False) if f is not None else None)):
                    out[k].append(v)
        engine.end_sentence(asked)

    def empty(schema_: pa.Schema) -> dict:
        return {n: [] for n in schema_.names}

    arrow = pa.schema(
        [
            ("doc_id", pa.string() if id_type == "string" else pa.int64()),
            ("sent_id", pa.int32()),
            ("rule", pa.string()),
            ("begin", pa.int32()),
            ("end", pa.int32()),
            ("inclusive", pa.bool_()),
            ("ext_b", pa.int32()),
            ("ext_e", pa.int32()),
            ("text", pa.string()),
            ("subs", pa.list_(pa.struct([("id", pa.int32()), ("parent", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))),
            ("fields", pa.string()),
        ]
    )

    if asked:

        def by_doc(t: pa.Table) -> pa.Table:
            engine, out = Engine(rules), empty(arrow)
            engine.start_document()
            for r in sorted(t.to_pylist(), key=lambda r: r["sent_id"]):
                rows(engine, r, out)
            return pa.table(out, schema=arrow)

        return view.groupBy("doc_id").applyInArrow(by_doc, schema)

    def chosen(batch: pa.RecordBatch, phrases: list[Phrase]) -> tuple[pa.RecordBatch, list[dict]]:
        """The sentences with one of the phrases, and where in them each can begin."""
        found = []
        for p in phrases:
            bounds, size = p.longest(batch)
            at = np.flatnonzero(size)
            row = np.searchsorted(bounds, at, "right") - 1
            found.append((p.key, row, at - bounds[row]))
        kept = np.unique(np.concatenate([row for _, row, _ in found]))
        viable = [{} for _ in kept]
        for key, row, at in found:
            for v in viable:
                v[key] = set()
            for k, i in zip(np.searchsorted(kept, row).tolist(), at.tolist()):
                viable[k][key].add(i)
        return batch.take(pa.array(kept)), viable

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine(rules)
        phrases = list({p.key: p for p in (anchor(rules, n) for n in names)}.values()) if need_phrases else []
        for whole in it:
            for a in range(0, whole.num_rows, PART):
                batch, viable = whole.slice(a, PART), None
                if phrases:
                    try:
                        batch, viable = chosen(batch, phrases)
                    except Other:
                        pass
                for b in range(0, batch.num_rows, 2000):
                    out = empty(arrow)
                    for k, r in enumerate(batch.slice(b, 2000).to_pylist()):
                        rows(engine, r, out, viable and viable[b + k])
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return view.mapInArrow(run, schema)


def extents(sents: DataFrame, rules: RuleSet | str, name: str) -> DataFrame:
    """Where a rule matches: (doc_id, sent_id, begin, end, ext_b, ext_e), as `extract` has them, without trees.

    A regular rule runs over whole Arrow batches and asks only for what it looks at; batches with edges that lead
    beyond a sentence, and other rules, go to the evaluator.
    """
    rules = RuleSet(rules) if isinstance(rules, str) else rules
    rules.lookup(name)
    out = ["doc_id", "sent_id", "begin", "end", "ext_b", "ext_e"]
    rule = regular(rules, name)
    if rule is None or (isinstance(rule, Path) and "deps" not in sents.columns):
        return extract(sents, rules, [name]).select(*out)
    kind = sents.schema["doc_id"].dataType.simpleString()
    need = literals(rules, name)
    if need is not None:
        sents = sents.where(F.arrays_overlap("tokens", F.array(*[F.lit(x) for x in sorted(need)]))) if need else sents.limit(0)
    have = sents.columns
    columns = rule.columns(have, "ann" in have and sents.schema["ann"].dataType.valueType.elementType.typeName() == "array")

    def slowly(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        engine, found = Engine(rules), []
        for i, r in enumerate(batch.to_pylist()):  # paths don't look at tokens
            engine.start_sentence(Sentence([""] * (r[SIZE] or 0), None, [(d["child"], d["parent"], d["label"]) for d in r.get("deps") or []]))
            found += [(i, m.begin, m.end) for m in engine.scan(name, 0, len(engine.s.tokens))]
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = regular(rules, name)
        for whole in it:
            for a in range(0, whole.num_rows, PART):
                batch = whole.slice(a, PART)
                try:
                    row, b, e = rule.spans(batch)
                except Other:
                    row, b, e = slowly(batch)
                lo, hi = (np.minimum(b, e), np.maximum(b, e) + 1) if rule.inclusive else (b, e)
                at = pa.array(row)
                ids = [batch.column(c).take(at) for c in ("doc_id", "sent_id")]
                yield pa.RecordBatch.from_arrays([*ids, *[pa.array(x.astype(np.int32)) for x in (b, e, lo, hi)]], names=out)

    view = sents.select("doc_id", "sent_id", *[c.alias(n) for n, c in columns.items()])
    return view.mapInArrow(run, f"doc_id {kind}, sent_id int, begin int, end int, ext_b int, ext_e int")


def test_column(rules: RuleSet, name: str, tok: Column, env: tuple = ()) -> Column:
    """A token test as a Column over a token, for tests that need no annotations."""
    engine = Engine(rules)

    def of(n: Node, home: RuleSet, env) -> Column:
        if n.op == "or":
            parts = [of(a, home, env) for a in n.args]
            out = parts[0]
            for p in parts[1:]:
                out = out | p
            return out
        if n.op == "and":
            parts = [of(a, home, env) for a in n.args]
            out = parts[0]
            for p in parts[1:]:
                out = out & p
            return out
        if n.op == "not":
            return ~of(n.args[0], home, env)
        if n.op == "regex":
            return tok.rlike(("(?iu)" if n.value[1] else "(?U)") + n.value[0].replace("(?P<", "(?<").replace("\\Z", "\\z"))
        if n.op == "member" and not n.value[2]:
            return (F.lower(tok) if n.value[1] else tok).isin(sorted(n.value[0]))
        if n.op == "substring":
            return F.contains(F.lower(tok) if n.value[1] else tok, F.lit(n.value[0]))
        if n.op == "radius":
            anchors, radius, every = n.value
            sets = [sorted({a, *rules.radius.get((a, radius), ())}) for a in anchors]
            parts = [tok.isin(s) for s in sets]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if every else (out | p)
            return out
        if n.op == "ref":
            got, rule, there, below = engine.rule(n.value, env, home)
            if rule is None:
                return F.lit(True)
            return of(rule.expr, there, below)
        raise RuleError(f"{n.op} needs annotations")

    got, rule, home, below = engine.rule(name, env, rules)
    return F.coalesce(F.lit(True) if rule is None else of(rule.expr, home, below), F.lit(False))


def token_spans(sents: DataFrame, rules: RuleSet, name: str) -> DataFrame:
    """Matches of a token test as spans (doc_id, sent_id, begin, end, tok), inside the JVM."""
    toks = sents.select("doc_id", "sent_id", F.posexplode("tokens").alias("begin", "tok"))
    return toks.where(test_column(rules, name, F.col("tok"))).withColumn("end", F.col("begin") + 1)
