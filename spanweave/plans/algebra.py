"""Operations on expressions: reversal, generation, tallies, functions for SQL."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Sentence
from .extract import test_column
from .lang import Node, RuleError, RuleSet


def reverse(n: Node) -> Node:
    """The expression of the reversed phrases."""
    args = tuple(reverse(a) for a in n.args)
    return Node(n.op, args[::-1] if n.op == "seq" else args, n.value)


def simplify(n: Node) -> Node:
    """Nested sequences and alternatives flat, equal alternatives once, common first and last parts in front and behind."""
    args = [simplify(a) for a in n.args]
    if n.op == "seq":
        flat = [b for a in args for b in (a.args if a.op == "seq" else (a,))]
        return flat[0] if len(flat) == 1 else Node("seq", tuple(flat))
    if n.op == "alt":
        flat = list(dict.fromkeys(b for a in args for b in (a.args if a.op == "alt" else (a,))))
        if len(flat) == 1:
            return flat[0]
        lists = [list(a.args) if a.op == "seq" else [a] for a in flat]
        head: list[Node] = []
        while all(len(x) > 1 for x in lists) and len({x[0] for x in lists}) == 1:
            head.append(lists[0][0])
            lists = [x[1:] for x in lists]
        tail: list[Node] = []
        while all(len(x) > 1 for x in lists) and len({x[-1] for x in lists}) == 1:
            tail.insert(0, lists[0][-1])
            lists = [x[:-1] for x in lists]
        inner = Node("alt", tuple(x[0] if len(x) == 1 else Node("seq", tuple(x)) for x in lists))
        return Node("seq", (*head, inner, *tail)) if head or tail else inner
    return Node(n.op, tuple(args), n.value)


def tally(sents: DataFrame, rules: RuleSet, names: list[str]) -> DataFrame:
    """(rule, tok, n): how often each token meets each test."""
    toks = sents.select(F.explode("tokens").alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))
    hits = F.filter(F.array(*[F.when(test_column(rules, n, F.col("tok")), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return toks.select(F.explode(hits).alias("rule"), "tok", "n")


def generate(rules: RuleSet, name: str, seeds: dict[str, dict[str, int]], rng: random.Random | None = None, limit: int = 50) -> list[str]:
    """A random phrase of a rule; tests give tokens by their tallies, membership tests their members without."""
    rng = rng or random.Random()

    def token(test: str, home: RuleSet) -> list[str]:
        if test in seeds and seeds[test]:
            words, weights = zip(*seeds[test].items())
            return rng.choices(words, weights)
        rule, _ = home.lookup(test)
        if rule.expr.op == "member":
            return [rng.choice(sorted(rule.expr.value[0]))]
        raise RuleError(f"no tokens to choose from for {test!r}")

    def of(n: Node, home: RuleSet) -> list[str]:
        if n.op == "lit":
            return [n.value[0]]
        if n.op in ("test", "call"):
            if n.value[0] in ("START", "END"):
                return []
            rule, there = home.lookup(n.value[0])
            return token(n.value[0], home) if rule.kind == "test" else of(rule.expr, there)
        if n.op == "trie":
            return list(rng.choice(sorted(n.value)))
        if n.op == "alt":
            return of(rng.choice(n.args), home)
        if n.op == "seq":
            return [t for a in n.args for t in of(a, home)]
        out = of(n.args[0], home) if n.op == "+" or rng.random() < 0.5 else []
        while n.op in "*+" and rng.random() < 0.5 and len(out) < limit:
            out += of(n.args[0], home)
        return out

    rule, home = rules.lookup(name)
    return of(rule.expr, home)


def register_sql(spark: SparkSession, rules: RuleSet | str, function: str = "rule_spans") -> None:
    """A table function for SQL: SELECT … FROM sentences, LATERAL rule_spans(tokens, 'rule')."""
    from pyspark.sql.functions import udtf

    rules = RuleSet(rules) if isinstance(rules, str) else rules

    class Spans:
        def __init__(self):
            self.engine = Engine(rules)

        def eval(self, tokens: list, name: str):
            self.engine.start_sentence(Sentence(list(tokens or [])))
            for m in self.engine.scan(name, 0, len(self.engine.s.tokens)):
                b, e = m.extent
                yield b, e, " ".join(self.engine.s.tokens[b:e]), json.dumps([k.name for k in m.children()])

    spark.udtf.register(function, udtf(Spans, returnType="begin int, end int, match string, parts string"))


def dependency_paths(sents: DataFrame, spans: DataFrame) -> DataFrame:
    """Label paths between the first and the last token of spans: (doc_id, sent_id, begin, end, path)."""

    @F.udf("array<string>")
    def paths(deps, b: int, e: int):
        s = Sentence([], None, [(d["child"], d["parent"], d["label"]) for d in deps or []])
        return [" ".join(p) for p in s.paths(b, e - 1)]

    j = spans.join(sents.select("doc_id", "sent_id", "deps"), ["doc_id", "sent_id"])
    return j.select("doc_id", "sent_id", "begin", "end", F.explode(paths("deps", "begin", "end")).alias("path"))
