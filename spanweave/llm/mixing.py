"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import cut, fresh

BUDGET_SHARE, EPOCHS, TEMPERATURE, PLAN_ROWS, SEED = 0.8, 4, 0.7, 50_000, 17


class Flow:
    """Min-cost flow by successive shortest paths with potentials; integer capacities and costs from 0 up."""

    def __init__(self) -> None:
        self.out: dict = defaultdict(list)
        self.edges: list[list] = []

    def add(self, a, b, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, source, sink) -> int:
        potential, sent = defaultdict(int), 0
        while True:
            dist, via, heap, n = {source: 0}, {}, [(0, 0, source)], 0
            while heap:
                d, _, a = heapq.heappop(heap)
                if d > dist[a]:
                    continue
                for e in self.out[a]:
                    b, capacity, cost = self.edges[e]
                    if capacity > 0 and (step := d + cost + potential[a] - potential[b]) < dist.get(b, 1 << 62):
                        dist[b], via[b] = step, e
                        n += 1
                        heapq.heappush(heap, (step, n, b))
            if sink not in dist:
                return sent
            far = max(dist.values())
            for a in self.out:
                potential[a] += dist.get(a, far)
            push, a = 1 << 62, sink
            while a != source:
                push, a = min(push, self.edges[via[a]][1]), self.edges[via[a] ^ 1][0]
            a = sink
            while a != source:
                self.edges[via[a]][1] -= push
                self.edges[via[a] ^ 1][1] += push
                a = self.edges[via[a] ^ 1][0]
            sent += push


def route(patterns: list[tuple[tuple[str, ...], int]], quotas: dict[str, int], epochs: int) -> dict[tuple[int, str], int]:
    """Tokens that each pattern (its sources, its tokens) gives to each source: as much of the quotas as the
    tokens, repeated up to `epochs` times, can fill, with the least sum of repetition costs (the k-th pass over
    a pattern's tokens costs k² a token, k from 0).
    """
    flow, links = Flow(), {}
    for i, (sources, tokens) in enumerate(patterns):
        for k in range(epochs):
            flow.add("from", ("p", i), tokens, k * k)
        for s in sources:
            if s in quotas:
                links[i, s] = flow.add(("p", i), ("s", s), tokens * epochs, 0)
    for s, quota in quotas.items():
        flow.add(("s", s), "to", quota, 0)
    flow.run("from", "to")
    return {k: flow.edges[e ^ 1][1] for k, e in links.items() if flow.edges[e ^ 1][1]}


def target_quotas(tokens: dict[str, int], budget: int, weights: dict[str, float] | None, temperature: float) -> dict[str, int]:
    """Each source's share of the budget: by `weights`, or by its own tokens to the power of `temperature`."""
    raw = {s: (weights or {}).get(s, 0.0) if weights else n**temperature for s, n in tokens.items()}
    whole = sum(raw.values())
    return {s: int(budget * x / whole) for s, x in sorted(raw.items()) if x > 0 and whole > 0}


def token_number(text: Column) -> Column:
    """Words, runs of signs above the space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x00-\\x20]+"), lambda x: x != "")), F.lit(0)).cast("long")


def memberships(docs: DataFrame) -> Column:
    """The sources of a document: the one that it comes from and its language; nulls under a name of their own."""
    have = {c.lower() for c in docs.columns}
    named = lambda kind, c: F.concat(F.lit(kind + ":"), F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit(""))
    return F.array(named("source", "source"), named("lang", "lang"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, share: float = BUDGET_SHARE, epochs: int = EPOCHS, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """`docs` as the mixture takes them: all columns, with `mix_copy` (0 for the first time a document is taken)
    and `mix_source` (the quota that it counts for), under other names if there are such columns already.

    A document belongs to several sources at once: the one that it comes from ("source:…") and its language
    ("lang:…").  Documents are summed by membership pattern; a min-cost flow routes each pattern's tokens, that
    may be repeated up to `epochs` times at a convex cost, to the quotas of the sources.  The quotas divide half
    of the budget (`share` of all tokens) among the sources and half among the languages, by `weights` or by
    tokens to the power of `temperature`.  A pattern's documents stand in the order of a seeded hash; its flow
    takes them from the beginning, as many times around as it needs, one source's part after the other.  A
    document counts for the source in whose part it begins.

    Nothing but sums by pattern and by up to 4096 ranges of the hash leaves the executors; the only documents that are
    ordered are those of the ranges in which a part ends.

    Nulls: a null source or language is a source of its own; documents without text have no tokens and are taken
    when the document before them is.  A null doc_id hashes like others.  Documents of equal hash are ordered by
    doc_id, text, source and lang; repeated rows are separate, equal documents.  An empty table gives an empty result.
    """
    copy, source = fresh(docs, "mix_copy"), fresh(docs, "mix_source")
    tok, pat, pos, bucket = (fresh(docs, x) for x in ("_tokens", "_pattern", "_hash", "_range"))
    have = {c.lower() for c in docs.columns}
    base = docs.withColumn(pat, memberships(docs)).withColumn(tok, token_number(F.col("text")))
    base = base.withColumn(pos, F.xxhash64(F.col("doc_id"), F.lit(seed))).withColumn(bucket, F.shiftright(pos, 52) + 2048)
    ranges = cut(base.groupBy(pat, bucket).agg(F.sum(tok).alias("t")))
    # wider ranges where there are many patterns, so that the plan stays small enough for every executor
    shift = max(0, (-(-ranges.count() // PLAN_ROWS) - 1).bit_length())
    if shift:
        base = base.withColumn(bucket, F.shiftright(bucket, shift))
        ranges = cut(ranges.groupBy(pat, F.shiftright(bucket, shift).alias(bucket)).agg(F.sum("t").alias("t")))
    totals = sorted((tuple(r[0]), r[1]) for r in ranges.groupBy(pat).agg(F.sum("t")).collect())
    if not totals:
        return docs.withColumn(copy, F.lit(0)).withColumn(source, F.lit("")).limit(0)
    by_source: dict[str, int] = defaultdict(int)
    for names, n in totals:
        for s in names:
            by_source[s] += n
    budget = int(sum(n for _, n in totals) * share)
    quotas: dict[str, int] = {}
    for kind in ("source:", "lang:"):
        quotas |= target_quotas({s: n for s, n in by_source.items() if s.startswith(kind)}, budget // 2, weights, temperature)
    given = route(totals, quotas, epochs)
    # a pattern's parts along the line of its tokens: [begin, end) for each source
    parts = []
    for i, (names, n) in enumerate(totals):
        at = 0
        for s in names:
            if f := given.get((i, s), 0):
                parts.append((list(names), n, s, at, at + f))
                at += f
    if not parts:
        return docs.withColumn(copy, F.lit(0)).withColumn(source, F.lit("")).limit(0)
    spark = docs.sparkSession
    line = spark.createDataFrame(parts, f"`{pat}` array<string>, n long, s string, b long, e long")
    line = line.withColumn("k", F.explode(F.sequence(F.expr("b div greatest(n, 1)"), F.expr("(e - 1) div greatest(n, 1)"))))
    line = line.select(pat, F.col("k").cast("int").alias("k"), "s", F.greatest(F.expr("b - k * n"), F.lit(0)).alias("b"), F.least(F.expr("e - k * n"), F.col("n")).alias("e"))
    before = F.sum("t").over(Window.partitionBy(pat).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select(pat, bucket, F.coalesce(before, F.lit(0)).alias("lo"), "t")
    met = starts.join(F.broadcast(line), pat).where("(lo < e and lo + t > b) or (lo >= b and lo < e)")
    whole = (F.col("lo") >= F.col("b")) & (F.col("lo") + F.col("t") <= F.col("e"))
    plan = met.groupBy(pat, bucket).agg(F.collect_list(F.struct("k", "s", "b", "e")).alias("_parts"), F.min(whole).alias("_whole"), F.first("lo").alias("_lo"))
    plan = cut(plan)
    tagged = base.join(F.broadcast(plan), [pat, bucket])  # at most PLAN_ROWS rows, or one for each pattern
    full = tagged.where("_whole").withColumn("_begin", F.col("_lo"))
    tie = [F.col(pos), F.col("doc_id"), *[F.col(c) for c in ("text", "source", "lang") if c in have]]
    order = Window.partitionBy(pat, bucket).orderBy(*tie)
    part = tagged.where("not _whole").withColumn("_begin", F.col("_lo") + F.coalesce(F.sum(tok).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = full.unionByName(part).withColumn("_p", F.explode("_parts"))
    taken = both.where("_whole or (_begin >= _p.b and _begin < _p.e)")
    return taken.select(*[F.col(c) for c in docs.columns], F.col("_p.k").alias(copy), F.col("_p.s").alias(source))
