"""Mixing and nearest neighbours against brute force."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm.mixing import memberships, mix, route, token_number
from spanweave.llm.vantage import neighbours


def test_route_is_optimal():
    """Small cases against all integer routings."""
    patterns = [(("a", "b"), 3), (("b",), 2), (("a",), 1)]
    quotas = {"a": 5, "b": 6}
    got = route(patterns, quotas, 3)
    cost = lambda used, n: sum((k // n) ** 2 for k in range(used))
    best = None
    links = [(i, s) for i, (names, _) in enumerate(patterns) for s in names]
    for flow in itertools.product(range(8), repeat=len(links)):
        used, filled = Counter(), Counter()
        for (i, s), f in zip(links, flow):
            used[i] += f
            filled[s] += f
        if any(used[i] > 3 * patterns[i][1] for i in used) or any(filled[s] > quotas[s] for s in filled):
            continue
        key = (-sum(filled.values()), sum(cost(used[i], patterns[i][1]) for i in used))
        best = min(best, key) if best else key
    used = Counter()
    for (i, _), f in got.items():
        used[i] += f
    assert (-sum(got.values()), sum(cost(used[i], patterns[i][1]) for i in used)) == best


def by_force(docs, **options):
    """The documented rule, row by row: each pattern's tokens in a line, its parts cut off in order."""
    from spanweave.llm import mixing as M

    rows = docs.select("*", memberships(docs).alias("pat"), token_number(F.col("text")).alias("t"), F.xxhash64("doc_id", F.lit(M.SEED)).alias("h")).collect()
    by = defaultdict(list)
    for r in rows:
        by[tuple(r.pat)].append(r)
    totals = sorted((p, sum(r.t for r in v)) for p, v in by.items())
    source = Counter()
    for p, n in totals:
        for s in p:
            source[s] += n
    budget = int(sum(n for _, n in totals) * options.get("share", M.BUDGET_SHARE))
    quotas = {}
    for kind in ("source:", "lang:"):
        quotas |= M.target_quotas({s: n for s, n in source.items() if s.startswith(kind)}, budget // 2, options.get("weights"), M.TEMPERATURE)
    given = M.route(totals, quotas, options.get("epochs", M.EPOCHS))
    out = Counter()
    for i, (p, n) in enumerate(totals):
        order = sorted(by[p], key=lambda r: (r.h, r.doc_id if r.doc_id is not None else -1, r.text or ""))
        begin = np.cumsum([0, *[r.t for r in order]])[:-1]
        at = 0
        for s in p:
            f = given.get((i, s), 0)
            for k in range(0 if not f else (at + f - 1) // n + 1):
                for r, b in zip(order, begin):
                    if at <= k * n + b < at + f:
                        out[r.doc_id, k, s] += 1
            at += f
    return out


@pytest.mark.parametrize("options", [{}, {"share": 2.5}, {"weights": {"source:src0": 3.0, "source:src1": 1.0, "lang:en": 1.0}}])
def test_mix(documents, options):
    got = Counter((r.doc_id, r.mix_copy, r.mix_source) for r in mix(documents, **options).select("doc_id", "mix_copy", "mix_source").collect())
    assert got == by_force(documents, **options) and got


def test_mix_odd(odd, none):
    got = mix(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and got.columns[-2:] == ["mix_copy_1", "mix_source"]
    assert got.count() > 0 and mix(none).count() == 0 and mix(odd.where("text is null")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, shard int, rank int")


def test_exact_neighbours(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    p = e.toPandas()
    x = np.array(p.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    ids = p.vec_id.to_numpy()
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.lexsort((ids, d[i]))[:10]}
    got = {(r.vec_id, r.neighbor_id) for r in neighbours(e, factor=1.0, per_shard=150).collect()}
    assert len(got ^ want) <= 0.002 * len(want)  # equal but for ties within rounding
    near = {(r.vec_id, r.neighbor_id) for r in neighbours(e, per_shard=150).collect()}
    assert len(near & want) >= 0.9 * len(want)


def test_queries_against_sql(spark):
    """The registered query finds what its SQL finds; the region tree and hot regions lose nothing at factor 1."""
    import duckdb

    from spanweave.llm.queries import ORACLES, op5_nearest_neighbours

    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    want = sorted(con.execute(ORACLES["op5_nearest_neighbours"]).fetchall())
    assert sorted(tuple(r) for r in op5_nearest_neighbours(spark, path).collect()) == want and want
    e = spark.read.parquet(f"{path}/embeddings.parquet")
    assert sorted(tuple(r) for r in neighbours(e, factor=1.0, per_shard=40, every=50).collect()) == want


def test_hot_vector_and_names(spark):
    """A third of all rows are one vector; ids may be strings."""
    rng = np.random.default_rng(2)
    x = np.where(np.arange(600)[:, None] % 3 == 0, np.ones(8), rng.normal(size=(600, 8)))
    df = vectors(spark, [(i, v.tolist(), 0, 1, 2) for i, v in enumerate(x)])
    got = neighbours(df, k=3, factor=1.0, per_shard=50).collect()
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(np.sqrt(np.maximum(((y[:, None] - y[None]) ** 2).sum(-1), 0)), 6)
    np.fill_diagonal(d, np.inf)
    want = {(i, j) for i in range(600) for j in np.lexsort((np.arange(600), d[i]))[:3].tolist()}
    assert {(r.vec_id, r.neighbor_id) for r in got} == want
    names = df.selectExpr("format_string('v%03d', vec_id) as vec_id", "embedding")
    assert {(r.vec_id, r.neighbor_id) for r in neighbours(names, k=3, factor=1.0, per_shard=50).collect()} == {(f"v{i:03d}", f"v{j:03d}") for i, j in want}


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (None, [1.0, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, [None, 1.0])]
    df = vectors(spark, [(i, v, 0, 1, 2) for i, v in rows])
    got = {(r.vec_id, r.neighbor_id, r["rank"]) for r in neighbours(df, k=2, factor=1.0).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)}
    assert neighbours(df.limit(0)).count() == 0 and neighbours(df.where("vec_id = 1")).count() == 0
