"""Distances by blocks: all terms, all pairs, as the joins and the SQL have them."""

import math
import os
import random

import duckdb
import pytest

from spanweave import queries as Q
from spanweave.operators import distances as D


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in os.listdir(data):
        c.execute(f"create view {t.split('.')[0]} as select * from '{data}/{t}'")
    return c


def counts(seed: int, terms: int = 130, sources: int = 5) -> list[tuple]:
    """Many terms of one distribution, terms without a neighbour, a context that is null."""
    rng = random.Random(seed)
    rows = [(f"t{t:03d}", f"s{y}", rng.choice([1, 2, 4])) for t in range(terms) for y in range(sources) if rng.random() < 0.4]
    return [*rows, *[(f"one{k}", "s0", k + 1) for k in range(15)], ("alone", "s9", 3), ("t000", None, 2), ("none", None, 4)]


def brute(rows: list[tuple]) -> dict[str, list[tuple]]:
    total: dict = {}
    for x, _, n in rows:
        total[x] = total.get(x, 0) + n
    r: dict = {}
    for x, y, n in rows:
        if y is not None:
            r.setdefault(x, {})[y] = math.sqrt(n / total[x])
    out = {}
    for a in r:
        bc = {b: sum(v * r[b].get(y, 0) for y, v in r[a].items()) for b in r if b != a}
        out[a] = sorted((round(math.sqrt(max(0, 1 - s)), 7), b) for b, s in bc.items() if s > 0)
    return out


@pytest.mark.parametrize("block,part", [(4096, 1024), (16, 7)])
def test_by_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "SLICE", part)
    rows = counts(block)
    want = brute(rows)
    df = spark.createDataFrame(rows, "x string, y string, n long")
    for k in (1, 4):
        got = sorted((r.x1, r["rank"], r.d, r.x2) for r in D.nearest_terms(df, k).collect())
        assert got == sorted((a, i + 1, d, b) for a, best in want.items() for i, (d, b) in enumerate(best[:k]))
    got = sorted((r.x1, r.d, r.x2) for r in D.all_distances(df).collect())
    assert got == sorted((a, d, b) for a, best in want.items() for d, b in best)


def test_rare_terms_have_neighbours_too(spark, data):
    """The least frequent terms were left out."""
    rare = Q._xb(spark, data).groupBy("x").sum("n").where("`sum(n)` = 1").limit(1).first().x
    assert Q.QUERIES["closest_terms"](spark, data).where(f"x1 = '{rare}'").count() == 10


@pytest.mark.parametrize("name", ["hellinger_distance", "prune_associations", "divergence_lookup", "closest_by_minimum", "rank_terms_by_group", "entropy_by_term"])
def test_against_sql(spark, data, con, name):
    df = Q.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    r = con.execute(Q.ORACLES[name])
    names = [x[0] for x in r.description]
    assert got == sorted(tuple(str(x[names.index(c)]) for c in cols) for x in r.fetchall()) != []


def test_repeated_documents_count_as_in_the_join(spark, tmp_path):
    """A doc_id that comes again has all of its sources."""
    rows = [(1, "a b", "s"), (1, "a", "t"), (2, "a", None), (None, "a", "s"), (3, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.x, r.y): r.n for r in Q._xb(spark, str(tmp_path)).collect()}
    assert got == {("a", "s"): 2, ("a", "t"): 2, ("b", "s"): 1, ("b", "t"): 1, ("a", None): 1}
