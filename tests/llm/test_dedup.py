"""Exact, near and passage dedup against brute force."""

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from spanweave.llm._session import keep_one
from spanweave.llm.bwt_merge import merge, repeated_intervals, shard_transform
from spanweave.llm.exact_dedup import EXACT_SQL, PerfectHash, exact_dedup, exact_losers
from spanweave.llm.lempel_ziv import shared_factors
from spanweave.llm.near_dedup import COORDINATES, components, near_groups, near_losers, sketch
from spanweave.llm.passages import SPANS_SQL, WINDOW


def pairs(df):
    return {tuple(r) for r in df.collect()}


def words(text):
    return [w for w in re.split("[\x00-\x20]+", text) if w]


def groups_by_force(rows, threshold=0.5, k=3):
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t or "")]
        if i is not None and w:
            sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            same = len(sets[a] & sets[b])
            if same >= threshold * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, find(i)) for i in ids if find(i) != i}


def spans_by_force(rows):
    where = defaultdict(set)
    texts = {i: words(t) for i, t in rows if i is not None and t is not None}
    for i, w in texts.items():
        for s in range(len(w) - WINDOW + 1):
            where[tuple(w[s : s + WINDOW])].add(i)
    out = set()
    for i, w in texts.items():
        span = None
        for s in range(len(w) - WINDOW + 1):
            if len(where[tuple(w[s : s + WINDOW])]) > 1:
                if span and s <= span[1]:
                    span = (span[0], s + WINDOW)
                else:
                    out |= {(i, *span)} if span else set()
                    span = (s, s + WINDOW)
        out |= {(i, *span)} if span else set()
    return out


def test_perfect_hash_is_minimal_and_rejects():
    rng = np.random.default_rng(1)
    d = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    h = PerfectHash(d)
    assert sorted(h.slots) == list(range(5000)) and (h.slot(d) == h.slots).all()
    other = rng.integers(0, 256, (500, 32), dtype=np.uint8)
    at = h.slot(other)
    held = np.empty_like(d)
    held[h.slots] = d
    assert not any(a >= 0 and (held[a] == o).all() for a, o in zip(at, other))


def test_exact(spark, data, documents):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    assert pairs(exact_dedup(documents, per_bucket=20)) == set(con.execute(EXACT_SQL).fetchall())


def test_exact_odd(odd, none):
    assert pairs(exact_dedup(odd)) == {(2, 1), (6, 5), (9, 8)}
    assert pairs(exact_dedup(none)) == set()
    assert pairs(exact_dedup(odd, history=none)) == {(2, 1), (6, 5), (9, 8)}
    assert pairs(exact_dedup(none, history=odd)) == set()


def test_exact_against_history(spark, odd):
    history = spark.createDataFrame([(100, "x"), (90, "x"), (None, "y")], "doc_id long, text string")
    assert pairs(exact_dedup(odd, history)) == {(2, 1), (6, 5), (8, 90), (9, 90)}


def test_keep_one(odd):
    kept = keep_one(odd, exact_losers(odd))
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids == [1, 3, 4, 5, 7, 8, 10, 11, 12, 13]


SEVERAL = [("1", "a b c d"), ("2", "a b c d"), ("2", "quite another text here"), ("2", "quite another text here"), ("3", "a b c d e"), (None, "a b c d"), ("4", None)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_several_texts_of_one_id(spark, kind):
    """Only the copied text of a doc_id goes, whatever the type of the ids."""
    docs = spark.createDataFrame(SEVERAL, "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
    assert {(str(a), str(b)) for a, b in pairs(exact_dedup(docs))} == {("2", "1")}
    left = sorted((str(r.doc_id), r.text or "") for r in keep_one(docs, exact_losers(docs)).collect())
    assert left == [("1", "a b c d"), ("2", "quite another text here"), ("3", "a b c d e"), ("4", ""), ("None", "a b c d")]
    assert {(str(a), str(b)) for a, b in pairs(near_groups(docs))} == {("2", "1"), ("3", "1")}
    left = sorted((str(r.doc_id), r.text or "") for r in keep_one(docs, near_losers(docs)).collect())
    assert left == [("1", "a b c d"), ("2", "quite another text here"), ("4", ""), ("None", "a b c d")]


def test_perfect_hash_of_alike_digests():
    """Digests that agree in all but their first word are told apart; none is left to a list in practice."""
    d = np.zeros((2000, 32), np.uint8)
    d.view("<u8").reshape(-1, 4)[:, 0] = np.arange(2000)
    h = PerfectHash(d)
    assert sorted(h.slots) == list(range(2000)) and (h.slot(d) == h.slots).all() and not h.rest
    h = PerfectHash(np.repeat(d[:1], 2, axis=0))
    assert sorted(h.slots) == [0, 1] and len(h.rest) == 1


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    x, y, one = a[:600], a[300:], a[:1]
    sets = np.concatenate([x, y, one])
    rows = np.repeat([0, 1, 2], [600, 600, 1])
    s = sketch(sets, rows, 3)
    assert np.isfinite(s).all() and s.shape == (3, COORDINATES)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.15


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7)], "a long, b long")
    assert pairs(components(e)) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}


def test_near(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert pairs(near_groups(documents)) == groups_by_force(rows)


def test_near_odd(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert pairs(near_groups(odd)) == groups_by_force(rows) >= {(2, 1), (9, 8), (13, 12)}
    assert pairs(near_groups(none)) == set()


@pytest.mark.parametrize("find", [repeated_intervals, shared_factors])
def test_passages(documents, odd, none, find):
    for df in (documents, odd):
        want = spans_by_force([tuple(r) for r in df.select("doc_id", "text").collect()])
        assert pairs(find(df)) == want and want
    assert pairs(find(none)) == set()


def test_passages_sql(data, documents):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    assert set(con.execute(SPANS_SQL).fetchall()) == pairs(repeated_intervals(documents))


def test_merge_equals_sorting_all():
    """Merged shards have the order and common prefixes of a sort of all suffixes."""
    rng = np.random.default_rng(3)
    strings = [rng.integers(1, 4, rng.integers(1, 12)).tolist() for _ in range(40)]
    flat, string = [], []
    for i, s in enumerate(strings):
        flat += [*s, 0]
        string += [i] * (len(s) + 1)
    x, string = np.array(flat, np.uint32), np.array(string)
    cut = np.searchsorted(string, [0, 13, 27, 40])
    shards = [shard_transform(x[a:b], string[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    rounds = 3
    order, common = merge(shards, rounds)

    def suffix(p):
        end = p + int(np.flatnonzero(x[p:] == 0)[0])
        return tuple(x[p:end].tolist())

    heads = [(suffix(p) + (0,))[:rounds] for p in order]
    assert heads == sorted(heads)
    for k in range(1, len(heads)):
        n = 0
        while n < rounds and n < len(heads[k]) and n < len(heads[k - 1]) and heads[k][n] == heads[k - 1][n] != 0:
            n += 1
        assert common[k] == n
