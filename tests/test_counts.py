"""Counts made in batches, against those that are made token by token."""

from pyspark.sql import functions as F

from spanweave import queries as Q
from spanweave.operators import counts as C
from spanweave.operators import stats as S


def rows(df):
    return sorted((r.x, r.y, r.n) for r in df.collect())


def test_pairs(spark, data, monkeypatch):
    sents = spark.createDataFrame([(1, ["a", "A", "b"]), (2, []), (3, ["c"]), (4, ["b", "a", "b", "b"]), (5, None)], "doc_id long, tokens array<string>")
    for some in (1, 3, 10**6):
        monkeypatch.setattr(C, "TOKENS", some)
        for width in (1, 2, 3):
            want = S.cooccurrence(sents, width)
            assert rows(C.pruned_cooccurrence(sents, width, 1)) == rows(want)
            assert rows(C.pruned_cooccurrence(sents, width, 5)) == rows(S.prune_contexts(want, 5))
    few = Q._sents(spark, data).where("doc_id % 9 = 0")
    assert rows(C.pruned_cooccurrence(few, 2, 5)) == rows(S.prune_contexts(S.cooccurrence(few, 2), 5)) != []


def test_documents(spark, data):
    """Documents over several batches, with all of their tokens beside each count."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sents = Q._sents(spark, data)
        got = C.document_counts(sents).collect()
        want = S.term_documents(sents)
        assert sorted((r.x, r.y, r.n) for r in got) == rows(want)
        ny = {r.y: r.m for r in want.groupBy("y").agg(F.sum("n").alias("m")).collect()}
        assert all(r.ny == ny[r.y] for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_totals_of_rare_and_frequent_terms(spark, data, monkeypatch):
    monkeypatch.setattr(C, "HEAVY", 300)
    sents = Q._sents(spark, data)
    key = lambda df: sorted((r.x, r.y, r.n, round(r.pmi, 9)) for r in df.collect())
    assert key(C.document_pmi(sents)) == key(S.pmi(S.term_documents(sents)))
