"""Registered queries against their SQL at the smallest scale, and batch against stream."""

import os

import duckdb
import pytest

from spanweave import queries as Q
from spanweave import queries_files  # noqa: F401
from spanweave.operators import spans as A
from spanweave.plans.extract import extract, token_spans
from spanweave.plans.lang import RuleSet

FEW = ["tokenize", "sentences", "test_edge", "phrase_longest", "phrase_optional", "select_submatch", "frame_fields", "coord_near", "coord_prefix", "coord_count_invert", "coord_overlaps", "coord_when", "bio", "markup", "snippets", "cooc_pruned", "closest_terms", "pmi_term_source", "rank_sources_by_terms", "variance_by_source", "source_lines"]
FEW += ["source_text", "source_csv", "source_twitter_reply", "source_triggers_news", "source_conllu_file", "source_simple_file", "path_maybe", "layer_phrase", "namespace_phrase", "coord_connects", "pmi_lookup"]


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in os.listdir(data):
        c.execute(f"create view {t.split('.')[0]} as select * from '{data}/{t}'")
    return c


@pytest.mark.parametrize("name", FEW)
def test_against_sql(spark, data, con, name):
    df = Q.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    r = con.execute(Q.ORACLES[name])
    names = [x[0] for x in r.description]
    want = sorted(tuple(str(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert sorted(names) == cols and got == want and got


def test_kernel_equals_algebra(spark, data):
    """Coordinators over token tests: the evaluator and the joins give the same spans."""
    rules = RuleSet(
        "the : {the}i\nion : <ion>i\nlong : /^[a-z]{9,}$/\na ~ near(the, 2, ion)\nb ~ prefix(the, long)\nc ~ count(the, 2, _)\n"
        "d ~ inter(long, ion)\ne ~ diff(long, ion)\nf ~ precedes(the, 3, ion)\ng ~ filter(the, _, invert)\nh ~ union(long, ion)",
        strict=True,
    )
    sents = Q._sents(spark, data).cache()
    s = {n: token_spans(sents, rules, n).select("doc_id", "sent_id", "begin", "end") for n in ("the", "ion", "long")}
    want = {
        "a": A.near(s["the"], 2, s["ion"]),
        "b": A.prefix(s["the"], s["long"]),
        "c": A.count_in(s["the"], 2, A.scopes(sents)),
        "d": A.intersection(s["long"], s["ion"]),
        "e": A.difference(s["long"], s["ion"]),
        "f": A.precedes(s["the"], 3, s["ion"]),
        "g": A.filter_in(s["the"], A.scopes(sents), True),
        "h": A.union(s["long"], s["ion"]),
    }
    found = extract(sents, rules, list(want)).select("rule", "doc_id", "sent_id", "ext_b", "ext_e").collect()
    for rule, df in want.items():
        a = sorted(tuple(r)[1:] for r in found if r.rule == rule)
        b = sorted(tuple(r) for r in df.select("doc_id", "sent_id", "begin", "end").collect())
        assert a == b and b, rule
    sents.unpersist()


def test_streams(spark, data, tmp_path):
    from spanweave.streaming.rules import stream_extract, stream_when

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(40)
    docs.write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    q = stream_extract(stream, Q.RULES, ["optional"]).select("doc_id", "sent_id", "ext_b", "ext_e").writeStream.format("memory").queryName("m").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = extract(Q.T.sentence_table(spark.read.parquet(str(tmp_path / "docs"))), Q.RULES, ["optional"]).select("doc_id", "sent_id", "ext_b", "ext_e")
    assert sorted(spark.table("m").collect()) == sorted(batch.collect())
    turns = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "text")
    turns.write.parquet(str(tmp_path / "turns"))
    rules = "the : {the}\nwith : {with}\nx ~ when(the and not with, _)"
    s = stream_when(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns")), rules, "x", "conv_id", "turn")
    q = s.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = Q.coord_when(spark, data).select("conv_id", "turn").collect()
    assert sorted((r.conv_id, r.turn) for r in spark.table("w").collect()) == sorted((r.conv_id, r.turn) for r in want)
