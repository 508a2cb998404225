"""The pipeline's stages, each on its own input, and the whole."""

import corpus_pipeline as P
from spanweave.llm.exact_dedup import exact_dedup
from spanweave.llm.near_dedup import near_groups
from spanweave.llm.quality import passing_ids


def test_stages_in_turn(spark, data, documents, labels, tmp_path):
    docs = documents
    for n, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, data)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if n < len(P.STAGES) - 1:
            assert out.columns == documents.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality":
            assert ids == {r.doc_id for r in passing_ids(docs, labels).collect()}
        elif name in ("exact", "near"):
            find = exact_dedup if name == "exact" else near_groups
            assert ids == before - {r.doc_id for r in find(docs).collect()}
            assert find(out).count() == 0
        elif name == "encoding":
            assert out.count() == docs.count() and out.where("not round_trip").count() == 0
        docs = out
    assert sorted(r.doc_id for r in P.run(spark, data).select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stages_on_odd_rows(spark, data, odd, none):
    for name, stage in P.STAGES:
        assert stage(spark, odd, data).count() >= 0, name
        assert stage(spark, none, data).count() == 0, name
