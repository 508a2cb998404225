"""The classifier on documents whose labels it never saw, by language."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.llm._batch import HashIndex, chunks, words
from spanweave.llm.grams import gather, score
from spanweave.llm.quality import passing_ids
from spanweave.llm.suffix_tree import grow, states


@pytest.fixture(scope="module")
def unseen(spark):
    """Labelled documents of sf0.1 of which no label was given: lang, quality, toxic, words, kept."""
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    hidden = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) == 0
    kept = passing_ids(docs, labels.where(~hidden)).select("doc_id").withColumn("kept", F.lit(1))
    rows = labels.where(hidden).join(docs, "doc_id").where("text <> ''").join(kept, "doc_id", "left")
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return rows.select("lang", "quality", "toxic", words.alias("words"), F.coalesce("kept", F.lit(0)).alias("kept")).toPandas()


def test_marks(documents):
    """The greatest evidence of a word, against a plain look-up."""
    docs = documents.select("doc_id", "text")
    levels = states(grow(gather(docs.select("text"), 1), 1, 20, 0.05))
    every = sorted({w for r in docs.collect() for w in re.findall(r"[^\x00-\x20]+", r.text or "")})
    value = {w: (len(w) * 7919 % 101) / 10 for w in every[::3]}
    keys = [words(next(chunks(pa.array([w])))).hashes[0] for w in value]
    marks = HashIndex(np.array(keys, np.uint64), np.array(list(value.values())))
    for most in (10**9, 1):
        got = score(docs, levels, None, ("l", "n", "p"), marks=marks, most=most).orderBy("doc_id").toPandas()
        want = [max([0, *(value.get(w, 0) for w in re.findall(r"[^\x00-\x20]+", r.text))]) for r in docs.orderBy("doc_id").collect()]
        assert np.allclose(got["p"], want)


def test_toxic_by_language(unseen):
    toxic, clean = unseen[(unseen.toxic == 1) & (unseen.quality == 1)], unseen[(unseen.toxic == 0) & (unseen.quality == 1)]
    print(toxic.groupby("lang").kept.agg(["sum", "count"]), clean.groupby("lang").kept.agg(["sum", "count"]))
    recall, rate = 1 - toxic.groupby("lang").kept.mean(), clean.groupby("lang").kept.mean()
    assert set(recall.index) == {"de", "en", "es", "fr"}
    assert recall.min() > 0.6 and rate.min() > 0.9


def test_clean_by_length(unseen):
    clean = unseen[(unseen.toxic == 0) & (unseen.quality == 1)]
    rate = clean.groupby(pd.cut(clean.words, [0, 20, 100, 500, 10**9]), observed=True).kept.agg(["mean", "sum", "count"])
    print(rate)
    assert rate["mean"].min() > 0.9
