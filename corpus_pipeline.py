"""From raw documents to token ids: classifier, exact dedup, near dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanweave.llm._session import keep_one, stored
from spanweave.llm.exact_dedup import exact_losers
from spanweave.llm.mixing import mix
from spanweave.llm.near_dedup import near_losers
from spanweave.llm.quality import classify
from spanweave.llm.queries import PIECES
from spanweave.llm.segmentation import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; see `classify` for rows without text, language or doc_id."""
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that of the smallest doc_id; other texts of a repeated doc_id, rows without a doc_id or text stay."""
    return keep_one(docs, exact_losers(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; other texts of a repeated doc_id, rows without a doc_id or text stay."""
    return keep_one(docs, near_losers(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, once for each time; see `mix` for rows without tokens or sources."""
    return mix(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; see `encode` for rows without text or doc_id."""
    return encode(docs, PIECES)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixture), ("encoding", encoding)]
ORACLE_SQL = None  # the classifier's and the segmentation's results are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs)
    return docs
