"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bwt_merge import repeated_intervals
from .exact_dedup import EXACT_SQL, exact_dedup
from .lempel_ziv import shared_factors
from .mixing import mix
from .near_dedup import NEAR_SQL, near_groups
from .passages import SPANS_SQL
from .quality import passing_ids
from .segmentation import encode
from .suffix_tree import tree_scores, tree_sql
from .token_counts import token_counts
from .vantage import neighbours, neighbours_sql

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
EVERY = 50  # the stated set of queries: vectors whose id is divisible by this, against all vectors


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_scores(_read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "mix_copy", "mix_source")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_read(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_intervals(_read(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_read(spark, sf_dir, "embeddings"), every=EVERY)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_factors(_read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passing_ids(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return kept.selectExpr("doc_id", "lang", "round(perplexity, 6) AS perplexity")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), BYTE_BPE)


def op9_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_read(spark, sf_dir, "documents"), PIECES)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_tree_scores,
        op2_mixing,
        op3_near_dedup,
        op4_suffix_array_dedup,
        op5_nearest_neighbours,
        op6_substring_dedup,
        op7_quality_classifier,
        op8_token_counts,
        op9_segmentation,
        op10_exact_dedup,
    )
}
ORACLES = {"op1_suffix_tree_scores": tree_sql(), "op3_near_dedup": NEAR_SQL, "op4_suffix_array_dedup": SPANS_SQL, "op5_nearest_neighbours": neighbours_sql(every=EVERY), "op6_substring_dedup": SPANS_SQL, "op10_exact_dedup": EXACT_SQL}
