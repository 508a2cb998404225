"""Where intermediate results go, and small helpers on DataFrames."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; only a local session may fall back to its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanweave-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once into the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """`df.mapInArrow(run, schema)` with batches of few bytes however long the texts are (unless the session says
    otherwise), and with the memory that a task freed given back when it ends."""
    spark = df.sparkSession
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)

    def lean(it):
        yield from run(it)
        give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have, whatever its letter case."""
    have = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in have:
        n += 1
        name = f"{base}_{n}"
    return name


def doc_view(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, those missing as null strings."""
    have = {c.lower() for c in docs.columns}
    return docs.select(*[F.col(n) if n.lower() in have else F.lit(None).cast("string").alias(n) for n in names])


def integral(df: DataFrame, column: str = "doc_id") -> bool:
    return df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def text_key(text: str | Column = "text") -> Column:
    """The SHA-256 digest of a text, 32 bytes."""
    return F.unhex(F.sha2(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"), 256))


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """(v, *columns): the distinct rows of `columns` without nulls, each with a long `v` that orders them alike.

    Written once in that order, by ranges, so that the numbers stay what they are.
    """
    rows = docs.select(*columns).dropna().distinct().orderBy(*columns)
    return cut(rows.select(F.monotonically_increasing_id().alias("v"), *columns))


def keep_one(docs: DataFrame, losers: DataFrame) -> DataFrame:
    """`docs` without the rows whose doc_id and text are in `losers` (doc_id, digest), and one row of each repeated
    doc_id with the same text.  Another text of the same doc_id stays, and so do rows without a doc_id or text.
    A null digest stands for every text of that doc_id.
    """
    digest = fresh(docs, "_digest")
    lost = losers.select("doc_id", F.col("digest").alias(digest)).distinct()
    ids = cut(docs.select("doc_id").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not ids.take(1):  # then a doc_id has one text, and the join needs no digests
        return docs.join(lost.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    keyed = docs.withColumn(digest, text_key())
    by_text = lost.where(F.col(digest).isNotNull())
    kept = keyed.join(by_text, ["doc_id", digest], "left_anti")
    kept = kept.join(lost.where(F.col(digest).isNull()).select("doc_id"), "doc_id", "left_anti")
    once = kept.join(ids, "doc_id", "left_anti").select(*docs.columns)
    again = kept.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", digest]).select(*docs.columns)
    return once.unionByName(again)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
