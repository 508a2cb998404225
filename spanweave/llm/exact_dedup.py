"""Exact dedup through a minimal perfect hash over the digests of the historical load."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batch import mix
from ._session import cut, integral, text_key

PER_BUCKET = 200_000
GAMMA = 2.0
LEVELS = 64


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests.

    Level by level every digest left over hashes into a bit array of GAMMA times their number; digests alone in
    their cell are placed there, the others go on to the next level.  The slot is the rank of the cell, so n
    digests fill exactly n slots.  Each level draws its cells from all 32 bytes; what LEVELS of them leave over
    (in practice nothing) is listed with its slots.
    """

    def __init__(self, digests: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, placed = np.arange(len(digests)), 0
        self.slots = np.zeros(len(digests), np.int64)
        while len(left) and len(self.levels) < LEVELS:
            size = max(64, int(len(left) * GAMMA) // 64 * 64)
            cell = self.cell(digests[left], len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            rank = placed + np.cumsum(alone) - alone
            hit = alone[cell]
            self.slots[left[hit]] = rank[cell[hit]]
            self.levels.append((size, alone, rank))
            placed += int(alone.sum())
            left = left[~hit]
        self.slots[left] = placed + np.arange(len(left))
        self.rest = {digests[i].tobytes(): int(self.slots[i]) for i in left.tolist()}

    @staticmethod
    def cell(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        h = np.full(len(digests), (level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1), np.uint64)
        for word in np.ascontiguousarray(digests).view("<u8").reshape(-1, 4).T:
            h = mix(h ^ word) + np.uint64(0x632BE59BD9B4E019)
        return (mix(h) % np.uint64(size)).astype(np.int64)

    def slot(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; for a nonmember any slot, or -1."""
        out, left = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, (size, alone, rank) in enumerate(self.levels):
            cell = self.cell(digests[left], level, size)
            hit = alone[cell]
            out[left[hit]] = rank[cell[hit]]
            left = left[~hit]
            if not len(left):
                break
        for i in left.tolist() if self.rest else ():
            out[i] = self.rest.get(digests[i].tobytes(), -1)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """32-byte values as rows of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fixed = column.cast(pa.binary()).cast(pa.binary(32))
    return np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * 32 : (fixed.offset + len(fixed)) * 32].reshape(-1, 32)


def _look_up(history: pa.Table, arrivals: pa.Table) -> pa.Table:
    """One bucket: build the hash over the history's digests, then look up the arrivals."""
    n = arrivals.num_rows
    place = np.full(n, -1, np.int64)
    if history.num_rows and n:
        held = np.ascontiguousarray(_matrix(history["digest"]))
        mph = PerfectHash(held)
        slots, row = np.empty_like(held), np.empty(len(held), np.int64)
        slots[mph.slots] = held
        row[mph.slots] = np.arange(len(held))
        asked = np.ascontiguousarray(_matrix(arrivals["digest"]))
        at = mph.slot(asked)
        found = at >= 0
        found[found] = (slots[at[found]] == asked[found]).all(axis=1)
        place[found] = row[at[found]]
    locators = history["locator"].combine_chunks() if history.num_rows else pa.nulls(1, arrivals["doc_id"].type)
    locator = locators.take(pa.array(np.maximum(place, 0), mask=place < 0))
    return pa.table({"doc_id": arrivals["doc_id"], "digest": arrivals["digest"].cast(pa.binary()), "locator": locator})


def exact_losers(docs: DataFrame, history: DataFrame | None = None, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(doc_id, digest, keeper_id): each text of a doc_id that another document keeps; see `exact_dedup`."""

    def keyed_(df: DataFrame) -> DataFrame:
        return df.where("doc_id is not null and text is not null").select("doc_id", text_key().alias("digest"))

    keyed = keyed_(docs)
    if history is None:
        keyed = cut(keyed)
        if integral(docs):
            low, high, n = keyed.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
            line = (low + high) // 2 if n else 0
        else:  # the document of the least hash stands anywhere in the order
            line, n = keyed.agg(F.min_by("doc_id", F.xxhash64("doc_id")), F.count("*")).first()
        line = F.lit(line).cast(docs.schema["doc_id"].dataType)
        before, arrivals, outside = keyed.where(F.col("doc_id") <= line), keyed.where(F.col("doc_id") > line), False
    else:
        before = keyed_(history)
        arrivals, outside, n = keyed, True, before.count()
    buckets = max(1, n // per_bucket)
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    winners = before.groupBy("digest").agg(F.min("doc_id").alias("locator"), F.max("doc_id").alias("last"))
    index = winners.select(bucket.alias("bucket"), "digest", F.col("locator").cast(docs.schema["doc_id"].dataType).alias("locator"))
    asked = arrivals.distinct().select(bucket.alias("bucket"), "digest", "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    looked = cut(index.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_look_up, f"doc_id {kind}, digest binary, locator {kind}"))
    repeats = looked.where("locator is not null and doc_id <> locator").select("doc_id", "digest", F.col("locator").alias("keeper_id"))
    new = looked.where("locator is null")
    first = new.groupBy("digest").agg(F.min("doc_id").alias("keeper_id"), F.max("doc_id").alias("last"))
    out = repeats.unionByName(new.join(first.where("last > keeper_id"), "digest").where("doc_id > keeper_id").select("doc_id", "digest", "keeper_id"))
    if not outside:
        own = before.join(winners.where("last > locator"), "digest").where("doc_id > locator").distinct()
        out = out.unionByName(own.select("doc_id", "digest", F.col("locator").alias("keeper_id")))
    return out


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Copies of a text and the document that stays: (doc_id, keeper_id), one row for each document to remove.

    The SHA-256 digests of the historical load are split into buckets by a hash of them, about `per_bucket`
    each.  A bucket's distinct digests get a minimal perfect hash whose slots hold the full digest and the
    locator (smallest doc_id) of its winner.  Arrivals look up their slot and compare all 32 bytes: members are
    repeats of history, nonmembers are grouped by digest among themselves.  Without `history` the lower half of
    the range of doc_id counts as the load that was there before; where that line is drawn can't change the
    result, since a smaller doc_id always wins.

    Only (digest, doc_id) is shuffled, 40 bytes a document whatever its length: very long texts are digested
    whole where they are read.  Texts count as equal if their SHA-256 digests are.  A doc_id may be of any type
    that has an order.

    Nulls: rows with a null doc_id or text are no copies and no winners.  The empty text is a text like any
    other.  Repeated rows (one doc_id more than once) count as one document and give no row of their own; a
    doc_id with several texts is listed if one of them is a copy, and `keep_one` then removes that text alone.
    Further columns are ignored.  An empty table gives an empty result.
    """
    return exact_losers(docs, history, per_bucket).groupBy("doc_id").agg(F.min("keeper_id").alias("keeper_id"))


EXACT_SQL = """
SELECT doc_id, min(keeper_id) AS keeper_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper_id
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
WHERE doc_id > keeper_id GROUP BY doc_id
"""
