"""Byte n-gram codes of whole texts: counting, distinct codes, and scoring texts from a table by code.

A code holds up to eight bytes and, if there is room, a group number above them (a language; 0 without): the last
byte is the symbol, the bytes before it its context, 0 before the beginning of a text.  Only sums by code are
shuffled, never a row per position.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ._batch import Chunk, HashIndex, Tally, byte_codes, chunks, mix, run_sums, words
from ._session import arrow_map, cut, fresh, stored
from ._units import forget

TABLE_ROWS = 4_000_000
UNIFORM = -math.log(256)


def tail(code: Column, n: int, bits: int) -> Column:
    """The last n bytes of codes of `bits` bits, with the group number."""
    mask = ~((1 << bits) - 1) | ((1 << 8 * n) - 1)
    return code.bitwiseAND(F.lit((mask + (1 << 63)) % (1 << 64) - (1 << 63)))


def group_codes(batch_column: pa.Array | None, groups: dict[str, int], first: int, last: int) -> np.ndarray:
    if batch_column is None:
        return np.zeros(last - first, np.uint64)
    return np.array([groups.get(x, 0) for x in batch_column.slice(first, last - first).to_pylist()], np.uint64)


def gather(docs: DataFrame, depth: int, groups: dict[str, int] | None = None, also: int | None = None) -> DataFrame:
    """(code, n): how often each symbol follows each context of `depth` bytes, over `docs` (text[, grp]).

    With `also`, every text counts under that group too.
    """
    bits = np.uint64(8 * (depth + 1))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        tally = Tally()
        for batch in it:
            for c in chunks(batch.column(0)):
                code = byte_codes(c, depth)
                if groups is not None:
                    g = np.repeat(group_codes(batch.column(1), groups, c.first, c.last), c.lengths)
                    if also is not None:
                        tally.add(code | np.uint64(also) << bits)
                    code |= g << bits
                tally.add(code)
                if tally.full():
                    yield _rows(*tally.take())
        yield _rows(*tally.take())

    return arrow_map(docs, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _rows(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])


@dataclass
class Level:
    """One length of context: log probabilities of the symbols seen after a context, by code (code, lp), and what is
    added for a symbol that wasn't, by context (ctx, lb), before the next shorter one is asked."""

    seen: DataFrame
    back: DataFrame


Sent = list[tuple[HashIndex, HashIndex]]


def _load(levels: list[Level]) -> Sent:
    out = []
    for level in levels:
        pair = []
        for table, key, value in ((level.seen, "code", "lp"), (level.back, "ctx", "lb")):
            t = table.select(key, value).toArrow()
            pair.append(HashIndex(t[key].to_numpy().view(np.uint64), t[value].to_numpy()))
        out.append(tuple(pair))
    return out


def walk(code: np.ndarray, levels: Sent, keep: int) -> np.ndarray:
    """The log probability of each code's symbol: that of the longest context that has seen it, and the weights of
    the longer ones that haven't; `keep` are the bits of the group."""
    lp, left = np.zeros(len(code)), np.arange(len(code))
    for n in range(len(levels), 0, -1):
        if not len(left):
            break
        seen, back = levels[n - 1]
        c = code[left] & np.uint64((keep | (1 << 8 * n) - 1) & (1 << 64) - 1)
        at = seen.find(c)
        hit = at >= 0
        lp[left[hit]] += seen.values[0][at[hit]] if hit.any() else 0.0
        left = left[~hit]
        at = back.find(c[~hit] & np.uint64(~255 & (1 << 64) - 1))
        known = at >= 0
        if known.any():
            lp[left[known]] += back.values[0][at[known]]
    lp[left] += UNIFORM
    return lp


def of_groups(levels: list[Level], bits: int, groups: list[int]) -> list[Level]:
    """The rows of `levels` that belong to some groups."""
    return [Level(*[t.where(F.shiftright(key, bits).isin(groups)) for t, key in ((x.seen, "code"), (x.back, "ctx"))]) for x in levels]


def group_parts(levels: list[Level], bits: int, most: int) -> list[list[int]]:
    """The groups of `levels` in lists of at most `most` rows, or of one group."""
    keys = reduce(DataFrame.unionByName, [t.select(F.shiftright(key, bits).cast("int").alias("g")) for x in levels for t, key in ((x.seen, "code"), (x.back, "ctx"))])
    out, size = [], 0
    for g, n in sorted(tuple(r) for r in keys.groupBy("g").count().collect()):  # a row for each language
        if out and size + n <= most:
            out[-1].append(g)
            size += n
        else:
            out.append([g])
            size = n
    return out


def score(docs: DataFrame, levels: list[Level], groups: dict[str, int] | None, names: tuple[str, str, str], marks: HashIndex | None = None, keep: list[str] | None = None, most: int = TABLE_ROWS) -> DataFrame:
    """The columns `keep` (all) of the rows of `docs`, and the sum of log probabilities over the bytes of the text
    under `levels` (for contexts of 0, 1, … bytes), the number of bytes and, with `marks`, values by key of `word_keys`,
    the greatest value of a word (0 without any); null without bytes.

    Levels of at most `most` rows in all go to the executors.  Larger ones go in parts of several groups, with one pass
    over the texts of each part.  Those of a group that is larger alone stay where they are: the texts' codes are
    counted text by text, and a join by code with the distinct codes' log probabilities gives the sums.
    """
    spark, depth = docs.sparkSession, len(levels) - 1
    bits, keep = 8 * (depth + 1), docs.columns if keep is None else keep
    sizes = [t.count() for x in levels for t in (x.seen, x.back)]
    small = sum(sizes) <= most
    if not small and groups and len(parts := group_parts(levels, bits, most)) > 1:
        own = F.coalesce(*[F.when(F.col("lang") == x, F.lit(i)) for x, i in groups.items()], F.lit(0))
        later, out = [g for part in parts[1:] for g in part], []
        for part in parts:
            here = own.isin(part) if part is not parts[0] else ~own.isin(later)
            out.append(score(docs.where(here), of_groups(levels, bits, part), groups, names, marks, keep, most))
        return reduce(DataFrame.unionByName, out)
    model = spark.sparkContext.broadcast((_load(levels) if small else None, marks))
    if not small:
        row = fresh(docs, "_row")
        docs = stored(docs.withColumn(row, F.monotonically_increasing_id()))
        keep = [*keep, row]
    lower = [c.lower() for c in docs.columns]
    text_at, grp_at = lower.index("text"), lower.index("lang") if groups is not None else None
    kept = [lower.index(c.lower()) for c in keep]
    schema = StructType([*[docs.schema.fields[i] for i in kept], StructField(names[0], DoubleType()), StructField(names[1], LongType()), StructField(names[2], DoubleType())])
    high = ~((1 << bits) - 1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        tables, words_ = model.value
        for batch in it:
            for c in chunks(batch.column(text_at)):
                grp = None if grp_at is None else group_codes(batch.column(grp_at), groups, c.first, c.last)
                none, total = c.lengths == 0, np.zeros(c.last - c.first)
                full = np.flatnonzero(~none)
                if len(full) and tables is not None:
                    code = byte_codes(c, depth)
                    if grp is not None:
                        code |= np.repeat(grp, c.lengths) << np.uint64(bits)
                    total[full] = np.add.reduceat(walk(code, tables, high), c.starts[full])
                peak = pa.array(_greatest(c, words_, grp), mask=none) if words_ is not None else pa.nulls(len(none), pa.float64())
                cols = [batch.column(i).slice(c.first, c.last - c.first) for i in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(total, mask=none), pa.array(c.lengths.astype(np.int64)), peak], schema.names)

    out = arrow_map(docs, run, schema)
    if small:
        return out

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lower.index(row.lower())
        for batch in it:
            for c in chunks(batch.column(text_at)):
                code = byte_codes(c, depth)
                if grp_at is not None:
                    code |= np.repeat(group_codes(batch.column(grp_at), groups, c.first, c.last), c.lengths) << np.uint64(bits)
                ids = batch.column(at).to_numpy()
                for i in np.flatnonzero(c.lengths).tolist():
                    codes, n = run_sums(code[c.starts[i] : c.starts[i + 1]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), ids[c.first + i])), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], [row, "code", "n"])

    counts = arrow_map(docs, count, f"`{row}` long, code long, n long")
    now = counts.select("code").distinct().withColumn("sum", F.lit(0.0)).withColumn("found", F.lit(False))
    for n in range(len(levels), 0, -1):
        key = tail(F.col("code"), n, bits)
        now = now.withColumn("k", key).join(levels[n - 1].seen.select(F.col("code").alias("k"), "lp"), "k", "left")
        now = now.withColumn("ctx", key.bitwiseAND(F.lit(~255))).join(levels[n - 1].back.select("ctx", "lb"), "ctx", "left")
        more = F.when(F.col("found"), 0.0).otherwise(F.coalesce("lp", "lb", F.lit(0.0)))
        now = now.select("code", (F.col("sum") + more).alias("sum"), (F.col("found") | F.col("lp").isNotNull()).alias("found"))
    now = cut(now.select("code", (F.col("sum") + F.when(F.col("found"), 0.0).otherwise(UNIFORM)).alias("lp")))
    sums = counts.join(now, "code").groupBy(row).agg(F.sum(F.col("n") * F.col("lp")).alias(names[0]))
    out = out.drop(names[0]).join(sums, row, "left")
    return out.select(*schema.names).drop(row)


def word_keys(hashes: np.ndarray, groups: np.ndarray | None) -> np.ndarray:
    """Keys of words by their hashes and the group number of each."""
    return hashes if groups is None else mix(hashes + groups * np.uint64(0x9E3779B97F4A7C15))


def _greatest(c: Chunk, marks: HashIndex, grp: np.ndarray | None) -> np.ndarray:
    w = words(c)
    counts, out = np.diff(w.row_starts), np.zeros(len(c.starts) - 1)
    at = marks.find(word_keys(w.hashes, None if grp is None else np.repeat(grp, counts)))
    some = np.flatnonzero(counts)
    if len(some) and len(marks.h):
        out[some] = np.maximum.reduceat(np.where(at >= 0, marks.values[0][at], 0.0), w.row_starts[some])
    return out


def spread_groups(g: Column, step: int) -> Column:
    """The groups that a text of group part · step + language counts under: its language and all languages (0), over
    the whole and within its part (0 is none)."""
    lang, part = F.pmod(g, F.lit(step)), g - F.pmod(g, F.lit(step))
    return F.array_distinct(F.array(lang, F.lit(0).cast("long"), g, part))


def peaks(docs: DataFrame, marks: HashIndex, groups: dict[str, int], keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` (with text and lang) and `peak`, the greatest value of a word as in `score`."""
    docs = docs.select("text", "lang", *[F.col(x).alias(f"_{x}") for x in keep])
    sent = docs.sparkSession.sparkContext.broadcast(marks)
    schema = StructType([*[StructField(x, f.dataType) for x, f in zip(keep, docs.schema.fields[2:])], StructField("peak", DoubleType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for c in chunks(batch.column(0)):
                grp = group_codes(batch.column(1), groups, c.first, c.last)
                cols = [batch.column(i + 2).slice(c.first, c.last - c.first) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(_greatest(c, sent.value, grp), mask=c.lengths == 0)], schema.names)

    return arrow_map(docs, run, schema)


def word_documents(docs: DataFrame, groups: dict[str, int], among: HashIndex | None = None) -> DataFrame:
    """(g, word, n): in how many texts of `docs` (text, lang) each word stands, by group and under group 0 too.

    With `among`, whose last value is a number by key of `word_keys`, (at, n): only those keys, by their number.  So
    no more rows are shuffled than `among` has, times the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(among)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        n = None if table is None else np.zeros(len(table.h), np.int64)
        for batch in it:
            for c in chunks(batch.column(0)):
                w, g = words(c), group_codes(batch.column(1), groups, c.first, c.last)
                row = np.repeat(np.arange(len(g)), np.diff(w.row_starts))
                order = np.lexsort((w.hashes, row))
                a, b = row[order], w.hashes[order]
                first = order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]] if len(order) else order
                own, hashes = g[row[first]], w.hashes[first]
                for t, use in ((own, own > 0), (np.zeros_like(own), np.ones(len(own), bool))):
                    if table is None:
                        yield pa.RecordBatch.from_arrays([pa.array(t[use].astype(np.int32)), pa.array(hashes[use].view(np.int64))], ["g", "word"])
                    else:
                        at = table.find(word_keys(hashes[use], t[use]))
                        n += np.bincount(at[at >= 0], minlength=len(n))
        if table is not None:
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(table.values[-1][some]), pa.array(n[some])], ["at", "n"])

    if among is not None:
        return arrow_map(docs.select("text", "lang"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return arrow_map(docs.select("text", "lang"), run, "g int, word long").groupBy("g", "word").agg(F.count("*").alias("n"))
