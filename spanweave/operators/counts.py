"""Counts of tokens in Arrow batches, before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kept import cut, stored

HEAVY = 100_000  # terms with at least so small a part of all tokens; there can't be more of them


def document_counts(sents: DataFrame) -> DataFrame:
    """(x, y, n, ny): tokens in lower case by document, with all tokens of the document.  Without a shuffle: the
    sentences of a document, whose doc_id must be its own, come one after the other as `sentence_table` has them."""
    kind = sents.schema["doc_id"].dataType.simpleString()

    def count(t: pa.Table) -> pa.RecordBatch:
        lists, ids = t.column("tokens").combine_chunks(), t.column("doc_id").combine_chunks()
        doc, start = starts(ids)
        size = np.diff(lists.offsets.to_numpy())
        d = lists.flatten().dictionary_encode()
        width = max(1, len(d.dictionary))
        keys, n = np.unique(np.repeat(doc, size) * width + d.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, code = keys // width, keys % width
        ny = np.bincount(doc, size, len(start)).astype(np.int64)
        y = ids.take(pa.array(start)).take(pa.array(row))
        return pa.RecordBatch.from_arrays([d.dictionary.take(pa.array(code)), y, pa.array(n.astype(np.int64)), pa.array(ny[row])], names=["x", "y", "n", "ny"])

    def starts(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of its document for each row, and the first row of each document."""
        code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new = np.append(True, code[1:] != code[:-1])[: len(code)]
        return np.cumsum(new) - 1, np.flatnonzero(new)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []  # of the document that may go on in the next batch
        for batch in it:
            if not batch.num_rows:
                continue
            last = int(starts(batch.column("doc_id"))[1][-1])
            ends = not left or left[-1].column("doc_id")[-1] != batch.column("doc_id")[0]
            if last or ends:
                whole = [*left, batch.slice(0, last)]
                if sum(b.num_rows for b in whole):
                    yield count(pa.Table.from_batches(whole))
                left = []
            left.append(batch.slice(last))
        if left:
            yield count(pa.Table.from_batches(left))

    view = sents.select("doc_id", F.transform("tokens", F.lower).alias("tokens"))
    return view.mapInArrow(run, f"x string, y {kind}, n long, ny long")


def document_pmi(sents: DataFrame) -> DataFrame:
    """(x, y, n, pmi) of terms and documents.  The counts are written once; frequent terms, which have nearly all
    rows, meet their totals without a shuffle."""
    xy = stored(document_counts(sents))
    tx = cut(xy.groupBy("x").agg(F.sum("n").alias("nx")))
    tx = tx.crossJoin(F.broadcast(tx.agg(F.sum("nx").alias("nn"))))  # the total is a single row
    often = F.col("nx") * HEAVY >= F.col("nn")
    heavy = F.broadcast(tx.where(often))
    rest = xy.join(heavy.select("x"), "x", "left_anti").join(tx.where(~often), "x")
    both = xy.join(heavy, "x").select(*rest.columns).unionByName(rest)
    return both.select("x", "y", "n", F.log(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny"))).alias("pmi"))


TOKENS = 2_000_000  # tokens whose pairs are counted together


def pair_counts(sents: DataFrame, width: int) -> DataFrame:
    """(x, y, both, n): parts of what `cooccurrence` counts, summed over some two million tokens each.  Where `both`
    is set, the same count holds for y and x, and x stands before y."""

    def count(t: pa.Table) -> pa.RecordBatch:
        lists = t.column("tokens").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        d = lists.flatten().dictionary_encode(null_encoding="encode")
        first, wide = len(d.dictionary), len(d.dictionary) + 2  # the pads come after all tokens
        n = int(size.sum())
        order = pc.sort_indices(d.dictionary).to_numpy()
        place = np.empty(first, np.int64)
        place[order] = np.arange(first)
        padded = np.full(n + 2 * width * len(size), first, np.int64)
        sent = np.repeat(np.arange(len(size)), size)
        padded[np.arange(n) + width * (2 * sent + 1)] = place[d.indices.to_numpy(zero_copy_only=False)]
        after = np.cumsum(size + 2 * width) - width
        padded[(after[:, None] + np.arange(width)).ravel()] = first + 1
        inner, outer = [], []
        for o in range(1, width + 1):
            a, b = padded[:-o], padded[o:]
            x, y = a < first, b < first
            low, high = np.minimum(a, b), np.maximum(a, b)
            inner.append((low * wide + high)[x & y])
            outer.append((low * wide + high)[x != y])
        pairs, m = np.unique(np.concatenate(inner), return_counts=True)
        ends, k = np.unique(np.concatenate(outer), return_counts=True)
        same = pairs // wide == pairs % wide
        x, y = np.concatenate([pairs // wide, ends // wide]), np.concatenate([pairs % wide, ends % wide])
        both = np.concatenate([~same, np.zeros(len(ends), bool)])
        words = pa.concat_arrays([d.dictionary.take(pa.array(order)).cast(pa.string()), pa.array([" BOS", " EOS"])])
        times = np.concatenate([np.where(same, 2 * m, m), k]).astype(np.int64)
        return pa.RecordBatch.from_arrays([words.take(pa.array(x)), words.take(pa.array(y)), pa.array(both), pa.array(times)], names=["x", "y", "both", "n"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in it:
            kept.append(batch)
            n += len(batch.column("tokens").flatten())
            if n >= TOKENS:
                yield from parts(count(pa.Table.from_batches(kept)))
                kept, n = [], 0
        if n:
            yield from parts(count(pa.Table.from_batches(kept)))

    def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, b.num_rows, 100_000):
            yield b.slice(a, 100_000)

    view = sents.where(F.size("tokens") > 0).select(F.transform("tokens", F.lower).alias("tokens"))
    return view.mapInArrow(run, "x string, y string, both boolean, n long")


def pruned_cooccurrence(sents: DataFrame, width: int, least: int) -> DataFrame:
    """`cooccurrence` with the contexts that have `least` in all.  Pairs are summed in one direction and written once;
    frequent contexts, which have nearly all rows, are kept without a shuffle."""
    sums = stored(pair_counts(sents, width).groupBy("x", "y", "both").agg(F.sum("n").alias("n")))
    cooc = sums.select("x", "y", "n").unionByName(sums.where("both").select(F.col("y").alias("x"), F.col("x").alias("y"), "n"))
    kept = cut(cooc.groupBy("y").agg(F.sum("n").alias("m")).where(F.col("m") >= least))
    kept = kept.crossJoin(F.broadcast(kept.agg(F.sum("m").alias("nn"))))  # the total is a single row
    often = F.col("m") * HEAVY >= F.col("nn")
    heavy, light = F.broadcast(kept.where(often).select("y")), kept.where(~often).select("y")
    rest = cooc.join(heavy, "y", "left_anti").join(light.hint("shuffle_hash"), "y", "left_semi")
    return cooc.join(heavy, "y", "left_semi").select("x", "y", "n").unionByName(rest.select("x", "y", "n"))
