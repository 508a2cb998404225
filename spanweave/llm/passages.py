"""Passages that documents share: anchors bring equal windows of words together, whole.

A window is 48 words.  Its anchor is the least hash of an 8-word gram in it, so equal windows have equal anchors
and meet in one place however many documents hold them; a run of windows of one document with the same anchor
travels as one segment.  Segments whose anchor occurs in a single document can't hold a shared window and are
left out before any text moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._batch import Words, chunks, gram_hashes, spread, words
from ._session import arrow_map, cut

WINDOW, GRAM = 48, 8
SEGMENTS_A_GROUP = 8_000


def window_minima(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The positions (in the chunk's words) where a window begins, and each one's anchor."""
    g = gram_hashes(w.hashes, GRAM)
    wide, width = g, 1
    need = WINDOW - GRAM + 1
    while 2 * width <= need and len(wide) > width:
        wide = np.minimum(wide[:-width], wide[width:])
        width *= 2
    rest = need - width
    if width * 2 <= need or len(wide) <= rest:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = np.minimum(wide[: len(wide) - rest], wide[rest:]) if rest else wide
    end = np.repeat(w.row_starts[1:], np.diff(w.row_starts))[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + WINDOW <= end)
    return at, low[at]


def _headers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        ids = batch.column(0).to_numpy()
        for c in chunks(batch.column(1)):
            w = words(c)
            at, low = window_minima(w)
            if not len(at):
                continue
            row = np.searchsorted(w.row_starts, at, "right") - 1
            new = np.r_[True, (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(low[first].view(np.int64)),
                    pa.array(ids[c.first + row[first]]),
                    pa.array((at - w.row_starts[row])[first].astype(np.int32)),
                    pa.array(np.diff(np.r_[first, len(at)]).astype(np.int32)),
                ],
                ["key", "doc_id", "s0", "r"],
            )


def _segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each segment of a document: (key, doc_id, s0, r, words)."""
    for batch in it:
        ids, segs = batch.column(0).to_numpy(), batch.column(2)
        for c in chunks(batch.column(1)):
            own = segs.slice(c.first, c.last - c.first)
            flat = own.flatten()
            key, s0, r = (flat.field(i).to_numpy() for i in range(3))
            row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
            w = words(c)
            a = w.row_starts[row] + s0
            begin, end = w.begin[a], w.end[a + r + WINDOW - 2]
            offs = np.r_[0, np.cumsum(end - begin)]
            for i in range(0, len(a), 4000):
                j = min(len(a), i + 4000)
                data = c.data[spread(begin[i:j], end[i:j] - begin[i:j])]
                text = pa.StringArray.from_buffers(j - i, pa.py_buffer((offs[i : j + 1] - offs[i]).astype(np.int32)), pa.py_buffer(data.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(key[i:j]), pa.array(ids[c.first + row[i:j]]), pa.array(s0[i:j]), pa.array(r[i:j]), text], ["key", "doc_id", "s0", "r", "words"])


def shared_segments(docs: DataFrame) -> tuple[DataFrame, int]:
    """Segments of anchors that at least two documents hold, and their number."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heads = arrow_map(texts, _headers, "key long, doc_id long, s0 int, r int")
    held = heads.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.collect_list(F.struct("doc_id", "s0", "r")).alias("at"))
    some = held.where("lo < hi").select("key", F.explode("at").alias("x")).select("x.doc_id", F.struct("key", "x.s0", "x.r").alias("seg"))
    by_doc = cut(some.groupBy("doc_id").agg(F.collect_set("seg").alias("segs")))
    number = by_doc.agg(F.sum(F.size("segs"))).first()[0] or 0
    joined = texts.join(by_doc, "doc_id").select("doc_id", "text", "segs")
    return arrow_map(joined, _segments, "key long, doc_id long, s0 int, r int, words string"), number


def load_segments(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A group's segments in order of (doc_id, s0): word hashes, each segment's first of them, documents, first
    words, windows.  The texts are hashed chunk by chunk, so that memory follows words and not bytes."""
    t = t.sort_by([("doc_id", "ascending"), ("s0", "ascending"), ("key", "ascending")])
    hashes, starts = [], [np.zeros(1, np.int64)]
    for c in chunks(t["words"]):
        w = words(c)
        hashes.append(w.hashes)
        starts.append(starts[-1][-1] + w.row_starts[1:])
    return np.concatenate(hashes), np.concatenate(starts), t["doc_id"].to_numpy(), t["s0"].to_numpy().astype(np.int64), t["r"].to_numpy().astype(np.int64)


def spans_table(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": doc.astype(np.int64), "begin_word": begin.astype(np.int32), "end_word": end.astype(np.int32)})


def runs(flag: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true flags in the same part: first positions, last positions."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (part[at[1:]] != part[at[:-1]])]
    first = np.flatnonzero(new)
    return at[first], at[np.r_[first[1:], len(at)] - 1]


def shared_spans(docs: DataFrame, kernel: Callable[[pa.Table], pa.Table], per_group: int = SEGMENTS_A_GROUP) -> DataFrame:
    """(doc_id, begin_word, end_word): the maximal unions of spans that `kernel` finds in groups of segments."""
    segments, number = shared_segments(docs)
    groups = max(1, -(-number // per_group))
    grouped = segments.withColumn("grp", F.pmod(F.xxhash64("key"), F.lit(groups)))
    spans = grouped.groupBy("grp").applyInArrow(kernel, "doc_id long, begin_word int, end_word int")
    before = Window.partitionBy("doc_id").orderBy("begin_word", "end_word")
    reach = F.max("end_word").over(before.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce((F.col("begin_word") > reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("span", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "span").agg(F.min("begin_word").alias("begin_word"), F.max("end_word").alias("end_word")).drop("span")


SPANS_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\\x01-\\x20]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
k AS (
  SELECT doc_id, list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: md5(array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS k
  FROM d WHERE len(w) >= {WINDOW}),
u AS (SELECT doc_id, unnest(k) AS k, unnest(range(len(k))) AS s FROM k),
r AS (SELECT k FROM u GROUP BY k HAVING min(doc_id) < max(doc_id)),
b AS (SELECT DISTINCT doc_id, s FROM u SEMI JOIN r USING (k)),
m AS (SELECT doc_id, s, coalesce((s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {WINDOW})::INT, 1) AS new FROM b),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM m)
SELECT doc_id, min(s)::INT AS begin_word, (max(s) + {WINDOW})::INT AS end_word FROM i GROUP BY doc_id, span
"""
