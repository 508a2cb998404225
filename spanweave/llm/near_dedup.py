"""Near-duplicate groups by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batch import chunks, gram_hashes, mix, words
from ._session import arrow_map, cut, integral, numbered, text_key

COORDINATES, BANDS, SHINGLE, THRESHOLD = 128, 32, 3, 0.5
_ROUND = 0xA24BAED4963EE407


def sketch(sets: np.ndarray, rows: np.ndarray, n_rows: int, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches (n_rows × t) of sets given as elements and their rows.

    In round i < t every element is thrown into one hashed bin with the value i + fraction, a bin keeps its
    least value; in round t + i all elements of a set go to bin i, so that after 2t rounds no bin is empty.
    A set takes part in a round only while one of its bins is empty: large sets are done after the first.
    """
    out = np.full(n_rows * t, np.inf)
    live = np.ones(len(sets), bool)
    for i in range(2 * t):
        el, rw = sets[live], rows[live]
        if not len(el):
            break
        h = mix(el ^ np.uint64((_ROUND * (i + 1)) & (2**64 - 1)))
        value = i + (h >> np.uint64(12)).astype(np.float64) * 2.0**-52
        bins = (mix(h) % np.uint64(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        cell = rw * t + bins
        np.minimum.at(out, cell, value)
        open_ = np.isinf(out.reshape(n_rows, t)).any(axis=1)
        live &= open_[rows]
    return out.reshape(n_rows, t)


def shingle_sets(c, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word k-shingles of each row (its whole word sequence if shorter), their rows, each row's first."""
    w = words(c, fold=True)
    n_rows, per = len(c.starts) - 1, np.diff(w.row_starts)
    g = gram_hashes(w.hashes, k)
    row_of = np.repeat(np.arange(n_rows), per)
    last = np.repeat(w.row_starts[1:], per)
    inside = np.arange(len(row_of)) + k <= last
    el, rw = g[inside[: len(g)]], row_of[: len(g)][inside[: len(g)]]
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        extra = w.hashes[w.row_starts[short]].copy()
        for j in range(1, k):
            more = per[short] > j
            extra[more] = mix(extra[more] * np.uint64(3) + w.hashes[w.row_starts[short[more]] + j])
        el, rw = np.r_[el, extra], np.r_[rw, short]
    order = np.lexsort((el, rw))
    el, rw = el[order], rw[order]
    new = np.r_[True, (el[1:] != el[:-1]) | (rw[1:] != rw[:-1])] if len(el) else np.zeros(0, bool)
    el, rw = el[new], rw[new]
    return el, rw, np.searchsorted(rw, np.arange(n_rows + 1))


def _signatures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, content, bands): a digest of the shingle set and the bands' keys; texts without words give no row."""
    per_band = COORDINATES // BANDS
    for batch in it:
        ids = batch.column(0)
        for c in chunks(batch.column(1)):
            el, rw, first = shingle_sets(c)
            n = len(c.starts) - 1
            full = np.flatnonzero(np.diff(first) > 0)
            if not len(full):
                continue
            s = sketch(el, rw, n)[full].view(np.uint64).reshape(len(full), BANDS, per_band)
            key = np.zeros((len(full), BANDS), np.uint64)
            for j in range(per_band):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j])
            key = mix(key + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))
            digest = [np.add.reduceat(mix(el + np.uint64(a)), first[full]) for a in (1, 2)]
            text = np.char.add(np.char.mod("%d", digest[0]), np.char.add("/", np.char.mod("%d", digest[1])))
            bands = pa.ListArray.from_arrays(np.arange(0, key.size + 1, BANDS, dtype=np.int32), pa.array(key.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(c.first, c.last - c.first).take(pa.array(full)), pa.array(text.astype(object)), bands], ["doc_id", "content", "bands"])


def _verify(it: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of which the exact Jaccard similarity of the shingle sets reaches the threshold."""
    for batch in it:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            both = pa.concat_arrays([part.column(2).cast(pa.large_string()), part.column(3).cast(pa.large_string())])
            m, sets = part.num_rows, []
            for c in chunks(both):
                el, _, first = shingle_sets(c)
                sets += [el[first[i] : first[i + 1]] for i in range(len(c.starts) - 1)]
            keep = []
            for i in range(m):
                x, y = sets[i], sets[m + i]
                small, large = (x, y) if len(x) < len(y) else (y, x)
                if len(small) < threshold * len(large) or not len(small):
                    continue
                same = np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small)
                if same >= threshold * (len(x) + len(y) - same):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(keep)) for k in (0, 1)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root): each vertex of `edges` (a, b) with the least vertex of its connected component.

    Alternating large-star and small-star rounds, each written to the shared folder; their number grows with
    the logarithm of a component's size.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.where("a <> b").distinct()
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        joined = low.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("doc_id"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("doc_id"), F.col("b").alias("root")).distinct()
            )
        seen = mark


def near_losers(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, digest, keeper_id): each text of a doc_id that has a near copy that stays; see `near_groups`.

    The digest is null where no doc_id has more than one text.
    """
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    several = rows.groupBy("doc_id").agg(F.min(text_key()).alias("lo"), F.max(text_key()).alias("hi")).where("lo <> hi")
    if integral(docs) and not several.take(1):
        texts, names = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    else:
        keyed = rows.withColumn("digest", text_key())
        names = numbered(keyed, "doc_id", "digest")
        texts = keyed.join(names, ["doc_id", "digest"]).select(F.col("v").alias("doc_id"), "text")
    found = _groups(texts, threshold)
    if names is None:
        return found.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("binary").alias("digest"), F.col("root").cast(docs.schema["doc_id"].dataType).alias("keeper_id"))
    keeper = names.select(F.col("v").alias("root"), F.col("doc_id").alias("keeper_id"))
    return found.withColumnRenamed("doc_id", "v").join(names, "v").join(keeper, "root").select("doc_id", "digest", "keeper_id")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Near copies and the document that stays: (doc_id, keeper_id), one row for each document to remove.

    Two documents are near copies if the Jaccard similarity of their sets of word 3-shingles (ASCII letters in
    lower case) is at least `threshold`; groups are the connected components of that relation among the
    candidates, and the smallest doc_id of a group stays.  Candidates share one of `BANDS` bands of a sketch of
    `COORDINATES`.  All of them are verified on the whole shingle sets, as 64-bit hashes of the shingles, with one
    exception that can't change a group: two documents that verified pairs already connect.  For that, documents
    with equal shingle sets are joined first, each band's members are verified against its least one, and only
    pairs of a band that are still in different groups are verified after that.

    Nulls: rows with a null doc_id or text, and texts without a word, belong to no group.  Texts shorter than
    three words are one shingle.  Very long texts are sketched and verified whole.  Repeated rows count once.  A
    doc_id may be of any type that has an order; one with several texts takes part with each of them, is listed
    if one of them goes, and `keep_one` then removes that text alone.  Further columns are ignored; an empty
    table gives an empty result.
    """
    found = near_losers(docs, threshold).where("doc_id <> keeper_id")
    return found.groupBy("doc_id").agg(F.min("keeper_id").alias("keeper_id"))


def _groups(texts: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, root) of all texts (doc_id long, text) that aren't the least of their group."""
    signed = cut(arrow_map(texts, _signatures, "doc_id long, content string, bands array<long>"))
    same = signed.groupBy("content").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top"))
    equal = signed.join(same.where("top > b"), "content").where("doc_id > b").select(F.col("doc_id").alias("a"), "b").distinct()
    one = signed.join(same, "content").where("doc_id = b").select("doc_id", "bands").dropDuplicates(["doc_id"])
    members = one.select("doc_id", F.explode(F.array_distinct("bands")).alias("band"))
    heads = members.groupBy("band").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top")).where("top > b").select("band", "b")
    members = cut(members.join(heads, "band").select("band", "doc_id", "b"))  # a hot band stays many rows, a head each

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        have = cut(texts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
        x = have.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
        y = have.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
        pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        return cut(arrow_map(pairs, lambda it: _verify(it, threshold), "a long, b long"))

    star = cut(members.where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct())
    good = verified(star)
    roots = components(good)
    rest = members.join(roots, "doc_id", "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    split = rest.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    rest = cut(rest.join(split, "band", "left_semi"))
    x = rest.select("band", F.col("doc_id").alias("b"), F.col("root").alias("rb"))
    y = rest.select("band", F.col("doc_id").alias("a"), F.col("root").alias("ra"))
    cross = x.join(y, "band").where("a > b and ra <> rb").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    cross = cut(cross)
    edges = equal.unionByName(good)
    if cross.take(1):
        edges = edges.unionByName(verified(cross))
    return components(edges).where("doc_id > root")


NEAR_SQL = f"""
WITH RECURSIVE d AS (
  SELECT DISTINCT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x01-\\x20]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS g
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (
  SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
  JOIN n m ON m.doc_id = p.x JOIN n o ON o.doc_id = p.y WHERE p.c >= {THRESHOLD} * (m.n + o.n - p.c)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT x AS doc_id, min(y) AS keeper_id FROM r GROUP BY x HAVING min(y) < x
"""
