"""Hellinger distances of all terms by products of blocks, where the contexts are few (sources, languages).

Each term is a point of one coordinate for each context.  Terms of the same distribution are one point, so what has
to be compared grows much slower than the vocabulary.  Points go in blocks to every group of queries, a task at a
time holds one group and one block.  All pairs are looked at; single precision only tells which can't be near enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kept import cut
from .stats import hellinger, nearest

CONTEXTS = 1024  # with more, the pairs are joined
BLOCK, SLICE, ROWS = 4096, 1024, 250_000
SCALE = 10**7  # distances are rounded to 7 places
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def vectors(cooc: DataFrame) -> tuple[DataFrame, int] | None:
    """(x, v): the share of each context by its number, without contexts that are null; and how many there are."""
    ys = [r.y for r in cooc.select("y").where("y is not null").distinct().limit(CONTEXTS + 1).collect()]
    if len(ys) > CONTEXTS:
        return None
    numbers = cooc.sparkSession.createDataFrame([(y, i) for i, y in enumerate(sorted(ys))], f"y {cooc.schema['y'].dataType.simpleString()}, i int")
    one = F.when(F.col("i").isNotNull(), F.struct("i", "n"))
    by = cooc.groupBy("x", "y").agg(F.sum("n").alias("n")).join(F.broadcast(numbers), "y", "left").groupBy("x").agg(F.sort_array(F.collect_list(one)).alias("v"), F.sum("n").alias("t"))
    share = F.transform("v", lambda e: F.struct(e["i"].alias("i"), (e["n"].cast("double") / F.col("t")).alias("p")))
    return by.where("size(v) > 0").select("x", share.alias("v")), len(ys)


def _blocks(points: DataFrame, width: int) -> DataFrame:
    """(b, ids, many, names, w): up to BLOCK points each, their coordinates as doubles."""
    schema = "ids binary, many binary, names array<string>, w binary"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> pa.RecordBatch:
            v = t.column("v").combine_chunks()
            inner = v.flatten()
            w = np.zeros((t.num_rows, width))
            row = np.repeat(np.arange(t.num_rows), np.diff(v.offsets.to_numpy()))
            w[row, inner.field("i").to_numpy()] = np.sqrt(inner.field("p").to_numpy())
            ids = t.column("c").to_numpy().astype(np.int64).tobytes()
            many = t.column("m").to_numpy().astype(np.int64).tobytes()
            names = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column("name").combine_chunks().cast(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([many], pa.binary()), names, pa.array([w.tobytes()], pa.binary())], names=["ids", "many", "names", "w"])

        kept = None
        for batch in it:
            t = pa.Table.from_batches([batch])
            kept = t if kept is None else pa.concat_tables([kept, t])
            while kept.num_rows >= BLOCK:
                yield out(kept.slice(0, BLOCK).combine_chunks())
                kept = kept.slice(BLOCK)
        if kept is not None and kept.num_rows:
            yield out(kept.combine_chunks())

    return cut(points.mapInArrow(run, schema).withColumn("b", F.monotonically_increasing_id()))


def _meetings(blocks: DataFrame) -> DataFrame:
    """Every block of queries (kind 0) followed by all blocks (kind 1), group by group."""
    spark = blocks.sparkSession
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)
    ids = sorted(r.b for r in blocks.select("b").collect())
    groups = max(1, min(len(ids), 4 * spark.sparkContext.defaultParallelism))
    places = spark.createDataFrame([(b, k % groups) for k, b in enumerate(ids)], "b long, g int")
    asked = blocks.join(F.broadcast(places), "b").withColumn("kind", F.lit(0)).drop("b")
    every = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("kind", F.lit(1)).drop("b")
    return asked.unionByName(every).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "kind")


class _Block:
    def __init__(self, r: dict, width: int):
        self.ids, self.many = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["many"], np.int64)
        self.w = np.frombuffer(r["w"], np.float64).reshape(-1, width)
        self.names = r["names"]


def _groups(it: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[_Block], "_Block | None"]]:
    """(blocks of queries of the group, each block in turn); None when the group ends."""
    at, asked = None, []
    for batch in it:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            r = {n: one.column(n)[0].as_py() for n in ("g", "kind", "ids", "many", "w")} | {"names": one.column("names").flatten()}
            if r["g"] != at:
                if at is not None:
                    yield asked, None
                at, asked = r["g"], []
            if r["kind"] == 0:
                asked.append(_Block(r, width))
            else:
                yield asked, _Block(r, width)
    if at is not None:
        yield asked, None


def rounded(bc: np.ndarray) -> np.ndarray:
    return np.floor(np.sqrt(np.maximum(0.0, 1.0 - bc)) * SCALE + 0.5).astype(np.int64)


class Best:
    """The nearest points of some queries: as many as have `k` members, in order of (distance, number)."""

    def __init__(self, block: _Block, a: int, b: int, k: int):
        self.ids, self.w, self.k = block.ids[a:b], block.w[a:b], k
        self.small = self.w.astype(np.float32)
        n = len(self.ids)
        self.slack = max(4e-6, 1.2e-7 * self.w.shape[1])
        self.floor = np.full(n, 1e-30, np.float32)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # query, distance, id, members
        self.fresh = True

    def look(self, c: _Block, small: np.ndarray) -> None:
        s = self.small @ small.T
        if self.fresh and s.shape[1] > self.k:
            least = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            self.floor = np.maximum(self.floor, least - np.float32(self.slack))
            self.fresh = False
        q, j = np.divmod(np.flatnonzero(s >= self.floor[:, None]), s.shape[1])
        if not len(q):
            return
        bc = np.einsum("ij,ij->i", self.w[q], c.w[j])
        ok = bc > 0
        q, j, d = q[ok], j[ok], rounded(bc[ok])
        rows = [np.concatenate([x, y]) for x, y in zip(self.rows, (q, d, c.ids[j], c.many[j]))]
        order = np.lexsort((rows[2], rows[1], rows[0]))
        q, d, i, m = (x[order] for x in rows)
        if not len(q):
            return
        at = np.arange(len(q))
        new = np.append(True, q[1:] != q[:-1])
        level = new | np.append(True, d[1:] != d[:-1])
        start, step = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(level, at, 0))
        before = np.cumsum(m) - m
        members = before[step] - before[start]  # of points that are nearer
        keep = (members < self.k) & (at - start < self.k)
        self.rows = [x[keep] for x in (q, d, i, m)]
        enough = (before + m - before[start] >= self.k) & keep
        q, d = q[enough], d[enough]
        first = np.append(True, q[1:] != q[:-1]) if len(q) else np.zeros(0, bool)
        worst = 1.0 - ((d[first] + 0.5) / SCALE) ** 2 - self.slack
        self.floor[q[first]] = np.maximum(self.floor[q[first]], worst.astype(np.float32))


def nearest_terms(cooc: DataFrame, k: int) -> DataFrame:
    """(x1, x2, d, rank): the k nearest terms of each among all with a common context, by (d, x2), d to 7 places."""
    cooc = cut(cooc)
    got = vectors(cooc)
    if got is None:
        return nearest(hellinger(cooc).withColumn("d", F.round("d", 7)), k)
    terms, width = got
    # of a point, k + 1 terms are enough for any query, one of its own too
    named = terms.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("x"))).where(F.col("r") <= k + 1)
    points = named.groupBy("v").agg(F.sort_array(F.collect_list("x")).alias("names"))
    points = points.withColumn("name", F.element_at("names", 1)).orderBy("name")
    points = cut(points.select(F.monotonically_increasing_id().alias("c"), "v", "name", "names", F.size("names").alias("m")))
    blocks = _blocks(points.select("c", "m", F.lit("").alias("name"), "v"), width)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[Best] = []
        for asked, block in _groups(it, width):
            if block is None:
                for b in best:
                    q, d, i, _ = b.rows
                    yield pa.RecordBatch.from_arrays([pa.array(b.ids[q]), pa.array(i), pa.array(d / SCALE)], names=["c1", "c2", "d"])
                best = []
                continue
            best = best or [Best(x, a, min(a + SLICE, len(x.ids)), k + 1) for x in asked for a in range(0, len(x.ids), SLICE)]
            small = block.w.astype(np.float32)
            for b in best:
                b.look(block, small)

    pairs = _meetings(blocks).mapInArrow(run, "c1 long, c2 long, d double")
    far = pairs.join(points.select(F.col("c").alias("c2"), "names"), "c2").select("c1", F.explode(F.transform("names", lambda x: F.struct(F.col("d"), x.alias("x2")))).alias("e"))
    lists = far.groupBy("c1").agg(F.slice(F.sort_array(F.collect_list("e")), 1, k + 1).alias("es"))
    own = terms.join(points.select("v", F.col("c").alias("c1")), "v").select(F.col("x").alias("x1"), "c1")
    out = own.join(lists, "c1").select("x1", F.posexplode(F.slice(F.filter("es", lambda e: e["x2"] != F.col("x1")), 1, k)).alias("rank", "e"))
    return out.select("x1", "e.x2", "e.d", (F.col("rank") + 1).alias("rank"))


def all_distances(cooc: DataFrame) -> DataFrame:
    """(x1, x2, d) of all pairs of terms with a common context, d to 7 places."""
    cooc = cut(cooc)
    got = vectors(cooc)
    if got is None:
        return hellinger(cooc).withColumn("d", F.round("d", 7))
    terms, width = got
    blocks = _blocks(terms.select(F.lit(0).cast("long").alias("c"), F.lit(1).alias("m"), F.col("x").alias("name"), "v"), width)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, block in _groups(it, width):
            if block is None:
                continue
            step = max(1, ROWS // len(block.ids))
            for x in asked:
                for a in range(0, len(x.ids), step):
                    bc = x.w[a : a + step] @ block.w.T
                    q, j = np.nonzero(bc > 0)
                    x1, x2 = x.names.take(pa.array(q + a)), block.names.take(pa.array(j))
                    t = pa.RecordBatch.from_arrays([x1, x2, pa.array(rounded(bc[q, j]) / SCALE)], names=["x1", "x2", "d"])
                    yield t.filter(pc.not_equal(x1, x2))

    return _meetings(blocks).mapInArrow(run, "x1 string, x2 string, d double")
