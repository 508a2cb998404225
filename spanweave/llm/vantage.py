"""Nearest neighbours through vantage-point trees: one over a sample that parts the space, one for each shard."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._batch import spread
from ._session import arrow_map, cut, integral, numbered

K, LEAF, PER_SHARD, FACTOR = 10, 64, 16_384, 0.9
QUERY_ROWS, QUERY_BLOCK = 2_048, 16_384
SAMPLE, REGION_POINTS = 8_192, 8


class Tree:
    """A vantage-point tree: each inner node splits its points at the median distance from one of them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.ids, self.x, self.sq = ids, x, (x * x).sum(axis=1)
        self.nodes: list[tuple] = []
        self.root = self._grow(np.arange(len(ids)), leaf, np.random.default_rng(seed))
        self.regions = {m: i for i, m in enumerate(m for m, n in enumerate(self.nodes) if len(n) == 1)}

    def _grow(self, at: np.ndarray, leaf: int, rng) -> int:
        if len(at) > leaf:
            v = int(at[rng.integers(len(at))])
            d = distances(self.x[at], self.sq[at], self.x[v : v + 1], self.sq[v : v + 1])[:, 0]
            mu = float(np.median(d))
            near = d < mu
            if near.any() and not near.all():
                # the greatest and least distances on both sides bound what each can hold
                me = len(self.nodes)
                self.nodes.append(())
                a, b = self._grow(at[near], leaf, rng), self._grow(at[~near], leaf, rng)
                self.nodes[me] = (v, mu, float(d[near].max()), float(d[~near].min()), a, b)
                return me
        self.nodes.append((at,))
        return len(self.nodes) - 1

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float, best_d: np.ndarray, best_i: np.ndarray) -> None:
        """Improve the k best distances and ids of each query, in place.

        A side is left out for a query if the triangle inequality puts it beyond factor · (the k-th distance so
        far): with factor 1 no nearer point can be lost.
        """
        sq = (q * q).sum(axis=1)

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            n = self.nodes[node]
            if len(n) == 1:
                at = n[0]
                d = np.round(distances(q[rows], sq[rows], self.x[at], self.sq[at]), 7)
                d[own[rows][:, None] == self.ids[at][None, :]] = np.inf
                # only queries with a point as near as their k-th so far go on
                closer = (d <= best_d[rows, -1:]) & (d < np.inf)
                some = np.flatnonzero(closer.any(axis=1))
                if not len(some):
                    return
                r, d, closer = rows[some], d[some], closer[some]
                i, width = np.broadcast_to(self.ids[at], d.shape), int(closer.sum(axis=1).max())
                if 2 * width < d.shape[1]:
                    pick = np.argpartition(~closer, width - 1, axis=1)[:, :width]
                    d, i = np.take_along_axis(np.where(closer, d, np.inf), pick, 1), np.take_along_axis(i, pick, 1)
                d, i = np.concatenate([best_d[r], d], axis=1), np.concatenate([best_i[r], i], axis=1)
                pick = np.lexsort((i, d), axis=1)[:, :k]
                best_d[r], best_i[r] = np.take_along_axis(d, pick, 1), np.take_along_axis(i, pick, 1)
                return
            v, mu, inner, outer, a, b = n
            d = distances(q[rows], sq[rows], self.x[v : v + 1], self.sq[v : v + 1])[:, 0]
            near = d < mu
            visit(a, rows[near])
            visit(b, rows[~near])
            reach = factor * best_d[rows, -1] + 1e-6
            visit(b, rows[near & (outer - d <= reach)])
            visit(a, rows[~near & (d - inner <= reach)])

        visit(self.root, np.arange(len(q)))

    def route(self, q: np.ndarray) -> np.ndarray:
        """The region (leaf) that each vector falls into."""
        sq, out = (q * q).sum(axis=1), np.zeros(len(q), np.int64)
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            n = self.nodes[node]
            if len(n) == 1:
                out[rows] = self.regions[node]
            elif len(rows):
                near = distances(q[rows], sq[rows], self.x[n[0] : n[0] + 1], self.sq[n[0] : n[0] + 1])[:, 0] < n[1]
                todo += [(n[4], rows[near]), (n[5], rows[~near])]
        return out

    def reach(self, q: np.ndarray, tau: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a region that may hold points nearer than factor · tau, by the triangle inequality."""
        sq, found = (q * q).sum(axis=1), []
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            n = self.nodes[node]
            if not len(rows):
                continue
            if len(n) == 1:
                found.append((rows, np.full(len(rows), self.regions[node])))
                continue
            d = distances(q[rows], sq[rows], self.x[n[0] : n[0] + 1], self.sq[n[0] : n[0] + 1])[:, 0]
            far = factor * tau[rows] + 1e-6
            todo += [(n[4], rows[d - n[1] <= far]), (n[5], rows[n[1] - d <= far])]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def distances(a: np.ndarray, aa: np.ndarray, b: np.ndarray, bb: np.ndarray) -> np.ndarray:
    d = aa[:, None] + bb[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _build(t: pa.Table) -> pa.Table:
    t = t.sort_by("vec_id")
    tree = Tree(t["vec_id"].to_numpy(), matrix(t["v"]))
    return pa.table({"shard": t["shard"].slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def neighbours(vectors: DataFrame, k: int = K, factor: float = FACTOR, per_shard: int = PER_SHARD, every: int = 1) -> DataFrame:
    """(vec_id, neighbor_id, distance, rank): the k nearest other vectors of the queries, by Euclidean distance
    of the vectors scaled to length 1, to 7 decimals.  Queries are all vectors, or with `every` those whose id is
    divisible by it; each is asked of all vectors.

    A vantage-point tree over about `SAMPLE` vectors, chosen by a hash, parts the space into regions; every vector goes to
    its region, and a region of more than `per_shard` (copies of one vector, say) is split by a hash.  Each
    of these shards has a vantage-point tree of all its vectors, kept as one row.  A query first searches its own
    shard; with the k-th distance found there it goes to the shards of the regions that the triangle inequality,
    relaxed by `factor`, doesn't rule out, and prunes in their trees alike.  Factor 1 gives the exact neighbours.
    A search task holds one tree and at most about `QUERY_BLOCK` queries.

    Nulls: rows with a null vec_id or vector, vectors of another dimension than most, with a null, infinite or
    NaN component or of length 0 are left out on both sides.  Rows that repeat a vec_id count once (the least vector).
    Ties in distance go to the smaller id.  Fewer than k others give fewer rows.  An id may be of any type that has
    an order (only integers can be chosen by `every`).  Further columns are ignored; an empty table gives an
    empty result.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    names = None
    if not integral(vectors, "vec_id"):
        names = numbered(vectors, "vec_id")
        vectors = vectors.select("vec_id", "embedding").join(names, "vec_id").select(F.col("v").alias("vec_id"), "embedding")
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = "vec_id is not null and embedding is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", v.alias("v")).where(fine).drop("embedding")
    rows = rows.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("len > 0")
    rows = rows.select("vec_id", F.transform("v", lambda x: x / F.col("len")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = cut(rows)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, neighbor_id {kind}, distance double, rank int")
    dim, n = size
    rows = rows.where(F.size("v") == dim)
    few = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(max(1, -(-n // SAMPLE)))) == 0).orderBy("vec_id").toArrow()
    points = matrix(few["v"]) if few.num_rows else np.zeros((1, dim))
    top = Tree(np.arange(len(points)), points, leaf=max(REGION_POINTS, len(points) * per_shard // n))
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(top)  # at most about SAMPLE vectors

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent.value.route(matrix(b.column(1))).astype(np.int32))], ["vec_id", "v", "region"])

    rows = cut(arrow_map(rows, place, "vec_id long, v array<double>, region int"))
    # a row for each region: a few thousand at most
    held = {r.region: -(-r["count"] // per_shard) for r in rows.groupBy("region").count().collect()}
    first = np.cumsum([0, *[held.get(i, 0) for i in range(len(top.regions))]]).astype(np.int64)
    splits = spark.createDataFrame([(i, int(first[i]), m) for i, m in held.items()], "region int, first long, parts int")
    rows = rows.join(F.broadcast(splits), "region")
    rows = rows.select("vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts"))).alias("shard"))
    trees = cut(rows.groupBy("shard").applyInArrow(_build, "shard long, tree binary"))
    asked = rows if every == 1 else rows.where(F.col("vec_id") % every == 0)

    def search(own: bool):
        def run(key, queries: pa.Table, trees_: pa.Table) -> pa.Table:
            if not queries.num_rows or not trees_.num_rows:
                return pa.table({"vec_id": pa.array([], pa.int64()), "neighbor_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
            tree = pickle.loads(trees_["tree"][0].as_py())
            ids, x = queries["vec_id"].to_numpy(), matrix(queries["v"])
            outs = []
            for a in range(0, len(ids), QUERY_ROWS):
                q, i = x[a : a + QUERY_ROWS], ids[a : a + QUERY_ROWS]
                d = np.full((len(i), k), np.inf) if own else np.repeat(queries["tau"].to_numpy()[a : a + QUERY_ROWS, None], k, 1)
                mark = np.full((len(i), k), np.iinfo(np.int64).max, np.int64)
                tree.search(q, i, k, factor, d, mark)
                ok = (mark != np.iinfo(np.int64).max) & np.isfinite(d)
                outs.append((np.repeat(i, ok.sum(axis=1)), mark[ok], d[ok]))
            a, b, d = (np.concatenate(z) for z in zip(*outs))
            return pa.table({"vec_id": a, "neighbor_id": b, "distance": d})

        return run

    def spread_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and each other shard that it has to ask."""
        parts = np.diff(first)
        for b in it:
            tau, home = b.column(3).to_numpy(), b.column(2).to_numpy()
            row, region = sent.value.reach(matrix(b.column(1)), tau, factor)
            shard = spread(first[region], parts[region])
            row = np.repeat(row, parts[region])
            other = shard != home[row]
            row, shard = row[other], shard[other]
            for a in range(0, len(row), QUERY_BLOCK):
                t = b.take(pa.array(row[a : a + QUERY_BLOCK]))
                yield pa.RecordBatch.from_arrays([pa.array(shard[a : a + QUERY_BLOCK]), t.column(0), t.column(1), t.column(3)], ["shard", "vec_id", "v", "tau"])

    out = "vec_id long, neighbor_id long, distance double"
    best = home = cut(asked.groupBy("shard").cogroup(trees.groupBy("shard")).applyInArrow(search(True), out))
    if first[-1] > 1:
        tau = home.groupBy("vec_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("tau"))
        away = asked.join(tau, "vec_id", "left").select("vec_id", "v", "shard", F.coalesce("tau", F.lit(float("inf"))).alias("tau"))
        away = cut(arrow_map(away, spread_out, "shard long, vec_id long, v array<double>, tau double"))
        blocks = away.groupBy("shard").agg(F.expr(f"cast(ceil(count(*) / {QUERY_BLOCK}) as int)").alias("blocks"))
        away = away.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(4)), "blocks")).drop("blocks")
        shown = trees.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("shard", "tree", F.col("block").cast("long").alias("block"))
        away = away.groupBy("shard", "block").cogroup(shown.groupBy("shard", "block")).applyInArrow(search(False), out)
        best = home.unionByName(away)
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbor_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("distance", F.round("distance", 6))
    if names is not None:
        best = best.join(names.select(F.col("v").alias("vec_id"), F.col("vec_id").alias("_a")), "vec_id").join(names.select(F.col("v").alias("neighbor_id"), F.col("vec_id").alias("_b")), "neighbor_id")
        return best.select(F.col("_a").alias("vec_id"), F.col("_b").alias("neighbor_id"), "distance", "rank")
    return best.select(F.col("vec_id").cast(kind).alias("vec_id"), F.col("neighbor_id").cast(kind).alias("neighbor_id"), "distance", "rank")


def neighbours_sql(k: int = K, every: int = 1) -> str:
    """The exact neighbours, each query against all vectors."""
    return f"""
WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
e AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM a),
d AS (SELECT q.vec_id, e.vec_id AS neighbor_id, round(list_distance(q.v, e.v), 7) AS d FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT vec_id, neighbor_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank FROM d)
SELECT vec_id, neighbor_id, round(d, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= {k}
"""
