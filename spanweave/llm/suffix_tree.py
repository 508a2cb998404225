"""Language-model scores from a probabilistic suffix tree over bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._session import cut, doc_view, fresh
from .grams import Level, gather, score, tail

DEPTH, MIN_COUNT, DIVERGENCE, BETA = 5, 64, 0.02, 2.0


def grow(counts: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, divergence: float = DIVERGENCE) -> list[DataFrame]:
    """The tree's contexts by length 0 … depth, each a table (ctx, total, next: symbol → count).

    A context is retained if it occurs `min_count` times and the Kullback-Leibler divergence of its next-symbol
    distribution from that of its longest proper suffix reaches `divergence` nats, or if it is a suffix of a
    retained context.
    """
    bits = 8 * (depth + 1)
    levels = [counts]
    for n in range(depth, 0, -1):
        levels.append(cut(levels[-1].groupBy(tail(F.col("code"), n, bits).alias("code")).agg(F.sum("n").alias("n"))))
    levels = levels[::-1]
    base = F.col("code").bitwiseAND(F.lit(~255))
    totals = [x.withColumn("total", F.sum("n").over(Window.partitionBy(base.alias("c")))) for x in levels]
    wanted: list[DataFrame] = []
    for n in range(1, depth + 1):
        above = totals[n - 1].select(F.col("code").alias("up"), F.col("n").alias("up_n"), F.col("total").alias("up_total"))
        both = totals[n].withColumn("up", tail(F.col("code"), n, bits)).where(F.col("total") >= min_count).join(above, "up")
        gain = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("up_total") / (F.col("total") * F.col("up_n")))
        apart = both.groupBy(base.alias("ctx")).agg(F.sum(gain).alias("kl")).where(F.col("kl") >= divergence)
        wanted.append(apart.select("ctx"))
    tree, closed = [], None
    for n in range(depth, -1, -1):
        parts = ([wanted[n - 1]] if n else []) + ([closed] if closed is not None else [])
        kept = reduce(DataFrame.unionByName, parts).distinct() if n else None
        rows = levels[n].withColumn("ctx", base)
        rows = rows.join(kept, "ctx", "left_semi") if n else rows
        symbol = F.struct(F.col("code").bitwiseAND(F.lit(255)).cast("int"), F.col("n"))
        tree.append(cut(rows.groupBy("ctx").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(symbol)).alias("next"))))
        closed = tree[-1].select(tail(F.col("ctx"), n, bits).bitwiseAND(F.lit(~255)).alias("ctx")) if n else None
    return tree[::-1]


def states(tree: list[DataFrame], beta: float = BETA) -> list[Level]:
    """The tree's states as levels: the log probability of every symbol seen in a state, and the weight of its parent.

    A state's distribution is smoothed with its parent's: (count + beta · parent's) / (total + beta); the root's
    with the uniform one over 256 bytes.  A symbol that a state hasn't seen has beta / (total + beta) of its parent's.
    """
    bits, out, parents = 8 * len(tree), [], None
    for n, level in enumerate(tree):
        rows = level.select("ctx", "total", F.explode("next").alias("sym", "n"))
        rows = rows.select(F.col("ctx").bitwiseOR(F.col("sym").cast("long")).alias("code"), "total", "n")
        if parents is None:
            rows = rows.withColumn("p", F.lit(1 / 256))
        else:  # what was seen after a context was seen after its suffix, and suffixes of states are states
            rows = rows.withColumn("up", tail(F.col("code"), n, bits)).join(parents.select(F.col("code").alias("up"), "p"), "up")
        parents = cut(rows.select("code", ((F.col("n") + beta * F.col("p")) / (F.col("total") + beta)).alias("p")))
        out.append(Level(parents.select("code", F.log("p").alias("lp")), level.select("ctx", F.log(beta / (F.col("total") + beta)).alias("lb"))))
    return out


def tree_scores(docs: DataFrame, train: DataFrame | None = None, depth: int = DEPTH, min_count: int = MIN_COUNT, divergence: float = DIVERGENCE, beta: float = BETA) -> DataFrame:
    """(doc_id, n_bytes, log_prob, bits_per_byte) of every row of `docs` under a suffix tree of `train` (or `docs`).

    Symbols are the bytes of the texts, all of them, and contexts up to `depth` bytes don't reach over the
    beginning of a text; a zero byte in a text counts like its beginning.  Seven bytes of context and the symbol fill
    a code of 64 bits, which is the most that `depth` can be.  Very long texts are counted and scored whole.

    Nulls: a null doc_id keeps its row; null and empty texts have 0 bytes, no log_prob and no bits_per_byte.
    Repeated rows and ties are rows like others, each counted and scored.  Further columns are ignored.  Trained
    on an empty table every byte has probability 1/256.
    """
    view = doc_view(docs, "doc_id", "text")
    counts = cut(gather(doc_view(docs if train is None else train, "text"), depth))
    levels = states(grow(counts, depth, min_count, divergence), beta)
    lp, size = fresh(view, "log_prob"), fresh(view, "n_bytes")
    out = score(view, levels, None, (lp, size, "_none"), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(size, F.lit(0)).alias("n_bytes"), F.round(lp, 3).alias("log_prob"), F.round(-F.col(lp) / F.col(size) / 0.6931471805599453, 6).alias("bits_per_byte"))


def tree_sql(depth: int = DEPTH, min_count: int = MIN_COUNT, divergence: float = DIVERGENCE, beta: float = BETA) -> str:
    """The scores of all documents under a tree of all documents, over hexadecimal texts."""
    ctes = [
        f"h AS (SELECT doc_id, row_number() OVER () AS r, repeat('00', {depth}) || hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL)",
        f"p AS (SELECT doc_id, r, substr(x, 2 * i + 1, {2 * depth + 2}) AS code FROM (SELECT doc_id, r, x, unnest(range(length(x) // 2 - {depth})) AS i FROM h))",
        "c AS (SELECT code, count(*) AS n FROM p GROUP BY 1)",
    ]
    for d in range(depth + 1):
        ctes.append(f"l{d} AS (SELECT right(code, {2 * d + 2}) AS code, left(right(code, {2 * d + 2}), {2 * d}) AS ctx, sum(n) AS n FROM c GROUP BY 1, 2)")
        ctes.append(f"t{d} AS (SELECT *, sum(n) OVER (PARTITION BY ctx) AS total FROM l{d})")
    for d in range(depth, 0, -1):
        own = f"SELECT a.ctx FROM t{d} a JOIN t{d - 1} b ON b.code = right(a.code, {2 * d}) WHERE a.total >= {min_count} GROUP BY 1 HAVING sum(a.n / a.total * ln(a.n * b.total / (a.total * b.n))) >= {divergence}"
        ctes.append(f"k{d} AS ({own}{f' UNION SELECT right(ctx, {2 * d}) FROM k{d + 1}' if d < depth else ''})")
    ctes.append("k0 AS (SELECT '' AS ctx)")
    ctes.append("s AS (SELECT code, 1 / 256 AS q FROM c)")
    before = "s"
    for d in range(depth + 1):
        ctes.append(
            f"q{d} AS (SELECT s.code, CASE WHEN k.ctx IS NULL THEN q ELSE (coalesce(t.n, 0) + {beta} * q) / (u.total + {beta}) END AS q FROM {before} s "
            f"LEFT JOIN k{d} k ON k.ctx = left(right(s.code, {2 * d + 2}), {2 * d}) "
            f"LEFT JOIN (SELECT DISTINCT ctx, total FROM t{d}) u ON u.ctx = k.ctx LEFT JOIN t{d} t ON t.code = right(s.code, {2 * d + 2}))"
        )
        before = f"q{d}"
    ctes.append(f"z AS (SELECT r, count(*) AS n, sum(ln(q)) AS lp FROM p JOIN q{depth} USING (code) GROUP BY 1)")
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, coalesce(z.n, 0) AS n_bytes, round(lp, 3) AS log_prob, round(-lp / z.n / ln(2), 6) AS bits_per_byte "
        "FROM h LEFT JOIN z USING (r) UNION ALL SELECT doc_id, 0, NULL, NULL FROM documents WHERE text IS NULL"
    )
