"""Corpus statistics: co-occurrence, distances, associations, rankings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cooccurrence(sents: DataFrame, width: int = 1) -> DataFrame:
    """(x, y, n): how often token y stands within `width` places of token x, sentence ends padded; lower case."""
    pad = lambda w: F.array_repeat(F.lit(w), width)
    p = F.concat(pad(" BOS"), F.transform("tokens", F.lower), pad(" EOS"))
    steps = F.array(*[F.lit(o) for o in range(-width, width + 1) if o])
    both = F.transform(F.sequence(F.lit(width), F.size("tokens") + width - 1), lambda i: F.transform(steps, lambda o: F.struct(F.get("p", i).alias("x"), F.get("p", i + o).alias("y"))))
    found = sents.where(F.size("tokens") > 0).withColumn("p", p).select(F.explode(F.flatten(both)).alias("c")).select("c.x", "c.y")
    return found.groupBy("x", "y").agg(F.count("*").alias("n"))


def term_documents(sents: DataFrame) -> DataFrame:
    """(x, y, n): tokens in lower case by document."""
    return sents.select("doc_id", F.explode("tokens").alias("t")).groupBy(F.lower("t").alias("x"), F.col("doc_id").alias("y")).agg(F.count("*").alias("n"))


def prune_contexts(cooc: DataFrame, least: int = 5) -> DataFrame:
    keep = cooc.groupBy("y").agg(F.sum("n").alias("m")).where(F.col("m") >= least).select("y")
    return cooc.join(keep, "y", "left_semi").select("x", "y", "n")


def frequent_terms(cooc: DataFrame, more_than: int) -> DataFrame:
    """Terms with a marginal above the limit, ranked by it."""
    found = cooc.groupBy("x").agg(F.sum("n").alias("m")).where(F.col("m") > more_than)
    # a single ordering, of the terms that are left only
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("m"), "x")))


def smoothed(n: Column, total: Column, support: Column, pseudo: float) -> Column:
    return (F.lit(pseudo) + n) / (F.lit(pseudo) * support + total)


def hellinger(cooc: DataFrame, left: list[str] | None = None, right: list[str] | None = None) -> DataFrame:
    """(x1, x2, d): distances of the distributions over y of all pairs of terms with a common y; others are at 1.

    The squared distance is 1 minus the sum of the roots of products over common y, so only pairs that share a
    context are ever made.  Terms that are asked for only (`left` for x1, `right` for x2) bound them further: with
    `right`, whose rows go to all executors, the terms are not shuffled by y.
    """
    total = cooc.groupBy("x").agg(F.sum("n").alias("t"))
    p = cooc.join(total, "x").select("x", "y", F.sqrt(F.col("n") / F.col("t")).alias("r"))
    a, b = p.select(F.col("x").alias("x1"), "y", F.col("r").alias("r1")), p.select(F.col("x").alias("x2"), "y", F.col("r").alias("r2"))
    if left is not None:
        a = a.where(F.col("x1").isin(left))
    if right is not None:
        b = F.broadcast(b.where(F.col("x2").isin(right)))
    both = a.join(b, "y").where("x1 <> x2").groupBy("x1", "x2").agg(F.sum(F.col("r1") * F.col("r2")).alias("bc"))
    return both.select("x1", "x2", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("bc"))).alias("d"))


def nearest(distances: DataFrame, k: int, ascending: bool = True) -> DataFrame:
    w = Window.partitionBy("x1").orderBy(F.col("d") if ascending else F.desc("d"), "x2")
    return distances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def radius_sets(distances: DataFrame, anchors: list[str], radius: float) -> dict[tuple[str, float], frozenset]:
    """For `RuleSet.radius`: the terms within the radius of each anchor."""
    rows = distances.where(F.col("x1").isin(anchors) & (F.col("d") < radius)).select("x1", "x2").collect()
    return {(a, radius): frozenset(r[1] for r in rows if r[0] == a) for a in anchors}


def entropy(cooc: DataFrame, by: str, over: str) -> DataFrame:
    """Entropy in nats of the distribution of `over` for each `by`; null for a total of 0."""
    total = F.sum("n").over(Window.partitionBy(by))
    p = F.try_divide(F.col("n"), F.col("t"))
    return cooc.groupBy(by, over).agg(F.sum("n").alias("n")).withColumn("t", total).groupBy(by).agg(F.sum(F.when(F.col("n") > 0, -p * F.log(p)).when(F.col("t") > 0, 0.0)).alias("entropy"))


def pmi(cooc: DataFrame) -> DataFrame:
    """(x, y, n, pmi) from counts."""
    tx, ty = cooc.groupBy("x").agg(F.sum("n").alias("nx")), cooc.groupBy("y").agg(F.sum("n").alias("ny"))
    total = cooc.agg(F.sum("n").alias("nn"))
    j = cooc.join(tx, "x").join(ty, "y").crossJoin(total)  # the total is a single row
    return j.select("x", "y", "n", F.log(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny"))).alias("pmi"))


def term_marginals(sents: DataFrame, terms: list[str]) -> DataFrame:
    """(y, ny, n0, n1, …): tokens of each document, and how many of them are each of the terms; nothing is exploded."""
    hits = [F.sum(F.size(F.filter("tokens", lambda t: F.lower(t) == w))).alias(f"n{k}") for k, w in enumerate(terms)]  # noqa: B023
    return sents.groupBy(F.col("doc_id").alias("y")).agg(F.sum(F.size("tokens")).alias("ny"), *hits)


def pmi_of_terms(marginals: DataFrame, terms: list[str]) -> DataFrame:
    """(x, y, n, nx, pmi) of the terms with the documents that have them, from `term_marginals`."""
    total = marginals.agg(F.sum("ny").alias("nn"), *[F.sum(f"n{k}").alias(f"t{k}") for k in range(len(terms))])
    one = F.array(*[F.struct(F.lit(w).alias("x"), F.col(f"n{k}").alias("n"), F.col(f"t{k}").alias("nx")) for k, w in enumerate(terms)])
    j = marginals.where("ny > 0").crossJoin(F.broadcast(total)).select("y", "ny", "nn", F.explode(one).alias("e")).where("e.n > 0")  # the total is a single row
    return j.select("e.x", "y", "e.n", "e.nx", F.log(F.col("e.n") * F.col("nn") / (F.col("e.nx") * F.col("ny"))).alias("pmi"))


def score_documents(marginals: DataFrame, terms: list[str]) -> DataFrame:
    """(y, score): as `rank_documents`, from `term_marginals`, in no order."""
    total = marginals.agg(F.sum("ny").alias("nn"), *[F.sum(f"n{k}").alias(f"t{k}") for k in range(len(terms))])
    part = lambda n, t: F.when(n > 0, F.log(n * F.col("nn") / (t * F.col("ny"))) * n / t).otherwise(0.0)
    parts = [part(F.col(f"n{k}"), F.col(f"t{k}")) for k in range(len(terms))]
    return marginals.where("ny > 0").crossJoin(F.broadcast(total)).select("y", sum(parts[1:], parts[0]).alias("score"))


def purity(labelled: DataFrame, by: str, label: str, target: str) -> DataFrame:
    """Per cent of labels that contain the target, and that don't, by cluster, 2 decimals."""
    hit = F.contains(F.col(label), F.lit(target)).cast("double")
    return labelled.groupBy(by).agg(F.round(F.avg(hit) * 100, 2).alias("purity"), F.round(100 - F.avg(hit) * 100, 2).alias("non_purity"))


def cluster_variance(xy: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean over documents of the squared deviations from the cluster's average count, present pairs only.

    `clusters` maps y to b.
    """
    j = xy.join(clusters, "y")
    avg = j.groupBy("b", "x").agg(F.avg("n").alias("avg"))
    per = j.join(avg, ["b", "x"]).groupBy("b", "y").agg((F.sum(F.pow(F.col("n") - F.col("avg"), 2)) / F.count("*")).alias("v"))
    return per.groupBy("b").agg(F.avg("v").alias("variance"))


def terms_in_cluster(xa: DataFrame, frequency: DataFrame, multi_word: bool = False) -> DataFrame:
    """Terms of each cluster by falling frequency."""
    out = xa.join(frequency, "x")
    return out.where(F.contains("x", F.lit(" "))) if multi_word else out


def lookup(table: DataFrame, asked: DataFrame, on: list[str], value: str, missing: float | None = None) -> DataFrame:
    """Values for asked keys; null or `missing` where there is none."""
    out = asked.join(table.select(*on, value), on, "left")
    return out if missing is None else out.withColumn(value, F.coalesce(value, F.lit(missing)))


def divergence_of(pairs: DataFrame, distances: DataFrame) -> DataFrame:
    """Divergences of pairs (x1, x2): 0 of a term with itself, 50 where unknown."""
    j = pairs.join(distances, ["x1", "x2"], "left")
    return j.select("x1", "x2", F.when(F.col("x1") == F.col("x2"), 0.0).otherwise(F.coalesce("d", F.lit(50.0))).alias("d"))


def document_counts(xy: DataFrame, terms: list[str], target: Column) -> DataFrame:
    """Distinct documents with one of the terms, of the target class and of the others."""
    hit = xy.where(F.col("x").isin(terms))
    return hit.agg(F.countDistinct(F.when(target, F.col("y"))).alias("target"), F.countDistinct(F.when(~target, F.col("y"))).alias("other"))


def rank_by_group(distances: DataFrame, group: list[str], limit: int = 200, exponent: float = 0.1, least: bool = False) -> DataFrame:
    """Terms outside a group by their generalised (or least) divergence from its members, unknown ones at 50."""
    members = distances.where(F.col("x2").isin(group) & ~F.col("x1").isin(group))
    n = len(group)
    gone = F.lit(n) - F.count("*")
    score = F.min("d") if least else F.sum(F.pow("d", F.lit(exponent))) + gone * F.pow(F.lit(50.0), F.lit(exponent))
    return members.groupBy("x1").agg(score.alias("score")).orderBy("score", "x1").limit(limit)


def rank_clusters(xb: DataFrame, terms: list[str], limit: int = 50) -> DataFrame:
    """Clusters by the PMI of terms with them, weighted by the terms' share of their counts; all clusters kept."""
    assoc = pmi(xb.select("x", F.col("b").alias("y"), "n")).where(F.col("x").isin(terms))
    total = assoc.groupBy("x").agg(F.sum("n").alias("t"))
    score = assoc.join(total, "x").groupBy("y").agg(F.sum(F.col("pmi") * F.col("n") / F.col("t")).alias("score"))
    every = xb.select(F.col("b").alias("y")).distinct()
    return every.join(score, "y", "left").select(F.col("y").alias("b"), F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "b").limit(limit)


def rank_documents(xy: DataFrame, terms: list[str], limit: int = 100) -> DataFrame:
    """Documents by the sum of the PMI of terms with them, weighted by share of counts; all documents kept."""
    assoc = pmi(xy).where(F.col("x").isin(terms))
    total = assoc.groupBy("x").agg(F.sum("n").alias("t"))
    score = assoc.join(total, "x").groupBy("y").agg(F.sum(F.col("pmi") * F.col("n") / F.col("t")).alias("score"))
    every = xy.select("y").distinct()
    return every.join(score, "y", "left").select("y", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "y").limit(limit)


def cluster_counts(xy: DataFrame, xa: DataFrame, yb: DataFrame) -> DataFrame:
    """(a, b, n): counts between clusters of terms and clusters of documents."""
    return xy.join(xa, "x").join(yb, "y").groupBy("a", "b").agg(F.sum("n").alias("n"))


def document_frequency(xy: DataFrame, yb: DataFrame) -> DataFrame:
    """(b, x, df): documents of a cluster with a term."""
    return xy.join(yb, "y").groupBy("b", "x").agg(F.countDistinct("y").alias("df"))


def generalised_mean(values: Column, exponent: float = 0.1) -> Column:
    return F.sum(F.pow(values, F.lit(exponent)))


def mark_terms(docs: DataFrame, assoc: DataFrame, threshold: float) -> DataFrame:
    """Documents with <b>term</b>(pmi) around terms longer than 2 whose PMI with them reaches the threshold.

    `assoc` is (x, y, pmi) with y a doc_id.  Longer terms first, each occurrence marked once.
    """
    @F.pandas_udf("string")
    def mark(text: pd.Series, terms: pd.Series) -> pd.Series:
        def one(t, pairs):
            if t is None or pairs is None or not len(pairs):
                return t
            table = {p["x"]: p["pmi"] for p in pairs}
            rx = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, sorted(table, key=lambda x: (-len(x), x)))) + r")(?!\w)", re.I)
            return rx.sub(lambda m: f"<b>{m[0]}</b>({table[m[0].lower()]:.2f})", t)

        return pd.Series([one(t, p) for t, p in zip(text, terms)])

    terms = assoc.where((F.length("x") > 2) & (F.col("pmi") >= threshold)).groupBy(F.col("y").alias("doc_id")).agg(F.collect_list(F.struct("x", "pmi")).alias("_t"))
    return docs.join(terms, "doc_id", "left").select("doc_id", mark("text", "_t").alias("html"))
