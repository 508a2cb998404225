"""The algebra of spans as joins, windows and aggregations on (doc_id, sent_id, begin, end).

Joins have the sentence as equality key and the extents as residual condition, so one shuffle by sentence serves
a whole tree of operators.  Operand spans of `match_in` … `count_in` must be of rules whose matches don't depend
on the scope (token tests, or spans found in the scopes beforehand).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "sent_id"]


def scopes(sents: DataFrame) -> DataFrame:
    """One span for each sentence, all of it."""
    return sents.select(*KEY, F.lit(0).alias("begin"), F.size("tokens").alias("end")).where("end > 0")


def _two(f: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame, list[Column]]:
    f, p = f.alias("f"), p.select(*KEY, "begin", "end").alias("p")
    return f, p, [F.col(f"f.{k}") == F.col(f"p.{k}") for k in KEY]


def _c(text: str) -> Column:
    return F.expr(text)


INSIDE = "p.begin >= f.begin and p.end <= f.end"
NEAR = "(f.begin - p.end between 0 and {k} or p.begin - f.end between 0 and {k})"
BEFORE = "f.begin - p.end between 0 and {k}"
AFTER = "p.begin - f.end between 0 and {k}"
OVERLAP = "f.begin < p.end and p.begin < f.end"
COVERED = "f.begin >= p.begin and f.end <= p.end"


def pairs(f: DataFrame, p: DataFrame, condition: str, extent: str = "f") -> DataFrame:
    """One row for each pair of a sentence that meets the condition, with the extent of one side."""
    f, p, on = _two(f, p)
    return f.join(p, [*on, _c(condition)]).select(*[F.col(f"f.{k}") for k in KEY], F.col(f"{extent}.begin").alias("begin"), F.col(f"{extent}.end").alias("end"))


def having(f: DataFrame, p: DataFrame, condition: str, invert: bool = False) -> DataFrame:
    """Spans of f with (without) a span of p in the same sentence that meets the condition."""
    cols = f.columns
    f, p, on = _two(f, p)
    return f.join(p, [*on, _c(condition)], "left_anti" if invert else "left_semi").select(*[F.col(f"f.{c}") for c in cols])


def match_in(p: DataFrame, f: DataFrame) -> DataFrame:
    return pairs(f, p, INSIDE, "p")


def filter_in(p: DataFrame, f: DataFrame, invert: bool = False) -> DataFrame:
    return having(f, p, INSIDE, invert)


def prefix(p: DataFrame, f: DataFrame, invert: bool = False) -> DataFrame:
    return having(f, p, "p.end = f.begin", invert)


def suffix(p: DataFrame, f: DataFrame, invert: bool = False) -> DataFrame:
    return having(f, p, "p.begin = f.end", invert)


def near(p: DataFrame, k: int, f: DataFrame, invert: bool = False) -> DataFrame:
    return having(f, p, NEAR.format(k=k), True) if invert else pairs(f, p, NEAR.format(k=k))


def precedes(p: DataFrame, k: int, f: DataFrame) -> DataFrame:
    return pairs(f, p, BEFORE.format(k=k))


def follows(p: DataFrame, k: int, f: DataFrame) -> DataFrame:
    return pairs(f, p, AFTER.format(k=k))


def count_in(p: DataFrame, n: int, f: DataFrame, invert: bool = False) -> DataFrame:
    """Spans of f with at least n spans of p inside (fewer, inverted)."""
    f, p, on = _two(f, p)
    cols = [F.col(f"f.{k}") for k in (*KEY, "begin", "end")]
    found = f.join(p, [*on, _c(INSIDE)], "left").groupBy(*cols).agg(F.count("p.begin").alias("n"))
    return found.where(F.col("n") < n if invert else F.col("n") >= n).drop("n")


def union(*feeds: DataFrame) -> DataFrame:
    """Extents of any feed, with the number of spans that have them."""
    every = reduce(DataFrame.unionByName, [f.select(*KEY, "begin", "end") for f in feeds])
    return every.groupBy(*KEY, "begin", "end").agg(F.count("*").alias("members"))


def intersection(*feeds: DataFrame) -> DataFrame:
    """Extents that all feeds have."""
    every = reduce(DataFrame.unionByName, [f.select(*KEY, "begin", "end", F.lit(i).alias("feed")) for i, f in enumerate(feeds)])
    found = every.groupBy(*KEY, "begin", "end").agg(F.count("*").alias("members"), F.countDistinct("feed").alias("feeds"))
    return found.where(F.col("feeds") == len(feeds)).drop("feeds")


def difference(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Extents of the first feed that no other has."""
    left = first.groupBy(*KEY, "begin", "end").agg(F.count("*").alias("members"))
    for o in others:
        left = left.join(o.select(*KEY, "begin", "end").distinct(), [*KEY, "begin", "end"], "left_anti")
    return left


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    return pairs(left, right, OVERLAP)


def contains(left: DataFrame, right: DataFrame) -> DataFrame:
    return pairs(left, right, INSIDE)


def contained_by(left: DataFrame, right: DataFrame) -> DataFrame:
    return pairs(left, right, COVERED)


def connects(paths: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths (raw begin and end) from a token of a left span to one of a right span."""
    p = paths.select(*KEY, "begin", "end").alias("p")
    x = left.alias("x")
    y = right.alias("y")
    on = lambda a: [F.col(f"p.{k}") == F.col(f"{a}.{k}") for k in KEY]
    found = p.join(x, [*on("x"), _c("p.begin >= x.begin and p.begin < x.end")]).join(y, [*on("y"), _c("p.end >= y.begin and p.end < y.end")])
    return found.select(*[F.col(f"p.{k}") for k in KEY], F.col("p.begin").alias("begin"), F.col("p.end").alias("end"))


def widen(f: DataFrame, p: DataFrame, condition: str) -> DataFrame:
    """The hull of each pair that meets the condition."""
    f, p, on = _two(f, p)
    return f.join(p, [*on, _c(condition)]).select(*[F.col(f"f.{k}") for k in KEY], F.least("f.begin", "p.begin").alias("begin"), F.greatest("f.end", "p.end").alias("end"))


def merge(f: DataFrame) -> DataFrame:
    """Overlapping spans of a sentence as one."""
    w = Window.partitionBy(*KEY).orderBy("begin", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = f.withColumn("_new", F.coalesce((F.col("begin") >= reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*KEY, "_part").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_part")


def runs(test: DataFrame, least: int = 1) -> DataFrame:
    """Maximal runs of at least `least` one-token spans: the phrase of one repeated test."""
    w = Window.partitionBy(*KEY).orderBy("begin")
    parts = test.withColumn("_part", F.col("begin") - F.row_number().over(w))
    found = parts.groupBy(*KEY, "_part").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_part")
    return found.where(F.col("end") - F.col("begin") >= least)


def when(sents: DataFrame, flags: dict[str, Column], condition: str, order: str = "sent_id", doc: str = "doc_id") -> DataFrame:
    """Sentences before which, in their document, the condition over flags ("seen earlier") holds."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = sents.select("*", *[F.coalesce(F.max(F.coalesce(c, F.lit(False))).over(before), F.lit(False)).alias(n) for n, c in flags.items()])
    return seen.where(condition).drop(*flags)


def leftmost(spans: DataFrame) -> DataFrame:
    """Spans that don't overlap the span before them in order of (begin, end), whether that one stays or not."""
    w = Window.partitionBy(*KEY).orderBy("begin", "end", *[c for c in ("rule",) if c in spans.columns])
    return spans.withColumn("_end", F.lag("end").over(w)).where("_end is null or begin >= _end").drop("_end")
