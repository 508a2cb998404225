"""Quality classifier: perplexity under interpolated modified Kneser-Ney models of trusted text."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._batch import HashIndex
from ._session import cut, doc_view, fresh, stored
from .grams import Level, gather, of_groups, peaks, score, spread_groups, tail, word_documents, word_keys

ORDER = 5
TRAIN_DOCS = None  # all
SENT_IDS = 2_000_000  # of documents that train, sent to the executors; the texts are joined by more
UPPER = 0.995
WIDEN = 3.0  # nats; over the root of a text's bytes about two standard errors of its mean log probability
ERRORS = 1.5  # standard errors taken off a word's log odds
CLEAN = 4  # times that a share of trusted documents lost weighs a share of toxic ones found
TOXIC_LEAST = 5  # toxic documents without which a language has no limit of its own


def kneser_ney(counts: DataFrame, order: int) -> list[DataFrame]:
    """Tables by context for n = 1 … order from (m, code, n): (ctx, m, tot, gam, disc: symbol → discounted count).

    Counts of the highest order are occurrences, those below are numbers of distinct left extensions; each
    model m and group has its own three discounts by order, from its counts of counts.
    """
    bits, grp = 8 * order, F.shiftright("code", 8 * order)
    level, out = counts.select("m", "code", F.col("n").alias("c")), []
    for n in range(order, 0, -1):
        if n < order:
            level = level.groupBy("m", tail(F.col("code"), n, bits).alias("code")).agg(F.count("*").alias("c"))
        k = [F.count_if(F.col("c") == i).cast("double") for i in (1, 2, 3, 4)]
        y = F.coalesce(F.try_divide(k[0], k[0] + 2 * k[1]), F.lit(0.5))
        d = [F.coalesce(F.least(F.greatest(i - (i + 1) * y * F.try_divide(k[i], k[i - 1]), F.lit(0.1)), F.lit(i - 0.1)), F.lit(i - 0.5)) for i in (1, 2, 3)]
        discounts = level.groupBy("m", grp.alias("g")).agg(*[x.alias(f"d{i + 1}") for i, x in enumerate(d)])
        cut_by = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = level.withColumn("g", grp).join(F.broadcast(discounts), ["m", "g"]).withColumn("cut", cut_by)
        ctx = F.col("code").bitwiseAND(F.lit(~255))
        out.append(
            rows.groupBy(ctx.alias("ctx"), "m").agg(
                F.sum("c").alias("tot"),
                F.sum("cut").alias("gam"),
                F.map_from_entries(F.collect_list(F.struct(F.col("code").bitwiseAND(F.lit(255)).cast("int"), F.col("c") - F.col("cut")))).alias("disc"),
            )
        )
    return out[::-1]


def backed_off(tables: list[DataFrame], order: int) -> list[Level]:
    """The model (m = 0) as levels: the interpolated probability of every n-gram that was seen, by a join with that of
    its ending, and the weight that a context gives to what it hasn't seen."""
    bits, out, shorter = 8 * order, [], None
    for n, table in enumerate(tables, 1):
        table = table.where("m = 0")
        rows = table.select("ctx", "tot", "gam", F.explode("disc").alias("sym", "count"))
        rows = rows.select(F.col("ctx").bitwiseOR(F.col("sym").cast("long")).alias("code"), "tot", "gam", "count")
        if shorter is None:
            rows = rows.withColumn("p", F.lit(1 / 256))
        else:
            rows = rows.withColumn("up", tail(F.col("code"), n - 1, bits)).join(shorter.select(F.col("code").alias("up"), "p"), "up")
        shorter = cut(rows.select("code", ((F.col("count") + F.col("gam") * F.col("p")) / F.col("tot")).alias("p")))
        out.append(Level(shorter.select("code", F.log("p").alias("lp")), cut(table.select("ctx", F.log(F.col("gam") / F.col("tot")).alias("lb")))))
    return out


def toxic_words(texts: DataFrame, sizes: dict[tuple[int, int], int], groups: dict[str, int], errors: float = ERRORS) -> list[HashIndex]:
    """Evidence by key of `word_keys`: log odds of a word's share of toxic against trusted texts, less `errors` standard errors.

    First as it is for other texts, then for a trusted one of `texts` and for a toxic one, which doesn't count itself.
    `texts` is (m, text, lang) with m 0 for trusted and 1 for toxic ones, `sizes` their numbers by (m, group).  Words
    of less than two toxic texts and those without evidence are left out: only words of two toxic texts of a group are
    sent to be counted in the trusted ones.
    """
    n1 = word_documents(texts.where("m = 1"), groups).where("n >= 2").toArrow()
    g, n1, word = (n1[x].to_numpy() for x in ("g", "n", "word"))
    keys, n0 = word_keys(word.view(np.uint64), g.astype(np.uint64)), np.zeros(len(g))
    if len(keys):
        found = word_documents(texts.where("m = 0"), groups, HashIndex(keys, np.arange(len(keys)))).toArrow()
        n0[found["at"].to_numpy()] = found["n"].to_numpy()
    size, out = [np.array([sizes.get((m, x), 0) for x in g.tolist()]) for m in (0, 1)], []
    for less0, less1 in ((0, 0), (1, 0), (0, 1)):
        a, b = np.maximum(n0 - less0, 0), n1 - less1
        value = np.log((b + 0.5) / (size[1] - less1 + 1.0)) - np.log((a + 0.5) / (np.maximum(size[0] - less0, 0) + 1.0)) - errors * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        use = (value > 0) & (b >= 2)
        out.append(HashIndex(keys[use], value[use]))
    return out


def toxic_limits(held: DataFrame) -> DataFrame:
    """(g, tox): the limit of `peak` by group that best parts the toxic (m = 1) from the trusted rows (m = 0).

    It maximises the share of toxic rows above it less `CLEAN` times that of trusted ones, and lies midway to the next value.
    """
    by, upto = Window.partitionBy("g").orderBy("peak"), Window.partitionBy("g")
    n = held.groupBy("g", "peak").agg(*[F.count_if(F.col("m") == m).alias(f"n{m}") for m in (0, 1)])  # at most a row for each word's value
    below = [F.try_divide(F.sum(f"n{m}").over(by), F.sum(f"n{m}").over(upto)) for m in (0, 1)]
    n = n.select("g", "peak", (CLEAN * below[0] - below[1]).alias("gain"), F.lead("peak").over(by).alias("above")).where("gain is not null")
    best = n.groupBy("g").agg(F.max(F.struct("gain", "peak", "above")).alias("x"))
    return best.select("g", ((F.col("x.peak") + F.coalesce("x.above", "x.peak")) / 2).alias("tox"))


def surprise(ppl: Column, size: Column) -> Column:
    """The log of a perplexity less what a text of `size` bytes may be off by chance; limits are set on it."""
    return F.log(ppl) - F.try_divide(F.lit(WIDEN), F.sqrt(size))


class Judge:
    """A trained classifier: `rated`, the rows of `docs` (with `full` all their columns, else doc_id and lang) with
    their log probability, bytes and word evidence under the names `cols`, scored and written once; and each
    language's limits (None without any trusted document)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, order: int, train_docs: int | None, upper: float, full: bool = False):
        self.limits = None
        view = doc_view(docs, "doc_id", "lang", "text")
        kinds = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"), F.count("quality").alias("n"))
        kind = F.when((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0), 0).when(F.col("t") == 1, 1)
        kinds = kinds.where("n > 0").select("doc_id", kind.alias("m")).where("m is not null")
        known = view.where("text is not null and text <> ''").select("doc_id", "lang").join(kinds, "doc_id").distinct()
        # without a bound all documents train, and limits come from models of either half over the other half;
        # with one, documents that train have even hashes, so that others are left for the limits
        even = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0
        if train_docs is None:
            known = cut(known.select("doc_id", "lang", "m", F.when(even, 1).otherwise(2).alias("part"), F.lit(True).alias("train")))
        else:
            order_by = F.xxhash64("doc_id", F.lit(20240229)), F.col("doc_id")
            ranked = known.withColumn("r", F.row_number().over(Window.partitionBy("m", "lang", even).orderBy(*order_by)))
            known = cut(ranked.select("doc_id", "lang", "m", F.lit(0).alias("part"), (even & (F.col("r") <= train_docs)).alias("train")))
        pairs = {tuple(r) for r in known.where("m = 0 and train").select("lang", "part").distinct().collect()}
        if not pairs:
            return
        halves = {p for _, p in pairs} == {1, 2}
        if not halves:
            known = known.withColumn("part", F.lit(0))
        trusted = sorted({x for x, _ in pairs if x is not None})
        groups = {x: i for i, x in enumerate(trusted, 1)}
        step, bits = len(groups) + 1, 8 * order
        lang = F.coalesce(*[F.when(F.col("lang") == x, F.lit(i)) for x, i in groups.items()], F.lit(0)).cast("long")
        ids = known.where("train").select("doc_id", "m", "part").distinct()
        few = ids.count() <= SENT_IDS
        training = view.join(F.broadcast(ids) if few else ids, "doc_id").withColumn("g", F.col("part") * step + lang)
        training = training if few else stored(training)
        own = {g: g for g in range(3 * step)}
        counts = gather(training.where("m = 0").select("text", F.col("g").alias("lang")), order - 1, own)
        group, low = spread_groups(F.shiftright("code", bits), step), F.col("code").bitwiseAND(F.lit((1 << bits) - 1))
        counts = counts.select(F.explode(group).alias("g"), low.alias("low"), "n").groupBy(F.shiftleft("g", bits).bitwiseOR(F.col("low")).alias("code")).agg(F.sum("n").alias("n"))
        levels = backed_off(kneser_ney(cut(counts.withColumn("m", F.lit(0))), order), order)
        sizes = known.where("train").select("m", F.explode(F.array_distinct(F.array(lang, F.lit(0).cast("long")))).alias("g")).groupBy("m", "g").count()
        marks, *without = toxic_words(training, {(r.m, r.g): r["count"] for r in sizes.collect()}, groups)
        base = docs if "lang" in {c.lower() for c in docs.columns} else docs.withColumn("lang", F.lit(None).cast("string"))
        base = base if full else view
        self.cols = tuple(fresh(base, x) for x in ("_lp", "_bytes", "_peak"))
        self.rated = stored(score(base, of_groups(levels, bits, list(range(step))), groups, self.cols, marks=marks, keep=None if full else ["doc_id", "lang"]))
        if halves:  # surprise by the other half, evidence by all others
            held = [peaks(training.where(f"m = {m}"), without[m], groups, ["m", "lang"]).select("m", "lang", F.lit(None).cast("double").alias("surprise"), "peak") for m in (0, 1)]
            for p in (1, 2):
                other = F.coalesce(*[F.when(F.col("lang") == x, F.lit(i)) for x, i in groups.items() if (x, p) in pairs], F.lit(0)) + p * step
                rows = training.where((F.col("m") == 0) & (F.col("part") == 3 - p)).select("m", "text", F.col("lang").alias("_lang"), other.alias("lang"))
                rows = score(rows, of_groups(levels, bits, list(range(p * step, (p + 1) * step))), own, self.cols, keep=["m", "_lang"])
                held.append(rows.select("m", F.col("_lang").alias("lang"), self._surprise().alias("surprise"), F.lit(None).cast("double").alias("peak")))
            held = reduce(DataFrame.unionByName, held).withColumn("_train", F.lit(False))
        else:
            held = self.rated.select("doc_id", "lang", self._surprise().alias("surprise"), F.col(self.cols[2]).alias("peak"))
            held = held.join(known.select("doc_id", "m", F.col("train").alias("_train")).distinct(), "doc_id")
        held = held.where("surprise is not null or peak is not null").withColumnRenamed("lang", "_lang")
        key = F.when(F.col("_lang").isin(trusted), F.col("_lang")).otherwise(F.lit(""))
        held = cut(held.withColumn("g", F.explode(F.array_distinct(F.array(key, F.lit(""))))).select("g", "m", "surprise", "peak", "_train"))
        enough = held.groupBy("g").agg(*[F.count_if(~F.col("_train") & (F.col("m") == m)).alias(f"left{m}") for m in (0, 1)])
        held = held.join(F.broadcast(enough), "g")  # a row for each language
        clean = held.where("m = 0 and (not _train or left0 < 20)")
        toxic = held.where(f"m = 1 and (not _train or left1 < {TOXIC_LEAST}) and (g = '' or left1 >= {TOXIC_LEAST})")
        self.limits = {r["g"]: {"hi": r["hi"], "tox": None} for r in clean.groupBy("g").agg(F.expr(f"percentile(surprise, {upper})").alias("hi")).collect()}
        for r in toxic_limits(clean.unionByName(toxic).where("peak is not null")).collect():
            self.limits[r["g"]]["tox"] = r["tox"]

    def perplexity(self) -> Column:
        return F.exp(-F.col(self.cols[0]) / F.col(self.cols[1]))

    def _surprise(self) -> Column:
        return surprise(self.perplexity(), F.col(self.cols[1]))

    def _limit(self, lang, name: str):
        out = F.lit(self.limits[""][name]).cast("double")
        for g, r in self.limits.items():
            if g and r[name] is not None:
                out = F.when(lang == g, F.lit(r[name])).otherwise(out)
        return out

    def passing(self) -> DataFrame:
        """The rows of `rated` that pass."""
        lang, peak = F.coalesce("lang", F.lit("")), F.col(self.cols[2])
        tox = self._limit(lang, "tox")
        ok = (self._surprise() <= self._limit(lang, "hi")) & (peak.isNull() | tox.isNull() | (peak <= tox))
        return self.rated.where(F.coalesce(ok, F.lit(False)))


def passing_ids(docs: DataFrame, labels: DataFrame, order: int = ORDER, train_docs: int | None = TRAIN_DOCS, upper: float = UPPER) -> DataFrame:
    """(doc_id, lang, perplexity) of the documents that pass, by the rules and with the defined results of `classify`
    for nulls, empty and very long texts, ties, repeated rows and empty tables."""
    judge = Judge(docs, labels, order, train_docs, upper)
    if judge.limits is None:
        return doc_view(docs, "doc_id", "lang", "text").where("text is not null and text <> ''").select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"))
    return judge.passing().select("doc_id", "lang", judge.perplexity().alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, train_docs: int | None = TRAIN_DOCS, upper: float = UPPER) -> DataFrame:
    """The documents that pass, with all their columns and `perplexity` (renamed if there is one already).

    One byte model of order `order` for each language is trained on all trusted documents of it (quality 1, toxic 0).
    A document passes if its perplexity's log, less `WIDEN` over the root of its bytes (short texts are noisier), is at
    most the `upper` quantile of its language, and if the evidence of its most toxic word is at most the language's
    limit.  The evidence is the smoothed log odds of whole words by the toxic and the trusted documents that hold
    them, all of either, less `ERRORS` standard errors.  Quantiles are exact, over all trusted documents of the
    language, each by models of the other half of them (the halves are told by a hash of doc_id; without trusted
    documents in both, by the model itself); a half without any of a language has its model of all languages instead.
    The limit of the evidence is the one that best parts all trusted from all toxic documents, each by the evidence
    of the others.  A language with fewer than `TOXIC_LEAST` toxic documents takes the limit of all languages.

    With `train_docs` one model is trained on at most so many documents of each language and kind with an even hash,
    and limits come from all that nothing was trained on (from all trusted ones of a language, if fewer than 20 are left).

    Texts are read once to score all, and those that train once each to count bytes and words and to be held out;
    very long ones are scored whole.  The model is as large as what it is trained on; see `score` for what happens
    beyond the size that is sent.  Up to `SENT_IDS` ids of labelled documents are sent, with more their texts move.

    Languages without trusted documents, and null, share one model and one set of quantiles over the trusted
    documents of all languages.  Rows without text (null or empty) have no perplexity and don't pass.  Rows with
    a null doc_id are scored like others but never train.  A doc_id with several labels is trusted if all of
    them are.  Repeated rows are each kept or not.  Without any trusted document nothing can be judged: all rows
    with text pass, with a null perplexity.
    """
    ppl = fresh(docs, "perplexity")
    judge = Judge(docs, labels, order, train_docs, upper, full=True)
    if judge.limits is None:
        return docs.where("text is not null and text <> ''").withColumn(ppl, F.lit(None).cast("double"))
    return judge.passing().select(*docs.columns, judge.perplexity().alias(ppl))
