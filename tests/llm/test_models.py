"""The suffix tree and the classifier against plain Python, and their behaviour on odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm._batch import HashIndex
from spanweave.llm.grams import gather, score, walk
from spanweave.llm.quality import backed_off, classify, kneser_ney, passing_ids
from spanweave.llm.suffix_tree import grow, states, tree_scores


def tree_by_force(train, texts, depth, min_count, divergence, beta):
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    for t in train:
        b = b"\0" * depth + t.encode()
        for i in range(depth, len(b)):
            for n in range(depth + 1):
                counts[n][b[i - n : i]][b[i]] += 1
    keep = {b""}
    for n in range(1, depth + 1):
        for ctx, c in counts[n].items():
            total, up = sum(c.values()), counts[n - 1][ctx[1:]]
            kl = sum(v / total * math.log(v * sum(up.values()) / (total * up[x])) for x, v in c.items())
            if total >= min_count and kl >= divergence:
                keep |= {ctx[j:] for j in range(len(ctx) + 1)}

    def p(ctx, x):
        out = 1 / 256
        for n in range(depth + 1):
            s = ctx[len(ctx) - n :]
            if s in keep:
                c = counts[n][s]
                out = (c[x] + beta * out) / (sum(c.values()) + beta)
        return out

    scores = []
    for t in texts:
        b = b"\0" * depth + t.encode()
        scores.append(sum(math.log(p(b[i - depth : i], b[i])) for i in range(depth, len(b))))
    return scores


def test_tree(spark, documents):
    few = documents.orderBy("doc_id").limit(12)
    texts = [r.text for r in few.orderBy("doc_id").collect()]
    got = tree_scores(few, depth=3, min_count=20, divergence=0.05).orderBy("doc_id").collect()
    want = tree_by_force(texts, texts, 3, 20, 0.05, 2.0)
    assert np.allclose([r.log_prob for r in got], want, atol=1e-3)
    other = tree_scores(few, train=few.where("doc_id < 4"), depth=3, min_count=20, divergence=0.05).orderBy("doc_id").collect()
    want = tree_by_force([t for t, r in zip(texts, got) if r.doc_id < 4], texts, 3, 20, 0.05, 2.0)
    assert np.allclose([r.log_prob for r in other], want, atol=1e-3)


def test_tree_odd(odd, none):
    got = tree_scores(odd)
    assert got.count() == odd.count()
    assert got.where("n_bytes = 0").where("log_prob is not null or bits_per_byte is not null").count() == 0
    assert tree_scores(none).count() == 0
    flat = tree_scores(odd.where("doc_id = 11"), train=none).first()
    assert abs(flat.bits_per_byte - 8) < 1e-6


def test_tree_of_whole_codes(documents):
    few = documents.orderBy("doc_id").limit(5)
    texts = [r.text for r in few.orderBy("doc_id").collect()]
    got = tree_scores(few, depth=7, min_count=5, divergence=0.05).orderBy("doc_id").collect()
    assert np.allclose([r.log_prob for r in got], tree_by_force(texts, texts, 7, 5, 0.05, 2.0), atol=1e-3)


@pytest.mark.parametrize("groups", [None, {"en": 1, "fr": 2}])
def test_score_by_join(documents, groups):
    """A model too large to be sent gives the same sums by a sharded join."""
    docs = documents.select("doc_id", "lang", "text")
    levels = states(grow(gather(docs.select("text"), 3), 3, 20, 0.05))
    if groups:
        counts = gather(docs.select("text", "lang"), 2, groups, also=0).withColumn("m", F.lit(0))
        levels = backed_off(kneser_ney(counts, 3), 3)
    a, b = (score(docs, levels, groups, ("l", "n", "p"), most=m).orderBy("doc_id") for m in (10**9, 700))
    assert a.columns == b.columns
    assert np.allclose(a.toPandas()["l"], b.toPandas()["l"])


def kneser_ney_by_force(train, order):
    raw = Counter()
    for t in train:
        b = b"\0" * (order - 1) + t.encode()
        raw.update(b[i - order + 1 : i + 1] for i in range(order - 1, len(b)))
    levels = {order: raw}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def discounts(c):
        k = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] + 2 * k[1] else 0.5
        return [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0.1), i - 0.1) if k[i - 1] else i - 0.5 for i in (1, 2, 3)]

    d = {n: discounts(c) for n, c in levels.items()}
    after = {n: defaultdict(Counter) for n in levels}
    for n, c in levels.items():
        for g, v in c.items():
            after[n][g[:-1]][g[-1]] = v

    def p(g):
        out = 1 / 256
        for n in range(1, order + 1):
            c = after[n].get(g[order - n : -1])
            if c:
                total = sum(c.values())
                gamma = sum(d[n][min(v, 3) - 1] for v in c.values())
                v = c[g[-1]]
                out = ((v - d[n][min(v, 3) - 1] if v else 0) + gamma * out) / total
        return out

    return p


def loaded(levels):
    def index(df, key, value):
        t = df.select(key, value).toArrow()
        return HashIndex(t[key].to_numpy().view(np.uint64), t[value].to_numpy())

    return [(index(x.seen, "code", "lp"), index(x.back, "ctx", "lb")) for x in levels]


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(spark, documents, order):
    texts = [r.text for r in documents.orderBy("doc_id").limit(6).collect()]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = gather(df, order - 1).withColumn("m", F.lit(0))
    levels = loaded(backed_off(kneser_ney(counts, order), order))
    probe = spark.createDataFrame([(t,) for t in [texts[0], "zzz unseen é"]], "text string")
    codes = np.array([r.code for r in gather(probe, order - 1).collect()], np.uint64)
    p = kneser_ney_by_force(texts, order)
    got = np.exp(walk(codes, levels, ~((1 << 8 * order) - 1)))
    assert np.allclose(got, [p(int(c).to_bytes(order, "big")) for c in codes], atol=1e-9)


def test_probabilities_add_up(documents):
    levels = loaded(backed_off(kneser_ney(gather(documents.select("text"), 2).withColumn("m", F.lit(0)), 3), 3))
    for context in (b"th", b"\xff\xfe", b"\0\0"):
        codes = np.arange(256, dtype=np.uint64) + np.uint64(int.from_bytes(context, "big") << 8)
        assert abs(np.exp(walk(codes, levels, ~((1 << 24) - 1))).sum() - 1) < 1e-9


def test_perplexities_by_force(spark, documents, labels):
    """The query's perplexities are those of plain Python models of the same training documents."""
    from collections import defaultdict as by

    from spanweave.llm.quality import Judge

    judge = Judge(documents, labels, 3, 5, 0.995)
    rows = documents.where("text <> ''").withColumn("even", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0).withColumn("h", F.xxhash64("doc_id", F.lit(20240229))).collect()
    mark = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    train = by(list)
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id)):
        if r.even and mark.get(r.doc_id, (0, 0)) == (1, 0) and len(train[r.lang]) < 5:
            train[r.lang].append(r.text)
    models = {lang: kneser_ney_by_force(texts, 3) for lang, texts in train.items()}
    models[None] = kneser_ney_by_force([t for x in train.values() for t in x], 3)
    got = {r.doc_id: r[1] for r in judge.rated.select("doc_id", judge.perplexity()).collect()}
    for r in rows[:25]:
        p, b = models.get(r.lang) or models[None], b"\0\0" + r.text.encode()
        want = math.exp(-sum(math.log(p(b[i - 2 : i + 1])) for i in range(2, len(b))) / (len(b) - 2))
        assert abs(got[r.doc_id] - want) < 1e-6 * want


def test_classifier(spark):
    """Held-out junk and toxic documents go, clean ones stay."""
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    kept = passing_ids(docs, labels)
    rate = labels.join(kept.select("doc_id").withColumn("k", F.lit(1)), "doc_id", "left").groupBy("quality", "toxic").agg(F.avg(F.coalesce("k", F.lit(0))).alias("r"))
    rate = {(r.quality, r.toxic): r.r for r in rate.collect()}
    assert rate[1, 0] > 0.95 and rate[0, 0] < 0.3 and rate[1, 1] < 0.4


def test_classifier_odd(spark, odd, none, labels):
    marks = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, 1, 0), (7, 1, None), (8, 1, 1), (11, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = classify(odd, marks)
    assert got.columns == [*odd.columns, "perplexity_1"] and got.where("text is null or text = ''").count() == 0
    assert classify(none, marks).count() == 0 and passing_ids(none, marks).count() == 0
    all_pass = classify(odd, marks.limit(0))
    assert all_pass.count() == odd.where("text is not null and text <> ''").count()
