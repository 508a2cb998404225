"""The classifier's models and limits come from all labelled documents."""

import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_models import kneser_ney_by_force

from spanweave.llm._batch import HashIndex
from spanweave.llm.grams import gather, score
from spanweave.llm.quality import ERRORS, TRAIN_DOCS, WIDEN, Judge, backed_off, kneser_ney


def log_perplexity(p, text):
    b = b"\0\0" + text.encode()
    return -sum(math.log(p(b[i - 2 : i + 1])) for i in range(2, len(b))) / (len(b) - 2)


def test_every_label_counts(documents, labels):
    """Perplexities, evidence and quantiles against plain Python over all trusted and toxic documents."""
    docs = documents.where("length(text) < 2500").orderBy("doc_id").limit(90)
    judge = Judge(docs, labels, 3, TRAIN_DOCS, 0.9)
    mark = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    rows = docs.where("text <> ''").withColumn("even", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0).collect()
    trusted, toxic = [r for r in rows if mark.get(r.doc_id) == (1, 0)], [r for r in rows if mark.get(r.doc_id, (0, 0))[1] == 1]
    texts = defaultdict(list)
    for r in trusted:
        for key in {(r.lang, None), (None, None), (r.lang, r.even), (None, r.even)}:
            texts[key].append(r.text)
    models = {key: kneser_ney_by_force(x, 3) for key, x in texts.items()}
    model = lambda r, half: models.get((r.lang, half)) or models[None, half]
    got = {r.doc_id: r for r in judge.rated.select("doc_id", F.log(judge.perplexity()).alias("s"), F.col(judge.cols[2]).alias("peak")).collect()}
    for r in rows[:40]:
        assert abs(got[r.doc_id].s - log_perplexity(model(r, None), r.text)) < 1e-6
    for lang in {r.lang for r in trusted}:
        held = [log_perplexity(model(r, not r.even), r.text) - WIDEN / math.sqrt(len(r.text.encode())) for r in trusted if r.lang == lang]
        assert abs(judge.limits[lang]["hi"] - np.quantile(held, 0.9)) < 1e-6
    split = lambda r: set(re.findall(r"[^\x00-\x20]+", r.text))
    known = {r.lang for r in trusted}
    for r in rows[:40]:
        kinds = [[split(x) for x in kind if x.lang == r.lang or r.lang not in known] for kind in (trusted, toxic)]
        best = 0.0
        for w in split(r):
            n0, n1 = (sum(w in x for x in kind) for kind in kinds)
            if n1 >= 2:
                odds = math.log((n1 + 0.5) / (len(kinds[1]) + 1)) - math.log((n0 + 0.5) / (len(kinds[0]) + 1))
                best = max(best, odds - ERRORS * math.sqrt(1 / (n0 + 0.5) + 1 / (n1 + 0.5)))
        assert abs(got[r.doc_id].peak - best) < 1e-9


def test_large_models_go_in_parts(documents):
    """Parts of some groups give what the whole table gives, and so does the join of a group."""
    docs, groups = documents.where("length(text) < 2500").limit(40), {"de": 1, "en": 2}
    levels = backed_off(kneser_ney(gather(docs.select("text", "lang"), 2, groups, also=0).withColumn("m", F.lit(0)), 3), 3)
    rows = sum(t.count() for x in levels for t in (x.seen, x.back))
    marks = HashIndex(np.zeros(0, np.uint64), np.zeros(0))
    got = [score(docs, levels, groups, ("l", "n", "p"), marks, ["doc_id"], most).orderBy("doc_id").toPandas() for most in (rows, rows - 1, 1)]
    assert all(np.allclose(got[0].l, x.l) and (got[0].doc_id == x.doc_id).all() for x in got[1:])
