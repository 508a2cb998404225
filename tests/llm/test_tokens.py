"""Token counts and segmentation against the installed libraries and brute force."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.llm import segmentation as G
from spanweave.llm import token_counts as C
from spanweave.llm._batch import chunks
from spanweave.llm._units import UnitCache
from spanweave.llm.queries import BYTE_BPE, PIECES

TEXT = st.text(alphabet=st.sampled_from(list(" \n\t'abestrvl.!$1é日　▁X")), max_size=40)


@pytest.fixture(scope="module")
def counter():
    c = C.PrefixCounter(BYTE_BPE)
    return c, UnitCache(c.make, 0)


@given(st.lists(TEXT, max_size=5))
@settings(max_examples=150, deadline=None)
def test_every_prefix(counter, texts):
    c, cache = counter
    for chunk in chunks(pa.array(texts, pa.string())):
        counts, starts = C.prefix_counts(chunk, cache)
        for t, a, b in zip(texts[chunk.first : chunk.last], starts[:-1], starts[1:]):
            want = [len(c.enc.encode_ordinary(t[:i])) for i in range(1, len(t) + 1)]
            assert counts[a:b].tolist() == want
            packed = C.pack(counts[a:b])
            assert C.unpack(packed).tolist() == want
            assert all(C.tokens_at(packed, i + 1) == n for i, n in enumerate(want))
            for budget in (0, 1, 3):
                assert C.truncate_at(packed, budget) == max([i + 1 for i, n in enumerate(want) if n <= budget], default=0)


@pytest.mark.parametrize("piece", ["$" * 300, "therefore" * 12, "日本語テキスト" * 9, " " * 100, "a", "'re", "'r", "'", "'ll", " don", "Straßenbahnhaltestelle"])
def test_dynamic_programme(counter, piece):
    c, _ = counter
    assert c.counts(piece) == [len(c.enc.encode_ordinary(piece[:i])) for i in range(1, len(piece) + 1)]


def test_pack_wide():
    import numpy as np

    counts = np.array([5, 900, 3, 4])
    assert C.unpack(C.pack(counts)).tolist() == counts.tolist()


def test_counts_odd(odd, none, counter):
    got = C.token_counts(odd, BYTE_BPE, (5,)).collect()
    texts = [r.text for r in odd.collect()]
    assert len(got) == len(texts)
    enc = counter[0].enc
    assert sorted(r.n_tokens for r in got if r.n_tokens is not None) == sorted(len(enc.encode_ordinary(t)) for t in texts if t is not None)
    assert all(r.prefix_counts is None and r.cut_5 is None for r in got if r.n_chars is None)
    assert C.token_counts(none, BYTE_BPE).count() == 0


def paths(lat, unit, n):
    u, out = unit.replace(" ", "▁"), []

    def walk(i, s, ids):
        if i == len(u):
            out.append((s, ids))
        for k in range(1, min(lat.longest, len(u) - i) + 1):
            e = lat.score.get(u[i : i + k])
            if e:
                walk(i + k, s + e[0], ids + [e[1]])
            elif k == 1:
                walk(i + 1, s + lat.unknown, ids + lat.fallback(unit[i]))

    walk(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])[:n]


@given(st.lists(st.text(alphabet=st.sampled_from(list(" abthe\né日")), max_size=9), max_size=4))
@settings(max_examples=80, deadline=None)
def test_best_segmentations(texts):
    lat, cache, more = G.worker_state(PIECES)
    for c in chunks(pa.array(texts, pa.string())):
        ids, counts, best_ids, best_counts, total, best = G.encode_chunk(c, lat, cache, more, 4)
        at = best_at = 0
        for k, t in enumerate(texts[c.first : c.last]):
            mine, path = ids[at : at + counts[k]].tolist(), best_ids[best_at : best_at + best_counts[k]].tolist()
            at, best_at = at + counts[k], best_at + best_counts[k]
            assert mine == lat.model.encode(t) and G.decode(mine, PIECES) == G.decode(path, PIECES) == t
            if t:
                want = paths(lat, " " + t, 4)
                assert [s for s, _ in best[k]] == [s for s, _ in want]
                assert total[k] == want[0][0]


def test_encode_odd(odd, none):
    got = G.encode(odd, PIECES).collect()
    assert len(got) == odd.count()
    assert all(r.round_trip for r in got if r.ids is not None)
    assert sum(r.ids is None for r in got) == odd.where("text is null").count()
    assert all(r.n_tokens == 0 and len(r.n_best) == 1 for r in got if r.ids == [])
    assert G.encode(none, PIECES).count() == 0


def test_ids_are_the_models(spark):
    """Every document's ids are those of the library."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = G.lattice(PIECES).model
    got = docs.select("doc_id", "text").join(G.encode(docs, PIECES).select("doc_id", "ids", "round_trip"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.round_trip and r.ids == model.encode(r.text) for r in got)


def test_long_units_like_short(monkeypatch):
    """The search of long units and the one of many short ones agree."""
    lat, unit = G.lattice(PIECES), " " + "therefore日x" * 40
    _, score, gap = lat.best([unit])
    monkeypatch.setattr(G, "LONG", 10)
    _, score_, gap_ = lat.best([unit])
    assert score[0] == score_[0] and gap[0] == gap_[0]
    found = lat.nbest(unit, 30)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True) and len({tuple(i) for _, i in found}) == 30


@pytest.mark.parametrize("signs, size", [("abcdefghij", 200_000), ("a", 1_000_000), ("ab日", 50_000)])
def test_long_text_without_spaces(signs, size, counter):
    """Signs without a space take time in proportion."""
    import random
    import time

    rng = random.Random(3)
    text, began = "".join(rng.choice(signs) for _ in range(size)), time.time()
    c = next(chunks(pa.array([text])))
    lat = G.lattice(PIECES)
    ids, counts, best_ids, best_counts, total, best = G.encode_chunk(c, lat, UnitCache(lat.segment, 3), {}, 4)
    assert ids.tolist() == lat.model.encode(text) and G.decode(best_ids.tolist(), PIECES) == text and len(best[0]) == 4
    assert time.time() - began < 240
    began = time.time()
    counts, _ = C.prefix_counts(c, UnitCache(counter[0].make, 0))
    assert time.time() - began < 60 and len(counts) == size
    assert counts[19_999] == len(counter[0].enc.encode_ordinary(text[:20_000]))
