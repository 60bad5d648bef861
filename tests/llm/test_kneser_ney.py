"""Operator 1: counts against brute force, probabilities that sum to one, and held-out perplexity."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.llm import kneser_ney as kn


def words(t):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]


@pytest.fixture(params=["nasty", "table"])
def docs(request):
    return request.getfixturevalue("nasty") if request.param == "nasty" else request.getfixturevalue("table")("documents")


def brute(train):
    """p(w | v) of the same model from plain dictionaries."""
    big, uni = Counter(), Counter()
    for t in train:
        seq = ["<s>", *words(t), "</s>"]
        big.update(zip(seq, seq[1:], strict=False))
        uni.update(seq[1:])
    types = Counter(w for _, w in big)
    d2 = kn.discounts([sum(c == k for c in big.values()) for k in (1, 2, 3, 4)])
    d1 = kn.discounts([sum(c == k for c in types.values()) for k in (1, 2, 3, 4)])
    d = lambda ds, c: (0, *ds)[min(c, 3)]
    total, spread = Counter(), Counter()
    for (v, _), c in big.items():
        total[v] += c
        spread[v] += d(d2, c)
    left = sum(d(d1, c) for c in types.values()) / len(big)
    low = lambda w: (types[w] - d(d1, types[w])) / len(big) + left / (len(uni) + 1)

    def p(v, w):
        if not total[v]:
            return low(w)
        return (big[v, w] - d(d2, big[v, w])) / total[v] + spread[v] / total[v] * low(w)

    return p, uni


def test_scores(docs):
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    p, uni = brute([r.text for r in rows if not held(r.doc_id)])
    n, v = sum(uni.values()), len(uni)
    model = kn.train(docs.where(~kn.held_out(F.col("doc_id"))), shard_bytes=50_000)
    assert (model.n_tokens, model.n_types) == (n, v)
    want = Counter()
    for r in rows:
        seq = ["<s>", *words(r.text), "</s>"]
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in seq[1:])
        want[r.doc_id, held(r.doc_id), len(seq) - 1, sum(uni[w] > 0 for w in seq[1:]), n, round(base, 5), round(sum(math.log10(p(a, b)) for a, b in zip(seq, seq[1:], strict=False)), 5)] += 1
    got = kn.score(docs, model).withColumn("held_out", kn.held_out(F.col("doc_id"))).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want


def test_probabilities_sum_to_one(nasty):
    model = kn.train(nasty)
    known = {w for r in nasty.collect() for w in words(r.text)}
    h = kn.tokens_of([b" ".join(known)])[0]  # all words and the end
    every = np.append(h, np.uint64(12345))  # and one for all that are unknown
    scorer = kn.Scorer(model)
    for before in (kn.START, h[0], h[5], np.uint64(999)):
        assert abs(scorer.probabilities(np.full(len(every), before), every)[0].sum() - 1) < 1e-9


def test_held_out_beats_base(table):
    docs = table("documents")
    model = kn.train(docs.where(~kn.held_out(F.col("doc_id"))))
    s = kn.score(docs.where(kn.held_out(F.col("doc_id"))), model).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert s.s > s.b


def test_of_nothing(none, nasty):
    model = kn.train(none)
    assert kn.score(none, model).count() == 0
    assert all(r.score == 0 and r.n_known == 0 for r in kn.score(nasty, model).collect())
