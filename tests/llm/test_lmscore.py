import math
from collections import Counter

import numpy as np
import pyarrow as pa

from sluice.llm import lmscore as lm
from sluice.llm import shingles


def brute(rows, good):
    """The same models from plain counts; exact while no two bigrams share a cell."""
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        w = (t or "").lower().split()
        for k in [0] + [1] * (i in good):
            uni[k].update(w)
            bi[k].update(zip(w, w[1:]))
    size = len(uni[0]) + 1
    out = []
    for i, t in rows:
        w, loss = (t or "").lower().split(), [0.0, 0.0]
        for k in (0, 1):
            total = sum(uni[k].values()) + lm.ADDED * size
            for j, x in enumerate(w):
                p = (uni[k][x] + lm.ADDED) / total
                if j:
                    p = lm.MIX * min(bi[k][w[j - 1], x] / max(uni[k][w[j - 1]], 1e-9), 1) + (1 - lm.MIX) * p
                loss[k] -= math.log(p) / len(w)
        out.append((i, len(w), loss[1], loss[0]))
    return out


def test_against_plain_counts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(["good", "fine", "day", "Sun", "é"] if k % 2 else ["bad", "fine", "night", "rain"], rng.integers(1, 30)))) for k in range(60)] + [(90, None), (91, ""), (3, "good day"), (None, "rain")]
    good = {k for k in range(40) if k % 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as good", "2 as n")
    labels = spark.createDataFrame([(k, ) for k in good] + [(1,), (None,)], "doc_id long")
    out = lm.score(docs, lm.fit(lm._marked(docs, labels))).collect()
    got = sorted(((r.doc_id, r.n_tokens, round(r.loss_target, 6), round(r.loss_background, 6)) for r in out), key=str)
    want = sorted(((i, n, round(a, 6), round(b, 6)) for i, n, a, b in brute(rows, good)), key=str)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and np.allclose(g[2:], w[2:], atol=1e-5)
    score = {r.doc_id: r.score for r in out}
    assert np.mean([score[k] for k in range(41, 60, 2)]) < np.mean([score[k] for k in range(40, 60, 2)])


def test_small_vocabulary_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a a a b c"), (2, "c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert all(np.isfinite(r.score) for r in lm.score(docs, lm.fit(lm._marked(docs, none))).collect())
    empty = docs.limit(0)
    assert lm.score(empty, lm.fit(lm._marked(empty, none))).count() == 0
    w = next(shingles.word_hashes(pa.array(["a b"])))[1]
    assert lm._ids(w, np.sort(w[:1])).tolist() == [0, 1]
