import hashlib
import random
import re

import pytest

from sluice.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width=10):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - width + 1)):
                wins.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    names |= wins[g]
        out.append((i, len(w), len(hit), len(names), ",".join(sorted(names))))
    return sorted(out, key=str)


def check(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' as word", "1 as w", "2 as at", "3 as mark")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as window", "2 as seen")
    got = decontam.report(d, b, **kw).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in got), key=str) == brute(docs, items)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_against_brute_force(spark, broadcast):
    rng = random.Random(1)
    vocab = ["the", "of", "Ünd", "é1"] + ["w%d" % k for k in range(30)]
    text = lambda n: rng.choice(["", " ", "!"]) + " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 11, 40]))) for k in range(15)] + [(3, text(12)), (None, text(12)), (50, None), (51, "!!"), (52, "the the the the the the the the the the the the")]
    docs = [(k, text(rng.choice([0, 5, 60]))) for k in range(30)]
    for k in range(30, 60):
        i = rng.choice(items)[1] or ""
        w = i.split(" ")
        at = rng.randrange(len(w))
        docs.append((k, text(20) + " " + " ".join(w[at:]).upper() + "; " + text(5) + " " + i))
    docs += [(70, None), (71, ""), (60, "the " * 40), (60, "the " * 40), (60, "of the"), (None, items[0][1]), (72, text(30_000) + " " + items[4][1])]
    check(spark, docs, items, broadcast=broadcast)


def test_empty_tables(spark):
    check(spark, [(1, "a b"), (2, None)], [])
    check(spark, [], [(1, "a b")])


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, "a b"), (9, "b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    (r,) = decontam.op9_decontam(spark, str(tmp_path)).collect()
    assert r.asDict() == {"doc_id": 1, "n_words": 4, "n_hit": 3, "n_items": 2, "items_sha256": hashlib.sha256(b"10,9").hexdigest(), "contaminated": True}
    assert decontam.stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() == 0
