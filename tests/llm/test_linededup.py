import random

from sluice.llm import linededup as ld


def edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return 9
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b))
    return min((1 for k in range(len(b)) if b[:k] + b[k + 1 :] == a), default=9)


def brute(rows):
    lines = sorted({(i if i is not None else -1, k, s) for i, t in rows if t is not None for k, s in enumerate(t.split("\n"))})
    gone, before = set(), []
    for i, k, s in lines:
        w = s.split(" ")
        if len(w) < ld.LEAST_WORDS:
            continue
        for v in before:
            if v == w or (min(len(v), len(w)) >= ld.NEAR_WORDS and edit(v, w) <= 1):
                gone.add((i, k))
                break
        before.append(w)
    return gone


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as line", "1 as mark", "2 as n_lines", "3 as g_x")
    got = ld.clean(df).collect()
    assert len(got) == len(rows)
    gone = brute(rows)
    want = []
    for i, t in rows:
        ls = [] if t is None else t.split("\n")
        keep = [s for k, s in enumerate(ls) if (i if i is not None else -1, k) not in gone]
        want.append((i, None if t is None else "\n".join(keep), len(ls), len(ls) - len(keep)))
    assert sorted(((r.doc_id, r.text, r.n_lines_, r.n_dropped) for r in got), key=str) == sorted(want, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    bases = [["w%d" % rng.randrange(40) for _ in range(rng.choice([1, 4, 5, 7, 8, 9, 20, 60]))] for _ in range(40)]
    rows = []
    for d in range(70):
        ls = []
        for _ in range(rng.choice([1, 3, 8])):
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k, p = rng.randrange(3), rng.randrange(len(w))
                if k == 0:
                    w[p] = "e%d" % rng.randrange(4)
                elif k == 1:
                    w.insert(p, "e%d" % rng.randrange(4))
                elif len(w) > 1:
                    del w[p]
            ls.append(" ".join(w))
        rows.append((d, "\n".join(ls)))
    check(spark, rows)


def test_odd_rows(spark):
    line = "one two three four five six seven eight nine"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, line), (4, line), (5, line + "\n" + line), (None, "a b c d e"), (6, "a b c d e\nshort\nshort"), (7, " ".join("x%d" % k for k in range(20_000))), (8, "  " * 20)]
    check(spark, rows)
    assert ld.clean(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_keeps_columns(spark):
    line = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(1, line, "en", 44), (2, line, "en", 44), (3, "own words in this one line\n" + line, "en", 70), (4, "", "en", 0)], "doc_id long, text string, lang string, n_chars long")
    out = {r.doc_id: r for r in ld.stage(spark, df, "").collect()}
    assert set(out) == {1, 3, 4} and out[3].text == "own words in this one line" and out[3].n_chars == 26 and list(out[1].asDict()) == df.columns
