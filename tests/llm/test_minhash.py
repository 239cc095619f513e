import random

import pyarrow as pa

from sluice.llm import minhash, shingles


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = [(i, brute_set(t)) for i, t in rows]
    near = {}
    for i, x in sets:
        for j, y in sets:
            if i != j and x and y and 100 * len(x & y) >= percent * len(x | y):
                near.setdefault(i, set()).add(j)
    comp = {}
    for i in near:
        if i not in comp:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            comp.update(dict.fromkeys(seen, min(seen)))
    return {(i, len(x), comp.get(i, i)) for i, x in sets}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as sketch", "1 as rep", "2 as key")
    got = minhash.groups(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_sets():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "one two THREE four", "a b c d e", "A b\tc d e f", "É é x y z É", "x" * 9000 + " y" * 9] + ["".join(rng.choice("ab \n") for _ in range(500)) for _ in range(50)]
    arr = pa.array(texts)
    old = shingles.SEGMENT
    got = [len(s) for s in shingles.shingle_sets(arr)]
    assert got == [len(brute_set(t)) for t in texts]
    whole = [s.tolist() for s in shingles.shingle_sets(arr)]
    try:
        shingles.SEGMENT = 64
        assert [s.tolist() for s in shingles.shingle_sets(arr)] == whole
        assert [s.tolist() for s in shingles.shingle_sets(arr.slice(3))] == whole[3:]
    finally:
        shingles.SEGMENT = old


def test_against_brute_force(spark):
    rng, rows, n = random.Random(2), [], 0
    for _ in range(60):
        base = ["w%d" % rng.randrange(500) for _ in range(rng.choice([3, 8, 60, 200, 600]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = "e%d" % rng.randrange(9)
            rows.append((n, " ".join(w)))
            n += 1
    check(spark, rows)


def test_odd_rows(spark):
    long = " ".join("t%d" % (k % 7000) for k in range(30_000))
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, long), (8, long + " end"), (9, None), (10, "a b c d e"), (10, "a b c d e")])
    assert minhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_group(spark):
    rng = random.Random(4)
    base = ["w%d" % k for k in range(150)]
    rows = []
    for k in range(400):
        w = list(base)
        w[rng.randrange(150)] = "x%d" % rng.randrange(40)
        rows.append((k, " ".join(w)))
    check(spark, rows + [(1000 + k, " ".join(base)) for k in range(50)])


def test_near_copies_spread_over_tasks(spark, capsys):
    """A large group of unequal near copies, more tasks than it has rows in a bucket."""
    rng = random.Random(6)
    base = ["w%d" % k for k in range(300)]
    rows = []
    for k in range(600):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            w[rng.randrange(300)] = "x%d" % rng.randrange(1000)
        rows.append((k, " ".join(w)))
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {i: c for i, _, c in brute(rows)}
    same = sum(got[i] == c for i, c in want.items()) / len(want)
    with capsys.disabled():
        print(f" share of documents in the right component: {same:.4f}", end="")
    assert same >= 0.99


def test_stage_takes_similarity_of_080(spark):
    rng, rows = random.Random(8), []
    for g in range(30):
        base = ["g%dw%d" % (g, k) for k in range(204)]
        other = list(base)
        for k in range(rng.choice([3, 4, 5])):  # 200 shingles, 5 changed for each word: 0.86, 0.82, 0.78
            other[5 + 9 * k] = "x"
        rows += [(2 * g, " ".join(base), "s"), (2 * g + 1, " ".join(other), "s")]
    out = minhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, kept string"), "").collect()
    assert {r.doc_id for r in out} == {i for i, _, c in brute([r[:2] for r in rows], 80) if i == c}
    assert all(r.kept == "s" for r in out)


def test_stage_keeps_one_of_a_group_and_of_an_id(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "b"), (3, "other words here", "c"), (3, "again other words", "c"), (4, None, "d"), (None, text, "e")]
    out = minhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted((r.doc_id for r in out), key=str) == [1, 3, 3, 4, None] and out[0].asDict().keys() == {"doc_id", "text", "lang"}


def test_every_pair_of_a_bucket_is_compared(spark, monkeypatch):
    """Where the first step proposes nothing at all, every link is found, in groups of several blocks too."""
    rng = random.Random(9)
    base = ["w%d" % k for k in range(150)]
    rows = [(k, " ".join(f"g{k // 2}{w}" for w in base) + " end" * (k % 2)) for k in range(8)]
    for k in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(150)] = "x%d" % rng.randrange(40)
        rows.append((100 + k, " ".join(w)))
    proposals = minhash._proposals
    monkeypatch.setattr(minhash, "_proposals", lambda *a: proposals(*a).where("false"))
    check(spark, rows)


def test_crowded_buckets_are_compared_once(spark, monkeypatch):
    """Rows that share many large buckets don't meet again in each; merged or not, every link is found."""
    rng = random.Random(12)
    base, rows = ["w%d" % k for k in range(150)], []
    for k in range(400):
        w = list(base)
        for _ in range(rng.choice([2, 4, 5])):
            w[rng.randrange(150)] = "x%d" % rng.randrange(4000)
        rows.append((k, " ".join(w)))
    proposals, blocked, made = minhash._proposals, minhash._blocked, {}
    monkeypatch.setattr(minhash, "_proposals", lambda *a: proposals(*a).where("false"))

    def counted(of, group, *more):
        out = blocked(of, group, *more)
        made[group] = out.count()
        return out

    monkeypatch.setattr(minhash, "_blocked", counted)
    check(spark, rows)
    # no more rows than the tables have; before, rows of a bucket of over 128 went to each of its blocks
    live = 400 * minhash.SIDES**2
    assert made["key"] < live
    rows = []
    for g in range(6):
        base = ["g%dw%d" % (g % 5, k) for k in range(60)]
        rows += [(500 * g + k, " ".join(base[k // 2 : k // 2 + 40])) for k in range(41)]
    monkeypatch.setattr(minhash, "CROWD", 2)
    monkeypatch.setattr(minhash, "NUMBERS", 8)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    check(spark, rows)
