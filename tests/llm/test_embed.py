import numpy as np

from sluice.llm import embed


def brute(rows):
    ok = {}
    for i, v, l in rows:
        if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault((i, l, tuple(v)), None)
    ok = list(ok)
    links = {}
    for a in ok:
        for b in ok:
            if a[0] != b[0] and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], float), np.array(b[2], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links.setdefault(a[0], set()).add(b[0])
    comp = {}
    for i in links:
        if i not in comp:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            comp.update(dict.fromkeys(seen, min(seen)))
    return {i: (len(links.get(i, ())), comp.get(i, i)) for i, _, _ in rows}


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as rep", "2 as key")
    got = embed.link(df).collect()
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows])
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (*want[r.vec_id], r.vec_id == want[r.vec_id][1])


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for g in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 30)):
            rows.append((n, [float(x) for x in base + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 0.4])], int(g % 2)))
            n += 1
    check(spark, rows)


def test_window_smaller_than_the_table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(300):
        base = rng.standard_normal(32)
        rows += [(3 * g + k, [float(x) for x in base + 0.15 * rng.standard_normal(32) * (k > 0)], 0) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want, got = brute([(i, [float(np.float32(x)) for x in v], l) for i, v, l in rows]), embed.link(df, window=16).collect()
    links = sum(n for n, _ in want.values())
    assert links > 300 and sum(r.n_links for r in got) >= 0.99 * links
    assert all(r.n_links <= want[r.vec_id][0] for r in got)


def test_dense_group_in_many_blocks(spark, capsys):
    """10000 vectors of one label, most of them in one dense group, with small windows and blocks."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    x = np.vstack([base + 0.25 * rng.standard_normal((7000, 16)), rng.standard_normal((3000, 16))]).astype(np.float32)
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1, keepdims=True))
    want = np.concatenate([(unit[k : k + 1000] @ unit.T >= 0.93).sum(axis=1) - 1 for k in range(0, len(x), 1000)])
    df = spark.createDataFrame([(k, v.tolist(), "a") for k, v in enumerate(x)], "vec_id long, embedding array<float>, label string")
    got = np.zeros(len(x), int)
    for r in embed.link(df, window=128, block=1000).collect():
        got[r.vec_id] = r.n_links
    assert want.max() > 3000 and (got <= want).all()
    with capsys.disabled():
        print(f" recall of links among 10000 vectors of a label: {got.sum() / want.sum():.5f}", end="")
    assert got.sum() >= 0.999 * want.sum()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-0.0, 1.0], 1), (14, [0.0, 1.0], 1), (1, [1.0, 0.0], 1),
    ])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed.link(empty).count() == 0
