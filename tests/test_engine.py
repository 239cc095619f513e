"""Detectors, matching, files and streams against plain models; no LLM operator is needed here."""

import datetime as dt
import itertools
import random
import statistics
import subprocess
import sys
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice import catalog
from sluice.functions import cache
from sluice.functions import text as T
from sluice.operators import control, detect, intervals, match
from sluice.sources import files
from sluice.streaming import streams

T0 = dt.datetime(2024, 1, 1)
RULES = "ord int, rule_id string, cls string, sensor string, warn_hi double, crit_hi double, warn_lo double, crit_lo double"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def frame(spark, rows):
    return spark.createDataFrame([(s, at(m), v) for s, m, v in rows], "sensor string, ts timestamp_ntz, value double")


def severity(v, r):
    _, _, _, _, wh, ch, wl, cl = r
    if (ch is not None and v > ch) or (cl is not None and v < cl):
        return "CRITICAL"
    if (wh is not None and v > wh) or (wl is not None and v < wl):
        return "WARNING"
    return None


def model_threshold(rows, rules, delay):
    start, out = {}, []
    for s, m, v in sorted(rows, key=lambda r: (r[0], r[1])):
        best = None
        for r in rules:
            if r[3] == s and (x := severity(v, r)) and (best is None or (x == "CRITICAL" and best[0] == "WARNING")):
                best = (x, r[1])
        if best is None:
            start[s] = None
            continue
        if start.get(s) is None:
            start[s] = m
        if m - start[s] >= (0 if best[0] == "CRITICAL" else delay):
            out.append((s, at(m), v, *best))
    return sorted(out)


def test_threshold_across_slices(spark):
    rng, rules = random.Random(1), [(1, "a", "ThresholdRule", "s0", 5.0, 9.0, None, 0.5), (2, "b", "ThresholdRule", "s0", 4.0, None, 1.0, None), (3, "c", "ThresholdRule", "s1", 5.0, 5.0, None, None)]
    rows = []
    for s in ("s0", "s1", "s2"):
        m = 0
        for k in range(300):
            m += rng.choice([1, 7, 200, 1500])
            rows.append((s, m, rng.choice([0.0, 2.0, 4.5, 5.0, 6.0, 10.0]) if k % 60 < 40 else 6.0))
    got = detect.threshold_alarms(frame(spark, rows), spark.createDataFrame(rules, RULES), 5.0).collect()
    assert sorted((r.sensor, r.ts, r.value, r.severity, r.rule_id) for r in got) == model_threshold(rows, rules, 5.0)


def test_telemetry_refuses_other_columns(spark):
    with pytest.raises(ValueError):
        detect.telemetry(frame(spark, [("s", 0, 1.0)]).withColumn("label", F.lit(1)))
    assert detect.telemetry(frame(spark, [("s", 0, float("nan")), ("s", 1, 1.0)])).count() == 1


def test_stuck_and_sustained(spark):
    rng = random.Random(2)
    rows = [("s", 3 * k, float(rng.choice([1, 1, 1, 2]))) for k in range(400)]
    p = spark.createDataFrame([("s", "r3", 3, "W"), ("s", "r5", 5, "W")], "sensor string, rule_id string, n int, severity string")
    got = {(r.rule_id, r.ts) for r in detect.stuck_alarms(frame(spark, rows), p).collect()}
    v = [x for _, _, x in rows]
    assert got == {(f"r{n}", at(rows[k][1])) for n in (3, 5) for k in range(n - 1, len(v)) if max(v[k - n + 1 : k + 1]) - min(v[k - n + 1 : k + 1]) < 1e-6}
    q = spark.createDataFrame([("s", "u", True, 1.5, 6, "W"), ("s", "d", False, 1.5, 9, "W")], "sensor string, rule_id string, upper boolean, threshold double, dur_min int, severity string")
    want = set()
    for rid, up, need in (("u", True, 6), ("d", False, 9)):
        start = None
        for _, m, x in rows:
            if not (x > 1.5 if up else x < 1.5):
                start = None
                continue
            start = m if start is None else start
            if m - start >= need:
                want.add((rid, at(m)))
    assert {(r.rule_id, r.ts) for r in detect.sustained_alarms(frame(spark, rows), q).collect()} == want


def test_drift(spark):
    rng = random.Random(3)
    rows, m = [], 0
    for k in range(250):
        m += rng.choice([1, 2, 5])
        rows.append(("s", m, rng.gauss(0, 1) + (6 if k > 150 else 0)))
    p = spark.createDataFrame([("s", "r", 2.0, 20, "W")], "sensor string, rule_id string, delta double, dur_min int, severity string")
    want, recent, ref = set(), [], []
    for _, m, v in rows:
        recent.append((m, v))
        while recent[0][0] < m - 20:
            ref.append(recent.pop(0)[1])
        last = ref[-15:]
        if len(last) >= 10 and len(recent) >= 2 and abs(statistics.mean(x for _, x in recent) - statistics.median(last)) >= 2.0 and m - recent[0][0] >= 20:
            want.add(at(m))
    got = {r.ts for r in detect.drift_alarms(frame(spark, rows), p, 15 * 60 / (20 * 60), 60).collect()}
    assert want and got == want


def test_merge_keeps_a_gap_of_exactly_the_limit(spark):
    a = spark.createDataFrame([("s", at(m), x, "threshold", r) for m, x, r in [(0, "WARNING", "b"), (15, "CRITICAL", "a"), (30.02, "WARNING", "a")]], "sensor string, ts timestamp_ntz, severity string, detector string, rule_id string")
    got = sorted((r.n_alarms, r.severity, r.rule_ids) for r in intervals.merge_alarms(a, 15).collect())
    assert got == [(1, "WARNING", ["a"]), (2, "CRITICAL", ["a", "b"])]


def test_coverage_of_nested_events_and_empty_windows(spark):
    ev = spark.createDataFrame([("s", at(a), at(b), ["t"], ["r"]) for a, b in [(0, 10), (2, 4), (20, 25), (90, 99)]], "sensor string, start timestamp_ntz, end timestamp_ntz, detectors array<string>, rule_ids array<string>")
    w = spark.createDataFrame([("g1", "s", "x", at(5), at(25)), ("g2", "s", "x", at(22), at(22)), ("g3", "s", "x", at(50), at(60))], "gt_id string, sensor string, atype string, gt_start timestamp_ntz, gt_end timestamp_ntz")
    got = {r.gt_id: (r.status, r.coverage_pct, r.latency_min) for r in intervals.coverage(ev, w).collect()}
    assert got == {"g1": ("DETECTED", 50.0, 0.0), "g2": ("DETECTED", 100.0, 0.0), "g3": ("MISSED", 0.0, None)}
    assert intervals.unmatched(ev, w).count() == 2


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, m = rng.integers(1, 7, 2)
        s = np.round(rng.random((n, m)), 1)
        got = match.assign(s)
        assert len(got) == min(n, m) and len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        wide = s if n <= m else s.T
        best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert abs(sum(s[a, b] for a, b in got) - best) < 1e-9
    assert match.assign(np.zeros((0, 3))) == []


def test_controls(spark):
    df = spark.createDataFrame([(k, "v%d" % k) for k in range(20)], "k long, v string")
    out = control.deranged(df, "k", "v", 42).collect()
    assert all(r.moved != r.v for r in out) and sorted(r.moved for r in out) == sorted(r.v for r in out)
    assert {tuple(r) for r in control.deranged(df.repartition(5), "k", "v", 42).collect()} == {tuple(r) for r in out}
    assert control.corrupt("5 bar") == "22 bar" and control.backwards("a 1 b 2") == "a 2 b 1"
    assert control.corrupt("ST02_SEALING DGT-101 -1.0 .5 7. 20°C") == "ST02_SEALING DGT-101 4 8.5 28. 67°C".replace("28. ", "28 ")
    assert control.backwards("T_01 5 of ST2, -1.5") == "T_01 -1.5 of ST2, 5"
    salad = spark.createDataFrame([("x y  z",), ("",), (None,)], "t string").select(control.word_salad("t").alias("w")).collect()
    assert sorted(salad[0].w.split(" ")) == ["x", "y", "z"] and salad[1].w == "" and salad[2].w is None
    own = spark.createDataFrame([("a", "k", [1, 2]), ("b", "k", [2, 3]), ("c", "m", [9])], "key string, corpus string, x array<int>")
    assert {r.key: r.padded for r in control.padded(own, "key", "x", "corpus").collect()} == {"a": [1, 2, 3], "b": [2, 3, 1], "c": [9]}


def test_standalone_numbers_against_the_pattern(spark):
    import re

    lines = ["-1.0 and .5 and 7.", "ST02_SEALING DGT-101", "20°C 35%RH x3 3x", "a -4, 5-6 (7) 8_9 .. 1.2.3", "", "--2 +3 1e5"]
    got = spark.createDataFrame(list(enumerate(lines)), "k int, s string").select("k", T.standalone_numbers(F.col("s")).alias("v")).collect()
    want = [[float(x) for x in re.findall(r"(?<![A-Za-z0-9_-])-?(?:\d+(?:\.\d*)?|\.\d+)(?![A-Za-z0-9_])", s, re.A)] for s in lines]
    assert [r.v for r in sorted(got, key=lambda r: r.k)] == want and want[0] == [-1.0, 0.5, 7.0] and want[1] == []


def test_repair():
    assert cache.repair('x {"a": [1, 2,') == '{"a": [1, 2]}'
    assert cache.repair('{"a": "say \\"hi\\"",}') == '{"a": "say \\"hi\\""}'
    assert cache.repair("none") is None and cache.repair(None) is None


def test_numbers_and_headings(spark):
    df = spark.createDataFrame([("GSH-401 at 7. bar", "  ## Pump Room", "one."), ("x 30.0", "Two words.", "Title")], "a string, b string, c string")
    got = df.select(T.numbers(F.col("a")).alias("n"), T.numbers(F.col("a"), True).alias("p"), T.standalone_numbers(F.col("a")).alias("s"), T.heading(F.col("b")).alias("h"), T.heading(F.col("c")).alias("c")).collect()
    assert got[0].n == [-401.0, 7.0] and got[0].p == [7.0] and got[0].h == "Pump Room" and got[0].c is None
    assert got[1].n == [30.0] and got[1].s == [30.0] and got[1].h is None and got[1].c is None


def test_files(spark, tmp_path):
    p = tmp_path / "in"
    p.mkdir()
    (p / "a.csv").write_text("﻿id,v\n1,\n2,x\n", encoding="utf-8")
    df = files.csv(spark, str(p / "a.csv"))
    assert df.columns == ["id", "v"] and [tuple(r) for r in df.orderBy("id").collect()] == [("1", ""), ("2", "x")]
    assert dict(files.csv(spark, str(p / "a.csv"), infer=True).dtypes)["id"] == "int"
    (p / "b.txt").write_text("one\ntwo WARN\n")
    (p / "c.txt").write_text("three")
    assert [r.line_no for r in files.lines(files.text_files(spark, str(p))).orderBy("source_file", "line_no").collect()] == [1, 2, 1]
    assert files.log_lines(spark, str(p / "b.txt"), ["warn", "error"]).count() == 1
    (p / "d.json").write_text('[{"device": {"id": 3}},\n {"device": {"id": 4}}]')
    assert {r.i for r in files.json(spark, str(p / "d.json")).select(F.col("device.id").alias("i")).collect()} == {3, 4}
    with zipfile.ZipFile(p / "e.zip", "w") as z:
        for n in ("x/1.csv", "2.csv", "3.txt"):
            z.writestr(n, "-")
    assert {(r.member, r.ending) for r in files.zip_members(spark, str(p / "e.zip")).collect()} == {("x/1.csv", "csv"), ("3.txt", "txt")}
    files.write_csv(files.canonical(df.withColumn("a", F.lit(1)), ["v"]), str(tmp_path / "out"))
    files.write_csv(files.canonical(df.withColumn("a", F.lit(1)), ["v"]), str(tmp_path / "out"), "append")
    back = files.csv(spark, str(tmp_path / "out"))
    assert back.columns == ["v", "a", "id"] and back.count() == 4
    files.write_json(df, str(tmp_path / "js"))
    assert spark.read.json(str(tmp_path / "js")).count() == 2
    assert files.report(df, df.withColumn("w", F.lit("1")), "id").columns == ["id", "v", "w"]


def test_streams_equal_batch(spark, tmp_path):
    rng, rules = random.Random(6), [(1, "a", "ThresholdRule", "s0", 5.0, 9.0, None, None), (2, "b", "ThresholdRule", "s1", 4.0, None, None, None)]
    rows = [(s, 2 * k, float(rng.choice([1, 5.5, 6, 10]))) for s in ("s0", "s1") for k in range(120)]
    df = frame(spark, rows).withColumn("ts", F.col("ts").cast("timestamp"))
    for k, (lo, hi) in enumerate([(0, 80), (80, 160), (160, 999)]):
        part = df.where((F.col("ts") >= F.lit(at(lo))) & (F.col("ts") < F.lit(at(hi)))).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    rule_df = spark.createDataFrame(rules, RULES)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.on_delay(detect.judged(source, rule_df), 5.0).writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("alarms").select("sensor", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "severity", "rule_id").collect()
    assert sorted(tuple(r) for r in got) == model_threshold(rows, rules, 5.0)


def test_queries_are_registered_with_matching_names():
    assert len(catalog.QUERIES) > 150 and set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_works_without_the_llm_folder(tmp_path):
    code = "import sys; sys.modules['sluice.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') for q in e.queries()); assert 'pipeline' not in e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_assignment_against_every_permutation(spark):
    """Groups of several shapes, a pair that is missing, and one that is given twice."""
    rng, rows, tables = np.random.default_rng(3), [], {}
    for g in range(30):
        m = np.round(rng.random((rng.integers(1, 6), rng.integers(1, 6))), 3)
        tables[g] = m
        rows += [(g, int(i) * 3, int(j) + 100, float(m[i, j])) for i, j in np.ndindex(m.shape)]
    rows += [(0, 0, 100, 0.0), (99, 1, 1, 0.5), (99, 2, 2, 0.25)]
    got = match.assignment(spark.createDataFrame(rows, "corpus long, gt int, pred int, score double"), "corpus").collect()
    for g, m in tables.items():
        own = [(r.gt // 3, r.pred - 100, r.score) for r in got if r.corpus == g]
        wide = m if m.shape[0] <= m.shape[1] else m.T
        best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert len(own) == min(m.shape) == len({r for r, _, _ in own}) == len({c for _, c, _ in own})
        assert sum(s for _, _, s in own) == pytest.approx(best) and all(m[r, c] == s for r, c, s in own)
    assert sorted((r.gt, r.pred, r.score) for r in got if r.corpus == 99) == [(1, 1, 0.5), (2, 2, 0.25)]


def test_clusters_and_wrong_corpora_read_all_ids(spark, tmp_path):
    # a rule beyond 60 and a run beyond 3
    rows = [(1, 5, 900, 7, 10.0, 0.1), (2, 6, 900, 7, 10.0, 0.1), (3, 6, 900, 7, 40.0, 0.2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, catalog.QUERIES["l7_greedy_clusters"](spark, str(tmp_path)).collect())) == [(9000000007, 1, 1), (9000000007, 2, 1)]
    spark.createDataFrame([(1, 7, 5.0), (2, 8, 6.0)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(900, 8, 5.0), (901, 7, 6.0)], "c_custkey long, c_nationkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted(map(tuple, catalog.QUERIES["m9_wrong_corpus"](spark, str(tmp_path)).collect())) == [("7>8", 1.0), ("8>7", 1.0)]


def test_ordinals_of_whole_tables(spark, tmp_path):
    spark.range(100_003).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(100_003).select((2 * F.col("id")).alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    out = catalog.QUERIES["c10_join_by_ordinal"](spark, str(tmp_path))
    assert out.count() == 100_003 and out.where("2 * c_custkey + s_suppkey <> 2 * 100002").count() == 0


def test_streamed_maintenance_over_several_batches(spark, tmp_path):
    """Bounded buffers carry on from batch to batch: the alarms are those of the whole table."""
    import datetime as dt

    rng, rows = np.random.default_rng(8), []
    for sensor, step in (("s", 7), ("t", 11)):
        for k in range(400):
            rows.append((sensor, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=step * k), float(np.floor(rng.normal(20, 3)) + (12 if 150 < k < 220 else 0))))
    rows.sort(key=lambda r: r[1])
    kind = "sensor string, ts timestamp, value double"
    for k in range(4):
        spark.createDataFrame(rows[k * 200 : k * 200 + 200], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stuck = spark.createDataFrame([("A", "s", 3, "WARNING")], "rule_id string, sensor string, n int, severity string")
    drift = spark.createDataFrame([("B", "s", 4.0, 60, "WARNING", 50.0), ("C", "t", 4.0, 90, "CRITICAL", 70.0)], "rule_id string, sensor string, delta double, dur_min int, severity string, span double")
    sustained = spark.createDataFrame([("D", "t", True, 24.0, 30, "WARNING"), ("E", "s", False, 19.5, 14, "WARNING")], "rule_id string, sensor string, upper boolean, threshold double, dur_min int, severity string")
    whole = spark.createDataFrame(rows, kind)
    want = detect.stuck_alarms(whole, stuck).unionByName(detect.drift_alarms(whole, drift, 2.0, 420.0, span="span")).unionByName(detect.sustained_alarms(whole, sustained))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    alarms = streams.maintenance(source, stuck, drift, sustained, 2.0, 420.0, span="span")
    run = alarms.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert len([p for p in run.recentProgress if p["numInputRows"]]) == 4
    key = lambda r: (r.sensor, r.ts, r.value, r.severity, r.detector, r.rule_id)
    got, batch = (sorted(map(key, df.collect())) for df in (spark.read.schema(streams.MAINTAINED).parquet(f"{tmp_path}/out"), want))
    assert got == batch and {x[4] for x in got} == {"stuck", "drift", "sustained"}


def test_cosines_of_blocks(spark):
    """As the column function, odd vectors too; equal vectors have equal scores."""
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [0.0, 0.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [2.0, 4.0]), (8, []), (9, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    pairs = v.toDF("a", "x").crossJoin(v.toDF("b", "y")).select("a", "b", match.cosine(F.col("x"), F.col("y")).alias("s"))
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert plain(match.cosines(v, v)) == plain(pairs)
    best = [(r.item, r.score) for r in match.cosines(v.where("id = 1"), v.where("id not in (6, 7)").coalesce(1), 2).collect()]
    assert sorted(best) == [(1, best[0][1]), (9, best[0][1])]


def test_numbers_are_assigned_as_by_all_pairs(spark, tmp_path):
    """Totals of the dense solver, on ties, repeated, negative and tiny numbers; nations of 1500 and 40 000 rows in time."""
    rng = np.random.default_rng(4)
    make = [
        lambda n: rng.normal(0, 10, n).round(), lambda n: rng.uniform(-1000, 10000, n), lambda n: np.exp(rng.normal(0, 2, n)),
        lambda n: rng.integers(-2, 3, n) * 4e-10, lambda n: np.repeat(rng.normal(5, 3, n).round(1), 3)[:n], lambda n: rng.choice([1.0, np.nan, np.inf, -2.0], n),
    ]
    for k in range(300):
        x, y = (make[k % len(make)](int(n)) for n in rng.integers(0, 14, 2))
        i, j, score = match.assign_numbers(x, y)
        with np.errstate(invalid="ignore"):
            m = np.nan_to_num(match.closeness(x[:, None], y))
        assert len(set(i)) == len(set(j)) == len(i) == min(len(x), len(y)) and m[i, j] == pytest.approx(score)
        assert score.sum() == pytest.approx(sum(m[r, c] for r, c in match.assign(m)), abs=1e-9)
    balance = [float(v) for v in rng.uniform(-1000, 10000, 40000).round(2)]
    spark.createDataFrame([(k, k % 2, balance[k]) for k in range(3000)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    both = [(n * 100_000 + k, n, v) for n in (0, 1) for k, v in enumerate(balance)]
    spark.createDataFrame(both, "c_custkey long, c_nationkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    began = time.time()
    got = catalog.QUERIES["m9_wrong_corpus"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("0>1", 1500.0), ("1>0", 1500.0)] and time.time() - began < 30
    # a key that has two values is one record
    spark.createDataFrame([(1, 7, 5.0), (1, 7, 6.0)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/two/supplier.parquet")
    spark.createDataFrame([(9, 8, 6.0), (10, 8, 5.0)], "c_custkey long, c_nationkey long, c_acctbal double").write.parquet(f"{tmp_path}/two/customer.parquet")
    assert [tuple(r) for r in catalog.QUERIES["m9_wrong_corpus"](spark, f"{tmp_path}/two").collect()] == [("7>8", 1.0)]


def test_jaccard_of_blocks(spark, tmp_path):
    """As the column function on odd rows too; 5000 long texts against 200 items in time."""
    rows = [(1, ["a", "b"]), (2, None), (3, []), (4, ["b", "c", "d"]), (5, ["é"]), (6, ["a", "b"]), (6, ["z"])]
    v = spark.createDataFrame(rows, "id long, v array<string>")
    pairs = v.toDF("query", "x").crossJoin(v.toDF("item", "y")).select("query", "item", T.jaccard(F.col("x"), F.col("y")).alias("score"))
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert plain(match.jaccards(v, v)) == plain(pairs) and match.jaccards(v.where("false"), v).count() == 0
    text = lambda n: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(4000)).cast("string"))), " ")
    spark.range(5_000).select(F.col("id").alias("doc_id"), text(400).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(200).select(F.col("id").alias("item_id"), text(200).alias("text")).write.parquet(f"{tmp_path}/benchmark.parquet")
    began = time.time()
    got = catalog.QUERIES["h11_jaccard"](spark, str(tmp_path)).agg(F.count("*"), F.max("j")).first()
    assert got[0] == 1_000_000 and got[1] <= 1 and time.time() - began < 30


def test_similar_names_as_in_sql(spark, tmp_path, monkeypatch):
    """Repeated, empty, long and non-ASCII names, a key held by two rows, in one block and in several."""
    import duckdb

    rng = random.Random(3)
    names = ["", "é", "è", "large ring", "large rings", "x" * 70, "x" * 69 + "y", None] + ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(12)]
    rows = [(k // 2 if k < 8 else k, rng.choice(names), rng.choice(["B", None]) if k % 9 == 0 else "B", k % 2) for k in range(240)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(db.execute(catalog.ORACLES["c22_similar_names"]).fetchall())
    for block in (1024, 16):
        monkeypatch.setattr(match, "BLOCK_OF_NAMES", block)
        assert sorted(map(tuple, catalog.QUERIES["c22_similar_names"](spark, str(tmp_path)).collect())) == want and len(want) > 100
