"""Controls over ``supplier``, ``documents``, ``orders``; streams over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.functions import text as T
from sluice.operators import control, detect, match
from sluice.plans import detect_queries as dq
from sluice.sources.tables import scratch, small, table
from sluice.streaming import streams


def _drawn(seed: int, *keys: str) -> str:
    """The SQL of ``control.draw``."""
    return f"md5('{seed}:' || " + " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"


def _moved(value: str, seed: int, key: str, group: str = "") -> str:
    """The SQL of ``control.shifted``: the next value in the drawn order, the first behind the last."""
    part = f"PARTITION BY {group} " if group else ""
    w = f"({part}ORDER BY {_drawn(seed, key)}, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"coalesce(lead({value}) OVER {w}, first_value({value}) OVER {w})"


@query("m1_derangement", f"SELECT s_suppkey, {_moved('s_name', 42, 's_suppkey')} AS moved FROM supplier")
def m1(spark, d):
    return control.deranged(table(spark, d, "supplier"), "s_suppkey", "s_name", 42).select("s_suppkey", "moved")


@query("m2_shuffled_decisions", f"SELECT o_orderkey, {_moved('o_orderstatus', 7, 'o_orderkey', 'o_orderpriority')} AS moved FROM orders")
def m2(spark, d):
    return control.shifted(table(spark, d, "orders"), "o_orderkey", "o_orderstatus", 7, ["o_orderpriority"]).select("o_orderkey", "moved")


@query("m3_corrupt_numbers", "SELECT p_partkey, 'ST02_SEALING DGT-101: ' || (3 * p_size + 7) || ' bar, 4 and 8.5 or x' || p_size || ', 28C9' AS t FROM part")
def m3(spark, d):
    t = F.concat(F.lit("ST02_SEALING DGT-101: "), "p_size", F.lit(" bar, -1.0 and .5 or x"), "p_size", F.lit(", 28C9"))
    return table(spark, d, "part").select("p_partkey", control.corrupt_numbers(t).alias("t"))


@query("m4_rotated_numbers", f"SELECT l_orderkey, {_moved('l', 3, 'l_orderkey', 'len(l)')} AS moved FROM (SELECT l_orderkey, list_sort(list(l_quantity)) AS l FROM lineitem GROUP BY l_orderkey)")
def m4(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("l"))
    return control.rotated(r, "l_orderkey", "l", 3).select("l_orderkey", "moved")


@query("m5_reversed_numbers", "SELECT o_orderkey, 'T_01 ' || o_custkey || ' then ' || o_orderkey || ' at ST' || o_orderkey AS t FROM orders")
def m5(spark, d):
    return table(spark, d, "orders").select("o_orderkey", control.reverse_numbers(F.format_string("T_01 %d then %d at ST%d", "o_orderkey", "o_custkey", "o_orderkey")).alias("t"))


@query("m6_permuted_categories", f"SELECT c_custkey, {_moved('c_mktsegment', 11, 'c_custkey', 'c_nationkey')} AS moved FROM customer")
def m6(spark, d):
    return control.shifted(table(spark, d, "customer"), "c_custkey", "c_mktsegment", 11, ["c_nationkey"]).select("c_custkey", "moved")


@query("m7_word_salad", r"SELECT item_id, array_to_string(list_transform(list_sort(list_transform(range(1, len(w) + 1), lambda i: {'d': md5('0:' || (i - 1) || ':' || w[i]), 'w': w[i]})), lambda x: x.w), ' ') AS t FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)")
def m7(spark, d):
    return table(spark, d, "benchmark").select("item_id", control.word_salad("text").alias("t"))


@query("m8_padded_numbers", "SELECT p_partkey, array_to_string(list_concat([p_size], list_filter(every, lambda x: x <> p_size)), ',') AS padded FROM part JOIN (SELECT p_brand, list_sort(list(DISTINCT p_size)) AS every FROM part GROUP BY 1) USING (p_brand)")
def m8(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.array("p_size").alias("x"))
    return control.padded(p, "p_partkey", "x", "p_brand").select("p_partkey", F.array_join(F.col("padded").cast("array<string>"), ",").alias("padded"))


@query("m9_wrong_corpus")
def m9(spark, d):
    side = lambda df, key, *c: df.groupBy(F.col(c[0]).alias(key)).agg(F.collect_list(F.struct(F.col(c[1]).cast("long").alias("id"), F.col(c[2]).cast("double").alias("value"))).alias("all"))
    s = side(table(spark, d, "supplier"), "own", "s_nationkey", "s_suppkey", "s_acctbal").withColumnRenamed("all", "left")
    c = side(table(spark, d, "customer"), "other", "c_nationkey", "c_custkey", "c_acctbal").withColumnRenamed("all", "right")
    # a row for each two nations with their rows; pairs of rows are made nowhere
    both = c.join(small(s)).where("own <> other").select(F.concat_ws(">", "own", "other").alias("pair"), "left", "right")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return match.number_assignment(both.repartition(parts, "pair"), "pair").groupBy("pair").agg(F.round(F.sum("score"), 9).alias("total"))


STRATUM = f"row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_drawn(5, 'o_orderkey')}, o_orderkey)"


@query("m11_stratified_sample", f"SELECT o_orderkey, o_orderpriority, turn FROM (SELECT *, {STRATUM} AS turn FROM orders) WHERE turn <= 20 ORDER BY turn, o_orderpriority LIMIT 20")
def m11(spark, d):
    return control.stratified(table(spark, d, "orders"), "o_orderkey", ["o_orderpriority"], 20, 5).select("o_orderkey", "o_orderpriority", "turn")


@query("m12_seeded_draw", f"SELECT c_custkey, {_drawn(1, 'c_custkey')} AS first, {_drawn(2, 'c_custkey', 'c_name')} AS second FROM customer")
def m12(spark, d):
    return table(spark, d, "customer").select("c_custkey", control.draw(1, "c_custkey").alias("first"), control.draw(2, "c_custkey", "c_name").alias("second"))


@query("i6_tumbling_windows", "SELECT event_type AS sensor, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, max(value) AS hi FROM events GROUP BY ALL")
def i6(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("sensor"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return streams.tumbling(e, "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("h28_transformed_value", "SELECT p_partkey, format('{:.12g}', 3 * p_retailprice + 7) AS v FROM part")
def h28(spark, d):
    return table(spark, d, "part").select("p_partkey", control.corrupt_numbers(F.col("p_retailprice").cast("string")).alias("v"))


def _streamed(spark, df, alarms, schema):
    """What a stream makes of a table's rows: the source is read in files, the sink is a table."""
    at, kind = scratch(spark, "stream"), "sensor string, ts timestamp, value double"
    df.select("sensor", F.col("ts").cast("timestamp").alias("ts"), "value").write.parquet(f"{at}/in")
    source = spark.readStream.schema(kind).parquet(f"{at}/in")
    run = alarms(source).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("i1_stream_alarms", f"{dq.BASE} SELECT sensor, ts, value, severity, rule_id FROM alarms")
def i1(spark, d):
    """The batch alarms from a stream that reads what there is and stops."""
    return _streamed(spark, dq.readings(spark, d), lambda s: streams.on_delay(detect.judged(s, dq.rules(spark)), dq.DELAY), streams.ALARM)


@query("i2_stream_maintenance", f"{dq.PLANT} SELECT * FROM maintained")
def i2(spark, d):
    """Stuck, drift and sustained alarms from bounded buffers."""
    drift = dq.params(spark, "drift").withColumn("span", F.col("dur_min") * 0.9)
    made = lambda s: streams.maintenance(s, dq.params(spark, "stuck"), drift, dq.params(spark, "sustained"), dq.RATIO, dq.CADENCE, span="span")
    return _streamed(spark, dq.plant(spark, d), made, streams.MAINTAINED)


@query("i4_stream_events", f'{dq.CHAIN}, {dq.event_sql()} SELECT sensor, start, "end", n_alarms FROM evs')
def i4(spark, d):
    a = dq.alarms(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    s = streams.sessions(a, f"{dq.GAP} minutes", "1 hour")
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("i5_commissioning", "SELECT event_type AS sensor, count(*) FILTER (WHERE date_diff('microsecond', (SELECT min(ts) FROM events), ts) <= 24 * 3600e6) AS commissioning, count(*) AS n FROM events GROUP BY 1")
def i5(spark, d):
    r = dq.readings(spark, d)
    r = r.join(F.broadcast(r.agg(F.min("ts").alias("origin"))))
    early = F.timestamp_diff("MICROSECOND", F.col("origin"), F.col("ts")) <= 24 * 3600 * 10**6
    return r.groupBy("sensor").agg(F.count_if(early).alias("commissioning"), F.count("*").alias("n"))
