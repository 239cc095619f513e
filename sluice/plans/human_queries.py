"""Logs of people over ``orders`` and ``customer``: a role is a market segment, a zone an order's priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.operators import human, intervals, match
from sluice.sources.tables import small, table, values, values_sql

MATRIX = [(1, "BUILDING", "1-URGENT", "yes"), (2, "BUILDING", "2-HIGH", "No"), (3, "MACHINERY", "1-URGENT", "denied"), (4, "HOUSEHOLD", "3-MEDIUM", "allowed"), (5, "BUILDING", "1-URGENT", "no"), (6, "FURNITURE", "5-LOW", "maybe"), (7, "AUTOMOBILE", "5-LOW", "Y")]
M_SQL = values_sql("m0", "ord, role, zone, said", MATRIX) + ", m1 AS (SELECT *, CASE WHEN lower(said) IN ('yes', 'y', 'true', 'allowed', 'authorized') THEN true WHEN lower(said) IN ('no', 'n', 'false', 'denied', 'prohibited') THEN false END AS ok FROM m0), m AS (SELECT role, zone, ok FROM m1 WHERE ok IS NOT NULL QUALIFY row_number() OVER (PARTITION BY role, zone ORDER BY ord) = 1)"
CAPS = [("click", 3), ("view", 4), ("error", 2), ("signup", 3)]
CAPS_SQL = values_sql("caps", "zone, cap", CAPS)


def matrix(spark):
    m = values(spark, "ord int, role string, zone string, said string", MATRIX).withColumn("ok", human.decision(F.col("said"))).where("ok is not null")
    return human.first_per(m, ["role", "zone"], "ord").select("role", "zone", "ok")


@query("b14_tri_state", f"WITH {M_SQL} SELECT ord, ok FROM m1")
def b14(spark, d):
    return values(spark, "ord int, role string, zone string, said string", MATRIX).select("ord", human.decision(F.col("said")).alias("ok"))


ACCESS = "a AS (SELECT o_orderkey, c_mktsegment AS role, o_orderpriority AS zone, o_orderstatus <> 'F' AS said FROM orders JOIN customer ON o_custkey = c_custkey)"


def access(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", F.col("c_mktsegment").alias("role"), F.col("o_orderpriority").alias("zone"), (F.col("o_orderstatus") != "F").alias("said"))


@query("c5_access_matrix", f"WITH {M_SQL}, {ACCESS} SELECT a.role, a.zone, count(*) AS n, count(ok) AS matched, count(*) FILTER (WHERE ok IS NOT NULL AND ok <> said) AS denied FROM a LEFT JOIN m USING (role, zone) GROUP BY ALL")
def c5(spark, d):
    j = access(spark, d).join(F.broadcast(matrix(spark)), ["role", "zone"], "left")
    return j.groupBy("role", "zone").agg(F.count("*").alias("n"), F.count("ok").alias("matched"), F.count_if(F.col("ok") != F.col("said")).alias("denied"))


DAY = "o AS (SELECT event_type AS zone, date_trunc('hour', ts) AS ts, count(*) AS people FROM events GROUP BY ALL)"


def occupancy(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("zone"), F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").alias("people"))


@query("c6_caps", f"WITH {CAPS_SQL}, {DAY} SELECT zone, ts, people, cap, people > cap AS breach FROM o LEFT JOIN caps USING (zone)")
def c6(spark, d):
    caps = values(spark, "zone string, cap int", CAPS)
    return occupancy(spark, d).join(F.broadcast(caps), "zone", "left").select("zone", "ts", "people", "cap", (F.col("people") > F.col("cap")).alias("breach"))


@query("d10_occupancy", f"WITH {CAPS_SQL}, {DAY}, b AS (SELECT *, people > cap AS said, people > 3 AS truth FROM o JOIN caps USING (zone)), e AS (SELECT zone, sum((said AND NOT coalesce(p, false))::INT) AS episodes FROM (SELECT *, lag(said) OVER (PARTITION BY zone ORDER BY ts) AS p FROM b) GROUP BY zone) SELECT zone, count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn, any_value(episodes) AS episodes FROM b JOIN e USING (zone) GROUP BY zone")
def d10(spark, d):
    caps = values(spark, "zone string, cap int", CAPS)
    b = occupancy(spark, d).join(F.broadcast(caps), "zone").withColumn("said", F.col("people") > F.col("cap")).withColumn("truth", F.col("people") > 3)
    c = b.groupBy("zone").agg(F.count_if(F.col("truth") & F.col("said")).alias("tp"), F.count_if(~F.col("truth") & F.col("said")).alias("fp"), F.count_if(F.col("truth") & ~F.col("said")).alias("fn"))
    return c.join(intervals.episodes(b, ["zone"], F.col("said")), "zone")


@query("c7_first_per_role", "SELECT o_orderkey, c_custkey AS first_of_role FROM orders JOIN (SELECT c_custkey AS k, c_mktsegment AS role FROM customer) ON o_custkey = k JOIN (SELECT c_mktsegment AS role, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) USING (role)")
def c7(spark, d):
    reg = human.first_per(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey").select(F.col("c_mktsegment").alias("role"), F.col("c_custkey").alias("first_of_role"))
    return access(spark, d).join(F.broadcast(reg), "role").select("o_orderkey", "first_of_role")


CELLS = "[o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE '-' END, CASE WHEN o_orderkey % 5 = 0 THEN 'no' ELSE '12.7' END]"


def _cells(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").withColumn("cells", F.array("o_orderstatus", F.when(k % 3 == 0, "yes").otherwise("-"), F.when(k % 5 == 0, "no").otherwise("12.7")))


@query("b12_one_decision", "SELECT o_orderkey, CASE WHEN (o_orderkey % 3 = 0) <> (o_orderkey % 5 = 0) THEN o_orderkey % 3 = 0 END AS ok FROM orders")
def b12(spark, d):
    return _cells(spark, d).select("o_orderkey", human.one_decision(F.col("cells")).alias("ok"))


@query("b13_one_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 12 END AS cap FROM orders")
def b13(spark, d):
    return _cells(spark, d).select("o_orderkey", human.one_number(F.col("cells")).alias("cap"))


@query("b11_in_vocabulary", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'yes' WHEN o_orderkey % 5 = 0 THEN 'no' END AS word FROM orders")
def b11(spark, d):
    return _cells(spark, d).select("o_orderkey", human.in_vocabulary(F.col("cells"), F.array(F.lit("YES"), F.lit("No"))).alias("word"))


@query("b7_label_dispatch", "SELECT cls, count(*) AS n FROM (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'ThresholdRule' WHEN 'MACHINERY' THEN 'MaintenanceRule' ELSE 'unmapped' END AS cls FROM customer) GROUP BY cls")
def b7(spark, d):
    labels = values(spark, "c_mktsegment string, cls string", [("BUILDING", "ThresholdRule"), ("MACHINERY", "MaintenanceRule")])
    return table(spark, d, "customer").join(F.broadcast(labels), "c_mktsegment", "left").groupBy(F.coalesce("cls", F.lit("unmapped")).alias("cls")).agg(F.count("*").alias("n"))


@query("b8_exclude_class", "SELECT count(*) AS n FROM customer WHERE c_mktsegment <> 'FURNITURE'")
def b8(spark, d):
    return table(spark, d, "customer").where("c_mktsegment <> 'FURNITURE'").agg(F.count("*").alias("n"))


@query("b9_station_by_value", "SELECT c_custkey, n_name AS station FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def b9(spark, d):
    n = table(spark, d, "nation")
    declared = n.where("n_regionkey = 1").agg(F.collect_set("n_name").alias("declared"))
    rec = table(spark, d, "customer").join(small(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.array("c_name", "n_name", "c_mktsegment").alias("cells"))
    hit = F.get(F.filter("cells", lambda c: F.array_contains("declared", c)), F.lit(0))
    return rec.join(F.broadcast(declared)).select("c_custkey", hit.alias("station")).where("station is not null")


@query("b10_sensor_resolution", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name WHEN s_nationkey < 10 THEN 'Supplier#' || lpad(s_nationkey::VARCHAR, 9, '0') ELSE '' END AS sensor FROM supplier")
def b10(spark, d):
    s = table(spark, d, "supplier")
    names = s.select(F.col("s_name").alias("name"))
    given = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.lit("code")).alias("raw"), F.when(F.col("s_nationkey") < 10, F.concat(F.lit("Supplier#"), F.lpad(F.col("s_nationkey").cast("string"), 9, "0"))).alias("built"))
    full = given.join(small(names.withColumnRenamed("name", "full")), F.col("raw") == F.col("full"), "left")
    both = full.join(small(names.withColumnRenamed("name", "code")), F.col("built") == F.col("code"), "left")
    return both.select("s_suppkey", F.coalesce("full", "code", F.lit("")).alias("sensor"))


@query("b15_inventory", "SELECT DISTINCT n_name AS name FROM nation WHERE n_regionkey = 2")
def b15(spark, d):
    return table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("name")).distinct()


@query("b17_unbindable", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def b17(spark, d):
    return table(spark, d, "supplier").join(small(table(spark, d, "nation").where("n_regionkey < 3")), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("s_suppkey", "s_nationkey")
