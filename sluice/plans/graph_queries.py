"""A property graph of nations, suppliers, customers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.operators import graph
from sluice.sources.tables import small, table, values

PLAN = [
    {"kind": "node", "table": "region", "label": "Region", "key": "r_regionkey", "props": ["r_name"]}, {"kind": "node", "table": "nation", "label": "Nation", "key": "n_nationkey", "props": ["n_name"]},
    {"kind": "node", "table": "supplier", "label": "Supplier", "key": "s_suppkey", "props": ["s_name", "s_nationkey"]}, {"kind": "node", "table": "part", "label": "Part", "key": "p_partkey", "props": ["p_name", "p_brand"]},
    {"kind": "edge", "table": "nation", "type": "IN_REGION", "from_label": "Nation", "from": "n_nationkey", "to_label": "Region", "to": "n_regionkey"},
    {"kind": "edge", "table": "supplier", "type": "IN_NATION", "from_label": "Supplier", "from": "s_suppkey", "to_label": "Nation", "to": "s_nationkey"},
    {"kind": "edge", "table": "lineitem", "type": "SUPPLIES", "from_label": "Supplier", "from": "l_suppkey", "to_label": "Part", "to": "l_partkey"},
]
NODES = "n AS (SELECT 'Region:' || r_regionkey AS id, 'Region' AS label FROM region UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier' FROM supplier UNION ALL SELECT 'Part:' || p_partkey, 'Part' FROM part)"
EDGES = "e0 AS (SELECT 'Nation:' || n_nationkey AS src, 'Region:' || n_regionkey AS dst, 'IN_REGION' AS type FROM nation UNION SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'IN_NATION' FROM supplier UNION SELECT 'Supplier:' || l_suppkey, 'Part:' || l_partkey, 'SUPPLIES' FROM lineitem), e AS (SELECT * FROM e0 WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))"
G = f"WITH {NODES}, {EDGES}"


def built(spark, d):
    return graph.build(spark, {t: table(spark, d, t) for t in ("region", "nation", "supplier", "part", "lineitem")}, PLAN)


@query("k12_plan_nodes", f"{G} SELECT label, count(*) AS n FROM n GROUP BY 1")
def k12(spark, d):
    return built(spark, d)[0].groupBy("label").agg(F.count("*").alias("n"))


@query("c21_plan_edges", f"{G} SELECT * FROM e")
def c21(spark, d):
    return built(spark, d)[1]


@query("k2_edge_upsert", f"{G} SELECT type, count(*) AS n FROM e GROUP BY 1")
def k2(spark, d):
    return built(spark, d)[1].groupBy("type").agg(F.count("*").alias("n"))


@query("k1_node_upsert", "SELECT 'Supplier:' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'renamed' ELSE s_name END AS name, s_nationkey::VARCHAR AS nation, CASE WHEN s_suppkey % 2 = 0 THEN 'yes' END AS checked FROM supplier")
def k1(spark, d):
    s = table(spark, d, "supplier")
    old = graph.nodes(s, "Supplier", "s_suppkey", ["s_name", "s_nationkey"])
    new = graph.nodes(s.where("s_suppkey % 2 = 0").withColumn("s_name", F.lit("renamed")).withColumn("checked", F.lit("yes")), "Supplier", "s_suppkey", ["s_name", "checked"])
    return graph.upsert_nodes(old, new).select("id", F.col("props")["s_name"].alias("name"), F.col("props")["s_nationkey"].alias("nation"), F.try_element_at("props", F.lit("checked")).alias("checked"))


@query("k8_duplicate_ids", "SELECT 'C:' || c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def k8(spark, d):
    return graph.duplicates(graph.nodes(table(spark, d, "customer"), "C", "c_nationkey", []))


@query("k9_labels_and_keys", "SELECT * FROM (VALUES ('Nation', 'n_name'), ('Part', 'p_brand'), ('Part', 'p_name'), ('Region', 'r_name'), ('Supplier', 's_name'), ('Supplier', 's_nationkey')) t(label, key)")
def k9(spark, d):
    return built(spark, d)[0].where(~F.startswith("label", F.lit("__"))).select("label", F.explode(F.map_keys("props")).alias("key")).distinct()


@query("k10_neighbours", f"{G} SELECT src AS id, count(*) AS n FROM (SELECT src, dst FROM e UNION SELECT dst, src FROM e) GROUP BY 1")
def k10(spark, d):
    return graph.neighbours(built(spark, d)[1]).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


@query("k11_endpoint_types", f"{G} SELECT DISTINCT a.label AS from_label, type, b.label AS to_label FROM e JOIN n a ON src = a.id JOIN n b ON dst = b.id")
def k11(spark, d):
    n, e = built(spark, d)
    a, b = n.select(F.col("id").alias("src"), F.col("label").alias("from_label")), n.select(F.col("id").alias("dst"), F.col("label").alias("to_label"))
    return e.join(a, "src").join(b, "dst").select("from_label", "type", "to_label").distinct()


@query("c19_edge_endpoints", f"{G} SELECT type, count(*) AS n FROM e0 WHERE src IN (SELECT id FROM n WHERE label <> 'Part') AND dst IN (SELECT id FROM n) GROUP BY 1")
def c19(spark, d):
    n, e = built(spark, d)
    return e.groupBy("type").agg(F.count("*").alias("n"))


@query("c4_last_edge", "SELECT l_partkey, max(l_suppkey) AS supplier FROM lineitem GROUP BY 1")
def c4(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_suppkey").alias("supplier"))


BIND = "r AS (SELECT c_custkey AS rule, 'Supplier#' || lpad((c_custkey % 150)::VARCHAR, 9, '0') AS sensor FROM customer)"


def _bound(spark, d):
    r = table(spark, d, "customer").select(F.col("c_custkey").alias("rule"), F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0")).alias("sensor"))
    return r, table(spark, d, "supplier").select(F.col("s_name").alias("sensor"), "s_suppkey")


@query("c20_rule_binding", f"WITH {BIND} SELECT rule, s_suppkey FROM r JOIN supplier ON sensor = s_name")
def c20(spark, d):
    r, s = _bound(spark, d)
    return r.join(small(s), "sensor").select("rule", "s_suppkey")


@query("k3_rule_nodes", f"WITH {BIND} SELECT sensor, count(*) AS n FROM (SELECT DISTINCT rule, sensor FROM r) GROUP BY 1")
def k3(spark, d):
    r, _ = _bound(spark, d)
    return r.distinct().groupBy("sensor").agg(F.count("*").alias("n"))


@query("k4_validation", f"WITH {BIND} SELECT CASE WHEN s_suppkey IS NULL THEN 'UNRESOLVED' ELSE 'ACTIVE' END AS status, count(*) AS n FROM r LEFT JOIN supplier ON sensor = s_name GROUP BY 1")
def k4(spark, d):
    r, s = _bound(spark, d)
    return r.join(small(s), "sensor", "left").groupBy(F.when(F.col("s_suppkey").isNull(), "UNRESOLVED").otherwise("ACTIVE").alias("status")).agg(F.count("*").alias("n"))


@query("k5_rules_through_binding", f"WITH {BIND} SELECT DISTINCT rule, sensor FROM r JOIN supplier ON sensor = s_name")
def k5(spark, d):
    r, s = _bound(spark, d)
    return r.join(small(s), "sensor", "left_semi").select("rule", "sensor").distinct()


@query("d11_graph_counts", f"WITH {BIND} SELECT count(DISTINCT sensor) FILTER (WHERE s_suppkey IS NOT NULL) AS active, 100.0 * count(DISTINCT s_suppkey) / (SELECT count(*) FROM supplier) AS covered_pct FROM r LEFT JOIN supplier ON sensor = s_name")
def d11(spark, d):
    r, s = _bound(spark, d)
    j = r.join(small(s), "sensor", "left").agg(F.count_distinct(F.when(F.col("s_suppkey").isNotNull(), F.col("sensor"))).alias("active"), F.count_distinct("s_suppkey").alias("k"))
    return j.crossJoin(s.agg(F.count("*").alias("all"))).select("active", (100.0 * F.col("k") / F.col("all")).alias("covered_pct"))


NAMES = ["than", "edble", "intion", "ofand", "the", "and"]
K6 = "w AS (SELECT source AS doc, doc_id AS record, string_split(lower(text), ' ') AS w FROM documents WHERE text IS NOT NULL), h AS (SELECT doc, record, w[k] AS name, min(k) AS pos FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM w) WHERE w[k] IN ('than', 'edble', 'intion', 'ofand', 'the', 'and') GROUP BY ALL), t AS (SELECT doc, record, list_sort(list(name)) AS p FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY pos) AS k FROM h) WHERE k <= 2 GROUP BY doc, record HAVING count(*) = 2)"


@query("k6_corroborated_pairs", f"WITH {K6} SELECT p[1] AS a, p[2] AS b, count(DISTINCT doc) AS docs FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 2")
def k6(spark, d):
    rec = table(spark, d, "documents").where("text is not null").select(F.col("source").alias("doc"), F.col("doc_id").alias("record"), F.split(F.lower("text"), " ").alias("words"))
    return graph.corroborated(rec, values(spark, "name string", [(n,) for n in NAMES]))


@query("k7_correlates_edges", f"WITH {K6} SELECT p[1] AS src, p[2] AS dst, 'CORRELATES_WITH' AS type FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 2")
def k7(spark, d):
    return graph.edges(k6(spark, d), "CORRELATES_WITH", F.col("a"), F.col("b"))


@query("c25_lagged_series", "WITH b AS (SELECT ts AS b0, ts + INTERVAL 10 MINUTE AS b1 FROM events WHERE event_type = 'view' AND value > 250) SELECT b0, count(*) AS n FROM b JOIN events e ON e.event_type = 'error' AND e.ts BETWEEN b0 AND b1 + INTERVAL 120 MINUTE GROUP BY b0")
def c25(spark, d):
    e = table(spark, d, "events")
    b = e.where("event_type = 'view' and value > 250").select(F.col("ts").alias("b0"), (F.col("ts") + F.expr("INTERVAL 130 MINUTES")).alias("b1"))
    return e.where("event_type = 'error'").join(small(b), (F.col("ts") >= F.col("b0")) & (F.col("ts") <= F.col("b1"))).groupBy("b0").agg(F.count("*").alias("n"))
