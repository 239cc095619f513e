"""Aggregates and statistics: runs are suppliers' line items, labels judge documents, conversations are runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.functions import text as T
from sluice.operators import match, reshape, score
from sluice.plans import detect_queries as dq
from sluice.sources.tables import small, table

HEUR = "SELECT l.doc_id, l.quality = 1 AS truth, l.toxic = 1 AS toxic, d.n_chars > 1000 AS said, lang FROM labels l JOIN documents d USING (doc_id)"


def judged(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 1).alias("toxic"), (F.col("n_chars") > 1000).alias("said"), "lang")


@query("d4_precision_recall", f"SELECT lang, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT lang, count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn FROM ({HEUR}) GROUP BY lang)")
def d4(spark, d):
    c = score.confusion(judged(spark, d), F.col("truth"), F.col("said"), "lang")
    return c.select("lang", *match.f1(F.col("tp"), F.col("fp"), F.col("fn")))


@query("d6_wilson", """SELECT lang, greatest((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 0) AS lo, least((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 1) AS hi
  FROM (SELECT lang, avg(quality) AS p, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)""")
def d6(spark, d):
    g = judged(spark, d).groupBy("lang").agg(F.count_if("truth").alias("k"), F.count("*").alias("n"))
    return g.select("lang", *score.wilson(F.col("k"), F.col("n")))


@query("d7_run_summary", "SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS sd, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS runs FROM lineitem GROUP BY 1")
def d7(spark, d):
    return score.summary(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")


@query("d8_group_by_stem", "SELECT regexp_replace(c_mktsegment || '_run' || (c_custkey % 5), '_run[0-9]+$', '') AS config, count(*) AS n FROM customer GROUP BY 1")
def d8(spark, d):
    name = F.concat("c_mktsegment", F.lit("_run"), (F.col("c_custkey") % 5).cast("string"))
    return table(spark, d, "customer").groupBy(F.regexp_replace(name, r"_run\d+$", "").alias("config")).agg(F.count("*").alias("n"))


@query("d9_confusion", f"SELECT count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn, count(*) FILTER (WHERE NOT truth AND NOT said) AS tn FROM ({HEUR})")
def d9(spark, d):
    return score.confusion(judged(spark, d), F.col("truth"), F.col("said"))


@query("d20_kappa", f"SELECT n, a AS agreement, (a - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) AS kappa FROM (SELECT count(*) AS n, avg((truth = said)::INT) AS a, avg(truth::INT) AS pa, avg(said::INT) AS pb FROM ({HEUR}))")
def d20(spark, d):
    return score.kappa(judged(spark, d), F.col("truth"), F.col("said"))


@query("d12_modal_field", "SELECT l_suppkey, l_returnflag AS mode, n / sum(n) OVER (PARTITION BY l_suppkey) AS share FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag DESC) = 1")
def d12(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    g = n.groupBy("l_suppkey").agg(F.max(F.struct("n", "l_returnflag")).alias("m"), F.sum("n").alias("all"))
    return g.select("l_suppkey", F.col("m.l_returnflag").alias("mode"), (F.col("m.n") / F.col("all")).alias("share"))


@query("d13_slot_agreement", "SELECT o_orderpriority, sum((o_orderstatus = 'F')::INT) / nullif(count(*), 0)::DOUBLE AS recall_frac, sum((o_orderstatus = 'F' AND o_totalprice > 200000)::INT) / nullif(sum((o_orderstatus = 'F')::INT), 0)::DOUBLE AS binding_frac FROM orders GROUP BY 1")
def d13(spark, d):
    f = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg((f / F.nullif(F.count("*"), F.lit(0))).alias("recall_frac"), (F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)) / F.nullif(f, F.lit(0))).alias("binding_frac"))


@query("d14_interventions", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS runs, count(*) FILTER (WHERE length(text) > 200) AS kept FROM conversations GROUP BY ROLLUP(role)")
def d14(spark, d):
    return table(spark, d, "conversations").rollup("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("runs"), F.count_if(F.length("text") > 200).alias("kept"))


@query("d15_margins", "SELECT l_returnflag, count(*) FILTER (WHERE m >= 0) AS own, count(*) FILTER (WHERE m < 0) AS yielded, count(*) FILTER (WHERE abs(m) <= 0.05) AS near FROM (SELECT l_returnflag, l_discount - l_tax AS m FROM lineitem) GROUP BY 1")
def d15(spark, d):
    m = F.col("l_discount") - F.col("l_tax")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(m >= 0).alias("own"), F.count_if(m < 0).alias("yielded"), F.count_if(F.abs(m) <= 0.05).alias("near"))


SETS = "f AS (SELECT DISTINCT l_returnflag AS corpus, l_linenumber AS run, l_suppkey AS field FROM lineitem)"


def _sets(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("corpus"), F.col("l_linenumber").alias("run"), F.col("l_suppkey").alias("field")).distinct()


@query("d16_schema_stability", f"WITH {SETS}, r AS (SELECT corpus, count(DISTINCT run) AS runs FROM f GROUP BY 1), p AS (SELECT corpus, field, count(*) AS n FROM f GROUP BY ALL), l AS (SELECT corpus, run, list(field) AS s FROM f GROUP BY ALL) SELECT corpus, fields, core, core / fields::DOUBLE AS core_frac, jaccard FROM (SELECT p.corpus, count(*) AS fields, count(*) FILTER (WHERE n = runs) AS core FROM p JOIN r USING (corpus) GROUP BY p.corpus) JOIN (SELECT a.corpus, round(avg(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE), 9) AS jaccard FROM l a JOIN l b ON a.corpus = b.corpus AND a.run < b.run GROUP BY 1) USING (corpus)")
def d16(spark, d):
    f = _sets(spark, d)
    runs = f.groupBy("corpus").agg(F.count_distinct("run").alias("runs"))
    present = f.groupBy("corpus", "field").agg(F.count("*").alias("n")).join(runs, "corpus").groupBy("corpus").agg(F.count("*").alias("fields"), F.count_if(F.col("n") == F.col("runs")).alias("core"))
    s = f.groupBy("corpus", "run").agg(F.collect_set("field").alias("s"))
    j = s.toDF("corpus", "r1", "a").join(s.toDF("corpus", "r2", "b"), "corpus").where("r1 < r2").groupBy("corpus").agg(F.round(F.avg(T.jaccard(F.col("a"), F.col("b"))), 9).alias("jaccard"))
    return present.join(j, "corpus").select("corpus", "fields", "core", (F.col("core") / F.col("fields")).alias("core_frac"), "jaccard")


@query("d17_field_presence", f"WITH {SETS} SELECT corpus, field, count(DISTINCT run) / any_value(runs)::DOUBLE AS presence FROM f JOIN (SELECT corpus, count(DISTINCT run) AS runs FROM f GROUP BY 1) USING (corpus) GROUP BY ALL")
def d17(spark, d):
    f = _sets(spark, d)
    runs = f.groupBy("corpus").agg(F.count_distinct("run").alias("runs"))
    return f.join(runs, "corpus").groupBy("corpus", "field").agg((F.count_distinct("run") / F.first("runs")).alias("presence"))


@query("g5_core_fields", f"WITH {SETS} SELECT corpus, field FROM (SELECT corpus, field, count(DISTINCT run) AS n FROM f GROUP BY corpus, field) JOIN (SELECT corpus, count(DISTINCT run) AS runs FROM f GROUP BY corpus) USING (corpus) WHERE n = runs")
def g5(spark, d):
    f = _sets(spark, d)
    runs = f.groupBy("corpus").agg(F.count_distinct("run").alias("runs"))
    return f.groupBy("corpus", "field").agg(F.count_distinct("run").alias("n")).join(runs, "corpus").where("n = runs").select("corpus", "field")


GROUND = "WITH w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS w FROM benchmark), dw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM documents WHERE source = '{source}')"


def _ground(spark, d, source):
    w = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("w"))
    own = table(spark, d, "documents").where(F.col("source") == source).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("w")).distinct().withColumn("hit", F.lit(1))
    return w.join(own, "w", "left").groupBy("item_id").agg(F.count("*").alias("tokens"), F.count("hit").alias("found"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("coverage"))


_GSQL = " SELECT item_id, count(*) AS tokens, count(dw.w) AS found, avg((dw.w IS NOT NULL)::INT) AS coverage FROM w LEFT JOIN dw USING (w) GROUP BY item_id"


@query("d19_grounding", GROUND.replace("{source}", "src1") + _GSQL)
def d19(spark, d):
    return _ground(spark, d, "src1")


@query("m10_foreign_null", GROUND.replace("{source}", "src2") + _GSQL)
def m10(spark, d):
    return _ground(spark, d, "src2")


@query("d18_citations", "WITH c AS (SELECT o_orderkey, o_custkey, o_custkey % 7 = 0 AS empty FROM orders) SELECT count(*) FILTER (WHERE NOT empty) / count(*)::DOUBLE AS coverage, count(*) FILTER (WHERE NOT empty AND c_custkey IS NOT NULL) / count(*) FILTER (WHERE NOT empty)::DOUBLE AS validity, count(*) FILTER (WHERE NOT empty AND c_custkey IS NULL) AS dangling FROM c LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 11 <> 0")
def d18(spark, d):
    c = table(spark, d, "orders").select("o_custkey", (F.col("o_custkey") % 7 == 0).alias("empty"))
    known = table(spark, d, "customer").where("c_custkey % 11 <> 0").select("c_custkey")
    j = c.join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    cited, found = ~F.col("empty"), F.col("c_custkey").isNotNull()
    return j.agg((F.count_if(cited) / F.count("*")).alias("coverage"), (F.count_if(cited & found) / F.count_if(cited)).alias("validity"), F.count_if(cited & ~found).alias("dangling"))


@query("d21_id_reuse", "SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS ids, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS reused")
def d21(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("hit"))
    return ids.join(known, "k", "left").agg(F.count("*").alias("ids"), F.count("hit").alias("reused"))


@query("d22_category_majority", "SELECT c_nationkey, c_mktsegment AS category FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment DESC) = 1")
def d22(spark, d):
    n = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.groupBy("c_nationkey").agg(F.max(F.struct("n", "c_mktsegment")).alias("m")).select("c_nationkey", F.col("m.c_mktsegment").alias("category"))


@query("d31_distinct_devices", "SELECT count(*) AS payloads, count(DISTINCT json_extract_string(props, '$.k')) AS devices FROM events")
def d31(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("payloads"), F.count_distinct(F.get_json_object("props", "$.k")).alias("devices"))


@query("d32_category_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def d32(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("d33_sum_coerced", "SELECT round(sum(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END), 4) AS total FROM customer WHERE c_mktsegment = 'BUILDING'")
def d33(spark, d):
    cell = F.when(F.col("c_custkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").agg(F.round(F.sum(T.as_number(cell)), 4).alias("total"))


@query("d34_distinct_nodes", "SELECT s_nationkey AS node FROM supplier UNION SELECT c_nationkey FROM customer")
def d34(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("node")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@query("d35_turn_averages", "SELECT role, avg(turns) AS turns, avg(chars) AS chars FROM (SELECT conv_id, role, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY ALL) GROUP BY role")
def d35(spark, d):
    runs = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return runs.groupBy("role").agg(F.avg("turns").alias("turns"), F.avg("chars").alias("chars"))


@query("b21_bound_order", f"WITH {dq.RULES_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE NOT (crit_lo <= warn_lo AND warn_lo <= warn_hi AND warn_hi <= crit_hi)) AS violations FROM all_rules WHERE crit_lo IS NOT NULL AND warn_lo IS NOT NULL AND warn_hi IS NOT NULL AND crit_hi IS NOT NULL")
def b21(spark, d):
    r = dq.rules(spark, dq.RULES).dropna(subset=["crit_lo", "warn_lo", "warn_hi", "crit_hi"])
    ok = (F.col("crit_lo") <= F.col("warn_lo")) & (F.col("warn_lo") <= F.col("warn_hi")) & (F.col("warn_hi") <= F.col("crit_hi"))
    return r.agg(F.count("*").alias("n"), F.count_if(~ok).alias("violations"))


@query("f2_best_config", "SELECT l_suppkey, m FROM (SELECT l_suppkey, round(avg(l_extendedprice), 6) AS m FROM lineitem GROUP BY 1) ORDER BY m DESC, l_suppkey LIMIT 1")
def f2(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_extendedprice"), 6).alias("m"))
    return m.orderBy(F.desc("m"), "l_suppkey").limit(1)


@query("f7_preview", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20")
def f7(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(20)


@query("f1_sort", "SELECT event_id, row_number() OVER (ORDER BY event_type, value DESC, event_id) AS rank FROM events")
def f1(spark, d):
    """The whole order; ranks are counted within ranges, so no task sees all rows."""
    return reshape.ordinal(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", F.desc("value"), "event_id").select("event_id", F.col("k").alias("rank"))
