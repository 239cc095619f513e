"""Matching over ``lineitem``, ``embeddings``, ``conversations``, ``customer``: a group is a corpus, a number a record."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.functions import text as T
from sluice.operators import match
from sluice.sources.tables import scratch, small, table, values, values_sql

# An order is a corpus; its lines in turn are reference rows and records, compared by price.
PAIRS = """l AS (SELECT l_orderkey AS corpus, l_extendedprice AS x, l_returnflag AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_returnflag) AS n FROM lineitem),
s AS (SELECT corpus, n AS gt, x, kind FROM l WHERE n % 2 = 1), c AS (SELECT corpus, n AS pred, x AS y, kind AS other FROM l WHERE n % 2 = 0),
p AS (SELECT corpus, gt, pred, greatest(0.0, 1 - abs(x - y) / greatest(abs(x), abs(y), 1e-9)) AS score, (kind = other)::INT::DOUBLE AS alike FROM s JOIN c USING (corpus))"""
# Every way to pair a corpus, reference row by reference row; the best is the optimal assignment.
CHOSEN = """o AS (SELECT corpus, gt, pred, score FROM {p} UNION ALL SELECT DISTINCT corpus, gt, 0, 0.0::DOUBLE FROM {p}),
walk AS (SELECT corpus, -1::BIGINT AS g, 0::BIGINT AS taken, 0.0::DOUBLE AS total, CAST([] AS STRUCT(gt BIGINT, pred BIGINT, score DOUBLE)[]) AS way FROM (SELECT DISTINCT corpus FROM {p})
  UNION ALL SELECT w.corpus, o.gt, CASE WHEN pred = 0 THEN taken ELSE taken | (1::BIGINT << (pred // 2)::INT) END, total + score, CASE WHEN pred = 0 THEN way ELSE list_append(way, {{'gt': o.gt, 'pred': pred, 'score': score}}) END
  FROM walk w JOIN o ON o.corpus = w.corpus AND o.gt = w.g + 2 AND (pred = 0 OR (taken >> (pred // 2)::INT) & 1 = 0)),
chosen AS (SELECT corpus, w.gt AS gt, w.pred AS pred, w.score AS score FROM (SELECT corpus, unnest(arg_max(way, total + len(way) * 1e-9)) AS w FROM walk WHERE (corpus, g) IN (SELECT corpus, max(gt) FROM {p} GROUP BY 1) GROUP BY corpus))"""
MATCHED = f"WITH RECURSIVE {PAIRS}, {CHOSEN.format(p='p')}"


def sides(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("corpus"), "l_linenumber", F.col("l_extendedprice").alias("x"), F.col("l_returnflag").alias("kind"))
    li = li.withColumn("n", F.row_number().over(Window.partitionBy("corpus").orderBy("l_linenumber", "x", "kind")).cast("long"))
    return li.where("n % 2 = 1").select("corpus", F.col("n").alias("gt"), "x", "kind"), li.where("n % 2 = 0").select("corpus", F.col("n").alias("pred"), F.col("x").alias("y"), F.col("kind").alias("other"))


def pairs(spark, d):
    s, c = sides(spark, d)
    return s.join(c, "corpus").select("corpus", "gt", "pred", T.closeness(F.col("x"), F.col("y")).alias("score"), (F.col("kind") == F.col("other")).cast("double").alias("alike"))


def chosen(spark, d):
    """The optimal pairs of every corpus."""
    return match.assignment(pairs(spark, d), "corpus")


@query("c9_scored_pairs", f"WITH {PAIRS} SELECT corpus, gt, pred, score FROM p")
def c9(spark, d):
    return pairs(spark, d).drop("alike")


@query("l2_assignment", f"{MATCHED} SELECT * FROM chosen")
def l2(spark, d):
    return chosen(spark, d)


SIZES = "sizes AS (SELECT corpus, count(*) FILTER (WHERE n % 2 = 1) AS n_gt, count(*) FILTER (WHERE n % 2 = 0) AS n_pred FROM l GROUP BY 1)"


@query("l3_accepted_pairs", f"{MATCHED}, {SIZES} SELECT corpus, tp, n_pred - tp AS fp, n_gt - tp AS fn, least(n_gt, n_pred) / nullif(n_pred, 0)::DOUBLE AS ceiling FROM (SELECT corpus, n_gt, n_pred, count(*) FILTER (WHERE score >= 0.6) AS tp FROM sizes LEFT JOIN chosen USING (corpus) GROUP BY ALL)")
def l3(spark, d):
    s, c = sides(spark, d)
    n = s.groupBy("corpus").agg(F.count("*").alias("n_gt")).join(c.groupBy("corpus").agg(F.count("*").alias("n_pred")), "corpus", "left").fillna(0, "n_pred")
    return n.join(chosen(spark, d), "corpus", "left").groupBy("corpus").agg(*match.counts(None, F.col("n_gt"), F.col("n_pred"), 0.6))


@query("l4_audit_rows", f"{MATCHED} SELECT corpus, gt, pred, score, 'pair' AS kind FROM chosen UNION ALL SELECT corpus, NULL, pred, NULL, 'unpaired record' FROM c WHERE (corpus, pred) NOT IN (SELECT corpus, pred FROM chosen) UNION ALL SELECT corpus, gt, NULL, NULL, 'unpaired reference' FROM s WHERE (corpus, gt) NOT IN (SELECT corpus, gt FROM chosen)")
def l4(spark, d):
    s, c = sides(spark, d)
    got = common_pairs(spark, d)
    rest = c.select("corpus", "pred").join(got, ["corpus", "pred"], "left_anti").withColumn("kind", F.lit("unpaired record"))
    missed = s.select("corpus", "gt").join(got, ["corpus", "gt"], "left_anti").withColumn("kind", F.lit("unpaired reference"))
    return got.withColumn("kind", F.lit("pair")).unionByName(rest, allowMissingColumns=True).unionByName(missed, allowMissingColumns=True)


def common_pairs(spark, d):
    """The optimal pairs, solved once and stored for the plans that read them several times."""
    at = scratch(spark, "pairs")
    got = chosen(spark, d)
    got.write.parquet(at)
    return spark.read.schema(got.schema).parquet(at)


@query("e13_runner_up", f"{MATCHED} SELECT b.corpus, b.gt, b.pred, b.score, max(p.score) AS next_score, b.score - max(p.score) AS margin FROM chosen b JOIN p ON p.corpus = b.corpus AND p.gt = b.gt AND p.pred <> b.pred GROUP BY b.corpus, b.gt, b.pred, b.score")
def e13(spark, d):
    return match.runner_up(pairs(spark, d), chosen(spark, d), ["corpus", "gt"])


TOTALS = "totals AS (SELECT sum(n_gt) AS g, sum(n_pred) AS q FROM sizes)"


@query("e17_threshold_curve", f"{MATCHED}, {SIZES}, {TOTALS}, t AS (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS t) SELECT t, tp, 2.0 * tp / (g + q)::DOUBLE AS f1 FROM (SELECT t, count(*) FILTER (WHERE score >= t) AS tp FROM chosen, t GROUP BY t), totals")
def e17(spark, d):
    t = spark.range(11).select((F.col("id") / 10.0).alias("t"))
    n = table(spark, d, "lineitem").agg(F.count("*").alias("n"))
    got = chosen(spark, d).crossJoin(F.broadcast(t)).groupBy("t").agg(F.count_if(F.col("score") >= F.col("t")).alias("tp"))
    return got.crossJoin(F.broadcast(n)).select("t", "tp", (2.0 * F.col("tp") / F.col("n")).alias("f1"))


BLENDED = "b AS (SELECT corpus * 10 + w AS corpus, gt, pred, w / 4.0::DOUBLE * score + (1 - w / 4.0::DOUBLE) * alike AS score FROM p, (SELECT unnest(range(0, 5)) AS w))"


@query("e18_weight_sweep", f"WITH RECURSIVE {PAIRS}, {BLENDED}, {CHOSEN.format(p='b')}, t AS (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS t) SELECT (corpus % 10) / 4.0::DOUBLE AS w, t, round(sum(score), 5) AS total, count(*) FILTER (WHERE score >= t - 1e-9) AS tp FROM chosen, t GROUP BY 1, 2")
def e18(spark, d):
    """Every blend of the two scores is assigned anew; thresholds are swept over its pairs."""
    weights = spark.range(5).select(F.col("id").alias("w"))
    share = F.col("w") / 4.0
    blended = pairs(spark, d).crossJoin(F.broadcast(weights)).select((F.col("corpus") * 10 + F.col("w")).alias("setting"), "gt", "pred", (share * F.col("score") + (1 - share) * F.col("alike")).alias("score"))
    t = values(spark, "t double", [(0.5,), (0.7,), (0.9,)])
    got = match.assignment(blended, "setting").crossJoin(F.broadcast(t)).groupBy((F.col("setting") % 10 / 4.0).alias("w"), "t")
    return got.agg(F.round(F.sum("score"), 5).alias("total"), F.count_if(F.col("score") >= F.col("t") - 1e-9).alias("tp"))


# F1 of a corpus and setting, from its pairs and the sizes of both sides.
F1_SQL = "f AS (SELECT corpus, t, round(2.0 * count(*) FILTER (WHERE score >= t) / (any_value(n_gt) + any_value(n_pred))::DOUBLE, 6) AS f FROM sizes JOIN chosen USING (corpus), (VALUES (0.5), (0.7), (0.9)) v(t) GROUP BY corpus, t)"


@query("e12_rank_per_setting", f"{MATCHED}, {SIZES}, {F1_SQL}, r AS (SELECT corpus, t, f, rank() OVER (PARTITION BY t ORDER BY f DESC) AS place FROM f) SELECT corpus, min(place) AS best, max(place) AS worst FROM r GROUP BY corpus")
def e12(spark, d):
    """Best and worst place of each corpus; equal values share the lowest place, found from counts of distinct values."""
    t = values(spark, "t double", [(0.5,), (0.7,), (0.9,)]).select(F.col("t").cast("decimal(2,1)").alias("t"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("corpus")).agg(F.count("*").alias("n"))
    f = chosen(spark, d).crossJoin(F.broadcast(t)).groupBy("corpus", "t").agg(F.count_if(F.col("score") >= F.col("t")).alias("tp"))
    f = f.join(n, "corpus").select("corpus", "t", F.round(2.0 * F.col("tp") / F.col("n"), 6).alias("f"))
    ranks = match.places(f, "t", "f")
    return f.join(ranks, ["t", "f"]).groupBy("corpus").agg(F.min("place").alias("best"), F.max("place").alias("worst"))


@query("e14_curve_shape", f"{MATCHED}, g AS (SELECT corpus, t, count(*) FILTER (WHERE score >= t / 10.0) AS n FROM chosen, (SELECT unnest(range(0, 11)) AS t) GROUP BY corpus, t) SELECT corpus, t, CASE WHEN n > coalesce(p, n) AND n > coalesce(x, n) THEN 'peak' WHEN n = coalesce(p, n) AND n = coalesce(x, n) THEN 'plateau' WHEN n <= coalesce(p, n) AND n >= coalesce(x, n) THEN 'declining' ELSE 'rising' END AS shape FROM (SELECT *, lag(n) OVER w AS p, lead(n) OVER w AS x FROM g WINDOW w AS (PARTITION BY corpus ORDER BY t))")
def e14(spark, d):
    t = spark.range(11).select(F.col("id").alias("t"))
    g = chosen(spark, d).crossJoin(F.broadcast(t)).groupBy("corpus", "t").agg(F.count_if(F.col("score") >= F.col("t") / 10.0).alias("n"))
    w = Window.partitionBy("corpus").orderBy("t")
    p, x, n = F.coalesce(F.lag("n").over(w), "n"), F.coalesce(F.lead("n").over(w), "n"), F.col("n")
    return g.select("corpus", "t", F.when((n > p) & (n > x), "peak").when((n == p) & (n == x), "plateau").when((n <= p) & (n >= x), "declining").otherwise("rising").alias("shape"))


COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


def _nearest(spark, d):
    e = table(spark, d, "embeddings")
    e = e.select("vec_id", "embedding")
    top = match.cosines(e.where(F.col("vec_id") % 100 == 0), e, 5).toDF("query", "vec_id", "score")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return top.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@query("l1_cosine", f"SELECT a.vec_id AS query, b.vec_id, round(greatest({COS}, 0), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0")
def l1(spark, d):
    e = table(spark, d, "embeddings")
    e = e.select("vec_id", "embedding")
    both = match.cosines(e.where(F.col("vec_id") % 100 == 0), e).toDF("query", "vec_id", "score")
    return both.select("query", "vec_id", F.round(F.greatest("score", F.lit(0.0)), 9).alias("score"))


@query("l1_text_cosine", "WITH v AS (SELECT item_id, substr(md5(w), 1, 2) AS k, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark) GROUP BY ALL), z AS (SELECT item_id, sqrt(sum(n * n)) AS z FROM v GROUP BY 1) SELECT a.item_id AS a, b.item_id AS b, round(least(greatest(sum(a.n / x.z * (b.n / y.z)), 0.0), 1.0), 9) AS score FROM v a JOIN v b ON a.k = b.k JOIN z x ON x.item_id = a.item_id JOIN z y ON y.item_id = b.item_id GROUP BY 1, 2")
def l1_text(spark, d):
    v = match.hashed_terms(table(spark, d, "benchmark"), "item_id", "text")
    return match.sparse_cosine(v, v).withColumn("score", F.round("score", 9))


TOP = f"t AS (SELECT query, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query, b.vec_id, {COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 5)"


@query("f4_top_k_above", f"WITH {TOP} SELECT query, vec_id, rank FROM t WHERE score >= 0.3")
def f4(spark, d):
    return _nearest(spark, d).where("score >= 0.3").select("query", "vec_id", "rank")


@query("f5_top_k_within", f"WITH {TOP} SELECT query, vec_id, rank FROM t WHERE 1 - score <= 0.6")
def f5(spark, d):
    return _nearest(spark, d).where("1 - score <= 0.6").select("query", "vec_id", "rank")


@query("b23_metadata_filter", f"SELECT a.vec_id AS query, b.vec_id, round({COS}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.label = 3")
def b23(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return e.where("label = 3").join(F.broadcast(q)).select("query", "vec_id", F.round(match.cosine(F.col("q"), F.col("embedding")), 9).alias("score"))


# Lines fall into three runs; a rule id is a part, its fields quantity and discount.
VOTES = "WITH r AS (SELECT l_linenumber % 3 AS run, l_partkey AS rule, l_quantity AS x, l_discount AS y, l_orderkey AS id FROM lineitem)"
# Where pairs are formed, a rule is a part of one supplier, and an order counts once in it.
CANDIDATES = "WITH r AS (SELECT l_linenumber % 3 AS run, l_partkey * 10000000 + l_suppkey AS rule, max(l_quantity) AS x, max(l_discount) AS y, l_orderkey AS id FROM lineitem GROUP BY ALL)"


def votes(spark, d):
    return _votes(table(spark, d, "lineitem"))


def _votes(li):
    return li.select((F.col("l_linenumber") % 3).alias("run"), F.col("l_partkey").alias("rule"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_orderkey").alias("id"))


def candidates(spark, d):
    li = table(spark, d, "lineitem")
    g = li.groupBy((F.col("l_linenumber") % 3).alias("run"), (F.col("l_partkey") * 10000000 + F.col("l_suppkey")).alias("rule"), F.col("l_orderkey").alias("id"))
    return g.agg(F.max("l_quantity").alias("x"), F.max("l_discount").alias("y"))


@query("d29_run_vote", f"{VOTES} SELECT rule, count(DISTINCT run) AS runs FROM r GROUP BY rule HAVING count(DISTINCT run) >= 2")
def d29(spark, d):
    return votes(spark, d).groupBy("rule").agg(F.count_distinct("run").alias("runs")).where("runs >= 2")


@query("d28_field_majority", f"{VOTES} SELECT rule, y, n FROM (SELECT rule, y, count(*) AS n FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY rule ORDER BY n DESC, y) = 1 AND n >= 2")
def d28(spark, d):
    n = votes(spark, d).groupBy("rule", "y").agg(F.count("*").alias("n"))
    top = n.groupBy("rule").agg(F.max(F.struct("n", (-F.col("y")).alias("k"))).alias("b"))
    return top.select("rule", (-F.col("b.k")).alias("y"), F.col("b.n").alias("n")).where("n >= 2")


AGREE = "(3 * (CASE WHEN abs(a.x - b.x) <= 1 THEN 1.0 ELSE 0 END) + 1 * (CASE WHEN a.y = b.y THEN 1.0 ELSE 0 END)) / 4"


def _agree(spark, d):
    return _pairs_of(candidates(spark, d))


def _pairs_of(v):
    a, b = v.select("rule", *[F.col(c).alias(f"a_{c}") for c in ("id", "run", "x", "y")]), v.select("rule", *[F.col(c).alias(f"b_{c}") for c in ("id", "run", "x", "y")])
    near, same = (F.abs(F.col("a_x") - F.col("b_x")) <= 1).cast("double"), (F.col("a_y") == F.col("b_y")).cast("double")
    return a.join(b, "rule").withColumn("score", (3 * near + same) / 4)


@query("l5_field_agreement", f"{CANDIDATES} SELECT a.rule, a.id AS a_id, b.id AS b_id, ({AGREE})::DOUBLE AS score FROM r a JOIN r b USING (rule) WHERE a.id < b.id")
def l5(spark, d):
    return _agree(spark, d).where("a_id < b_id").select("rule", "a_id", "b_id", "score")


@query("l6_medoid", f"{CANDIDATES}, s AS (SELECT a.rule, a.id, sum({AGREE})::DOUBLE AS total FROM r a JOIN r b USING (rule) WHERE a.id <> b.id GROUP BY ALL) SELECT rule, id AS medoid, total FROM s QUALIFY row_number() OVER (PARTITION BY rule ORDER BY total DESC, id) = 1")
def l6(spark, d):
    return match.medoids(_agree(spark, d).where("a_id <> b_id"), "rule", "a_id", "score")


@query("l7_greedy_clusters")
def l7(spark, d):
    # every run and rule; pairs that can't make or grow a cluster don't go to Python
    pairs = _agree(spark, d).where("a_id < b_id and score >= 0.55 and a_run <> b_run")
    p = pairs.select("rule", F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a_run").alias("run_a"), F.col("b_run").alias("run_b"), "score")
    return match.greedy_clusters(p, "rule", 0.55)


@query("l8_content_vote", f"{VOTES}, k AS (SELECT rule FROM r GROUP BY rule HAVING count(DISTINCT run) >= 2), m AS (SELECT rule, y FROM (SELECT rule, y, count(*) AS n FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY rule ORDER BY n DESC, y) = 1) SELECT rule, y, avg(x) AS x FROM r JOIN k USING (rule) JOIN m USING (rule, y) GROUP BY rule, y")
def l8(spark, d):
    v = votes(spark, d)
    kept = v.groupBy("rule").agg(F.count_distinct("run").alias("k")).where("k >= 2")
    n = v.groupBy("rule", "y").agg(F.count("*").alias("n")).groupBy("rule").agg((-F.max(F.struct("n", (-F.col("y")).alias("k")))["k"]).alias("y"))
    return v.join(kept.select("rule"), "rule").join(n, ["rule", "y"]).groupBy("rule", "y").agg(F.avg("x").alias("x"))


@query("l9_hindsight_gap", "WITH m AS (SELECT l_suppkey AS cfg, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY 1) SELECT cfg, round(mean - other, 9) AS gap, mean - other > sd AS beyond FROM (SELECT *, CASE WHEN mean = max(mean) OVER () THEN (SELECT max(mean) FROM m WHERE mean < (SELECT max(mean) FROM m)) ELSE max(mean) OVER () END AS other FROM m)")
def l9(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cfg")).agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd"))
    top = m.agg(F.max("mean").alias("first"))
    second = m.join(F.broadcast(top)).where("mean < first").agg(F.max("mean").alias("second"))
    both = m.join(F.broadcast(top)).join(F.broadcast(second))
    gap = F.col("mean") - F.when(F.col("mean") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return both.select("cfg", F.round(gap, 9).alias("gap"), (gap > F.col("sd")).alias("beyond"))


@query("c22_similar_names", "SELECT a.p_partkey AS a, b.p_partkey AS b, round(jaro_winkler_similarity(a.p_name, b.p_name), 9) AS s FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE jaro_winkler_similarity(a.p_name, b.p_name) > 0.8")
def c22(spark, d):
    pairs = match.similar_names(table(spark, d, "part"), ["p_brand", "p_size"], "p_partkey", "p_name", 0.8)
    return pairs.select("a", "b", F.round("s", 9).alias("s"))


KEYS = [("c_custkey",), ("c_nationkey",), ("s_suppkey",), ("s_nationkey",), ("n_nationkey",), ("n_regionkey",), ("r_regionkey",)]


@query("c23_key_correlation")
def c23(spark, d):
    k = values(spark, "k string", KEYS)
    both = small(k.select(F.col("k").alias("a"))).crossJoin(k.select(F.col("k").alias("b"))).where("a < b").withColumn("ratio", match.matcher_ratio("a", "b"))
    return both.where("ratio > 0.6").groupBy("a").agg(F.max(F.struct("ratio", "b")).alias("m")).select("a", "m.b", F.round("m.ratio", 6).alias("ratio"))


RAW_ZONES = [("urgent",), ("1 urgent",), ("high ",), ("2_HIGH",), ("medum",), ("4-not specifed",), ("lower",), ("xyz",)]


@query("c8_fuzzy_zone")
def c8(spark, d):
    zones = table(spark, d, "orders").select(F.col("o_orderpriority").alias("zone")).distinct().withColumn("z", T.alnum(F.col("zone")))
    raw = values(spark, "raw string", RAW_ZONES).withColumn("z", T.alnum(F.col("raw")))
    both = raw.withColumnRenamed("z", "x").crossJoin(small(zones)).withColumn("ratio", F.when(F.col("x") == F.col("z"), 2.0).otherwise(match.matcher_ratio("x", "z")))
    return both.where("ratio >= 0.72").groupBy("raw").agg(F.max(F.struct("ratio", "zone")).alias("m")).select("raw", "m.zone", F.least(F.round("m.ratio", 6), F.lit(1.0)).alias("ratio"))


@query("c24_neighbour_overlap", "WITH n AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), c AS (SELECT s, count(*) AS n FROM n GROUP BY 1) SELECT a.s AS a, b.s AS b, count(*) AS shared, count(*) / any_value(c.n)::DOUBLE AS share FROM n a JOIN n b ON a.p = b.p AND a.s < b.s JOIN c ON c.s = a.s GROUP BY a.s, b.s")
def c24(spark, d):
    n = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    c = n.groupBy("s").agg(F.count("*").alias("n"))
    both = n.toDF("a", "p").join(n.toDF("b", "p"), "p").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return both.join(c.toDF("a", "n"), "a").select("a", "b", "shared", (F.col("shared") / F.col("n")).alias("share"))


@query("f3_top_suggestions", "SELECT doc_id, item_id, r FROM (SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, item_id DESC) AS r FROM (SELECT doc_id, item_id, len(list_intersect(x, y)) AS j FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM documents) a, (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS y FROM benchmark) b)) WHERE r <= 3")
def f3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("x"))
    items = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("y"))
    j = docs.join(small(items)).select("doc_id", "item_id", F.size(F.array_intersect("x", "y")).alias("j"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("j"), F.desc("item_id"))
    return j.withColumn("r", F.row_number().over(w)).where("r <= 3").select("doc_id", "item_id", "r")


@query("f8_greedy_order", f"{CANDIDATES}, q AS (SELECT a.rule, a.id AS a, b.id AS b, a.run AS ra, b.run AS rb, ({AGREE})::DOUBLE AS score FROM r a JOIN r b USING (rule) WHERE a.id < b.id) SELECT rule, a, b, row_number() OVER (PARTITION BY rule ORDER BY score DESC, a, b, ra, rb) AS place FROM q WHERE score >= 0.55")
def f8(spark, d):
    p = _agree(spark, d).where("a_id < b_id and score >= 0.55")
    w = Window.partitionBy("rule").orderBy(F.desc("score"), "a_id", "b_id", "a_run", "b_run")
    return p.select("rule", F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.row_number().over(w).alias("place"))
