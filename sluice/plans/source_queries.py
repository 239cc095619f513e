"""Sources and sinks over what the tables hold; files themselves are covered by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.plans.text_queries import LINES, lines
from sluice.sources import files
from sluice.functions import cache
from sluice.operators import detect
from sluice.sources.tables import scratch, table, values


@query("a6_documents", "SELECT doc_id || '.txt' AS source_file, length(text) AS n FROM documents")
def a6(spark, d):
    return table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"), F.length("text").alias("n"))


@query("a7_lines", f"WITH {LINES} SELECT doc_id || '.txt' AS source_file, n AS line_no, s AS text FROM lines JOIN documents USING (doc_id) WHERE n = 1 OR s <> '' OR n < len(string_split(text, chr(10)))")
def a7(spark, d):
    return files.lines(table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"), "text"))


@query("a5_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def a5(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_totalprice")


@query("a9_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def a9(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("a10_keyword_lines", f"WITH {LINES} SELECT doc_id, n FROM lines WHERE regexp_matches(lower(s), 'license|version')")
def a10(spark, d):
    return lines(spark, d).where(F.lower("s").rlike("license|version")).select("doc_id", "n")


@query("a27_grep", f"WITH {LINES} SELECT doc_id, n FROM lines WHERE contains(lower(s), 'apache')")
def a27(spark, d):
    return files.grep(lines(spark, d), "Apache", "s").select("doc_id", "n")


@query("a12_name_parts", "SELECT o_orderkey, c_mktsegment AS corpus, (o_orderkey % 5)::VARCHAR AS run FROM orders JOIN customer ON o_custkey = c_custkey")
def a12(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = o.select("o_orderkey", F.format_string("out/%s_run%d.csv", "c_mktsegment", F.col("o_orderkey") % 5).alias("file"))
    return files.named_parts(named, "file", r"/([A-Z]+)_run(\d+)\.csv$", ["corpus", "run"]).drop("file")


@query("a13_sidecar", "SELECT DISTINCT 'out/' || source || '_facts.csv' AS path FROM documents")
def a13(spark, d):
    return table(spark, d, "documents").select(files.sidecar(F.concat(F.lit("out/"), "source", F.lit(".csv"))).alias("path")).distinct()


@query("a14_transcript", "SELECT conv_id, turn, last_value(tag IGNORE NULLS) OVER w AS tag, sum((tag IS NOT NULL)::INT) OVER w AS run FROM (SELECT *, CASE WHEN role = 'user' THEN 'user' || turn END AS tag FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def a14(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.col("turn").cast("string")).alias("text"))
    return files.transcript(c, r"^(user\d+)", "conv_id", "turn").select("conv_id", "turn", "tag", "run")


@query("a16_canonical_columns", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer")
def a16(spark, d):
    return files.canonical(table(spark, d, "customer"), ["c_custkey", "c_name"])


@query("a18_json_rows", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS j FROM nation")
def a18(spark, d):
    return table(spark, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("j"))


@query("a20_report", "SELECT s_suppkey AS k, s_acctbal AS score, NULL AS seg FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def a20(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("score"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("score"), F.col("c_mktsegment").alias("seg"))
    return files.report(old, new, "score")


@query("a24_load_nodes", "SELECT c_nationkey AS id, min(c_mktsegment) AS any_segment FROM customer GROUP BY 1")
def a24(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.min("c_mktsegment").alias("any_segment"))


@query("a25_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def a25(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return files.upsert(e, e.where("vec_id % 3 = 0").withColumn("label", F.lit(-1)), "vec_id")


@query("a26_file_sample", f"WITH {LINES} SELECT doc_id, n, s FROM lines ORDER BY doc_id, n LIMIT 100")
def a26(spark, d):
    return lines(spark, d).orderBy("doc_id", "n").limit(100)


CUT = [(1, '```json\n{"a": 1, "b": [1, 2,]}\n```'), (2, 'Sure: {"a": "x", "b": "unfin'), (3, "no json"), (4, '[{"r": 1}, {"r": 2}, {"r'), (5, None)]


@query("h34_json_repair", """SELECT * FROM (VALUES (1, '{"a": 1, "b": [1, 2]}'), (2, '{"a": "x", "b": "unfin"}'), (3, NULL), (4, '[{"r": 1}, {"r": 2}]'), (5, NULL)) t(id, j)""")
def h34(spark, d):
    return values(spark, "id int, s string", CUT).select("id", cache.repaired("s").alias("j"))


@query("o2_reply_cache", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'replied' END AS status FROM documents) GROUP BY 1")
def o2(spark, d):
    req = table(spark, d, "documents").select("doc_id", cache.request_key("doc_id", "lang").alias("key"))
    known = req.where("doc_id % 3 <> 0").select("key", F.lit("{}").alias("reply"))
    return cache.replies(req, known).groupBy(F.when(F.col("reply").isNull(), "pending").otherwise("replied").alias("status")).agg(F.count("*").alias("n"))


@query("o7_pending_runs", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def o7(spark, d):
    req = table(spark, d, "documents").select("doc_id", cache.request_key("doc_id", "lang").alias("key"))
    return cache.pending(req, req.where("doc_id % 3 <> 0").select("key", F.lit("{}").alias("reply"))).select("doc_id")


@query("p_linear_svm")
def p_svm(spark, d):
    """A linear classifier on node vectors with a 75/25 split (2.P)."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").where("embedding is not null and label is not null")
    e = e.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), (F.col("label") < 5).cast("double").alias("label"))
    train = F.pmod(F.xxhash64("vec_id"), F.lit(4)) < 3
    model = LinearSVC(maxIter=10).fit(e.where(train))
    return model.transform(e.where(~train)).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("a1_csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a1(spark, d):
    at = scratch(spark, "csv")
    files.write_csv(table(spark, d, "nation"), at)
    return files.csv(spark, at, schema="n_nationkey int, n_name string, n_regionkey int")


@query("a2_csv_text", "SELECT n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_regionkey = 1 THEN '' ELSE n_name END AS n_name FROM nation")
def a2(spark, d):
    at = scratch(spark, "csv")
    files.write_csv(table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("n_name")), at)
    return files.csv(spark, at)


@query("a3_csv_typed", "SELECT s_suppkey, s_acctbal FROM supplier")
def a3(spark, d):
    at = scratch(spark, "csv")
    files.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), at)
    return files.csv(spark, at, infer=True).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_acctbal")


@query("a19_append_log", "SELECT r_regionkey, r_name, count(*) AS n FROM (SELECT * FROM region UNION ALL SELECT * FROM region) GROUP BY ALL")
def a19(spark, d):
    at, r = scratch(spark, "log"), table(spark, d, "region")
    files.write_csv(r, at)
    files.write_csv(r, at, "append")
    return files.csv(spark, at, schema="r_regionkey int, r_name string").groupBy("r_regionkey", "r_name").agg(F.count("*").alias("n"))


REPLIES = [(1, '{"records": [{"id": "R1", "lines": [3, 4], "fields": {"hi": "5"}}, {"id": "R2", "lines": [9], "fields": {}}]}'), (2, '{"records": []}'), (3, "no reply")]


@query("o3_reply_records", "SELECT * FROM (VALUES (1, 'R1', 2), (1, 'R2', 1)) t(chunk, id, n_lines)")
def o3(spark, d):
    kind = "records array<struct<id: string, lines: array<int>, fields: map<string, string>>>"
    r = values(spark, "chunk int, reply string", REPLIES).select("chunk", F.explode(F.from_json("reply", kind)["records"]).alias("r"))
    return r.select("chunk", "r.id", F.size("r.lines").alias("n_lines"))


@query("o4_schema_mapping", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' ELSE c_mktsegment END AS category FROM customer")
def o4(spark, d):
    m = values(spark, "c_mktsegment string, to string", [("BUILDING", "construction")])
    return table(spark, d, "customer").join(F.broadcast(m), "c_mktsegment", "left").select("c_custkey", F.coalesce("to", "c_mktsegment").alias("category"))


@query("a4_marked_csv", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def a4(spark, d):
    """A file that begins with a byte order mark."""
    at = scratch(spark, "csv")
    rows = table(spark, d, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value"))
    head = values(spark, "value string", [("\ufeffn_nationkey,n_name",)])
    head.withColumn("k", F.lit(0)).unionByName(rows.withColumn("k", F.lit(1))).repartition(1).sortWithinPartitions("k").select("value").write.text(at)
    return files.csv(spark, at)


@query("a11_first_members", "SELECT n_nationkey || '.zip' AS archive, n_nationkey || '/b.csv' AS member, 'csv' AS ending FROM nation UNION ALL SELECT n_nationkey || '.zip', 'a.TXT', 'txt' FROM nation")
def a11(spark, d):
    """An archive for each nation, with two members of one ending; the executors write and read them."""
    at = scratch(spark, "zip")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    member = lambda name: F.struct(name.alias("member"), F.col("n_name").alias("text"))
    members = F.array(member(F.concat("k", F.lit("/b.csv"))), member(F.lit("a.TXT")), member(F.lit("c.csv")))
    files.write_archives(n.select(F.concat("k", F.lit(".zip")).alias("archive"), members.alias("members")), at)
    return files.archive_members(spark, at)


@query("a15_first_row_header", "SELECT r_regionkey, r_name FROM region")
def a15(spark, d):
    at = scratch(spark, "csv")
    files.write_csv(table(spark, d, "region").select("r_regionkey", "r_name"), at)
    return files.csv(spark, at, infer=True).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("a17_discovered_columns", "SELECT s_suppkey::VARCHAR AS k, s_name AS a, '' AS b FROM supplier UNION ALL SELECT c_custkey::VARCHAR, '', c_name FROM customer")
def a17(spark, d):
    """Columns are those that any record has; missing cells are empty."""
    at = scratch(spark, "csv")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("a"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("b"))
    files.write_csv(s.unionByName(c, allowMissingColumns=True), at)
    return files.csv(spark, at)


@query("a21_replaced_whole", "SELECT r_regionkey + 10 AS k FROM region")
def a21(spark, d):
    """A table that is written anew: readers see the old rows or the new ones, never a part."""
    at, r = scratch(spark, "whole"), table(spark, d, "region")
    files.replace(r.select(F.col("r_regionkey").alias("k")), at)
    files.replace(r.select((F.col("r_regionkey") + 10).alias("k")), at)
    return files.current(spark, at)


@query("a22_partial_checkpoints", "SELECT doc_id, length(text) AS n FROM documents")
def a22(spark, d):
    """Half of the documents are done by a run that stopped; the next one does the rest and reads all."""
    at = scratch(spark, "partial")
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    files.resume(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), at, "doc_id")
    return files.resume(docs, at, "doc_id")


@query("b16_leakage_guard", "SELECT count(*) AS n, true AS refused FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
def b16(spark, d):
    """Telemetry with a label is refused; without it, it passes."""
    e = table(spark, d, "events").select(F.col("event_type").alias("sensor"), "ts", "value")
    try:
        detect.telemetry(e.withColumn("label", F.lit(1)))
        refused = False
    except ValueError:
        refused = True
    return detect.telemetry(e).agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))
