"""Reshaping over ``part``, ``documents``, ``conversations``: a record's fields, a run's lines and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.functions import text as T
from sluice.operators import reshape, segment
from sluice.plans.text_queries import LINES, lines
from sluice.sources.tables import small, table, values, values_sql

FIELDS = ["p_name", "p_brand", "p_type", "p_size"]
FACTS = "f AS (" + " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS field, trim(CAST({c} AS VARCHAR)) AS value FROM part" for c in FIELDS) + ")"


def facts(spark, d):
    return reshape.facts(table(spark, d, "part"), "p_partkey", FIELDS)


@query("dm6_facts", f"WITH {FACTS} SELECT * FROM f WHERE value <> ''")
def dm6(spark, d):
    return facts(spark, d)


@query("d26_pivot", f"WITH {FACTS} SELECT p_partkey, string_agg(value, ' | ' ORDER BY value) FILTER (WHERE field = 'p_brand') AS p_brand, string_agg(value, ' | ' ORDER BY value) FILTER (WHERE field = 'p_name') AS p_name, string_agg(value, ' | ' ORDER BY value) FILTER (WHERE field = 'p_size') AS p_size, string_agg(value, ' | ' ORDER BY value) FILTER (WHERE field = 'p_type') AS p_type FROM f GROUP BY 1")
def d26(spark, d):
    long = facts(spark, d)
    out = reshape.wide(long, "p_partkey", reshape.field_order(long))
    return out.select("p_partkey", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in FIELDS])


@query("d27_field_order", f"WITH {FACTS} SELECT field, row_number() OVER (ORDER BY n DESC, field) AS place FROM (SELECT field, count(*) AS n FROM f WHERE field <> 'p_size' OR p_partkey % 3 = 0 GROUP BY 1)")
def d27(spark, d):
    order = reshape.field_order(facts(spark, d).where("field <> 'p_size' or p_partkey % 3 = 0"))
    return values(spark, "field string, place int", [(f, k + 1) for k, f in enumerate(order)])


@query("d23_inventory", f"WITH {FACTS} SELECT field, sum(n)::BIGINT AS n, list_sort(list(value) FILTER (WHERE k <= 6)) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY value) AS k FROM (SELECT field, substring(value, 1, 80) AS value, count(*) AS n FROM f GROUP BY ALL)) GROUP BY field")
def d23(spark, d):
    return reshape.inventory(facts(spark, d))


MERGE = [(1, "b", "30", True), (2, "b", "31", True), (1, "a", "stop pump", False), (2, "a", "pump", False), (3, "a", "call", False), (1, "c", "", False), (2, "c", "x", False)]


@query("d24_merge_values", "SELECT * FROM (VALUES ('a', 'stop pump; call'), ('b', '30'), ('c', 'x')) t(field, merged)")
def d24(spark, d):
    m = values(spark, "ord int, field string, value string, numeric boolean", MERGE)
    v = m.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("v"), F.first("numeric").alias("numeric"))
    return v.select("field", reshape.merge_values(F.col("v"), F.col("numeric")).alias("merged"))


@query("d25_lines_union", "SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS lines FROM lineitem GROUP BY 1")
def d25(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"))


def _profile_sql(name: str, cols: list[str]) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce(trim(CAST({c} AS VARCHAR)), '') AS v FROM {name}" for c in cols)
    return f"p AS (SELECT field, count(*) AS n, count(*) FILTER (WHERE v <> '') AS filled, count(DISTINCT v) FILTER (WHERE v <> '') AS dist, avg(length(v)) FILTER (WHERE v <> '') AS len, bool_and(v = '' OR (length(v) <= 24 AND NOT contains(v, ' ') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]'))) AS labels FROM ({cells}) GROUP BY field)"


CUST = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query("b3_id_column", f"WITH {_profile_sql('customer', CUST)} SELECT field, round(dist / filled - len / 200 + CASE WHEN field IN ('id') THEN 0.05 ELSE 0 END, 9)::DOUBLE AS score FROM p WHERE filled / n >= 0.9 AND dist / filled >= 0.9 ORDER BY 2 DESC LIMIT 1")
def b3(spark, d):
    return reshape.id_column(reshape.column_profile(table(spark, d, "customer").select(CUST)))


TWO_SOURCES = "(SELECT doc_id, source, lang, 1 AS one FROM documents WHERE source IN ('src1', 'src2'))"


@query("b4_noise_columns", f"WITH {_profile_sql(TWO_SOURCES, ['doc_id', 'source', 'lang', 'one'])} SELECT field FROM p WHERE filled >= 2 AND (dist = 1 OR (dist <= greatest(6, floor(n * 0.1)) AND labels))")
def b4(spark, d):
    docs = table(spark, d, "documents").where("source in ('src1', 'src2')").select("doc_id", "source", "lang", F.lit(1).alias("one"))
    return reshape.noise_columns(reshape.column_profile(docs))


@query("b2_column_names", "SELECT c_custkey AS custkey, c_name AS name FROM customer")
def b2(spark, d):
    c = table(spark, d, "customer")
    norm = {"".join(ch for ch in n.lower() if ch.isalnum()): n for n in c.columns}
    return c.select(F.col(norm["ccustkey"]).alias("custkey"), F.col(norm["cname"]).alias("name"))


@query("b1_rename_drop", "SELECT c_custkey AS id, c_name, c_mktsegment FROM customer")
def b1(spark, d):
    return table(spark, d, "customer").drop("c_acctbal", "c_nationkey").withColumnRenamed("c_custkey", "id")


@query("b18_title_fields", "WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents WHERE text IS NOT NULL), f AS (SELECT source, 'lang' AS field, lang AS v, title FROM documents JOIN t USING (doc_id) UNION ALL SELECT source, 'first', substring(title, 1, 3), title FROM documents JOIN t USING (doc_id)) SELECT source, field FROM f GROUP BY ALL HAVING bool_and(contains(title, v) OR contains(v, title))")
def b18(spark, d):
    docs = table(spark, d, "documents").where("text is not null").withColumn("title", F.split("text", "\n")[0])
    f = docs.select("source", "title", F.inline(F.array(F.struct(F.lit("lang").alias("field"), F.col("lang").alias("v")), F.struct(F.lit("first").alias("field"), F.substring("title", 1, 3).alias("v")))))
    return f.groupBy("source", "field").agg(F.bool_and(F.contains("title", F.col("v")) | F.contains("v", F.col("title"))).alias("same")).where("same").select("source", "field")


@query("b19_citations_kept", "SELECT l_orderkey, CASE WHEN len(k) = 0 THEN [1] ELSE list_sort(k) END AS lines FROM (SELECT l_orderkey, list_distinct(list_filter(list(l_linenumber), lambda x: x BETWEEN 3 AND 5)) AS k FROM lineitem GROUP BY 1)")
def b19(spark, d):
    k = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.array_intersect(F.collect_list("l_linenumber"), F.array(*[F.lit(x) for x in (3, 4, 5)]))).alias("k"))
    return k.select("l_orderkey", F.when(F.size("k") == 0, F.array(F.lit(1))).otherwise(F.col("k")).alias("lines"))


@query("b20_score_band", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount BETWEEN 0.03 AND 0.06 THEN 'near' ELSE 'far' END AS band FROM lineitem")
def b20(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_discount").between(0.03, 0.06), "near").otherwise("far").alias("band"))


@query("b22_skip_existing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def b22(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("b25_confident_first", "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events WHERE value >= 150")
def b25(spark, d):
    sure = table(spark, d, "events").where("value >= 150").select("event_id", "value")
    return reshape.ordinal(sure, F.desc("value"), "event_id").select("event_id", F.col("k").alias("rank"))


@query("b26_all_equal", "SELECT conv_id, count(DISTINCT role) = 1 AS same FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1")
def b26(spark, d):
    return table(spark, d, "conversations").where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg((F.count_distinct("role") == 1).alias("same"))


@query("b24_guess_column", "SELECT s_suppkey AS station FROM supplier")
def b24(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col(next(c for c in s.columns if any(w in c.lower() for w in ("station", "machine", "suppkey")))).alias("station"))


# Texts without blank lines get some: a line of one word is a break.
BROKEN = f"{LINES}, b AS (SELECT doc_id, n, CASE WHEN contains(trim(s), ' ') THEN s ELSE '' END AS s FROM lines), g AS (SELECT *, sum(CASE WHEN trim(s) <> '' AND coalesce(p, '') = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM (SELECT *, trim(lag(s) OVER (PARTITION BY doc_id ORDER BY n)) AS p FROM b))"


def broken(spark, d):
    return lines(spark, d).withColumn("s", F.when(F.contains(F.trim("s"), F.lit(" ")), F.col("s")).otherwise(F.lit("")))


@query("n1_blocks", f"WITH {BROKEN} SELECT doc_id, n, block FROM g WHERE trim(s) <> ''")
def n1(spark, d):
    return segment.blocks(broken(spark, d)).select("doc_id", "n", "block")


@query("n2_chunks")
def n2(spark, d):
    return segment.pack(segment.shaped(broken(spark, d)), 3500)


@query("n3_rendered_chunks")
def n3(spark, d):
    ls = broken(spark, d)
    return segment.rendered(segment.pack(segment.shaped(ls), 3500), ls)


@query("n4_paragraph_chunks")
def n4(spark, d):
    return segment.paragraph_chunks(table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@query("n6_title_chunks")
def n6(spark, d):
    return segment.paragraph_chunks(table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), 3000, 100)


@query("n5_regex_split", "SELECT doc_id, k - 1 AS k, parts[k] AS part FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, regexp_split_to_array(text, '[.] ') AS parts FROM documents))")
def n5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "[.] ", -1)).alias("k", "part"))


@query("e15_heading_in_force", rf"WITH {LINES}, h AS (SELECT *, CASE WHEN trim(s) <> '' AND length(trim(s)) <= 90 AND len(regexp_split_to_array(trim(s), '\s+')) >= 2 AND NOT regexp_matches(trim(s), '[.,;]$') THEN nullif(trim(regexp_replace(trim(s), '^[^\p{{L}}\p{{N}}]+', '')), '') END AS h FROM lines) SELECT doc_id, n, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS heading FROM h")
def e15(spark, d):
    return segment.carried(lines(spark, d), T.heading(F.col("s")), "heading").select("doc_id", "n", "heading")


STATION = "CASE WHEN starts_with(s, 'The ') THEN 'A' WHEN starts_with(s, 'Of ') THEN '' END"


@query("e16_station_in_force", f"WITH {LINES} SELECT doc_id, n, nullif(last_value(x IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING), '') AS station FROM (SELECT *, {STATION} AS x FROM lines)")
def e16(spark, d):
    x = F.when(F.startswith("s", F.lit("The ")), "A").when(F.startswith("s", F.lit("Of ")), "")
    return segment.carried(lines(spark, d), x, "station").select("doc_id", "n", F.nullif(F.col("station"), F.lit("")).alias("station"))


RULE_TEXT = [(1, "RULE-A01: Pump hot\nstop pump\n\nRULE-B02: Leak\ncall staff\nlog it\n\nend"), (2, "none here"), (3, "| T_01 | 5 | 10 | bar | 1 | 2 | high |\n| T_02 | 6 | 11 | K | 3 | 4 | low |"), (4, "| cap | 12 persons |")]
RT_SQL = values_sql("r", "id, body", RULE_TEXT)


def _rule_text(spark):
    return values(spark, "id int, body string", RULE_TEXT)


@query("n7_rule_sections", r"SELECT * FROM (VALUES (1, 'RULE-A01', 'Pump hot' || chr(10) || 'stop pump'), (1, 'RULE-B02', 'Leak' || chr(10) || 'call staff' || chr(10) || 'log it')) t(id, rule_id, body)")
def n7(spark, d):
    p = F.lit(r"(RULE-[A-Z0-9]+):\s*((?:.+\n?)+)")
    both = F.arrays_zip(F.regexp_extract_all("body", p, F.lit(1)).alias("rule_id"), F.regexp_extract_all("body", p, F.lit(2)).alias("body"))
    return _rule_text(spark).select("id", F.inline(both)).select("id", "rule_id", F.regexp_replace("body", r"\n+$", "").alias("body"))


@query("n8_threshold_rows", "SELECT * FROM (VALUES (3, 'T_01', 5.0::DOUBLE, 10.0::DOUBLE, 'bar'), (3, 'T_02', 6.0, 11.0, 'K')) t(id, sensor, lo, hi, unit)")
def n8(spark, d):
    p = r"^\|\s*(\w+)\s*\|\s*([\d.]+)\s*\|\s*([\d.]+)\s*\|\s*(\S+)\s*\|"
    ls = _rule_text(spark).select("id", F.explode(F.split("body", "\n")).alias("s")).where(F.col("s").rlike(p))
    got = lambda k: F.regexp_extract("s", p, k)
    return ls.select("id", got(1).alias("sensor"), got(2).cast("double").alias("lo"), got(3).cast("double").alias("hi"), got(4).alias("unit"))


@query("n9_fault_rows", f"WITH {RT_SQL} SELECT id, trim(string_split(s, '|')[2]) AS sensor, trim(string_split(s, '|')[8]) AS kind FROM (SELECT id, unnest(string_split(body, chr(10))) AS s FROM r) WHERE len(string_split(s, '|')) = 9")
def n9(spark, d):
    ls = _rule_text(spark).select("id", F.explode(F.split("body", "\n")).alias("s")).withColumn("c", F.split("s", r"\|", -1)).where(F.size("c") == 9)
    return ls.select("id", F.trim(F.col("c")[1]).alias("sensor"), F.trim(F.col("c")[7]).alias("kind"))


@query("n10_occupancy_rows", f"WITH {RT_SQL} SELECT id, CAST(regexp_extract(body, '([0-9]+) persons', 1) AS INT) AS cap FROM r WHERE regexp_matches(body, '[0-9]+ persons')")
def n10(spark, d):
    return _rule_text(spark).where(F.col("body").rlike(r"\d+ persons")).select("id", F.regexp_extract("body", r"(\d+) persons", 1).cast("int").alias("cap"))


EXPAND = [("BUILDING", "a", "WARNING"), ("BUILDING", "b", "CRITICAL"), ("MACHINERY", "a", "WARNING")]


@query("n11_expand_rules", f"WITH {values_sql('x', 'seg, part, severity', EXPAND)} SELECT c_custkey, c_mktsegment || coalesce(part, '') AS rule_id, severity FROM customer LEFT JOIN x ON c_mktsegment = seg")
def n11(spark, d):
    x = values(spark, "c_mktsegment string, part string, severity string", EXPAND)
    return table(spark, d, "customer").join(F.broadcast(x), "c_mktsegment", "left").select("c_custkey", F.concat("c_mktsegment", F.coalesce("part", F.lit(""))).alias("rule_id"), "severity")


@query("n12_station_by_prefix", "SELECT p_partkey, min(w) AS station FROM part LEFT JOIN (VALUES ('red'), ('small'), ('large')) v(w) ON starts_with(p_name, w || ' ') GROUP BY 1")
def n12(spark, d):
    v = values(spark, "w string", [("red",), ("small",), ("large",)])
    p = table(spark, d, "part")
    return p.join(F.broadcast(v), F.startswith(p["p_name"], F.concat(v["w"], F.lit(" "))), "left").groupBy("p_partkey").agg(F.min("w").alias("station"))


@query("c16_line_owner", "SELECT o_orderkey, min(l_linenumber) AS line, min(l_linenumber) // 3 AS chunk FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def c16(spark, d):
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("line"))
    owner = spark.range(1, 100).select(F.col("id").cast("int").alias("line"), F.floor(F.col("id") / 3).alias("chunk"))
    return table(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(F.broadcast(owner), "line").select("o_orderkey", "line", "chunk")


@query("c17_verdicts", "SELECT c_custkey, coalesce(v, 'keep') AS verdict FROM customer LEFT JOIN (SELECT o_custkey, CASE arg_max(o_orderstatus, o_orderkey) WHEN 'F' THEN 'drop' WHEN 'P' THEN 'correct' ELSE 'keep' END AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def c17(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"))
    v = F.when(F.col("s") == "F", "drop").when(F.col("s") == "P", "correct")
    return table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(v, F.lit("keep")).alias("verdict"))


@query("o5_audit_override", "SELECT l_orderkey, n, dropped, dropped = n AND n >= 3 AS overridden FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'N') AS dropped FROM lineitem GROUP BY 1)")
def o5(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "N").alias("dropped"))
    return g.withColumn("overridden", (F.col("dropped") == F.col("n")) & (F.col("n") >= 3))


for _name, _sql, _f in [
    ("c10_join_by_ordinal", "SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) a JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS k FROM supplier) b USING (k)",
     lambda s, d: reshape.ordinal(table(s, d, "customer").select("c_custkey"), "c_custkey").join(reshape.ordinal(table(s, d, "supplier").select("s_suppkey"), F.desc("s_suppkey")), "k").select("c_custkey", "s_suppkey")),
    ("c11_last_duplicate", "SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))),
    ("c12_sheet_key", "SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)", lambda s, d: table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select("doc_id", "quality", "lang")),
    ("c13_two_annotators", "SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL", lambda s, d: (lambda l: l.select("doc_id", "quality").join(l.select("doc_id", "toxic"), "doc_id").dropna())(table(s, d, "labels"))),
    ("c14_first_keyed", "SELECT s_suppkey, c FROM supplier LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS c FROM customer GROUP BY 1) ON s_nationkey = c_nationkey", lambda s, d: table(s, d, "supplier").join(table(s, d, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("c")), "s_nationkey", "left").select("s_suppkey", "c")),
    ("c15_declared_bound", "SELECT s_suppkey, s_acctbal > n AS above FROM supplier LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS n FROM customer GROUP BY 1) ON s_nationkey = c_nationkey", lambda s, d: table(s, d, "supplier").join(table(s, d, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.avg("c_acctbal").alias("n")), "s_nationkey", "left").select("s_suppkey", (F.col("s_acctbal") > F.col("n")).alias("above"))),
    ("c18_facts_bookkeeping", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey", lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")),
    ("g1_union", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer", lambda s, d: table(s, d, "supplier").select(F.col("s_nationkey").alias("k")).unionByName(table(s, d, "customer").select(F.col("c_nationkey").alias("k")))),
    ("g2_intersection", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer", lambda s, d: table(s, d, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(s, d, "customer").select("c_nationkey"))),
    ("g3_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(s, d, "orders").select("o_custkey"))),
    ("g4_distinct_first", "SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))),
    ("g6_subset", "SELECT NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)) AS subset", lambda s, d: table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").agg((F.count("*") == 0).alias("subset"))),
    ("f6_first_match", "SELECT c_nationkey, min(c_custkey) AS first FROM customer WHERE c_acctbal > 5000 GROUP BY 1", lambda s, d: table(s, d, "customer").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"))),
]:
    query(_name, _sql)(_f)
