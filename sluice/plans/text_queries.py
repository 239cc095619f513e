"""Scalar functions over ``documents``, ``pages`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.functions import text as T
from sluice.operators import match
from sluice.sources.tables import table, values, values_sql

LINES = "lines AS (SELECT doc_id, n, t[n] AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))"


def lines(spark, d):
    """doc_id, n, s: the lines of every document, from 1 (DM1)."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "s")).select("doc_id", (F.col("k") + 1).alias("n"), "s")


def _per_line(name: str, column, sql: str, out: str = "v"):
    """A query with one computed column for each line."""

    @query(name, f"WITH {LINES} SELECT doc_id, n, {sql} AS {out} FROM lines")
    def run(spark, d):
        return lines(spark, d).select("doc_id", "n", column(F.col("s")).alias(out))

    return run


_per_line("h1_alnum", T.alnum, "regexp_replace(lower(s), '[^a-z0-9]', '', 'g')")
_per_line("h2_spaced", T.spaced, "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))")
_per_line("h3_snake", T.snake, "coalesce(nullif(lower(regexp_replace(regexp_replace(s, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'field')")
_per_line("h6_numbers", T.numbers, r"list_transform(regexp_extract_all(s, '-?[0-9]+\.?[0-9]*'), lambda x: CAST(x AS DOUBLE))")
_per_line("h7_numbers_not_negative", lambda s: T.numbers(s, True), r"list_filter(list_transform(regexp_extract_all(s, '-?[0-9]+\.?[0-9]*'), lambda x: CAST(x AS DOUBLE)), lambda x: x >= 0)")
_per_line("h10_tokens", lambda s: F.size(T.tokens(s)), "len(list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')))")
_per_line("h20_heading", T.heading, r"CASE WHEN trim(s) <> '' AND length(trim(s)) <= 90 AND len(regexp_split_to_array(trim(s), '\s+')) >= 2 AND NOT regexp_matches(trim(s), '[.,;]$') THEN nullif(trim(regexp_replace(trim(s), '^[^\p{L}\p{N}]+', '')), '') END")
_per_line("h21_rule_off", T.is_rule_off, r"regexp_replace(s, '[\s|:+\-=_*~.#]', '', 'g') = ''")
_per_line("h22_separators", T.repair_separators, r"regexp_replace(s, '([0-9A-Za-z_])\s*([-_])\s*([0-9A-Za-z_])', '\1\2\3', 'g')")
_per_line("h24_units", T.without_units, r"regexp_replace(s, '[°%a-zA-Z/\s]', '', 'g')")
_per_line("h25_severity_word", T.severity_word, "CASE WHEN regexp_matches(lower(s), 'critical|emergency|immediate|stop') THEN 'CRITICAL' WHEN regexp_matches(lower(s), 'warning|alert|caution') THEN 'WARNING' ELSE 'INFO' END")
_per_line("h26_year", T.year, r"nullif(regexp_extract(s, '\b((?:19|20)[0-9]{2})\b', 1), '')")
_per_line("h32_span", lambda s: T.span(F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit("::L"), F.col("n").cast("string")), s), "substring('D' || doc_id || '::L' || n || ' | ' || s, 1, 200)")
_per_line("h38_title", lambda s: T.title(F.concat(F.lit("# "), s)), "nullif(regexp_extract(s, '^(.+)$', 1), '')")
_per_line("h39_content_words", lambda s: F.array_sort(T.content_words(s)), "list_sort(list_distinct(list_filter(regexp_extract_all(lower(s), '[a-z]+'), lambda x: x NOT IN ('the', 'and', 'of', 'to', 'in', 'a', 'is', 'that', 'for', 'on'))))")
_per_line("h40_rough_tokens", T.rough_tokens, "length(s) // 4")


@query("h35_canonical_hash", "SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\"}') AS h FROM documents")
def h35(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.to_json(F.struct("lang", "n_chars", "source")), 256).alias("h"))


SPELLED = [(1, "GSH‑401", "GSH-401"), (2, "5 bar", "5 bar"), (3, "a​b", "ab"), (4, "x− 3", "x- 3"), (5, "H₂O", "H2O"), (6, "7.", "7.0"), (7, "7", "7.0"), (8, " a ", "a"), (9, "1d", "1"), (10, "T_IN_01", "T IN 01")]
SPELLED_SQL = values_sql("v", "id, a, b", SPELLED)


def _spelled(spark):
    return values(spark, "id int, a string, b string", SPELLED)


@query("h4_unicode_fold", f"WITH {SPELLED_SQL} SELECT id, translate(a, '{T.DASHES}{T.SPACES}{T.NOTHING}', '{'-' * len(T.DASHES)}{' ' * len(T.SPACES)}') AS f FROM v")
def h4(spark, d):
    return _spelled(spark).select("id", T.fold(F.col("a")).alias("f"))


@query("h5_squeeze", f"WITH {SPELLED_SQL} SELECT id, trim(regexp_replace(lower(translate(a, '{T.DASHES}{T.SPACES}{T.NOTHING}', '{'-' * len(T.DASHES)}{' ' * len(T.SPACES)}')), '\\s+', ' ', 'g')) AS f FROM v")
def h5(spark, d):
    return _spelled(spark).select("id", T.squeeze(F.col("a")).alias("f"))


@query("h23_spellings", f"WITH {SPELLED_SQL} SELECT id, CASE WHEN contains(a, '_') THEN [a, regexp_replace(a, '^(.*)_(.*)$', '\\1-\\2'), regexp_replace(a, '^(.*)_(.*)$', '\\1 \\2')] ELSE [a] END AS f FROM v")
def h23(spark, d):
    return _spelled(spark).select("id", T.spellings(F.col("a")).alias("f"))


_NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


@query("h27_same_value", f"WITH {SPELLED_SQL} SELECT id, CASE WHEN regexp_matches(trim(a), {_NUM}) AND regexp_matches(trim(b), {_NUM}) THEN try_cast(trim(a) AS DOUBLE) = try_cast(trim(b) AS DOUBLE) ELSE trim(a) = trim(b) END AS same FROM v")
def h27(spark, d):
    return _spelled(spark).select("id", T.same_value(F.col("a"), F.col("b")).alias("same"))


@query("h8_standalone_numbers")
def h8(spark, d):
    return lines(spark, d).select("doc_id", "n", F.size(T.standalone_numbers(F.col("s"))).alias("v"))


@query("h9_number_as_token")
def h9(spark, d):
    return lines(spark, d).where(F.size(T.numbers(F.col("s"))) > 0).select("doc_id", "n", T.has_number(F.col("s"), F.element_at(T.numbers(F.col("s")), 1)).alias("alone"))


H11 = "SELECT a.doc_id, b.item_id, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE AS j FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM documents) a, (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS y FROM benchmark) b"


@query("h11_jaccard", H11)
def h11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("x"))
    items = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("y"))
    return match.jaccards(items, docs).select(F.col("item").alias("doc_id"), F.col("query").alias("item_id"), F.col("score").alias("j"))


@query("h12_closeness", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0.0, 1 - abs(l_quantity - l_extendedprice / 1000) / greatest(abs(l_quantity), abs(l_extendedprice / 1000), 1e-9)) AS c FROM lineitem")
def h12(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.closeness(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("c"))


PAIR = "a AS (SELECT o_custkey AS k, list(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, list(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"
BEST = "list_sum(list_transform({own}, lambda g: list_max(list_transform({other}, lambda p: greatest(0.0, 1 - abs(g - p) / greatest(abs(g), abs(p), 1e-9)))))) / len({own})"


@query("h13_number_agreement", f"WITH {PAIR}, r AS (SELECT k, {BEST.format(own='x', other='y')} AS r, {BEST.format(own='y', other='x')} AS p FROM a JOIN b USING (k)) SELECT k, round(CASE WHEN r + p <= 0 THEN 0 ELSE 2 * r * p / (r + p) END, 9) AS f FROM r")
def h13(spark, d):
    o = table(spark, d, "orders")
    of = lambda s, name: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list("o_totalprice").alias(name))
    return of("F", "x").join(of("O", "y"), "k").select("k", F.round(T.agreement(F.col("x"), F.col("y")), 9).alias("f"))


@query("h14_blob", "SELECT p_partkey, concat_ws(' | ', nullif(trim(p_name), ''), nullif(trim(p_brand), ''), nullif(trim(p_type), ''), CAST(p_size AS VARCHAR)) AS b FROM part")
def h14(spark, d):
    return table(spark, d, "part").select("p_partkey", T.blob(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("b"))


@query("h15_json_attributes", "SELECT event_id, concat_ws(' | ', event_type, json_extract_string(props, '$.k')) AS b FROM events")
def h15(spark, d):
    kv = F.map_values(F.from_json("props", "map<string,string>"))
    return table(spark, d, "events").select("event_id", F.concat_ws(" | ", F.array("event_type"), kv).alias("b"))


@query("h16_blend", "SELECT p_partkey, CASE WHEN p_size > 10 THEN 0.6 * (p_size / 50.0) + 0.4 * (p_retailprice / 2000) ELSE p_size / 50.0 END AS s FROM part")
def h16(spark, d):
    return table(spark, d, "part").select("p_partkey", T.blend(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000, F.col("p_size") > 10).alias("s"))


_ENT = "html"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "), ("&amp;", "&"), ("\\_", "_")):
    _ENT = f"replace({_ENT}, '{_a}', '{_b}')"


@query("h17_unescape", f"SELECT page_id, md5(regexp_replace({_ENT}, ' {{2,}}', ' ', 'g')) AS h FROM pages WHERE NOT regexp_matches(html, '\\b(fi|fl)\\b')")
def h17(spark, d):
    p = table(spark, d, "pages").where(~F.col("html").rlike(r"\b(fi|fl)\b"))
    return p.select("page_id", F.md5(T.unescape(F.col("html")).cast("binary")).alias("h"))


REPEATED = [(1, "a b a b a b", "a b"), (2, "x", "x"), (3, "x x x", "x"), (4, "a b a", "a b a"), (5, "one  two one two", "one two")]


@query("h18_once", f"WITH {values_sql('v', 'id, s, want', REPEATED)} SELECT id, want AS v FROM v")
def h18(spark, d):
    return values(spark, "id int, s string, want string", REPEATED).select("id", T.once(F.col("s")).alias("v"))


@query("h19_table_cells", "SELECT * FROM (VALUES (1, '| a b | x |'), (2, 'no table'), (3, '| 1 |')) t(id, v)")
def h19(spark, d):
    return values(spark, "id int, s string", [(1, "| a b a b | x x |"), (2, "no table"), (3, "|1 1|")]).select("id", T.table_line(F.col("s")).alias("v"))


@query("h29_where_is_value", "SELECT c_custkey, CASE WHEN n_name = 'NATION_' || c_nationkey THEN 'slot-bound' WHEN c_mktsegment = 'BUILDING' THEN 'ambiguous' WHEN contains(c_name, c_custkey::VARCHAR) THEN 'in-text' ELSE 'missing' END AS at FROM (SELECT *, 'X' AS n_name FROM customer)")
def h29(spark, d):
    c = table(spark, d, "customer")
    v = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("BUILDING")).otherwise(F.col("c_custkey").cast("string"))
    return c.select("c_custkey", T.where_is(v, F.lit("X"), F.array("c_mktsegment"), F.col("c_name")).alias("at"))


@query("h30_record_key", "SELECT c_custkey, c_mktsegment || '::' || CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE 'L' || least(c_nationkey, 7) || '#' || c_custkey END AS k FROM customer")
def h30(spark, d):
    printed = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.lit(" "))
    return table(spark, d, "customer").select("c_custkey", T.record_key(F.col("c_mktsegment"), printed, F.array(F.col("c_nationkey"), F.lit(7)), F.col("c_custkey")).alias("k"))


@query("h31_record_ids", "SELECT c_custkey, CASE WHEN r = 1 THEN seg || '/' || nat ELSE upper(substring(seg, 1, 12)) || '-' || printf('%03d', r - 1) END AS id FROM (SELECT c_custkey, c_mktsegment AS seg, c_nationkey AS nat, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS r FROM customer)")
def h31(spark, d):
    """A file is a segment of a nation; the first record of a file has its own id."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey"))
    made = F.concat(F.upper(F.substring("c_mktsegment", 1, 12)), F.lit("-"), F.format_string("%03d", F.col("r") - 1))
    own = F.when(F.col("r") == 1, F.concat_ws("/", "c_mktsegment", "c_nationkey")).otherwise(made)
    return table(spark, d, "customer").withColumn("r", r).select("c_custkey", own.alias("id"))


@query("h33_span_refs", "SELECT p_partkey, 'part-' || p_partkey || '.txt' AS file, unnest([p_size, p_size + 1]) AS line FROM part")
def h33(spark, d):
    s = F.format_string("see part-%d.txt::L%d and part-%d.txt::L%d", "p_partkey", "p_size", "p_partkey", F.col("p_size") + 1)
    return table(spark, d, "part").select("p_partkey", F.inline(T.span_refs(s)))


@query("h36_stem", "SELECT doc_id, 'run_' || source || '_' || lang AS s FROM documents")
def h36(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stem(F.concat(F.lit("/out/x/run_"), F.col("source"), F.lit("_"), F.col("lang"), F.lit(".csv"))).alias("s"))


@query("h37_strip_label", "SELECT * FROM (VALUES (1, 'name'), (2, 'partkey'), (3, 'part'), (4, 'x1')) t(id, k)")
def h37(spark, d):
    v = values(spark, "id int, key string, label string", [(1, "Part_Name", "Part"), (2, "partKey", "Supplier"), (3, "part", "PART"), (4, "supplier x1", "Supplier")])
    return v.select("id", T.strip_label(F.col("key"), F.col("label")).alias("k"))
