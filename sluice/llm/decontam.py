"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is ``WIDTH`` consecutive words of an item (all of them where an item has fewer).  To
hold a window whole a document must hold each of its words, so one necessary word is enough as
prefix: the rarest, by its count in all documents.  The join on that word brings document
positions and windows together; the word's offset fixes where the window would begin and must
leave room before and after (positional and length bounds); then the document's words in that
place are compared with the window's, which is exact.

The documents are read twice, once to count the benchmark's words and once to join.  Windows
are broadcast while there are at most ``BROADCAST_WINDOWS``; then the comparison runs in the
scan's own stage and only true hits leave it.  Beyond, the join shuffles words with the few
words around them and the adaptive planner splits frequent words.

Defined results: null text has no words; items without words or without an id have no windows;
items that share an id count as one; rows that share doc_id and text get equal rows; an item's
window repeated in it or in other items is one window of all of them.  No items: nothing is hit.
Very long texts are compared whole.  Ties: of words equally rare in a window the least leads,
which changes no result.  Repeated rows give repeated rows, an empty table an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 10
BROADCAST_WINDOWS = 300_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    low = common.ascii_lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _windows(items: DataFrame, width: int) -> DataFrame:
    """window_id, window, item_id: a row for each distinct window of each item."""
    cut = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = cut.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))).alias("s"))
    return at.select("item_id", F.slice("w", F.col("s"), F.least(F.lit(width), F.size("w"))).alias("window")).distinct().withColumn(
        "window_id", F.sha2(F.array_join("window", " "), 256)
    )


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, broadcast: int = BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame, common.Workspace]:
    """What the scan finds, and the windows' items.

    The first has doc_id, mark (a hash of the text), n_words, at, size, window_id: a row with
    null ``at`` for each document and one for each place where a window occurs.
    """
    spark = docs.sparkSession
    ws = common.Workspace(spark, "decontam")
    owners = ws.save(_windows(items, width), "windows")
    distinct = owners.select("window_id", "window").distinct()
    n = distinct.count()
    few = (lambda d: F.broadcast(d)) if n <= broadcast else (lambda d: d)
    cut = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"), words(F.col("text")).alias("w"))
    base = cut.select("doc_id", "mark", F.size("w").alias("n_words"), F.expr("posexplode(concat(array(cast(null as string)), w))").alias("at", "word"), "w")
    if not n:
        scan = base.where("word is null").select("doc_id", "mark", "n_words", F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("window_id"))
        return ws.save(scan, "hits"), owners, ws
    vocabulary = distinct.select(F.explode("window").alias("word")).distinct()
    counts = (
        cut.select(F.explode("w").alias("word")).join(few(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("seen"))
    )
    counts = ws.save(counts, "counts")
    # the rarest word leads; a window with a word that no document has can't occur at all
    lead = (
        distinct.select("window_id", "window", F.posexplode("window").alias("offset", "word")).join(counts, "word")
        .groupBy("window_id").agg(F.min(F.struct("seen", "word", "offset")).alias("lead"), F.count("*").alias("known"), F.first("window").alias("window"))
        .where(F.col("known") == F.size("window")).select("window_id", "window", F.col("lead.word").alias("word"), F.col("lead.offset").alias("offset"))
    )
    lead = ws.save(lead, "lead")
    start = F.col("at") - F.col("offset")
    fits = (start >= 1) & (start + F.size("window") - 1 <= F.col("n_words"))
    if n <= broadcast:
        joined = base.join(F.broadcast(lead), "word", "left")
        same = F.slice("w", F.greatest(start, F.lit(1)), F.size("window")) == F.col("window")
    else:
        first = F.greatest(F.col("at") - (width - 1), F.lit(1))
        near = base.select("doc_id", "mark", "n_words", "at", "word", first.alias("first"), F.when(F.col("word").isNotNull(), F.slice("w", first, 2 * width - 1)).alias("w"))
        joined = near.join(vocabulary, "word", "left_semi").join(lead, "word").unionByName(near.where("word is null"), allowMissingColumns=True)
        same = F.slice("w", F.greatest(start - F.col("first") + 1, F.lit(1)), F.size("window")) == F.col("window")
    found = joined.where(F.col("word").isNull() | (fits & same)).select(
        "doc_id", "mark", "n_words",
        F.when(F.col("word").isNotNull(), start).alias("at"), F.when(F.col("word").isNotNull(), F.size("window")).alias("size"), F.when(F.col("word").isNotNull(), F.col("window_id")).alias("window_id"),
    )
    return ws.save(found, "hits"), owners, ws


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, mark, n_words, n_hit, n_items, items (sorted), contaminated."""
    found, owners, _ = hits(docs, items, width, broadcast)
    inside = found.where("at is not null")
    covered = (
        inside.select("doc_id", "mark", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("p")).distinct()
        .groupBy("doc_id", "mark").agg(F.count("*").alias("n_hit"))
    )
    named = (
        inside.select("doc_id", "mark", "window_id").distinct().join(owners.select("window_id", "item_id"), "window_id")
        .groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    each = covered.alias("c").join(named.alias("n"), F.col("c.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("c.mark") == F.col("n.mark"))).select("c.doc_id", "c.mark", "n_hit", "items")
    d = found.where("at is null")
    out = d.alias("d").join(each.alias("e"), F.col("d.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("d.mark") == F.col("e.mark")), "left")
    items_or_none = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "d.doc_id", "d.mark", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_or_none).cast("long").alias("n_items"), items_or_none.alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    found, _, _ = hits(docs, common.read(spark, sf_dir, "benchmark"))
    own, text_mark = common.fresh(docs, "hit_id"), common.fresh(docs, "hit_mark")
    bad = found.where("at is not null").select(F.col("doc_id").alias(own), F.col("mark").alias(text_mark)).distinct()
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(own)) & (mark == F.col(text_mark)), "left_anti")


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
grams AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, s, g.n, item_id FROM grams g JOIN win ON g.t = win.t AND g.n = win.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
