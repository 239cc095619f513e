"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared as sequences of words (split at single spaces).  The bound is one edit of a
word - put in, left out or replaced - for lines of ``NEAR_WORDS`` words or more, and no edit for
lines of ``LEAST_WORDS`` or more; shorter lines (rulings, greetings, items of lists) say too
little to be called copies and always stay.  A line goes if an earlier line is
equal or within the bound; earlier means less (doc_id, hash of the text, line number).

Every distinct line stands for its first place.  Its variants are itself and itself without one
word.  Two lines are one replacement apart if they agree without the word at one position, and
one insertion apart if one without a word is the other.  Both are joins on hashed variants, and
as only the earliest line of a variant matters, the join is with a minimum per variant: rows
grow with the lines, not with the square of a group.  The earliest line is then compared word
by word.

Most lines have no near line at all.  Before variants are made, a line must share its first or
its last half (cut for its own length or for a partner one word shorter) with another distinct
line; one edit leaves one half untouched, so this loses nothing.

Defined results: null text stays null and has no lines; lines are what stands between line
feeds; a text that loses all its lines becomes empty.  Very long texts and lines are compared
whole.  Ties: of equal lines the one at the earliest place stays.  Rows with equal doc_id and text are at the
same place, so none of them is the later one.  Null doc_id comes before all others.  Empty
table: empty result.  Other columns pass through, whatever their names.  Equality of whole lines rests on 128 bits of
hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_WORDS, NEAR_WORDS = 5, 8
#: Lines, and shared halves, that may be broadcast; beyond, the join shuffles.
BROADCAST_LINES, BROADCAST_KEYS = 300_000, 1_000_000


def _hash(words: Column, *more) -> Column:
    return F.xxhash64(F.array_join(words, " "), *[F.lit(m) if not isinstance(m, Column) else m for m in more])


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark, at, line, words, m of every line that may be compared."""
    text = F.col("text").cast("string")
    out = docs.where("text is not null").select(F.col("doc_id"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    words = F.split("line", " ")
    return out.withColumn("words", words).withColumn("m", F.size("words")).where(F.col("m") >= LEAST_WORDS)


def _halves() -> Column:
    """Hashes of the halves of a line: for partners of its own length, and for those a word shorter."""
    m, out = F.col("m"), []
    for part, less in ((1, 0), (2, 1)):
        n = m - less
        h = F.floor(n / 2).cast("int")
        out += [_hash(F.slice("words", F.lit(1), h), n, 0), _hash(F.slice("words", m - (n - h) + 1, n - h), n, 1)]
    return F.array(*out)


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are exactly one word edit apart."""
    n, k = F.size(a), F.size(b)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))

    def without(long, short):
        # the first place where they part; the rest must agree one word on
        same = F.zip_with(long, short, lambda x, y: x.eqNullSafe(y))
        p = F.array_position(same, False).cast("int")
        return F.slice(long, p + 1, F.size(long)) == F.slice(short, p, F.size(long))

    return F.when(n == k, differ == 1).when(n == k + 1, without(a, b)).when(k == n + 1, without(b, a)).otherwise(F.lit(False))


def drops(docs: DataFrame) -> DataFrame:
    """doc_id, mark, at of the lines that go."""
    ws = common.Workspace(docs.sparkSession, "lines")
    lines = _lines(docs)
    place = F.struct("doc_id", "mark", "at")
    keyed = lines.select(
        F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(1)).alias("k2"), "doc_id", "mark", "at",
        F.when(F.col("m") >= NEAR_WORDS, _halves()).alias("halves"),
    )
    keyed = ws.save(keyed, "keyed")
    classes = ws.save(keyed.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.first("halves").alias("halves")), "classes")
    again = keyed.join(classes.select("k1", "k2", "first"), ["k1", "k2"]).where(place != F.col("first")).select("doc_id", "mark", "at")
    again = ws.save(again, "again")
    ws.drop(keyed)
    # lines that share a half with another line; from here on its first place stands for a line
    half = classes.where("halves is not null").select("first", F.posexplode("halves").alias("part", "half"))
    shared = ws.save(half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), "shared")
    near = half.join(_small(shared, BROADCAST_KEYS), "half", "left_semi").groupBy("first").agg(F.bool_or(F.col("part") % 2 == 0).alias("head"), F.bool_or(F.col("part") % 2 == 1).alias("tail"))
    near = ws.save(near.select("first.*", "head", "tail"), "near")
    own = lines.alias("l").join(
        _small(near, BROADCAST_LINES).alias("s"), F.col("l.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("l.mark") == F.col("s.mark")) & (F.col("l.at") == F.col("s.at"))
    ).select(F.struct("l.doc_id", "l.mark", "l.at").alias("first"), "words", "m", "head", "tail").dropDuplicates(["first"])
    own = ws.save(own, "own")
    # with its first half shared, a line's edit is in the rest of it, and the other way round
    low = F.when(F.col("tail"), 1).otherwise(F.floor((F.col("m") - 1) / 2).cast("int") + 1)
    high = F.when(F.col("head"), F.col("m")).otherwise(F.floor((F.col("m") - 1) / 2).cast("int") + 1)
    cut = own.select("first", "words", "m", F.explode(F.sequence(low, high)).alias("i")).select(
        "first", "i", _hash(F.concat(F.slice("words", F.lit(1), F.col("i") - 1), F.slice("words", F.col("i") + 1, F.col("m")))).alias("variant")
    )
    cut = ws.save(cut, "variants")
    whole = own.select(_hash(F.col("words")).alias("variant"), F.col("first").alias("other"))
    # one replacement: the same variant at the same position, as of the earliest line that has it
    least = ws.save(cut.groupBy("variant", "i").agg(F.min("first").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    same = cut.join(_small(least, BROADCAST_LINES), ["variant", "i"]).where("earliest < first").select(F.col("first").alias("line"), "earliest")
    # one insertion: a line without a word is another line; whichever is later goes
    both = ws.save(cut.join(_small(whole, BROADCAST_LINES), "variant").select("first", "other"), "insertions")
    longer = both.where("other < first").select(F.col("first").alias("line"), F.col("other").alias("earliest"))
    shorter = both.where("first < other").groupBy(F.col("other").alias("line")).agg(F.min("first").alias("earliest"))
    pairs = same.union(longer).union(shorter).distinct()
    mine, theirs = own.select(F.col("first").alias("line"), "words"), own.select(F.col("first").alias("earliest"), F.col("words").alias("their"))
    gone = pairs.join(mine, "line").join(theirs, "earliest").where(_one_edit(F.col("words"), F.col("their"))).select("line").distinct()
    # of a line that goes, the first place goes as well; the later ones are gone already
    out = ws.save(again.union(gone.select("line.*")).distinct(), "drops")
    ws.drop(again, classes, shared, near, own, cut, least, both)
    return out


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast up to so many rows; beyond, the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without its dropped lines, and ``n_lines``, ``n_dropped``.

    A column of docs that has one of these names stays; the new one gets underscores until it is new.
    """
    names = docs.columns
    g_doc, g_mark, g_ats, g_own = (common.fresh(docs, c) for c in ("g_doc", "g_mark", "g_ats", "g_own"))
    gone = drops(docs.select("doc_id", "text")).groupBy("doc_id", "mark").agg(F.collect_set("at").alias("ats")).toDF(g_doc, g_mark, g_ats)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(F.col("text").cast("string")).alias(g_own))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col(g_doc)) & (F.col(g_own) == F.col(g_mark)), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    kept = F.filter(lines, lambda line, k: ~F.array_contains(g_ats, k))
    text = F.when(F.col(g_ats).isNull(), F.col("text").cast("string")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(common.fresh(docs, "n_lines")), F.coalesce(F.size(g_ats), F.lit(0)).cast("long").alias(common.fresh(docs, "n_dropped")),
    )


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(common.read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents of which nothing is left go."""
    dropped = F.col(common.fresh(docs, "n_dropped"))
    out = clean(docs).where((dropped == 0) | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(dropped > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = f"""
WITH l AS (
  SELECT doc_id, k AS ln, ls[k] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
c AS (
  SELECT line, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS m, min(row(doc_id, ln)) AS f
  FROM l WHERE len(string_split(line, ' ')) >= {LEAST_WORDS} GROUP BY line),
v AS (
  SELECT line, f, m, i, array_to_string(w[1:i - 1] || w[i + 1:], ' ') AS x
  FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM c WHERE m >= {NEAR_WORDS})),
g AS (
  SELECT line FROM (SELECT line, f, min(f) OVER (PARTITION BY i, m, x) AS e FROM v) WHERE e < f
  UNION SELECT c.line FROM c JOIN v ON v.x = c.line AND c.m = v.m - 1 WHERE c.m >= {NEAR_WORDS} AND v.f < c.f
  UNION SELECT v.line FROM c JOIN v ON v.x = c.line AND c.m = v.m - 1 WHERE c.m >= {NEAR_WORDS} AND c.f < v.f),
k AS (
  SELECT l.doc_id, l.ln, l.line, c.line IS NOT NULL AND (g.line IS NOT NULL OR row(l.doc_id, l.ln) > c.f) AS gone
  FROM l LEFT JOIN c ON l.line = c.line LEFT JOIN g ON l.line = g.line)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(t, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT gone) AS t FROM k GROUP BY doc_id) USING (doc_id)
"""
