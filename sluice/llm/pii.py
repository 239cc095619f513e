"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything happens inside a row with built-in functions, so the plan is one map over the table.
Offsets count code points.  They come from the texts between the matches, summed up in blocks,
so the work stays close to the text's length however many matches there are.

Kinds: email, ip (four parts of at most 255), card (12 to 19 digits, Luhn), phone (9 to 15
digits), and iban (mod 97).  A failing match is dropped and not tried again elsewhere.

Patterns are possessive and may only begin where a run begins or where the last match ended:
the same matches as without, but no long run is scanned again and again.

Defined results: null text is the empty text and has no spans.  Repeated rows give repeated
rows; an empty table gives an empty result; columns of the docs pass through.  Very long texts
are searched whole.  Ties: spans that start together stand in the order of the kinds.  The score
(0 to 100) leaves with each span: ``op7_pii`` lists the scores in the order of its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ["email", "ip", "card", "phone", "iban"]
BLOCK = 256

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERN = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: A cheap test that a text must pass before its pattern is tried at all.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
}
#: Score of a confirmed span in hundredths, and the words shortly before it that raise the score.
SCORE = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 90}
CONTEXT = {
    "email": "e-?mail|contact|write|mailto",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|pay",
    "phone": "phone|tel|call|mobile|fax|contact",
    "iban": "iban|account|bank|transfer",
}
CONTEXT = {k: f"(?:^|[^a-z0-9_])(?:{w})(?:[^a-z0-9_]|$)" for k, w in CONTEXT.items()}
NEAR, RAISE = 40, 10
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    back = F.reverse(number)

    def add(total, k):
        d = F.ascii(F.substring(back, k, F.lit(1))) - 48
        return total + F.when(k % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 when its rearranged value is divided by 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest, k):
        c = F.ascii(F.substring(turned, k, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        # the length goes first: the sum then never runs over a long number
        return F.when(F.length(digits(match)) > 19, F.lit(False)).otherwise(luhn(digits(match)))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        bare = F.regexp_replace(match, " ", "")
        return F.length(bare).between(15, 34) & mod97(bare)
    return F.lit(True)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: an array of (start, order, kind, end, score), sorted by start, then kind.

    Should the docs have a column ``pii``, the new one's name gets underscores until it is new.
    """
    names, pii = docs.columns, common.fresh(docs, "pii")
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    none = "cast(array() as array<string>)"
    for k in KINDS:
        ok = NEEDS[k](F.col("__t"))
        out = out.withColumn(f"__m_{k}", F.when(ok, F.regexp_extract_all("__t", F.lit(PATTERN[k]), F.lit(0))).otherwise(F.expr(none)))
    for k in KINDS:
        out = out.withColumn(f"__g_{k}", F.when(F.size(f"__m_{k}") > 0, F.split("__t", PATTERN[k], -1)).otherwise(F.expr(none)))
    for k in KINDS:
        lens = f"zip_with(slice(__g_{k}, 1, size(__m_{k})), __m_{k}, (g, m) -> struct(length(g) as g, length(m) as m))"
        out = out.withColumn(f"__l_{k}", F.expr(lens))
    for k in KINDS:
        out = out.withColumn(
            f"__b_{k}",
            F.expr(f"if(size(__l_{k}) = 0, cast(array() as array<array<struct<g: int, m: int>>>), transform(sequence(0, (size(__l_{k}) - 1) div {BLOCK}), b -> slice(__l_{k}, b * {BLOCK} + 1, {BLOCK})))"),
        )
    running = "aggregate({items}, struct({first} as at, cast(array() as array<int>) as out), (s, x) -> struct(s.at + x.g + x.m as at, concat(s.out, array(s.at + {of})) as out), s -> s.out)"
    for k in KINDS:
        sums = f"transform(__b_{k}, b -> struct(aggregate(b, 0, (t, x) -> t + x.g + x.m) as g, 0 as m))"
        offsets = running.format(items=sums, first="0", of="0")
        inner = running.format(items="b", first="o", of="x.g")
        out = out.withColumn(f"__s_{k}", F.expr(f"flatten(zip_with(__b_{k}, {offsets}, (b, o) -> {inner}))"))
    spans = [_spans(k, order) for order, k in enumerate(KINDS)]
    return out.withColumn(pii, F.array_sort(F.concat(*spans))).select(*[F.col(f"`{c}`") for c in names], pii)


def _spans(kind: str, order: int) -> Column:
    """The confirmed spans of one kind, from its matches, the gaps before them and their starts."""
    matches, gaps = F.col(f"__m_{kind}"), F.slice(f"__g_{kind}", F.lit(1), F.size(f"__m_{kind}"))

    def span(x, start):
        close = F.lower(F.right(x["g"], F.lit(NEAR))).rlike(CONTEXT[kind])
        return F.struct(
            start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end"),
            (F.lit(SCORE[kind]) + F.when(close, F.lit(RAISE)).otherwise(F.lit(0))).alias("score"), x["m"].alias("match"),
        )

    zipped = F.zip_with(F.arrays_zip(matches.alias("m"), gaps.alias("g")), f"__s_{kind}", span)
    good = F.filter(zipped, lambda x: confirmed(kind, x["match"]))
    return F.transform(good, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "order", "kind", "end", "score")]))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda x: x["order"] < 4)
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"))


def _oracle_kind(order: int, kind: str, pattern: str, test: str) -> str:
    return f"""
  SELECT r, {order} AS o, '{kind}' AS kind, s AS a, s + length(m) AS b, {SCORE[kind]} + CASE WHEN regexp_matches(lower(right(g, {NEAR})), '{CONTEXT[kind]}') THEN {RAISE} ELSE 0 END AS score FROM (
    SELECT r, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS s
    FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d))
  WHERE {test}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ascii(reverse({_DIGITS})[i]) - 48 WHEN ascii(reverse({_DIGITS})[i]) > 52 THEN 2 * (ascii(reverse({_DIGITS})[i]) - 48) - 9 ELSE 2 * (ascii(reverse({_DIGITS})[i]) - 48) END)) % 10 = 0"
_PARTS = "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0"
_BARE = "replace(m, ' ', '')"
_MOD = f"list_reduce(list_prepend(0, list_transform(string_split({_BARE}[5:] || {_BARE}[1:4], ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda x, y: (x * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1"
#: The base patterns as stated; DuckDB's engine is linear and needs no guards.
ORACLE = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(
        [
            _oracle_kind(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            _oracle_kind(1, "ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", f"length(m) < 100 AND {_PARTS}"),
            _oracle_kind(2, "card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
            _oracle_kind(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
            _oracle_kind(4, "iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", f"length({_BARE}) BETWEEN 15 AND 34 AND {_MOD}"),
        ]
    )
    + """)
SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_email, count(*) FILTER (WHERE o = 1) AS n_ip, count(*) FILTER (WHERE o = 2) AS n_card, count(*) FILTER (WHERE o = 3) AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (WHERE o < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o), '') AS spans, coalesce(string_agg(score::VARCHAR, ',' ORDER BY a, o), '') AS scores
FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id
"""
)
