"""Scalar text functions on columns (2.H): normalising, tokens, numbers, headings, spans, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that are folded to one.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2043\u2212\ufe58\ufe63\uff0d"
SPACES = "\u00a0\u2007\u2009\u202f\u205f\u3000"
NOTHING = "\u200b\u200c\u200d\u2060\ufeff"
NUMBER = r"-?\d+\.?\d*"
# Fixed value: a number with or without a sign that no letter, digit, underscore or hyphen touches before it, and no letter, digit or underscore behind.
STANDALONE = r"(?<![A-Za-z0-9_-])-?(?:\d+(?:\.\d*)?|\.\d+)(?![A-Za-z0-9_])"
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def alnum(s: Column) -> Column:
    """Only [a-z0-9] (H1)."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def spaced(s: Column) -> Column:
    """Lower-case words of [a-z0-9] with single spaces (H2)."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def snake(s: Column, default: str = "field") -> Column:
    """lower_snake_case; a name without letters or digits gets the default (H3)."""
    out = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))
    return F.when(out == "", F.lit(default)).otherwise(out)


def fold(s: Column) -> Column:
    """One dash, one space, no zero-width marks; digits in super- or subscript stay as they are (H4)."""
    return F.translate(s, DASHES + SPACES + NOTHING, "-" * len(DASHES) + " " * len(SPACES))


def squeeze(s: Column) -> Column:
    """Folded, lower case, white space collapsed (H5)."""
    return F.trim(F.regexp_replace(F.lower(fold(s)), r"\s+", " "))


def numbers(s: Column, drop_negative: bool = False) -> Column:
    """Every number written in a text; a tag's hyphen reads as a minus sign (H6, H7)."""
    found = F.transform(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    return F.filter(found, lambda x: x >= 0) if drop_negative else found


def standalone_numbers(s: Column) -> Column:
    """Numbers that aren't part of a word, tag or longer number (H8)."""
    return F.transform(F.regexp_extract_all(s, F.lit(STANDALONE), F.lit(0)), lambda x: x.cast("double"))


def has_number(s: Column, number: Column) -> Column:
    """Whether a number, in its short form, stands as a token of its own (H9)."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", number), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    pattern = F.concat(F.lit(r"(?<![\w.])"), F.regexp_replace(short, r"([.\-])", r"\\$1"), F.lit(r"(?![\w]|\.\d)"))
    return F.regexp_like(s, pattern)


def tokens(s: Column) -> Column:
    """Distinct [a-z0-9]+ tokens, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; two empty sets share nothing."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def closeness(g: Column, p: Column) -> Column:
    """1 for equal numbers, less by the relative difference, at least 0."""
    return F.greatest(F.lit(0.0), 1 - F.abs(g - p) / F.greatest(F.abs(g), F.abs(p), F.lit(1e-9)))


def recall(own: Column, other: Column) -> Column:
    """Mean, over one's own numbers, of the closest of the other's."""
    best = F.transform(own, lambda g: F.array_max(F.transform(other, lambda p: closeness(g, p))))
    total = F.aggregate(best, F.lit(0.0), lambda t, x: t + x)
    return F.when((F.size(own) == 0) | (F.size(other) == 0), 0.0).otherwise(total / F.nullif(F.size(own), F.lit(0)))


def agreement(a: Column, b: Column) -> Column:
    """Harmonic mean of both directions."""
    r, p = recall(a, b), recall(b, a)
    return F.when(r + p <= 0, 0.0).otherwise(2 * r * p / F.nullif(r + p, F.lit(0.0)))


def blend(semantic: Column, numeric: Column, has_numbers: Column, weight: float = 0.6) -> Column:
    """Weighted mean; the text alone decides where the reference has no numbers."""
    return F.when(has_numbers, weight * semantic + (1 - weight) * numeric).otherwise(semantic)


def blob(*cells: Column) -> Column:
    """Non-empty cells joined by ' | ' (H14)."""
    return F.concat_ws(" | ", *[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cells])


def unescape(s: Column) -> Column:
    """The usual character references, escaped underscores, lost arrows, runs of spaces."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(char))
    s = F.replace(s, F.lit("\\_"), F.lit("_"))
    s = F.regexp_replace(F.regexp_replace(s, r"\bfi\b", "→"), r"\bfl\b", "↓")
    return F.regexp_replace(s, " {2,}", " ")


def once(s: Column) -> Column:
    """A cell that repeats the same words over and over, once: the least period that divides it."""
    w = F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " ")
    n = F.size(w)
    fits = F.filter(F.sequence(F.lit(1), n), lambda p: (n % p == 0) & F.forall(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, i) == F.get(w, i % p)))
    return F.array_join(F.slice(w, F.lit(1), F.array_min(fits)), " ")


def table_line(s: Column) -> Column:
    """The cells of a |…| line, each once."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(s), r"^\||\|$", ""), r"\|"), lambda c: once(F.trim(c)))
    return F.when(F.trim(s).rlike(r"^\|.*\|$"), F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))).otherwise(s)


def heading(line: Column) -> Column:
    """The label in a line that is short, of two words or more and doesn't end a sentence; else null."""
    t = F.trim(line)
    shaped = (t != "") & (F.length(t) <= 90) & (F.size(F.split(t, r"\s+")) >= 2) & ~t.rlike("[.,;]$")
    return F.when(shaped, F.nullif(F.trim(F.regexp_replace(t, r"^[^\p{L}\p{N}]+", "")), F.lit("")))


def is_rule_off(line: Column) -> Column:
    """Only ruling characters."""
    return F.regexp_replace(line, r"[\s|:+\-=_*~.#]", "") == ""


def repair_separators(s: Column) -> Column:
    """No space around - and _ between word characters."""
    return F.regexp_replace(s, r"(\w)\s*([-_])\s*(\w)", "$1$2$3")


def spellings(s: Column) -> Column:
    """An identifier with _, - and space between its last two parts."""
    a, b = F.regexp_extract(s, "^(.*)_(.*)$", 1), F.regexp_extract(s, "^(.*)_(.*)$", 2)
    return F.when(s.contains("_"), F.array(s, F.concat_ws("-", a, b), F.concat_ws(" ", a, b))).otherwise(F.array(s))


def without_units(s: Column) -> Column:
    """H24."""
    return F.regexp_replace(s, r"[°%a-zA-Z/\s]", "")


def severity_word(s: Column) -> Column:
    """H25."""
    low = F.lower(s)
    return F.when(low.rlike("critical|emergency|immediate|stop"), "CRITICAL").when(low.rlike("warning|alert|caution"), "WARNING").otherwise("INFO")


def year(s: Column) -> Column:
    """H26."""
    return F.nullif(F.regexp_extract(s, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))


def as_number(s: Column) -> Column:
    """A number only where the whole text is one in plain notation."""
    t = F.trim(s)
    return F.when(t.rlike(NUMERIC), t.try_cast("double"))


def same_value(a: Column, b: Column) -> Column:
    """As numbers where both are, else as trimmed text."""
    x, y = as_number(a), as_number(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.trim(a) == F.trim(b))


def where_is(value: Column, slot: Column, others: Column, text: Column) -> Column:
    """In its slot, in another slot, somewhere in the text, or nowhere."""
    v = F.trim(value)
    n = F.size(F.filter(others, lambda o: same_value(o, v)))
    return F.when(same_value(slot, v), "slot-bound").when(n > 0, "ambiguous").when(F.contains(text, v), "in-text").otherwise("missing")


def record_key(file: Column, printed: Column, lines: Column, seq: Column) -> Column:
    """H30."""
    own = F.nullif(F.upper(F.trim(printed)), F.lit(""))
    return F.concat(file, F.lit("::"), F.coalesce(own, F.concat(F.lit("L"), F.array_min(lines).cast("string"), F.lit("#"), seq.cast("string"))))


def span(key: Column, text: Column, width: int = 200) -> Column:
    """H32."""
    return F.substring(F.concat_ws(" | ", key, text), 1, width)


def span_refs(s: Column) -> Column:
    """Every file::Ln in a span as (file, line)."""
    files = F.regexp_extract_all(s, F.lit(r"([\w.\-]+)::L(\d+)"), F.lit(1))
    lines = F.transform(F.regexp_extract_all(s, F.lit(r"([\w.\-]+)::L(\d+)"), F.lit(2)), lambda x: x.cast("int"))
    return F.arrays_zip(files.alias("file"), lines.alias("line"))


def title(s: Column) -> Column:
    """H38."""
    return F.nullif(F.regexp_extract(s, r"(?m)^# (.+)$", 1), F.lit(""))


STOP_WORDS = ["the", "and", "of", "to", "in", "a", "is", "that", "for", "on"]


def content_words(s: Column) -> Column:
    """H39."""
    return F.array_except(F.regexp_extract_all(F.lower(s), F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, STOP_WORDS)))


def rough_tokens(s: Column) -> Column:
    """H40."""
    return F.floor(F.length(s) / 4)


def strip_label(key: Column, label: Column) -> Column:
    """A property key without its label's prefix."""
    k, p = alnum(key), alnum(label)
    return F.when((k != p) & F.startswith(k, p), F.substring(k, F.length(p) + 1, F.length(k))).otherwise(k)


def stem(file: Column) -> Column:
    """A.b/C.txt -> C: the name without folder and ending."""
    return F.regexp_replace(F.regexp_replace(file, "^.*/", ""), r"\.[^.]*$", "")
