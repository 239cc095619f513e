"""Null controls, perturbations and samples; a seed and a key give the same result wherever a row is."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sluice.functions.text import STANDALONE


def draw(seed: int, *keys) -> Column:
    """A pseudo-random order that only hangs on seed and keys: the MD5 of them, which any engine makes alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def shifted(df: DataFrame, key: str, value: str, seed: int, group: list[str] | None = None) -> DataFrame:
    """Values passed on to the next row in a seeded order, the last to the first: the same values, each moved (M1, M2, M6)."""
    by = group or []
    w = Window.partitionBy(*by).orderBy(draw(seed, key), key)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("moved", F.coalesce(F.lead(value).over(w), F.first(value).over(full)))


def deranged(df: DataFrame, key: str, value: str, seed: int, tries: int = 100) -> DataFrame:
    """As ``shifted``, drawn again while a row keeps its value (M1); the rule table is small."""
    for k in range(tries):
        out = shifted(df, key, value, seed + k)
        if not out.where(F.col("moved") == F.col(value)).limit(1).count():
            return out
    return out


def _rewrite(f):
    """A text function as a vectorised UDF; null stays null."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: f(t) if isinstance(t, str) else None)

    return run


def corrupt(text: str) -> str:
    """Every number x that stands alone becomes 3x + 7; identifiers stay (M3)."""
    return re.sub(STANDALONE, lambda m: f"{3 * float(m[0]) + 7:.12g}", text)


def backwards(text: str) -> str:
    """The numbers that stand alone in a text, in reverse order (M5)."""
    own = re.findall(STANDALONE, text)
    return re.sub(STANDALONE, lambda m: own.pop(), text)


corrupt_numbers, reverse_numbers = _rewrite(corrupt), _rewrite(backwards)


def word_salad(text: str, seed: int = 0) -> Column:
    """The words of a text in an order of their own, the same for the same text (M7)."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    drawn = F.array_sort(F.transform(words, lambda w, k: F.struct(draw(seed, k, w).alias("d"), w.alias("w"))))
    return F.array_join(F.transform(drawn, lambda x: x["w"]), " ")


def rotated(df: DataFrame, key: str, numbers: str, seed: int) -> DataFrame:
    """Whole lists of numbers passed on among records with as many of them (M4)."""
    return shifted(df.withColumn("_n", F.size(numbers)), key, numbers, seed, ["_n"]).drop("_n")


def padded(df: DataFrame, key: str, numbers: str, corpus: str) -> DataFrame:
    """Each record's numbers with those of its corpus that it hasn't (M8).

    A corpus's distinct numbers are made by partial sets on every task, and meet its records by an
    equal join; nothing is gathered over corpora.
    """
    every = df.select(corpus, F.explode(numbers).alias("x")).distinct().groupBy(corpus).agg(F.array_sort(F.collect_list("x")).alias("every"))
    return df.join(every, corpus, "left").withColumn("padded", F.concat(numbers, F.array_except(F.coalesce("every", numbers), numbers))).drop("every")


def stratified(df: DataFrame, key: str, strata: list[str], k: int, seed: int) -> DataFrame:
    """k rows drawn in turn from every stratum (M11): only the first k of a stratum can be among them."""
    w = Window.partitionBy(*strata).orderBy(draw(seed, key), key)
    r = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= k)
    return r.orderBy("turn", *strata).limit(k)
