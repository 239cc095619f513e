"""Logs of people: role by zone decisions, caps, acknowledgements; yes, no and can't tell are three values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import NUMERIC


def decision(s: Column) -> Column:
    """True, false, or null where the text doesn't decide."""
    low = F.lower(F.trim(s))
    return F.when(low.isin("yes", "y", "true", "allowed", "authorized"), True).when(low.isin("no", "n", "false", "denied", "prohibited"), False)


def one_decision(cells: Column) -> Column:
    """The decision of a record with exactly one deciding cell; null where there are none or several."""
    found = F.filter(F.transform(cells, decision), lambda x: x.isNotNull())
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def one_number(cells: Column) -> Column:
    """The whole number of a record with exactly one numeric cell, cut off at the point."""
    found = F.filter(cells, lambda x: F.trim(x).rlike(NUMERIC))
    return F.when(F.size(found) == 1, F.get(F.transform(found, lambda x: F.trim(x).try_cast("double").cast("int")), F.lit(0)))


def in_vocabulary(cells: Column, words: Column) -> Column:
    """The first cell that is one of the words, whatever its case."""
    return F.get(F.filter(cells, lambda c: F.exists(words, lambda w: F.lower(F.trim(c)) == F.lower(w))), F.lit(0))


def first_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of a key, by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
