"""Statistics of scores: intervals, kappa, summaries, ranks, confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> list[Column]:
    """Score interval of a share."""
    p = k / F.nullif(n, F.lit(0))
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return [F.greatest(mid - half, F.lit(0.0)).alias("lo"), F.least(mid + half, F.lit(1.0)).alias("hi")]


def summary(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """Mean, sample deviation (0 for one run), least, greatest and number of runs."""
    return df.groupBy(*keys).agg(
        F.round(F.avg(value), digits).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), digits).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("runs")
    )


def kappa(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Agreement of two yes/no labels and what is left of it beyond chance."""
    m = df.agg(F.avg((a == b).cast("double")).alias("agreement"), F.avg(a.cast("double")).alias("pa"), F.avg(b.cast("double")).alias("pb"), F.count("*").alias("n"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select("n", "agreement", F.when(chance >= 1, 1.0).otherwise((F.col("agreement") - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("kappa"))


def confusion(df: DataFrame, truth: Column, said: Column, *keys: str) -> DataFrame:
    """D9."""
    g = df.groupBy(*keys) if keys else df
    return g.agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))
