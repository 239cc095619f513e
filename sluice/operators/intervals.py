"""Intervals: alarms to events, overlap with windows, coverage, merging, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.detect import minutes
from sluice.sources.tables import small


def merge_alarms(alarms: DataFrame, gap_min: int = 15) -> DataFrame:
    """Alarms of a sensor no more than a gap apart are one event.

    ``session_window`` merges partial sessions before the shuffle; a gap of exactly the limit
    still merges.
    """
    session = F.session_window("ts", f"{gap_min} minutes")
    return (
        alarms.groupBy("sensor", session.alias("_w"))
        .agg(
            F.min("ts").alias("start"), F.max("ts").alias("end"),
            F.when(F.max((F.col("severity") == "CRITICAL").cast("int")) == 1, "CRITICAL").otherwise("WARNING").alias("severity"),
            F.array_sort(F.collect_set("detector")).alias("detectors"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.count("*").alias("n_alarms"),
        ).drop("_w")
    )


def overlaps(events: DataFrame, windows: DataFrame) -> Column:
    """Closed intervals of one sensor that share at least an instant."""
    return (events["sensor"] == windows["sensor"]) & (events["start"] <= windows["gt_end"]) & (events["end"] >= windows["gt_start"])


def unmatched(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events that overlap no window."""
    return events.join(small(windows), overlaps(events, windows), "left_anti")


def merged(df: DataFrame, keys: list[str], touch: bool = True) -> DataFrame:
    """Union of overlapping intervals (start, end) per key, by a running maximum."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = before.isNull() | (F.col("start") > before if touch else F.col("start") >= before)
    out = df.withColumn("_new", fresh.cast("int")).withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*keys, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_k")


def coverage(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: status, span and union of what events cover, latency."""
    hit = windows.join(events.select("sensor", "start", "end", "detectors", "rule_ids"), "sensor").where((F.col("start") <= F.col("gt_end")) & (F.col("end") >= F.col("gt_start")))
    spans = hit.groupBy("gt_id").agg(
        F.min("start").alias("det_start"), F.max("end").alias("det_end"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("detectors")))).alias("detectors"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rule_ids")))).alias("rules"),
    )
    clipped = hit.select("gt_id", F.greatest("start", "gt_start").alias("start"), F.least("end", "gt_end").alias("end"))
    covered = merged(clipped, ["gt_id"]).groupBy("gt_id").agg(F.sum(minutes(F.col("end"), F.col("start"))).alias("covered"))
    length = minutes(F.col("gt_end"), F.col("gt_start"))
    out = windows.join(spans, "gt_id", "left").join(covered, "gt_id", "left")
    found = F.col("det_start").isNotNull()
    return out.select(
        "gt_id", "sensor", "atype", F.when(found, "DETECTED").otherwise("MISSED").alias("status"), "det_start", "det_end", "detectors", "rules",
        F.when(found, F.greatest(minutes(F.col("det_start"), F.col("gt_start")), F.lit(0.0))).alias("latency_min"),
        F.when(~found, 0.0).when(length <= 0, 100.0).otherwise(100.0 * F.col("covered") / length).alias("coverage_pct"),
        length.alias("length_min"),
    )


def episodes(df: DataFrame, keys: list[str], holds: Column) -> DataFrame:
    """How often a condition begins to hold along ts."""
    w = Window.partitionBy(*keys).orderBy("ts")
    begins = holds & ~F.coalesce(F.lag(holds).over(w), F.lit(False))
    return df.withColumn("_b", begins.cast("int")).groupBy(*keys).agg(F.sum("_b").alias("episodes"))
