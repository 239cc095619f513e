"""Detectors over telemetry (sensor, ts, value): severity, on-delay, stuck, drift, sustained, correlated.

The detectors read three columns and nothing else; ``telemetry`` refuses a frame with more, so
labels can't leak in.  Readings that aren't numbers are dropped first: NaN compares as greater
than everything here but as neither in the rules' semantics.

State that runs along a sensor's readings is kept in slices of time: a window inside each
(sensor, slice), and one over the slices' summaries.  So a sensor with a large share of all
readings is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.sources.tables import small

COLUMNS = {"sensor", "ts", "value"}
SLICE = "1 day"
STUCK_TOLERANCE = 1e-6
CADENCE_S = 30


def telemetry(df: DataFrame) -> DataFrame:
    """Numbers only; raises if the frame has any other column."""
    if set(df.columns) != COLUMNS:
        raise ValueError(f"telemetry has exactly the columns {sorted(COLUMNS)}, not {df.columns}")
    return df.where(F.col("value").isNotNull() & ~F.isnan("value"))


def severity(value: Column, crit_hi: Column, crit_lo: Column, warn_hi: Column, warn_lo: Column) -> Column:
    """Critical bounds before warning bounds, strict; a missing bound never holds."""
    return F.when((value > crit_hi) | (value < crit_lo), "CRITICAL").when((value > warn_hi) | (value < warn_lo), "WARNING")


def rule_class(bounds: list[str], mapped: Column) -> Column:
    """Any bound makes a threshold rule; a mapped threshold without bounds is maintenance."""
    has = F.coalesce(*[F.col(b) for b in bounds]).isNotNull()
    return F.when(has, "ThresholdRule").when(mapped.isNull() | mapped.isin("ThresholdRule", "OperationalRule"), "MaintenanceRule").otherwise(mapped)


def per_sensor(rules: DataFrame, *fields: str) -> DataFrame:
    """A row for each sensor with its rules in order, so that a reading meets them all in one row."""
    return rules.groupBy("sensor").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("rules"))


def judged(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """Each reading with the worst severity and the first rule of that severity; null where no rule holds."""
    own = per_sensor(rules, "rule_id", "warn_hi", "crit_hi", "warn_lo", "crit_lo")
    found = F.transform("rules", lambda r: F.struct(severity(F.col("value"), r["crit_hi"], r["crit_lo"], r["warn_hi"], r["warn_lo"]).alias("severity"), r["rule_id"].alias("rule_id")))
    worst = F.coalesce(*[F.get(F.filter("found", _is(s)), F.lit(0)) for s in ("CRITICAL", "WARNING")])
    return (
        readings.join(small(own), "sensor", "left").withColumn("found", found).withColumn("worst", worst)
        .select("sensor", "ts", "value", F.col("worst.severity").alias("severity"), F.col("worst.rule_id").alias("rule_id"))
    )


def _is(s: str):
    return lambda x: x["severity"] == s


def run_start(df: DataFrame, keys: list[str], holds: Column, slice_: str = SLICE) -> DataFrame:
    """``df`` with ``run_start``: where it holds, the first ts since the last one at which it didn't.

    Inside a slice the run starts after the slice's last miss so far; if there is none, it is
    the run that was open when the slice began.
    """
    df = df.withColumn("_holds", F.coalesce(holds, F.lit(False))).withColumn("_slice", F.window(F.col("ts").cast("timestamp"), slice_)["start"])
    so_far = Window.partitionBy(*keys, "_slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_misses", F.sum((~F.col("_holds")).cast("int")).over(so_far))
    local = df.withColumn("_local", F.min(F.when(F.col("_holds"), F.col("ts"))).over(Window.partitionBy(*keys, "_slice", "_misses").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    ends = df.groupBy(*keys, "_slice").agg(F.max(F.when(~F.col("_holds"), F.col("ts"))).alias("_miss"))
    # the run open at a slice's end starts after its last miss, or is the one open at its beginning
    tail = df.join(ends.select(*keys, "_slice", "_miss"), [*keys, "_slice"]).where(F.col("_holds") & (F.col("_miss").isNull() | (F.col("ts") > F.col("_miss"))))
    tail = tail.groupBy(*keys, "_slice").agg(F.min("ts").alias("_tail"))
    ends = ends.join(tail, [*keys, "_slice"], "left")
    # the first tail since the last slice with a miss, that slice's own tail included
    ends = ends.withColumn("_reset", F.count("_miss").over(Window.partitionBy(*keys).orderBy("_slice")))
    opened = Window.partitionBy(*keys, "_reset").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_open_after", F.min("_tail").over(opened))
    ends = ends.withColumn("_open", F.lag("_open_after").over(Window.partitionBy(*keys).orderBy("_slice")))
    out = local.join(ends.select(*keys, "_slice", "_open"), [*keys, "_slice"])
    start = F.when(F.col("_holds"), F.when(F.col("_misses") == 0, F.coalesce("_open", "_local")).otherwise(F.col("_local")))
    return out.withColumn("run_start", start).drop("_holds", "_slice", "_misses", "_local", "_open")


def minutes(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 60e6


def threshold_alarms(readings: DataFrame, rules: DataFrame, warning_delay_min: float) -> DataFrame:
    """A critical reading alarms at once, a warning after its sensor has been in violation long enough."""
    runs = run_start(judged(readings, rules), ["sensor"], F.col("severity").isNotNull())
    late = minutes(F.col("ts"), F.col("run_start"))
    due = F.when(F.col("severity") == "CRITICAL", late >= 0).otherwise(late >= warning_delay_min)
    return runs.where(F.col("severity").isNotNull() & due).select("sensor", "ts", "value", "severity", F.lit("threshold").alias("detector"), "rule_id")


def stuck_alarms(readings: DataFrame, params: DataFrame) -> DataFrame:
    """The last n values within a tolerance, once there are n (E2). ``params``: sensor, rule_id, n, severity."""
    sizes = [r["n"] for r in params.select("n").distinct().orderBy("n").collect()]
    order = Window.partitionBy("sensor").orderBy("ts")
    flat = F.lit(False)
    for n in sizes:
        w = order.rowsBetween(-(n - 1), 0)
        readings = readings.withColumn(f"_flat{n}", (F.count("*").over(w) == n) & (F.max("value").over(w) - F.min("value").over(w) < STUCK_TOLERANCE))
        flat = F.when(F.col("n") == n, F.col(f"_flat{n}")).otherwise(flat)
    out = readings.join(small(params), "sensor")
    return out.where(flat).select("sensor", "ts", "value", "severity", F.lit("stuck").alias("detector"), "rule_id")


def drift_alarms(readings: DataFrame, params: DataFrame, ratio: float, cadence_s: float = CADENCE_S, least_reference: int = 10, span: str = "dur_min") -> DataFrame:
    """Mean of the recent window against the median of what left it.

    ``params``: sensor, rule_id, delta, dur_min, severity; a sensor's window is its longest
    duration.  The reference is the last R readings older than the window, R from the window's
    length.  ``span`` names the column with the minutes that the recent readings must reach.

    One pass: readings lie in slices of time longer than the window, and a slice goes on to the
    later ones that may need it, the next one and those with fewer than R readings in between.  So
    a slice meets all it needs, and a sensor of any share spreads over its slices.
    """
    width = params.groupBy("sensor").agg(F.max("dur_min").cast("double").alias("_w"))
    width = width.withColumn("_r", F.greatest(F.round(F.col("_w") * ratio * 60 / cadence_s).cast("long"), F.lit(1).cast("long")))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = readings.join(small(width), "sensor").withColumn("_slice", F.floor(at / (F.col("_w") * (1 + ratio) * 60e6)).cast("long"))
    order = Window.partitionBy("sensor").orderBy("_slice")
    # rows so far in millionths of R; the frame begins a little late, which only adds rows that aren't looked at
    slices = own.groupBy("sensor", "_slice", "_r").agg(F.count("*").alias("_n"))
    slices = slices.withColumn("_k", F.row_number().over(order)).withColumn("_c", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) * 1_000_000 / F.col("_r"))
    slices = slices.withColumn("_c", F.floor("_c").cast("long"))
    beyond = Window.partitionBy("sensor").orderBy("_c").rangeBetween(1_000_001, Window.unboundedFollowing)
    every = F.max("_k").over(Window.partitionBy("sensor"))
    slices = slices.withColumn("_last", F.least(F.greatest(F.coalesce(F.min("_k").over(beyond), every), F.col("_k")) + 1, every))
    placed = own.join(slices.select("sensor", "_slice", "_k", "_last"), ["sensor", "_slice"]).withColumn("_at", F.explode(F.sequence("_k", "_last")))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ts", kind="stable")
        ts, v = f["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), f["value"].to_numpy(float)
        low = np.searchsorted(ts, ts - int(f["_w"].iloc[0] * 60e6))
        size, mean, base = int(f["_r"].iloc[0]), np.full(len(v), np.nan), np.full(len(v), np.nan)
        for k in np.flatnonzero((f["_k"] == f["_at"]).to_numpy()):
            first = max(0, low[k] - size)
            if low[k] - first >= least_reference and k > low[k]:
                mean[k], base[k] = v[low[k] : k + 1].mean(), np.median(v[first : low[k]])
        out = f[["sensor", "ts", "value"]].assign(_delta=np.abs(mean - base), _span=(ts - ts[low]) / 60e6)
        return out[~np.isnan(mean)]

    kind = ", ".join(f"{c} {readings.schema[c].dataType.simpleString()}" for c in ("sensor", "ts", "value"))
    placed = placed.select("sensor", "ts", F.col("value").cast("double").alias("value"), "_w", "_r", "_k", "_at")
    got = placed.groupBy("sensor", "_at").applyInPandas(run, f"{kind}, _delta double, _span double")
    hit = got.join(small(params), "sensor").where((F.col("_delta") >= F.col("delta")) & (F.col("_span") >= F.col(span)))
    return hit.select("sensor", "ts", "value", "severity", F.lit("drift").alias("detector"), "rule_id")


def sustained_alarms(readings: DataFrame, params: DataFrame) -> DataFrame:
    """Beyond a threshold without a break for long enough, per rule (E4). ``params``: sensor, rule_id, upper, threshold, dur_min, severity."""
    each = readings.join(small(params), "sensor")
    holds = F.when(F.col("upper"), F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    runs = run_start(each, ["sensor", "rule_id"], holds)
    return runs.where(minutes(F.col("ts"), F.col("run_start")) >= F.col("dur_min")).select("sensor", "ts", "value", "severity", F.lit("sustained").alias("detector"), "rule_id")


# The three forms in which a maintenance condition is written.
STUCK = r"(?i)stuck\s*[>≥]\s*(\d+)\s*samples"
DRIFT = r"(?i)drift\s*[>≥]\s*([\d.]+)\s*\S*\s*(?:over|for)\s*[>≥]?\s*(\d+)\+?\s*(min|h)"
SUSTAINED = r"(?i)([><%≥≤]+)\s*([\d.]+)\s*\S*\s+for\s+[>≥]?\s*(\d+)\s*(min|h)"


def maintenance(rules: DataFrame) -> DataFrame:
    """Parameters read from a condition's text; the first form that fits wins (E5)."""
    c = F.col("condition")
    got = lambda pattern, k: F.regexp_extract(c, pattern, k)
    unit = lambda pattern, k: F.when(F.lower(got(pattern, k)) == "h", 60).otherwise(1)
    stuck, drift, sustained = (c.rlike(p) for p in (STUCK, DRIFT, SUSTAINED))
    kind = F.when(stuck, "stuck").when(drift, "drift").when(sustained, "sustained")
    number = lambda s: F.when(s.rlike(r"^\d+\.?\d*$|^\.\d+$"), s.cast("double"))
    return rules.select(
        "rule_id", "sensor", "severity", kind.alias("kind"),
        F.when(kind == "stuck", got(STUCK, 1).try_cast("int") + 1).alias("n"),
        F.when(kind == "drift", number(got(DRIFT, 1))).alias("delta"),
        F.when(kind == "sustained", got(SUSTAINED, 1).rlike("[>≥]")).alias("upper"),
        F.when(kind == "sustained", number(got(SUSTAINED, 2))).alias("threshold"),
        F.when(kind == "drift", got(DRIFT, 2).try_cast("int") * unit(DRIFT, 3)).when(kind == "sustained", got(SUSTAINED, 3).try_cast("int") * unit(SUSTAINED, 4)).alias("dur_min"),
    ).where("kind is not null")


def violation_rates(readings: DataFrame, rules: DataFrame, first_hours: float | None = None) -> DataFrame:
    """Share of a rule's readings that violate it; optionally only the first hours of the file."""
    if first_hours is not None:
        origin = readings.agg(F.min("ts").alias("origin"))
        readings = readings.join(F.broadcast(origin)).where(minutes(F.col("ts"), F.col("origin")) <= first_hours * 60).drop("origin")
    each = readings.join(small(rules), "sensor")
    bad = severity(F.col("value"), F.col("crit_hi"), F.col("crit_lo"), F.col("warn_hi"), F.col("warn_lo")).isNotNull()
    return each.groupBy("rule_id").agg(F.avg(bad.cast("double")).alias("rate"), F.count("*").alias("n"))


def accepted(readings: DataFrame, rules: DataFrame, most: float = 0.5) -> DataFrame:
    """The rules without those that more than a share of their readings violate (D3, quarantine)."""
    out = violation_rates(readings, rules).where(F.col("rate") > most).select("rule_id")
    return rules.join(out, "rule_id", "left_anti")


def all_alarms(readings: DataFrame, rules: DataFrame, stuck: DataFrame, drift: DataFrame, sustained: DataFrame, warning_delay_min: float, ratio: float, cadence_s: float = CADENCE_S) -> DataFrame:
    """Every detector over the same readings: thresholds of the accepted rules, and the maintenance parameters by kind."""
    found = threshold_alarms(readings, accepted(readings, rules), warning_delay_min)
    more = [stuck_alarms(readings, stuck), drift_alarms(readings, drift, ratio, cadence_s, span="span"), sustained_alarms(readings, sustained)]
    for m in more:
        found = found.unionByName(m)
    return found


def robust_z(df: DataFrame, key: str) -> DataFrame:
    """(value - median) / (1.4826 MAD) over a key's whole series; else by the deviation, else by one."""
    mid = df.groupBy(key).agg(F.median("value").alias("_mid"), F.stddev_pop("value").alias("_sd"))
    spread = df.join(mid, key).groupBy(key).agg(F.median(F.abs(F.col("value") - F.col("_mid"))).alias("_mad"))
    scale = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    return df.join(mid.join(spread, key), key).withColumn("z", (F.col("value") - F.col("_mid")) / scale).drop("_mid", "_sd", "_mad")


def blocks(df: DataFrame, keys: list[str], gap_s: float) -> DataFrame:
    """Runs of rows no more than ``gap_s`` apart, as (keys, start, end, n)."""
    w = Window.partitionBy(*keys).orderBy("ts")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) > gap_s * 1e6
    marked = df.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int"))
    marked = marked.withColumn("_block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_block").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("_block")


def correlated(readings: DataFrame, source: str, target: str, above: float, z_below: float, lag_min: float, gap_s: float, least_min: float) -> DataFrame:
    """After a block of high source readings, the first long enough run of low target readings."""
    sources = blocks(readings.where((F.col("sensor") == source) & (F.col("value") > above)), ["sensor"], gap_s).select(F.col("start").alias("b0"), F.col("end").alias("b1"))
    low = robust_z(readings.where(F.col("sensor") == target), "sensor").where(F.col("z") < z_below)
    near = low.join(small(sources), (F.col("ts") >= F.col("b0")) & (F.timestamp_diff("MICROSECOND", F.col("b1"), F.col("ts")) <= lag_min * 60e6))
    runs = blocks(near, ["sensor", "b0"], gap_s).where(minutes(F.col("end"), F.col("start")) >= least_min)
    first = runs.withColumn("_k", F.row_number().over(Window.partitionBy("sensor", "b0").orderBy("start"))).where("_k = 1")
    return first.select("sensor", F.lit(source).alias("source"), "b0", "start", "end")
