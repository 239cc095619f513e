"""Detection over ``events``: a sensor is an event type, a reading its value."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.operators import detect, intervals
from sluice.sources.tables import table, values, values_sql

RULE_COLUMNS = "ord, rule_id, cls, sensor, warn_hi, crit_hi, warn_lo, crit_lo"
RULES = [
    (1, "R-VIEW", "ThresholdRule", "view", 100.0, 200.0, 1.0, 0.2), (2, "R-CLICK", "ThresholdRule", "click", 110.0, 220.0, None, None), (3, "R-BUY", "OperationalRule", "purchase", 90.0, None, 2.0, None),
    (4, "R-SIGN", "ThresholdRule", "signup", 120.0, 120.0, None, 0.3), (5, "R-ERR", "ThresholdRule", "error", 80.0, 160.0, 1.5, None), (6, "R-ERR2", "ThresholdRule", "error", 70.0, None, None, 0.5),
    (7, "R-NONE", "ThresholdRule", "absent", 1.0, 2.0, None, None), (8, "R-BAD", "ThresholdRule", "view", 10.0, None, None, None),
]
GOOD = RULES[:7]
TEXTS = [
    ("M-1", "click", "Stuck > 3 samples", "WARNING"), ("M-2", "view", "drift > 8.5 units over 240 min", "WARNING"), ("M-3", "purchase", "> 40 units for 30 min", "WARNING"), ("M-4", "error", "Drift ≥ 6 K for 5+ h", "CRITICAL"),
    ("M-5", "signup", "≤ 60 bar for > 1 h", "CRITICAL"), ("M-6", "view", "inspect weekly", "INFO"), ("M-7", "error", ">= 30 for 45 min", "WARNING"),
]


def _t(day: int, hour: int, minute: int = 0) -> str:
    return str(dt.datetime(2024, 1, day, hour, minute))


WINDOWS = [
    ("G01", "view", "OUT_OF_RANGE", _t(1, 2), _t(1, 9)), ("G02", "view", "DRIFT", _t(2, 0), _t(2, 12)), ("G03", "click", "STUCK", _t(1, 0), _t(1, 1)), ("G04", "click", "SPIKE", _t(3, 6), _t(3, 7)),
    ("G05", "purchase", "OUT_OF_RANGE", _t(1, 5), _t(2, 5)), ("G06", "purchase", "DRIFT", _t(4, 0), _t(4, 0)), ("G07", "signup", "SPIKE", _t(2, 3), _t(2, 4)), ("G08", "signup", "DRIFT", _t(5, 0), _t(6, 0)),
    ("G09", "error", "OUT_OF_RANGE", _t(1, 0), _t(1, 12)), ("G10", "error", "DRIFT", _t(6, 0), _t(7, 0)), ("G11", "error", "SPIKE", _t(7, 1), _t(7, 1, 30)), ("G12", "absent", "STUCK", _t(1, 0), _t(2, 0)),
    ("G13", "view", "CORRELATED", _t(8, 0), _t(8, 6)), ("G14", "click", "DRIFT", _t(9, 0), _t(9, 18)),
]
DELAY, GAP = 5.0, 15

RULES_SQL = values_sql("all_rules", RULE_COLUMNS, RULES)
GOOD_SQL = values_sql("rules", RULE_COLUMNS, GOOD)
WINDOWS_SQL = values_sql("raw_windows", "gt_id, sensor, atype, s, e", WINDOWS) + ", windows AS (SELECT gt_id, sensor, atype, CAST(s AS TIMESTAMP) AS gt_start, CAST(e AS TIMESTAMP) AS gt_end FROM raw_windows)"
TEXTS_SQL = values_sql("texts", "rule_id, sensor, condition, severity", TEXTS)
SEVERITY_SQL = "CASE WHEN value > crit_hi OR value < crit_lo THEN 'CRITICAL' WHEN value > warn_hi OR value < warn_lo THEN 'WARNING' END"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return detect.telemetry(e.select(F.col("event_type").alias("sensor"), "ts", "value"))


def rules(spark: SparkSession, rows=GOOD) -> DataFrame:
    return values(spark, "ord int, rule_id string, cls string, sensor string, warn_hi double, crit_hi double, warn_lo double, crit_lo double", rows)


def windows(spark: SparkSession) -> DataFrame:
    w = values(spark, "gt_id string, sensor string, atype string, s string, e string", WINDOWS)
    return w.select("gt_id", "sensor", "atype", F.col("s").cast("timestamp_ntz").alias("gt_start"), F.col("e").cast("timestamp_ntz").alias("gt_end"))


def params(spark: SparkSession, kind: str) -> DataFrame:
    texts = values(spark, "rule_id string, sensor string, condition string, severity string", TEXTS)
    return detect.maintenance(texts).where(F.col("kind") == kind)


def threshold_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.threshold_alarms(readings(spark, sf_dir), rules(spark), DELAY)


def plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of the whole chain; clicks come from a sensor that resolves steps of 40."""
    return readings(spark, sf_dir).withColumn("value", F.when(F.col("sensor") == "click", F.floor(F.col("value") / 40) * 40.0).otherwise(F.col("value")))


def alarms(spark: SparkSession, sf_dir: str, delay: float = DELAY) -> DataFrame:
    """All detectors over one plant, without the rules that most readings violate."""
    drift = params(spark, "drift").withColumn("span", F.col("dur_min") * 0.9)
    return detect.all_alarms(plant(spark, sf_dir), rules(spark, RULES), params(spark, "stuck"), drift, params(spark, "sustained"), delay, RATIO, CADENCE)


def events(spark: SparkSession, sf_dir: str, delay: float = DELAY) -> DataFrame:
    return intervals.merge_alarms(alarms(spark, sf_dir, delay), GAP)


def alarm_sql(delay: float = DELAY, suffix: str = "", source: str = "(SELECT event_type AS sensor, ts, value FROM events)", name: str = "alarms") -> str:
    """Threshold alarms of a source (sensor, ts, value)."""
    return f"""
each{suffix} AS (SELECT e.sensor, ts, value, {SEVERITY_SQL} AS sev, ord, rule_id FROM {source} e LEFT JOIN rules r ON e.sensor = r.sensor WHERE value IS NOT NULL AND NOT isnan(value)),
worst{suffix} AS (SELECT sensor, ts, value, min(sev) AS severity, arg_min(rule_id, (CASE sev WHEN 'CRITICAL' THEN 0 ELSE 1000 END) + ord) FILTER (WHERE sev IS NOT NULL) AS rule_id FROM each{suffix} GROUP BY sensor, ts, value),
isl{suffix} AS (SELECT *, sum(CASE WHEN severity IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY sensor ORDER BY ts) AS k FROM worst{suffix}),
run{suffix} AS (SELECT *, min(CASE WHEN severity IS NOT NULL THEN ts END) OVER (PARTITION BY sensor, k) AS run_start FROM isl{suffix}),
{name}{suffix} AS (SELECT sensor, ts, value, severity, 'threshold' AS detector, rule_id FROM run{suffix} WHERE severity IS NOT NULL AND date_diff('microsecond', run_start, ts) / 60e6 >= CASE severity WHEN 'CRITICAL' THEN 0 ELSE {delay} END)"""


def event_sql(suffix: str = "") -> str:
    return f"""
gap{suffix} AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY sensor ORDER BY ts) <= INTERVAL {GAP} MINUTE THEN 0 ELSE 1 END AS fresh FROM alarms{suffix}),
grp{suffix} AS (SELECT *, sum(fresh) OVER (PARTITION BY sensor ORDER BY ts) AS g FROM gap{suffix}),
evs{suffix} AS (SELECT sensor, min(ts) AS start, max(ts) AS "end", min(severity) AS severity, list_sort(list(DISTINCT detector)) AS detectors, list_sort(list(DISTINCT rule_id)) AS rule_ids, count(*) AS n_alarms FROM grp{suffix} GROUP BY sensor, g)"""


def coverage_sql(suffix: str = "") -> str:
    return f"""
hit{suffix} AS (SELECT w.*, e.start, e."end" AS fin, e.detectors, e.rule_ids FROM windows w JOIN evs{suffix} e ON e.sensor = w.sensor AND e.start <= gt_end AND e."end" >= gt_start),
clip{suffix} AS (SELECT gt_id, greatest(start, gt_start) AS a, least(fin, gt_end) AS b FROM hit{suffix}),
prev{suffix} AS (SELECT *, max(b) OVER (PARTITION BY gt_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM clip{suffix}),
cov{suffix} AS (SELECT gt_id, sum(greatest(0, date_diff('microsecond', CASE WHEN pb > a THEN pb ELSE a END, b))) / 60e6 AS covered FROM prev{suffix} GROUP BY gt_id),
span{suffix} AS (SELECT gt_id, min(start) AS det_start, max(fin) AS det_end, list_sort(list_distinct(flatten(list(detectors)))) AS detectors, list_sort(list_distinct(flatten(list(rule_ids)))) AS rules FROM hit{suffix} GROUP BY gt_id),
coverage{suffix} AS (
  SELECT w.gt_id, w.sensor, w.atype, CASE WHEN det_start IS NULL THEN 'MISSED' ELSE 'DETECTED' END AS status, det_start, det_end, detectors, rules,
    CASE WHEN det_start IS NOT NULL THEN greatest(date_diff('microsecond', gt_start, det_start) / 60e6, 0) END AS latency_min,
    CASE WHEN det_start IS NULL THEN 0.0 WHEN gt_end <= gt_start THEN 100.0 ELSE 100.0 * covered / (date_diff('microsecond', gt_start, gt_end) / 60e6) END AS coverage_pct,
    date_diff('microsecond', gt_start, gt_end) / 60e6 AS length_min
  FROM windows w LEFT JOIN span{suffix} USING (gt_id) LEFT JOIN cov{suffix} USING (gt_id))"""


RATIO, CADENCE = 2.0, 900
BASE = f"WITH {GOOD_SQL}, {alarm_sql()}"


def _stuck_sql(source: str, rule: str = "M-1", sensor: str = "click") -> str:
    return f"""SELECT sensor, ts, value, 'WARNING' AS severity, 'stuck' AS detector, '{rule}' AS rule_id FROM (
    SELECT *, count(*) OVER w AS c, max(value) OVER w - min(value) OVER w AS s FROM {source} WHERE sensor = '{sensor}' WINDOW w AS (PARTITION BY sensor ORDER BY ts ROWS 3 PRECEDING)) WHERE c = 4 AND s < 1e-6"""


def _drift_sql(rule: str, sensor: str, severity: str, delta: float, width: int) -> str:
    r = max(1, round(width * RATIO * 60 / CADENCE))
    return f"""SELECT b.sensor, b.ts, b.value, '{severity}' AS severity, 'drift' AS detector, '{rule}' AS rule_id FROM (
      SELECT *, count(*) OVER w AS c, avg(value) OVER w AS m, min(ts) OVER w AS f FROM t WHERE sensor = '{sensor}' WINDOW w AS (PARTITION BY sensor ORDER BY ts RANGE BETWEEN INTERVAL {width} MINUTE PRECEDING AND CURRENT ROW)) b,
      LATERAL (SELECT count(*) AS n, median(x.value) AS base FROM t x WHERE x.sensor = '{sensor}' AND x.rn BETWEEN b.rn - b.c - {r} + 1 AND b.rn - b.c) q
      WHERE n >= 10 AND c >= 2 AND abs(m - base) >= {delta} AND date_diff('microsecond', f, b.ts) / 60e6 >= {width} * 0.9"""


def _sustained_sql(rule: str, sensor: str, severity: str, test: str, minutes: int) -> str:
    return f"""SELECT sensor, ts, value, '{severity}' AS severity, 'sustained' AS detector, '{rule}' AS rule_id FROM (
      SELECT *, min(ts) OVER (PARTITION BY k) AS s FROM (SELECT event_type AS sensor, ts, value, value {test} AS v, sum(CASE WHEN value {test} THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS k FROM events WHERE event_type = '{sensor}') WHERE v)
      WHERE date_diff('microsecond', s, ts) / 60e6 >= {minutes}"""


DRIFTS = [("M-2", "view", "WARNING", 8.5, 240), ("M-4", "error", "CRITICAL", 6, 300)]
SUSTAINS = [("M-3", "purchase", "WARNING", "> 40", 30), ("M-5", "signup", "CRITICAL", "< 60", 60)]
#: Readings, the rules that stay, and the maintenance alarms, which know no delay.
PLANT = f"""WITH {RULES_SQL}, plant AS (SELECT event_type AS sensor, ts, CASE WHEN event_type = 'click' THEN floor(value / 40) * 40.0 ELSE value END AS value FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
rules AS (SELECT * FROM all_rules WHERE rule_id NOT IN (SELECT rule_id FROM (SELECT rule_id, {SEVERITY_SQL} AS sev FROM plant JOIN all_rules r USING (sensor)) GROUP BY 1 HAVING avg((sev IS NOT NULL)::INT) > 0.5)),
t AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY ts) AS rn FROM plant),
maintained AS ({_stuck_sql("plant")} UNION ALL {" UNION ALL ".join(_drift_sql(*x) for x in DRIFTS)} UNION ALL {" UNION ALL ".join(_sustained_sql(*x) for x in SUSTAINS)})"""


def chain_sql(delay: float = DELAY, suffix: str = "") -> str:
    """All alarms, as ``alarms``."""
    return f"{alarm_sql(delay, suffix, 'plant', 'limits')}, alarms{suffix} AS (SELECT * FROM limits{suffix} UNION ALL SELECT * FROM maintained)"


CHAIN = f"{PLANT}, {chain_sql()}"
FULL = f"{CHAIN}, {WINDOWS_SQL}, {event_sql()}, {coverage_sql()}"


@query("b5_severity", f"WITH {RULES_SQL} SELECT event_id, rule_id, {SEVERITY_SQL} AS severity FROM events e JOIN all_rules r ON e.event_type = r.sensor")
def b5(spark, d):
    r = rules(spark, RULES)
    e = table(spark, d, "events").withColumnRenamed("event_type", "sensor").join(F.broadcast(r), "sensor")
    return e.select("event_id", "rule_id", detect.severity(F.col("value"), F.col("crit_hi"), F.col("crit_lo"), F.col("warn_hi"), F.col("warn_lo")).alias("severity"))


@query("c1_rules_by_sensor", f"WITH {RULES_SQL} SELECT r.rule_id, count(*) AS n FROM events e JOIN all_rules r ON e.event_type = r.sensor GROUP BY r.rule_id")
def c1(spark, d):
    return readings(spark, d).join(F.broadcast(rules(spark, RULES)), "sensor").groupBy("rule_id").agg(F.count("*").alias("n"))


RATE = f"SELECT rule_id, avg(CASE WHEN {SEVERITY_SQL} IS NULL THEN 0.0 ELSE 1.0 END) AS rate, count(*) AS n FROM events e JOIN all_rules r ON e.event_type = r.sensor"


@query("d1_violation_rates", f"WITH {RULES_SQL} {RATE} GROUP BY rule_id")
def d1(spark, d):
    return detect.violation_rates(readings(spark, d), rules(spark, RULES))


@query("d2_calibration_rates", f"WITH {RULES_SQL} {RATE} WHERE date_diff('microsecond', (SELECT min(ts) FROM events), ts) / 60e6 <= 24 * 60 GROUP BY rule_id")
def d2(spark, d):
    return detect.violation_rates(readings(spark, d), rules(spark, RULES), 24)


@query("d3_quarantine", f"WITH {RULES_SQL} SELECT rule_id, rate FROM ({RATE} GROUP BY rule_id) WHERE rate > 0.5")
def d3(spark, d):
    return detect.violation_rates(readings(spark, d), rules(spark, RULES)).where("rate > 0.5").select("rule_id", "rate")


@query("e1_threshold_alarms", f"{BASE} SELECT * FROM alarms")
def e1(spark, d):
    return threshold_alarms(spark, d)


STUCK_N = 4


@query(
    "e2_stuck_alarms",
    """SELECT * FROM (SELECT event_type AS sensor, ts, value, 'WARNING' AS severity, 'stuck' AS detector, 'M-1' AS rule_id FROM (
    SELECT *, count(*) OVER w AS c, max(value) OVER w - min(value) OVER w AS s FROM (SELECT event_type, ts, floor(value / 40) AS value FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS 3 PRECEDING))
    WHERE c = 4 AND s < 1e-6 AND event_type = 'click')""",
)
def e2(spark, d):
    coarse = readings(spark, d).withColumn("value", F.floor(F.col("value") / 40).cast("double"))
    return detect.stuck_alarms(coarse, params(spark, "stuck"))


@query(
    "e3_drift_alarms",
    "WITH t AS (SELECT event_type AS sensor, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events) " + " UNION ALL ".join(_drift_sql(*x) for x in DRIFTS),
)
def e3(spark, d):
    # readings are irregular, so a full window is rare: the span asked for is nine tenths of it
    p = params(spark, "drift")
    own = p.withColumn("span", F.col("dur_min") * 0.9)
    return detect.drift_alarms(readings(spark, d), own, RATIO, CADENCE, span="span")


@query("e4_sustained_alarms", " UNION ALL ".join(_sustained_sql(*x) for x in SUSTAINS))
def e4(spark, d):
    return detect.sustained_alarms(readings(spark, d), params(spark, "sustained"))


_P = {"stuck": r"(?i)stuck\s*[>≥]\s*(\d+)\s*samples", "drift": r"(?i)drift\s*[>≥]\s*([\d.]+)\s*\S*\s*(?:over|for)\s*[>≥]?\s*(\d+)\+?\s*(min|h)", "sustained": r"(?i)([><%≥≤]+)\s*([\d.]+)\s*\S*\s+for\s+[>≥]?\s*(\d+)\s*(min|h)"}


@query(
    "e5_maintenance_text",
    f"""WITH {TEXTS_SQL}, k AS (SELECT *, CASE WHEN regexp_matches(condition, '{_P['stuck']}') THEN 'stuck' WHEN regexp_matches(condition, '{_P['drift']}') THEN 'drift' WHEN regexp_matches(condition, '{_P['sustained']}') THEN 'sustained' END AS kind FROM texts)
    SELECT rule_id, sensor, severity, kind, CASE kind WHEN 'stuck' THEN CAST(regexp_extract(condition, '{_P['stuck']}', 1) AS INT) + 1 END AS n,
      CASE kind WHEN 'drift' THEN CAST(regexp_extract(condition, '{_P['drift']}', 1) AS DOUBLE) END AS delta,
      CASE kind WHEN 'sustained' THEN regexp_matches(regexp_extract(condition, '{_P['sustained']}', 1), '[>≥]') END AS upper,
      CASE kind WHEN 'sustained' THEN CAST(regexp_extract(condition, '{_P['sustained']}', 2) AS DOUBLE) END AS threshold,
      CASE kind WHEN 'drift' THEN CAST(regexp_extract(condition, '{_P['drift']}', 2) AS INT) * CASE lower(regexp_extract(condition, '{_P['drift']}', 3)) WHEN 'h' THEN 60 ELSE 1 END
        WHEN 'sustained' THEN CAST(regexp_extract(condition, '{_P['sustained']}', 3) AS INT) * CASE lower(regexp_extract(condition, '{_P['sustained']}', 4)) WHEN 'h' THEN 60 ELSE 1 END END AS dur_min
    FROM k WHERE kind IS NOT NULL""",
)
def e5(spark, d):
    return detect.maintenance(values(spark, "rule_id string, sensor string, condition string, severity string", TEXTS))


@query("e6_alarm_events", f'{CHAIN}, {event_sql()} SELECT sensor, start, "end", severity, detectors, rule_ids, n_alarms FROM evs')
def e6(spark, d):
    return events(spark, d)


@query("e7_window_coverage", f"{FULL} SELECT * FROM coverage")
def e7(spark, d):
    return intervals.coverage(events(spark, d), windows(spark))


@query("c2_event_window_overlap", f'{FULL} SELECT gt_id, start, fin AS "end" FROM hit')
def c2(spark, d):
    e, w = events(spark, d), windows(spark)
    return e.join(F.broadcast(w), intervals.overlaps(e, w)).select("gt_id", "start", "end")


@query("c3_false_positive_events", f'{FULL} SELECT sensor, start, "end" FROM evs e WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.sensor = e.sensor AND e.start <= gt_end AND e."end" >= gt_start)')
def c3(spark, d):
    return intervals.unmatched(events(spark, d), windows(spark)).select("sensor", "start", "end")


METRIC = """SELECT {lead}tp, fn, fp, tp / (tp + fn)::DOUBLE AS recall, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
  CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM (
  SELECT (SELECT count(*) FROM coverage{s} WHERE status = 'DETECTED') AS tp, (SELECT count(*) FROM coverage{s} WHERE status = 'MISSED') AS fn,
  (SELECT count(*) FROM evs{s} e WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.sensor = e.sensor AND e.start <= gt_end AND e."end" >= gt_start)) AS fp)"""


def metrics(spark, d, delay: float = DELAY) -> DataFrame:
    e, w = events(spark, d, delay), windows(spark)
    got = intervals.coverage(e, w).agg(F.count_if(F.col("status") == "DETECTED").alias("tp"), F.count_if(F.col("status") == "MISSED").alias("fn"))
    both = got.crossJoin(intervals.unmatched(e, w).agg(F.count("*").alias("fp")))
    return both.select(
        "tp", "fn", "fp", (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"), F.when(F.col("tp") + F.col("fp") == 0, 0.0).otherwise(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"),
        F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
    )


@query("d5_event_metrics", f"{FULL} {METRIC.format(s='', lead='')}")
def d5(spark, d):
    return metrics(spark, d)


STRICT = "count(*) FILTER (WHERE status = 'DETECTED') / count(*)::DOUBLE AS recall, count(*) FILTER (WHERE coverage_pct >= 25) / count(*)::DOUBLE AS recall_25, count(*) FILTER (WHERE coverage_pct >= 50) / count(*)::DOUBLE AS recall_50, count(*) FILTER (WHERE latency_min <= 30) / count(*)::DOUBLE AS recall_30min, count(*) FILTER (WHERE latency_min <= 0.25 * length_min) / count(*)::DOUBLE AS recall_quarter"


@query("d36_strictness", f"{PLANT}, {WINDOWS_SQL}, {chain_sql(5.0, '5')}, {event_sql('5')}, {coverage_sql('5')}, {chain_sql(0.0, '0')}, {event_sql('0')}, {coverage_sql('0')} SELECT 5.0::DOUBLE AS delay_min, {STRICT} FROM coverage5 UNION ALL SELECT 0.0::DOUBLE AS delay_min, {STRICT} FROM coverage0")
def d36(spark, d):
    share = lambda c: F.count_if(c) / F.count("*")
    out = None
    for delay in (5.0, 0.0):
        c = intervals.coverage(events(spark, d, delay), windows(spark))
        row = c.agg(
            share(F.col("status") == "DETECTED").alias("recall"), share(F.col("coverage_pct") >= 25).alias("recall_25"), share(F.col("coverage_pct") >= 50).alias("recall_50"),
            share(F.col("latency_min") <= 30).alias("recall_30min"), share(F.col("latency_min") <= 0.25 * F.col("length_min")).alias("recall_quarter"),
        ).select(F.lit(delay).alias("delay_min"), "*")
        out = row if out is None else out.union(row)
    return out


@query("e8_breach_episodes", "SELECT sensor, sum(CASE WHEN v AND NOT coalesce(p, false) THEN 1 ELSE 0 END) AS episodes FROM (SELECT *, lag(v) OVER (PARTITION BY sensor ORDER BY ts) AS p FROM (SELECT event_type AS sensor, ts, value > 60 AS v FROM events)) GROUP BY sensor")
def e8(spark, d):
    return intervals.episodes(readings(spark, d), ["sensor"], F.col("value") > 60)


Z = "z AS (SELECT event_type AS sensor, ts, value, (value - m) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1.0 END AS z FROM events JOIN (SELECT event_type, m, sd, mad FROM (SELECT event_type, median(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1) JOIN (SELECT event_type, median(abs(value - m)) AS mad FROM events JOIN (SELECT event_type, median(value) AS m FROM events GROUP BY 1) USING (event_type) GROUP BY 1) USING (event_type)) USING (event_type))"


@query("e9_robust_z", f"WITH {Z} SELECT sensor, ts, round(z, 9) AS z FROM z")
def e9(spark, d):
    return detect.robust_z(readings(spark, d), "sensor").select("sensor", "ts", F.round("z", 9).alias("z"))


def _blocks_sql(name: str, source: str, keys: str, gap: int) -> str:
    return f"{name} AS (SELECT {keys}, min(ts) AS s, max(ts) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY {keys} ORDER BY ts), ts) <= {gap}e6 THEN 0 ELSE 1 END AS f FROM {source})) GROUP BY {keys}, k)"


@query(
    "e10_correlated",
    f"""WITH {Z}, src AS (SELECT sensor, ts FROM z WHERE sensor = 'view' AND value > 100), {_blocks_sql('b', 'src', 'sensor', 3600)},
    near AS (SELECT z.sensor, z.ts, b.s AS b0 FROM z JOIN b ON z.ts >= b.s AND date_diff('microsecond', b.e, z.ts) <= 600 * 60e6 WHERE z.sensor = 'error' AND z < -0.6),
    {_blocks_sql('r', 'near', 'sensor, b0', 3600)}
    SELECT sensor, 'view' AS source, b0, s AS start, e AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY sensor, b0 ORDER BY s) AS k FROM r WHERE date_diff('microsecond', s, e) / 60e6 >= 10) WHERE k = 1""",
)
def e10(spark, d):
    return detect.correlated(readings(spark, d), "view", "error", 100.0, -0.6, 600, 3600, 10)


@query(
    "e11_interval_merge",
    """WITH i AS (SELECT event_type AS sensor, ts AS s, ts + INTERVAL 20 MINUTE AS e FROM events), p AS (SELECT *, max(e) OVER (PARTITION BY sensor ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM i),
    g AS (SELECT *, sum(CASE WHEN q IS NULL OR s > q THEN 1 ELSE 0 END) OVER (PARTITION BY sensor ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM p) SELECT sensor, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY sensor, k""",
)
def e11(spark, d):
    i = readings(spark, d).select("sensor", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("end"))
    return intervals.merged(i, ["sensor"])


@query("b6_rule_class", f"WITH {RULES_SQL} SELECT rule_id, CASE WHEN coalesce(warn_hi, crit_hi, warn_lo, crit_lo) IS NOT NULL THEN 'ThresholdRule' WHEN cls IS NULL OR cls IN ('ThresholdRule', 'OperationalRule') THEN 'MaintenanceRule' ELSE cls END AS cls FROM all_rules UNION ALL SELECT rule_id, 'MaintenanceRule' FROM (VALUES ('M-1'), ('M-2'), ('M-3'), ('M-4'), ('M-5'), ('M-6'), ('M-7')) v(rule_id)")
def b6(spark, d):
    texts = values(spark, "rule_id string, sensor string, condition string, severity string", TEXTS).select("rule_id", F.lit(None).cast("string").alias("cls"))
    all_ = rules(spark, RULES).unionByName(texts, allowMissingColumns=True)
    return all_.select("rule_id", detect.rule_class(["warn_hi", "crit_hi", "warn_lo", "crit_lo"], F.col("cls")).alias("cls"))


@query("d30_three_sigma", "SELECT event_type AS sensor, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, count(*) FILTER (WHERE abs(value - m) > 3 * s) AS outside FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) USING (event_type) GROUP BY event_type")
def d30(spark, d):
    r = readings(spark, d)
    s = r.groupBy("sensor").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    out = r.join(F.broadcast(s), "sensor").groupBy("sensor").agg(F.count_if(F.abs(F.col("value") - F.col("mean")) > 3 * F.col("sd")).alias("outside"))
    return s.join(out, "sensor").select("sensor", "n", "lo", "hi", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), "outside")
