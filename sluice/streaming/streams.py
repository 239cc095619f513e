"""The detectors on streams of (sensor, ts, value), event time in ``ts``.

``sessions`` and ``tumbling`` are built in and work on batch and stream alike.  ``on_delay``
keeps, for each sensor, the start of its present run; ``maintenance`` keeps the last readings,
as many as the longest window, its reference and the longest stuck run need, and a run start for
each sustained rule.  Readings of a sensor are taken in order of time: those of a batch are
sorted, and one that isn't later than the last one seen comes too late and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators.detect import CADENCE_S, STUCK_TOLERANCE

ALARM = "sensor string, ts timestamp, value double, severity string, rule_id string"
MAINTAINED = "sensor string, ts timestamp, value double, severity string, detector string, rule_id string"


def tumbling(df: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and peaks per sensor and window; rows later than ``late`` are left out."""
    df = df.withWatermark("ts", late) if late else df
    return df.groupBy("sensor", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("hi")).select("sensor", F.col("w.start").alias("start"), "n", "hi")


def sessions(alarms: DataFrame, gap: str, late: str) -> DataFrame:
    """Alarms to events as they come (I4)."""
    got = alarms.withWatermark("ts", late).groupBy("sensor", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_alarms"))
    return got.drop("w")


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


def _in_order(frames: Iterator[pd.DataFrame], last: int | None) -> tuple[pd.DataFrame, np.ndarray]:
    f = pd.concat(list(frames)).sort_values("ts", kind="stable")
    at = _micros(f["ts"])
    fresh = np.ones(len(at), bool) if last is None else at > last
    return f[fresh], at[fresh]


def _run_starts(holds: np.ndarray, at: np.ndarray, opened: int | None) -> np.ndarray:
    """For each reading the start of the run it stands in; ``opened`` is that of a run from before."""
    miss = np.maximum.accumulate(np.where(holds, -1, np.arange(len(at))))
    start = at[np.minimum(miss + 1, len(at) - 1)]
    return start if opened is None else np.where(miss < 0, opened, start)


def on_delay(judged: DataFrame, warning_delay_min: float) -> DataFrame:
    """Alarms of judged readings (sensor, ts, value, severity, rule_id) after the on-delay."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, last = state.get if state.exists else (None, None)
        f, at = _in_order(frames, last)
        if not len(at):
            return
        holds = f["severity"].notna().to_numpy()
        late = (at - _run_starts(holds, at, opened)) / 60e6
        due = holds & ((f["severity"] == "CRITICAL").to_numpy() | (late >= warning_delay_min))
        state.update((int(_run_starts(holds, at, opened)[-1]) if holds[-1] else None, int(at[-1])))
        yield f.loc[due, ["ts", "value", "severity", "rule_id"]].assign(sensor=key[0])[["sensor", "ts", "value", "severity", "rule_id"]]

    return judged.groupBy("sensor").applyInPandasWithState(step, ALARM, "start long, last long", "append", GroupStateTimeout.NoTimeout)


def maintenance(readings: DataFrame, stuck: DataFrame, drift: DataFrame, sustained: DataFrame, ratio: float, cadence_s: float = CADENCE_S, least_reference: int = 10, span: str = "dur_min") -> DataFrame:
    """Stuck, drift and sustained alarms of a stream, with bounded buffers.

    The three tables of parameters are rules, a row for each, and go to the tasks with the code.
    """
    rules = {k: [r.asDict() for r in t.collect()] for k, t in (("stuck", stuck), ("drift", drift), ("sustained", sustained))}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = {k: sorted((r for r in rows if r["sensor"] == key[0]), key=lambda r: r["rule_id"]) for k, rows in rules.items()}
        kept_at, kept, starts = state.get if state.exists else ([], [], [None] * len(own["sustained"]))
        f, fresh = _in_order(frames, kept_at[-1] if kept_at else None)
        if not len(fresh):
            return
        m, at, v = len(kept_at), np.concatenate([np.array(kept_at, np.int64), fresh]), np.concatenate([np.array(kept, float), f["value"].to_numpy(float)])
        out, need = [], [1]

        def alarm(hit: np.ndarray, r: dict, detector: str) -> None:
            out.append(f[hit[m:]][["ts", "value"]].assign(severity=r["severity"], detector=detector, rule_id=r["rule_id"]))

        for r in own["stuck"]:
            n, hit = r["n"], np.zeros(len(v), bool)
            if len(v) >= n:
                last = np.lib.stride_tricks.sliding_window_view(v, n)
                hit[n - 1 :] = last.max(axis=1) - last.min(axis=1) < STUCK_TOLERANCE
            alarm(hit, r, "stuck")
            need.append(n - 1)
        if own["drift"]:
            width = max(r["dur_min"] for r in own["drift"])
            size = max(1, round(width * ratio * 60 / cadence_s))
            low = np.searchsorted(at, at - int(width * 60e6))
            base, mean = np.full(len(v), np.nan), np.full(len(v), np.nan)
            for k in range(m, len(v)):
                if low[k] - max(0, low[k] - size) >= least_reference and k - low[k] >= 1:
                    base[k], mean[k] = np.median(v[max(0, low[k] - size) : low[k]]), v[low[k] : k + 1].mean()
            for r in own["drift"]:
                alarm((np.abs(mean - base) >= r["delta"]) & ((at - at[low]) / 60e6 >= r[span]), r, "drift")
            need.append(len(v) - int(low[-1]) + size)
        for j, r in enumerate(own["sustained"]):
            holds = v[m:] > r["threshold"] if r["upper"] else v[m:] < r["threshold"]
            start = _run_starts(holds, fresh, starts[j])
            hit = np.zeros(len(v), bool)
            hit[m:] = holds & ((fresh - start) / 60e6 >= r["dur_min"])
            alarm(hit, r, "sustained")
            starts[j] = int(start[-1]) if holds[-1] else None
        keep = min(len(v), max(need))
        state.update((at[len(at) - keep :].tolist(), v[len(v) - keep :].tolist(), list(starts)))
        if out:
            yield pd.concat(out).assign(sensor=key[0])[["sensor", "ts", "value", "severity", "detector", "rule_id"]]

    return readings.groupBy("sensor").applyInPandasWithState(step, MAINTAINED, "at array<long>, kept array<double>, starts array<long>", "append", GroupStateTimeout.NoTimeout)
