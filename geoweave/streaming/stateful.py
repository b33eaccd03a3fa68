"""Per-device state machines over DataFrames: the same kernels in batch and in Structured Streaming.

Batch: one Arrow group a device, rows in order of arrival. Streaming: transformWithStateInPandas, the state as JSON in a ValueState that
the RocksDB store keeps; rows of a micro-batch are sorted by seq. Devices are the unit of parallelism: many devices, short histories.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from . import kernels as K

TRACK_SCHEMA = "seq long, t_ms long, movement string, vote string, confidence double, smoothed_mps double, at_control boolean"
SPEED_SCHEMA = "seq long, t_ms long, state string, smoothed_mps double"
HELD_SCHEMA = "seq long, t_ms long, movement string"
SESSION_SCHEMA = (
    "seq long, t_ms long, movement string, vote string, confidence double, smoothed_mps double, at_control boolean, changed boolean, location_level string, location_ms long, distance_m double, "
    "accel_level string, accel_hz long, window_ms long, burst_ms long, reevaluate_ms long, reason string, generation long, limited boolean"
)


def _clean(x):
    """A pandas cell as a Python value: no NaN for NULL, nested rows as dicts."""
    if x is None or (isinstance(x, float) and x != x) or x is pd.NaT:
        return None
    if hasattr(x, "asDict"):
        return {k: _clean(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {k: _clean(v) for k, v in x.items()}
    return x.item() if hasattr(x, "item") else x


def rows_of(pdf: pd.DataFrame) -> list[dict]:
    names = list(pdf.columns)
    return [{n: _clean(v) for n, v in zip(names, row)} for row in pdf.sort_values("seq").itertuples(index=False, name=None)]


def step_speed(s: dict, r: dict) -> dict:
    state = K.push_speed(s, r["t_ms"], r["lat"], r["lon"], float("inf") if r["accuracy_m"] is None else r["accuracy_m"], r["speed_mps"])
    return {"state": state, "smoothed_mps": K.smoothed(s)}


def step_track(s: dict, r: dict) -> dict:
    return K.track(s, r)


def step_track_responsive(s: dict, r: dict) -> dict:
    return K.track(s, r, hold=K.RESPONSIVE)


def step_hold(s: dict, r: dict) -> dict:
    return {"movement": K.debounce(s, r["vote"], r["t_ms"], r.get("control"))}


def step_session(s: dict, r: dict) -> dict:
    at = {k: r.get(k) for k in ("lat", "lon", "accuracy_m", "speed_mps", "bearing")} if r.get("lat") is not None else None
    return K.observe(s, {"t_ms": r["t_ms"], "location": at, "accel": r.get("accel"), "road": r.get("road"), "control": r.get("control")})


#: name -> (new state, step, output columns)
MACHINES: dict[str, tuple[Callable, Callable, str]] = {
    "speed": (K.new_speed, step_speed, SPEED_SCHEMA),
    "track": (K.new_tracker, step_track, TRACK_SCHEMA),
    "track_responsive": (K.new_tracker, step_track_responsive, TRACK_SCHEMA),
    "hold": (K.new_debounce, step_hold, HELD_SCHEMA),
    "session": (K.new_session, step_session, SESSION_SCHEMA),
}


def run_rows(machine: str, state: dict, rows: list[dict]) -> list[dict]:
    _, step, _ = MACHINES[machine]
    return [{"seq": r["seq"], "t_ms": r["t_ms"]} | step(state, r) for r in rows]


def batch(df: DataFrame, machine: str, key: str = "device") -> DataFrame:
    """M1, M6, M9, M11, L1 over whole traces: key, seq, t_ms and the machine's columns."""
    new, _, columns = MACHINES[machine]
    names = [c.split()[0] for c in columns.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(run_rows(machine, new(), rows_of(pdf)), columns=names)
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return df.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, {columns}")


class Machine(StatefulProcessor):
    """A machine whose state outlives micro-batches. With a timer machine ("session"), devices that fall silent are advised again when
    their advice expires (processing time)."""

    def __init__(self, machine: str, key: str):
        self.machine, self.key = machine, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("json", StringType())]))

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else MACHINES[self.machine][0]()

    def _emit(self, key, rows: list[dict]) -> pd.DataFrame:
        names = [c.split()[0] for c in MACHINES[self.machine][2].split(", ")]
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, self.key, key[0])
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        got = rows_of(pd.concat(list(rows)))
        out = run_rows(self.machine, state, got)
        if self.machine == "session" and out:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            state["clock"] = [got[-1]["t_ms"], got[-1]["seq"]]
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + out[-1]["reevaluate_ms"])
        self.state.update((json.dumps(state),))
        yield self._emit(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        t, seq = state["clock"]
        t += state["sampler"]["advice"]["reevaluate_ms"]
        out = K.tick(state, t)
        state["clock"] = [t, seq]
        self.state.update((json.dumps(state),))
        yield self._emit(key, [{"seq": seq, "t_ms": t} | out])

    def close(self) -> None:
        pass


def stream(df: DataFrame, machine: str, key: str = "device") -> DataFrame:
    """The machine over a streaming DataFrame. The session must use the RocksDB state store:
    spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider."""
    columns = MACHINES[machine][2]
    mode = "ProcessingTime" if machine == "session" else "None"
    return df.groupBy(key).transformWithStateInPandas(Machine(machine, key), f"{key} {dict(df.dtypes)[key]}, {columns}", "append", mode)
