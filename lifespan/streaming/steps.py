"""Steps of live units in order of their times: position, running minimum, windows, lasting exceedance.

Rows wait in the state of their unit until the watermark has passed them; a timer then hands them on in
order of time, so the result does not depend on the order in which they came.  What a unit carries is
bounded: its count, its lowest value, the tail of one window and the begin of the present run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WAITING = "at long, tie long, value double"
CARRIED = "n long, low double, tail array<double>, since long, alarmed boolean"
STEPS = "unit_id string, at long, tie long, step long, value double, low double, window_index long, x array<double>, first_at long"


@dataclass(frozen=True)
class StepRules:
    """Window length and stride in steps; a value above ``limit`` for ``duration`` seconds is an alarm."""

    length: int
    stride: int
    limit: float
    duration: float


class Steps(StatefulProcessor):
    """One row per step; ``x`` holds the window that ends there, if one does, and ``first_time`` the begin
    of the first lasting exceedance, at the step that makes it last."""

    def __init__(self, rules: StepRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.carried = handle.getValueState("carried", CARRIED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        soonest = None
        for batch in rows:
            new = [(int(a), int(t), None if pd.isna(v) else float(v)) for a, t, v in zip(batch["at"], batch["tie"], batch["value"])]
            if new:
                self.waiting.appendList(new)
                soonest = min([a for a, _, _ in new] + ([soonest] if soonest is not None else []))
        if soonest is not None:
            # a timer counts milliseconds; the watermark has to be beyond it
            self.handle.registerTimer(soonest // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1]))
        ready, later = [r for r in every if r[0] < passed], [r for r in every if r[0] >= passed]
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.appendList(later)
                self.handle.registerTimer(later[0][0] // 1000 + 1)
            yield self._steps(key[0], ready)

    def _steps(self, unit: str, rows: list[tuple]) -> pd.DataFrame:
        r = self.rules
        n, low, tail, since, alarmed = self.carried.get() if self.carried.exists() else (0, None, [], None, False)
        tail, out = list(tail), []
        for at, tie, value in rows:
            low = value if low is None else low if value is None else min(low, value)
            tail = [*tail, value][-r.length :]
            whole = n + 1 >= r.length and (n + 1 - r.length) % r.stride == 0
            above = value is not None and value > r.limit
            since = (at if since is None else since) if above else None
            first = None
            if above and not alarmed and at - since >= r.duration * 1e6:
                alarmed, first = True, since
            out.append((unit, at, tie, n, value, low, (n + 1 - r.length) // r.stride if whole else None, list(tail) if whole else None, first))
            n += 1
        self.carried.update((n, low, tail, since, alarmed))
        made = pd.DataFrame(out, columns=[f.split()[0] for f in STEPS.split(", ")])
        return made.astype({"window_index": "Int64", "first_at": "Int64"})

    def close(self) -> None:
        pass


def stream_steps(rows: DataFrame, rules: StepRules, lateness: str) -> DataFrame:
    """Steps of ``unit_id, ts, tie, value`` rows, each emitted once the watermark has passed it.

    Rows later than ``lateness`` are dropped by Spark; rows of one time come in order of ``tie``.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    timed = rows.select("unit_id", "ts", F.unix_micros("ts").alias("at"), "tie", "value").withWatermark("ts", lateness)
    made = timed.groupBy("unit_id").transformWithStateInPandas(Steps(rules), T.StructType.fromDDL(STEPS), "Append", "EventTime")
    named = {"at": F.timestamp_micros("at").alias("ts"), "first_at": F.timestamp_micros("first_at").alias("first_time")}
    return made.select(*[named.get(c, F.col(c)) for c in made.columns])
