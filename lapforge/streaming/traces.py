"""Own-trace metrics of laps on a stream, with state for each trace.

A trace's state is what its next lap needs: times of the last four laps, the pit entry and number of the last
lap, pit laps so far, and for each stint its total time and laps. So a lap's metrics come out with
the micro-batch that brings it, and equal those of the whole trace, however the stream is cut:
tyre_age@v1 and @v2, stint_age_squared@v1, pit_delta@v2, degradation_rate@v1 and pace_delta@v1.

A call for each trace costs far more than its laps do, so the traces of DRIVERS neighbouring driver numbers of a
session share a key of the state, and one call works on the laps of all of them as arrays. A key
never has more traces than that, so more traces make more keys, not larger ones. Driver numbers that aren't
integers are keys of their own.

Laps of a trace must come in order. One that comes in a later batch than a higher lap number is late: it is
told (late is true, metrics are null) and changes nothing. A trace that brings no lap for idle_timeout_ms
loses its state (not by default: with such a timeout Spark goes on with empty batches, so a stream that
takes what there is and ends, as availableNow does, can't have one). A lap without stint number gets the one derived from the pit laps before it, as the batch
metrics do for traces that have no stint number at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.windows import TRACE

KEPT = 4  # laps before the current one that a window looks back to
INPUT = ("lap_number", "row_id", "lap_time_seconds", "stint_number", "is_pit_lap", "pit_in_time", "pit_out_time")
METRICS = ("tyre_age@v1", "tyre_age@v2", "stint_age_squared@v1", "pit_delta@v2", "degradation_rate@v1", "pace_delta@v1")
DRIVERS = 64  # a power of two
STATE = "last array<long>, pits array<long>, seen array<long>, pit_in array<double>, times array<double>, trace array<long>, stints array<double>, sums array<double>, laps array<long>"


def _output(df: DataFrame) -> str:
    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in TRACE)
    return f"{keys}, lap_number long, row_id long, late boolean, " + ", ".join(f"`{m}` double" for m in METRICS)


@dataclass
class _Traces:
    """The state of a key's traces: a value a trace up to times (KEPT of those a trace), then a value for each stint
    of the trace that `trace` counts to. seen: when the trace's last laps came, in ms."""

    drivers: list
    last: np.ndarray
    pits: np.ndarray
    seen: np.ndarray
    pit_in: np.ndarray
    times: np.ndarray
    trace: np.ndarray
    stints: np.ndarray
    sums: np.ndarray
    laps: np.ndarray

    @classmethod
    def of(cls, state: tuple | None) -> _Traces:
        drivers, last, pits, seen, pit_in, times, trace, stints, sums, laps = state or ([] for _ in range(10))
        whole = [np.array(x, "int64") for x in (last, pits, seen, trace, laps)]
        real = [np.array(x, float) for x in (pit_in, times, stints, sums)]
        return cls(list(drivers), *whole[:3], real[0], real[1].reshape(-1, KEPT), whole[3], *real[2:], whole[4])

    def stored(self) -> tuple:
        return self.drivers, *(x.ravel().tolist() for x in (self.last, self.pits, self.seen, self.pit_in, self.times, self.trace, self.stints, self.sums, self.laps))

    def grow(self, drivers: list) -> None:
        """Adds empty traces for drivers, whose first ones it has."""
        n = len(drivers) - len(self.drivers)
        self.drivers = drivers
        self.last = np.append(self.last, np.full(n, np.iinfo("int64").min))
        self.pits, self.seen = (np.append(x, np.zeros(n, "int64")) for x in (self.pits, self.seen))
        self.pit_in, self.times = np.append(self.pit_in, np.full(n, np.nan)), np.vstack([self.times, np.full((n, KEPT), np.nan)])

    def keep(self, stay: np.ndarray) -> None:
        """Drops the traces that don't stay."""
        self.drivers = [d for d, s in zip(self.drivers, stay, strict=True) if s]
        self.last, self.pits, self.seen, self.pit_in, self.times = (x[stay] for x in (self.last, self.pits, self.seen, self.pit_in, self.times))
        own = stay[self.trace]
        self.trace = (np.cumsum(stay) - 1)[self.trace[own]]
        self.stints, self.sums, self.laps = self.stints[own], self.sums[own], self.laps[own]


def _metrics(laps: pd.DataFrame, at: np.ndarray, held: _Traces) -> dict[str, np.ndarray]:
    """Metrics of laps in order of their traces (at counts to them) and of the laps in each; held moves on."""
    n, t = len(laps), np.arange(len(held.drivers))
    start, end = np.searchsorted(at, t), np.searchsorted(at, t, side="right")
    moved = end > start
    own = laps["lap_time_seconds"].to_numpy(float)

    # times of all traces in a line, each one's kept times before its laps
    line, lap, kept = np.full(n + KEPT * len(t), np.nan), np.arange(n) + KEPT * (at + 1), np.arange(KEPT)
    line[lap] = own
    line[(start + KEPT * t)[:, None] + kept] = held.times
    fives = np.lib.stride_tricks.sliding_window_view(line, KEPT + 1)[lap - KEPT]
    mean, before = fives[:, -3:].sum(1) / 3, fives[:, -4:-1].sum(1) / 3  # NaN where one is missing
    known, rising = (~np.isnan(fives)).sum(1), np.sort(fives, axis=1)  # NaN come last
    middle = [np.take_along_axis(rising, k[:, None], 1)[:, 0] for k in ((known - 1) // 2, known // 2)]
    median = (middle[0] + middle[1]) / 2
    held.times = line[(end + KEPT * t)[:, None] + kept]

    pit = laps["is_pit_lap"].fillna(False).to_numpy(bool)
    pits = np.append(0, np.cumsum(pit))
    derived = held.pits[at] + pits[:-1] - pits[start][at]
    held.pits = held.pits + pits[end] - pits[start]
    given = laps["stint_number"].to_numpy(float)

    # each stint's total so far, then its laps
    whose, stint = np.append(held.trace, at), np.append(held.stints, np.where(np.isnan(given), derived, given))
    order = np.lexsort((stint, whose))
    whose, stint = whose[order], stint[order]
    first = np.append(True, (whose[1:] != whose[:-1]) | (stint[1:] != stint[:-1]))
    group = np.cumsum(first) - 1
    total = pd.Series(np.append(held.sums, np.where(np.isnan(own), 0.0, own))[order]).groupby(group).cumsum().to_numpy()
    each = np.append(held.laps, np.ones(n, "int64"))[order]
    count = np.cumsum(each)
    count = count - (count - each)[first][group]
    place = np.empty(len(order), "int64")
    place[order] = np.arange(len(order))
    place = place[len(held.trace) :]
    driven, age = total[place] - own, (count[place] - 1).astype(float)
    last = np.append(first[1:], True)
    held.trace, held.stints, held.sums, held.laps = whose[last], stint[last], total[last], count[last]

    entries = laps["pit_in_time"].to_numpy(float)
    earlier = np.append(np.nan, entries[:-1])
    earlier[start[moved]] = held.pit_in[moved]
    delta = laps["pit_out_time"].to_numpy(float) - earlier
    held.pit_in[moved] = entries[end[moved] - 1]
    held.last[moved] = laps["lap_number"].to_numpy()[end[moved] - 1]
    return {
        "tyre_age@v1": driven, "tyre_age@v2": age, "stint_age_squared@v1": age**2,
        "pit_delta@v2": np.where(delta >= 0, delta, np.nan), "degradation_rate@v1": mean - before, "pace_delta@v1": own - median,
    }


def _step(timeout_ms: int | None):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, now, out = _Traces.of(state.get if state.exists else None), state.getCurrentProcessingTimeMs(), None
        if not state.hasTimedOut:
            laps = pd.concat(list(frames), ignore_index=True)
            before = pd.Series(held.drivers, dtype=laps["driver_number"].dtype)
            at, drivers = pd.factorize(pd.concat([before, laps["driver_number"]]), use_na_sentinel=False)
            held.grow([None if pd.isna(d) else d for d in drivers.tolist()])
            at = at[len(before) :]
            order = np.lexsort((laps["row_id"], laps["lap_number"], at))
            laps, at = laps.iloc[order], at[order]
            held.seen[at] = now
            late = laps["lap_number"].to_numpy() < held.last[at]
            columns = {"session_key": key[0], **{c: laps[c].to_numpy() for c in ("driver_number", "lap_number", "row_id")}, "late": late}
            found = _metrics(laps[~late], at[~late], held) if not late.all() else {}
            for name in METRICS:
                columns[name] = np.full(len(laps), np.nan)
                columns[name][~late] = found.get(name, np.nan)
            out = pd.DataFrame(columns)
        if timeout_ms is not None:
            held.keep(held.seen + timeout_ms >= now)
        if held.drivers:
            state.update(held.stored())
            if timeout_ms is not None:  # wakes up when the trace that has been idle longest is due
                state.setTimeoutDuration(max(1, int(held.seen.min()) + timeout_ms - now))
        else:
            state.remove()
        if out is not None:
            yield out

    return step


def trace_metrics(laps: DataFrame, idle_timeout_ms: int | None = None) -> DataFrame:
    """(session_key, driver_number, lap_number, row_id, late, metrics) of a stream of laps, in append mode. Laps
    without row_id count it as 0; without lap number they are left out."""
    absent = {c: F.lit(None).cast(kind) for c, kind in (("stint_number", "double"), ("pit_in_time", "double"), ("pit_out_time", "double"), ("is_pit_lap", "boolean"), ("row_id", "long")) if c not in laps.columns}
    laps = laps.withColumns(absent).where("lap_number is not null")
    rows = laps.select(*TRACE, F.col("lap_number").cast("long"), F.coalesce(F.col("row_id").cast("long"), F.lit(0)).alias("row_id"), "lap_time_seconds", F.col("stint_number").cast("double"), *INPUT[4:])
    timeout = GroupStateTimeout.NoTimeout if idle_timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    driver = rows.schema["driver_number"].dataType
    block = F.shiftright("driver_number", DRIVERS.bit_length() - 1) if isinstance(driver, T.IntegralType) else F.col("driver_number")
    state = f"drivers array<{driver.simpleString()}>, {STATE}"
    step = rows.withColumn("__block", block).groupBy("session_key", "__block").applyInPandasWithState(_step(idle_timeout_ms), _output(rows), state, "append", timeout)
    return step.select(*TRACE, "lap_number", "row_id", "late", *[F.when(~F.isnan(f"`{m}`"), F.col(f"`{m}`")).alias(m) for m in METRICS])
