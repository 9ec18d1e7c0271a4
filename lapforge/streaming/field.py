"""Field-relative metrics of laps on a stream, final under a lateness bound.

gap_to_leader@v1 and @v2, gap_closing_rate@v1 and relative_pace_delta@v1 compare a lap with those of all
drivers on the same lap, so they are known once the lap closes: when the watermark (the latest event
time less `lateness`) has passed the lap's first finish by `spread`, the time that the field may need to
get over the line. Laps of a session close in order; then their rows come out, equal to the batch metrics of
the laps that had come in. A row of a lap that has closed is late: it comes out at once with late true and
without metrics, so that late laps can be counted.

State of a session: the rows of its open laps (bounded by spread and lateness, whatever the session's
length), and for each driver the running gap and the last three gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

METRICS = ("gap_to_leader@v1", "gap_to_leader@v2", "gap_closing_rate@v1", "relative_pace_delta@v1")
ROW = ("driver_number", "lap_number", "row_id", "lap_time_seconds", "at_ms")
OUTPUT = "session_key string, driver_number long, lap_number long, row_id long, late boolean, " + ", ".join(f"`{m}` double" for m in METRICS)
_OPEN = ", ".join(f"{c} array<{'double' if c == 'lap_time_seconds' else 'long'}>" for c in ROW)
STATE = f"closed long, {_OPEN}, drivers array<long>, totals array<double>, gaps array<array<double>>"


def close_lap(laps: pd.DataFrame, memory: dict[int, tuple[float, list[float]]]) -> pd.DataFrame:
    """The metrics of all rows of one lap; memory (driver: running gap, last three gaps) moves on."""
    time = laps["lap_time_seconds"].to_numpy(float)
    timed = time[~np.isnan(time)]
    gap = time - (timed.min() if len(timed) else np.nan)
    closing, total = np.full(len(laps), np.nan), np.full(len(laps), np.nan)
    for i, driver in enumerate(laps["driver_number"]):
        so_far, gaps = memory.get(driver, (np.nan, []))
        if len(gaps) == 3:
            closing[i] = (gaps[0] - gap[i]) / 3
        if not np.isnan(gap[i]):
            so_far = gap[i] + (0.0 if np.isnan(so_far) else so_far)
        total[i] = so_far
        memory[driver] = so_far, [*gaps, gap[i]][-3:]
    pace = time - (np.median(timed) if len(timed) else np.nan)
    return laps[["driver_number", "lap_number", "row_id"]].assign(late=False, **dict(zip(METRICS, (gap, total, closing, pace), strict=True)))


def _step(spread_ms: int):
    none = lambda x: None if np.isnan(x) else float(x)
    nan = lambda x: np.nan if x is None else x

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, memory, parts = 0, {}, []
        open_ = pd.DataFrame({c: pd.Series(dtype=float if c == "lap_time_seconds" else "int64") for c in ROW})
        if state.exists:
            closed, *columns, drivers, totals, gaps = state.get
            open_ = pd.DataFrame({c: [nan(v) for v in x] for c, x in zip(ROW, columns, strict=True)})
            memory = {d: (nan(t), [nan(g) for g in three]) for d, t, three in zip(drivers, totals, gaps, strict=True)}
        new = pd.concat([open_.head(0), *([] if state.hasTimedOut else [f[list(ROW)] for f in frames])])
        late = new["lap_number"] <= closed
        if late.any():
            parts.append(new.loc[late, ["driver_number", "lap_number", "row_id"]].assign(late=True, **dict.fromkeys(METRICS, np.nan)))
        open_ = pd.concat([x for x in (open_, new[~late]) if len(x)] or [open_])
        due = state.getCurrentWatermarkMs() - spread_ms
        for lap, first in open_.groupby("lap_number")["at_ms"].min().sort_index().items():
            if first > due:
                break
            parts.append(close_lap(open_[open_["lap_number"] == lap].sort_values(["driver_number", "row_id"]), memory))
            closed = int(lap)
        open_ = open_[open_["lap_number"] > closed]
        listed = [[none(v) for v in open_[c]] if c == "lap_time_seconds" else open_[c].astype("int64").tolist() for c in ROW]
        known = list(memory)
        state.update((closed, *listed, [int(d) for d in known], [none(memory[d][0]) for d in known], [[none(g) for g in memory[d][1]] for d in known]))
        if len(open_):  # wakes up when the lowest open lap is due
            lowest = open_.loc[open_["lap_number"] == open_["lap_number"].min(), "at_ms"].min()
            state.setTimeoutTimestamp(int(max(lowest + spread_ms, state.getCurrentWatermarkMs() + 1)))
        out = pd.concat(parts) if parts else None
        if out is not None:
            yield out.assign(session_key=key[0])[["session_key", "driver_number", "lap_number", "row_id", "late", *METRICS]]

    return step


def field_metrics(laps: DataFrame, ts: str = "ts", lateness: str = "1 minute", spread_seconds: float = 600.0) -> DataFrame:
    """(session_key, driver_number, lap_number, row_id, late, metrics) of a stream of laps with event time ts, in
    append mode. Rows without session, driver, lap number or time of the event are left out; without
    row_id they count it as 0."""
    row_id = F.col("row_id").cast("long") if "row_id" in laps.columns else F.lit(None).cast("long")
    rows = laps.withWatermark(ts, lateness).where(f"session_key is not null and driver_number is not null and lap_number is not null and {ts} is not null")
    rows = rows.select(
        "session_key", F.col("driver_number").cast("long").alias("driver_number"), F.col("lap_number").cast("long").alias("lap_number"),
        F.coalesce(row_id, F.lit(0)).alias("row_id"), F.col("lap_time_seconds").cast("double").alias("lap_time_seconds"),
        F.unix_millis(ts).alias("at_ms"), ts,
    )
    step = rows.groupBy("session_key").applyInPandasWithState(_step(int(spread_seconds * 1000)), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return step.select("session_key", "driver_number", "lap_number", "row_id", "late", *[F.when(~F.isnan(f"`{m}`"), F.col(f"`{m}`")).alias(m) for m in METRICS])
