"""Window specifications of lap traces, built from the key columns that exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

TRACE, FIELD, SESSION = (
    ("session_key", "driver_number"),
    ("session_key", "lap_number"),
    ("session_key",),
)
#: Orders laps of a trace; row_id, where present, breaks ties of repeated lap numbers.
ORDER = ("lap_number", "row_id")


def present_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    found = [k for k in keys if k in df.columns]
    if not found:
        raise KeyError(f"none of {tuple(keys)} is a column")
    return found


def group(df: DataFrame, keys: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*present_keys(df, keys))


def ordered(df: DataFrame, keys: Sequence[str] = TRACE) -> WindowSpec:
    return group(df, keys).orderBy(*present_keys(df, ORDER))
