"""Labels: does the driver pit within the next k laps?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import ordered

HORIZON = 5


def with_target(laps: DataFrame, k: int = HORIZON) -> DataFrame:
    """pit_next: 1 if one of the next k laps of the trace is a pit lap, as documented."""
    pit = F.coalesce(F.col("is_pit_lap").cast("int"), F.lit(0))
    ahead = F.max(pit).over(ordered(laps).rowsBetween(1, k))
    return laps.withColumn(f"pit_next_{k}_laps", F.coalesce(ahead, F.lit(0)).cast("long"))


def with_compat_target(laps: DataFrame, k: int = HORIZON) -> DataFrame:
    """The label as older models saw it: the next lap and the k - 2 before, trailing."""
    w = ordered(laps)
    laps = laps.withColumn("__next", F.lead(F.coalesce(F.col("is_pit_lap").cast("int"), F.lit(0)), 1).over(w))
    trailing = F.max("__next").over(w.rowsBetween(-(k - 1), 0))
    return laps.withColumn(f"pit_next_{k}_laps_compat", F.coalesce(trailing, F.lit(0)).cast("long")).drop("__next")
