"""Micro-batch ingest of raw laps.

Own-trace metrics need whole traces, and field metrics are final only when every driver has
finished the lap, so the stream only normalizes and stores; metrics run on the stored sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import normalize_laps


def ingest(raw: DataFrame, path: str, checkpoint: str, session_key: str | None = None, once: bool = True) -> StreamingQuery:
    """Normalized laps of a stream under path, by session and batch. A batch that is run again
    after a failure replaces itself. Outlier flags need whole traces and are left to readers."""

    def write(batch: DataFrame, batch_id: int) -> None:
        laps = normalize_laps(batch, session_key, outliers=False).withColumn("batch", F.lit(batch_id))
        laps.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "session_key").parquet(path)

    stream = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def lap_counts(laps: DataFrame, ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Laps and mean time for each session and event-time window of a stream; later rows than
    the watermark allows are left out."""
    by = [F.window(ts, window).alias("window"), "session_key"]
    return laps.withWatermark(ts, late).groupBy(*by).agg(F.count("*").alias("n_laps"), F.avg("lap_time_seconds").alias("mean_time"))
