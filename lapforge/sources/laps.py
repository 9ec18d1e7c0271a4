"""Sources and sinks of laps: derived laps, sessions, star load, stored laps and traces."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import normalize_compound
from ..functions.windows import ORDER, TRACE
from ..schema import LAPS_SCHEMA, RACES_SCHEMA
from ..staging import stage
from . import sessions

log = logging.getLogger(__name__)


def laps_from_events(spark: SparkSession, sf_dir: str, with_nulls: bool = False) -> DataFrame:
    """A lap table out of the events table: a user's events in order are a trace of laps, a
    purchase is an in-lap. with_nulls leaves out the lap time of every 23rd event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    trace = W.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    pitted = F.col("event_type") == "purchase"
    before = F.coalesce(F.lag(pitted).over(trace), F.lit(False))
    k = F.get_json_object("props", "$.k").cast("long")
    laps = events.select(
        F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("session_key"),
        F.col("user_id").alias("driver_number"),
        F.row_number().over(trace).cast("long").alias("lap_number"),
        F.col("value").alias("lap_time_seconds"),
        F.when(pitted, seconds).alias("pit_in_time"),
        F.when(before, seconds).alias("pit_out_time"),
        (pitted | before).alias("is_pit_lap"),
        before.alias("out_lap"),
        F.expr("CASE event_type WHEN 'purchase' THEN 'HYPERSOFT' WHEN 'view' THEN ' m ' WHEN 'click' THEN 'Inter' WHEN 'error' THEN 'GLITTER' END").alias("tyre_compound_raw"),
        F.concat(F.lit("C"), (k % 7).cast("string")).alias("circuit_name"),
        F.when(F.dayofmonth("ts") <= 24, 2018).otherwise(2024).cast("long").alias("year"),
        "ts",
        "event_id",
    )
    by_lap = W.partitionBy("session_key", "driver_number").orderBy("lap_number").rowsBetween(W.unboundedPreceding, 0)
    laps = laps.withColumn("stint_number", (F.sum(F.col("out_lap").cast("long")).over(by_lap) + 1).cast("long"))
    laps = laps.withColumns({
        "position": F.row_number().over(W.partitionBy("session_key", "lap_number").orderBy("lap_time_seconds", "event_id")).cast("long"),
        "tyre_compound": normalize_compound(F.col("tyre_compound_raw")),
    }).drop("out_lap")
    if with_nulls:
        laps = laps.withColumn("lap_time_seconds", F.when(F.col("event_id") % 23 != 0, F.col("lap_time_seconds")))
    return laps


def race_metadata(laps: DataFrame) -> DataFrame:
    """One row a session: drivers, laps, and the least name and date of those columns that laps has."""
    told = {c: F.min(c).alias(c) for c in ("race_name", "circuit_name", "session_date") if c in laps.columns}
    return laps.groupBy("session_key").agg(
        F.count_distinct("driver_number").alias("num_drivers"), F.max("lap_number").cast("long").alias("num_laps"), *told.values()
    )


def attach_races(laps: DataFrame, races: DataFrame, columns: Sequence[str] = ("year", "circuit_name"), on: str = "race_id") -> DataFrame:
    """laps with the named columns of their race; laps without one keep nulls. Columns of laps with
    these names give way."""
    return laps.drop(*columns).join(races.select(on, *columns), on, "left")


def load_star(laps: DataFrame, races: DataFrame, years: Sequence[int] | None = None, on: str | None = None) -> DataFrame:
    """laps joined with their race (small dimension: Spark broadcasts it by its size). Other columns that both
    have are the race's. on: session_key if both have it, else race_id; laps stored by session are then
    pruned to the sessions of the years asked for, as the plan runs. An empty result raises ValueError."""
    if on is None:
        on = "session_key" if "session_key" in laps.columns and "session_key" in races.columns else "race_id"
    if years is not None:
        races = races.where(F.col("year").isin(list(years)))
    joined = laps.drop(*[c for c in races.columns if c != on]).join(races, on)
    if joined.isEmpty():
        raise ValueError("no laps for the chosen years")
    return joined


def _sessions(spark: SparkSession, root: str, years: Iterable[int], rounds: Iterable[int]) -> tuple[DataFrame, DataFrame]:
    sessions.register(spark)
    listed = lambda numbers: ",".join(str(x) for x in numbers)
    read = spark.read.format(sessions.FORMAT).option("years", listed(years)).option("rounds", listed(rounds)).load(root)
    table = stage(read, "sessions")  # the files are read once
    failures = table.where("failure is not null").select("session_key", "year", "round", "kind", "failure")
    return table.where("failure is null").drop("kind", "failure"), failures


def fetch_session(spark: SparkSession, root: str, year: int, number: int) -> tuple[DataFrame, dict] | tuple[None, None]:
    """(laps, meta) of one session under root (see sources.sessions); (None, None) if it can't be read.
    meta: session_key, year, round."""
    laps, failures = _sessions(spark, root, [year], [number])
    if failure := failures.first():
        log.warning("session %s: %s", failure["session_key"], failure["failure"])
        return None, None
    return laps, {"session_key": sessions.session_key(year, number), "year": year, "round": number}


def fetch_seasons(spark: SparkSession, root: str, years: Iterable[int], rounds: Iterable[int]) -> tuple[DataFrame, DataFrame]:
    """(laps, failures) of all sessions of years x rounds, from one scan that reads each session in a task of its
    own. laps: the sessions' cells as text with session_key, year, round and row_id; absent columns are
    null. failures: (session_key, year, round, kind: missing or unreadable, failure). ValueError if no session
    could be read."""
    laps, failures = _sessions(spark, root, years, rounds)
    if laps.isEmpty():
        raise ValueError("no session could be read")
    return laps, failures


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns that df and a contract share, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns])


def write_laps(laps: DataFrame, path: str) -> None:
    """Laps by the contract (whose columns alone are stored), partitioned by session and sorted by trace
    in each file; a session that is written again replaces itself."""
    rows = conform(laps, LAPS_SCHEMA)
    by = [c for c in ("session_key", "driver_number", "lap_number") if c in rows.columns]
    rows.sortWithinPartitions(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_key").parquet(path)


def read_laps(spark: SparkSession, path: str) -> DataFrame:
    """What write_laps stored; columns of the contract that no session has are null."""
    return spark.read.schema(LAPS_SCHEMA).parquet(path)


def save_traces(laps: DataFrame, table: str, buckets: int = 200) -> None:
    """Laps as a catalog table whose buckets hold whole traces, sorted by lap, one file a bucket: windows over
    traces (and over stints, which lie in a trace) need no exchange, nor, read by trace_table, a sort."""
    keys = [c for c in TRACE if c in laps.columns]
    order = [*keys, *[c for c in ORDER if c in laps.columns]]
    laps.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*order).format("parquet").saveAsTable(table)


def trace_table(spark: SparkSession, table: str) -> DataFrame:
    """A table of save_traces. Lets Spark rely on the order in a bucket's one file, for this session."""
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return spark.table(table)


def create_tables(spark: SparkSession, laps: str = "laps", races: str = "races") -> None:
    """Both tables of the contract in the session's catalog, if they are absent."""
    for name, schema, by in ((laps, LAPS_SCHEMA, " PARTITIONED BY (session_key)"), (races, RACES_SCHEMA, "")):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{by}")
