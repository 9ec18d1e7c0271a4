"""The race table: dense surrogate keys that never change, and their place in the laps.

A race is named by (year, race_name). Races that the table knows keep their row and their id; new ones
are numbered on from the largest id in the order of their names, by running totals over sorted
ranges, so that no task sees them all. The table is a commit log: it is replaced whole, and two ingests at
once can't give one id twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order_statistics import dense_ids
from ..schema import RACES_SCHEMA
from .commits import CommitLog

NAME = ["year", "race_name"]


def race_candidates(laps: DataFrame) -> DataFrame:
    """The race of each session of laps (session_key, year, and what else is told of a race). A session
    without race_name is named by its key. ValueError if a session names two races, circuits or dates."""
    told = [c for c in ("year", "race_name", "circuit_name", "session_date") if c in laps.columns]
    races = laps.groupBy("session_key").agg(
        F.count_distinct("driver_number").alias("num_drivers"),
        F.max("lap_number").cast("long").alias("num_laps"),
        *[F.min(c).alias(c) for c in told],
        F.array(*[F.when(F.min(c) != F.max(c), F.lit(c)) for c in told]).alias("__odd"),
    )
    races = races.withColumn("__odd", F.array_compact("__odd"))
    if odd := races.where(F.size("__odd") > 0).select("session_key", "__odd").first():
        raise ValueError(f"session {odd['session_key']} has several values of {odd['__odd']}")
    name = F.coalesce("race_name", "session_key") if "race_name" in told else F.col("session_key")
    return races.withColumn("race_name", name).drop("__odd")


def merge_races(known: DataFrame | None, candidates: DataFrame) -> DataFrame:
    """known (None: an empty table) and after it the candidates whose (year, race_name) it lacks, with ids. Of
    candidates of one name the one of least session_key counts; their own ids don't."""
    columns = [f.name for f in RACES_SCHEMA if f.name != "race_id"]
    typed = candidates.select(
        *[(F.col(c) if c in candidates.columns else F.lit(None)).cast(RACES_SCHEMA[c].dataType).alias(c) for c in columns]
    )
    once = typed.groupBy(*NAME).agg(F.min(F.struct("session_key", *[c for c in columns if c not in (*NAME, "session_key")])).alias("r"))
    once = once.select(*NAME, "r.*")
    first = 1
    if known is not None:
        same = (F.col("year").eqNullSafe(F.col("__y"))) & (F.col("race_name").eqNullSafe(F.col("__n")))
        once = once.join(known.select(F.col("year").alias("__y"), F.col("race_name").alias("__n")), same, "left_anti")
        first = (known.agg(F.max("race_id")).first()[0] or 0) + 1
    new = dense_ids(once, NAME, first, "race_id").select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RACES_SCHEMA])
    return new if known is None else known.select(*new.columns).union(new)


def append_races(candidates: DataFrame, path: str) -> DataFrame:
    """The race table under path after the candidates that it lacked were added."""
    return CommitLog(candidates.sparkSession, path).update(lambda known: merge_races(known, candidates))


def read_races(spark: SparkSession, path: str) -> DataFrame:
    """The race table; FileNotFoundError before the first append."""
    races = CommitLog(spark, path).read()
    if races is None:
        raise FileNotFoundError(f"no race table under {path}")
    return races


def with_race_ids(laps: DataFrame, candidates: DataFrame, races: DataFrame) -> DataFrame:
    """laps with the race_id of their session's race."""
    same = F.col("year").eqNullSafe(F.col("__y")) & F.col("race_name").eqNullSafe(F.col("__n"))
    ids = candidates.select("session_key", *NAME).join(races.select("race_id", F.col("year").alias("__y"), F.col("race_name").alias("__n")), same)
    return laps.drop("race_id").join(ids.select("session_key", "race_id"), "session_key", "left")
