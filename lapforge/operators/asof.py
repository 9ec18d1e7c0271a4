"""As-of join: facts with the version that was in force at their time.

Facts and versions are merged: sorted together by key and time, the number of versions of the key up to
a fact is the place of the one that may be in force, so facts and versions meet in an equi-join on key
and place. Nothing is compared pair by pair, and the sort is by ranges (see functions.order_statistics),
so neither a key of many facts nor one of many versions is one task's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.order_statistics import with_rows_below


def overlaps(versions: DataFrame, keys: Sequence[str], since: str = "since", until: str = "until") -> DataFrame:
    """Versions that are still in force when the next of their key begins."""
    later = F.lead(since).over(W.partitionBy(*keys).orderBy(since))
    return versions.withColumn("__next", later).where(F.col("__next").isNotNull() & (F.col(until).isNull() | (F.col("__next") < F.col(until)))).drop("__next")


def as_of_join(facts: DataFrame, versions: DataFrame, time: str, keys: Sequence[str], since: str = "since", until: str = "until") -> DataFrame:
    """facts with the other columns of the version of their keys for which since <= time < until (until null:
    open), nulls if there is none. Facts with a null key or time have none; versions without since are
    never in force. LookupError if versions of a key overlap."""
    keys = list(keys)
    versions = versions.where(F.col(since).isNotNull())
    if not (odd := overlaps(versions, keys, since, until)).isEmpty():
        raise LookupError(f"overlapping versions: {odd.first()}")
    taken = [c for c in versions.columns if c not in keys]
    fact, version = F.struct(*facts.columns), F.struct(*taken)
    own = versions.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(since).alias("t"), version.alias("v"))
    rows = facts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(time).alias("t"), fact.alias("f"))
    ks, absent = [f"k{i}" for i in range(len(keys))], lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    # versions come before facts of the same time; equal facts are told apart, so that ranges can part them
    merged = rows.select(*ks, "t", F.lit(1).alias("is_fact"), F.xxhash64("f").alias("tie"), F.lit(0).alias("n"), "f", absent(own, "v")).union(
        own.select(*ks, "t", F.lit(0), F.lit(0).cast("long"), F.lit(1), absent(rows, "f"), "v")
    )
    placed = with_rows_below(merged, ["t", "is_fact", "tie"], ks)
    mine = placed.where("is_fact = 1").select(*ks, "t", "below", "f")
    theirs = placed.where("is_fact = 0").select(*[F.col(k).alias(f"v_{k}") for k in ks], (F.col("below") + 1).alias("place"), "v")
    same = F.col("below") == F.col("place")
    for k in ks:
        same = same & (F.col(k) == F.col(f"v_{k}"))
    live = F.col("t").isNotNull() & (F.col(f"v.{until}").isNull() | (F.col("t") < F.col(f"v.{until}")))
    return mine.join(theirs, same, "left").select("f.*", *[F.when(live, F.col(f"v.{c}")).alias(c) for c in taken])
