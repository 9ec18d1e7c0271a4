"""Exact ranks, running totals and quantiles without bringing all rows of a group into one task.

Rows are sorted by (keys, order) into ranges of about equal length: Spark samples them for the
splitters. Rows that are equal in keys and order must have been counted before, so no value is too frequent for
its range. In a range a task walks its sorted rows and adds up what it has read of each key so far.
What lies before the range is the same for all of its rows of one key, and other than 0 for one key
only: the one that the range before ended with. So the totals that ranges hand on have a row a
range at most, and they are broadcast. A task holds one range, whatever the values: narrow, wide or
mostly equal, of one key or of many.

The ranges are staged (see lapforge.staging): ranks, quantiles and what else is asked of them read
that one table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import stage

_RANGE, _INSIDE = "__range", "__inside"


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays are equal or both null."""
    return pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _walk(keys: list[str], n: str):
    """Batches of a sorted range with what their key's rows before hold, in this range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            amount = batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                c = batch.column(k)
                new[1:] |= ~_same(c[1:], c[:-1])
            ends = [tuple(batch.column(k)[at].as_py() for k in keys) for at in (0, batch.num_rows - 1)]
            before = np.cumsum(amount) - amount
            starts = np.append(0, np.flatnonzero(new))
            inside = before - np.repeat(before[starts], np.diff(np.append(starts, len(new))))
            if ends[0] == last:
                inside[: starts[1] if len(starts) > 1 else len(new)] += total
            last, total = ends[1], int(inside[-1] + amount[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside)], names=[*batch.schema.names, _INSIDE])

    return run


def ranged(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = (), n: str = "n") -> DataFrame:
    """rows, staged by ranges of (keys, order), with their range and what it holds of the key before them."""
    keys, order = list(keys), list(order)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    walked = cut.mapInArrow(_walk(keys, n), f"{_ddl(rows)}, {_INSIDE} long")
    return stage(walked.withColumn(_RANGE, F.spark_partition_id()), "ranges")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def with_rows_below(rows: DataFrame, order: str | Sequence[str], keys: Sequence[str] = (), n: str = "n", name: str = "below") -> DataFrame:
    """rows (one for each key and place in the order, n of it) with the sum of n over the key's rows before.
    What is returned reads staged ranges, so that it may be used more than once."""
    keys = list(keys)
    table = ranged(rows, [order] if isinstance(order, str) else order, keys, n)
    totals = table.groupBy(*keys, _RANGE).agg(F.sum(n).alias("__n"))
    earlier = W.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.sum("__n").over(earlier)).where("__before > 0")  # one key a range
    same = F.col(_RANGE) == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    handed = F.broadcast(totals.select(F.col(_RANGE).alias("__r"), "__before", *[F.col(k).alias(f"__{k}") for k in keys]))
    below = (F.col(_INSIDE) + F.coalesce("__before", F.lit(0))).cast("long")
    return table.join(handed, same, "left").select(*rows.columns, below.alias(name))


def dense_ids(rows: DataFrame, order: Sequence[str], first: int, name: str) -> DataFrame:
    """rows (distinct in order) numbered first, first + 1, ... in their order."""
    numbered = with_rows_below(rows.withColumn("__one", F.lit(1)), order, n="__one", name="__at")
    return numbered.withColumn(name, F.col("__at") + first).drop("__one", "__at")


def quantiles(below: DataFrame, value: str, cuts: Sequence[float], keys: Sequence[str] = (), n: str = "n") -> DataFrame:
    """(keys, quantiles: an array, one for each cut) by linear interpolation, from what with_rows_below returns.
    Only the rows that hold a rank asked for take part in more than one sum."""
    keys = list(keys)
    last = F.sum(n) - 1
    place = [F.lit(float(c)) * F.col("__last") for c in cuts]
    ranks = below.groupBy(*keys).agg(last.alias("__last")).where("__last >= 0")
    ranks = ranks.select(*[F.col(k).alias(f"__{k}") for k in keys], F.array(*place).alias("__places"))
    same: Column = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    holds = lambda rank: (F.col("below") <= rank) & (rank < F.col("below") + F.col(n))
    met = below.where(F.col(n) > 0).join(ranks, same).select(
        *keys, value, F.filter(F.transform("__places", lambda p, i: F.struct(i.alias("i"), p.alias("p"), holds(F.floor(p)).alias("lo"), holds(F.ceil(p)).alias("hi"))), lambda x: x["lo"] | x["hi"]).alias("__met")
    )
    met = met.where(F.size("__met") > 0).select(*keys, value, F.explode("__met").alias("x"))
    at = lambda side: F.max(F.when(F.col(f"x.{side}"), F.col(value)))
    found = met.groupBy(*keys, "x.i").agg(at("lo").alias("a"), at("hi").alias("b"), F.first("x.p").alias("p"))
    up = F.col("p") - F.floor("p")
    between = F.when(up == 0, F.col("a")).otherwise((F.ceil("p") - F.col("p")) * F.col("a") + up * F.col("b"))
    listed = F.sort_array(F.collect_list(F.struct("i", between.alias("q"))))
    return found.groupBy(*keys).agg(listed.alias("l")).select(*keys, F.col("l.q").alias("quantiles"))
