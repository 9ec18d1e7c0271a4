"""Population stability of features between a reference and a current sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order_statistics import quantiles, with_rows_below
from ..functions.scalars import finite, psi_severity

FLOOR = 1e-4


def _counted(frame: DataFrame, is_reference: Column, features: Sequence[str]) -> DataFrame:
    """(feature, v, and r, c: finite values of the reference and of the rest), counted before any shuffle."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features]
    long = frame.select(is_reference.alias("ref"), F.explode(F.array(*pairs)).alias("x")).where("ref is not null")
    long = long.select("ref", "x.feature", finite(F.col("x.v")).alias("v")).where("v is not null")
    return long.groupBy("feature", "v").agg(F.count_if("ref").alias("r"), F.count_if(~F.col("ref")).alias("c"))


def drift_report(reference: DataFrame, current: DataFrame, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    """(feature, psi, severity), worst first. Bins are quantiles of the reference; the outer
    ones are open; empty bins count FLOOR. One class of values only: 0. A feature that a side
    lacks, or has no finite value of, is unavailable."""
    both = [c for c in features if c in reference.columns and c in current.columns]
    side = lambda df, ref: df.select(F.lit(ref).alias("__ref"), *[F.col(c).cast("double").alias(c) for c in both])
    return _report(side(reference, True).union(side(current, False)), F.col("__ref"), features, both, n_bins)


def drift_within(frame: DataFrame, is_reference: Column, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    """drift_report of the rows of one frame for which is_reference is true against those for which it is
    false (null: neither); the frame is read once."""
    return _report(frame, is_reference, features, [c for c in features if c in frame.columns], n_bins)


def _report(frame: DataFrame, is_reference: Column, features: Sequence[str], both: list[str], n_bins: int) -> DataFrame:
    names = frame.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    if not both:
        return names.select("feature", F.lit(None).cast("double").alias("psi"), F.lit("unavailable (column missing)").alias("severity"))
    # staged once: edges and shares both come from it
    values = with_rows_below(_counted(frame, is_reference, both), "v", ["feature"], "r")
    edges = quantiles(values, "v", [i / n_bins for i in range(n_bins + 1)], ["feature"], "r")
    edges = edges.select("feature", F.array_distinct("quantiles").alias("e"))
    # inner edges part the bins; a value on an edge belongs to the upper bin
    edges = edges.select("feature", F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))).alias("inner"), F.size("e").alias("n_edges"))
    edges = F.broadcast(edges)  # one row a feature
    bin_ = F.size(F.filter("inner", lambda e: e <= F.col("v")))
    seen = values.join(edges, "feature").groupBy("feature", "n_edges", "inner", bin_.alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    # from here on a row for each feature and bin; a bin that neither side has counts FLOOR on both, so it adds 0
    total = seen.groupBy("feature", "n_edges").agg(F.sum("r").alias("all_r"), F.sum("c").alias("all_c"))
    share = lambda c: F.greatest(F.col(c) / F.col(f"all_{c}"), F.lit(FLOOR))
    psi = (
        seen.join(total, ["feature", "n_edges"])
        .where("all_c > 0")
        .groupBy("feature", "n_edges")
        .agg(F.sum((share("c") - share("r")) * F.log(share("c") / share("r"))).alias("s"))
        .select("feature", F.when(F.col("n_edges") < 2, 0.0).otherwise(F.col("s")).alias("psi"))
    )
    told = F.coalesce(psi_severity(F.col("psi")), F.lit("unavailable (column missing)"))
    return names.join(psi, "feature", "left").select("feature", "psi", told.alias("severity")).orderBy(F.col("psi").desc_nulls_last())


def psi(reference: DataFrame, current: DataFrame, column: str, n_bins: int = 10) -> float:
    """The index of one column; ValueError if a side has no finite value."""
    value = drift_report(reference, current, [column], n_bins).first()["psi"]
    if value is None:
        raise ValueError(f"{column} has no finite value on one side")
    return value
