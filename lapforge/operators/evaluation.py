"""Quality of scored laps: columns y (0 or 1) and p (probability)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.order_statistics import quantiles, with_rows_below

MIN_GROUP = 30


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": _ratio(2 * precision * recall, precision + recall)}


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1). Every row adds to the bin of the highest
    threshold that it reaches; running sums over the grid give the counts, so a row is handled
    once, not once for each threshold."""
    grid = sorted(thresholds)
    edges = F.array(*[F.lit(float(t)) for t in grid])
    bins = scored.groupBy(F.size(F.filter(edges, lambda t: t <= F.col("p"))).alias("bin")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    numbered = scored.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "bin int, threshold double")
    down = W.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)  # one row a threshold
    both = numbered.unionByName(scored.sparkSession.createDataFrame([(0, None)], "bin int, threshold double")).join(bins, "bin", "left")
    counts = both.select(
        "threshold",
        F.sum(F.coalesce("pos", F.lit(0))).over(down).cast("long").alias("tp"),
        F.sum(F.coalesce("neg", F.lit(0))).over(down).cast("long").alias("fp"),
        F.sum(F.coalesce("pos", F.lit(0))).over(W.partitionBy()).cast("long").alias("all"),
    ).where("threshold is not null")
    counts = counts.withColumn("fn", F.col("all") - F.col("tp")).drop("all")
    return counts.withColumns(_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """(threshold, f1) of the best F1, the least threshold on ties; (0.5, 0) if none is over 0."""
    best = F.max_by("threshold", F.struct("f1", (-F.col("threshold")).alias("t")))
    return sweep.agg(
        F.when(F.max("f1") > 0, best).otherwise(0.5).alias("threshold"), F.coalesce(F.max("f1"), F.lit(0.0)).alias("f1")
    )


def _tied(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, n, pos, neg, ranked, below): a row for each distinct p of a group, staged by ranges of p.
    Rows without p count in n alone; ranked are those with one, below the group's of lesser p."""
    ties = scored.groupBy(*keys, "p").agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    return with_rows_below(ties.withColumn("ranked", F.when(F.col("p").isNotNull(), F.col("n")).otherwise(F.lit(0))), "p", keys, "ranked")


def _auc_of() -> tuple[list[Column], Column]:
    """(sums over a group's ties, ROC-AUC from them): Mann-Whitney with average ranks, exact."""
    has = F.col("p").isNotNull()
    rank = F.col("below") + (F.col("ranked") + 1) / 2
    sums = [F.sum(F.when(has, rank * F.col("pos"))).alias("r"), F.sum(F.when(has, F.col("pos"))).alias("np"), F.sum("ranked").alias("nn")]
    neg = F.col("nn") - F.col("np")
    auc = (F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * neg)
    return sums, F.when((F.col("np") > 0) & (neg > 0), auc)


def roc_auc(scored: DataFrame) -> DataFrame:
    sums, auc = _auc_of()
    return _tied(scored, []).agg(*sums).where("nn is not null").select(auc.alias("roc_auc"))


def group_metrics(scored: DataFrame, group: str, threshold: float = 0.5, min_size: int = MIN_GROUP) -> DataFrame:
    """(group, n, roc_auc, precision, recall, f1), by group with null last; null where a group has
    under min_size rows or one class only. The null group is a group. All comes from one table of ties."""
    hit = F.col("p") >= threshold
    ties = _tied(scored, [group])
    sums, auc = _auc_of()
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    groups = ties.groupBy(group).agg(
        F.sum("n").alias("n"), total("pos", hit).alias("tp"), total("neg", hit).alias("fp"), total("pos", ~hit).alias("fn"), *sums
    )
    fit = (F.col("n") >= min_size) & auc.isNotNull()
    named = {"roc_auc": auc, **_scores(F.col("tp"), F.col("fp"), F.col("fn"))}
    return groups.select(group, "n", *[F.when(fit, v).alias(k) for k, v in named.items()]).orderBy(F.col(group).asc_nulls_last())


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def brier_by_group(scored: DataFrame, group: str, min_size: int = MIN_GROUP) -> DataFrame:
    score = F.avg(F.pow(F.col("p") - F.col("y"), 2))
    scores = scored.groupBy(group).agg(F.count("*").alias("n"), F.when(F.count("*") >= min_size, score).alias("brier"))
    return scores.orderBy(F.col(group).asc_nulls_last())


def nearest_threshold(sweep: DataFrame, threshold: float) -> DataFrame:
    """The one row of a sweep whose threshold is nearest, the lower one on ties."""
    return sweep.orderBy(F.abs(F.round(F.col("threshold") - threshold, 9)), "threshold").limit(1)


def reliability(scored: DataFrame, n_bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """(bin, mean_predicted, observed_rate, n) for each bin that has rows. Quantile bins have
    equal counts (equal edges merge), uniform ones equal width; both are closed on the right."""
    if strategy not in ("quantile", "uniform"):
        raise ValueError(f"unknown strategy {strategy!r}")
    counts = scored.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.count("y").alias("known")).where("p is not null")
    if strategy == "quantile":
        counts = with_rows_below(counts, "p")
        limits = quantiles(counts, "p", [i / n_bins for i in range(n_bins + 1)]).select(F.array_distinct("quantiles").alias("e"))
        bin_ = F.greatest(F.lit(1), F.size(F.filter("e", lambda e: e < F.col("p"))))
    else:
        limits = counts.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
        place = F.ceil(F.try_divide((F.col("p") - F.col("lo")) * n_bins, F.col("hi") - F.col("lo")))
        bin_ = F.greatest(F.lit(1), F.least(F.lit(n_bins), F.coalesce(place, F.lit(1))))
    return (
        counts.join(F.broadcast(limits))  # one row
        .groupBy(bin_.cast("long").alias("bin"))
        .agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_predicted"), (F.sum("pos") / F.sum("known")).alias("observed_rate"), F.sum("n").alias("n"))
    )
