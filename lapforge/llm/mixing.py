"""Mixing sources to target weights by capped water-filling.

Every source may be repeated at most max_epochs times. A source whose weighted share is
over that cap is clamped to it and the excess goes to the others in proportion to their
weights, until none is above. In closed form: with sources ordered by cap / weight, the
clamped ones are a prefix of that order, found from running sums.

Whole repetitions take every document; the fractional one takes the documents whose seeded
hash lies below a cut. The cut is set from a 4096-bin histogram of the hash, so a source's
words miss the target by half a bin (1/8192 of the source) or half a document at most.

Defined results: null source is a source of its own, last in order; null, empty and blank
texts have size 0; rows without id are hashed by their text; with no words at all every target is 0. Repeated rows hash alike and are
taken alike. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, stage, words

BINS = 4096
#: The plan has one row a source; it is broadcast up to this many sources.
MAX_BROADCAST = 10_000


def hash_bin(key: Column, seed: int, text: Column) -> Column:
    """A seeded bin below BINS for a document id, or for the text of a row without one: three
    hex digits of its MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.concat(F.lit("text "), F.xxhash64(text).cast("string"))))
    return F.conv(F.substring(F.md5(text), 1, 3), 16, 10).cast("int")


def water_fill(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target). One row a source goes
    through one task: the windows run over sources, never over documents."""
    every = W.partitionBy()
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn(
        "weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    )
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = F.sum("source_size").over(every) * F.lit(float(share))
    by_cap = W.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    filled = ranked.select(
        "*",
        cap.alias("cap"),
        total.alias("total"),
        F.coalesce(F.sum(cap).over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)).alias("open"),
    ).withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
    # the first source (in cap order) that its level doesn't fill to the cap sets the level for all after it
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("before", "level"))).over(every)
    return filled.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("cap"), F.coalesce(level["level"] * F.col("weight"), F.col("cap"))).alias("target"),
    )


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(sized documents: id, source, size, bin; plan: source, source_size, target, whole, cut).
    A document is taken whole + (1 if bin < cut) times. Both are staged tables without text."""
    sized = stage(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.size(words(F.col(text_col))).cast("long").alias("size"),
            hash_bin(F.col(id_col), seed, F.col(text_col)).alias("bin"),
        ),
        "sized",
    )
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    bins = stage(bins, "bins")
    targets = water_fill(
        bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs
    ).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # the cut after the bin whose running total comes nearest to the rest; 0 (none) counts too
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bin"))
    cuts = (
        bins.select(F.col("source").alias("s"), F.col("bin"), upto.alias("upto"))
        .join(targets.select(F.col("source").alias("t"), "rest"), F.col("s").eqNullSafe(F.col("t")))
        .groupBy("s")
        .agg(
            F.min(F.struct(F.abs(F.col("upto") - F.col("rest")).alias("miss"), (F.col("bin") + 1).alias("cut"))).alias("m"),
            F.first("rest").alias("rest"),
        )
        .select("s", F.when(F.col("m.miss") < F.col("rest"), F.col("m.cut")).otherwise(0).alias("cut"))
    )
    plan = targets.join(cuts, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "source_size", "target", F.col("whole").cast("long").alias("whole"), F.col("cut").cast("int").alias("cut")
    )
    return sized, stage(plan, "plan")


def _copies() -> Column:
    return F.col("whole") + F.when(F.col("bin") < F.col("cut"), 1).otherwise(0)


def mix_report(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, copies, taken (words)."""
    p = broadcast_if_small(plan.withColumnRenamed("source", "__s"), MAX_BROADCAST)
    return sized.join(p, F.col("source").eqNullSafe(F.col("__s"))).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        _copies().alias("copies"),
        (_copies() * F.col("size")).alias("taken"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    copy_col: str = "__copy",
) -> DataFrame:
    """The mixed corpus itself: every row of docs as often as the mix takes it, with copy_col
    (1, 2, ...; under a name of its own, with _ before it, if docs has that column). Rows that
    it doesn't take are absent."""
    _, plan = mix_plan(docs, weights, share, max_epochs, seed, id_col, text_col, source_col)
    p = broadcast_if_small(plan.select(F.col("source").alias("s"), "whole", "cut"), MAX_BROADCAST)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),  # names can't clash then
        F.col(source_col).alias("source"),
        hash_bin(F.col(id_col), seed, F.col(text_col)).alias("bin"),
    )
    taken = rows.join(p, F.col("source").eqNullSafe(F.col("s"))).withColumn("n", _copies()).where("n > 0")
    return taken.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias(fresh(copy_col, docs)))
