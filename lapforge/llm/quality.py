"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document when one of its measures is over a cutoff. A stratum (a
language) gets its own cutoffs. Candidates come from a fixed grid; the labelled documents
that pass the base rules are the holdout. A cutoff is certified when the exact binomial
(Clopper-Pearson) bound on its false rejection rate is within the risk: that is when
P(X <= rejected good | n good, risk) <= delta / (strata * rules). Along the grid cutoffs are
tested from lenient to strict and testing ends at the first failure (fixed sequence), so only
strata and rules need the Bonferroni share. Of the certified cutoffs the most useful one
holds: the largest excess of the rejection rate of bad documents over WEIGHT times that of
good ones; ties go to the more lenient; without an excess over 0 the rule stays off. With
probability 1 - delta no stratum rejects more than RISK of its good documents in all.

Defined results: null, empty and blank texts have measures 0 and fail the base rule (fewer
than 20 words). Null strata are a stratum. A stratum without enough labels certifies nothing
and keeps what passes the base rules. A document with several label rows has the lowest
quality. Ties and repeated rows are judged alike. Labels are counted whole; only counts by
stratum, one row each, travel. Very long texts are measured whole, a few MB at a time. An empty
table gives an empty table. Columns of docs come through whatever their names, also those that this
module uses (__q, row, stratum).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_PATTERN, broadcast_if_small, drop_stage, stage
from .texthash import _IS_WS, buffers, text_blocks, windows, word_hashes

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rule: cutoffs from lenient to strict.
GRID: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "dup_line_ratio": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "repeat_ratio": (0.28, 0.25, 0.2, 0.18, 0.15, 0.12, 0.1, 0.08, 0.05, 0.02),
    "mean_word_chars": (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0),
}
RISK, DELTA, WEIGHT = 0.02, 0.05, 5.0
#: Cutoffs have one row a stratum; broadcast up to this many.
MAX_BROADCAST = 10_000
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_repeat_words")


def repeated_words(h: np.ndarray, counts: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """For each text, words inside windows of n words that it holds twice or more."""
    w, per_text = windows(h, counts, n)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), per_text)
    w = w ^ (owner * np.uint64(0x9E3779B97F4A7C15))  # equal windows of different texts differ
    s = np.sort(w)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(counts), np.int64)
    at = np.minimum(np.searchsorted(twice, w), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == w)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(per_text)[:-1]]), per_text)
    begin = hit + first[hit]
    edge = np.bincount(begin, minlength=len(h) + 1) - np.bincount(begin + n, minlength=len(h) + 1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return inside[starts + counts] - inside[starts]


def _measure(texts: pa.Array) -> pa.Array:
    parts: list[np.ndarray] = []
    for lo, hi in text_blocks(texts):
        block = texts.slice(lo, hi - lo)
        raw, offsets = buffers(block)
        h, counts = word_hashes(block, fold=False)
        total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
        chars = total(((raw & 0xC0) != 0x80) & ~_IS_WS[raw])
        parts.append(np.stack([counts, chars, total(_IS_SYMBOL[raw]), repeated_words(h, counts)]))
    both = np.concatenate(parts, 1) if parts else np.zeros((4, 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in both], names=list(_MEASURES))


def _measures_udf():
    # marked so that a filter on the measures isn't pushed below them, where they would be made a second time,
    # in a second Python worker of the same task
    return F.arrow_udf(_measure, ", ".join(f"{c} long" for c in _MEASURES)).asNondeterministic()


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct __q: the measures and base_failed."""
    out = docs.withColumn("__m", _measures_udf()(F.col(text_col)))
    m = F.col("__m")
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    return out.withColumn(
        "__q",
        F.struct(
            *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")],
            _dup_lines(F.col(text_col)).alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).cast("long").alias("n_lines"),
        ),
    ).drop("__m")


def rule_values(q: Column) -> dict[str, Column]:
    """What each rule compares with its cutoff; 0 where it isn't defined."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": ratio(q["n_symbols"], q["word_chars"]),
        "dup_line_ratio": ratio(q["n_dup_lines"], q["n_lines"]),
        "repeat_ratio": ratio(q["n_repeat_words"], q["n_words"]),
        "mean_word_chars": ratio(q["word_chars"], q["n_words"]),
    }


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for n draws: a continued fraction of the incomplete beta function."""
    if k >= n or n == 0:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 1.0 - p
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return min(1.0, max(0.0, 1.0 - front * f if flip else front * f))


def _tails(k: pa.Array, n: pa.Array, p: pa.Array) -> pa.Array:
    return pa.array([binomial_cdf(*x) for x in zip(k.to_pylist(), n.to_pylist(), p.to_pylist())], pa.float64())


def calibrate(
    measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, weight: float = WEIGHT
) -> DataFrame:
    """(stratum, a cutoff for each rule or null) from measured (id, stratum, __q) and labels
    (doc_id, quality). One aggregate counts every rule at every cutoff."""
    truth = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    truth = stage(truth, "truth")  # so that Spark splits an id that many rows share
    held = measured.join(truth, F.col("id") == F.col("doc_id")).where("not __q.base_failed and quality is not null")
    values, good = rule_values(F.col("__q")), F.col("quality") == 1
    counts = held.groupBy("stratum").agg(
        F.count_if(good).alias("n_good"),
        F.count_if(~good).alias("n_bad"),
        *[
            F.array(*[F.struct(F.lit(i).alias("step"), F.lit(c).alias("cut"), F.count_if(good & (values[r] > c)).alias("good"), F.count_if(~good & (values[r] > c)).alias("bad")) for i, c in enumerate(cuts)]).alias(r)
            for r, cuts in GRID.items()
        ],
    )
    counts = stage(counts, "counts")
    level = delta / (max(1, counts.count()) * len(GRID))
    rows = counts.select(
        "stratum", "n_good", "n_bad", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("steps")) for r in GRID])).alias("x")
    ).select("stratum", "n_good", "n_bad", F.col("x.rule").alias("rule"), F.explode("x.steps").alias("s"))
    tail = F.arrow_udf(_tails, "double")(F.col("s.good"), F.col("n_good"), F.lit(risk / len(GRID)))
    gain = F.try_divide("s.bad", "n_bad") - weight * F.try_divide("s.good", "n_good")
    best = (
        rows.withColumn("ok", (F.col("n_good") > 0) & (tail <= level))
        .groupBy("stratum", "rule")
        .agg(
            F.coalesce(F.min(F.when(~F.col("ok"), F.col("s.step"))), F.lit(10**6)).alias("stop"),
            F.collect_list(F.struct(gain.alias("gain"), F.col("s.step").alias("step"), F.col("s.cut").alias("cut"))).alias("all"),
        )
        .withColumn("fit", F.filter("all", lambda x: (x["step"] < F.col("stop")) & (x["gain"] > 0)))
        .withColumn("best", F.array_max(F.transform("fit", lambda x: F.struct(x["gain"], -x["step"], x["cut"].alias("cut")))))
    )
    return stage(
        best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("best.cut"))).alias(r) for r in GRID]), "cutoffs"
    )


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: Column) -> DataFrame:
    """measured with a boolean __kept."""
    c = broadcast_if_small(cutoffs.select(F.col("stratum").alias("__s"), F.struct(*GRID).alias("__cut")), MAX_BROADCAST)
    rejected = F.lit(False)
    for r, v in rule_values(F.col("__q")).items():
        rejected = rejected | F.coalesce(v > F.col("__cut")[r], F.lit(False))
    return (
        measured.join(c, stratum.eqNullSafe(F.col("__s")), "left")
        .withColumn("__kept", ~F.col("__q.base_failed") & ~rejected)
        .drop("__s", "__cut")
    )


def measured_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, __q) of every document, staged: the measures without the texts."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(stratum_col).alias("stratum"))
    return stage(with_measures(narrow).drop("text"), "measured")


def filter_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """The documents that the base rules and the certified cutoffs keep, columns unchanged. The
    cutoffs come from staged measures; texts are measured again where they are judged, which costs
    less than a second copy of the corpus."""
    measured = measured_table(docs, id_col, text_col, stratum_col)
    cutoffs = calibrate(measured, labels)
    drop_stage(measured)
    nested = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), F.col(stratum_col).alias("stratum"))
    return judge(with_measures(nested), cutoffs, F.col("stratum")).where("__kept").select("row.*")
