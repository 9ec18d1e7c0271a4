"""Normalizing raw laps, flagging outliers and filling short sensor gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import known_compound, nan_to_null, normalize_compound, to_boolean, to_integer, to_seconds
from ..functions.windows import ORDER, TRACE, present_keys
from ..schema import DURATION_COLUMNS, INCIDENTS, INTEGER_COLUMNS, RAW_TO_CANONICAL, WEATHER_COLUMNS

MAD_SIGMA = 1.4826


def unreadable_counts(kinds: dict[str, T.DataType], unit: str = "auto") -> dict[str, Column]:
    """For each text column of the contract that has to be read, how many of its cells hold something that
    isn't a duration, a number, or a known compound."""
    said = lambda c: F.trim(F.col(c)).isNotNull() & ~F.lower(F.trim(F.col(c))).isin("", "nan", "nat", "none", "null")
    texts = [c for c, kind in kinds.items() if isinstance(kind, T.StringType)]
    counts = {c: said(c) & to_seconds(F.col(c), kinds[c], unit).isNull() for c in DURATION_COLUMNS if c in texts}
    counts |= {c: said(c) & F.col(c).try_cast("double").isNull() for c in (*INTEGER_COLUMNS, *WEATHER_COLUMNS) if c in texts}
    if "tyre_compound" in texts:
        counts["tyre_compound"] = ~known_compound(F.col("tyre_compound"))
    return {c: F.count_if(odd) for c, odd in counts.items()}


def normalize_laps(
    raw: DataFrame, session_key: str | None = None, unit: str = "auto", outliers: bool = True, observation: Observation | None = None
) -> DataFrame:
    """Raw laps in the canonical contract. Columns that are absent stay absent; nothing missing
    is made up. ValueError if there is no session key. observation: gets the counts of unreadable_counts
    from whatever job runs over the laps first."""
    df = raw.withColumnsRenamed(RAW_TO_CANONICAL)
    if "session_key" not in df.columns:
        if session_key is None:
            raise ValueError("session_key is needed: the frame has no such column")
        df = df.withColumn("session_key", F.lit(session_key))
    kinds = {f.name: f.dataType for f in df.schema}
    if observation is not None:
        counts = unreadable_counts(kinds, unit)
        df = df.observe(observation, F.count(F.lit(1)).alias("rows"), *[n.alias(c) for c, n in counts.items()])
    new: dict[str, Column] = {c: to_seconds(F.col(c), kinds[c], unit) for c in DURATION_COLUMNS if c in kinds}
    new |= {c: to_integer(F.col(c)) for c in INTEGER_COLUMNS if c in kinds}
    if "tyre_compound" in kinds:
        new |= {"tyre_compound_raw": F.col("tyre_compound"), "tyre_compound": normalize_compound(F.col("tyre_compound"))}
    if "driver_code" in kinds:
        new["driver_code"] = F.substring(F.upper(F.trim(F.col("driver_code").cast("string"))), 1, 3)
    if "team_name" in kinds:
        new["team_name"] = F.trim(F.col("team_name").cast("string"))
    if "rainfall" in kinds:
        new["rainfall"] = F.coalesce(to_boolean(F.col("rainfall"), kinds["rainfall"]), F.lit(False))
    for c in WEATHER_COLUMNS:
        if c in kinds and isinstance(kinds[c], (T.DoubleType, T.FloatType, T.StringType)):
            new[c] = nan_to_null(F.col(c).try_cast("double"))
    for c, digit in INCIDENTS.items():
        told = [to_boolean(F.col(c), kinds[c])] if c in kinds else []
        if "track_status" in kinds:
            told.append(F.contains(F.col("track_status").cast("string"), F.lit(digit)))
        if told:
            new[c] = F.coalesce(*told, F.lit(False))
    df = df.withColumns(new)
    pit = [F.col(c).isNotNull() for c in ("pit_in_time", "pit_out_time") if c in kinds]
    if pit:
        is_pit = pit[0] | pit[-1]
    else:
        is_pit = F.coalesce(to_boolean(F.col("is_pit_lap"), kinds["is_pit_lap"]), F.lit(False)) if "is_pit_lap" in kinds else F.lit(False)
    df = df.withColumn("is_pit_lap", is_pit)
    if outliers and "lap_time_seconds" in kinds:
        df = flag_outliers(df, "lap_time_seconds", name="lap_time_outlier")
    return df


def exclude_unmodelled_laps(laps: DataFrame) -> DataFrame:
    """Without pit laps, laps under any flag, the first three laps and rain; opt-in."""
    keep = ~F.col("is_pit_lap") & (F.col("lap_number") > 3)
    if "track_status" in laps.columns:
        keep = keep & (F.col("track_status").cast("string") == "1")
    if "rainfall" in laps.columns:
        keep = keep & ~F.col("rainfall")
    return laps.where(keep)


def with_mad(df: DataFrame, column: str, keys: Sequence[str] = TRACE) -> DataFrame:
    """df with __n, __median and __mad of the group."""
    w = W.partitionBy(*[k for k in keys if k in df.columns])
    df = df.withColumns({"__n": F.count(column).over(w), "__median": F.median(column).over(w)})
    return df.withColumn("__mad", F.median(F.abs(F.col(column) - F.col("__median"))).over(w))


def flag_outliers(
    df: DataFrame, column: str, keys: Sequence[str] = TRACE, n_sigma: float = 3.0, min_size: int = 5, name: str | None = None
) -> DataFrame:
    """df with a boolean column: over n_sigma robust deviations from its group's median. Groups
    with under min_size values or without spread flag nothing; nulls are False."""
    name = name or f"{column}_outlier"
    if column not in df.columns:
        return df.withColumn(name, F.lit(False))
    far = F.abs(F.col(column) - F.col("__median")) / (F.col("__mad") * MAD_SIGMA) > n_sigma
    flag = (F.col("__n") >= min_size) & (F.col("__mad") > 0) & far
    return with_mad(df, column, keys).withColumn(name, F.coalesce(flag, F.lit(False))).drop("__n", "__median", "__mad")


def _runs(df: DataFrame, column: str, keys: list[str], order: Sequence[str]) -> DataFrame:
    """df with __seen (values of the column so far in the group: the number of its gap) and
    __missing (length of the gap that the row belongs to)."""
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("__seen", F.count(column).over(upto))
    gap = W.partitionBy(*keys, "__seen")
    return df.withColumn("__missing", F.count_if(F.col(column).isNull()).over(gap))


def _with_interval(df: DataFrame, keys: list[str], order: Sequence[str], time_col: str | None, interval: float | None) -> DataFrame:
    if interval is not None:
        return df.withColumn("__interval", F.lit(float(interval)))
    if time_col is None or time_col not in df.columns:
        return df.withColumn("__interval", F.lit(None).cast("double"))
    step = F.col(time_col) - F.lag(time_col).over(W.partitionBy(*keys).orderBy(*order))
    df = df.withColumn("__step", step).withColumn("__step", F.when(F.col("__step") > 0, F.col("__step")))
    return df.withColumn("__interval", F.median("__step").over(W.partitionBy(*keys))).drop("__step")


def impute_gaps(
    df: DataFrame,
    columns: Sequence[str],
    time_col: str | None = None,
    sample_interval_seconds: float | None = None,
    max_gap_seconds: float = 1.0,
    keys: Sequence[str] = TRACE,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Short gaps carry the last value on; long ones, those at a trace's start and those of
    unknown length are sensor failures. A gap is filled whole or not at all. Adds
    <c>_imputed and <c>_sensor_failure; columns that df lacks are skipped."""
    if max_gap_seconds < 0:
        raise ValueError("max_gap_seconds must not be negative")
    by, order = present_keys(df, keys), present_keys(df, order)
    df = _with_interval(df, by, order, time_col, sample_interval_seconds)
    upto = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    for c in [c for c in columns if c in df.columns]:
        missing = F.col(c).isNull()
        fits = (F.col("__seen") > 0) & (F.col("__missing") * F.col("__interval") <= max_gap_seconds)
        filled = missing & F.coalesce(fits, F.lit(False))
        df = _runs(df, c, by, order).withColumns(
            {
                f"{c}_imputed": filled,
                f"{c}_sensor_failure": missing & ~filled,
                c: F.when(filled, F.last(c, ignorenulls=True).over(upto)).otherwise(F.col(c)),
            }
        ).drop("__seen", "__missing")
    return df.drop("__interval")


def gap_events(
    df: DataFrame,
    columns: Sequence[str],
    time_col: str | None = None,
    sample_interval_seconds: float | None = None,
    max_gap_seconds: float = 1.0,
    keys: Sequence[str] = TRACE,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """One row for each gap of impute_gaps: keys, column, first_lap, n_samples,
    duration_seconds, action, reason."""
    by, order = present_keys(df, keys), present_keys(df, order)
    df = _with_interval(df, by, order, time_col, sample_interval_seconds)
    parts = []
    for c in [c for c in columns if c in df.columns]:
        gaps = _runs(df, c, by, order).where(F.col(c).isNull()).groupBy(*by, "__seen").agg(
            F.min(order[0]).alias("first_lap"), F.count("*").alias("n_samples"), F.first("__interval").alias("i")
        )
        duration = F.col("n_samples") * F.col("i")
        start, unknown, short = F.col("__seen") == 0, duration.isNull(), duration <= max_gap_seconds
        told = F.format_string("gap of %.3fs ", duration)
        parts.append(
            gaps.select(
                *by,
                F.lit(c).alias("column"),
                "first_lap",
                "n_samples",
                duration.alias("duration_seconds"),
                F.when(start | unknown, "sensor_failure").when(short, "forward_filled").otherwise("sensor_failure").alias("action"),
                F.when(start, "gap at start of trace")
                .when(unknown, "gap of unknown length")
                .when(short, F.concat(told, F.lit(f"within {max_gap_seconds}s")))
                .otherwise(F.concat(told, F.lit(f"over {max_gap_seconds}s")))
                .alias("reason"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, percent not null), from one aggregate; 100 for an empty frame."""
    wide = df.agg(*[F.coalesce(F.avg(F.col(c).isNotNull().cast("double")) * 100, F.lit(100.0)).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("percent")) for c in columns])).alias("x")).select("x.*")


def imputation_report(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, percent_before, percent_after): completeness around impute_gaps."""
    have = [c for c in columns if c in before.columns]
    was = completeness(before, have).withColumnRenamed("percent", "percent_before")
    return was.join(completeness(after, have).withColumnRenamed("percent", "percent_after"), "column")
