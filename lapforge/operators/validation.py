"""Checks of a lap frame.

check_results is the report as a DataFrame, one row a result, from two plans: one aggregate over
all laps (null rates, bounds, trace checks, sigma) and one by session (drivers, holes). Counts come
from running differences of the ordered trace, so the checks share its windows.
validate_laps collects the rows into a report. Each check is also a function of its own.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import FIELD, TRACE, ordered
from ..staging import drop_since, settled, staged_so_far
from .cleaning import MAD_SIGMA, with_mad

PASS, WARNING, ERROR = "PASS", "WARNING", "ERROR"


@dataclass(frozen=True)
class ValidationConfig:
    # Required columns and limits.
    required_columns: tuple[str, ...] = (
        "session_key", "driver_number", "lap_number", "lap_time_seconds", "tyre_compound", "tyre_life",
    )
    max_null_rate: Mapping[str, float] = field(
        default_factory=lambda: {"lap_time_seconds": 0.05, "tyre_compound": 0.05, "tyre_life": 0.05, "position": 0.05}
    )
    default_max_null_rate: float = 0.10
    #: Columns of this ending hold untouched input and may be empty.
    exempt_suffix: str = "_raw"
    expected_drivers: int | None = None
    min_drivers: int = 2
    bounds: Mapping[str, tuple[float, float]] = field(
        default_factory=lambda: {"lap_time_seconds": (55.0, 150.0), "degradation_rate": (-0.5, 0.5), "pit_delta": (1.5, 90.0)}
    )
    n_sigma: float = 2.0
    min_group_size: int = 5


@dataclass(frozen=True)
class CheckResult:
    """session_key is set for results of one session; n_affected counts rows (or gaps, or drivers)."""

    category: str
    name: str
    severity: str
    n_affected: int
    message: str
    session_key: str | None = None
    details: dict = field(default_factory=dict)


@dataclass(frozen=True)
class ValidationReport:
    results: list[CheckResult]

    @property
    def passed(self) -> bool:
        return not any(r.severity == ERROR for r in self.results)

    def to_dict(self) -> dict:
        return {"passed": self.passed, "results": [asdict(r) for r in self.results]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, sort_keys=True)

    def failures(self) -> list[CheckResult]:
        return [r for r in self.results if r.severity == ERROR]

    def summary(self) -> str:
        counts = {s: sum(r.severity == s for r in self.results) for s in (PASS, WARNING, ERROR)}
        return f"{'passed' if self.passed else 'failed'}: " + ", ".join(f"{n} {s}" for s, n in counts.items())


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, null_rate) from one aggregate; 0 for an empty frame."""
    wide = df.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in columns])).alias("x")).select("x.*")


def driver_coverage(df: DataFrame) -> DataFrame:
    """(session_key, n_drivers); a null session is a session."""
    return df.groupBy("session_key").agg(F.count_distinct("driver_number").alias("n_drivers"))


def lap_gaps(df: DataFrame) -> DataFrame:
    """(session_key, driver_number, first_missing, last_missing) for each hole in the lap numbers."""
    laps = df.where("lap_number is not null").select(*TRACE, "lap_number").distinct()
    nxt = F.lead("lap_number").over(W.partitionBy(*TRACE).orderBy("lap_number"))
    holes = laps.withColumn("nxt", nxt).where("nxt - lap_number > 1")
    return holes.select(*TRACE, (F.col("lap_number") + 1).alias("first_missing"), (F.col("nxt") - 1).alias("last_missing"))


def _diff(df: DataFrame, column: str):
    return F.col(column) - F.lag(column).over(ordered(df))


def monotonic_gap(df: DataFrame, column: str = "gap_to_leader") -> DataFrame:
    """(n_violations): laps where the running gap falls."""
    return df.withColumn("d", _diff(df, column)).agg(F.count_if(F.col("d") < -1e-6).alias("n_violations"))


def stint_resets(df: DataFrame, age: str = "tyre_age") -> DataFrame:
    """(n_violations): laps that begin a new stint with a tyre age other than 0."""
    return df.withColumn("d", _diff(df, "stint_number")).agg(F.count_if((F.col("d") != 0) & (F.col(age) != 0)).alias("n_violations"))


def repeated_laps(df: DataFrame) -> DataFrame:
    """(n_violations): laps whose number doesn't rise in the ordered trace."""
    return df.withColumn("d", _diff(df, "lap_number")).agg(F.count_if(F.col("d") <= 0).alias("n_violations"))


def repeated_positions(df: DataFrame) -> DataFrame:
    """(n_duplicates): positions that several drivers hold on one lap."""
    per_lap = df.groupBy(*FIELD).agg((F.count("position") - F.count_distinct("position")).alias("d"))
    return per_lap.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n_duplicates"))


def bounds(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(column, n_low, n_high, n_total) from one aggregate over all columns."""
    x = {c: F.col(c).try_cast("double") for c in limits}
    wide = df.agg(
        *[
            F.struct(F.lit(c).alias("column"), F.count_if(x[c] < lo).alias("n_low"), F.count_if(x[c] > hi).alias("n_high"), F.count(x[c]).alias("n_total")).alias(c)
            for c, (lo, hi) in limits.items()
        ]
    )
    return wide.select(F.explode(F.array(*limits)).alias("x")).select("x.*")


def sigma_counts(df: DataFrame, column: str = "lap_time_seconds", n_sigma: float = 2.0, min_size: int = 5) -> DataFrame:
    """(session_key, driver_number, n_outside): laps over n_sigma robust deviations from the
    driver's median; drivers with few laps or no spread are absent."""
    far = F.abs(F.col(column) - F.col("__median")) > n_sigma * MAD_SIGMA * F.col("__mad")
    return with_mad(df, column).where((F.col("__n") >= min_size) & (F.col("__mad") > 0)).groupBy(*TRACE).agg(F.count_if(far).alias("n_outside"))


RESULT = "category string, name string, severity string, n_affected long, message string, session_key string, details string"
COMPLETENESS, CONSISTENCY, REASONABLENESS = "completeness", "consistency", "reasonableness"
SHOWN, KEPT = 5, 20


def _result(category: str, name: str | Column, severity: Column, n: Column, message: Column, session: Column | None = None, details: Column | None = None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit(category).alias("category"), (F.lit(name) if isinstance(name, str) else name).alias("name"), severity.alias("severity"), n.cast("long").alias("n_affected"),
        message.alias("message"), (text if session is None else session).alias("session_key"), (text if details is None else details).alias("details"),
    )


def _whole_frame(df: DataFrame, c: ValidationConfig, complete: bool) -> DataFrame:
    """Results from one aggregate over all laps."""
    kinds = {f.name: f.dataType for f in df.schema}
    trace = all(k in kinds for k in TRACE)
    step: dict[str, Column] = {}
    if trace and "lap_number" in kinds:
        step["lap_number"] = F.col("lap_number") - F.lag("lap_number").over(ordered(df))
        for name in ("gap_to_leader", "stint_number"):
            if name in kinds:
                step[name] = F.col(name) - F.lag(name).over(ordered(df))
    sigma = trace and "lap_time_seconds" in kinds
    wide = df.withColumns({f"__d_{k}": v for k, v in step.items()})
    if sigma:
        wide = with_mad(wide, "lap_time_seconds")
    found: dict[str, Column] = {}
    results: list[Column] = []

    def check(category: str, name: str, key: str, count: Column, bad: str, unless_bad: str | None = PASS) -> None:
        """A result whose severity is bad where count is over 0; no row then if unless_bad is None."""
        found[key] = count
        severity = F.when(F.col(key) > 0, bad).otherwise(unless_bad) if unless_bad else F.when(F.col(key) > 0, bad)
        results.append(_result(category, name, severity, F.col(key), F.concat(F.col(key).cast("string"), F.lit(" rows"))))

    found["__rows"] = F.count("*")
    if complete:
        strict = [x for x in c.max_null_rate if x in kinds]
        skipped = {*strict, *c.required_columns}
        loose = [x for x, t in kinds.items() if x not in skipped and not x.endswith(c.exempt_suffix) and isinstance(t, T.AtomicType)]
        for x in [*strict, *loose]:
            key = f"__null_{x}"
            found[key] = F.count_if(F.col(f"`{x}`").isNull())
            rate = F.coalesce(F.try_divide(F.col(key), F.col("__rows")), F.lit(0.0))
            over = rate > c.max_null_rate.get(x, c.default_max_null_rate)
            severity = F.when(over, ERROR).otherwise(PASS) if x in c.max_null_rate else F.when(over, WARNING)
            results.append(_result(COMPLETENESS, f"null_rate:{x}", severity, F.col(key), F.format_string("%.2f%% null", rate * 100)))
    if "gap_to_leader" in step:
        check(CONSISTENCY, "monotonic_cumulative_gap", "__gap", F.count_if(F.col("__d_gap_to_leader") < -1e-6), ERROR)
    if "stint_number" in step and "tyre_age" in kinds:
        check(CONSISTENCY, "tyre_age_resets_after_pit", "__age", F.count_if((F.col("__d_stint_number") != 0) & (F.col("tyre_age") != 0)), ERROR)
    if "lap_number" in step:
        check(CONSISTENCY, "lap_number_strictly_increasing", "__order", F.count_if(F.col("__d_lap_number") <= 0), ERROR)
    for x, (lo, hi) in c.bounds.items():
        if x in kinds:
            v = F.col(x).try_cast("double")
            check(REASONABLENESS, f"bounds:{x}", f"__bound_{x}", F.count_if((v < lo) | (v > hi)), ERROR)
    if sigma:
        far = F.abs(F.col("lap_time_seconds") - F.col("__median")) > c.n_sigma * MAD_SIGMA * F.col("__mad")
        fit = (F.col("__n") >= c.min_group_size) & (F.col("__mad") > 0)
        check(REASONABLENESS, "lap_time_within_driver_sigma", "__sigma", F.count_if(fit & far), WARNING)
    one = wide.agg(*[v.alias(k) for k, v in found.items()])
    if not results:
        return df.sparkSession.createDataFrame([], RESULT)
    return one.select(F.explode(F.array(*results)).alias("x")).select("x.*").where("severity is not null")


def _positions(df: DataFrame) -> DataFrame:
    per_place = df.where("position is not null").groupBy(*FIELD, "position").agg((F.count("*") - 1).alias("again"))
    n = per_place.agg(F.coalesce(F.sum("again"), F.lit(0)).alias("n"))
    severity = F.when(F.col("n") > 0, WARNING).otherwise(PASS)
    return n.select(_result(CONSISTENCY, "unique_position_per_lap", severity, F.col("n"), F.concat(F.col("n").cast("string"), F.lit(" rows"))).alias("x")).select("x.*")


def _by_session(df: DataFrame, c: ValidationConfig) -> list[DataFrame]:
    """Results of single sessions: too few drivers, holes in the lap numbers."""
    out = []
    count = F.col("n_drivers")
    few = F.when(count < c.min_drivers, ERROR) if c.expected_drivers is None else F.when(count < c.expected_drivers, WARNING).when(count < c.min_drivers, ERROR)
    told = F.concat(count.cast("string"), F.lit(" drivers"))
    coverage = driver_coverage(df).select(_result(COMPLETENESS, "driver_coverage", few, count, told, F.col("session_key")).alias("x"))
    out.append(coverage.select("x.*").where("severity is not null"))
    if "lap_number" in df.columns:
        holes = lap_gaps(df)
        nth = F.row_number().over(W.partitionBy("session_key").orderBy("driver_number", "first_missing"))
        first = holes.withColumn("k", nth).where(F.col("k") <= KEPT)  # Spark keeps no more than these of a session
        hole = F.struct("k", F.array(*[F.col(x).cast("string") for x in ("driver_number", "first_missing", "last_missing")]).alias("g"))
        first = first.groupBy(F.col("session_key").alias("s")).agg(F.sort_array(F.collect_list(hole)).alias("l"))
        n = holes.groupBy("session_key").agg(F.count("*").alias("n"))
        both = n.join(first, F.col("session_key").eqNullSafe(F.col("s"))).withColumn("g", F.col("l.g"))
        told = F.concat(F.col("n").cast("string"), F.lit(" holes, e.g. "), F.to_json(F.slice("g", 1, SHOWN)))
        row = _result(COMPLETENESS, "lap_sequence_gaps", F.lit(WARNING), F.col("n"), told, F.col("session_key"), F.to_json(F.struct(F.col("g").alias("gaps"))))
        out.append(both.select(row.alias("x")).select("x.*"))
    return out


def check_results(df: DataFrame, config: ValidationConfig | None = None) -> DataFrame:
    """All checks whose columns df has, one row a result: category, name, severity, n_affected,
    message, session_key, details (JSON). A frame that has to be computed is staged first."""
    c = config or ValidationConfig()
    df = settled(df, "laps")
    have = set(df.columns)
    missing = [x for x in c.required_columns if x not in have]
    row = (COMPLETENESS, "required_columns", ERROR if missing else PASS, len(missing), f"missing: {', '.join(missing)}" if missing else "all there", None, json.dumps({"missing": missing}))
    parts = [df.sparkSession.createDataFrame([row], RESULT), _whole_frame(df, c, not missing)]
    if not missing:
        parts += _by_session(df, c)
    if have >= {*FIELD, "position"}:
        parts.append(_positions(df))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validate_laps(df: DataFrame, config: ValidationConfig | None = None) -> ValidationReport:
    """The report of check_results: completeness, consistency, reasonableness, in this order. Its rows
    come to the driver: some for each column, and one or two for each session that fails."""
    order, mark = [COMPLETENESS, CONSISTENCY, REASONABLENESS], staged_so_far()
    rows = sorted(check_results(df, config).collect(), key=lambda r: order.index(r["category"]))
    drop_since(df.sparkSession, mark, keep_last=False)
    return ValidationReport([CheckResult(**(r.asDict() | {"details": json.loads(r["details"] or "{}")})) for r in rows])
