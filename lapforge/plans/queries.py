"""Registered queries of the lap operators, over laps derived from events and over the order tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import action_label, to_seconds
from ..operators import asof, cleaning, drift, evaluation, metrics, target, validation
from ..sources import laps as sources
from ..sources import races
from ..sources.laps import laps_from_events, race_metadata
from ..staging import drop_stage, shared_dir, stage
from ..streaming import traces
from . import ingest, training

KEYS = ["session_key", "driver_number", "lap_number"]


def _laps(spark: SparkSession, sf_dir: str, nulls: bool = True) -> DataFrame:
    return laps_from_events(spark, sf_dir, with_nulls=nulls)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | F.Column):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _metric(key: str, version: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = metrics.with_metric(_laps(spark, sf_dir), key, version)
        c = F.col(f"`{key}@{version}`")
        return out.select(*KEYS, (c if (key, version) == ("tyre_age", "v2") else F.round(c, 6)).alias("value"))

    return run


def metrics_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    _laps(spark, sf_dir).createOrReplaceTempView("lapforge_laps")
    spark.sql(metrics.metrics_view_sql("lapforge_metrics", "lapforge_laps"))
    numbers = [k for k in metrics.REGISTRY.keys() if k != "tyre_age"]
    return spark.table("lapforge_metrics").select(*KEYS, "stint_number", "tyre_age", *[r6(k).alias(k) for k in numbers])


def metrics_as_of_2023(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.with_all_metrics(_laps(spark, sf_dir), date(2023, 6, 1))
    return out.select(*KEYS, *[r6(k).alias(k) for k in ("degradation_rate", "gap_to_leader", "pit_delta", "tyre_age")])


def metrics_without_stint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the stint where no lap has a stint number: stints derived from pit laps."""
    laps = _laps(spark, sf_dir).withColumn("stint_number", F.lit(None).cast("long"))
    return metrics.with_all_metrics(laps).select(*KEYS, "tyre_age", "stint_age_squared", r6("degradation_rate").alias("degradation_rate"))


def registry_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions live on the days of the events: an as-of join with the registry."""
    registry = metrics.REGISTRY.table(spark).select("key", "version", "since", "until")
    days = _table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n_events"))
    days = days.withColumn("key", F.explode(F.array(*map(F.lit, metrics.REGISTRY.keys()))))
    live = asof.as_of_join(days, registry, "day", ["key"]).where("version is not null")
    return live.groupBy("key", "version").agg(F.count("*").alias("n_days"), F.sum("n_events").alias("n_events"))


def combined_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's metrics over registered ones, and over each other."""
    registry = metrics.MetricRegistry(metrics.REGISTRY.rows)
    own = {"unit": "seconds", "owner": "analyst", "definition": "pace against own and against the field", "until": None, "since": date(2024, 1, 1), "version": "v1"}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    registry.register(metrics.MetricVersion("pace_balance", title="Balance", uses=("pace_delta", "relative_pace_delta"), column=lambda m: zero(m["pace_delta"]) - zero(m["relative_pace_delta"]), **own))
    registry.register(metrics.MetricVersion("balance_by_age", title="Balance by age", uses=("pace_balance@v1", "tyre_age"), column=lambda m: m["pace_balance@v1"] / (m["tyre_age"] + 1), **own))
    out = metrics.with_all_metrics(_laps(spark, sf_dir), registry=registry)
    return out.select(*KEYS, r6("pace_balance").alias("pace_balance"), r6("balance_by_age").alias("balance_by_age"))


def derive_stint(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = metrics.derive_stint(_laps(spark, sf_dir)).withColumnRenamed("derived_stint", "by_pit_lap")
    return metrics.derive_stint_by_in_lap(laps).select(*KEYS, "by_pit_lap", F.col("derived_stint").alias("by_in_lap"))


def race_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return race_metadata(_laps(spark, sf_dir))


def compound_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = _laps(spark, sf_dir)
    return laps.groupBy("tyre_compound_raw", "tyre_compound").agg(F.count("*").alias("n"))


def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as clock strings, plain numbers, milliseconds and junk, parsed back."""
    v = F.col("value")
    clock = F.concat(F.floor(v / 60).cast("string"), F.lit(":"), F.lpad(F.floor(v % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    kind = F.col("event_id") % 5
    ms = F.when(kind == 0, clock).when(kind == 1, F.col("event_id").cast("string")).when(kind == 2, F.concat(F.lit("1:"), clock)).when(kind == 3, "not-a-time").otherwise(None)
    rows = _table(spark, sf_dir, "events").select("event_id", ms.alias("raw"))
    text = rows.schema["raw"].dataType
    return rows.select("event_id", r6(to_seconds(F.col("raw"), text)).alias("seconds"), r6(to_seconds(F.col("raw"), text, "ms")).alias("seconds_from_ms"))


def normalize_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _laps(spark, sf_dir).select(
        "session_key",
        F.col("driver_number").cast("string").alias("DriverNumber"),
        F.concat(F.lit(" d"), F.col("driver_number").cast("string"), F.lit("x ")).alias("Driver"),
        F.concat(F.lit(" Team "), (F.col("driver_number") % 2).cast("string")).alias("Team"),
        F.col("lap_number").cast("double").alias("LapNumber"),
        F.col("lap_time_seconds").alias("LapTime"),
        F.col("tyre_compound_raw").alias("Compound"),
        F.when(F.col("tyre_compound_raw") != "HYPERSOFT", F.dayofmonth("ts") == 3).alias("rainfall"),
        F.col("pit_in_time").alias("PitInTime"),
        F.col("pit_out_time").alias("PitOutTime"),
    )
    out = cleaning.normalize_laps(raw)
    return out.select(*KEYS, "driver_code", "team_name", "tyre_compound", "rainfall", "is_pit_lap", "lap_time_outlier", r6("lap_time_seconds").alias("lap_time_seconds"))


def exclude_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events are laps under a flag; it rains on the third of each month."""
    status = F.when(F.col("tyre_compound_raw") == "GLITTER", "4").otherwise("1")
    laps = _laps(spark, sf_dir).withColumns({"track_status": status, "rainfall": F.dayofmonth("ts") == 3})
    return cleaning.exclude_unmodelled_laps(laps).select(*KEYS)


def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    flagged = cleaning.flag_outliers(lines, "l_extendedprice", ["l_suppkey"], n_sigma=2.0, name="outlier")
    return flagged.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if("outlier").alias("n_outliers"))


_GAPS = {"columns": ["lap_time_seconds"], "time_col": "pit_clock", "max_gap_seconds": 100_000.0}


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    laps = _laps(spark, sf_dir).withColumn("pit_clock", clock)
    return laps.withColumn("lap_time_seconds", F.when(F.col("event_id") % 7 > 1, F.col("lap_time_seconds")))


def impute_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaning.impute_gaps(_gappy(spark, sf_dir), **_GAPS)
    return out.select(*KEYS, "lap_time_seconds", "lap_time_seconds_imputed", "lap_time_seconds_sensor_failure")


def impute_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaning.gap_events(_gappy(spark, sf_dir), **_GAPS)
    return out.select("session_key", "driver_number", "column", "first_lap", "n_samples", r6("duration_seconds").alias("duration_seconds"), "action", F.regexp_replace("reason", "[0-9.]+s", "").alias("reason"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaning.completeness(_laps(spark, sf_dir), ["lap_time_seconds", "pit_in_time", "pit_out_time", "position"])
    return out.select("column", r6("percent").alias("percent"))


def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validation.null_rates(_laps(spark, sf_dir), ["lap_time_seconds", "tyre_compound", "tyre_compound_raw", "pit_in_time"])
    return out.select("column", r6("null_rate").alias("null_rate"))


def driver_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.driver_coverage(_laps(spark, sf_dir))


def lap_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lap from an event divisible by 11 on is numbered one higher: a hole before each of them."""
    w = W.partitionBy("driver_number").orderBy("lap_number").rowsBetween(W.unboundedPreceding, W.currentRow)
    moved = F.sum((F.col("event_id") % 11 == 0).cast("long")).over(w)
    return validation.lap_gaps(_laps(spark, sf_dir).withColumn("lap_number", F.col("lap_number") + moved))


def _with_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_all_metrics(_laps(spark, sf_dir))


def monotonic_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.monotonic_gap(metrics.with_metric(_laps(spark, sf_dir), "gap_to_leader", "v1"), "`gap_to_leader@v1`")


def stint_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = _with_current(spark, sf_dir)
    return validation.stint_resets(laps.withColumn("tyre_age", F.when(F.col("event_id") % 3 == 0, F.col("tyre_age") + 1).otherwise(F.col("tyre_age"))))


def dup_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = _laps(spark, sf_dir).select(*KEYS, "event_id")
    return validation.repeated_laps(laps.union(laps.where("event_id % 17 = 0")).select(*KEYS))


def dup_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = _laps(spark, sf_dir)
    return validation.repeated_positions(laps.withColumn("position", F.when(F.col("event_id") % 10 == 0, 1).otherwise(F.col("position"))))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.bounds(_with_current(spark, sf_dir), validation.ValidationConfig().bounds)


def sigma_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.sigma_counts(_laps(spark, sf_dir), n_sigma=1.5)


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report, one row a result."""
    laps = _with_current(spark, sf_dir).withColumn("tyre_life", F.col("tyre_age"))
    # a tenth of the laps moved up by one: repeated numbers, and holes where they were
    laps = laps.withColumn("lap_number", F.when(F.col("event_id") % 10 == 0, F.col("lap_number") + 1).otherwise(F.col("lap_number")))
    out = validation.check_results(laps.withColumn("row_id", F.col("event_id")), validation.ValidationConfig(expected_drivers=10_000))
    return out.select("category", "name", "severity", "n_affected", "session_key")


def circuit_loss_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = metrics.fit_circuit_loss(_with_current(spark, sf_dir))
    return losses.select("circuit_name", r6("circuit_loss").alias("circuit_loss"))


def circuit_loss_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = _with_current(spark, sf_dir)
    losses = metrics.fit_circuit_loss(laps.where("circuit_name <> 'C3'"))
    return metrics.apply_circuit_loss(laps, losses).select(*KEYS, r6("circuit_loss").alias("circuit_loss"))


def pit_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = target.with_compat_target(target.with_target(_laps(spark, sf_dir)))
    return laps.select(*KEYS, "pit_next_5_laps", "pit_next_5_laps_compat")


def star_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact and dimensions with a filter on the far dimension, aggregated."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = _table(spark, sf_dir, "nation").where(F.col("n_name").isNotNull() & F.col("n_regionkey").isin(1, 2, 3))
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    years = joined.groupBy("n_name", F.year("o_orderdate").cast("long").alias("year"))
    return years.agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps with the forward label and the probability of a fixed logistic of three metrics."""
    laps = target.with_target(_with_current(spark, sf_dir))
    z = -1.0 + 0.15 * F.col("tyre_age") + 0.5 * F.col("race_progress") + 0.001 * F.coalesce("pace_delta", F.lit(0.0))
    # rounded, so that equal inputs tie alike on any engine
    return laps.select(*KEYS, "circuit_name", "year", F.col("pit_next_5_laps").alias("y"), F.round(1 / (1 + F.exp(-z)), 6).alias("p"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.threshold_sweep(_scored(spark, sf_dir), [round(0.1 + 0.05 * i, 2) for i in range(17)])
    return out.select("threshold", "tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.best_threshold(evaluation.threshold_sweep(_scored(spark, sf_dir), training.GRID))
    return out.select("threshold", r6("f1").alias("f1"))


def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.group_metrics(_scored(spark, sf_dir), "circuit_name", 0.55)
    return out.select("circuit_name", "n", *[r6(c).alias(c) for c in ("roc_auc", "precision", "recall", "f1")])


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_auc(_scored(spark, sf_dir)).select(r6("roc_auc").alias("roc_auc"))


def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.brier(_scored(spark, sf_dir)).select(r6("brier").alias("brier"))


def brier_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.brier_by_group(_scored(spark, sf_dir), "driver_number").select("driver_number", "n", r6("brier").alias("brier"))


def _reliability(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = evaluation.reliability(_scored(spark, sf_dir), 10, strategy)
        return out.select("bin", "n", r6("mean_predicted").alias("mean_predicted"), r6("observed_rate").alias("observed_rate"))

    return run


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.when(F.col("year") == 2018, True).when(F.col("year") == 2024, False)
    out = drift.drift_within(_with_current(spark, sf_dir), since, ["lap_time_seconds", "tyre_age", "race_progress", "no_such_column"])
    return out.select("feature", F.round("psi", 5).alias("psi"), "severity")


def psi_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drift.drift_within(_table(spark, sf_dir, "orders"), F.month("o_orderdate") <= 6, ["o_totalprice"])
    return out.select("feature", F.round("psi", 5).alias("psi"), "severity")


def action_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return scored.groupBy(action_label(F.col("p"), 0.6).alias("action")).agg(F.count("*").alias("n"))


def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = training.training_frame(_laps(spark, sf_dir))
    train, _ = training.temporal_split(frame)
    rows = [(c, m, s) for c, (m, s) in training.fit_scaler(train).items()]
    return spark.createDataFrame(rows, "feature string, mean double, deviation double").select("feature", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))


def train_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, scale, fit, score the held-out laps; a row for each of them."""
    model, _, _, test = training.fit_on_years(_laps(spark, sf_dir), training.candidate_models()["logistic_regression"])
    return training.score(model, test).select(*KEYS, "y", "p")


def base_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    laps = target.with_target(_laps(spark, sf_dir)).withColumn("y", F.col("pit_next_5_laps"))
    out = training.base_rates(*training.temporal_split(laps))
    return out.select("part", "n", r6("base_rate").alias("base_rate"))


def race_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps with the columns of their race, of the years asked for, from the loader of training."""
    laps = _laps(spark, sf_dir)
    told = race_metadata(laps).withColumn("year", F.when(F.col("session_key") < "S3", 2018).otherwise(2024))
    loaded = sources.load_star(laps.drop("circuit_name", "year"), told, [2018], on="session_key")
    return loaded.groupBy("session_key", "year", "circuit_name").agg(F.count("*").alias("n_laps"), F.max("num_drivers").alias("num_drivers"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lapforge-{uuid.uuid4().hex}"


def race_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The race table after two ingests: a session for each user, of which several may run one race. The second
    ingest brings all sessions, those of the first keep their ids."""
    user = F.col("driver_number")
    race = {"session_key": F.concat(F.lit("U"), user.cast("string")), "year": (2018 + user % 7).cast("int"), "race_name": F.concat(F.lit("R"), (user % 40).cast("string"))}
    candidates = races.race_candidates(_laps(spark, sf_dir).drop("circuit_name").withColumns(race))
    path = _folder(spark)
    races.append_races(candidates.where(F.substring("session_key", 2, 20).cast("long") % 2 == 0), path)
    table = races.append_races(candidates, path)
    return table.select("race_id", "session_key", "year", "race_name", "num_drivers", "num_laps")


def stored_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps written by session with their race_id, read back with the races of one year."""
    laps = _laps(spark, sf_dir).drop("circuit_name")
    laps = laps.withColumns({"year": F.when(F.col("session_key") < "S3", 2018).otherwise(2024), "race_name": F.concat(F.lit("R"), F.col("session_key"))})
    root = _folder(spark)
    candidates = races.race_candidates(laps)
    table = races.append_races(candidates, ingest.races_path(root))
    sources.write_laps(races.with_race_ids(laps, candidates, table), ingest.laps_path(root))
    star = ingest.stored_star(spark, root, [2018])
    return star.groupBy("race_id", "session_key", "race_name", "year").agg(F.count("*").alias("n_laps"), F.round(F.sum("lap_time_seconds"), 3).alias("total"))


def normalize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What normalizing couldn't read, counted by the job that writes the laps."""
    i = F.col("event_id")
    time = F.when(i % 5 == 0, "not-a-time").when(i % 5 == 1, " ").when(i % 5 == 2, F.lit(None)).when(i % 5 == 3, "1:32.5").otherwise(F.col("lap_time_seconds").cast("string"))
    raw = _laps(spark, sf_dir, nulls=False).select(
        "session_key", F.col("driver_number").alias("DriverNumber"), F.when(i % 7 == 0, "x").otherwise(F.col("lap_number").cast("string")).alias("LapNumber"),
        time.alias("LapTime"), F.when(i % 9 == 0, "hot").otherwise("28.5").alias("AirTemp"), F.col("tyre_compound_raw").alias("Compound"),
    )
    counted = Observation("unreadable")
    drop_stage(stage(cleaning.normalize_laps(raw, observation=counted), "normalized"))
    return spark.createDataFrame([(c, n) for c, n in counted.get.items()], "column string, n long")


def stream_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own-trace metrics from a stream that brings the laps in three micro-batches, with state between them."""
    root = _folder(spark)
    laps = stage(_laps(spark, sf_dir).select(*KEYS, F.col("event_id").alias("row_id"), *traces.INPUT[2:]), "laps")
    cuts = [0, 20, 45, 2**31]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        laps.where((F.col("lap_number") > lo) & (F.col("lap_number") <= hi)).write.mode("append").parquet(f"{root}/laps")
        stream = traces.trace_metrics(spark.readStream.schema(laps.schema).parquet(f"{root}/laps"))
        sink = stream.writeStream.format("parquet").option("path", f"{root}/metrics").option("checkpointLocation", f"{root}/state")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    drop_stage(laps)
    out = spark.read.parquet(f"{root}/metrics")
    return out.select(*KEYS, "late", *[r6(f"`{m}`").alias(m.replace("@", "_")) for m in traces.METRICS])


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the folds of each label."""
    folded = training.with_folds(_scored(spark, sf_dir).select(*KEYS, "y"), 5)
    return folded.groupBy("y", F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


def policy_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.policy_sweep(_scored(spark, sf_dir))
    return out.select("threshold", "style", "tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "flagged_share")])


def race_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.race_state(_scored(spark, sf_dir), 0.6)


def model_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.review(_scored(spark, sf_dir), 0.55).select("measure", r6("value").alias("value"))


def nearest_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.nearest_threshold(evaluation.threshold_sweep(_scored(spark, sf_dir), training.GRID), 0.3333)
    return out.select("threshold", "tp", "fp", "fn")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f"{d.key}_{d.version}": _metric(d.key, d.version) for d in metrics.REGISTRY.rows
} | {
    f.__name__: f
    for f in (
        metrics_view, metrics_as_of_2023, metrics_without_stint, registry_as_of, derive_stint, race_dimension, compound_norm, duration_parse,
        normalize_raw, exclude_laps, mad_outliers, impute_gaps, impute_events, completeness, null_rates, driver_coverage,
        lap_gaps, monotonic_gap, stint_reset, dup_laps, dup_positions, bounds, sigma_count, validation_report,
        circuit_loss_fit, circuit_loss_apply, pit_targets, star_load, threshold_sweep, best_threshold, group_metrics,
        roc_auc, brier, brier_by_group, drift_report, psi_orders, action_labels, scaler_fit, train_logistic,
        base_rates, race_star, nearest_threshold, combined_metrics, race_merge, stored_star, normalize_counts,
        stratified_folds, policy_sweep, race_state, model_review, stream_traces,
    )
} | {"reliability_quantile": _reliability("quantile"), "reliability_uniform": _reliability("uniform")}
