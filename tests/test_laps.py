"""Lap operators on small frames with known answers; every SQL query against DuckDB."""

import hashlib
import math
import os
import random
from dataclasses import replace
from datetime import date

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lapforge import cli
from lapforge.functions import order_statistics
from lapforge.functions.scalars import action_label, normalize_compound, to_integer, to_seconds
from lapforge.operators import cleaning, drift, evaluation, metrics, target, validation
from lapforge.plans import queries as lap_queries
from lapforge.plans import snapshot, training
from lapforge.schema import LAPS_SCHEMA
from lapforge.sources import laps as sources

SF = "/root/testdata/sf0.001"


def trace(spark, times, pits=(), driver=1, session="S", stints=None):
    rows = [
        (session, driver, i + 1, (stints or [1] * len(times))[i], t, (i + 1) in pits, None, None)
        for i, t in enumerate(times)
    ]
    schema = "session_key string, driver_number long, lap_number long, stint_number long, lap_time_seconds double, is_pit_lap boolean, pit_in_time double, pit_out_time double"
    return spark.createDataFrame(rows, schema)


def column(df, name):
    return [r[0] for r in df.orderBy("driver_number", "lap_number").select(f"`{name}`").collect()]


# scalars


def test_durations(spark):
    raw = ["1:32.456", "92.5", "not-a-time", None, "45", "1:05:32", " 0:59.5 ", "NaN", "1:02.1234567"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    kind = df.schema["x"].dataType
    got = [r[0] for r in df.orderBy("i").select(to_seconds(F.col("x"), kind)).collect()]
    assert got == [92.456, 92.5, None, None, 45.0, None, 59.5, None, None]
    assert df.where("i = 4").select(to_seconds(F.col("x"), kind, "ms")).first()[0] == 45.0  # the clock form goes first
    number = spark.createDataFrame([(92500.0,), (float("nan"),)], "x double")
    assert [r[0] for r in number.select(to_seconds(F.col("x"), number.schema["x"].dataType, "ms")).collect()] == [92.5, None]
    interval = spark.sql("select interval '1:32.456' minute to second as x")
    assert interval.select(to_seconds(F.col("x"), interval.schema["x"].dataType)).first()[0] == 92.456
    with pytest.raises(ValueError):
        to_seconds(F.col("x"), kind, "fortnights")


def test_compounds(spark):
    pairs = [("HYPERSOFT", "SOFT"), ("supersoft", "SOFT"), (" Medium ", "MEDIUM"), ("intermediate", "INTERMEDIATE"), ("wet", "WET"), (None, "UNKNOWN"), ("GLITTER", "UNKNOWN"), ("", "UNKNOWN")]
    df = spark.createDataFrame(pairs, "raw string, want string")
    assert df.where(normalize_compound(F.col("raw")) != F.col("want")).count() == 0


def test_action_bands(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.6,)], "p double")
    assert [r[0] for r in df.select(action_label(F.col("p"), 0.6)).collect()] == ["Unlikely near-term", "Monitor", "Investigate pit window"]


# metrics


def test_running_gap_carries_over_missing_laps(spark):
    df = trace(spark, [90.0, 91.0, None, 93.0]).union(trace(spark, [89.0, 92.0, 90.0, 90.0], driver=2))
    assert column(metrics.with_metric(df, "gap_to_leader"), "gap_to_leader@v2") == [1.0, 1.0, 1.0, 4.0, 0.0, 1.0, 1.0, 1.0]
    assert column(metrics.with_metric(df, "gap_to_leader", null_on_null=True), "gap_to_leader@v2")[2] is None


def test_metrics_with_known_values(spark):
    df = metrics.with_all_metrics(trace(spark, [90.0, 90.1, 90.2, 90.3, 91.0], stints=[1, 1, 1, 1, 2]))
    assert column(df, "tyre_age") == [0, 1, 2, 3, 0]
    assert [round(x, 9) for x in column(df, "degradation_rate")] == [0.1] * 4 + [0.0]
    assert column(df, "stint_age_squared") == [0, 1, 4, 9, 0] and column(df, "race_progress") == [0.2, 0.4, 0.6, 0.8, 1.0]
    steep = metrics.with_metric(trace(spark, [90.0, 95.0]), "degradation_rate")
    assert column(steep, "degradation_rate@v2") == [0.5, 0.5]
    closing = trace(spark, [90.0] * 5).union(trace(spark, [94.0, 93.0, 92.0, 91.0, 90.0], driver=2))
    assert column(metrics.with_metric(closing, "gap_closing_rate"), "gap_closing_rate@v1")[-1] == 1.0
    field = trace(spark, [89.0]).union(trace(spark, [90.0], driver=2)).union(trace(spark, [91.0], driver=3))
    assert column(metrics.with_metric(field, "relative_pace_delta"), "relative_pace_delta@v1") == [-1.0, 0.0, 1.0]


def test_pit_delta_needs_both_times(spark):
    df = trace(spark, [90.0, 120.0, 110.0, 90.0]).withColumns(
        {"pit_in_time": F.when(F.col("lap_number") == 2, 600.0), "pit_out_time": F.when(F.col("lap_number").isin(3, 4), 622.0)}
    )
    assert column(metrics.with_metric(df, "pit_delta"), "pit_delta@v2") == [None, None, 22.0, None]


def test_derived_stints(spark):
    df = trace(spark, [90.0] * 6, pits=(3, 4)).withColumn("pit_in_time", F.when(F.col("lap_number") == 3, 1.0))
    assert column(metrics.derive_stint(df), "derived_stint") == [0, 0, 0, 1, 2, 2]
    assert column(metrics.derive_stint_by_in_lap(df), "derived_stint") == [0, 0, 0, 1, 1, 1]


def test_metrics_without_stints_derive_them(spark):
    df = trace(spark, [90.0 + i for i in range(8)], pits=(4,))
    for bare in (df.drop("stint_number"), df.withColumn("stint_number", F.lit(None).cast("long"))):
        assert column(metrics.with_metric(bare, "tyre_age"), "tyre_age@v2") == [0, 1, 2, 3, 0, 1, 2, 3]
    some = df.withColumn("stint_number", F.lit(None).cast("long")).union(trace(spark, [90.0] * 3, driver=2, stints=[1, 1, 2]))
    assert column(metrics.with_metric(some, "tyre_age"), "tyre_age@v2") == [0, 1, 2, 3, 0, 1, 2, 3, 0, 1, 0]
    with pytest.raises(KeyError):
        metrics.with_metric(df.drop("stint_number", "is_pit_lap"), "tyre_age")
    assert metrics.with_metric(df.drop("stint_number", "is_pit_lap"), "pace_delta").count() == 8


def test_integers_with_a_fraction_fail(spark):
    df = spark.createDataFrame([("3",), ("4.0",), ("x",), (None,), ("NaN",)], "x string")
    assert [r[0] for r in df.select(to_integer(F.col("x"))).collect()] == [3, 4, None, None, None]
    with pytest.raises(Exception, match="not a whole number"):
        spark.createDataFrame([("3.7",)], "x string").select(to_integer(F.col("x"))).collect()


def test_registry():
    registry = metrics.REGISTRY
    assert len(registry.rows) == 13 and len(registry.current()) == 9
    assert {d.version for d in registry.as_of(date(2023, 6, 1)).values()} == {"v1"} and not registry.as_of(date(2020, 1, 1))
    assert registry.versions("tyre_age") == ["v1", "v2"] and registry.get("tyre_age").qualified_name == "tyre_age@v2"
    with pytest.raises(KeyError):
        registry.get("nothing")
    with pytest.raises(ValueError):
        metrics.MetricRegistry([registry.get("tyre_age"), registry.get("tyre_age")])
    with pytest.raises(LookupError):
        metrics.MetricRegistry([registry.get("tyre_age", "v1")]).get("tyre_age")
    changed = metrics.MetricRegistry([replace(registry.get("tyre_age"), definition="other")])
    assert changed.fingerprint != metrics.MetricRegistry([registry.get("tyre_age")]).fingerprint and len(registry.fingerprint) == 12
    assert registry.get("tyre_age").fingerprint == hashlib.sha256(b"tyre_age|v2|laps|Laps of the stint before this one.|laps_on_tyre").hexdigest()[:12]
    assert registry.get("pit_delta").supersedes == "v1" and registry.get("pit_delta").rationale
    assert registry.to_dict()["tyre_age"][1]["is_current"] and registry.to_dict()["tyre_age"][0]["until"] == "2024-01-01"
    with pytest.raises(KeyError):
        registry.get("tyre_age", "v9")
    with pytest.raises(LookupError):
        metrics.MetricRegistry([registry.get("tyre_age", "v1"), replace(registry.get("tyre_age"), since=date(2023, 6, 1))]).as_of(date(2023, 7, 1))
    assert metrics.metrics_view_sql() == metrics.metrics_view_sql() and "gap_to_leader@v2" in registry.to_markdown()
    with pytest.raises(NotImplementedError):
        metrics.opponent_signal()


def test_partial_keys_and_row_order(spark):
    df = trace(spark, [90.0, 91.0, 92.0]).drop("driver_number")
    assert metrics.with_metric(df, "pace_delta").count() == 3
    with pytest.raises(KeyError):
        metrics.with_metric(df.drop("session_key"), "pace_delta")
    twice = trace(spark, [90.0, 91.0, 92.0]).withColumn("lap_number", F.lit(1)).withColumn("row_id", (F.col("lap_time_seconds") * 10).cast("long"))
    got = metrics.with_metric(twice, "tyre_age").orderBy("row_id").select("`tyre_age@v2`").collect()
    assert [r[0] for r in got] == [0, 1, 2]


def test_results_do_not_depend_on_row_order_or_partitions(spark):
    df = sources.laps_from_events(spark, SF, with_nulls=True)
    a = metrics.with_all_metrics(df).select(*lap_queries.KEYS, "gap_to_leader", "degradation_rate").orderBy(*lap_queries.KEYS).collect()
    b = metrics.with_all_metrics(df.repartition(7).orderBy(F.rand(1))).select(*lap_queries.KEYS, "gap_to_leader", "degradation_rate").orderBy(*lap_queries.KEYS).collect()
    assert a == b


def test_circuit_loss(spark):
    df = spark.createDataFrame([("Monaco", 22.0), ("Monaco", 24.0), ("Monza", 18.0), (None, 99.0)], "circuit_name string, pit_delta double")
    losses = metrics.fit_circuit_loss(df)
    assert {tuple(r) for r in losses.collect()} == {("Monaco", 23.0), ("Monza", 18.0)}
    other = spark.createDataFrame([("Spa",)], "circuit_name string")
    assert metrics.apply_circuit_loss(other, losses).first()["circuit_loss"] == 20.5


# target


def test_targets(spark):
    df = target.with_compat_target(target.with_target(trace(spark, [90.0] * 16, pits=(9,))))
    assert [i + 1 for i, x in enumerate(column(df, "pit_next_5_laps")) if x] == [4, 5, 6, 7, 8]
    assert [i + 1 for i, x in enumerate(column(df, "pit_next_5_laps_compat")) if x] == [8, 9, 10, 11, 12]


# cleaning


def test_outliers(spark):
    times = [92.0, 92.1, 91.9, 92.05, 125.0, 91.95, 92.0, 92.1, 91.9, 92.0]
    assert column(cleaning.flag_outliers(trace(spark, times), "lap_time_seconds"), "lap_time_seconds_outlier") == [t == 125.0 for t in times]
    assert not any(column(cleaning.flag_outliers(trace(spark, [90.0, 91.0, 200.0]), "lap_time_seconds"), "lap_time_seconds_outlier"))


@pytest.mark.parametrize(
    ("values", "limit", "filled", "failed"),
    [([41.0, 41.2, None, 41.6, 41.8], 1.0, [2], []), ([41.0, None, None, None, 41.8], 1.0, [], [1, 2, 3]), ([None, 41.2, 41.4], 100.0, [], [0])],
)
def test_imputation(spark, values, limit, filled, failed):
    df = cleaning.impute_gaps(trace(spark, values), ["lap_time_seconds", "absent"], sample_interval_seconds=1.0, max_gap_seconds=limit)
    assert [i for i, x in enumerate(column(df, "lap_time_seconds_imputed")) if x] == filled
    assert [i for i, x in enumerate(column(df, "lap_time_seconds_sensor_failure")) if x] == failed
    events = cleaning.gap_events(trace(spark, values), ["lap_time_seconds"], sample_interval_seconds=1.0, max_gap_seconds=limit).collect()
    assert [e["action"] for e in events] == ["forward_filled" if filled else "sensor_failure"]


def test_imputation_without_times_or_with_negative_tolerance(spark):
    df = cleaning.impute_gaps(trace(spark, [1.0, None]), ["lap_time_seconds"])
    assert column(df, "lap_time_seconds_sensor_failure") == [False, True]
    with pytest.raises(ValueError):
        cleaning.impute_gaps(trace(spark, [1.0]), ["lap_time_seconds"], max_gap_seconds=-1)


def test_normalize(spark):
    raw = spark.createDataFrame([("7", " ver ", "1:32.456", "HYPERSOFT", None, 622.0, None), ("x", "hamilton", None, None, None, None, True)], "DriverNumber string, Driver string, LapTime string, Compound string, PitInTime double, PitOutTime double, Rainfall boolean")
    with pytest.raises(ValueError):
        cleaning.normalize_laps(raw)
    a, b = cleaning.normalize_laps(raw, "2024-01").orderBy(F.desc("driver_code")).collect()
    assert (a["driver_number"], a["driver_code"], a["lap_time_seconds"], a["tyre_compound"], a["tyre_compound_raw"], a["is_pit_lap"], a["rainfall"]) == (7, "VER", 92.456, "SOFT", "HYPERSOFT", True, False)
    assert (b["driver_number"], b["driver_code"], b["tyre_compound"], b["is_pit_lap"], b["lap_time_outlier"]) == (None, "HAM", "UNKNOWN", False, False)


# validation and snapshots


def clean_laps(spark):
    r = [(f"S{s}", d, i, 1 + (i > 10), 90 + 0.05 * (i % 10) + d, "SOFT", (i - 1) % 10, d) for s in range(2) for d in (1, 2) for i in range(1, 21)]
    return spark.createDataFrame(r, "session_key string, driver_number long, lap_number long, stint_number long, lap_time_seconds double, tyre_compound string, tyre_life long, position long")


def test_clean_laps_pass_and_damage_fails(spark):
    df = clean_laps(spark)
    assert validation.validate_laps(df).passed
    damaged = {
        "required": df.drop("tyre_life"),
        "nulls": df.withColumn("lap_time_seconds", F.when(F.col("lap_number") > 4, F.col("lap_time_seconds"))),
        "bounds": df.withColumn("lap_time_seconds", F.col("lap_time_seconds") + F.when(F.col("lap_number") == 5, 100).otherwise(0)),
        "repeated": df.union(df.where("driver_number = 1 and lap_number = 6")),
        "one driver": df.where("driver_number = 1"),
        "age": df.withColumn("tyre_age", F.col("lap_number")),
        "gap": df.withColumn("gap_to_leader", -F.col("lap_number").cast("double")),
    }
    for name, bad in damaged.items():
        assert not validation.validate_laps(bad).passed, name
    warned = validation.validate_laps(df.where("lap_number not in (7, 8)").withColumn("position", F.lit(1)))
    assert warned.passed and {r.name for r in warned.results if r.severity == "WARNING"} >= {"lap_sequence_gaps", "unique_position_per_lap"}
    assert "passed" in warned.summary() and '"passed": true' in warned.to_json() and not warned.failures()


def test_results_of_single_sessions(spark):
    df = clean_laps(spark)
    lone = df.where("session_key = 'S0' or driver_number = 1")
    one = [r for r in validation.validate_laps(lone).results if r.name == "driver_coverage"]
    assert [(r.session_key, r.severity, r.n_affected, r.category) for r in one] == [("S1", "ERROR", 1, "completeness")]
    both = validation.validate_laps(df.where("driver_number = 1")).results
    assert sorted(r.session_key for r in both if r.name == "driver_coverage") == ["S0", "S1"]
    masked = validation.validate_laps(lone, validation.ValidationConfig(expected_drivers=2))
    assert [(r.session_key, r.severity) for r in masked.results if r.name == "driver_coverage"] == [("S1", "WARNING")]
    many = spark.createDataFrame([(f"S{s}", d, 2 * i, 90.0, "SOFT", 1) for s in range(3) for d in (1, 2) for i in range(1, 16 - 5 * s)], "session_key string, driver_number long, lap_number long, lap_time_seconds double, tyre_compound string, tyre_life long")
    holes = {r.session_key: r for r in validation.validate_laps(many).results if r.name == "lap_sequence_gaps"}
    assert {k: r.n_affected for k, r in holes.items()} == {"S0": 28, "S1": 18, "S2": 8}
    assert len(holes["S0"].details["gaps"]) == 20 and holes["S2"].details["gaps"][0] == ["1", "3", "3"]
    names = {r.name: r for r in validation.validate_laps(df.withColumns({"odd_raw": F.lit(None).cast("double"), "odd": F.lit(None).cast("double")})).results}
    assert names["null_rate:odd"].severity == "WARNING" and names["null_rate:odd"].n_affected == 80 and "null_rate:odd_raw" not in names
    assert {r.category for r in names.values()} == {"completeness", "consistency", "reasonableness"}
    assert validation.validate_laps(df.limit(0)).passed


def test_publish_and_load(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        snapshot.load_snapshot(spark, root)
    df = clean_laps(spark)
    assert not snapshot.publish(df.drop("tyre_life"), root).passed and os.listdir(f"{root}/rejected")
    with pytest.raises(FileNotFoundError):
        snapshot.load_snapshot(spark, root)
    snapshot.publish(df, root, {"n": 1})
    snapshot.publish(df.where("session_key = 'S0'"), root, {"n": 2})
    laps, meta = snapshot.load_snapshot(spark, root)
    assert laps.count() == 40 and meta["n"] == 2 and meta["version"] == 2
    first, meta = snapshot.load_snapshot(spark, root, 1)
    assert first.count() == 80 and meta["n"] == 1


def test_stale_view_is_found(tmp_path):
    file = str(tmp_path / "view.sql")
    assert cli.main(["view", file, "--check"]) == 1
    assert cli.main(["view", file]) == 0 and cli.main(["view", file, "--check"]) == 0
    assert cli.main(["view", file, "--as-of", "2023-06-01", "--check"]) == 1
    with pytest.raises(SystemExit):
        cli.main(["view", file, "--as-of", "not-a-day"])


def test_tables_of_the_contract(spark):
    sources.create_tables(spark, "lapforge_t_laps", "lapforge_t_races")
    try:
        sources.create_tables(spark, "lapforge_t_laps", "lapforge_t_races")
        assert {f.name for f in spark.table("lapforge_t_laps").schema} == {f.name for f in LAPS_SCHEMA}
    finally:
        spark.sql("drop table lapforge_t_laps")
        spark.sql("drop table lapforge_t_races")


def test_completeness_around_imputation(spark):
    df = trace(spark, [1.0, None, 2.0, None, None])
    after = cleaning.impute_gaps(df, ["lap_time_seconds"], sample_interval_seconds=1.0)
    assert [tuple(r) for r in cleaning.imputation_report(df, after, ["lap_time_seconds", "absent"]).collect()] == [("lap_time_seconds", 40.0, 60.0)]


def test_write_laps_replaces_sessions(spark, tmp_path):
    path, df = str(tmp_path / "laps"), clean_laps(spark)
    sources.write_laps(df, path)
    sources.write_laps(df.where("session_key = 'S1'"), path)
    assert spark.read.parquet(path).count() == df.count()


# evaluation


def scored(spark, y, p, group=None):
    return spark.createDataFrame([(int(a), float(b), None if group is None else group[i]) for i, (a, b) in enumerate(zip(y, p, strict=True))], "y int, p double, g string")


def test_thresholds_and_auc(spark):
    df = scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    rows = {r["threshold"]: r for r in evaluation.threshold_sweep(df, [0.5, 1.01]).collect()}
    assert (rows[0.5]["precision"], rows[0.5]["recall"], rows[1.01]["precision"], rows[1.01]["recall"]) == (1, 1, 0, 0)
    assert tuple(evaluation.best_threshold(evaluation.threshold_sweep(df, [0.3, 0.5])).first()) == (0.3, 1.0)
    assert tuple(evaluation.best_threshold(evaluation.threshold_sweep(df.where("y = 0"), [0.3])).first()) == (0.5, 0.0)
    assert evaluation.roc_auc(scored(spark, [0, 1, 1, 0], [0.5, 0.5, 0.9, 0.1])).first()[0] == 0.875
    assert evaluation.brier(scored(spark, [0, 1], [1, 0])).first()[0] == 1.0


def test_order_statistics_are_exact(spark):
    r = np.random.default_rng(5)
    groups = {
        "a": np.round(r.normal(90, 0.5, 3000), 3), "b": r.exponential(1e6, 500) * r.choice([-1, 1], 500), "c": np.array([0.0, -0.0, 7.0]),
        None: np.full(40, 2.5), "tiny": np.array([5e-324, 1e308, -1e308, 1.0]),
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x]
    counts = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    cuts = [0, 0.1, 0.25, 0.5, 0.9, 0.999, 1]
    below = order_statistics.with_rows_below(counts, "v", ["g"])
    got = {x["g"]: x["quantiles"] for x in order_statistics.quantiles(below, "v", cuts, ["g"]).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(x, cuts)), rel=1e-12), g
    rows = below.collect()
    assert len(rows) == counts.count()
    for x in rows:
        assert x["below"] == (groups[x["g"]] < x["v"]).sum()
    none = order_statistics.with_rows_below(counts.limit(0), "v", ["g"])
    assert none.count() == 0 and order_statistics.quantiles(none, "v", cuts, ["g"]).count() == 0


@pytest.mark.parametrize("values", ["narrow", "wide", "constant", "near one", "many keys"])
def test_ranges_are_even_whatever_the_values(spark, values):
    """No task holds over twice the mean of the rows."""
    i = F.col("id")
    v = {
        "narrow": 1.7e9 + i / 1000, "wide": F.exp(F.pmod(F.xxhash64("id"), F.lit(600)) - 300) * i, "constant": F.lit(5.0),
        "near one": 1 - i / 1e12, "many keys": i % 3,
    }[values]
    g = F.lit(0) if values != "many keys" else i
    counts = spark.range(60_000).select(g.alias("g"), v.cast("double").alias("v")).groupBy("g", "v").agg(F.count("*").alias("n"))
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        table = order_statistics.ranged(counts, ["v"], ["g"])
        sizes = [r["count"] for r in table.groupBy("__range").count().collect()]
        below = order_statistics.with_rows_below(counts, "v", ["g"])
        total = below.agg(F.max(F.col("below") + F.col("n")), F.count("*")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
    assert total[1] == sum(sizes) == counts.count()
    if values == "constant":
        assert sizes == [1] and total[0] == 60_000
        return
    assert len(sizes) >= 11 and max(sizes) <= 2 * sum(sizes) / 12
    if values != "many keys":
        assert total[0] == 60_000


def test_auc_matches_pairs_and_no_task_holds_all_scores(spark):
    r = random.Random(8)
    y, p = [r.randint(0, 1) for _ in range(400)], [round(r.random(), 2) for _ in range(400)]
    pos, neg = [a for a, b in zip(p, y, strict=True) if b], [a for a, b in zip(p, y, strict=True) if not b]
    pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    auc = evaluation.roc_auc(scored(spark, y, p))
    assert auc.first()[0] == pytest.approx(pairs)
    sweep = evaluation.threshold_sweep(scored(spark, y, p), [0.2, 0.3, 0.4])
    assert [evaluation.nearest_threshold(sweep, x).first()["threshold"] for x in (0.0, 0.26, 0.35, 0.99)] == [0.2, 0.3, 0.3, 0.4]


def test_group_metrics(spark):
    y = [i % 2 for i in range(200)] + [1] * 40 + [0, 1, 1]
    p = [0.2 + 0.6 * (i % 2) for i in range(200)] + [0.9] * 40 + [0.1, 0.9, 0.9]
    got = {r["g"]: r for r in evaluation.group_metrics(scored(spark, y, p, ["a"] * 200 + [None] * 40 + ["c"] * 3), "g").collect()}
    assert list(got) == ["a", "c", None]  # sorted, null last
    assert got["a"]["roc_auc"] == 1.0 and got[None]["roc_auc"] is None and got["c"]["f1"] is None


def test_reliability(spark):
    df = scored(spark, [i % 2 for i in range(100)], [i / 99 for i in range(100)])
    for strategy in ("quantile", "uniform"):
        rows = evaluation.reliability(df, 5, strategy).collect()
        assert len(rows) == 5 and sum(r["n"] for r in rows) == 100
    assert len(evaluation.reliability(scored(spark, [0, 1], [0.5, 0.5]), 5, "uniform").collect()) == 1
    with pytest.raises(ValueError):
        evaluation.reliability(df, 5, "other")


def test_drift(spark):
    a = spark.range(2000).select((F.randn(1)).alias("x"), F.lit(1.0).alias("flat"))
    b = spark.range(2000).select((F.randn(2) + 5).alias("x"), F.lit(1.0).alias("flat"))
    assert drift.psi(a, a, "x") < 1e-9 and drift.psi(a, b, "x") > 0.25 and drift.psi(a, b, "flat") == 0.0
    with pytest.raises(ValueError):
        drift.psi(a, b.limit(0), "x")
    odd = a.union(spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 1.0)], "x double, flat double"))
    assert math.isfinite(drift.psi(odd, odd, "x"))
    assert drift.drift_report(a, b.drop("x"), ["x", "flat"]).collect()[-1]["severity"].startswith("unavailable")


# training


def test_training_round_trip(spark, tmp_path):
    laps = sources.laps_from_events(spark, SF)
    assert set(training.candidate_models()) == {"logistic_regression", "random_forest", "gradient_boosting"}
    pipeline = training.candidate_models()["logistic_regression"]
    model, scaler, train, test = training.fit_on_years(laps, pipeline)
    small = training.candidate_models(trees=4, rounds=2)
    scores = training.cross_validate(small, train.drop("weight"), 5)
    assert scores.keys() == small.keys() and all(0 <= v <= 1 for v in scores.values())
    names, values = zip(*training.feature_importances(small["random_forest"].fit(train)), strict=True)
    assert set(names) == set(training.FEATURES) and list(values) == sorted(values, reverse=True)
    folds = {(r["y"], r["fold"]): r["count"] for r in training.with_folds(train).groupBy("y", "fold").count().collect()}
    assert len(folds) == 10 and {f for _, f in folds} == set(range(5))
    # at the optimum the weighted gradient of the logistic loss is 0
    rows = training.score(model, train).select(*training.FEATURES, "weight", (F.col("weight") * (F.col("p") - F.col("y"))).alias("e"))
    gradient = rows.agg(*[F.sum(F.col("e") * F.col(c)) / F.sum("weight") for c in training.FEATURES], F.sum("e") / F.sum("weight")).first()
    assert max(abs(g) for g in gradient) < 1e-3
    held = training.score(model, test)
    threshold, _ = training.tune_threshold(training.score(model, train))
    result = training.held_out_metrics(held, threshold, train.count())
    assert training.gate(held, result).accepted
    assert not training.gate(held.withColumn("p", F.lit(1.4)), result).accepted
    assert not training.gate(held.withColumn("y", F.lit(2.0)), result).accepted
    assert not training.gate(held, result | {"roc_auc": 1.4}).accepted
    assert not training.gate(held.withColumn("pace_delta", F.lit(float("nan"))), result).accepted
    training.save_artifacts(model, scaler, result, test, str(tmp_path / "artifacts"))
    assert cli.main(["artifacts", str(tmp_path / "artifacts")]) == 0 and cli.main(["artifacts", str(tmp_path / "nothing")]) == 1
    assert cli.main(["notes", str(tmp_path / "artifacts")]) == 0
    assert training.release_notes({"roc_auc": 0.5, "f1": 0.25, "other": 1}) == "- roc_auc: 0.500\n- f1: 0.250"
    loaded, scaler2, metrics2, _ = training.load_artifacts(spark, str(tmp_path / "artifacts"))
    assert metrics2 == result
    row = dict.fromkeys(training.FEATURES, 0.0)
    assert training.predict(loaded, {k: tuple(v) for k, v in scaler2.items()}, row, spark) == pytest.approx(training.predict(model, scaler, row, spark))
    with pytest.raises(KeyError):
        training.predict(model, scaler, {}, spark)
    assert len(training.feature_importances(model)) == 9 and training.policy_sweep(held).count() == 18


# every query against its SQL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def plain(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x


@pytest.mark.parametrize("name", sorted(lap_queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = lap_queries.QUERIES[name](spark, SF)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(repr(plain(r[names.index(c)])) for c in order) for r in cursor.fetchall()))
    got = sorted(tuple(repr(plain(r[c])) for c in order) for r in df.collect())
    assert got == want


def test_report_of_a_session_with_all_expected_drivers_matches_sql(spark, tmp_path):
    """S0 has the 10,000 drivers that the query expects and S1 has one too few: only S1 is told."""
    i = F.col("id")
    events = spark.range(19_999 + 40).select(
        i.alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"),
        F.when(i < 10_000, i * 5).when(i < 19_999, (i - 10_000) * 5 + 1).otherwise(i % 4 * 5).alias("user_id"),
        F.when(i % 3 == 0, "purchase").otherwise("view").alias("event_type"), (i % 97 + 50.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    sql = f"select category, name, severity, n_affected, session_key from ({__spark_entry__.oracle_sql()['validation_report']})"
    got = {tuple(r) for r in lap_queries.validation_report(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(sql).fetchall())
    assert [r for r in got if r[1] == "driver_coverage"] == [("completeness", "driver_coverage", "WARNING", 9_999, "S1")]


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 1000
