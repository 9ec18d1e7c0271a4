"""Session files, race keys, stored laps, ingest and training commands, as-of joins, composed metrics."""

import datetime
import json
import os
import threading
from datetime import date

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_laps import SF, clean_laps

from lapforge import cli
from lapforge.operators import asof, cleaning, metrics
from lapforge.plans import ingest, snapshot, training
from lapforge.sources import commits, races, sessions
from lapforge.sources import laps as sources
from lapforge.staging import settled, staged_so_far


def raw_session(drivers=2, laps=20, pits=(10,), **more):
    """A session as it comes from a timing feed: its own column names and types."""
    rows = []
    for d in range(1, drivers + 1):
        for i in range(1, laps + 1):
            seconds = 90 + d + 0.05 * (i % 10)
            rows.append(
                {
                    "DriverNumber": str(d), "Driver": f"d{d}x", "Team": " Team ", "LapNumber": float(i), "LapTime": pd.Timedelta(seconds=seconds),
                    "Compound": "HYPERSOFT" if i <= 10 else "M", "Stint": 1.0 + (i > 10), "TyreLife": float((i - 1) % 10), "Position": float(d), "TrackStatus": "24" if i == 3 else "1",
                    "PitInTime": pd.Timedelta(seconds=600.0) if i in pits else pd.NaT, "PitOutTime": pd.Timedelta(seconds=622.5) if i - 1 in pits else pd.NaT, "AirTemp": 28.5, "Rainfall": False,
                } | more
            )
    return pd.DataFrame(rows)


def write_sessions(root):
    """Two good sessions, an empty one, a damaged one."""
    raw_session().to_parquet(f"{root}/2023-1.parquet")
    raw_session(drivers=3).drop(columns="Position").assign(LapTime="1:31.5", PitInTime=None, PitOutTime=None).to_json(f"{root}/2024-1.json", orient="records", lines=True)
    raw_session().head(0).to_parquet(f"{root}/2024-2.parquet")
    with open(f"{root}/2024-3.parquet", "wb") as file:
        file.write(b"PAR1 this is no table PAR1")
    return str(root)


# sessions


def test_damaged_sessions_stop_nothing(spark, tmp_path):
    root, jobs = write_sessions(tmp_path), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sessions", "one scan")
    laps, failures = sources.fetch_seasons(spark, root, [2023, 2024], range(1, 4))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs.getJobIdsForGroup("sessions")) <= 2  # the scan, and whether there are laps
    count = {(r["session_key"], r["year"], r["round"]): r["count"] for r in laps.groupBy("session_key", "year", "round").count().collect()}
    assert count == {("2023-1", 2023, 1): 40, ("2024-1", 2024, 1): 60}
    told = {(r["session_key"], r["kind"]) for r in failures.collect()}
    assert told == {("2024-3", "unreadable"), ("2023-2", "missing"), ("2023-3", "missing")}
    assert sorted(r["row_id"] for r in laps.where("session_key = '2023-1'").collect()) == list(range(40))
    with pytest.raises(ValueError):
        sources.fetch_seasons(spark, root, [2020], [1])
    assert sources.fetch_session(spark, root, 2024, 3) == (None, None) and sources.fetch_session(spark, root, 2020, 1) == (None, None)
    one, meta = sources.fetch_session(spark, root, 2023, 1)
    assert one.count() == 40 and meta == {"session_key": "2023-1", "year": 2023, "round": 1}
    sessions.register(spark)
    assert spark.read.format("lap_sessions").load(root).where("failure is null").select("session_key").distinct().count() == 2


def test_cells_of_sessions_are_read(spark, tmp_path):
    laps, _ = sources.fetch_seasons(spark, write_sessions(tmp_path), [2023, 2024], [1])
    out = cleaning.normalize_laps(laps)
    row = out.where("session_key = '2023-1' and driver_number = 2 and lap_number = 11").first()
    assert (row["lap_time_seconds"], row["tyre_compound"], row["stint_number"], row["position"], row["air_temp"], row["pit_out_time"], row["is_pit_lap"], row["driver_code"], row["rainfall"]) == (92.05, "MEDIUM", 2, 2, 28.5, 622.5, True, "D2X", False)
    flags = out.where("lap_number = 3").select("is_safety_car_lap", "is_yellow_flag", "is_red_flag").distinct().collect()
    assert [tuple(f) for f in flags] == [(True, True, False)]
    other = out.where("session_key = '2024-1'")
    assert other.where("lap_time_seconds = 91.5 and position is null").count() == 60


def test_sessions_as_folders_and_csv(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame(raw_session().drop(columns=["LapTime", "PitInTime", "PitOutTime"])).repartition(3).write.parquet(f"{root}/2022-1.parquet")
    raw_session().to_csv(f"{root}/2022-2.csv", index=False)
    open(f"{root}/2022-3.csv", "w").close()
    pq.write_table(pa.table({"LapNumber": pa.array([[1], [2]])}), f"{root}/2022-4.parquet")  # a column that isn't a cell
    laps, failures = sources.fetch_seasons(spark, root, [2022], range(1, 5))
    assert {r["session_key"]: r["count"] for r in laps.groupBy("session_key").count().collect()} == {"2022-1": 40, "2022-2": 40}
    assert [r["session_key"] for r in failures.collect()] == ["2022-4"]


def test_unreadable_cells_are_counted_in_the_same_job(spark):
    rows = [("1:31.5", "1", "SOFT", "28.5"), ("fast", "x", "GLITTER", "hot"), (None, None, None, None), (" ", "", "", " "), ("1:05:32", "2.0", "wet", "nan")]
    raw = spark.createDataFrame([("S", *r) for r in rows], "session_key string, LapTime string, LapNumber string, Compound string, AirTemp string")
    counted = Observation()
    cleaning.normalize_laps(raw, observation=counted).collect()
    assert counted.get == {"rows": 5, "lap_time_seconds": 2, "lap_number": 1, "air_temp": 1, "tyre_compound": 1}


# commits and race keys


def test_race_ids_are_dense_and_stay(spark, tmp_path):
    path = str(tmp_path / "races")
    cand = lambda rows: spark.createDataFrame(rows, "session_key string, year int, race_name string, circuit_name string, num_laps long")
    first = [(f"s{i:03d}", 2018 + i % 3, f"race {i}", "c", 50) for i in range(50, 0, -1)]
    ids = {(r["year"], r["race_name"]): r["race_id"] for r in races.append_races(cand(first), path).collect()}
    assert [ids[k] for k in sorted(ids)] == list(range(1, 51))
    again = {(r["year"], r["race_name"]): r["race_id"] for r in races.append_races(cand(first + first[:3]), path).collect()}
    assert again == ids
    more = races.append_races(cand([("t1", 2017, "early", None, 1), ("t0", 2017, "early", None, 2), ("t2", None, "odd", None, 3), ("s001", 2019, "race 1", "other", 9)]), path)
    after = {(r["year"], r["race_name"]): r for r in more.collect()}
    assert {k: r["race_id"] for k, r in after.items()} == ids | {(None, "odd"): 51, (2017, "early"): 52}
    assert after[2017, "early"]["session_key"] == "t0" and after[2019, "race 1"]["circuit_name"] == "c"
    assert {(r["year"], r["race_name"]): r["race_id"] for r in races.read_races(spark, path).collect()} == {k: r["race_id"] for k, r in after.items()}
    log = commits.CommitLog(spark, path)
    assert log.numbers() == [1, 2, 3] and log.read(1).count() == 50
    log.vacuum()
    assert log.read().count() == 52 and os.listdir(f"{path}/data") == [log.entry()["folder"]]
    with pytest.raises(FileNotFoundError):
        races.read_races(spark, str(tmp_path / "none"))


def at_once(*functions):
    errors = []

    def run(f):
        try:
            f()
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=run, args=(f,)) for f in functions]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors


def test_race_tables_merged_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "races")
    part = lambda k: lambda: races.append_races(spark.createDataFrame([(f"s{k}-{i}", 2020 + k, f"r{i}") for i in range(10)], "session_key string, year int, race_name string"), path)
    at_once(*[part(k) for k in range(4)])
    rows = races.read_races(spark, path).collect()
    assert sorted(r["race_id"] for r in rows) == list(range(1, 41)) and len({(r["year"], r["race_name"]) for r in rows}) == 40
    assert commits.CommitLog(spark, path).numbers() == [1, 2, 3, 4]


def test_two_publishers_make_two_versions(spark, tmp_path):
    root, df = str(tmp_path / "store"), clean_laps(spark)
    at_once(*[lambda k=k: snapshot.publish(df.where(f"lap_number <= {18 + k}"), root, {"n": k}) for k in range(2)])
    log = commits.CommitLog(spark, root)
    assert log.numbers() == [1, 2]
    seen = {}
    for number in (1, 2):
        laps, meta = snapshot.load_snapshot(spark, root, number)
        seen[meta["n"]] = laps.count()
        assert meta["version"] == number
    assert seen == {0: 72, 1: 76} and snapshot.load_snapshot(spark, root)[1]["version"] == 2


def test_a_number_is_taken_once(spark, tmp_path):
    path = f"{tmp_path}/log/1.json"
    os.makedirs(f"{tmp_path}/log")
    taken = []
    at_once(*[lambda k=k: taken.append(k) if commits.put_new(spark, path, f"{k}") else None for k in range(8)])
    assert len(taken) == 1 and commits.read_text(spark, path) == str(taken[0]) and os.listdir(f"{tmp_path}/log") == ["1.json"]


def test_a_session_of_two_circuits_is_refused(spark):
    laps = clean_laps(spark).withColumns({"year": F.lit(2023), "circuit_name": F.when(F.col("lap_number") < 5, "A").otherwise("B")})
    with pytest.raises(ValueError, match="circuit_name"):
        races.race_candidates(laps)
    assert {r["race_name"] for r in races.race_candidates(laps.withColumn("circuit_name", F.lit("A"))).collect()} == {"S0", "S1"}


# stored laps


def test_star_joins(spark):
    laps = clean_laps(spark).withColumn("race_id", F.when(F.col("session_key") == "S0", 1).otherwise(2).cast("long"))
    table = spark.createDataFrame([(1, "S0", 2023, "A", "x"), (3, "S9", 2024, "B", "y")], "race_id long, session_key string, year int, race_name string, circuit_name string")
    assert sources.load_star(laps, table.drop("session_key"), [2023]).count() == 40
    star = sources.load_star(laps.withColumn("circuit_name", F.lit("laps'")), table, [2023])
    assert star.count() == 40 and {r["circuit_name"] for r in star.collect()} == {"x"}
    with pytest.raises(ValueError):
        sources.load_star(laps, table, [2024])
    joined = sources.attach_races(laps, table)
    assert joined.count() == 80 and joined.where("year is null").count() == 40
    meta = sources.race_metadata(clean_laps(spark).withColumn("race_name", F.lit("R"))).orderBy("session_key").first()
    assert (meta["num_drivers"], meta["num_laps"], meta["race_name"]) == (2, 20, "R")


def test_only_files_of_the_years_asked_for_are_read(spark, tmp_path):
    laps = clean_laps(spark)
    many = laps.withColumn("session_key", F.concat("session_key", F.lit("-"), F.col("lap_number") % 5)).withColumn("year", 2015 + F.col("lap_number") % 5)
    candidates = races.race_candidates(many)
    table = races.append_races(candidates, ingest.races_path(str(tmp_path)))
    sources.write_laps(races.with_race_ids(many, candidates, table), ingest.laps_path(str(tmp_path)))
    star = ingest.stored_star(spark, str(tmp_path), [2016, 2018])
    assert "dynamicpruning" in star._jdf.queryExecution().executedPlan().toString()
    assert star.count() == many.where("year in (2016, 2018)").count()
    scans = {}

    def walk(node):
        for m in range(node.children().size()):
            walk(node.children().apply(m))
        if "AdaptiveSparkPlan" in node.nodeName():
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())
        if node.nodeName().startswith("Scan parquet") and "session_key" in node.toString() and node.metrics().contains("numFiles"):
            scans[node.toString()[:400]] = node.metrics().apply("numFiles").value()

    pruned = ingest.stored_star(spark, str(tmp_path), [2016, 2018]).select("session_key", "year")
    pruned.collect()
    walk(pruned._jdf.queryExecution().executedPlan())
    every = sum(name.startswith("part-") for _, _, names in os.walk(ingest.laps_path(str(tmp_path))) for name in names)
    assert any(0 < n < every for n in scans.values()), (scans, every)


def test_traces_in_buckets_need_no_exchange_and_no_sort(spark):
    laps = sources.laps_from_events(spark, SF, with_nulls=True).withColumn("row_id", F.col("event_id"))
    sources.save_traces(laps, "lapforge_traces", buckets=4)
    try:
        stored = sources.trace_table(spark, "lapforge_traces")
        own = ["degradation_rate@v1", "pace_delta@v1", "tyre_age@v2", "tyre_age@v1", "degradation_rate@v2"]
        for name in own:
            key, version = name.split("@")
            out = metrics.with_metric(stored, key, version)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Window" in plan and "Exchange" not in plan, name
            if key == "pace_delta":
                assert "Sort" not in plan
            want = metrics.with_metric(laps, key, version).select("event_id", F.round(f"`{name}`", 6).alias("v"))
            assert {tuple(r) for r in out.select("event_id", F.round(f"`{name}`", 6)).collect()} == {tuple(r) for r in want.collect()}
    finally:
        spark.sql("drop table lapforge_traces")


# commands


def test_ingest_command(spark, tmp_path, capsys):
    source, target = write_sessions(tmp_path), str(tmp_path / "store")
    before = staged_so_far()
    assert cli.main(["ingest", source, target, "--years", "2023,2024", "--rounds", "1,2,3"]) == 0
    out = capsys.readouterr()
    assert "2 races, 100 laps, 3 errors" in out.out and "2024-3: unreadable" in out.err and "2023-2: missing" in out.err
    assert staged_so_far() == before  # nothing is left behind
    star = ingest.stored_star(spark, target)
    ids = {r["session_key"]: r["race_id"] for r in star.select("session_key", "race_id").distinct().collect()}
    assert ids == {"2023-1": 1, "2024-1": 2} and star.count() == 100
    # again, with a session more: the same ids, no lap twice
    raw_session(laps=5).to_parquet(f"{source}/2022-7.parquet")
    assert cli.main(["ingest", source, target, "--years", "2022,2023,2024", "--rounds", "1,7"]) == 0
    star = ingest.stored_star(spark, target)
    assert {r["session_key"]: r["race_id"] for r in star.select("session_key", "race_id").distinct().collect()} == ids | {"2022-7": 3}
    assert star.count() == 110 and ingest.stored_star(spark, target, [2022]).count() == 10
    assert cli.main(["ingest", source, target, "--years", "2001", "--rounds", "1"]) == 1
    report = ingest.ingest(spark, source, target, [2024], [1])
    assert report.unreadable == {} and report.races == 1 and json.dumps(report.to_dict())


def test_train_command(spark, tmp_path, capsys):
    """Sessions of several seasons to a saved model that the artifact check accepts; two trees and rounds."""
    source, target, folder = str(tmp_path), str(tmp_path / "store"), str(tmp_path / "model")
    for k, year in enumerate((2018, 2019, 2020, 2024)):
        raw_session(drivers=3, laps=30, pits=(8 + 3 * k,)).to_parquet(f"{source}/{year}-1.parquet")
    assert cli.main(["ingest", source, target, "--years", "2018,2019,2020,2024", "--rounds", "1"]) == 0
    laps = ingest.stored_star(spark, target)
    told = training.train(laps, folder, (2018, 2019, 2020), (2024,), models=training.candidate_models(trees=2, rounds=2), folds=2)
    assert set(told["cv_scores"]) == {"logistic_regression", "random_forest", "gradient_boosting"} and told["train_size"] == 270 and told["test_size"] == 90
    assert cli.main(["artifacts", folder]) == 0 and cli.main(["notes", folder]) == 0
    assert cli.main(["train", target, folder, "--train-years", "2001", "--test-years", "2024"]) == 1
    assert "no model" in capsys.readouterr().err
    with pytest.raises(ValueError):
        training.train(laps, folder, (2018,), (2001,))


def test_folds_of_a_label_differ_by_one_row(spark):
    df = spark.range(1003).select((F.col("id") % 7 == 0).cast("int").alias("y"), F.lit("S").alias("session_key"), F.lit(1).alias("driver_number"), F.col("id").alias("lap_number"))
    sizes = {}
    for r in training.with_folds(df, 5).groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    assert {y: sum(x) for y, x in sizes.items()} == {0: 859, 1: 144} and all(len(x) == 5 and max(x) - min(x) <= 1 for x in sizes.values())
    a, b = ({(r["lap_number"], r["fold"]) for r in training.with_folds(d, 5).collect()} for d in (df, df.repartition(7)))
    assert a == b and sorted(n for n, f in a if f == 0) != list(range(0, 1003, 5))


# as-of joins


def test_as_of_join(spark):
    day = lambda n: date(2020, 1, 1) + datetime.timedelta(n)
    versions = [("a", "v1", day(0), day(10)), ("a", "v2", day(10), day(20)), ("a", "v3", day(25), None), ("b", "w", day(5), None), ("c", "x", None, None)]
    table = spark.createDataFrame(versions, "key string, version string, since date, until date")
    facts = [(k, None if d is None else day(d), n) for k in ("a", "b", "c", "d", None) for d in (-1, 0, 9, 10, 19, 20, 24, 25, 99, None) for n in (1, 1)]
    got = asof.as_of_join(spark.createDataFrame(facts, "key string, day date, n int"), table, "day", ["key"])

    def brute(k, d):
        live = [v for key, v, s, u in versions if key == k and s is not None and d is not None and s <= d and (u is None or d < u)]
        return live[0] if live else None

    assert sorted([(r["key"], r["day"], r["n"], r["version"]) for r in got.collect()], key=str) == sorted([(*f, brute(f[0], f[1])) for f in facts], key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for odd in ([("a", "v0", day(8), day(9))], [("a", "v9", day(30), None)]):
        with pytest.raises(LookupError):
            asof.as_of_join(spark.createDataFrame(facts, "key string, day date, n int"), table.union(spark.createDataFrame(odd, table.schema)), "day", ["key"])


def test_as_of_join_with_many_dates(spark):
    n = 100_000
    versions = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 10).alias("since"), F.when(F.col("id") % 3 == 0, F.col("id") * 10 + 5).alias("until"), F.col("id").alias("version"))
    versions = versions.withColumn("until", F.coalesce("until", F.when(F.col("version") < n - 1, F.col("since") + 10)))
    facts = spark.range(50_000).select(F.lit("k").alias("key"), F.pmod(F.xxhash64("id"), F.lit(10 * n + 50)).alias("at"))
    got = asof.as_of_join(facts, versions, "at", ["key"])
    want = F.when((F.floor(F.col("at") / 10) % 3 == 0) & (F.col("at") % 10 >= 5), F.lit(None)).otherwise(F.least(F.floor(F.col("at") / 10), F.lit(n - 1)))
    last = (n - 1) % 3 == 0
    odd = got.where(~F.col("version").eqNullSafe(want))
    assert got.count() == 50_000 and odd.where(F.col("at") < 10 * (n - 1)).count() == 0 and (last or odd.count() == 0)


# composed metrics


def own_metric(key, uses, column, version="v1"):
    return metrics.MetricVersion(key, date(2024, 1, 1), version, None, key, "seconds", "analyst", "made of others", uses=uses, column=column)


def test_metrics_over_metrics(spark):
    registry = metrics.MetricRegistry(metrics.REGISTRY.rows)
    registry.register(own_metric("both", ("tyre_age", "gap_to_leader@v1"), lambda m: m["tyre_age"] * 100 + m["gap_to_leader@v1"]))
    registry.register(own_metric("more", ("both",), lambda m: m["both"] + F.col("lap_number")))
    df = sources.laps_from_events(spark, SF)
    out = metrics.with_metric(df, "more", registry=registry)
    assert set(out.columns) == {*df.columns, "more@v1"}
    parts = metrics.with_metric(metrics.with_metric(df, "tyre_age"), "gap_to_leader", "v1")
    want = parts.select("event_id", (F.col("`tyre_age@v2`") * 100 + F.col("`gap_to_leader@v1`") + F.col("lap_number")).alias("v"))
    assert {tuple(r) for r in out.select("event_id", "`more@v1`").collect()} == {tuple(r) for r in want.collect()}
    assert [[m.key for m in step] for step in registry.steps([registry.get("more")])] == [["gap_to_leader", "tyre_age"], ["both"], ["more"]]
    every = metrics.with_all_metrics(df, registry=registry)
    assert {"both", "more", "pace_delta"} <= set(every.columns) and not [c for c in every.columns if c.startswith("__")]
    assert registry.get("more").to_dict()["uses"] == ("both",) and registry.get("more").qualified_name == "more@v1"
    with pytest.raises(ValueError, match="more@v1"):
        metrics.metrics_view_sql(registry=registry)
    with pytest.raises(KeyError):
        metrics.with_metric(df, "lost", registry=metrics.MetricRegistry([own_metric("lost", ("nothing",), lambda m: m["nothing"])]))
    cycle = metrics.MetricRegistry([own_metric("a", ("b",), lambda m: m["b"]), own_metric("b", ("a",), lambda m: m["a"])])
    with pytest.raises(ValueError, match="cycle"):
        metrics.with_metric(df, "a", registry=cycle)
    for odd in ({"sql": "1", "column": lambda m: F.lit(1)}, {}, {"sql": "1", "uses": ("a",)}):
        with pytest.raises(ValueError):
            metrics.MetricVersion("x", date(2024, 1, 1), "v1", None, "x", "s", "me", "d", **odd)


def test_imputation_follows_row_order_of_repeated_laps(spark):
    rows = [("S", 1, 1, 0, 10.0), ("S", 1, 2, 2, None), ("S", 1, 2, 1, 20.0), ("S", 1, 3, 3, None)]
    df = spark.createDataFrame(rows, "session_key string, driver_number long, lap_number long, row_id long, v double")
    out = cleaning.impute_gaps(df, ["v"], sample_interval_seconds=1.0, max_gap_seconds=5.0)
    assert [r["v"] for r in out.orderBy("row_id").collect()] == [10.0, 20.0, 20.0, 20.0]


def test_only_computed_frames_are_settled(spark, tmp_path):
    clean_laps(spark).write.parquet(f"{tmp_path}/laps")
    stored = spark.read.parquet(f"{tmp_path}/laps")
    for plain in (stored, stored.where("lap_number > 3").select("lap_number"), clean_laps(spark)):
        assert settled(plain, "x") is plain
    for made in (metrics.with_metric(stored, "tyre_age"), stored.groupBy("session_key").count(), stored.join(stored.select("driver_number"), "driver_number"), stored.distinct()):
        out = settled(made, "x")
        assert out is not made and out.inputFiles() and out.columns == made.columns
