import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapforge.operators import metrics
from lapforge.sources.laps import laps_from_events
from lapforge.streaming import field, traces
from lapforge.streaming.ingest import ingest, lap_counts


def test_ingest_normalizes_and_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("raw", "laps", "state"))
    schema = "DriverNumber string, LapNumber int, LapTime string"
    for i in range(2):
        spark.createDataFrame([("1", 1 + i, "1:30.0"), ("2", 1 + i, None)], schema).write.mode("append").parquet(source)
        query = ingest(spark.readStream.schema(schema).parquet(source), out, state, "2024-1")
        query.awaitTermination(120)
    laps = spark.read.parquet(out)
    assert laps.count() == 4 and laps.where("lap_time_seconds = 90").count() == 2
    assert {r[0] for r in laps.select("session_key").distinct().collect()} == {"2024-1"}


def test_lap_counts(spark, tmp_path):
    source = str(tmp_path / "laps")
    rows = spark.range(12).select((F.lit(1_700_000_100) + F.col("id") * 60).cast("timestamp").alias("ts"), F.lit("S").alias("session_key"), F.lit(90.0).alias("lap_time_seconds"))
    rows.write.parquet(source)
    stream = lap_counts(spark.readStream.schema(rows.schema).parquet(source))
    name = f"counts_{int(time.time())}"
    query = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table(name).agg(F.sum("n_laps")).first()[0] == 12


SF = "/root/testdata/sf0.001"


def run_stream(spark, tmp_path, laps, parts, metrics, name, **options):
    """The rows that a stream gives whose micro-batches are these parts of laps, in this order."""
    source = f"{tmp_path}/{name}"
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        for f in os.listdir(source):  # files are taken by time
            if f.endswith(".parquet") and os.stat(f"{source}/{f}").st_mtime > 1_750_000_000:
                os.utime(f"{source}/{f}", (1_700_000_000 + 10 * k,) * 2)
    stream = spark.readStream.schema(laps.schema).option("maxFilesPerTrigger", 1).parquet(source)
    table = f"{name}_{time.monotonic_ns()}"
    query = metrics(stream, **options).writeStream.outputMode("append").format("memory").queryName(table).trigger(availableNow=True).start()
    assert query.awaitTermination(90) and query.exception() is None
    return spark.table(table)


def rounded(rows, names):
    return {(r["row_id"], *(None if r[n] is None else round(r[n], 6) for n in names)) for r in rows}


@pytest.fixture
def laps(spark, tmp_path):
    rows = laps_from_events(spark, SF, with_nulls=True).withColumn("row_id", F.col("event_id")).where("driver_number < 7")
    rows.write.parquet(f"{tmp_path}/all")
    return spark.read.parquet(f"{tmp_path}/all")


@pytest.mark.parametrize("cuts", [[100], [1, 2, 3, 30, 100], [17, 100]])
def test_stream_of_traces_equals_the_batch(spark, tmp_path, laps, cuts):
    parts = [laps.where((F.col("lap_number") > lo) & (F.col("lap_number") <= hi)) for lo, hi in zip([0, *cuts], cuts, strict=False)]
    got = run_stream(spark, tmp_path, laps, parts, traces.trace_metrics, "cuts").collect()
    want = laps
    for name in traces.METRICS:
        want = metrics.with_metric(want, *name.split("@"))
    assert rounded(got, traces.METRICS) == rounded(want.collect(), traces.METRICS) and not any(r["late"] for r in got)


def test_stream_of_traces_derives_stints_and_tells_late_laps(spark, tmp_path, laps):
    bare = laps.drop("stint_number")
    bare = bare.where("not (driver_number = 2 and lap_number = 3)")
    parts = [bare.where("lap_number <= 5"), bare.where("lap_number > 5"), laps.drop("stint_number").where("driver_number = 2 and lap_number = 3"), bare.limit(0)]
    got = run_stream(spark, tmp_path, bare, parts, traces.trace_metrics, "late").collect()
    want = metrics.with_metric(metrics.with_metric(bare, "tyre_age"), "tyre_age", "v1").collect()
    names = ("tyre_age@v1", "tyre_age@v2")
    assert rounded([r for r in got if not r["late"]], names) == rounded(want, names)
    late = [r for r in got if r["late"]]
    assert [(r["driver_number"], r["lap_number"]) for r in late] == [(2, 3)] and all(late[0][m] is None for m in traces.METRICS)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_neighbouring_traces_share_a_key_and_stay_apart(spark, tmp_path, kind):
    """200 drivers from -100 on lie in 5 blocks of 64 numbers, and a far one and the unnamed one in one each; a text is
    its own key. Infinite and missing times, stints that return and laps below 0 touch their own trace alone."""
    i, driver, lap = F.col("id"), F.col("id") % 202, (F.col("id") / 202).cast("long")
    rows = spark.range(202 * 12).select(
        F.lit("S").alias("session_key"), F.when(driver == 200, 2**60 + 1).when(driver < 200, driver - 100).cast(kind).alias("driver_number"),
        (lap - 3).alias("lap_number"), i.alias("row_id"), F.when(i % 7 > 0, F.when((driver == 5) & (lap == 6), float("inf")).otherwise(80 + i % 13 / 4)).alias("lap_time_seconds"),
        F.when(driver % 2 == 0, lap % 3).alias("stint_number"), (i % 5 == 0).alias("is_pit_lap"),
        F.when(i % 5 == 0, lap * 90.0).alias("pit_in_time"), F.when((i + 1) % 3 == 0, lap * 95.0).alias("pit_out_time"),
    )
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    parts = [rows.where("lap_number < 2"), rows.where("lap_number between 2 and 4"), rows.where("lap_number > 4")]
    got = run_stream(spark, tmp_path, rows, parts, traces.trace_metrics, f"blocks_{kind}")
    want = rows
    for name in traces.METRICS:
        want = metrics.with_metric(want, *name.split("@"))
    fit = "driver_number is null or driver_number <> -95"
    assert rounded(got.where(fit).collect(), traces.METRICS) == rounded(want.where(fit).collect(), traces.METRICS)
    assert got.where("driver_number = -95 and not late").count() == 12 and got.where("late").count() == 0
    assert {(r[0], r[1]) for r in got.select("driver_number", "row_id").collect()} == {(r[0], r[1]) for r in rows.select("driver_number", "row_id").collect()}


def test_a_stream_keeps_one_state_for_neighbouring_traces(spark, tmp_path):
    """A call a trace was what a stream of many traces spent its time on."""
    many = spark.range(1_000).select(F.lit("S").alias("session_key"), F.col("id").alias("driver_number"), F.lit(1).cast("long").alias("lap_number"), F.lit(80.0).alias("lap_time_seconds"))
    many.write.parquet(f"{tmp_path}/many")
    stream = traces.trace_metrics(spark.readStream.schema(many.schema).parquet(f"{tmp_path}/many"))
    query = stream.writeStream.format("memory").queryName(f"many_{time.monotonic_ns()}").trigger(availableNow=True).start()
    assert query.awaitTermination(90) and query.exception() is None
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(held) == 16  # of 64 numbers each


class State:
    """A state as Spark hands it to a step."""

    def __init__(self):
        self.value, self.now, self.hasTimedOut, self.due = None, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def setTimeoutDuration(self, ms):
        self.due = self.now + ms

    def update(self, value):
        self.value = value

    def remove(self):
        self.value, self.due = None, None


def test_an_idle_trace_goes_without_its_neighbours():
    step, state = traces._step(100), State()

    def bring(now, drivers, lap, timed_out=False):
        state.now, state.hasTimedOut = now, timed_out
        frame = pd.DataFrame({"driver_number": drivers, "lap_number": lap, "row_id": 0, "lap_time_seconds": 80.0, "stint_number": float("nan"), "is_pit_lap": False, "pit_in_time": float("nan"), "pit_out_time": float("nan")})
        out = list(step(("S", 0), iter([] if timed_out else [frame]), state))
        return {r["driver_number"]: r["tyre_age@v2"] for f in out for _, r in f.iterrows()}

    assert bring(1_000, [1, 2, 3], 1) == {1: 0, 2: 0, 3: 0} and state.due == 1_100
    assert bring(1_060, [2, 3], 2) == {2: 1, 3: 1} and state.due == 1_100
    assert bring(1_101, [], 0, timed_out=True) == {} and state.value[0] == [2, 3] and state.due == 1_160
    assert bring(1_150, [3, 1], 3) == {3: 2, 1: 0} and state.value[0] == [2, 3, 1] and state.due == 1_160
    assert bring(1_170, [1], 4) == {1: 1} and state.value[0] == [3, 1]  # 2 went as its neighbours came
    assert bring(1_175, [1], 3) == {1: pytest.approx(float("nan"), nan_ok=True)} and state.value[0] == [3, 1]  # late, but there
    bring(9_999, [], 0, timed_out=True)
    assert not state.exists


def test_stream_of_the_field_equals_the_batch(spark, tmp_path, laps):
    """Event times by lap; a lap far ahead in another session closes all others."""
    field_laps = laps.withColumn("ts", (F.lit(1_700_000_000) + F.col("lap_number") * 100 + F.col("driver_number")).cast("timestamp"))
    last = field_laps.limit(1).withColumns({"session_key": F.lit("end"), "ts": F.lit("2030-01-01").cast("timestamp")})
    parts = [field_laps.where("lap_number <= 10"), field_laps.where("lap_number between 11 and 40"), field_laps.where("lap_number > 40"), last, last.withColumn("lap_number", F.lit(999).cast("long"))]
    options = {"lateness": "10 seconds", "spread_seconds": 60.0}
    got = run_stream(spark, tmp_path, field_laps, parts, field.field_metrics, "field", **options).where("session_key <> 'end'").collect()
    want = field_laps
    for name in field.METRICS:
        want = metrics.with_metric(want, *name.split("@"))
    assert rounded(got, field.METRICS) == rounded(want.collect(), field.METRICS) and not any(r["late"] for r in got)


def test_stream_of_the_field_counts_late_laps(spark, tmp_path, laps):
    field_laps = laps.withColumn("ts", (F.lit(1_700_000_000) + F.col("lap_number") * 100).cast("timestamp"))
    held = field_laps.where("driver_number = 3 and lap_number = 4").withColumn("ts", (F.lit(1_700_000_000) + 10_000).cast("timestamp"))
    others = field_laps.where("not (driver_number = 3 and lap_number = 4)")
    end = field_laps.limit(1).withColumns({"session_key": F.lit("end"), "ts": F.lit("2030-01-01").cast("timestamp")})
    parts = [others.where("lap_number <= 30"), others.where("lap_number > 30").limit(3), held, others.where("lap_number > 90"), end]
    got = run_stream(spark, tmp_path, field_laps, parts, field.field_metrics, "fieldlate", lateness="10 seconds", spread_seconds=60.0).collect()
    assert [(r["driver_number"], r["lap_number"]) for r in got if r["late"]] == [(3, 4)]
    assert all(r[m] is None for r in got if r["late"] for m in field.METRICS)
