"""Contracts of the lap and race tables and the fixed vocabularies of raw inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw spellings of tyre compounds and their canonical names.
COMPOUND_ALIASES = {
    "HYPERSOFT": "SOFT",
    "ULTRASOFT": "SOFT",
    "SUPERSOFT": "SOFT",
    "SOFT": "SOFT",
    "S": "SOFT",
    "MEDIUM": "MEDIUM",
    "M": "MEDIUM",
    "HARD": "HARD",
    "SUPERHARD": "HARD",
    "H": "HARD",
    "INTERMEDIATE": "INTERMEDIATE",
    "INTER": "INTERMEDIATE",
    "I": "INTERMEDIATE",
    "WET": "WET",
    "W": "WET",
    "WETS": "WET",
    "WET WEATHER": "WET",
    "TEST_UNKNOWN": "UNKNOWN",
    "UNKNOWN": "UNKNOWN",
    "NAN": "UNKNOWN",
}
UNKNOWN_COMPOUND = "UNKNOWN"

# Raw lap columns and their canonical names.
RAW_TO_CANONICAL = {
    "LapTime": "lap_time_seconds",
    "DriverNumber": "driver_number",
    "Driver": "driver_code",
    "Team": "team_name",
    "LapNumber": "lap_number",
    "Compound": "tyre_compound",
    "TyreLife": "tyre_life",
    "Stint": "stint_number",
    "Position": "position",
    "Sector1Time": "sector_1",
    "Sector2Time": "sector_2",
    "Sector3Time": "sector_3",
    "PitInTime": "pit_in_time",
    "PitOutTime": "pit_out_time",
    "AirTemp": "air_temp",
    "TrackTemp": "track_temp",
    "WindSpeed": "wind_speed",
    "Humidity": "humidity",
    "Rainfall": "rainfall",
    "TrackStatus": "track_status",
}

# Canonical columns that hold seconds.
DURATION_COLUMNS = (
    "lap_time_seconds",
    "sector_1",
    "sector_2",
    "sector_3",
    "pit_in_time",
    "pit_out_time",
    "pit_loss_seconds",
    "gap_to_leader",
    "gap_to_car_in_front",
)
INTEGER_COLUMNS = ("driver_number", "lap_number", "tyre_life", "stint_number", "position")
WEATHER_COLUMNS = ("air_temp", "track_temp", "wind_speed", "humidity")
# The digit of a track status that stands for each incident.
INCIDENTS = {"is_yellow_flag": "2", "is_safety_car_lap": "4", "is_red_flag": "5"}

RACES_SCHEMA = T.StructType(
    [
        T.StructField("race_id", T.LongType()),
        T.StructField("session_key", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("race_name", T.StringType()),
        T.StructField("circuit_name", T.StringType()),
        T.StructField("session_date", T.TimestampType()),
        T.StructField("num_drivers", T.LongType()),
        T.StructField("num_laps", T.LongType()),
    ]
)

LAPS_SCHEMA = T.StructType(
    [
        T.StructField("race_id", T.LongType()),
        T.StructField("session_key", T.StringType()),
        T.StructField("driver_number", T.LongType()),
        T.StructField("driver_code", T.StringType()),
        T.StructField("team_name", T.StringType()),
        T.StructField("lap_number", T.LongType()),
        T.StructField("lap_time_seconds", T.DoubleType()),
        T.StructField("sector_1", T.DoubleType()),
        T.StructField("sector_2", T.DoubleType()),
        T.StructField("sector_3", T.DoubleType()),
        T.StructField("is_pit_lap", T.BooleanType()),
        T.StructField("pit_in_time", T.DoubleType()),
        T.StructField("pit_out_time", T.DoubleType()),
        T.StructField("pit_loss_seconds", T.DoubleType()),
        T.StructField("tyre_compound", T.StringType()),
        T.StructField("tyre_compound_raw", T.StringType()),
        T.StructField("tyre_life", T.LongType()),
        T.StructField("stint_number", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("position_text", T.StringType()),
        T.StructField("gap_to_leader", T.DoubleType()),
        T.StructField("gap_to_car_in_front", T.DoubleType()),
        T.StructField("air_temp", T.DoubleType()),
        T.StructField("track_temp", T.DoubleType()),
        T.StructField("wind_speed", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("rainfall", T.BooleanType()),
        T.StructField("track_status", T.StringType()),
        T.StructField("is_safety_car_lap", T.BooleanType()),
        T.StructField("is_yellow_flag", T.BooleanType()),
        T.StructField("is_red_flag", T.BooleanType()),
        T.StructField("circuit_name", T.StringType()),
        T.StructField("lap_time_outlier", T.BooleanType()),
    ]
)
