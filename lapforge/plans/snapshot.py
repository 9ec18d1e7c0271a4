"""Publishing validated laps as numbered versions.

A snapshot is a commit (see sources.commits): <root>/data/<stamp>/laps.parquet with its report and meta
beside it, and an entry of the log that makes it version n. The last entry is the live one, so a reader
always finds a whole snapshot, and of two publishers at once each makes a version of its own. Frames that
fail validation leave only a report under <root>/rejected/. Files are written through Hadoop's file
system, so root may be on any store Spark can reach.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..operators.validation import ValidationConfig, ValidationReport, validate_laps
from ..sources.commits import CommitLog, put_text, read_text


def publish(laps: DataFrame, root: str, meta: dict | None = None, config: ValidationConfig | None = None) -> ValidationReport:
    """Validate and, if that passes, make laps the live snapshot."""
    spark = laps.sparkSession
    report = validate_laps(laps, config)
    now = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    stamp = f"{now}-{uuid.uuid4().hex[:8]}"
    if not report.passed:
        put_text(spark, f"{root}/rejected/{stamp}/validation_report.json", report.to_json())
        return report
    folder = f"{root}/data/{stamp}"
    laps.write.parquet(f"{folder}/laps.parquet")
    put_text(spark, f"{folder}/validation_report.json", report.to_json())
    put_text(spark, f"{folder}/meta.json", json.dumps((meta or {}) | {"published_at": now}, sort_keys=True))
    CommitLog(spark, root).commit(stamp, {"published_at": now})
    return report


def load_snapshot(spark: SparkSession, root: str, number: int | None = None) -> tuple[DataFrame, dict]:
    """(laps, meta) of the live snapshot, or of a version by number; meta has the version. FileNotFoundError
    if there is none."""
    log = CommitLog(spark, root)
    entry = log.entry(number)
    if entry is None:
        raise FileNotFoundError(f"no snapshot under {root}" if number is None else f"no version {number} under {root}")
    folder = log.folder(entry["number"])
    meta = json.loads(read_text(spark, f"{folder}/meta.json") or "{}")
    return spark.read.parquet(f"{folder}/laps.parquet"), meta | {"version": entry["number"]}
