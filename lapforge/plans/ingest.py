"""Ingest: session files to stored laps and races.

One scan reads the sessions; one job normalizes them, counting the cells it can't read on the way;
races are merged into the race table, which gives the laps their race_id; a session that is ingested again
replaces itself. Sessions that can't be read are told, and stop nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession

from ..operators.cleaning import normalize_laps
from ..operators.validation import ValidationReport, validate_laps
from ..sources.laps import fetch_seasons, load_star, read_laps, write_laps
from ..sources.races import append_races, race_candidates, read_races, with_race_ids
from ..staging import drop_since, stage, staged_so_far


@dataclass(frozen=True)
class IngestReport:
    """races and laps stored, errors: sessions that failed or weren't there; cells that couldn't be read,
    by column; what validation says of the laps."""

    races: int
    laps: int
    errors: int
    unreadable: dict[str, int] = field(default_factory=dict)
    failures: list[dict] = field(default_factory=list)
    validation: ValidationReport | None = None

    def to_dict(self) -> dict:
        told = asdict(self) | {"validation": self.validation and self.validation.to_dict()}
        return told


def laps_path(root: str) -> str:
    return f"{root.rstrip('/')}/laps"


def races_path(root: str) -> str:
    return f"{root.rstrip('/')}/races"


def ingest(spark: SparkSession, source: str, target: str, years: Sequence[int], rounds: Sequence[int], validate: bool = True) -> IngestReport:
    """Sessions of years x rounds under source into the tables under target."""
    mark = staged_so_far()
    try:
        raw, failed = fetch_seasons(spark, source, years, rounds)
    except ValueError:
        return IngestReport(0, 0, len(list(years)) * len(list(rounds)))
    counted = Observation("unreadable")
    laps = stage(normalize_laps(raw, observation=counted), "normalized")
    seen = dict(counted.get)
    candidates = stage(race_candidates(laps), "candidates")
    laps = with_race_ids(laps, candidates, append_races(candidates, races_path(target)))
    write_laps(laps, laps_path(target))
    failures = [r.asDict() for r in failed.orderBy("year", "round").collect()]  # a row a session
    report = IngestReport(
        candidates.count(), seen.pop("rows"), len(failures), {c: n for c, n in seen.items() if n}, failures, validate_laps(laps) if validate else None
    )
    drop_since(spark, mark, keep_last=False)
    return report


def stored_star(spark: SparkSession, target: str, years: Sequence[int] | None = None) -> DataFrame:
    """The stored laps of some years with their races; files of other sessions aren't read."""
    return load_star(read_laps(spark, laps_path(target)), read_races(spark, races_path(target)), years)
