"""Command line: python -m lapforge.cli COMMAND. Exit status 1 where a check fails.

  view FILE [--as-of DAY] [--check]  write the SQL of the metrics view, or check that FILE is up to date
  artifacts FOLDER                   check a saved model with its metrics and test rows
  notes FOLDER                       release notes of a saved model's metrics
  ingest SOURCE TARGET [--years ...] [--rounds ...]
                                     session files into the lap and race tables under TARGET
  train TARGET FOLDER [--train-years ...] [--test-years ...] [--model NAME]
                                     cross-validate, fit, tune, gate and save a model of the stored laps
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date
from pathlib import Path


def check_view(path: str, when: date | None = None, check: bool = False) -> int:
    from .operators.metrics import metrics_view_sql

    sql, file = metrics_view_sql(when=when) + ";\n", Path(path)
    if not check:
        file.write_text(sql)
        return 0
    if file.exists() and file.read_text() == sql:
        print(f"{path} is up to date")
        return 0
    print(f"{path} is {'stale' if file.exists() else 'missing'}: write it again", file=sys.stderr)
    return 1


def check_artifacts(folder: str) -> int:
    from pyspark.sql import SparkSession

    from .plans.training import load_artifacts

    try:
        load_artifacts(SparkSession.builder.getOrCreate(), folder)
    except Exception as error:  # whatever is wrong with an artifact refuses it
        print(f"refused: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1
    print("artifacts are sound")
    return 0


def run_ingest(source: str, target: str, years: list[int], rounds: list[int]) -> int:
    """0 if any session came in."""
    from pyspark.sql import SparkSession

    from .plans.ingest import ingest

    report = ingest(SparkSession.builder.getOrCreate(), source, target, years, rounds)
    print(f"{report.races} races, {report.laps} laps, {report.errors} errors")
    for f in report.failures:
        print(f"{f['session_key']}: {f['kind']}: {f['failure']}", file=sys.stderr)
    for column, n in report.unreadable.items():
        print(f"{column}: {n} cells couldn't be read", file=sys.stderr)
    if report.validation is not None and not report.validation.passed:
        print(report.validation.summary(), file=sys.stderr)
    return 0 if report.races else 1


def run_train(target: str, folder: str, train_years: list[int], test_years: list[int], model: str) -> int:
    from pyspark.sql import SparkSession

    from .plans.ingest import stored_star
    from .plans.training import release_notes, train

    try:
        laps = stored_star(SparkSession.builder.getOrCreate(), target, train_years + test_years)
        print(release_notes(train(laps, folder, train_years, test_years, model)))
    except (ValueError, FileNotFoundError) as error:
        print(f"no model: {error}", file=sys.stderr)
        return 1
    return 0


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lapforge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    view = commands.add_parser("view")
    view.add_argument("file")
    view.add_argument("--as-of", type=date.fromisoformat)
    view.add_argument("--check", action="store_true")
    for name in ("artifacts", "notes"):
        commands.add_parser(name).add_argument("folder")
    get = commands.add_parser("ingest")
    get.add_argument("source")
    get.add_argument("target")
    get.add_argument("--years", type=_numbers, default=list(range(2018, 2025)))
    get.add_argument("--rounds", type=_numbers, default=list(range(1, 25)))
    fit = commands.add_parser("train")
    fit.add_argument("target")
    fit.add_argument("folder")
    fit.add_argument("--train-years", type=_numbers, default=list(range(2018, 2024)))
    fit.add_argument("--test-years", type=_numbers, default=[2024])
    fit.add_argument("--model", default="gradient_boosting")
    asked = parser.parse_args(argv)
    if asked.command == "ingest":
        return run_ingest(asked.source, asked.target, asked.years, asked.rounds)
    if asked.command == "train":
        return run_train(asked.target, asked.folder, asked.train_years, asked.test_years, asked.model)
    if asked.command == "view":
        return check_view(asked.file, asked.as_of, asked.check)
    if asked.command == "artifacts":
        return check_artifacts(asked.folder)
    from .plans.training import release_notes

    print(release_notes(json.loads(Path(asked.folder, "metrics.json").read_text())))
    return 0


if __name__ == "__main__":
    sys.exit(main())
