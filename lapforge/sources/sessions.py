"""A Spark data source of session files: spark.read.format("lap_sessions").

Under the option path lie sessions <year>-<round>.parquet, .json (a record a line) or .csv (with a
header), each a file or a folder of files. Options years and rounds (comma-separated) name the
sessions to read, every combination of them; without them, all that the folder lists. A session is
one partition, and is read by one task as a whole: either all of its rows come out, or one row that
tells why not (kind missing or unreadable, failure the message), so a damaged file stops nothing.
A session without rows gives none.

Every cell is text, whatever a file stores (durations as seconds), under the canonical column names;
normalize_laps reads the text. row_id is the row's place in its session. Paths may be URIs of any file
system that pyarrow knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import LAPS_SCHEMA, RAW_TO_CANONICAL

FORMAT = "lap_sessions"
KINDS = ("parquet", "json", "csv")
_OWN = ("session_key", "race_id")
#: What a session's file may say of its race.
RACE_TEXT = ("race_name", "circuit_name", "session_date")
TEXT_COLUMNS = tuple(dict.fromkeys([f.name for f in LAPS_SCHEMA if f.name not in _OWN] + list(RACE_TEXT)))
SCHEMA = "session_key string, year int, round int, row_id long, kind string, failure string, " + ", ".join(f"{c} string" for c in TEXT_COLUMNS)
_ARROW = pa.schema(
    [("session_key", pa.string()), ("year", pa.int32()), ("round", pa.int32()), ("row_id", pa.int64()), ("kind", pa.string()), ("failure", pa.string())]
    + [(c, pa.string()) for c in TEXT_COLUMNS]
)


def session_key(year: int, number: int) -> str:
    """The key of a session: year and round."""
    return f"{year}-{number}"


class SessionPartition(InputPartition):
    def __init__(self, year: int, number: int):
        super().__init__((year, number))
        self.year, self.number = year, number


def _file_system(path: str):
    """(file system, path in it); a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(file_system, path: str) -> list[str]:
    """The data files of a file or folder; empty if there is nothing."""
    from pyarrow import fs

    found = file_system.get_file_info(path)
    if found.type == fs.FileType.File:
        return [path]
    if found.type == fs.FileType.NotFound:
        return []
    inside = file_system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(f.path for f in inside if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _table(file_system, path: str, kind: str) -> pa.Table:
    with file_system.open_input_file(path) as file:
        if kind == "parquet":
            import pyarrow.parquet

            return pyarrow.parquet.read_table(file)
        if kind == "json":
            import pyarrow.json

            return pyarrow.json.read_json(file) if file.size() else pa.table({})
        import pandas

        return pa.Table.from_pandas(pandas.read_csv(file, dtype=str), preserve_index=False) if file.size() else pa.table({})


def as_text(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """Cells as text; durations in seconds."""
    import pyarrow.compute as pc

    if pa.types.is_duration(column.type):
        column = pc.divide(pc.cast(pc.cast(column, pa.duration("us"), safe=False), pa.int64()).cast(pa.float64()), 1e6)
    return column.cast(pa.string()) if not pa.types.is_null(column.type) else pa.chunked_array([pa.nulls(len(column), pa.string())])


def read_session(path: str, year: int, number: int) -> pa.Table:
    """The rows of a session, or one row of its failure."""
    key = session_key(year, number)
    try:
        file_system, root = _file_system(path)
        for kind in KINDS:
            if files := _files(file_system, f"{root.rstrip('/')}/{key}.{kind}"):
                break
        else:
            return _failed(key, year, number, "missing", f"no session {key} under {path}")
        parts = []
        for file in files:
            table = _table(file_system, file, kind)
            named = {RAW_TO_CANONICAL.get(c, c): c for c in table.column_names}
            columns = {c: as_text(table.column(named[c])) if c in named else pa.nulls(len(table), pa.string()) for c in TEXT_COLUMNS}
            parts.append(pa.table(columns))
        text = pa.concat_tables(parts)
    except Exception as error:  # whatever a damaged file raises is told, not passed on
        return _failed(key, year, number, "unreadable", f"{type(error).__name__}: {str(error)[:500]}")
    n = len(text)
    same = lambda value, kind: pa.array([value] * n, kind)
    own = [same(key, pa.string()), same(year, pa.int32()), same(number, pa.int32()), pa.array(range(n), pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
    return pa.table([*own, *text.columns], schema=_ARROW)


def _failed(key: str, year: int, number: int, kind: str, failure: str) -> pa.Table:
    row = {"session_key": key, "year": year, "round": number, "kind": kind, "failure": failure}
    return pa.Table.from_pylist([row], schema=_ARROW)


class SessionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        numbers = lambda name: [int(x) for x in options[name].split(",")] if options.get(name) else None
        self.years, self.rounds = numbers("years"), numbers("rounds")

    def _listed(self) -> list[tuple[int, int]]:
        from pyarrow import fs

        file_system, root = _file_system(self.path)
        names = [f.base_name for f in file_system.get_file_info(fs.FileSelector(root))]
        found = {(int(m[1]), int(m[2])) for x in names if (m := re.fullmatch(rf"(\d+)-(\d+)\.({'|'.join(KINDS)})", x))}
        return sorted((y, r) for y, r in found if (self.years is None or y in self.years) and (self.rounds is None or r in self.rounds))

    def partitions(self) -> list[SessionPartition]:
        whole = self.years is not None and self.rounds is not None
        return [SessionPartition(*x) for x in (product(self.years, self.rounds) if whole else self._listed())]

    def read(self, partition: SessionPartition) -> Iterator[pa.RecordBatch]:
        yield from read_session(self.path, partition.year, partition.number).to_batches(max_chunksize=10_000)


class SessionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SessionReader:
        return SessionReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SessionSource)
