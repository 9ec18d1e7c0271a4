"""Tables written once to the folder that all executors share, and read back.

Staging cuts the lineage: what a plan reads from a staged table isn't computed again by a second use, and
a lost executor loses nothing. spark.checkpoint.dir names the folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

#: (thread, folder) of the staged tables that this driver hasn't dropped, oldest first.
_staged: dict[str, tuple[int, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. In local mode alone, where
    every executor is this process, an unset folder becomes a private one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lapforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back. Tables that no later plan reads go with
    drop_stage; the owner of the folder clears the rest."""
    tag = f"lapforge-{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{tag}/{name}"
    _staged[tag] = get_ident(), path
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CHEAP = {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD", "Range", "OneRowRelation", "Union", "SubqueryAlias", "RelationV2"}


def settled(df: DataFrame, name: str) -> DataFrame:
    """df if its plan only reads, filters and projects stored rows; else df staged, for callers that use it
    several times."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+\-]*(\w+)", line))}
    return df if nodes <= _CHEAP else stage(df, name)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)
            _staged.pop(folder.split("/")[-2], None)


def staged_so_far() -> frozenset[str]:
    """A mark for drop_since."""
    return frozenset(_staged)


def drop_since(spark: SparkSession, before: frozenset[str], keep_last: bool = True) -> None:
    """Delete what this thread staged since the mark; keep_last: but for the table staged last."""
    mine = [t for t, (thread, _) in _staged.items() if t not in before and thread == get_ident()]
    for tag in mine[: len(mine) - keep_last]:
        _delete(spark, _staged.pop(tag)[1])
