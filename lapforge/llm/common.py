"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words (ASCII only), as a Java pattern and as characters.
WS_PATTERN = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_PATTERN), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the cheaper built-in lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


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
    """Write df to the shared folder and read it back: work is done once, the lineage is
    cut, and a lost executor loses nothing. Tables that no later plan reads go with
    drop_stage; the owner of the folder clears the rest."""
    tag = f"lapforge-{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{tag}/{name}"
    _staged[tag] = path
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The folders of staged tables that this driver hasn't dropped, oldest first.
_staged: dict[str, str] = {}


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


def drop_since(spark: SparkSession, before: frozenset[str]) -> None:
    """Delete what was staged since the mark on the way to the table staged last, which stays."""
    for tag in [t for t in _staged if t not in before][:-1]:
        _delete(spark, _staged.pop(tag))


def document_key(id_col: str, text_col: str) -> Column:
    """What names a document: its id (a long), or a hash of its text if it has none."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("text"), F.col(text_col)))


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df (a staged table, so that counting is cheap) with a broadcast hint if it has at
    most max_rows rows; else df, and Spark shuffles the join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def least_hashed(rows: DataFrame, sample: int, total: int, rank: str, *ties: str) -> DataFrame:
    """The sample of rows (a staged table of total rows) with the least rank, a 64-bit hash;
    equal ranks go by ties. Exact at every size: the rows under a threshold that holds more
    than enough evenly spread hashes, raised until it holds enough of these, are sorted."""
    if total <= sample:
        return rows
    share = 1.1 * sample / total
    while share < 1:
        low = rows.where(F.col(rank) <= int(share * 2**64) - 2**63)
        if low.count() >= sample:
            rows = low
            break
        share *= 2
    return rows.orderBy(rank, *ties).limit(sample)
