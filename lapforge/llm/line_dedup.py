"""Line dedup: drop lines whose normalised form occurs in many documents.

Method: explode normalised lines, hash, count the distinct documents of each hash, drop
the lines over the threshold and reassemble the rest by position.

Defined results: a null or empty text is one empty line and is never dropped (its key has
no code point); a null text stays null. Every row counts as a document of its own, also
if its id is null or repeated. An empty table gives an empty table. Columns other than the
text come through untouched, whatever their names (__n_lines and __n_dropped give way to the
counts).

Plan: the text is read twice. The first pass writes 8 bytes a line. Counting aggregates
before its shuffle, so a line that every document has costs one row a task. Positions to
drop go back to their document by (id, text hash), which spreads groups of copies; they are
staged, so that Spark splits rows that repeat both and may broadcast a table small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, broadcast_if_small, lower_ascii, stage

#: Frequent-line hashes are broadcast up to this count (8 bytes each), else shuffled.
MAX_BROADCAST = 200_000


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(WS_CHARS)))


def _hashes(text: Column, min_chars: int) -> Column:
    """A 64-bit hash for each line's key, null for keys too short to count."""
    keys = F.transform(split_lines(text), line_key)
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.xxhash64(k)))


def line_dedup(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with the text rebuilt from the lines that stay, and __n_lines (before) and
    __n_dropped. A key of at least min_chars code points found in at least min_docs
    documents loses all its lines everywhere."""
    text = F.col(text_col)
    lines = stage(
        docs.select(
            F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), _hashes(text, min_chars).alias("hs")
        ),
        "lines",
    )
    frequent = (
        lines.select(F.explode(F.array_distinct("hs")).alias("h"))
        .where("h is not null")
        .groupBy("h")
        .count()
        .where(F.col("count") >= min_docs)
        .select("h")
    )
    frequent = broadcast_if_small(stage(frequent, "frequent"), MAX_BROADCAST)
    drops = (
        lines.select("id", "th", F.posexplode("hs").alias("pos", "h"))
        .join(frequent, "h", "left_semi")
        .groupBy("id", "th")
        .agg(F.sort_array(F.collect_set("pos")).alias("drop"))
        .select(F.col("id").alias("d_id"), F.col("th").alias("d_th"), "drop")
    )
    drops = stage(drops, "drops")
    columns = [c for c in docs.columns if c not in ("__n_lines", "__n_dropped")]
    rows = docs.select(F.struct(*columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("th"))  # names can't clash then
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("th") == F.col("d_th")), "left")
    text = F.col("row")[text_col]
    joined = joined.select("row", "drop", split_lines(text).alias("lines"))  # split once: the functions below refer to the column
    # the runs of lines between dropped ones, so that a text takes time in proportion to its lines
    ends = F.zip_with(F.concat(F.array(F.lit(-1)), "drop"), F.concat("drop", F.array(F.size("lines"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = F.transform(F.filter(ends, lambda e: e["b"] - e["a"] > 1), lambda e: F.slice("lines", e["a"] + 2, e["b"] - e["a"] - 1))
    rest = F.array_join(F.flatten(runs), "\n")
    return joined.select(
        *[F.when(F.col("drop").isNotNull(), rest).otherwise(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns],
        F.size("lines").cast("long").alias("__n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("__n_dropped"),
    )
