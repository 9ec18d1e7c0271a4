"""Vectors in columns: which count, as whole numbers, and sums over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_whole(vector: Column) -> Column:
    """Not null, and no entry null, NaN or infinite."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda c: F.coalesce(odd(c.cast("double")), F.lit(True)))


def scaled(vector: Column, by: float, limit: int, add: int = 0) -> Column:
    """Each entry c, as a double, as the long floor(by * c) + add; the floor is kept within +-limit."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * by, F.lit(float(limit))), F.lit(float(-limit)))) + F.lit(add))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one array."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], column: str = "x", kind: str = "double") -> np.ndarray:
    """The sum over all rows of part(block of rows), a flat array of fixed length. A task adds up
    its own rows first; what reaches the driver is one number for each place. Empty if rows is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = np.asarray(part(matrix(batch.column(0)))).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["part"])

    parts = rows.select(column).mapInArrow(run, f"part array<{kind}>")
    sums = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    return sums.column("v").to_numpy()[np.argsort(sums.column("at").to_numpy())]
