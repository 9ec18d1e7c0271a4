"""Scalar functions as Spark columns; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import COMPOUND_ALIASES, UNKNOWN_COMPOUND

UNIT_SCALE = {"auto": 1.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
_CLOCK = r"^\s*(?:(\d+):)?(\d{1,2})(?:\.(\d{1,6}))?\s*$"


def nan_to_null(c: Column) -> Column:
    """NaN is a missing value; infinities stay for the finite checks."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clock_seconds(text: Column) -> Column:
    """Seconds of "m:ss.ffffff" (minutes and fraction optional), null for other strings."""
    part = lambda i: F.nullif(F.regexp_extract(text, _CLOCK, i), F.lit(""))
    minutes = F.coalesce(part(1).cast("double"), F.lit(0.0))
    digits = part(3)
    fraction = F.coalesce(digits.cast("double") / F.pow(F.lit(10.0), F.length(digits)), F.lit(0.0))
    return F.when(text.rlike(_CLOCK), minutes * 60 + part(2).cast("double") + fraction)


def to_seconds(value: Column, kind: T.DataType, unit: str = "auto") -> Column:
    """A duration of any raw type in seconds. Clock strings are read before the unit applies:
    "45" in unit ms is 45 s. What can't be read is null."""
    if unit not in UNIT_SCALE:
        raise ValueError(f"unknown unit {unit!r}")
    if isinstance(kind, T.DayTimeIntervalType):
        return value.cast("interval second").cast("decimal(18,6)").cast("double")
    if isinstance(kind, T.StringType):
        other = value.try_cast("double") * UNIT_SCALE[unit]
        return nan_to_null(F.coalesce(clock_seconds(value), other))
    return nan_to_null(value.cast("double") * UNIT_SCALE[unit])


def normalize_compound(raw: Column) -> Column:
    """The canonical compound; UNKNOWN for null, blank and unknown spellings."""
    pairs = [F.lit(x) for pair in COMPOUND_ALIASES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(F.trim(raw))), F.lit(UNKNOWN_COMPOUND))


def known_compound(raw: Column) -> Column:
    """Whether the vocabulary has this spelling; null and blank have none to know."""
    name = F.upper(F.trim(raw))
    return name.isNull() | (name == "") | name.isin(*COMPOUND_ALIASES)


def to_boolean(c: Column, kind: T.DataType) -> Column:
    """True, false, or null for what is neither; numbers other than 0 are true."""
    if isinstance(kind, T.StringType):
        return F.coalesce(c.try_cast("boolean"), nan_to_null(c.try_cast("double")) != 0)
    return c.cast("boolean")


def to_integer(c: Column) -> Column:
    """Numbers in any form as long; null if not numeric. A number with a fraction (or too large)
    fails the job, as a lap 3.7 that became lap 3 would repeat another."""
    x = nan_to_null(c.try_cast("double"))
    whole = (F.abs(x) < 2.0**63) & (x == F.floor(x))
    return F.when(x.isNull() | whole, x.try_cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), x.cast("string"))).cast("long"))


def psi_severity(psi: Column) -> Column:
    return F.when(psi < 0.10, "stable").when(psi < 0.25, "moderate").when(psi.isNotNull(), "significant")


def action_label(p: Column, threshold: float) -> Column:
    """What to do at probability p, given the decision threshold."""
    return (
        F.when(p < 0.7 * threshold, "Unlikely near-term").when(p < threshold, "Monitor").otherwise("Investigate pit window")
    )
