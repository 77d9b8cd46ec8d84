"""Idle-gap sessions, computed from pre-aggregated slices so that a hot key never meets one task as raw rows.

Rows of a key in one slice of width <= gap cannot be more than the gap apart, so a slice never needs splitting.
The raw rows are therefore aggregated per (key, slice) with map-side combine, and only the slices (at most one
per key and gap length) are ordered to find the session starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slices(df: DataFrame, keys: list[str], gap_us: Column | int, aggs: list[Column], ts: str = "ts_us") -> DataFrame:
    """Per (keys, slice): first and last time plus the given aggregates."""
    gap = gap_us if isinstance(gap_us, Column) else F.lit(gap_us)
    slice_no = F.floor(F.col(ts) / gap).cast("bigint") if isinstance(gap_us, Column) else (
        (F.col(ts) - F.pmod(F.col(ts), gap)) / gap).cast("bigint")
    return df.groupBy(*keys, slice_no.alias("slice")).agg(
        F.min(ts).alias("slice_first"), F.max(ts).alias("slice_last"), *aggs
    )


def session_starts(sl: DataFrame, keys: list[str], gap_us: Column | int) -> DataFrame:
    """Adds ``session_us``, the time of the first row of the session the slice belongs to."""
    gap = gap_us if isinstance(gap_us, Column) else F.lit(gap_us)
    w = Window.partitionBy(*keys).orderBy("slice")
    prev = F.lag("slice_last").over(w)
    opens = prev.isNull() | (F.col("slice_first") - prev > gap)
    return sl.withColumn("_open", F.when(opens, F.col("slice_first"))).withColumn(
        "session_us", F.max("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_open")
