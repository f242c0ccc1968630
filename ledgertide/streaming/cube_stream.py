"""Incremental cubes: counts by district and month from a stream of case rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.functions.calendar import month_of


def streaming_cube(cases: DataFrame, filed: str = "filed", decided: str = "decided", district: str = "district") -> DataFrame:
    """(district, f, d, n) in update mode: each changed cell is emitted with its new count."""
    rows = cases.select(district, month_of(F.col(filed)).alias("f"), month_of(F.col(decided)).alias("d")).where("f is not null and (d is null or d >= f)")
    return rows.groupBy(district, "f", "d").agg(F.count("*").alias("n"))


def listing_windows(events: DataFrame, at: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, by, n) of listings, closed once the watermark has passed."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
