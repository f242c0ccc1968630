"""Months as plain integers: year * 12 + month - 1, null for missing. YYYYMM only in files, with 0 for missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def to_ym(m: Column) -> Column:
    return F.coalesce(F.floor(m / 12) * 100 + F.pmod(m, F.lit(12)) + 1, F.lit(0)).cast("int")


def from_ym(ym: Column) -> Column:
    return F.when(ym > 0, (F.floor(ym / 100) * 12 + F.pmod(ym, F.lit(100)) - 1).cast("int"))


def month(year: int, month: int) -> int:
    return year * 12 + month - 1


@dataclass(frozen=True)
class Calendar:
    """The constants of a collection of records, all months inclusive."""

    first: int = month(1995, 1)  # records are expected from here
    last: int = month(2001, 12)  # no decision after this counts when ends are sought
    base_year: int = 2000  # ends are measured against this year's decisions
    level_from: int = month(2000, 1)  # filings from here to complete_by give the full level
    complete_by: int = month(2001, 6)
    decisions_from: int = month(1995, 7)  # windows that start earlier need no decisions
    horizon: int = 120
    least_risk: int = 20


CALENDAR = Calendar()
