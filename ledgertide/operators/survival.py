"""Kaplan-Meier curves with delayed entry, from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions.calendar import CALENDAR, Calendar
from ledgertide.operators.records import collection_month


def spells(cube: DataFrame, cuts: DataFrame, entries: DataFrame | None = None, cal: Calendar = CALENDAR) -> DataFrame:
    """The cube's rows that enter a risk set, with dur, ent, event; cuts (district, cut), entries (district, entry).

    Rows without a cut or filed after it are dropped; a decision after the cut counts as none; with entries, districts
    that are never complete are dropped, and rows that end before they enter.
    """
    rows = cube.join(cuts.select("district", "cut"), "district").where("cut is not null and f <= cut")
    event = F.col("d").isNotNull() & (F.col("d") <= F.col("cut"))
    clip = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(cal.horizon))
    rows = rows.withColumn("event", event.cast("int")).withColumn("dur", clip(F.when(event, F.col("d")).otherwise(F.col("cut")) - F.col("f")))
    if entries is None:
        return rows.withColumn("ent", F.lit(0))
    rows = rows.join(entries.select("district", "entry"), "district").where("entry is not null")
    return rows.withColumn("ent", clip(F.col("entry") - F.col("f"))).where("dur >= ent")


def curves(rows: DataFrame, unit: list[str], cal: Calendar = CALENDAR, min_cases: int = 1) -> DataFrame:
    """(*unit, m, at_risk, dec, s, var, cases, reach) for m in 0..horizon; reach is the last month with enough at risk.

    Rows are first summed to at most (horizon + 1) ** 2 counts for each unit, and only these are laid on the grid.
    """
    sums = rows.groupBy(*unit, "dur", "ent").agg(F.sum(F.col("n") * F.col("event")).alias("dec"), F.sum("n").alias("n"))
    moves = sums.select(*unit, F.explode(F.array(F.struct(F.col("dur").alias("m"), "dec", F.col("n").alias("out"), (F.col("n") * 0).alias("come")), F.struct(F.col("ent").alias("m"), (F.col("dec") * 0).alias("dec"), (F.col("n") * 0).alias("out"), F.col("n").alias("come")))).alias("x")).select(*unit, "x.*")
    moves = moves.groupBy(*unit, "m").agg(F.sum("dec").alias("dec"), F.sum("out").alias("out"), F.sum("come").alias("come"))
    units = moves.groupBy(*unit).agg(F.sum("out").alias("cases")).where(F.col("cases") >= min_cases)
    grid = units.select(*unit, "cases", F.explode(F.sequence(F.lit(0), F.lit(cal.horizon))).alias("m"))
    dense = grid.join(moves, [*unit, "m"], "left").fillna(0, ["dec", "out", "come"])
    upto = Window.partitionBy(*unit).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    risk = F.sum("come").over(upto) - F.sum("out").over(upto) + F.col("out")
    dense = dense.withColumn("at_risk", risk)
    hazard = F.when(F.col("at_risk") > 0, F.col("dec") / F.col("at_risk")).otherwise(0.0)
    greenwood = F.when((F.col("at_risk") > 0) & (F.col("at_risk") > F.col("dec")), F.col("dec") / (F.col("at_risk") * (F.col("at_risk") - F.col("dec")))).otherwise(0.0)
    every = Window.partitionBy(*unit)
    reach = F.coalesce(F.min(F.when(F.col("at_risk") < cal.least_risk, F.col("m"))).over(every) - 1, F.lit(cal.horizon))
    out = dense.withColumn("h", hazard).withColumn("g", greenwood).withColumn("s", F.product(1 - F.col("h")).over(upto))
    return out.withColumn("var", F.col("s") * F.col("s") * F.sum("g").over(upto)).withColumn("reach", reach).select(*unit, "m", "at_risk", "dec", "s", "var", "cases", "reach")


def table_of(curve: DataFrame, unit: list[str]) -> DataFrame:
    """One row for each unit: cases, median and 90 % months, reach, shares pending after 1, 3, 5 years, 95 % bounds at 3.

    Shares are compared at 12 decimals, so a share of exactly a half counts as reached however it was multiplied.
    """
    ok = F.col("m") <= F.col("reach")
    first = lambda share: F.min(F.when(ok & (F.round("s", 12) <= share), F.col("m")))
    at = lambda m, x="s": F.max(F.when(ok & (F.col("m") == m), F.col(x)))
    wide = 1.96 * F.sqrt(at(36, "var"))
    bounds = [F.greatest(at(36) - wide, F.lit(0.0)), F.least(at(36) + wide, F.lit(1.0))]
    points = F.array_sort(F.collect_list(F.when(F.col("m") % 3 == 0, F.struct("m", F.when(ok, F.col("s")).alias("s")))))
    text = F.array_join(F.transform(points, lambda x: F.when(x["s"].isNull(), "").otherwise(F.format_string("%.3f", x["s"]))), " ")
    return curve.groupBy(*unit).agg(
        F.max("cases").alias("cases"), first(0.5).alias("median_months"), first(0.1).alias("p90_months"), F.max("reach").alias("followed_months"),
        at(12).alias("pending_1y"), at(36).alias("pending_3y"), at(60).alias("pending_5y"),
        F.when(at(36).isNotNull(), bounds[0]).alias("pending_3y_lo"), F.when(at(36).isNotNull(), bounds[1]).alias("pending_3y_hi"), text.alias("curve"),
    )


def time_to_decision(cube: DataFrame, unit: list[str], entries: DataFrame | None = None, min_cases: int = 200, cal: Calendar = CALENDAR) -> DataFrame:
    """Survival by unit; a pooled unit keeps every district's own cut and entry."""
    return table_of(curves(spells(cube, collection_month(cube, cal=cal), entries, cal), unit, cal, min_cases), unit)


def decided_only(cube: DataFrame, entries: DataFrame | None = None, cal: Calendar = CALENDAR) -> DataFrame:
    """(case_type, decided_cases, median_months, mean_months) of cases decided by their cut; the median is the lower one."""
    rows = cube.join(collection_month(cube, cal=cal).select("district", "cut"), "district").where("cut is not null and f <= cut and d <= cut")
    if entries is not None:
        rows = rows.join(entries, "district").where("f >= entry")
    by = rows.groupBy("case_type", F.greatest(F.col("d") - F.col("f"), F.lit(0)).alias("m")).agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("case_type").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("upto", F.sum("n").over(upto)).withColumn("every", F.sum("n").over(Window.partitionBy("case_type")))
    return by.groupBy("case_type").agg(F.sum("n").alias("decided_cases"), F.min(F.when(F.col("upto") * 2 >= F.col("every"), F.col("m"))).alias("median_months"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean_months"))
