"""Where a district's records begin and end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions.calendar import CALENDAR, Calendar


def _ends(cube: DataFrame, unit: str, frac: float, per_year: bool, cal: Calendar) -> DataFrame:
    """The last month whose decisions reach frac of the base year's mean, over all 12 months or those with decisions."""
    base0 = cal.base_year * 12
    per = cube.where(F.col("d").between(base0, cal.last)).groupBy(unit, "d").agg(F.sum("n").alias("n"))
    in_base = F.when(F.col("d") < base0 + 12, F.col("n"))
    level = F.sum(in_base) / 12 if per_year else F.avg(in_base)
    base = per.groupBy(unit).agg(level.alias("level"))
    return per.join(base, unit).where((F.col("level") > 0) & (F.col("n") >= frac * F.col("level"))).groupBy(unit).agg(F.max("d").alias("end"))


def state_collection_month(cube: DataFrame, frac: float = 0.2, cal: Calendar = CALENDAR) -> DataFrame:
    """(state, end); the level is the mean over base-year months that have decisions."""
    return _ends(cube, "state", frac, False, cal)


def collection_month(cube: DataFrame, frac: float = 0.5, state_frac: float = 0.2, cal: Calendar = CALENDAR) -> DataFrame:
    """(state, district, cut): the district's own end, a twelfth of the base year as level, no later than its state's."""
    own = _ends(cube, "district", frac, True, cal).withColumnRenamed("end", "own")
    units = cube.select("state", "district").distinct()
    return units.join(state_collection_month(cube, state_frac, cal), "state", "left").join(own, "district", "left").select("state", "district", F.least("end", "own").alias("cut"))


def completeness_month(cube: DataFrame, share: float = 0.5, decision_share: float = 0.2, width: int = 6, cal: Calendar = CALENDAR) -> DataFrame:
    """(district, entry): the first month from which every window of `width` months holds at least share of the later
    filing level and, from cal.decisions_from, decisions of decision_share of its filings. Null if there is none.

    Only districts with a filing in the range are listed, as a district without has no row on the grid.
    """
    span = F.col("m").between(cal.first, cal.complete_by)
    flows = cube.select("district", F.col("f").alias("m"), F.col("n").alias("fil"), F.lit(0).alias("dec")).unionByName(cube.where("d is not null").select("district", F.col("d").alias("m"), F.lit(0).alias("fil"), F.col("n").alias("dec")))
    flows = flows.where(span).groupBy("district", "m").agg(F.sum("fil").alias("fil"), F.sum("dec").alias("dec"))
    grid = flows.where("fil > 0").select("district").distinct().select("district", F.explode(F.sequence(F.lit(cal.first), F.lit(cal.complete_by))).alias("m"))
    dense = grid.join(flows, ["district", "m"], "left").fillna(0, ["fil", "dec"])
    months = cal.complete_by - cal.level_from + 1
    ahead = Window.partitionBy("district").orderBy("m").rowsBetween(0, width - 1)
    every = Window.partitionBy("district")
    seen = dense.select("district", "m", F.sum("fil").over(ahead).alias("fw"), F.sum("dec").over(ahead).alias("dw"), (F.sum(F.when(F.col("m") >= cal.level_from, F.col("fil"))).over(every) / months).alias("level"))
    seen = seen.where(F.col("m") <= cal.complete_by - width + 1)
    fine = (F.col("fw") >= width * share * F.col("level")) & ((F.col("dw") >= decision_share * F.col("fw")) | (F.col("m") < cal.decisions_from))
    later = Window.partitionBy("district").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, 0)
    held = seen.withColumn("held", F.min(fine.cast("int")).over(later))
    return held.groupBy("district").agg(F.min(F.when(F.col("held") == 1, F.col("m"))).alias("entry"))
