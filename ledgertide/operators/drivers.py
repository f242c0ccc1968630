"""What might explain a district's pace: courts, load, tenure; and judges' seats by cadre with the shift-share instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions.calendar import CALENDAR, Calendar
from ledgertide.operators import panel


def district_drivers(cases: DataFrame, tenures: DataFrame, marked: str, first: int, last: int) -> DataFrame:
    """(district, courts, filed_per_year, log_filings, log_filings_per_court, marked_share, tenure, disposal_ratio).

    cases (district, court, f, d, case_type); tenures (district, months). Courts is the mean number of courts active
    in a month; flows are of the months first to last, the share of `marked` (a condition) of all cases.
    """
    years = (last - first + 1) / 12
    both = F.array(F.struct(F.col("f").alias("m"), F.lit(1).alias("filed"), F.lit(0).alias("gone")), F.struct(F.col("d").alias("m"), F.lit(0).alias("filed"), F.lit(1).alias("gone")))
    moves = cases.select("district", "court", F.explode(both).alias("x")).select("district", "court", "x.*").where(F.col("m").between(first, last))
    seats = moves.groupBy("district", "m", "court").agg(F.sum("filed").alias("filed"), F.sum("gone").alias("gone"))
    months = seats.groupBy("district", "m").agg(F.count("*").alias("courts"), F.sum("filed").alias("filed"), F.sum("gone").alias("gone"))
    flows = months.groupBy("district").agg(F.avg("courts").alias("courts"), (F.sum("filed") / years).alias("filed_per_year"), F.try_divide(F.sum("gone"), F.sum("filed")).alias("disposal_ratio"))
    shares = cases.groupBy("district").agg(F.avg(F.expr(f"CASE WHEN {marked} THEN 1.0D ELSE 0.0D END")).alias("marked_share"))
    tenure = tenures.groupBy("district").agg(F.median("months").alias("tenure"))
    logs = [F.when(F.col("filed_per_year") > 0, F.ln("filed_per_year")).alias("log_filings"), F.when(F.col("filed_per_year") > 0, F.ln(F.col("filed_per_year") / F.col("courts"))).alias("log_filings_per_court")]
    return flows.join(shares, "district").join(tenure, "district", "left").select("district", "courts", "filed_per_year", *logs, "marked_share", "tenure", "disposal_ratio")


def seats_by_cadre(postings: DataFrame, cadres: int, cal: Calendar = CALENDAR) -> DataFrame:
    """(state, district, m, working, c0 ...): filled courts by month and cadre. postings: state, district, court, cadre, s, e."""
    months = postings.where((F.col("e") >= F.col("s")) & (F.col("s") <= cal.last) & (F.col("e") >= cal.first))
    months = months.select("district", "court", "cadre", F.explode(F.sequence(F.greatest("s", F.lit(cal.first)), F.least("e", F.lit(cal.last)))).alias("m")).distinct()
    counts = months.groupBy("district", "m").agg(F.count("*").alias("working"), *[F.count(F.when(F.col("cadre") == k, 1)).alias(f"c{k}") for k in range(cadres)])
    units = postings.select("state", "district").distinct()
    return panel.grid(units, cal.first, cal.last).join(counts, ["district", "m"], "left").fillna(0, ["working", *[f"c{k}" for k in range(cadres)]])


def shift_share(seats: DataFrame, cadres: int, base_year: int) -> DataFrame:
    """(district, m, z): base-year cadre shares times the log change of the state's seats of each cadre, mean of 12 months.

    Seats of no named cadre form one more. A cadre whose totals have no finite log change adds nothing; a district
    without seats in the base year has no z.
    """
    named = sum((F.col(f"c{k}") for k in range(1, cadres)), F.col("c0"))
    rows = seats.withColumn(f"c{cadres}", F.greatest(F.col("working") - named, F.lit(0)))
    ks, own, here = range(cadres + 1), Window.partitionBy("district"), Window.partitionBy("state", "m")
    based = F.floor(F.col("m") / 12) == base_year
    rows = rows.withColumns({f"all{k}": F.sum(f"c{k}").over(here) for k in ks})
    rows = rows.withColumns({f"share{k}": F.avg(F.when(based, F.col(f"c{k}"))).over(own) for k in ks} | {f"then{k}": F.avg(F.when(based, F.col(f"all{k}"))).over(own) for k in ks})
    total = sum((F.col(f"share{k}") for k in ks[1:]), F.col("share0"))
    change = [F.when((F.col(f"all{k}") > 0) & (F.col(f"then{k}") > 0), F.ln(f"all{k}") - F.ln(f"then{k}")).otherwise(0.0) * F.try_divide(F.col(f"share{k}"), total) for k in ks]
    rows = rows.select("district", "m", sum(change[1:], change[0]).alias("z"))
    return rows.select("district", "m", panel.rolling("z", 12, how=F.avg).alias("z"))


def recorded_each_december(seats: DataFrame) -> DataFrame:
    """(year, working): filled seats in December; a rising total shows records that thin out going back."""
    return seats.where("m % 12 = 11").groupBy(F.floor(F.col("m") / 12).alias("year")).agg(F.sum("working").alias("working"))
