"""Dense district-month panels: stocks, flows, ages, occupancy, and windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions.calendar import CALENDAR, Calendar

#: Lower edges of the age buckets, in years (fixed values).
AGE_EDGES = (0, 1, 3, 5, 10, 20, 30)


def grid(units: DataFrame, first: int, last: int) -> DataFrame:
    return units.distinct().withColumn("m", F.explode(F.sequence(F.lit(first), F.lit(last))))


def stock_flow(cube: DataFrame, cal: Calendar = CALENDAR) -> DataFrame:
    """(district, m, instituted, disposed, pending) on the full grid; filings outside it are dropped, later decisions are open.

    A case is +1 at its filing and -1 at its decision, and stocks are running sums: no range join.
    """
    rows = cube.where(F.col("f").between(cal.first, cal.last))
    flows = rows.select("district", F.col("f").alias("m"), F.col("n").alias("inst"), F.lit(0).alias("disp")).unionByName(rows.where(F.col("d") <= cal.last).select("district", F.col("d").alias("m"), F.lit(0).alias("inst"), F.col("n").alias("disp")))
    flows = flows.groupBy("district", "m").agg(F.sum("inst").alias("instituted"), F.sum("disp").alias("disposed"))
    dense = grid(cube.select("district"), cal.first, cal.last).join(flows, ["district", "m"], "left").fillna(0, ["instituted", "disposed"])
    upto = Window.partitionBy("district").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("pending", F.sum(F.col("instituted") - F.col("disposed")).over(upto))


def age_stock(cube: DataFrame, cal: Calendar = CALENDAR, edges: tuple[int, ...] = AGE_EDGES) -> DataFrame:
    """(district, m, bucket, pending): open cases by age. A case enters bucket k at f + 12 * edge and leaves at the next edge or its decision."""
    rows = cube.where(F.col("f").between(cal.first, cal.last))
    tops = [*edges[1:], None]
    spans = F.array(*[F.struct(F.lit(k).alias("bucket"), (F.col("f") + 12 * lo).alias("a"), (F.coalesce(F.col("d"), F.lit(10**6)) if hi is None else F.least(F.col("f") + 12 * hi, F.coalesce(F.col("d"), F.lit(10**6)))).alias("b")) for k, (lo, hi) in enumerate(zip(edges, tops, strict=True))])
    stays = rows.select("district", "n", F.explode(spans).alias("x")).select("district", "n", "x.*").where("a < b")
    moves = stays.select("district", "bucket", F.explode(F.array(F.struct(F.col("a").alias("m"), F.col("n").alias("x")), F.struct(F.col("b").alias("m"), (-F.col("n")).alias("x")))).alias("e")).select("district", "bucket", "e.*")
    moves = moves.where(F.col("m") <= cal.last).groupBy("district", "bucket", "m").agg(F.sum("x").alias("x"))
    cells = grid(moves.select("district", "bucket"), cal.first, cal.last)
    upto = Window.partitionBy("district", "bucket").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return cells.join(moves, ["district", "bucket", "m"], "left").select("district", "bucket", "m", F.sum(F.coalesce("x", F.lit(0))).over(upto).alias("pending"))


def rolling(x: str | Column, width: int, by: str = "district", how=F.sum) -> Column:
    """An aggregate over the last `width` months, only where all of them are there."""
    x = F.col(x) if isinstance(x, str) else x
    frame = Window.partitionBy(by).orderBy("m").rowsBetween(-(width - 1), 0)
    return F.when(F.count(x).over(frame) == width, how(x).over(frame))


def leave_one_out(x: str, group: list[str]) -> Column:
    """The mean of the others in the group that are observed; null if x is missing or alone."""
    w = Window.partitionBy(*group)
    return F.when(F.col(x).isNotNull(), F.try_divide(F.sum(x).over(w) - F.col(x), F.count(x).over(w) - 1))


def occupancy(postings: DataFrame, cal: Calendar = CALENDAR, lookback: int = 36) -> DataFrame:
    """(district, m, working, staffed): courts with a judge, and courts that had one within the lookback."""
    months = postings.where((F.col("e") >= F.col("s")) & (F.col("s") <= cal.last) & (F.col("e") >= cal.first - lookback + 1)).select("district", "court", F.explode(F.sequence(F.greatest("s", F.lit(cal.first - lookback + 1)), F.least("e", F.lit(cal.last)))).alias("m")).distinct()
    seats = grid(months.select("district", "court"), cal.first, cal.last).join(months.withColumn("on", F.lit(1)), ["district", "court", "m"], "left").fillna(0, ["on"])
    past = Window.partitionBy("district", "court").orderBy("m").rowsBetween(-(lookback - 1), 0)
    return seats.withColumn("near", F.max("on").over(past)).groupBy("district", "m").agg(F.sum("on").alias("working"), F.sum("near").alias("staffed"))


def bowley_skew(cdf_values: list[Column], edges: list[float]) -> Column:
    """(q3 + q1 - 2 q2) / (q3 - q1) with quartiles interpolated in bucket counts; edges has one more than the counts."""
    total = sum(cdf_values[1:], cdf_values[0])

    def quartile(p: float) -> Column:
        below, out = F.lit(0.0), F
        for count, lo, hi in zip(cdf_values, edges[:-1], edges[1:], strict=True):
            inside = F.lit(float(lo)) + F.try_divide(total * p - below, count) * (hi - lo)
            out = out.when((count > 0) & (total * p <= below + count), inside)
            below = below + count
        return out.otherwise(F.lit(None))

    q1, q2, q3 = (quartile(p) for p in (0.25, 0.5, 0.75))
    return F.try_divide(q3 + q1 - 2 * q2, q3 - q1)
