"""Joining records that begin late to later snapshots of the whole stock, and what a collection looked like at its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions.calendar import CALENDAR, Calendar
from ledgertide.operators import panel

#: Edges of the age buckets in years; the last bucket is closed at 40 (fixed values).
EDGES = (*panel.AGE_EDGES, 40)
BUCKETS = [f"p{k}" for k in range(len(panel.AGE_EDGES))]


def scrape_summary(rows: DataFrame, stages: list[str], min_obs: int, width: int = 12, share: float = 0.2) -> DataFrame:
    """(district, scraped, gap, share_<stage>...) from rows (district, t, stage, gap), t being a period number.

    scraped is the last period with at least `share` of the district's largest count. The rest describes the `width`
    periods up to it: the geometric mean of positive gaps and the shares among the named stages, null where fewer
    than min_obs rows bear on them.
    """
    sums = [F.count(F.when(F.col("stage") == s, 1)).alias(f"n_{s}") for s in stages]
    by_t = rows.groupBy("district", "t").agg(F.count("*").alias("n"), F.count(F.when(F.col("gap") > 0, 1)).alias("gaps"), F.sum(F.when(F.col("gap") > 0, F.ln("gap"))).alias("logs"), *sums)
    own = Window.partitionBy("district")
    by_t = by_t.withColumn("peak", F.max("n").over(own)).withColumn("scraped", F.max(F.when(F.col("n") >= share * F.col("peak"), F.col("t"))).over(own))
    live = by_t.where((F.col("t") > F.col("scraped") - width) & (F.col("t") <= F.col("scraped"))).groupBy("district", "scraped").agg(*[F.sum(c).alias(c) for c in ("gaps", "logs", *[f"n_{s}" for s in stages])])
    known = sum((F.col(f"n_{s}") for s in stages[1:]), F.col(f"n_{stages[0]}"))
    shares = [F.when(known >= min_obs, F.try_divide(F.col(f"n_{s}"), known)).alias(f"share_{s}") for s in stages]
    return live.select("district", "scraped", F.when(F.col("gaps") >= min_obs, F.exp(F.try_divide("logs", "gaps"))).alias("gap"), *shares)


def aged_panel(cube: DataFrame, cal: Calendar = CALENDAR) -> DataFrame:
    """(district, m, instituted, disposed, p0 ... p6): flows, and stocks by age bucket as columns."""
    ages = panel.age_stock(cube, cal).groupBy("district", "m").agg(*[F.sum(F.when(F.col("bucket") == k, F.col("pending")).otherwise(0)).alias(b) for k, b in enumerate(BUCKETS)])
    return panel.stock_flow(cube, cal).drop("pending").join(ages, ["district", "m"], "left").fillna(0, BUCKETS)


def _total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def harmonise(records: DataFrame, snapshots: DataFrame, start: int, end: int, last: int, hazard: float) -> DataFrame:
    """(district, m, instituted, disposed, pending, p0 ... p6, coverage) for the districts of both, months start to last.

    records hold cases filed from `start` and are complete to `end`; snapshots show the whole stock from their first
    month t0. What of a bucket at t0 is older than the records reach is legacy: going back it grows by `hazard` a
    month and moves to younger buckets, from the middle of the ages it can have. coverage scales the records so that
    they meet the snapshot's stock, carried back at its first year's growth (at most 0.1 a month), within 0.5 and 2.
    Months of a snapshot are taken from it as they are; months of neither are null.
    """
    whole = _total([F.col(b) for b in BUCKETS])
    dated = snapshots.withColumn("t0", F.min("m").over(Window.partitionBy("district")))
    at0 = lambda c: F.max(F.when(F.col("m") == F.col("t0"), c))
    head = dated.groupBy("district", "t0").agg(*[at0(F.col(b)).alias(f"s{k}") for k, b in enumerate(BUCKETS)], at0(whole).alias("stock"), F.max(F.when(F.col("m") == F.col("t0") + 12, whole)).alias("later"))
    reach = (F.col("t0") - start) / F.lit(12.0)
    growth = F.when((F.col("stock") > 0) & (F.col("later") > 0), F.least(F.greatest(F.ln(F.col("later") / F.col("stock")) / 12, F.lit(-0.1)), F.lit(0.1))).otherwise(0.0)
    old = [F.col(f"s{k}") * F.least(F.greatest((F.lit(float(hi)) - reach) / float(hi - lo), F.lit(0.0)), F.lit(1.0)) for k, (lo, hi) in enumerate(zip(EDGES, EDGES[1:], strict=False))]
    middle = [(F.greatest(F.lit(float(lo)), reach) + float(hi)) / 2 for lo, hi in zip(EDGES, EDGES[1:], strict=False)]
    head = head.select("district", "t0", "stock", growth.alias("growth"), *[x.alias(f"old{k}") for k, x in enumerate(old)], *[x.alias(f"mid{k}") for k, x in enumerate(middle)])

    rows = records.where(F.col("m").between(start, end)).withColumn("at_end", F.max(F.when(F.col("m") == end, whole)).over(Window.partitionBy("district"))).join(head, "district")
    back = F.col("t0") - F.col("m")
    base = _total([F.col(f"old{k}") for k in range(len(BUCKETS))])
    raw = (F.col("stock") * F.exp(-F.col("growth") * (F.col("t0") - end)) - base * F.exp(hazard * (F.col("t0") - end))) / F.greatest(F.col("at_end"), F.lit(1))
    rows = rows.withColumns({"coverage": F.least(F.greatest(F.coalesce(raw, F.lit(1.0)), F.lit(0.5)), F.lit(2.0)), "rise": F.exp(hazard * back)})
    younger = [_total([(F.col(f"mid{k}") - back / F.lit(12.0) >= float(e)).cast("int") for e in EDGES[1:-1]]) for k in range(len(BUCKETS))]
    rows = rows.withColumns({f"to{k}": x for k, x in enumerate(younger)})
    legacy = [_total([F.when(F.col(f"to{k}") == b, F.col(f"old{k}")).otherwise(0.0) for k in range(len(BUCKETS))]) * F.col("rise") for b in range(len(BUCKETS))]
    all_legacy, scale = base * F.col("rise"), F.col("coverage")
    fixed = rows.select(
        "district", "m", (F.col("instituted") * scale).alias("instituted"), (F.col("disposed") * scale + all_legacy * (F.exp(F.lit(hazard)) - 1)).alias("disposed"),
        (whole * scale + all_legacy).alias("pending"), *[(F.col(b) * scale + x).alias(b) for b, x in zip(BUCKETS, legacy, strict=True)], "coverage",
    )
    units = records.select("district").distinct().join(snapshots.select("district").distinct(), "district")
    seen = snapshots.join(units, "district").select("district", "m", *[F.col(c).cast("double").alias(c) for c in ("instituted", "disposed")], whole.cast("double").alias("pending"), *[F.col(b).cast("double").alias(b) for b in BUCKETS], F.lit(1.0).alias("coverage"))
    both = fixed.join(snapshots.select("district", "m"), ["district", "m"], "left_anti").unionByName(seen)
    return panel.grid(units, start, last).join(both, ["district", "m"], "left")
