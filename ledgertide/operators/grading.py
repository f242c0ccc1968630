"""Grading forecasts against published figures: which units count, each unit's loss, and scores by subset."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.operators import estimation as est


def log_ratio(now: str, then: str) -> Column:
    return F.when((F.col(now) > 0) & (F.col(then) > 0), F.ln(F.col(now) / F.col(then)))


def published(stock: DataFrame, origin: int) -> DataFrame:
    """(district, past, p0, p1, a0, d0, a1, d1): stocks a year before, at and a year after the origin month, flows of both years."""
    at = lambda m: F.max(F.when(F.col("m") == m, F.col("pending")))
    year = lambda c, m: F.sum(F.when(F.col("m").between(m - 11, m), F.col(c)))
    flows = [year(c, m).alias(n) for n, c, m in (("a0", "instituted", origin), ("d0", "disposed", origin), ("a1", "instituted", origin + 12), ("d1", "disposed", origin + 12))]
    return stock.groupBy("district").agg(at(origin - 12).alias("past"), at(origin).alias("p0"), at(origin + 12).alias("p1"), *flows)


def district_losses(forecasts: DataFrame, truth: DataFrame, recorded: DataFrame, near: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """(subset, district, forecaster, target, tau, y, q, loss) of forecasts (district, forecaster, target, tau, q).

    Every matched district is in `all_matched`; in `clean`, too, where the published stock and filings lie within `near`
    times those recorded (district, pending, filed). Districts without a finite actual value do not count.
    """
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b).between(*near), F.lit(False))
    actual = F.array(F.struct(F.lit("growth").alias("target"), log_ratio("p1", "p0").alias("y")), F.struct(F.lit("cr").alias("target"), F.try_divide("d1", "a1").alias("y")))
    known = truth.join(recorded, "district", "left").withColumn("clean", ratio(F.col("p0"), F.col("pending")) & ratio(F.col("a0"), F.col("filed")))
    known = known.select("district", "clean", F.explode(actual).alias("x")).select("district", "clean", "x.*").where("y is not null")
    miss = F.col("y") - F.col("q")
    rows = forecasts.join(known, ["district", "target"]).withColumn("loss", F.greatest(F.col("tau") * miss, (F.col("tau") - 1) * miss))
    subsets = F.explode(F.when(F.col("clean"), F.array(F.lit("all_matched"), F.lit("clean"))).otherwise(F.array(F.lit("all_matched")))).alias("subset")
    return rows.select(subsets, "district", "forecaster", "target", "tau", "y", "q", "loss")


def scores(losses: DataFrame, reference: str = "drift") -> DataFrame:
    """Pinball loss, coverage and skill against the reference by subset, forecaster, target and quantile."""
    by = losses.groupBy("subset", "forecaster", "target", "tau").agg(F.count("*").alias("n"), F.avg("loss").alias("pinball"), F.avg((F.col("y") <= F.col("q")).cast("double")).alias("coverage"))
    base = F.max(F.when(F.col("forecaster") == reference, F.col("pinball"))).over(Window.partitionBy("subset", "target", "tau"))
    return by.withColumn("skill", F.when(F.col("forecaster") != reference, 1 - F.try_divide("pinball", base)))


def skill_intervals(losses: DataFrame, reference: str = "drift", draws: int = 1000, seed: int = 0) -> list[tuple]:
    """(subset, forecaster, target, tau, low, high): clusters are states; only their sums of losses reach the driver."""
    sums = losses.groupBy("subset", "target", "tau", "forecaster", F.floor(F.col("district") / 1000).alias("state")).agg(F.sum("loss").alias("loss")).toPandas()
    out = []
    for (subset, target, tau), part in sums.groupby(["subset", "target", "tau"]):
        wide = part.pivot(index="state", columns="forecaster", values="loss").sort_index()
        for name in sorted(wide.columns.difference([reference])) if reference in wide else []:
            low, high = est.skill_bounds(wide[name].to_numpy(), wide[reference].to_numpy(), draws, seed)
            out.append((subset, name, target, float(tau), low, high))
    return out


def below_one(losses: DataFrame) -> DataFrame:
    """Share of districts forecast, and found, to clear fewer cases than were filed."""
    half = losses.where((F.col("target") == "cr") & (F.col("tau") == 0.5))
    share = lambda c: F.avg((F.col(c) < 1).cast("double"))
    return half.groupBy("subset", "forecaster").agg(F.count("*").alias("n"), share("q").alias("forecast"), share("y").alias("actual"))


def state_table(truth: DataFrame, recorded: DataFrame, least: float = 0.3, most: float = 1.5) -> DataFrame:
    """(state, p0, p1, coverage, growth, cr, growth_last, cr_last, graded) from district figures.

    A state is graded if what is recorded is between `least` and `most` of its published stock and its clearance is
    between 0 and 3.
    """
    sums = truth.join(recorded, "district", "left").groupBy(F.floor(F.col("district") / 1000).alias("state")).agg(*[F.sum(c).alias(c) for c in ("past", "p0", "p1", "a0", "d0", "a1", "d1", "pending")])
    rows = sums.select("state", "p0", "p1", F.try_divide("pending", "p0").alias("coverage"), log_ratio("p1", "p0").alias("growth"), F.when(F.col("a1") > 0, F.col("d1") / F.col("a1")).alias("cr"), log_ratio("p0", "past").alias("growth_last"), F.when(F.col("a0") > 0, F.col("d0") / F.col("a0")).alias("cr_last"))
    return rows.withColumn("graded", F.coalesce(F.col("coverage").between(least, most) & F.col("cr").between(0, 3), F.lit(False)))


def state_errors(states: DataFrame, steady: float = -0.10) -> DataFrame:
    """(subset, target, forecaster, state, e, y, q, p0) of graded states and three forecasters: each state's own last
    year, the median of those for all, and no change. `steady` leaves out states whose published stock fell by more."""
    graded = states.where("graded")
    whole = Window.partitionBy(F.lit(0))  # one row a state
    graded = graded.withColumns({f"{t}_common": F.percentile(f"{t}_last", 0.5).over(whole) for t in ("growth", "cr")})
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(n).alias("forecaster"), F.col(t).alias("y"), q.alias("q")) for t, still in (("growth", 0.0), ("cr", 1.0)) for n, q in (("last_year", F.col(f"{t}_last")), ("common", F.col(f"{t}_common")), ("no_change", F.lit(still)))])
    subsets = F.explode(F.when(F.col("growth") >= steady, F.array(F.lit("all_graded"), F.lit("steady"))).otherwise(F.array(F.lit("all_graded")))).alias("subset")
    rows = graded.select("state", "p0", subsets, cells.alias("cells")).select("state", "p0", "subset", F.explode("cells").alias("x")).select("state", "p0", "subset", "x.*")
    return rows.where("y is not null and q is not null").withColumn("e", F.col("q") - F.col("y"))


def state_scores(errors: DataFrame) -> DataFrame:
    """Mean absolute error, bias, error beside the bias, and error weighted by cases."""
    by = ["subset", "target", "forecaster"]
    bias = F.avg("e").over(Window.partitionBy(*by))
    rows = errors.withColumn("beside", F.abs(F.col("e") - bias))
    return rows.groupBy(*by).agg(F.count("*").alias("states"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"), F.avg("beside").alias("mae_bias_removed"), (F.sum(F.abs("e") * F.col("p0")) / F.sum("p0")).alias("mae_case_weighted"))


def national_growth(errors: DataFrame) -> DataFrame:
    """(forecaster, growth): of all graded states together, forecast and actual."""
    rows = errors.where("subset = 'all_graded' and target = 'growth'")
    total = lambda c: F.ln(F.sum(F.col("p0") * F.exp(c)) / F.sum("p0"))
    return rows.groupBy("forecaster").agg(total("q").alias("growth"), total("y").alias("actual"))


def finite(value: float) -> float | None:
    return float(value) if np.isfinite(value) else None
