"""Estimators whose draws or iterations have no SQL form; each collects only counts by unit, class or month."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.operators import estimation as est
from ledgertide.operators import elasticity, events, matching, panel, survival
from ledgertide.plans.core import _handover
from ledgertide.sources import lifecycle as src


def _panel(spark: SparkSession, sf_dir: str):
    """By district and December, at most units x years rows: pending, filings and disposals of the year."""
    rows = panel.stock_flow(src.cube(spark, sf_dir)).withColumn("y", F.floor(F.col("m") / 12))
    return rows.groupBy("district", "y").agg(F.max_by("pending", "m").alias("p"), F.sum("instituted").alias("a"), F.sum("disposed").alias("d")).toPandas().sort_values(["district", "y"])


def skill_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _panel(spark, sf_dir)
    x["growth"] = np.log(x.p.where(x.p > 0)).groupby(x.district).diff()
    x["naive"] = x.groupby("district").growth.shift(1)
    x = x.dropna()
    by = x.assign(a=(x.growth - x.growth.median()).abs(), b=(x.growth - x.naive).abs(), c=x.district // 1000).groupby("c")[["a", "b"]].sum()
    low, high = est.skill_bounds(by.a.to_numpy(), by.b.to_numpy(), 2000, 0)
    return spark.createDataFrame([(float(1 - by.a.sum() / by.b.sum()), low, high)], "skill double, low double, high double")


def quantile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of log pending on log filings, fitted on all years but the last and shifted on the residuals of that one."""
    x = _panel(spark, sf_dir)
    x = x[(x.p > 0) & (x.a > 0)]
    design, y, last = np.c_[np.ones(len(x)), np.log(x.a)], np.log(x.p).to_numpy(), (x.y == x.y.max()).to_numpy()
    rows = []
    for tau in (0.1, 0.5, 0.9):
        line = est.quantile_line(design[~last], y[~last], tau)
        rows.append((tau, float(line[0]), float(line[1]), est.calibration_shift(y[last] - design[last] @ line, tau)))
    return spark.createDataFrame(rows, "tau double, constant double, slope double, shift double")


def covid_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _panel(spark, sf_dir).pivot(index="district", columns="y", values="p").astype(float)
    growth = np.diff(np.log(p.clip(lower=1)), axis=1)[:, :4]
    out = est.years_bootstrap(growth, p[1999].to_numpy(), 2, 2000)
    return spark.createDataFrame([(2000 + k, *map(float, np.quantile(out[:, k], [0.025, 0.5, 0.975]))) for k in range(2)], "year int, low double, mid double, high double")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = survival.time_to_decision(src.cube(spark, sf_dir), ["district"]).where("pending_3y is not null")
    t = t.select("district", "pending_3y", ((F.col("pending_3y_hi") - F.col("pending_3y_lo")) / 3.92).alias("error"))
    return est.rank_bounds(t, "district", "pending_3y", "error").select("district", F.round("rank_lo").cast("int").alias("rank_lo"), F.round("rank_hi").cast("int").alias("rank_hi"))


def fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of log pending on log filings, district and month effects out; errors clustered by state. A row a district and month."""
    rows = panel.stock_flow(src.cube(spark, sf_dir)).where("pending > 0 and instituted > 0").select("district", "m", F.ln("pending").alias("y"), F.ln("instituted").alias("x")).toPandas().sort_values(["district", "m"])
    free = elasticity.within(rows[["y", "x"]].to_numpy(), rows.district.to_numpy(), rows.m.to_numpy())
    fit = elasticity.clustered_fit(free[:, 0], free[:, 1:], free[:, 1:], rows.district.to_numpy() // 1000)
    return spark.createDataFrame([(round(float(fit.slope[0]), 6), round(float(fit.error[0]), 6), len(rows))], "slope double, error double, n long")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelled nations of a region against the right names, and one override."""
    nation = src.table(spark, sf_dir, "nation").select("n_regionkey", F.lower("n_name").alias("name"))
    spelled = nation.select("n_regionkey", F.when(F.length("name") >= 6, F.concat(F.lit("x"), F.substring("name", 2, 99))).otherwise(F.col("name")).alias("name"))
    given = nation.where("name = 'france'").select("n_regionkey", F.lit("xrance").alias("name"), F.col("name").alias("match"))
    return matching.with_overrides(matching.fuzzy_match(spelled, nation, "n_regionkey", "name"), given, ["n_regionkey", "name"])


def handover_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of handovers and their trend before, with intervals from resampled districts."""
    found = events.clustered_means(events.event_totals(_handover(spark, sf_dir), 8), ["after", "before", "lost"])
    return spark.createDataFrame([(c, *[round(v, 6) for v in rest]) for c, *rest in found], "figure string, mean double, low double, high double")


def queries() -> dict:
    return {
        "M12_intervals": handover_intervals,
        "M2_skill_interval": skill_interval, "M3_M4_quantile_lines": quantile_lines, "M7_two_way_fixed_effects": fixed_effects, "M11_rank_intervals": ranked, "M13_years_bootstrap": covid_bootstrap,
        "J12_fuzzy_names": names,
    }


def oracle_sql() -> dict[str, str]:
    return {}
