"""Forecasts graded by district and state, elasticities behind their gate, and the simulated queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.functions.calendar import CALENDAR as C
from ledgertide.operators import drivers, grading, panel
from ledgertide.operators import elasticity as ela
from ledgertide.plans import district as dst
from ledgertide.plans.core import BASE, FULL, GRID, r6
from ledgertide.sources import lifecycle as src
from ledgertide.sources.simulate import Setting, simulate

ORIGIN, TAUS = dst.FOLDS[-1], dst.TAUS
QUEUE = Setting(months=96, filings=25.0, shocks=((60, 68, 0.35),))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.published(panel.stock_flow(src.cube(spark, sf_dir)), ORIGIN)


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(district, pending, filed) at the origin, as if a district's records began 0 to 4 years late."""
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    rows = src.cube(spark, sf_dir).where(F.col("f") >= C.first + 12 * F.pmod("district", F.lit(5)))
    return rows.groupBy("district").agg(n((F.col("f") <= ORIGIN) & (F.col("d").isNull() | (F.col("d") > ORIGIN))).alias("pending"), n(F.col("f").between(ORIGIN - 11, ORIGIN)).alias("filed"))


TRUTH = f"""{BASE}, {GRID}, {FULL}, truth AS (SELECT district, max(pending) FILTER (m = {ORIGIN - 12}) AS past, max(pending) FILTER (m = {ORIGIN}) AS p0, max(pending) FILTER (m = {ORIGIN + 12}) AS p1,
  sum(instituted) FILTER (m BETWEEN {ORIGIN - 11} AND {ORIGIN}) AS a0, sum(disposed) FILTER (m BETWEEN {ORIGIN - 11} AND {ORIGIN}) AS d0, sum(instituted) FILTER (m BETWEEN {ORIGIN + 1} AND {ORIGIN + 12}) AS a1, sum(disposed) FILTER (m BETWEEN {ORIGIN + 1} AND {ORIGIN + 12}) AS d1 FROM stock GROUP BY district),
rec AS (SELECT district, coalesce(sum(n) FILTER (f <= {ORIGIN} AND (d IS NULL OR d > {ORIGIN})), 0) AS pending, coalesce(sum(n) FILTER (f BETWEEN {ORIGIN - 11} AND {ORIGIN}), 0) AS filed FROM cube WHERE f >= {C.first} + 12 * (district % 5) GROUP BY district)"""


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dst.targets(spark, sf_dir)
    part = lambda x: F.percentile(F.when(F.col("m") < ORIGIN - 30, x), list(TAUS))
    fits = rows.groupBy("target").agg(part(F.col("y") - F.col("anchor")).alias("drift"), part(F.col("y")).alias("climatology"))
    taus = F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.lit(k).alias("k")) for k, t in enumerate(TAUS)])).alias("t")
    now = rows.where(F.col("m") == ORIGIN).join(fits, "target").select("district", "target", "anchor", "drift", "climatology", taus)
    at = lambda c: F.element_at(c, F.col("t.k") + 1)
    still = F.when(F.col("target") == "growth", 0.0).otherwise(F.col("anchor"))
    q = F.explode(F.create_map(F.lit("drift"), F.col("anchor") + at("drift"), F.lit("climatology"), at("climatology"), F.lit("no_change"), still)).alias("forecaster", "q")
    return grading.district_losses(now.select("district", "target", F.col("t.tau").alias("tau"), q), _truth(spark, sf_dir), _recorded(spark, sf_dir))


_AHEAD = dst.NAIVE[dst.NAIVE.index("r AS (SELECT") : dst.NAIVE.index("t AS (SELECT m")]
LOSSES = f"""{TRUTH}, {_AHEAD}t AS (SELECT district, m, 'growth' AS target, CASE WHEN ahead > 0 AND pending > 0 THEN ln(ahead / pending) END AS y, CASE WHEN pending > 0 AND past > 0 THEN ln(pending / past) END AS anchor FROM s UNION ALL SELECT district, m, 'cr', dn / nullif(an, 0), d12 / nullif(a12, 0) FROM s),
x AS (SELECT * FROM t WHERE y IS NOT NULL AND anchor IS NOT NULL),
ft AS (SELECT target, {dst._quantiles("d", "y - anchor", f"m < {ORIGIN - 30}")}, {dst._quantiles("c", "y", f"m < {ORIGIN - 30}")} FROM x GROUP BY target),
q AS ({" UNION ALL ".join(f"SELECT district, target, CAST({tau} AS DOUBLE) AS tau, '{name}' AS forecaster, {value.format(k)} AS q FROM x JOIN ft USING (target) WHERE m = {ORIGIN}" for k, tau in enumerate(TAUS) for name, value in (("drift", "anchor + d{}"), ("climatology", "c{}"), ("no_change", "CASE WHEN target = 'growth' THEN 0 ELSE anchor END")))}),
known AS (SELECT truth.*, coalesce(p0 / nullif(rec.pending, 0) BETWEEN 0.5 AND 2 AND a0 / nullif(filed, 0) BETWEEN 0.5 AND 2, false) AS clean FROM truth LEFT JOIN rec USING (district)),
act AS (SELECT district, clean, 'growth' AS target, CASE WHEN p1 > 0 AND p0 > 0 THEN ln(p1 / p0) END AS y FROM known UNION ALL SELECT district, clean, 'cr', d1 / nullif(a1, 0) FROM known),
one AS (SELECT q.*, y, clean, greatest(tau * (y - q), (tau - 1) * (y - q)) AS loss FROM q JOIN act USING (district, target) WHERE y IS NOT NULL),
ls AS (SELECT 'all_matched' AS subset, * FROM one UNION ALL SELECT 'clean', * FROM one WHERE clean)"""


def graded_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(grading.scores(_losses(spark, sf_dir)), "pinball", "coverage", "skill")


GRADED = f"""{LOSSES}, sc AS (SELECT subset, forecaster, target, tau, count(*) AS n, avg(loss) AS pinball, avg(CASE WHEN y <= q THEN 1.0 ELSE 0.0 END) AS coverage FROM ls GROUP BY ALL)
SELECT subset, forecaster, target, tau, n, round(pinball, 6) AS pinball, round(coverage, 6) AS coverage, round(CASE WHEN forecaster <> 'drift' THEN 1 - pinball / nullif(max(pinball) FILTER (forecaster = 'drift') OVER (PARTITION BY subset, target, tau), 0) END, 6) AS skill FROM sc"""


def below_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(grading.below_one(_losses(spark, sf_dir)), "forecast", "actual")


BELOW = f"{LOSSES} SELECT subset, forecaster, count(*) AS n, round(avg(CASE WHEN q < 1 THEN 1.0 ELSE 0.0 END), 6) AS forecast, round(avg(CASE WHEN y < 1 THEN 1.0 ELSE 0.0 END), 6) AS actual FROM ls WHERE target = 'cr' AND tau = 0.5 GROUP BY ALL"


def graded_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(*r[:4], grading.finite(r[4]), grading.finite(r[5])) for r in grading.skill_intervals(_losses(spark, sf_dir))]
    return spark.createDataFrame(rows, "subset string, forecaster string, target string, tau double, low double, high double")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.state_table(_truth(spark, sf_dir), _recorded(spark, sf_dir))


def state_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_states(spark, sf_dir), "coverage", "growth", "cr", "growth_last", "cr_last")


def state_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(grading.state_scores(grading.state_errors(_states(spark, sf_dir))), "mae", "bias", "mae_bias_removed", "mae_case_weighted")


def national(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(grading.national_growth(grading.state_errors(_states(spark, sf_dir))), "growth", "actual")


STATES = f"""{TRUTH}, su AS (SELECT district // 1000 AS state, {", ".join(f"sum({c}) AS {c}" for c in ("past", "p0", "p1", "a0", "d0", "a1", "d1"))}, sum(rec.pending) AS kept FROM truth LEFT JOIN rec USING (district) GROUP BY ALL),
tb AS (SELECT state, p0, p1, kept / nullif(p0, 0) AS coverage, CASE WHEN p1 > 0 AND p0 > 0 THEN ln(p1 / p0) END AS growth, CASE WHEN a1 > 0 THEN d1 / a1 END AS cr, CASE WHEN p0 > 0 AND past > 0 THEN ln(p0 / past) END AS growth_last, CASE WHEN a0 > 0 THEN d0 / a0 END AS cr_last FROM su),
gr AS (SELECT *, coalesce(coverage BETWEEN 0.3 AND 1.5 AND cr BETWEEN 0 AND 3, false) AS graded FROM tb)"""
STATE_FILTERS = f"{STATES} SELECT state, CAST(p0 AS BIGINT) AS p0, CAST(p1 AS BIGINT) AS p1, {', '.join(f'round({c}, 6) AS {c}' for c in ('coverage', 'growth', 'cr', 'growth_last', 'cr_last'))}, graded FROM gr"
ERRORS = f"""{STATES}, g AS (SELECT * FROM gr WHERE graded), md AS (SELECT median(growth_last) AS growth, median(cr_last) AS cr FROM g),
ev AS ({" UNION ALL ".join(f"SELECT state, p0, g.growth AS jump, '{t}' AS target, '{n}' AS forecaster, g.{t} AS y, {q} AS q FROM g CROSS JOIN md" for t, still in (("growth", 0), ("cr", 1)) for n, q in (("last_year", f"g.{t}_last"), ("common", f"md.{t}"), ("no_change", f"CAST({still} AS DOUBLE)")))}),
er AS (SELECT 'all_graded' AS subset, *, q - y AS e FROM ev WHERE y IS NOT NULL AND q IS NOT NULL UNION ALL SELECT 'steady', *, q - y FROM ev WHERE y IS NOT NULL AND q IS NOT NULL AND jump >= -0.1)"""
STATE_SCORES = f"{ERRORS}, b AS (SELECT *, avg(e) OVER (PARTITION BY subset, target, forecaster) AS bias FROM er) SELECT subset, target, forecaster, count(*) AS states, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias, round(avg(abs(e - b.bias)), 6) AS mae_bias_removed, round(sum(abs(e) * p0) / sum(p0), 6) AS mae_case_weighted FROM b GROUP BY ALL"
NATIONAL = f"{ERRORS} SELECT forecaster, round(ln(sum(p0 * exp(q)) / sum(p0)), 6) AS growth, round(ln(sum(p0 * exp(y)) / sum(p0)), 6) AS actual FROM er WHERE subset = 'all_graded' AND target = 'growth' GROUP BY forecaster"


def elastic_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(district, state, m, log_d, log_c, log_p, load, z): one row a district and month; unknown values are null."""
    own = Window.partitionBy("district").orderBy("m")
    log = lambda c: F.when(F.col(c) > 0, F.ln(c))
    flows = panel.stock_flow(src.cube(spark, sf_dir)).select("district", "m", "pending", panel.rolling("instituted", 12).alias("a12"), panel.rolling("disposed", 12).alias("d12"))
    flows = flows.select("district", "m", log("d12").alias("log_d"), F.lag(log("pending"), 12).over(own).alias("log_p"), F.lag(F.try_divide("a12", "d12"), 12).over(own).alias("load"))
    seats = dst._seats(spark, sf_dir)
    bench = seats.select("district", "state", "m", panel.rolling("working", 12, how=F.avg).alias("c12")).join(drivers.shift_share(seats, 2, 1997), ["district", "m"])
    bench = bench.select((F.col("state") * 1000 + F.col("district")).alias("district"), "state", "m", log("c12").alias("log_c"), "z")
    return flows.join(bench, ["district", "m"]).select("district", "state", "m", "log_d", "log_c", "log_p", "load", "z")


PANEL = f"""{BASE}, {GRID}, {FULL}, w AS (SELECT district, m, pending, CASE WHEN count(*) OVER t = 12 THEN sum(instituted) OVER t END AS a12, CASE WHEN count(*) OVER t = 12 THEN sum(disposed) OVER t END AS d12 FROM stock WINDOW t AS (PARTITION BY district ORDER BY m ROWS 11 PRECEDING)),
v AS (SELECT district, m, CASE WHEN d12 > 0 THEN ln(d12) END AS log_d, lag(CASE WHEN pending > 0 THEN ln(pending) END, 12) OVER o AS log_p, lag(a12 / nullif(d12, 0), 12) OVER o AS load FROM w WINDOW o AS (PARTITION BY district ORDER BY m)),
ins AS (SELECT * FROM ({dst.INSTRUMENT}) AS i), wk AS (SELECT state, district, m, sum(n) AS working FROM ({dst.SEATS} SELECT * FROM st) AS k GROUP BY ALL),
bn AS (SELECT state, district, m, CASE WHEN count(*) OVER t = 12 AND avg(working) OVER t > 0 THEN ln(avg(working) OVER t) END AS log_c FROM wk WINDOW t AS (PARTITION BY district ORDER BY m ROWS 11 PRECEDING))
SELECT v.district, bn.state, v.m, round(log_d, 6) AS log_d, round(log_c, 6) AS log_c, round(log_p, 6) AS log_p, round(load, 6) AS load, round(z, 6) AS z FROM v JOIN bn ON v.district = bn.state * 1000 + bn.district AND v.m = bn.m JOIN ins ON ins.district = bn.district AND ins.m = bn.m"""


def panel_of_elasticities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(elastic_panel(spark, sf_dir), "log_d", "log_c", "log_p", "load", "z")


def elasticities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, value); a value that is not identified is null. The panel that reaches the driver is bounded by districts."""
    rows = elastic_panel(spark, sf_dir).toPandas().sort_values(["district", "m"]).astype(float)
    return spark.createDataFrame([(k, grading.finite(v)) for k, v in ela.elasticities(rows, 1998 * 12 + 11).items()], "name string, value double")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, filed, decided, median_months, unripe) of a simulated queue of as many districts as there are nations."""
    cases = simulate(spark, src.table(spark, sf_dir, "nation").count(), 7, QUEUE)
    return cases.groupBy("kind").agg(F.count("*").alias("filed"), F.count("d").alias("decided"), F.median(F.col("d") - F.col("f")).alias("median_months"), F.count(F.when(F.col("d") < F.col("ripe"), 1)).alias("unripe"))


def queries() -> dict:
    return {
        "M17_district_grading": graded_districts, "M17_below_one": below_one, "M17_skill_intervals": graded_intervals, "M24_state_filters": state_filters, "M24_state_scores": state_scores,
        "M24_national_growth": national, "M22_panel": panel_of_elasticities, "M22_elasticities": elasticities, "S12_queue": queue,
    }


def oracle_sql() -> dict[str, str]:
    return {"M17_district_grading": GRADED, "M17_below_one": BELOW, "M24_state_filters": STATE_FILTERS, "M24_state_scores": STATE_SCORES, "M24_national_growth": NATIONAL, "M22_panel": PANEL}
