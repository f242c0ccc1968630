"""Seam, drivers, instrument, naive benchmarks, boosting and grading, with SQL wherever nothing is drawn or iterated."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.functions.calendar import CALENDAR as C
from ledgertide.operators import boosting, drivers, panel, seam
from ledgertide.operators import estimation as est
from ledgertide.plans.core import BASE, FULL, GRID, POSTS, r6
from ledgertide.sources import lifecycle as src

STAGES = ["view", "signup", "click", "error", "purchase"]
START, END, HAZARD = 1997 * 12, 1999 * 12 + 5, 0.02
TAUS, FOLDS = (0.1, 0.5, 0.9), (2000 * 12, 2000 * 12 + 6)
MARKED = "case_type IN ('PROMO', 'SMALL')"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.hearings(spark, sf_dir).select("district", F.date_diff(F.col("at").cast("date"), F.lit("1970-01-01").cast("date")).alias("t"), "stage", "gap")


def scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(seam.scrape_summary(_events(spark, sf_dir), STAGES, 10), "gap", *[f"share_{s}" for s in STAGES])


SCRAPED = f"""WITH h AS (SELECT user_id % 25 AS district, event_type AS stage, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS t, (epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(ts)) / 60 AS gap FROM events),
per AS (SELECT district, t, count(*) AS n FROM h GROUP BY ALL), pk AS (SELECT district, max(n) AS peak FROM per GROUP BY district),
sc AS (SELECT district, max(t) AS scraped FROM per JOIN pk USING (district) WHERE n >= 0.2 * peak GROUP BY district),
live AS (SELECT h.*, scraped FROM h JOIN sc USING (district) WHERE t > scraped - 12 AND t <= scraped),
known AS (SELECT district, count(*) AS k FROM live WHERE stage IN ({", ".join(f"'{s}'" for s in STAGES)}) GROUP BY district)
SELECT district, scraped, round(CASE WHEN count(*) FILTER (gap > 0) >= 10 THEN exp(avg(CASE WHEN gap > 0 THEN ln(gap) END)) END, 6) AS gap, {", ".join(f"round(CASE WHEN max(k) >= 10 THEN count(*) FILTER (stage = '{s}') / max(k) END, 6) AS share_{s}" for s in STAGES)} FROM live LEFT JOIN known USING (district) GROUP BY district, scraped"""


def harmonised(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = src.cube(spark, sf_dir)
    snapshots = seam.aged_panel(cube).where(F.col("m") >= 2000 * 12 + F.pmod("district", F.lit(3)))
    out = seam.harmonise(seam.aged_panel(cube.where(F.col("f") >= START)), snapshots, START, END, C.last, HAZARD)
    return r6(out, "instituted", "disposed", "pending", "coverage", *seam.BUCKETS)


_P = [f"p{k}" for k in range(7)]
_SPANS = list(zip(seam.EDGES, [*seam.EDGES[1:-1], 1000], strict=False))
EDGE_ROWS = f"""edges(b, lo, hi) AS (VALUES {", ".join(f"({k}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for k, (lo, hi) in enumerate(zip(seam.EDGES, seam.EDGES[1:], strict=False)))})"""
HARMONISED = f"""{BASE}, {GRID}, src AS (SELECT 0 AS s, * FROM cube WHERE f BETWEEN {START} AND {C.last} UNION ALL SELECT 1 AS s, * FROM cube WHERE f BETWEEN {C.first} AND {C.last}),
wide AS (SELECT v.s, g.district, g.m, coalesce(sum(n) FILTER (f = g.m), 0) AS inst, coalesce(sum(n) FILTER (d = g.m), 0) AS disp, {", ".join(f"coalesce(sum(n) FILTER (f <= g.m AND (d IS NULL OR d > g.m) AND g.m - f >= {12 * lo} AND g.m - f < {12 * hi}), 0) AS p{k}" for k, (lo, hi) in enumerate(_SPANS))}
  FROM grid g CROSS JOIN (VALUES (0), (1)) v(s) LEFT JOIN src ON src.district = g.district AND src.s = v.s GROUP BY v.s, g.district, g.m),
allp AS (SELECT *, {" + ".join(_P)} AS tot FROM wide), rec AS (SELECT * FROM allp WHERE s = 0 AND m BETWEEN {START} AND {END}), snap AS (SELECT * FROM allp WHERE s = 1 AND m >= 24000 + district % 3),
hd AS (SELECT district, min(m) AS t0 FROM snap GROUP BY district),
h1 AS (SELECT a.*, hd.t0, CASE WHEN a.tot > 0 AND b.tot > 0 THEN least(greatest(ln(b.tot / a.tot) / 12, -0.1), 0.1) ELSE 0 END AS g, CAST(hd.t0 - {START} AS DOUBLE) / 12 AS a0 FROM hd JOIN snap a ON a.district = hd.district AND a.m = hd.t0 LEFT JOIN snap b ON b.district = hd.district AND b.m = hd.t0 + 12),
{EDGE_ROWS},
lg AS (SELECT district, t0, b, [{", ".join(_P)}][b + 1] * least(greatest((hi - a0) / (hi - lo), 0), 1) AS old, (greatest(lo, a0) + hi) / 2 AS mid FROM h1 CROSS JOIN edges),
l0 AS (SELECT district, sum(old) AS old FROM lg GROUP BY district),
tg AS (SELECT lg.district, r.m, len(list_filter([1.0, 3.0, 5.0, 10.0, 20.0, 30.0], lambda e: CAST(e AS DOUBLE) <= mid - CAST(lg.t0 - r.m AS DOUBLE) / 12)) AS tb, old * exp(CAST({HAZARD} AS DOUBLE) * (lg.t0 - r.m)) AS x FROM lg JOIN rec r ON r.district = lg.district),
lt AS (SELECT district, m, sum(x) AS l, {", ".join(f"coalesce(sum(x) FILTER (tb = {k}), 0) AS l{k}" for k in range(7))} FROM tg GROUP BY district, m),
kp AS (SELECT h1.district, least(greatest((h1.tot * exp(-g * (t0 - {END})) - l0.old * exp(CAST({HAZARD} AS DOUBLE) * (t0 - {END}))) / greatest(e.tot, 1), 0.5), 2) AS k FROM h1 JOIN l0 USING (district) JOIN rec e ON e.district = h1.district AND e.m = {END}),
fx AS (SELECT r.district, r.m, inst * k AS instituted, disp * k + l * (exp(CAST({HAZARD} AS DOUBLE)) - 1) AS disposed, tot * k + l AS pending, {", ".join(f"p{j} * k + l{j} AS p{j}" for j in range(7))}, k AS coverage FROM rec r JOIN kp USING (district) JOIN lt USING (district, m)
  UNION ALL SELECT district, m, inst, disp, tot, {", ".join(_P)}, 1 FROM snap)
SELECT g.district, g.m, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ("instituted", "disposed", "pending", "coverage", *_P))} FROM grid g LEFT JOIN fx USING (district, m) WHERE g.m >= {START}"""


def skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seam.aged_panel(src.cube(spark, sf_dir))
    return rows.select("district", "m", F.round(panel.bowley_skew([F.col(b).cast("double") for b in seam.BUCKETS], list(seam.EDGES)), 6).alias("skew"))


SKEWED = f"""{BASE}, {GRID}, {EDGE_ROWS},
ag AS (SELECT g.district, g.m, b, lo, hi, coalesce(sum(n), 0) AS n FROM grid g CROSS JOIN edges LEFT JOIN cube c ON c.district = g.district AND c.f BETWEEN {C.first} AND g.m AND (c.d IS NULL OR c.d > g.m) AND g.m - c.f >= 12 * lo AND (g.m - c.f < 12 * hi OR b = 6) GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER (PARTITION BY district, m ORDER BY b) AS upto, sum(n) OVER (PARTITION BY district, m) AS tot FROM ag),
qs AS (SELECT district, m, q, min_by(lo + (tot * q / 4.0 - (upto - n)) / n * (hi - lo), b) FILTER (n > 0 AND 4 * upto >= q * tot) AS v FROM cu CROSS JOIN (VALUES (1), (2), (3)) k(q) GROUP BY ALL),
w AS (SELECT district, m, max(v) FILTER (q = 1) AS a, max(v) FILTER (q = 2) AS b, max(v) FILTER (q = 3) AS c FROM qs GROUP BY ALL)
SELECT district, m, round((c + a - 2 * b) / nullif(c - a, 0), 6) AS skew FROM w"""


def district_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = src.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_regionkey") * 1000 + F.col("n_nationkey")).alias("district"))
    tenures = src.postings(spark, sf_dir).select(F.col("district").alias("nation"), (F.col("e") - F.col("s") + 1 + F.pmod("court", F.lit(5))).alias("months")).join(nation, "nation").select("district", "months")
    out = drivers.district_drivers(src.valid_cases(spark, sf_dir), tenures, MARKED, START, START + 47)
    return r6(out, "courts", "filed_per_year", "log_filings", "log_filings_per_court", "marked_share", "tenure", "disposal_ratio")


DRIVERS = f"""{BASE}, {POSTS}, mv AS (SELECT district, court, f AS m, 1 AS a, 0 AS b FROM valid UNION ALL SELECT district, court, d, 0, 1 FROM valid),
ok AS (SELECT * FROM mv WHERE m BETWEEN {START} AND {START + 47}), ct AS (SELECT district, avg(c) AS courts FROM (SELECT district, m, count(DISTINCT court) AS c FROM ok GROUP BY ALL) AS x GROUP BY district),
fl AS (SELECT district, sum(a) / 4.0 AS y, sum(b) / nullif(sum(a), 0) AS ratio FROM ok GROUP BY district), ms AS (SELECT district, avg(CASE WHEN {MARKED} THEN 1.0 ELSE 0.0 END) AS ms FROM valid GROUP BY district),
tn AS (SELECT n_regionkey * 1000 + n_nationkey AS district, median(e - s + 1 + court % 5) AS t FROM posts JOIN nation ON n_nationkey = posts.district GROUP BY ALL)
SELECT district, round(courts, 6) AS courts, round(y, 6) AS filed_per_year, round(CASE WHEN y > 0 THEN ln(y) END, 6) AS log_filings, round(CASE WHEN y > 0 THEN ln(y / courts) END, 6) AS log_filings_per_court, round(ms, 6) AS marked_share, round(t, 6) AS tenure, round(ratio, 6) AS disposal_ratio
FROM ct JOIN fl USING (district) JOIN ms USING (district) LEFT JOIN tn USING (district)"""


def _seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = src.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("district"), F.col("n_regionkey").alias("state"))
    posts = src.postings(spark, sf_dir).join(states, "district").withColumn("cadre", F.pmod("court", F.lit(3)))
    return drivers.seats_by_cadre(posts, 2)


def instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(drivers.shift_share(_seats(spark, sf_dir), 2, 1997), "z")


def decembers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drivers.recorded_each_december(_seats(spark, sf_dir))


SEATS = f"""WITH {POSTS}, mo AS (SELECT DISTINCT district, court, unnest(range(s, least(e, {C.last}) + 1)) AS m FROM posts),
un AS (SELECT n_regionkey AS state, n_nationkey AS district, unnest(range({C.first}, {C.last + 1})) AS m FROM nation WHERE n_nationkey IN (SELECT district FROM posts)),
st AS (SELECT un.state, un.district, un.m, k, count(mo.court) AS n FROM un CROSS JOIN (VALUES (0), (1), (2)) c(k) LEFT JOIN mo ON mo.district = un.district AND mo.m = un.m AND mo.court % 3 = k GROUP BY ALL)"""
INSTRUMENT = f"""{SEATS}, al AS (SELECT *, sum(n) OVER (PARTITION BY state, m, k) AS tot FROM st), bs AS (SELECT district, k, avg(n) AS share, avg(tot) AS base FROM al WHERE m // 12 = 1997 GROUP BY ALL),
z AS (SELECT al.district, al.m, sum(share / nullif(whole, 0) * CASE WHEN tot > 0 AND base > 0 THEN ln(tot) - ln(base) ELSE 0 END) AS z FROM al JOIN bs USING (district, k) JOIN (SELECT district, sum(share) AS whole FROM bs GROUP BY district) w ON w.district = al.district GROUP BY ALL)
SELECT district, m, round(CASE WHEN count(z) OVER w = 12 THEN avg(z) OVER w END, 6) AS z FROM z WINDOW w AS (PARTITION BY district ORDER BY m ROWS 11 PRECEDING)"""
DECEMBERS = f"{SEATS} SELECT m // 12 AS year, CAST(sum(n) AS BIGINT) AS working FROM st WHERE m % 12 = 11 GROUP BY m // 12"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(district, m, target, y, anchor): the next year's growth and clearance and the last year's; rows without either go."""
    from pyspark.sql import Window

    own = Window.partitionBy("district").orderBy("m")
    rows = panel.stock_flow(src.cube(spark, sf_dir)).select("district", "m", "pending", panel.rolling("instituted", 12).alias("a12"), panel.rolling("disposed", 12).alias("d12"))
    rows = rows.select("*", F.lead("pending", 12).over(own).alias("ahead"), F.lag("pending", 12).over(own).alias("past"), F.lead("a12", 12).over(own).alias("a_next"), F.lead("d12", 12).over(own).alias("d_next"))
    change = lambda now, then: F.when((F.col(now) > 0) & (F.col(then) > 0), F.ln(F.col(now) / F.col(then)))
    both = F.array(F.struct(F.lit("growth").alias("target"), change("ahead", "pending").alias("y"), change("pending", "past").alias("anchor")), F.struct(F.lit("cr").alias("target"), F.try_divide("d_next", "a_next").alias("y"), F.try_divide("d12", "a12").alias("anchor")))
    return rows.select("district", "m", F.explode(both).alias("x")).select("district", "m", "x.*").where("y is not null and anchor is not null")


def naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinball losses of drift, climatology and last year's cross-section in the year after each fold's start."""
    rows = targets(spark, sf_dir).withColumn("fold", F.explode(F.array(*map(F.lit, FOLDS))))
    part = lambda c, x: F.percentile(F.when(c, x), list(TAUS))
    train, last = F.col("m") < F.col("fold") - 18 - 12, F.col("m").between(F.col("fold") - 24, F.col("fold") - 13)
    fits = rows.groupBy("fold", "target").agg(part(train, F.col("y") - F.col("anchor")).alias("drift"), part(train, F.col("y")).alias("clim"), part(last, F.col("y")).alias("last"))
    fits = fits.select("fold", "target", F.posexplode(F.arrays_zip("drift", "clim", "last")).alias("k", "q")).select("fold", "target", F.element_at(F.array(*map(F.lit, TAUS)), F.col("k") + 1).alias("tau"), "q.*")
    met = rows.where(F.col("m").between(F.col("fold"), F.col("fold") + 11)).join(fits, ["fold", "target"])
    loss = lambda q: F.round(F.avg(F.greatest(F.col("tau") * (F.col("y") - q), (F.col("tau") - 1) * (F.col("y") - q))), 6)
    return met.groupBy("fold", "target", "tau").agg(F.count("*").alias("n"), loss(F.col("anchor") + F.col("drift")).alias("drift"), loss(F.col("clim")).alias("climatology"), loss(F.col("last")).alias("last_year_xs"))


def _quantiles(name: str, x: str, where: str) -> str:
    return ", ".join(f"quantile_cont({x}, {tau}) FILTER ({where}) AS {name}{k}" for k, tau in enumerate(TAUS))


NAIVE = f"""{BASE}, {GRID}, {FULL}, r AS (SELECT district, m, pending, CASE WHEN count(*) OVER w = 12 THEN sum(instituted) OVER w END AS a12, CASE WHEN count(*) OVER w = 12 THEN sum(disposed) OVER w END AS d12 FROM stock WINDOW w AS (PARTITION BY district ORDER BY m ROWS 11 PRECEDING)),
s AS (SELECT *, lead(pending, 12) OVER o AS ahead, lag(pending, 12) OVER o AS past, lead(a12, 12) OVER o AS an, lead(d12, 12) OVER o AS dn FROM r WINDOW o AS (PARTITION BY district ORDER BY m)),
t AS (SELECT m, 'growth' AS target, CASE WHEN ahead > 0 AND pending > 0 THEN ln(ahead / pending) END AS y, CASE WHEN pending > 0 AND past > 0 THEN ln(pending / past) END AS anchor FROM s UNION ALL SELECT m, 'cr', dn / nullif(an, 0), d12 / nullif(a12, 0) FROM s),
x AS (SELECT * FROM t CROSS JOIN (VALUES {", ".join(f"({f})" for f in FOLDS)}) v(fold) WHERE y IS NOT NULL AND anchor IS NOT NULL),
ft AS (SELECT fold, target, {_quantiles("d", "y - anchor", "m < fold - 30")}, {_quantiles("c", "y", "m < fold - 30")}, {_quantiles("l", "y", "m BETWEEN fold - 24 AND fold - 13")} FROM x GROUP BY ALL),
u AS ({" UNION ALL ".join(f"SELECT fold, target, CAST({tau} AS DOUBLE) AS tau, y, anchor + d{k} AS d, c{k} AS c, l{k} AS l FROM x JOIN ft USING (fold, target) WHERE m BETWEEN fold AND fold + 11" for k, tau in enumerate(TAUS))})
SELECT fold, target, tau, count(*) AS n, {", ".join(f"round(avg(greatest(tau * (y - {q}), (tau - 1) * (y - {q}))), 6) AS {n}" for q, n in (("d", "drift"), ("c", "climatology"), ("l", "last_year_xs")))} FROM u GROUP BY fold, target, tau"""


def _matrix(spark: SparkSession, sf_dir: str):
    """One row a district and month, which their number bounds: features, growth ahead, growth behind, month, state, stock."""
    t = targets(spark, sf_dir).where("target = 'growth'").select("district", "m", "y", "anchor")
    rows = seam.aged_panel(src.cube(spark, sf_dir)).join(t, ["district", "m"]).toPandas().sort_values(["district", "m"])
    stock = rows[seam.BUCKETS].sum(axis=1)
    x = np.c_[rows.anchor, np.log1p(rows.instituted), np.log1p(rows.disposed), rows[seam.BUCKETS[:4]].div(stock.clip(lower=1), axis=0), rows.m % 12].astype(float)
    return x, rows.y.to_numpy(float), rows.anchor.to_numpy(float), rows.m.to_numpy(int), rows.district.to_numpy(int), stock.to_numpy(float)


def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, anchor, month, *_ = _matrix(spark, sf_dir)
    return spark.createDataFrame(boosting.validated(x, y, anchor, month, list(FOLDS)), "fold int, tau double, n int, pinball double, drift double, skill double, coverage double")


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute attribution by family of features to the median of the last fold's forecasts."""
    x, y, anchor, month, *_ = _matrix(spark, sf_dir)
    models, part = boosting.fit_suite(x, y, anchor, month, FOLDS[-1])
    each = models[1].attributed(x[part["validate"]])[:, 1:]
    families = {"trend": [0], "flows": [1, 2], "ages": [3, 4, 5, 6], "season": [7]}
    return spark.createDataFrame([(n, float(np.abs(each[:, js].sum(1)).mean())) for n, js in families.items()], "family string, mean_abs double")


def graded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted, drift and no-change forecasts of a state's stock after a year: error, bias, and reduction against drift."""
    x, y, anchor, month, district, stock = _matrix(spark, sf_dir)
    models, part = boosting.fit_suite(x, y, anchor, month, FOLDS[-1])
    at = month == FOLDS[-1]
    state = district[at] // 1000
    total = lambda g: np.array([(stock[at] * np.exp(g))[state == s].sum() / stock[at][state == s].sum() for s in np.unique(state)])
    actual = np.log(total(y[at]))
    found = {"boosted": boosting.predicted(models, x[at], anchor[at])[:, 1], "drift": anchor[at] + np.median((y - anchor)[part["train"]]), "none": np.zeros(at.sum())}
    error = {n: np.log(total(g)) - actual for n, g in found.items()}
    rows = []
    for n, e in error.items():
        low, high = est.skill_bounds(np.abs(e), np.abs(error["drift"]), 5000, 0)
        rows.append((n, len(e), float(np.abs(e).mean()), float(e.mean()), float(np.abs(e - e.mean()).mean()), float(1 - np.abs(e).sum() / np.abs(error["drift"]).sum()), low, high))
    return spark.createDataFrame(rows, "forecaster string, states int, mae double, bias double, mae_bias_removed double, reduction double, low double, high double")


def queries() -> dict:
    return {
        "K13_scrape_summary": scraped, "K14_seam_harmonisation": harmonised, "K15_bowley_skew": skewed, "F4_district_drivers": district_drivers, "F5_shift_share": instrument, "F6_judge_coverage": decembers,
        "M19_naive_benchmarks": naive, "M5_M23_quantile_boosting": boosted, "M10_attributions": attributions, "M18_state_grading": graded_states,
    }


def oracle_sql() -> dict[str, str]:
    return {"K13_scrape_summary": SCRAPED, "K14_seam_harmonisation": HARMONISED, "K15_bowley_skew": SKEWED, "F4_district_drivers": DRIVERS, "F5_shift_share": INSTRUMENT, "F6_judge_coverage": DECEMBERS, "M19_naive_benchmarks": NAIVE}
