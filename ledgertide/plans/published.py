"""Published figures and estimators as DataFrame operators, each with SQL written on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.functions.calendar import CALENDAR as C
from ledgertide.operators import estimation as est
from ledgertide.operators import panel, records, survival
from ledgertide.plans import core
from ledgertide.plans.core import BASE, r6
from ledgertide.sources import lifecycle as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LAST = 24022  # the month in which waiting is measured
FIFTHS = (0.2, 0.4, 0.6, 0.8)


def add(name: str, sql: str):
    def keep(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


@add("P1_rename_project", "SELECT l_orderkey AS case_id, l_suppkey AS court_no, l_linestatus AS state_of_case FROM lineitem")
def renamed(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("court_no"), F.col("l_linestatus").alias("state_of_case"))


@add("O5_distinct", "SELECT l_orderkey, l_suppkey, l_linestatus FROM lineitem GROUP BY ALL")
def distinct(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus").distinct()


@add("K11_waiting_years", f"""{BASE}, p AS (SELECT district, {LAST} - f AS age, sum(n) AS n FROM cube WHERE f <= {LAST} AND coalesce(d, {LAST} + 1) > {LAST} GROUP BY ALL),
one AS (SELECT district, age, unnest(range(CAST(n AS BIGINT))) AS copy FROM p)
SELECT district, CAST(count(*) AS BIGINT) AS pending, round(sum(age) / 12.0, 4) AS case_years, round(avg(age) / 12.0, 6) AS mean_age_years, round(quantile_disc(age, 0.5) / 12.0, 6) AS median_age_years,
  round(avg(CAST(age >= 12 AS INT)), 6) AS over_1y, round(avg(CAST(age >= 36 AS INT)), 6) AS over_3y, round(avg(CAST(age >= 60 AS INT)), 6) AS over_5y FROM one GROUP BY district""")
def waiting(spark, sf_dir):
    """Ages of pending cases by district; the median is the least age up to which half of them are."""
    age = F.lit(LAST) - F.col("f")
    p = src.cube(spark, sf_dir).where((F.col("f") <= LAST) & (F.col("d").isNull() | (F.col("d") > LAST))).groupBy("district", age.alias("age")).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("district").orderBy("age"))
    p = p.withColumn("half", 2 * upto >= F.sum("n").over(Window.partitionBy("district")))
    over = lambda k: (F.sum(F.when(F.col("age") >= 12 * k, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"over_{k}y")
    years = F.sum(F.col("n") * F.col("age")) / 12
    out = p.groupBy("district").agg(F.sum("n").alias("pending"), F.round(years, 4).alias("case_years"), (years / F.sum("n")).alias("mean_age_years"), (F.min(F.when(F.col("half"), F.col("age"))) / 12).alias("median_age_years"), over(1), over(3), over(5))
    return r6(out, "mean_age_years", "median_age_years", "over_1y", "over_3y", "over_5y")


@add("Q12_map_rollup", f"""{BASE}, u AS (SELECT district, sum(n) AS n, sum(n) FILTER (d IS NULL) / sum(n) AS x FROM cube GROUP BY district),
m AS (SELECT (district % 1000) % 7 AS shape, sum(n * coalesce(x, 0)) / sum(n) AS x FROM u GROUP BY 1)
SELECT shape, round(x, 6) AS x, CAST(len(list_filter((SELECT quantile_cont(x, [{", ".join(map(str, FIFTHS))}]) FROM m), lambda c: c <= x)) AS INT) AS bin FROM m""")
def mapped(spark, sf_dir):
    """Shapes with several districts take their cases-weighted mean, and the fifth that it falls in."""
    u = src.cube(spark, sf_dir).groupBy("district").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("d").isNull(), F.col("n")).otherwise(0)).alias("open"))
    m = u.groupBy(F.pmod(F.col("district") % 1000, F.lit(7)).alias("shape")).agg((F.sum("open") / F.sum("n")).alias("x"))
    cuts = m.agg(F.percentile("x", F.array(*map(F.lit, FIFTHS))).alias("cuts"))
    return m.crossJoin(F.broadcast(cuts)).select("shape", F.round("x", 6).alias("x"), F.size(F.filter("cuts", lambda c: c <= F.col("x"))).alias("bin"))  # one row of cuts


HISTOGRAM = f"""{BASE}, h AS (SELECT least(coalesce(d, {C.last}) - f, 97) AS dur, sum(n) AS n, sum(CASE WHEN d IS NOT NULL THEN n ELSE 0 END) AS events FROM cube GROUP BY 1)"""


@add("K10_workload_weights", f"""{HISTOGRAM}, r AS (SELECT a.dur, (SELECT sum(n) FROM h b WHERE b.dur >= a.dur) AS risk, coalesce((SELECT sum(events) FROM h b WHERE b.dur = a.dur), 0) AS events FROM range(97) AS a(dur)),
s AS (SELECT dur, (SELECT product(CASE WHEN b.risk > 0 THEN 1 - b.events / b.risk ELSE 1 END) FROM r b WHERE b.dur <= a.dur) AS s FROM r a),
t AS (SELECT (SELECT s FROM s WHERE dur = 96) AS s96, least(greatest(-ln(greatest((SELECT s FROM s WHERE dur = 96), 1e-9) / greatest((SELECT s FROM s WHERE dur = 84), 1e-9)) / 12, 0.001), 1) AS tail),
life AS (SELECT dur AS age, ((SELECT sum(s) FROM s b WHERE b.dur >= a.dur) + s96 / tail) / greatest(coalesce((SELECT s FROM s b WHERE b.dur = a.dur - 1), 1), 1e-9) AS life, tail FROM s a, t)
SELECT CAST(e.bucket AS INT) AS bucket, round(coalesce((SELECT life FROM life WHERE age = 12 * e.lo), 1 / (SELECT any_value(tail) FROM life)) / (SELECT life FROM life WHERE age = 0), 6) AS weight
FROM (VALUES {", ".join(f"({k}, {a})" for k, a in enumerate(panel.AGE_EDGES))}) AS e(bucket, lo)""")
def workload(spark, sf_dir):
    """What a case of each age band still takes, against a new one."""
    life = est.remaining_months(core.histograms(spark, sf_dir), 96)
    fresh = life.agg(F.max(F.when(F.col("age") == 0, F.col("life"))).alias("fresh"), F.max("tail").alias("beyond"))
    edges = spark.createDataFrame([(k, 12 * a) for k, a in enumerate(panel.AGE_EDGES)], "bucket int, age int")
    return edges.join(life.select("age", "life"), "age", "left").crossJoin(F.broadcast(fresh)).select("bucket", F.round(F.coalesce("life", 1 / F.col("beyond")) / F.col("fresh"), 6).alias("weight"))


MONTHS = f"{BASE}, months AS (SELECT unnest(range({C.first}, {C.last + 1})) AS m FROM (SELECT 1 FROM cube LIMIT 1) AS one)"


@add("M6_purged_split", f"""{MONTHS}, free AS (SELECT list(m ORDER BY m) AS ms FROM months WHERE m + 12 < {C.base_year * 12}),
held AS (SELECT ms[greatest(len(ms) - 11, 1):] AS hs FROM free), cut AS (SELECT hs[1] AS first, hs[len(hs) // 2 + 1] AS middle, hs[-1] AS last FROM held)
SELECT CASE WHEN m >= {C.base_year * 12} THEN 'validate' WHEN m >= middle AND m <= last THEN 'conformal' WHEN m >= first AND m < middle THEN 'stop' WHEN m + 12 < first THEN 'train' END AS part, CAST(m AS INT) AS m
FROM months, cut WHERE m >= {C.base_year * 12} OR m <= last AND m >= first OR m + 12 < first""")
def folds(spark, sf_dir):
    return est.fold_parts(panel.stock_flow(src.cube(spark, sf_dir)).select("m"), 12, C.base_year * 12, 12).select("part", F.col("m").cast("int").alias("m"))


BREAK = (C.first + 25, C.first + 27)


@add("M6_purged_breaks", f"""{MONTHS}, ok AS (SELECT m FROM months WHERE NOT EXISTS (SELECT 1 FROM range({BREAK[0]}, {BREAK[1] + 1}) b(x) WHERE x BETWEEN m AND m + 6)),
free AS (SELECT list(m ORDER BY m) AS ms FROM ok WHERE m + 6 < {C.base_year * 12}),
held AS (SELECT ms[greatest(len(ms) - 23, 1):] AS hs, ms FROM free), cut AS (SELECT hs[1] AS first, hs[len(hs) // 2 + 1] AS middle, hs, ms FROM held)
SELECT CASE WHEN m >= {C.base_year * 12} THEN 'validate' WHEN list_contains(hs, m) AND m >= middle THEN 'conformal' WHEN list_contains(hs, m) THEN 'stop' ELSE 'train' END AS part, CAST(m AS INT) AS m
FROM months, cut WHERE m >= {C.base_year * 12} OR list_contains(hs, m) OR list_contains(ms, m) AND m + 6 < first""")
def broken_folds(spark, sf_dir):
    """Folds of half a year ahead, 24 months of calibration, three months taken as a break."""
    return est.fold_parts(panel.stock_flow(src.cube(spark, sf_dir)).select("m"), 6, C.base_year * 12, 24, (BREAK,)).select("part", F.col("m").cast("int").alias("m"))


@add("M8_least_squares", f"""WITH r AS (SELECT ln(pending) AS y, ln(instituted) AS a, ln(disposed + 1) AS b FROM ({core.STOCK}) AS sf WHERE pending > 0 AND instituted > 0),
c AS (SELECT avg(y) AS y, avg(a) AS a, avg(b) AS b, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, var_pop(y) AS yy FROM r),
k AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS sa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS sb FROM c)
SELECT 'constant' AS term, round(y - sa * a - sb * b, 6) AS value FROM k UNION ALL SELECT 'a', round(sa, 6) FROM k UNION ALL SELECT 'b', round(sb, 6) FROM k
UNION ALL SELECT 'r2', round((sa * ay + sb * by_) / yy, 6) FROM k""")
def least_squares(spark, sf_dir):
    rows = panel.stock_flow(src.cube(spark, sf_dir)).where("pending > 0 and instituted > 0").select(F.ln("pending").alias("y"), F.ln("instituted").alias("a"), F.ln(F.col("disposed") + 1).alias("b"))
    beta = est.ols(rows, "y", ["a", "b"])
    fitted = float(beta[0]) + float(beta[1]) * F.col("a") + float(beta[2]) * F.col("b")
    r2 = rows.agg((1 - F.avg((F.col("y") - fitted) ** 2) / F.var_pop("y")).alias("r2")).first().r2
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in zip(("constant", "a", "b", "r2"), (*beta, r2), strict=True)], "term string, value double")


YEAR = 2000


@add("M21_bench_additions", f"""{BASE}, v AS (SELECT district, CAST(sum(n) FILTER (f BETWEEN {12 * YEAR} AND {12 * YEAR + 11}) AS DOUBLE) AS a, CAST(coalesce(sum(n) FILTER (d BETWEEN {12 * YEAR} AND {12 * YEAR + 11}), 0) AS DOUBLE) AS d FROM cube GROUP BY district),
g AS (SELECT v.district, x, greatest(any_value(a) - any_value(v.d), 0) AS excess, sum(any_value_d * (pow(1 + x * CASE WHEN t > 6 THEN 1 - exp((6 - t) / 6.0) ELSE 0 END / 4.0, 0.6) - 1)) AS gain
  FROM (SELECT *, d / 12 AS any_value_d FROM v) AS v, range(81) AS xs(x), range(1, 37) AS ts(t) GROUP BY v.district, x)
SELECT district, coalesce(CAST(min(x) FILTER (gain >= excess) AS DOUBLE), CAST('infinity' AS DOUBLE)) AS judges FROM g GROUP BY district""")
def bench(spark, sf_dir):
    """Judges that would have to join a bench of 4 so that the year's excess of filings is decided within three years."""
    year = lambda c: F.sum(F.when(F.floor(F.col(c) / 12) == YEAR, F.col("n")).otherwise(0)).cast("double")
    v = src.cube(spark, sf_dir).groupBy("district").agg(year("f").alias("a"), year("d").alias("d"))
    v = v.select("district", F.lit(4.0).alias("bench"), (F.col("d") / 12).alias("pace"), F.greatest(F.col("a") - F.col("d"), F.lit(0.0)).alias("excess"))
    return est.judges_needed(v, "bench", "pace", "excess", 0.6).select("district", "judges")


def _state_types() -> str:
    body = core.km_sql("state, case_type", True)
    return f"WITH k AS ({body}) SELECT case_type, " + ", ".join(f"round(sum(CASE WHEN {c} IS NOT NULL THEN {c} * cases END) / sum(CASE WHEN {c} IS NOT NULL THEN cases END), 6) AS {c}" for c in ("pending_1y", "pending_3y", "pending_5y")) + " FROM k GROUP BY case_type"


@add("Q2_state_average", _state_types())
def state_average(spark, sf_dir):
    cube = src.truncated_cube(spark, sf_dir)
    rows = survival.spells(cube, records.collection_month(cube), records.completeness_month(cube))
    t = r6(survival.table_of(survival.curves(rows, ["state", "case_type"], min_cases=200), ["state", "case_type"]), "pending_1y", "pending_3y", "pending_5y")  # as published
    mean = lambda c: F.round(F.sum(F.when(F.col(c).isNotNull(), F.col(c) * F.col("cases"))) / F.sum(F.when(F.col(c).isNotNull(), F.col("cases"))), 6).alias(c)
    return t.groupBy("case_type").agg(*[mean(c) for c in ("pending_1y", "pending_3y", "pending_5y")])


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if v}
