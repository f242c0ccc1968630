"""Survival, panel, record and event operators on the lifecycle view, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.functions.calendar import CALENDAR as C
from ledgertide.functions.taxonomy import classify_labels
from ledgertide.functions.text import indian_digits
from ledgertide.operators import events, panel, records, survival
from ledgertide.plans.portable import RULES, Other, _taxonomy, cases
from ledgertide.sources import lifecycle as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


BASE = cases(Other)
GRID = f"grid AS (SELECT district, unnest(range({C.first}, {C.last + 1})) AS m FROM (SELECT DISTINCT district FROM cube) AS u)"
CUT = f"""per AS (SELECT state, district, d, sum(n) AS n FROM cube WHERE d BETWEEN {C.base_year * 12} AND {C.last} GROUP BY ALL),
st AS (SELECT state, d, sum(n) AS n FROM per GROUP BY ALL), sb AS (SELECT state, avg(n) AS level FROM st WHERE d < {C.base_year * 12 + 12} GROUP BY state),
se AS (SELECT state, max(d) AS fin FROM st JOIN sb USING (state) WHERE n >= 0.2 * level GROUP BY state),
db AS (SELECT district, sum(n) / 12.0 AS level FROM per WHERE d < {C.base_year * 12 + 12} GROUP BY district),
de AS (SELECT district, max(d) AS own FROM per JOIN db USING (district) WHERE level > 0 AND n >= 0.5 * level GROUP BY district),
cut AS (SELECT state, district, least(fin, own) AS cut FROM (SELECT DISTINCT state, district FROM cube) AS u LEFT JOIN se USING (state) LEFT JOIN de USING (district))"""
TRUNCATED = BASE.replace("cube AS (SELECT state, district, f, d, case_type, count(*) AS n FROM valid GROUP BY", f"cube AS (SELECT state, district, f, d, case_type, count(*) AS n FROM valid WHERE d IS NULL OR d >= {C.first} + 6 * (nation % 5) GROUP BY")
ENTRY = f"""fil AS (SELECT district, f AS m, sum(n) AS x FROM cube WHERE f BETWEEN {C.first} AND {C.complete_by} GROUP BY ALL),
dcs AS (SELECT district, d AS m, sum(n) AS x FROM cube WHERE d BETWEEN {C.first} AND {C.complete_by} GROUP BY ALL),
cells AS (SELECT district, unnest(range({C.first}, {C.complete_by + 1})) AS m FROM (SELECT DISTINCT district FROM fil) AS u),
dense AS (SELECT c.district, c.m, coalesce(fil.x, 0) AS fil, coalesce(dcs.x, 0) AS dcs FROM cells c LEFT JOIN fil USING (district, m) LEFT JOIN dcs USING (district, m)),
lvl AS (SELECT district, avg(fil) AS level FROM dense WHERE m >= {C.level_from} GROUP BY district),
win AS (SELECT a.district, a.m, sum(b.fil) AS fw, sum(b.dcs) AS dw FROM dense a JOIN dense b ON a.district = b.district AND b.m BETWEEN a.m AND a.m + 5 WHERE a.m <= {C.complete_by - 5} GROUP BY ALL),
ok AS (SELECT district, m, fw >= 3 * level AND (dw >= 0.2 * fw OR m < {C.decisions_from}) AS fine FROM win JOIN lvl USING (district)),
entry AS (SELECT district, min(CASE WHEN NOT EXISTS (SELECT 1 FROM ok b WHERE b.district = a.district AND b.m >= a.m AND NOT b.fine) THEN m END) AS entry FROM ok a GROUP BY district)"""


def km_sql(unit: str, entry: bool, min_cases: int = 200) -> str:
    clip = "least(greatest({}, 0), 120)".format
    ent, joined, keep = (clip("entry - f"), "JOIN entry USING (district)", "AND entry IS NOT NULL") if entry else ("0", "", "")
    return f"""{TRUNCATED if entry else BASE}, {CUT}{", " + ENTRY if entry else ""},
rows AS (SELECT {unit}, n, coalesce(d <= cut, false) AS event, {clip("CASE WHEN d <= cut THEN d ELSE cut END - f")} AS dur, {ent} AS ent FROM cube JOIN cut USING (state, district) {joined} WHERE cut IS NOT NULL AND f <= cut {keep}),
kept AS (SELECT * FROM rows WHERE dur >= ent), tot AS (SELECT {unit}, sum(n) AS cases FROM kept GROUP BY ALL HAVING sum(n) >= {min_cases}),
g AS (SELECT {unit}, cases, unnest(range(0, 121)) AS m FROM tot),
byd AS (SELECT {unit}, dur AS m, sum(n) AS gone, sum(CASE WHEN event THEN n ELSE 0 END) AS dcd FROM kept GROUP BY ALL), bye AS (SELECT {unit}, ent AS m, sum(n) AS come FROM kept GROUP BY ALL),
x AS (SELECT g.*, coalesce(gone, 0) AS gone, coalesce(dcd, 0) AS dcd, coalesce(come, 0) AS come FROM g LEFT JOIN byd USING ({unit}, m) LEFT JOIN bye USING ({unit}, m)),
y AS (SELECT *, sum(come) OVER w - sum(gone) OVER w + gone AS risk FROM x WINDOW w AS (PARTITION BY {unit} ORDER BY m)),
z AS (SELECT *, product(1 - CASE WHEN risk > 0 THEN dcd / risk ELSE 0 END) OVER w AS s, sum(CASE WHEN risk > dcd AND risk > 0 THEN dcd / (risk * (risk - dcd)) ELSE 0 END) OVER w AS gw FROM y WINDOW w AS (PARTITION BY {unit} ORDER BY m)),
q AS (SELECT *, coalesce(min(CASE WHEN risk < 20 THEN m END) OVER (PARTITION BY {unit}) - 1, 120) AS reach FROM z)
SELECT {unit}, CAST(max(cases) AS BIGINT) AS cases, min(CASE WHEN m <= reach AND round(s, 12) <= 0.5 THEN m END) AS median_months, min(CASE WHEN m <= reach AND round(s, 12) <= 0.1 THEN m END) AS p90_months, max(reach) AS followed_months,
  {", ".join(f"round(max(CASE WHEN m = {k} AND m <= reach THEN s END), 6) AS pending_{y}y" for k, y in ((12, 1), (36, 3), (60, 5)))},
  round(greatest(max(CASE WHEN m = 36 AND m <= reach THEN s - 1.96 * s * sqrt(gw) END), CASE WHEN max(reach) >= 36 THEN 0.0 END), 6) AS pending_3y_lo,
  round(least(max(CASE WHEN m = 36 AND m <= reach THEN s + 1.96 * s * sqrt(gw) END), CASE WHEN max(reach) >= 36 THEN 1.0 END), 6) AS pending_3y_hi
FROM q GROUP BY {unit}"""


def _km(unit: list[str], entry: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cube = src.truncated_cube(spark, sf_dir) if entry else src.cube(spark, sf_dir)
        entries = records.completeness_month(cube) if entry else None
        out = survival.time_to_decision(cube, unit, entries).drop("curve")
        return r6(out, "pending_1y", "pending_3y", "pending_5y", "pending_3y_lo", "pending_3y_hi")

    return run


add("K5_kaplan_meier", km_sql("case_type", False))(_km(["case_type"], False))
add("K5_delayed_entry", km_sql("case_type", True))(_km(["case_type"], True))
add("K6_district_curves", km_sql("district", False))(_km(["district"], False))


@add("K7_national_pooled", km_sql("nationwide", True).replace("rows AS (SELECT nationwide,", "rows AS (SELECT 0 AS nationwide,"))
def national(spark, sf_dir):
    cube = src.truncated_cube(spark, sf_dir)
    rows = survival.spells(cube, records.collection_month(cube), records.completeness_month(cube)).withColumn("nationwide", F.lit(0))
    out = survival.table_of(survival.curves(rows, ["nationwide"], min_cases=200), ["nationwide"]).drop("curve")
    return r6(out, "pending_1y", "pending_3y", "pending_5y", "pending_3y_lo", "pending_3y_hi")


@add("K3_collection_month", f"{BASE}, {CUT} SELECT state, district, cut FROM cut")
def collection(spark, sf_dir):
    return records.collection_month(src.cube(spark, sf_dir))


@add("K4_completeness_month", f"{TRUNCATED}, {ENTRY} SELECT district, entry FROM entry")
def completeness(spark, sf_dir):
    return records.completeness_month(src.truncated_cube(spark, sf_dir))


@add("K8_decided_only", f"{BASE}, {CUT}, x AS (SELECT case_type, d - f AS m, sum(n) AS n FROM cube JOIN cut USING (state, district) WHERE f <= cut AND d <= cut GROUP BY ALL), y AS (SELECT *, sum(n) OVER (PARTITION BY case_type ORDER BY m) AS upto, sum(n) OVER (PARTITION BY case_type) AS every FROM x) SELECT case_type, CAST(sum(n) AS BIGINT) AS decided_cases, min(CASE WHEN 2 * upto >= every THEN m END) AS median_months, round(sum(m * n) / sum(n), 6) AS mean_months FROM y GROUP BY case_type")
def decided(spark, sf_dir):
    return r6(survival.decided_only(src.cube(spark, sf_dir)), "mean_months")


@add("K9_duration_histograms", f"{BASE} SELECT state, least(coalesce(d, {C.last}) - f, 97) AS dur, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN d IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS events FROM cube GROUP BY ALL")
def histograms(spark, sf_dir):
    cube = src.cube(spark, sf_dir)
    return cube.groupBy("state", F.least(F.coalesce("d", F.lit(C.last)) - F.col("f"), F.lit(97)).alias("dur")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("d").isNotNull(), F.col("n")).otherwise(0)).alias("events"))


STOCK = f"""{BASE}, {GRID} SELECT g.district, g.m, CAST(coalesce(sum(n) FILTER (f = g.m), 0) AS BIGINT) AS instituted, CAST(coalesce(sum(n) FILTER (d = g.m), 0) AS BIGINT) AS disposed,
CAST(coalesce(sum(n) FILTER (f <= g.m AND (d IS NULL OR d > g.m)), 0) AS BIGINT) AS pending FROM grid g LEFT JOIN (SELECT * FROM cube WHERE f BETWEEN {C.first} AND {C.last}) c ON c.district = g.district GROUP BY g.district, g.m"""


@add("K1_stock_flow", STOCK)
def stock(spark, sf_dir):
    return panel.stock_flow(src.cube(spark, sf_dir))


@add("K2_age_buckets", f"""{BASE}, {GRID}, edges(bucket, lo, hi) AS (VALUES {", ".join(f"({k}, {12 * a}, {12 * b})" for k, (a, b) in enumerate(zip(panel.AGE_EDGES, [*panel.AGE_EDGES[1:], 1000], strict=True)))}),
u AS (SELECT DISTINCT c.district, bucket FROM cube c JOIN edges ON f + lo <= {C.last} AND (d IS NULL OR d > f + lo) WHERE f BETWEEN {C.first} AND {C.last})
SELECT g.district, g.m, u.bucket, CAST(coalesce(sum(n), 0) AS BIGINT) AS pending FROM grid g JOIN u ON u.district = g.district JOIN edges e ON e.bucket = u.bucket
LEFT JOIN cube c ON c.district = g.district AND c.f >= {C.first} AND g.m - c.f >= e.lo AND g.m - c.f < e.hi AND (c.d IS NULL OR c.d > g.m) GROUP BY ALL""")
def ages(spark, sf_dir):
    return panel.age_stock(src.cube(spark, sf_dir))


@add("J9_interval_stabbing", STOCK.replace("SELECT g.district, g.m, CAST(coalesce(sum(n) FILTER (f = g.m), 0) AS BIGINT) AS instituted, CAST(coalesce(sum(n) FILTER (d = g.m), 0) AS BIGINT) AS disposed,", "SELECT g.district, g.m,"))
def stabbing(spark, sf_dir):
    return panel.stock_flow(src.cube(spark, sf_dir)).select("district", "m", "pending")


FULL = f"stock AS ({STOCK.split(GRID + ' ')[1]})"


@add("W1_rolling", f"{BASE}, {GRID}, {FULL} SELECT district, m, CASE WHEN count(*) OVER w = 12 THEN CAST(sum(instituted) OVER w AS BIGINT) END AS a12, CASE WHEN count(*) OVER w = 12 THEN round(avg(disposed) OVER w, 6) END AS d12 FROM stock WINDOW w AS (PARTITION BY district ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolled(spark, sf_dir):
    rows = panel.stock_flow(src.cube(spark, sf_dir))
    return rows.select("district", "m", panel.rolling("instituted", 12).alias("a12"), F.round(panel.rolling("disposed", 12, how=F.avg), 6).alias("d12"))


def _features(e_rows: DataFrame) -> DataFrame:
    q = lambda p: panel.rolling("instituted", 24, how=lambda x: F.percentile(x, p))
    rows = e_rows.select("district", "m", "instituted", "disposed", "pending", q(0.5).alias("q50"), (q(0.75) - q(0.25)).alias("iqr"), panel.rolling("instituted", 3, how=F.avg).alias("mean3"), panel.rolling("instituted", 12).alias("a12"), panel.rolling("disposed", 12).alias("d12"))
    from pyspark.sql import Window

    own = Window.partitionBy("district").orderBy("m")
    shock = (F.col("mean3") - F.lag("q50", 3).over(own)) / F.greatest(F.lag("iqr", 3).over(own) / 1.349, F.lit(1.0))
    ahead = F.lead("pending", 12).over(own)
    return rows.select("district", "m", F.round("q50", 9).alias("q50"), F.round("iqr", 9).alias("iqr"), F.round(shock, 9).alias("shock_z"), F.round(F.try_divide("a12", "d12"), 9).alias("idvr_12"), F.round(F.try_divide("d12", "a12"), 9).alias("clearance"), F.round(F.when((F.col("pending") > 0) & (ahead > 0), F.ln(ahead / F.col("pending"))), 9).alias("growth_12"))


@add("F1_features", f"""{BASE}, {GRID}, {FULL}, w AS (SELECT district, m, pending,
  CASE WHEN count(*) OVER t24 = 24 THEN quantile_cont(instituted, 0.5) OVER t24 END AS q50, CASE WHEN count(*) OVER t24 = 24 THEN quantile_cont(instituted, 0.75) OVER t24 - quantile_cont(instituted, 0.25) OVER t24 END AS iqr,
  CASE WHEN count(*) OVER t3 = 3 THEN avg(instituted) OVER t3 END AS mean3, CASE WHEN count(*) OVER t12 = 12 THEN sum(instituted) OVER t12 END AS a12, CASE WHEN count(*) OVER t12 = 12 THEN sum(disposed) OVER t12 END AS d12
  FROM stock WINDOW t24 AS (PARTITION BY district ORDER BY m ROWS 23 PRECEDING), t12 AS (PARTITION BY district ORDER BY m ROWS 11 PRECEDING), t3 AS (PARTITION BY district ORDER BY m ROWS 2 PRECEDING)),
v AS (SELECT *, lag(q50, 3) OVER o AS q50l, lag(iqr, 3) OVER o AS iqrl, lead(pending, 12) OVER o AS ahead FROM w WINDOW o AS (PARTITION BY district ORDER BY m))
SELECT district, m, round(q50, 9) AS q50, round(iqr, 9) AS iqr, round((mean3 - q50l) / CASE WHEN iqrl IS NULL THEN 1 ELSE greatest(iqrl / 1.349, 1) END, 9) AS shock_z, round(a12 / nullif(d12, 0), 9) AS idvr_12, round(d12 / nullif(a12, 0), 9) AS clearance, round(CASE WHEN pending > 0 AND ahead > 0 THEN ln(ahead / pending) END, 9) AS growth_12 FROM v""")
def features(spark, sf_dir):
    return _features(panel.stock_flow(src.cube(spark, sf_dir)))


@add("W5_first_active_month", f"""{BASE}, {GRID}, {FULL}, a AS (SELECT district, m, instituted AS x, quantile_cont(instituted, 0.9) OVER (PARTITION BY district ORDER BY m) AS typical FROM stock)
SELECT district, m, round(typical, 6) AS typical, m - (SELECT min(b.m) FROM a b WHERE b.district = a.district AND b.m <= a.m AND b.x >= 0.1 * a.typical) AS months_on FROM a""")
def active(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("district").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    rows = panel.stock_flow(src.cube(spark, sf_dir)).select("district", "m", F.percentile("instituted", 0.9).over(w).alias("typical"), F.collect_list("instituted").over(w).alias("past"))
    since = F.array_position(F.transform("past", lambda x: x >= 0.1 * F.col("typical")), True) - 1
    return rows.select("district", "m", F.round("typical", 6).alias("typical"), (F.col("m") - C.first - since).alias("months_on"))


@add("W6_later_windows_hold", f"{TRUNCATED}, {ENTRY} SELECT district, CAST(count(*) FILTER (fine) AS BIGINT) AS windows_fine, count(*) AS windows FROM ok GROUP BY district")
def windows_fine(spark, sf_dir):
    cube = src.truncated_cube(spark, sf_dir)
    grid = panel.stock_flow(cube).where(F.col("m") <= C.complete_by)
    from pyspark.sql import Window

    ahead = Window.partitionBy("district").orderBy("m").rowsBetween(0, 5)
    level = F.sum(F.when(F.col("m") >= C.level_from, F.col("instituted"))).over(Window.partitionBy("district")) / (C.complete_by - C.level_from + 1)
    seen = grid.select("district", "m", F.sum("instituted").over(ahead).alias("fw"), F.sum("disposed").over(ahead).alias("dw"), level.alias("level")).where(F.col("m") <= C.complete_by - 5)
    fine = (F.col("fw") >= 3 * F.col("level")) & ((F.col("dw") >= 0.2 * F.col("fw")) | (F.col("m") < C.decisions_from))
    return seen.groupBy("district").agg(F.count(F.when(fine, 1)).alias("windows_fine"), F.count("*").alias("windows"))


POSTS = "posts AS (SELECT s_nationkey AS district, s_suppkey AS court, CAST(23940 + s_suppkey % 18 + 18 * k AS INT) AS s, CAST(23955 + s_suppkey % 18 + 18 * k AS INT) AS e FROM (SELECT s_nationkey, s_suppkey, unnest(range(0, 5)) AS k FROM supplier) AS x)"


@add("J10_posting_months", f"WITH {POSTS}, mon AS (SELECT DISTINCT district, court, unnest(range(s, least(e, {C.last}) + 1)) AS m FROM posts), seat AS (SELECT district, court, unnest(range({C.first}, {C.last + 1})) AS m FROM (SELECT DISTINCT district, court FROM mon) AS u) SELECT seat.district, seat.m, count(mon.m) AS working, count(CASE WHEN EXISTS (SELECT 1 FROM mon b WHERE b.district = seat.district AND b.court = seat.court AND b.m BETWEEN seat.m - 35 AND seat.m) THEN 1 END) AS staffed FROM seat LEFT JOIN mon USING (district, court, m) GROUP BY ALL")
def posted(spark, sf_dir):
    return panel.occupancy(src.postings(spark, sf_dir))


@add("P6_taxonomy", f"SELECT p_partkey, {_taxonomy(Other, 'p_name')} AS class FROM part")
def taxonomy(spark, sf_dir):
    return classify_labels(src.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", RULES, "other", "class").select("p_partkey", "class")


@add("P12_indian_digits", "SELECT c_custkey, regexp_replace(CASE WHEN length(x) <= 3 THEN x ELSE reverse(regexp_replace(left(reverse(x), 3) || ',' || regexp_replace(substr(reverse(x), 4), '(..)', '\\1,', 'g'), ',$', '')) END, '^,', '') AS text FROM (SELECT c_custkey, CAST(c_custkey * 7919 AS VARCHAR) AS x FROM customer) AS y")
def digits(spark, sf_dir):
    return src.table(spark, sf_dir, "customer").select("c_custkey", indian_digits(F.col("c_custkey") * 7919).alias("text"))


@add("P19_curve_text", f"SELECT p_brand, array_to_string(list_transform(list_sort(list(DISTINCT p_size)), lambda x: CAST(x AS VARCHAR)), ' ') AS curve, max(p_size) AS top FROM part GROUP BY p_brand")
def curve_text(spark, sf_dir):
    text = src.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_set("p_size")), lambda x: x.cast("string")), " ").alias("curve"))
    return text.select("p_brand", "curve", F.array_max(F.transform(F.split("curve", " "), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))).alias("top"))


@add("J13_neighbour_mean", "WITH v AS (SELECT s_nationkey AS k, avg(s_acctbal) AS x FROM supplier GROUP BY 1), e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), g AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b) SELECT a AS district, round(avg(x), 6) AS lag FROM g LEFT JOIN v ON v.k = b GROUP BY a")
def neighbours(spark, sf_dir):
    value = src.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("b")).agg(F.avg("s_acctbal").alias("x"))
    one = src.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.pmod(F.col("n_nationkey") * 3 + 1, F.lit(25)).alias("b")).where("a <> b")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.join(value, "b", "left").groupBy(F.col("a").alias("district")).agg(F.round(F.avg("x"), 6).alias("lag"))


@add("Q1_cohort_speed", f"{TRUNCATED}, {CUT}, {ENTRY}, x AS (SELECT f // 12 AS year, f >= coalesce(entry, 0) AS complete, n, n * CASE WHEN d - f <= 12 THEN 1 ELSE 0 END AS d12 FROM cube JOIN cut USING (state, district) LEFT JOIN entry USING (district) WHERE f + 12 <= cut) SELECT CAST(year AS BIGINT) AS year, round(sum(d12) FILTER (complete) / nullif(sum(n) FILTER (complete), 0), 6) AS after_complete, round(sum(d12) FILTER (NOT complete) / nullif(sum(n) FILTER (NOT complete), 0), 6) AS before, CAST(sum(n) AS BIGINT) AS filed FROM x GROUP BY year")
def cohort_speed(spark, sf_dir):
    cube = src.truncated_cube(spark, sf_dir)
    rows = cube.join(records.collection_month(cube).select("district", "cut"), "district").join(records.completeness_month(cube), "district", "left").where("f + 12 <= cut")
    soon, done = F.when(F.col("d") - F.col("f") <= 12, F.col("n")).otherwise(0), F.col("f") >= F.coalesce("entry", F.lit(0))
    share = lambda c: F.round(F.try_divide(F.sum(F.when(c, soon)), F.sum(F.when(c, F.col("n")))), 6)
    return rows.groupBy(F.floor(F.col("f") / 12).alias("year")).agg(share(done).alias("after_complete"), share(~done).alias("before"), F.sum("n").alias("filed"))


@add("Q3_collection_ends", f"{BASE}, {CUT}, dm AS (SELECT district, d AS m, sum(n) AS n FROM cube WHERE d IS NOT NULL GROUP BY ALL), k AS (SELECT unnest(range(0, 4)) AS k) SELECT CAST(k AS INT) AS k, round(sum(coalesce(a.n, 0)) / nullif(sum(coalesce(b.n, 0)), 0), 6) AS ratio FROM k CROSS JOIN (SELECT * FROM cut WHERE cut IS NOT NULL) c LEFT JOIN dm a ON a.district = c.district AND a.m = c.cut - k LEFT JOIN dm b ON b.district = c.district AND b.m = c.cut - k - 12 GROUP BY k")
def ends(spark, sf_dir):
    cube = src.cube(spark, sf_dir)
    dm = cube.where("d is not null").groupBy("district", F.col("d").alias("m")).agg(F.sum("n").alias("n"))
    cut = records.collection_month(cube).where("cut is not null").select("district", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "cut")
    asked = cut.select("district", "k", F.explode(F.array(F.struct((F.col("cut") - F.col("k")).alias("m"), F.lit(True).alias("now")), F.struct((F.col("cut") - F.col("k") - 12).alias("m"), F.lit(False).alias("now")))).alias("x")).select("district", "k", "x.*")
    met = asked.join(dm, ["district", "m"], "left")
    return met.groupBy("k").agg(F.round(F.try_divide(F.sum(F.when(F.col("now"), F.coalesce("n", F.lit(0)))), F.sum(F.when(~F.col("now"), F.coalesce("n", F.lit(0))))), 6).alias("ratio"))


@add("Q4_sensitivity", " UNION ALL ".join(f"SELECT {frac} AS frac, CAST(count(cut) AS BIGINT) AS units, round(avg(cut), 6) AS mean_cut FROM ({BASE}, {CUT.replace('0.5 * level', f'{frac} * level')} SELECT cut FROM cut)" for frac in (0.35, 0.5, 0.65)))
def sensitivity(spark, sf_dir):
    cube, out = src.cube(spark, sf_dir), None
    for frac in (0.35, 0.5, 0.65):
        one = records.collection_month(cube, frac).agg(F.lit(frac).alias("frac"), F.count("cut").alias("units"), F.round(F.avg("cut"), 6).alias("mean_cut"))
        out = one if out is None else out.unionByName(one)
    return out


@add("M9_rank_correlation", f"{BASE}, x AS (SELECT district, sum(n) AS a, sum(CASE WHEN d IS NULL THEN n ELSE 0 END) / sum(n) AS b FROM cube GROUP BY district), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x) SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, sf_dir):
    from pyspark.sql import Window

    x = src.cube(spark, sf_dir).groupBy("district").agg(F.sum("n").alias("a"), (F.sum(F.when(F.col("d").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("b"))
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2  # noqa: E731  one row a district
    return x.select(rank("a").alias("ra"), rank("b").alias("rb")).agg(F.round(F.corr("ra", "rb"), 6).alias("rho"), F.count("*").alias("n"))


def _handover(spark: SparkSession, sf_dir: str, earlier: tuple[int, ...] = (0,)) -> DataFrame:
    posts = src.postings(spark, sf_dir)
    flow = src.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("court"), (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("m")).groupBy("court", "m").agg(F.count("*").alias("x"))
    flow = flow.join(posts.select("district", "court").distinct(), "court")
    return events.event_study(flow, _dates(posts, earlier), posts.select("district", "court", "s"), C.first, C.last, post=8)


def _dates(posts: DataFrame, earlier: tuple[int, ...]) -> DataFrame:
    """Handovers with the date moved by each of some numbers of months; `earlier` says by which."""
    held = events.handovers(posts)
    return reduce(DataFrame.unionByName, [events.moved(held, k).withColumn("earlier", F.lit(k)) for k in earlier])


HANDOVER = f"""WITH {POSTS}, flow AS (SELECT court, m, count(*) AS x FROM (SELECT l_suppkey AS court, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m FROM lineitem WHERE l_linestatus = 'F') AS l GROUP BY ALL),
ev AS (SELECT district, court, s AS t0 FROM (SELECT *, lag(e) OVER (PARTITION BY district, court ORDER BY s) AS pe FROM posts) AS q WHERE pe IS NOT NULL AND s - 12 >= {C.first} AND s + 8 <= {C.last}),
uc AS (SELECT DISTINCT p.district, p.court FROM posts p JOIN flow USING (court)),
pr AS (SELECT ev.*, uc.court AS other FROM ev JOIN uc ON uc.district = ev.district WHERE uc.court = ev.court OR NOT EXISTS (SELECT 1 FROM posts p WHERE p.district = uc.district AND p.court = uc.court AND abs(p.s - ev.t0) <= 8)),
pa AS (SELECT pr.*, k, coalesce(x, 0) AS x FROM (SELECT *, unnest(range(-12, 9)) AS k FROM pr) pr LEFT JOIN flow ON flow.court = pr.other AND flow.m = pr.t0 + pr.k),
bs AS (SELECT *, sum(x) FILTER (k < 0) OVER (PARTITION BY district, court, t0, other) / 12 AS base FROM pa),
pk AS (SELECT district, court, t0, k, max(x / base) FILTER (other = court) AS own, avg(x / base) FILTER (other <> court) AS ctrl FROM bs WHERE base >= 1 AND k >= -6 GROUP BY ALL)"""


@add("M12_event_study", HANDOVER + " SELECT CAST(k AS INT) AS k, count(*) AS events, round(avg(own - ctrl), 6) AS effect FROM pk WHERE own IS NOT NULL AND ctrl IS NOT NULL GROUP BY k")
def study(spark, sf_dir):
    return _handover(spark, sf_dir).groupBy("k").agg(F.count("*").alias("events"), F.round(F.avg("effect"), 6).alias("effect"))


PLACEBO = (0, 18, 30)  # months
TOTALS = "tot AS (SELECT district, court, t0, avg(e) FILTER (k >= 0 AND k < 8) AS after, avg(e) FILTER (k < 0) AS before, -sum(e * b) FILTER (k >= 0 AND k < 8) AS lost, max(b) AS b FROM (SELECT *, own - ctrl AS e FROM pk WHERE own IS NOT NULL AND ctrl IS NOT NULL) AS s GROUP BY ALL)"
BASED = HANDOVER.replace("AS ctrl FROM bs", "AS ctrl, max(base) FILTER (other = court) AS b FROM bs")


def _moved_sql(earlier: int) -> str:
    sql = HANDOVER.replace("s AS t0 FROM", f"s - {earlier} AS t0 FROM").replace("AND s - 12 >=", f"AND s - {earlier} - 12 >=").replace("AND s + 8 <=", f"AND s - {earlier} + 8 <=")
    return f"SELECT {earlier} AS earlier, * FROM ({sql} SELECT count(DISTINCT (district, court, t0)) AS events, round(avg(own - ctrl) FILTER (k >= 0 AND k < 8), 6) AS effect FROM pk WHERE own IS NOT NULL AND ctrl IS NOT NULL)"


@add("M12_placebo", " UNION ALL ".join(_moved_sql(k) for k in PLACEBO))
def placebo(spark, sf_dir):
    """The mean effect after handovers and after the same dates some months earlier."""
    totals = events.event_totals(_handover(spark, sf_dir, PLACEBO), 8).join(_dates(src.postings(spark, sf_dir), PLACEBO), ["district", "court", "t0"])
    means = totals.groupBy("earlier").agg(F.count("*").alias("events"), F.round(F.avg("after"), 6).alias("effect"))
    asked = spark.range(1).select(F.explode(F.lit(list(PLACEBO))).alias("earlier"))
    return asked.join(means, "earlier", "left").fillna(0, ["events"])


@add("M12_by_vacancy", f"{BASED}, {TOTALS}, va AS (SELECT district, court, s AS t0, least(greatest(s - pe, 0), 2) < 2 AS short FROM (SELECT *, lag(e) OVER (PARTITION BY district, court ORDER BY s) AS pe FROM posts) AS q WHERE pe IS NOT NULL) SELECT CASE WHEN short THEN '0-1' ELSE '2+' END AS vacancy, count(*) AS events, round(avg(after), 6) AS effect, round(avg(before), 6) AS pre_trend, round(avg(lost), 6) AS lost, round(avg(lost) / (12 * avg(b)), 6) AS lost_share FROM tot JOIN va USING (district, court, t0) GROUP BY ALL")
def by_vacancy(spark, sf_dir):
    totals = events.event_totals(_handover(spark, sf_dir), 8).join(events.handovers(src.postings(spark, sf_dir)), ["district", "court", "t0"])
    r = lambda c: F.round(c, 6)
    out = totals.groupBy(F.when(F.col("vacancy") <= 1, "0-1").otherwise("2+").alias("vacancy"))
    return out.agg(F.count("*").alias("events"), r(F.avg("after")).alias("effect"), r(F.avg("before")).alias("pre_trend"), r(F.avg("lost")).alias("lost"), r(F.avg("lost") / (12 * F.avg("base_mean"))).alias("lost_share"))


@add("J11_control_courts", f"WITH {POSTS}, ev AS (SELECT district, court, s AS t0 FROM (SELECT *, lag(e) OVER (PARTITION BY district, court ORDER BY s) AS pe FROM posts) AS q WHERE pe IS NOT NULL), uc AS (SELECT DISTINCT district, court FROM posts) SELECT ev.district, ev.court, t0, uc.court AS other FROM ev JOIN uc ON uc.district = ev.district AND uc.court <> ev.court WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.district = uc.district AND p.court = uc.court AND abs(p.s - t0) <= 12)")
def controls(spark, sf_dir):
    posts = src.postings(spark, sf_dir)
    near = posts.select("district", F.col("court").alias("other"), F.explode(F.sequence(F.col("s") - 12, F.col("s") + 12)).alias("t0")).distinct()
    others = posts.select("district", F.col("court").alias("other")).distinct()
    return events.handovers(posts).select("district", "court", "t0").join(others, "district").where("court <> other").join(near, ["district", "other", "t0"], "left_anti").select("district", "court", "t0", "other")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
