"""Audits of survival curves, inverse-coverage weights, transposed sums, curve encoding, and Parquet by state."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.functions.text import drops
from ledgertide.operators import panel, records, survival
from ledgertide.plans.core import BASE, CUT, FULL, GRID, TRUNCATED, km_sql, r6
from ledgertide.sources import lifecycle as src
from ledgertide.sources.files import write_by_state


def _shared(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a folder of our own only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        own = tempfile.mkdtemp(prefix="ledgertide-")
        atexit.register(shutil.rmtree, own, True)
        named = f"file://{own}"
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def naive_and_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(district, naive, corrected, shift, rank_shift): medians of months without and with delayed entry, where both
    exist, and how far the district moves among the others by its share pending after three years."""
    cube = src.truncated_cube(spark, sf_dir)
    table = lambda entries, m, p: survival.time_to_decision(cube, ["district"], entries).select("district", F.col("median_months").alias(m), F.round("pending_3y", 6).alias(p))
    both = table(None, "naive", "p0").join(table(records.completeness_month(cube), "corrected", "p1"), "district").where("p0 is not null and p1 is not null")
    place = lambda p: F.rank().over(Window.orderBy(p))  # noqa: E731  one row a district
    return both.select("district", "naive", "corrected", (F.col("corrected") - F.col("naive")).alias("shift"), (place("p1") - place("p0")).alias("rank_shift"))


NAIVE_CORRECTED = f"""SELECT a.district, a.median_months AS naive, b.median_months AS corrected, b.median_months - a.median_months AS shift, rank() OVER (ORDER BY b.pending_3y) - rank() OVER (ORDER BY a.pending_3y) AS rank_shift
FROM ({km_sql("district", False).replace(BASE, TRUNCATED, 1)}) a JOIN ({km_sql("district", True)}) b ON a.district = b.district WHERE a.pending_3y IS NOT NULL AND b.pending_3y IS NOT NULL"""


def impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, cases, late, before_filing, no_end): decisions after the district's end, before filing, and cases of districts without an end."""
    rows = src.raw_cases(spark, sf_dir).where("f is not null").groupBy("state", "district", "f", "d").agg(F.count("*").alias("n"))
    met = rows.join(records.collection_month(src.cube(spark, sf_dir)).select("district", "cut"), "district", "left")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return met.groupBy("state").agg(F.sum("n").alias("cases"), n(F.col("d") > F.col("cut")).alias("late"), n(F.col("d") < F.col("f")).alias("before_filing"), n(F.col("cut").isNull()).alias("no_end"))


IMPOSSIBLE = f"{BASE}, {CUT}, x AS (SELECT cases.state, d, f, cut FROM cases LEFT JOIN cut ON cases.district = cut.district WHERE f IS NOT NULL) SELECT state, count(*) AS cases, count(*) FILTER (d > cut) AS late, count(*) FILTER (d < f) AS before_filing, count(*) FILTER (cut IS NULL) AS no_end FROM x GROUP BY state"


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survival by case type when each district's cases stand for 1, 1.5 or 2: counts need not be whole."""
    cube = src.cube(spark, sf_dir).withColumn("n", F.col("n") * (1 + F.pmod("district", F.lit(3)) * 0.5))
    out = survival.time_to_decision(cube, ["case_type"]).drop("curve")
    return r6(out, "cases", "pending_1y", "pending_3y", "pending_5y", "pending_3y_lo", "pending_3y_hi")


WEIGHTED = km_sql("case_type", False).replace("count(*) AS n FROM valid", "count(*) * (1 + district % 3 * 0.5) AS n FROM valid", 1).replace("CAST(max(cases) AS BIGINT)", "round(max(cases), 6)", 1)


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.stock_flow(src.cube(spark, sf_dir)).groupBy("district").agg(*[F.sum(c).alias(c) for c in ("instituted", "disposed", "pending")])


def by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns summed by the family that they belong to."""
    long = _totals(spark, sf_dir).unpivot("district", ["instituted", "disposed", "pending"], "name", "value")
    return long.groupBy("district", F.when(F.col("name") == "pending", "stock").otherwise("flow").alias("family")).agg(F.sum("value").alias("value"))


def largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the two largest columns of each row; of equal ones, the first by name."""
    ranked = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(c).alias("name")) for c in ("instituted", "disposed", "pending")]))
    return _totals(spark, sf_dir).select("district", F.array_join(F.transform(F.slice(ranked, 1, 2), lambda x: x["name"]), " > ").alias("top"))


LONG = f"""{BASE}, {GRID}, {FULL}, tt AS (SELECT district, sum(instituted) AS instituted, sum(disposed) AS disposed, sum(pending) AS pending FROM stock GROUP BY district),
long AS (SELECT district, 'instituted' AS name, instituted AS value FROM tt UNION ALL SELECT district, 'disposed', disposed FROM tt UNION ALL SELECT district, 'pending', pending FROM tt)"""
FAMILY = f"{LONG} SELECT district, CASE WHEN name = 'pending' THEN 'stock' ELSE 'flow' END AS family, CAST(sum(value) AS BIGINT) AS value FROM long GROUP BY ALL"
LARGEST = f"{LONG}, rk AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY value DESC, name) AS k FROM long) SELECT district, string_agg(name, ' > ' ORDER BY k) AS top FROM rk WHERE k <= 2 GROUP BY district"

STEPS = (10, 20, 30, 40, 50)


def curve_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a brand's parts above each size, as drops per mille."""
    above = [F.avg((F.col("p_size") > k).cast("double")) for k in STEPS]
    shares = src.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array(*[F.when(a > 0, a) for a in above]).alias("curve"))
    return shares.select("p_brand", F.array_join(drops(F.col("curve")), " ").alias("drops"))


CURVE_DROPS = f"""WITH s AS (SELECT p_brand, k, round(1000 * avg(CASE WHEN p_size > k THEN 1.0 ELSE 0.0 END)) AS v FROM part CROSS JOIN (VALUES {", ".join(f"({k})" for k in STEPS)}) t(k) GROUP BY ALL),
seen AS (SELECT s.*, (SELECT count(*) FILTER (p_size > s.k) FROM part p WHERE p.p_brand = s.p_brand) AS more FROM s),
dd AS (SELECT *, CAST(coalesce(lag(v) OVER (PARTITION BY p_brand ORDER BY k), 1000) - v AS BIGINT) AS drop_by FROM seen)
SELECT p_brand, coalesce(string_agg(CAST(drop_by AS VARCHAR), ' ' ORDER BY k) FILTER (more > 0), '') AS drops FROM dd GROUP BY p_brand"""


def by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube written as Parquet by state, and one state read back: the others' folders are not opened."""
    path = _shared(spark, "cube")
    write_by_state(src.cube(spark, sf_dir), path)
    return spark.read.parquet(path).where("state = 1").groupBy("state", "district").agg(F.sum("n").alias("n"), F.min("f").alias("first"), F.max("d").alias("last"))


BY_STATE = f"{BASE} SELECT state, district, CAST(sum(n) AS BIGINT) AS n, min(f) AS first, max(d) AS last FROM cube WHERE state = 1 GROUP BY ALL"


def queries() -> dict:
    return {
        "Q5_naive_and_corrected": naive_and_corrected, "Q5_impossible_decisions": impossible, "Q10_inverse_coverage": weighted, "A14_sums_by_family": by_family, "O3_largest_columns": largest,
        "S25_curve_drops": curve_drops, "S6_S7_S20_parquet_by_state": by_state,
    }


def oracle_sql() -> dict[str, str]:
    return {"Q5_naive_and_corrected": NAIVE_CORRECTED, "Q5_impossible_decisions": IMPOSSIBLE, "Q10_inverse_coverage": WEIGHTED, "A14_sums_by_family": FAMILY, "O3_largest_columns": LARGEST, "S25_curve_drops": CURVE_DROPS, "S6_S7_S20_parquet_by_state": BY_STATE}
