"""Postings, edge lists, run reports, rounded tables and district documents, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.functions.calendar import CALENDAR as C
from ledgertide.operators import panel
from ledgertide.plans.audit import _shared
from ledgertide.plans.core import BASE, FULL, GRID
from ledgertide.sources import intake, reports
from ledgertide.sources import lifecycle as src

POSITIONS = ("District and Sessions Judge", "Civil Judge Senior Division", "Munsif", "Registrar")


def _raw_postings(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """Postings as a file has them: dates as text, every tenth court's first start unreadable, the last posting open."""
    day = lambda m: F.date_format(F.make_date(F.floor(F.col(m) / 12).cast("int"), F.pmod(m, F.lit(12)).cast("int") + 1, F.lit(5)), form)
    position = F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), (F.pmod("court", F.lit(4)) + 1).cast("int"))
    nth = F.floor((F.col("s") - C.first) / 18)
    start = F.when((F.pmod("court", F.lit(10)) == 0) & (nth == 0), "unknown").otherwise(day("s"))
    return src.postings(spark, sf_dir).select(
        F.lit(1).alias("state_code"), F.col("district").alias("dist_code"), "court", position.alias("judge_position"), start.alias("start_date"), F.when(nth < 4, day("e")).alias("end_date")
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of three files: day-month-year; ISO, by the fallback; and only those closed since 1996."""
    files = (("usual", "dd-MM-yyyy", intake.DAY_FIRST, None), ("iso", "yyyy-MM-dd", intake.ISO, None), ("closed", "dd/MM/yyyy", intake.DAY_FIRST, C.first + 12))
    out = None
    for name, form, fallback, since in files:
        one = intake.load_postings(_raw_postings(spark, sf_dir, form), fallback, closed_from=since).select(F.lit(name).alias("file"), "district_id", "court", "cadre", "s", "e")
        out = one if out is None else out.unionAll(one)
    return out


POSTINGS = f"""WITH p AS (SELECT 1000 + s_nationkey AS district_id, s_suppkey AS court, k, {C.first} + s_suppkey % 18 + 18 * k AS s FROM supplier CROSS JOIN range(5) t(k)),
q AS (SELECT district_id, court, ['district', 'senior', 'junior', 'other'][court % 4 + 1] AS cadre, s, CASE WHEN k < 4 THEN s + 15 END AS e FROM p WHERE NOT (court % 10 = 0 AND k = 0))
SELECT file, district_id, court, cadre, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM q CROSS JOIN (VALUES ('usual'), ('iso'), ('closed')) f(file) WHERE file <> 'closed' OR (e IS NOT NULL AND s >= {C.first + 12})"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row weights of neighbours: a nation borders the one as many keys on as its region's key, and the next."""
    nation = src.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k"))
    to = nation.select(F.col("r").alias("dst_state"), F.col("k").alias("dst_dist"))
    pairs = nation.join(to, F.col("dst_dist") == F.col("k") + F.col("r") + 1).select(F.col("r").alias("src_state"), F.col("k").alias("src_dist"), "dst_state", "dst_dist")
    out = intake.edge_weights(pairs.unionAll(pairs), nation.select((F.col("r") * 1000 + F.col("k")).alias("district")))
    return out.withColumn("weight", F.round("weight", 6))


EDGES = """WITH e AS (SELECT a.n_regionkey * 1000 + a.n_nationkey AS x, b.n_regionkey * 1000 + b.n_nationkey AS y FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + a.n_regionkey + 1),
u AS (SELECT x AS district, y AS neighbour FROM e UNION SELECT y, x FROM e)
SELECT CAST(district AS BIGINT) AS district, CAST(neighbour AS BIGINT) AS neighbour, round(1.0 / (SELECT count(*) FROM u v WHERE v.district = u.district), 6) AS weight FROM u"""


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_report(src.raw_cases(spark, sf_dir))


REPORT = f"""{BASE}, good AS (SELECT * FROM cases WHERE f IS NOT NULL AND (d IS NULL OR d >= f)),
years AS (SELECT CAST(f // 12 AS VARCHAR) AS year, count(*) AS n FROM good GROUP BY ALL),
cells AS (SELECT DISTINCT district, f, d, case_type FROM good)
SELECT '{{"rows":' || (SELECT count(*) FROM cases) || ',"no_filing":' || (SELECT count(*) FROM cases WHERE f IS NULL) || ',"impossible":' || (SELECT count(*) FROM cases WHERE d < f)
|| ',"last_decision":' || (SELECT max(d) // 12 * 100 + max(d) % 12 + 1 FROM good) || ',"districts":' || (SELECT count(DISTINCT district) FROM good) || ',"cells":' || (SELECT count(*) FROM cells)
|| ',"filing_years":{{' || (SELECT string_agg('"' || year || '":' || n, ',' ORDER BY year) FROM years) || '}}}}' AS report"""


def rounded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks and their share, written as a rounded gzip table and read back as it stands."""
    rows = panel.stock_flow(src.cube(spark, sf_dir)).groupBy("district").agg(F.sum("instituted").alias("instituted"), (F.sum("disposed") / F.sum("instituted")).alias("clearance"))
    path = _shared(spark, "table")
    reports.write_table(rows, path, ["district"])
    return spark.read.option("header", True).schema("district long, instituted long, clearance double").csv(path)


ROUNDED = f"{BASE}, {GRID}, {FULL} SELECT CAST(district AS BIGINT) AS district, CAST(sum(instituted) AS BIGINT) AS instituted, round_even(sum(disposed) / sum(instituted), 4) AS clearance FROM stock GROUP BY district"


def district_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document for each district and the index of all."""
    cells = src.cube(spark, sf_dir).groupBy("state", "district", "case_type").agg(F.sum("n").alias("cases"), F.sum(F.when(F.col("d").isNull(), F.col("n"))).alias("open"))
    docs = reports.documents(cells, ("state", "district"), "case_type", {"cases": F.col("cases"), "open": F.col("open")})
    return docs.unionAll(reports.index(docs).select(F.lit("index.json").alias("path"), "body"))


DOCUMENTS = f"""{BASE}, k AS (SELECT state, district, case_type, sum(n) AS cases, sum(CASE WHEN d IS NULL THEN n END) AS open FROM cube GROUP BY ALL),
docs AS (SELECT state || '/' || district || '.json' AS path, '{{"state":' || state || ',"district":' || district || ',"kinds":{{' ||
  string_agg('"' || case_type || '":{{"cases":' || CAST(cases AS BIGINT) || ',"open":' || coalesce(CAST(CAST(open AS BIGINT) AS VARCHAR), 'null') || '}}', ',' ORDER BY case_type) || '}}}}' AS body FROM k GROUP BY state, district)
SELECT * FROM docs UNION ALL SELECT 'index.json', '[' || string_agg('"' || path || '"', ',' ORDER BY path) || ']' FROM docs"""


def queries() -> dict:
    return {"S14_postings": postings, "S13_edge_weights": edges, "S22_run_report": report, "S23_rounded_table": rounded_table, "S24_district_documents": district_documents}


def oracle_sql() -> dict[str, str]:
    return {"S14_postings": POSTINGS, "S13_edge_weights": EDGES, "S22_run_report": REPORT, "S23_rounded_table": ROUNDED, "S24_district_documents": DOCUMENTS}
