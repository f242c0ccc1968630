"""What a run leaves for readers: a report of the run, rounded tables, one nested document for each district."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions.calendar import to_ym
from ledgertide.functions.text import slug


def run_report(cases: DataFrame) -> DataFrame:
    """One row: report, a JSON document of rows, rows without a filing month, impossible rows, filing years, the last
    decision (YYYYMM), districts and cube cells, from cases (district, f, d, case_type).

    Everything comes from the count cube, so cases are read once.
    """
    cells = cases.groupBy("district", "f", "d", "case_type").agg(F.count("*").alias("n"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    good = F.col("f").isNotNull() & (F.col("d").isNull() | (F.col("d") >= F.col("f")))
    years = cells.where(good).groupBy(F.floor(F.col("f") / 12).cast("string").alias("year")).agg(F.sum("n").alias("n"))
    years = years.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "n")))).alias("filing_years"))
    totals = cells.agg(
        n(F.lit(True)).alias("rows"), n(F.col("f").isNull()).alias("no_filing"), n(F.col("d") < F.col("f")).alias("impossible"),
        to_ym(F.max(F.when(good, F.col("d")))).alias("last_decision"), F.countDistinct(F.when(good, F.col("district"))).alias("districts"), F.count(F.when(good, 1)).alias("cells"),
    )
    return totals.join(years).select(F.to_json(F.struct("rows", "no_filing", "impossible", "last_decision", "districts", "cells", "filing_years")).alias("report"))  # one row each


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Fractions at so many places, halves to even."""
    return df.select(*[F.bround(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_table(df: DataFrame, path: str, order: list[str], places: int = 4, gzip: bool = True) -> None:
    """A report's table as one CSV file with a header, rounded and sorted.

    Equal tables give equal bytes: gzip members carry no time. For tables of report size; one task writes the file.
    """
    out = rounded(df, places).coalesce(1).sortWithinPartitions(*order)
    out.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def documents(table: DataFrame, keys: tuple[str, ...], kind: str, values: dict[str, Column]) -> DataFrame:
    """(path, body): one JSON document for each combination of keys, the values of its kinds nested under kinds in order.

    path is made of the keys' slugs. A null kind is left out; nulls among the values stay, as null.
    """
    inner = F.struct(F.col(kind).cast("string").alias("kind"), F.struct(*[v.alias(k) for k, v in values.items()]).alias("v"))
    rows = table.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(kind).isNotNull(), inner)))).alias("kinds"))
    path = F.concat(F.concat_ws("/", *[slug(F.col(k).cast("string")) for k in keys]), F.lit(".json"))
    return rows.select(path.alias("path"), F.to_json(F.struct(*keys, "kinds"), {"ignoreNullFields": "false"}).alias("body"))


def index(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row: the paths of documents in order, as a JSON list."""
    return docs.agg(F.to_json(F.array_sort(F.collect_list("path"))).alias(body))


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as text, a folder for each path; tasks take about equal numbers of them."""
    docs.repartition("path").select("body", "path").write.mode("overwrite").partitionBy("path").text(path)
