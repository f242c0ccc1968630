"""Case records over the star schema: an order line is a case, filed on the order's date, decided when it was shipped.

district = region * 1000 + nation, court = supplier, case type = part type. Lines of status F are decided.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.functions.calendar import CALENDAR, month_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, district, nation, f, d, case_type, court): one row for each line. Dimensions join by size-checked plans."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("n_regionkey").alias("state"),
        (F.col("n_regionkey") * 1000 + F.col("n_nationkey")).alias("district"),
        F.col("n_nationkey").alias("nation"),
        month_of(F.col("o_orderdate")).alias("f"),
        F.when(F.col("l_linestatus") == "F", month_of(F.col("l_shipdate"))).alias("d"),
        F.col("p_type").alias("case_type"),
        F.col("l_suppkey").alias("court"),
    )


def valid_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed, and not decided in a month before the filing month."""
    return raw_cases(spark, sf_dir).where("f is not null and (d is null or d >= f)")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, district, f, d, case_type) -> n: the additive count cube that the other operators read.

    Kept by the session, so that queries share one pass over the facts; a lost part is made again from them.
    """
    return valid_cases(spark, sf_dir).groupBy("state", "district", "f", "d", "case_type").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)


def truncated_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube as if the records of a district began 0, 6, 12, 18 or 24 months late: cases decided before are missing."""
    begun = F.lit(CALENDAR.first) + 6 * F.pmod(F.col("nation"), F.lit(5))
    rows = valid_cases(spark, sf_dir).where(F.col("d").isNull() | (F.col("d") >= begun))
    return rows.groupBy("state", "district", "f", "d", "case_type").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)


def hearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(district, stage, at, gap): a listing and the minutes to the next one of the same user; stage is the event's type."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("MICROSECOND", F.col("ts"), F.lead("ts").over(own)) / 6e7
    return table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(25)).alias("district"), F.col("event_type").alias("stage"), F.col("ts").alias("at"), gap.alias("gap"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(district, court, s, e): judges' postings of 16 months with gaps of 2, shifted by court."""
    places = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("district"), F.col("s_suppkey").alias("court"))
    nth = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("nth")
    start = F.lit(CALENDAR.first) + F.pmod("court", F.lit(18)) + 18 * F.col("nth")
    return places.select("district", "court", nth).select("district", "court", start.cast("int").alias("s"), (start + 15).cast("int").alias("e"))
