"""Reading and writing case files: discovery, projection, partitioned Parquet, audits, reports, locks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.sources.archives import workbook


def kind_of(columns: list[str], kinds: dict[str, set[str]]) -> str | None:
    """The first kind whose required columns are all there; headers are stripped and lower-cased."""
    have = {c.strip().lower() for c in columns}
    return next((k for k, need in kinds.items() if need <= have), None)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV (gzip too), Parquet, ORC, JSON lines or a workbook by file name, with headers stripped and lower-cased; CSV and
    workbooks as strings."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(".xlsx"):
        df = workbook(spark, path)
    elif name.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
    elif name.endswith((".json", ".jsonl")):
        df = spark.read.json(path)
    elif name.endswith(".orc"):
        df = spark.read.orc(path)
    else:
        df = spark.read.parquet(path)
    return df.toDF(*[c.strip().lower() for c in df.columns])


def require(df: DataFrame, required: dict[str, str], optional: dict[str, str]) -> DataFrame:
    """Columns cast to the named types; a missing required one is an error, a missing optional one is null."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    both = required | optional
    return df.select(*[(F.expr(f"try_cast(`{c}` as {t})") if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in both.items()])


def write_by_state(df: DataFrame, path: str, state: str = "state", order: tuple[str, ...] = ("district", "f"), rows_per_file: int = 2_000_000) -> None:
    """Hive-partitioned Parquet, zstd, sorted within files of a bounded number of rows; a large state takes many tasks."""
    spread = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(16)))
    spread.repartition(state, "_part").drop("_part").sortWithinPartitions(state, *order).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy(state).parquet(path)


def label_audit(df: DataFrame, label: str, kind: str) -> DataFrame:
    """(label, class, n) by descending count."""
    return df.groupBy(F.col(label).alias("label"), F.col(kind).alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def content_lock(df: DataFrame, columns: list[str]) -> str:
    """SHA-256 over the sorted hashes of all rows, in order-free form: equal for equal multisets of rows."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    sums = df.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("a"), F.conv(F.substring(row, 16, 15), 16, 10).cast("decimal(38,0)").alias("b")).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return hashlib.sha256(f"{sums.n}:{sums.a}:{sums.b}".encode()).hexdigest()
