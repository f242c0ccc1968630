"""The corpus pipeline: five stages over `documents`, each applying one operator of ledgertide.llm.

Each stage takes (spark, docs, sf_dir), docs being all that its predecessor kept, and all but the last return the
columns of documents. The last returns one row for each document with the copies that the mix takes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.common import table, written
from ledgertide.llm.decontaminate import without_contaminated
from ledgertide.llm.jaccard_join import jaccard_components
from ledgertide.llm.mixture import mixture
from ledgertide.llm.secret_scan import redacted
from ledgertide.llm.toxicity import fit_toxicity, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go; the model is fitted on the labels of what is there."""
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join, one row stays: that with the smallest id, null last.

    Rows are numbered and written, so rows that repeat an id, or have none, are told apart. Rows without words stay.
    """
    rows = written(docs.withColumn("row_number", F.monotonically_increasing_id()), "rows")
    found = jaccard_components(rows, row_col="row_number")
    return rows.join(found.where("not stays").select("row_number"), "row_number", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked in the text; every document stays. n_chars stays that of the original."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken."""
    return mixture(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: Learned scores and edit distances have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
