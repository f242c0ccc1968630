"""Ordered rules: the first pattern found in the lower-cased label names its class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]


def classify(label: Column, rules: Rules, default: str) -> Column:
    text = F.lower(F.coalesce(label, F.lit("")))
    out = F
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def classify_labels(rows: DataFrame, column: str, rules: Rules, default: str, into: str) -> DataFrame:
    """Patterns run once for each distinct label; rows get the class by a join that may broadcast if labels are few."""
    labels = rows.select(F.col(column).alias("_label")).distinct().withColumn(into, classify(F.col("_label"), rules, default))
    return rows.join(labels, F.col(column).eqNullSafe(F.col("_label")), "left").drop("_label")
