"""Matching names within blocks: exact, then the closest above a ratio, then given overrides."""

from __future__ import annotations

from difflib import SequenceMatcher
from heapq import nlargest

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closest(word: str, known: list[str], most: int = 3, least: float = 0.6) -> list[tuple[float, str]]:
    """(ratio, name) of the names nearest to a word with a ratio of at least `least`, best first; of equal ones, the later by name.

    Ratios are bounded from above by lengths and letter counts first, which is exact and spares most comparisons.
    """
    matcher, found = SequenceMatcher(b=word), []
    for other in known:
        matcher.set_seq1(other)
        if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and (ratio := matcher.ratio()) >= least:
            found.append((ratio, other))
    return nlargest(most, found)


def fuzzy_match(left: DataFrame, right: DataFrame, block: str, name: str, cutoff: float = 0.88) -> DataFrame:
    """(block, name, match, how, ratio, candidates) for every left name; both sides hold distinct names of a block, such as a state.

    how is exact, fuzzy (the nearest name has a ratio of the cutoff or more) or none; ratio is the nearest name's, null
    where none reaches 0.6. candidates: up to three names of 0.6 or more, best first, joined by "; ". Null names
    go. A block is a state's list of names, compared in one task.
    """

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        known, rows = sorted(b[name].dropna()), []
        there = set(known)
        for n in a[name].dropna():
            near = closest(n, known)
            best = near[0][1] if near else None
            ratio = 1.0 if n in there else SequenceMatcher(None, n, best).ratio() if near else None
            how = "exact" if n in there else "fuzzy" if near and ratio >= cutoff else "none"
            rows.append((a[block].iloc[0], n, {"exact": n, "fuzzy": best, "none": None}[how], how, ratio, "; ".join(k for _, k in near)))
        return pd.DataFrame(rows, columns=[block, name, "match", "how", "ratio", "candidates"])

    kind = left.schema[block].dataType.simpleString()
    pick = lambda df: df.select(block, name).distinct().groupBy(block)
    return pick(left).cogroup(pick(right)).applyInPandas(solve, f"{block} {kind}, {name} string, match string, how string, ratio double, candidates string")


def with_overrides(matches: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Matches with those of `overrides` (keys, match) in their place."""
    given = overrides.select(*keys, F.col("match").alias("given"))
    joined = matches.join(given, keys, "left")
    return joined.withColumn("how", F.when(F.col("given").isNotNull(), "override").otherwise(F.col("how"))).withColumn("match", F.coalesce("given", "match")).drop("given")
