"""Names, slugs and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_name(name: Column, stop_words: tuple[str, ...] = ("district", "the", "of")) -> Column:
    """Lower case, & as and, letters only, without stop words, single spaces."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(name), "&", " and "), "[^a-z]+", " ")
    kept = F.regexp_replace(letters, rf"\b(?:{'|'.join(stop_words)})\b", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def slug(name: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(cut == "", "x").otherwise(cut)


def indian_digits(n: Column) -> Column:
    """12345678 -> 1,23,45,678."""
    digits = n.cast("string")
    head = F.regexp_replace(F.regexp_replace(digits, r"\d{3}$", ""), r"(?<=\d)(?=(?:\d\d)+$)", ",")
    return F.when(F.length(digits) <= 3, digits).otherwise(F.concat(head, F.lit(","), F.regexp_extract(digits, r"\d{3}$", 0)))


def drops(curve: Column) -> Column:
    """A falling curve of shares as drops per mille from one point to the next, the first from 1; nulls at the end go.

    A null between two points stays null, and the next drop counts from the last point known.
    """
    mille = F.transform(curve, lambda s: F.round(s * 1000).cast("long"))
    known = F.array_max(F.transform(mille, lambda v, k: F.when(v.isNotNull(), k + 1).otherwise(0)))
    kept = F.slice(mille, 1, F.coalesce(known, F.lit(0)))
    before = lambda k: F.coalesce(F.try_element_at(F.filter(F.slice(kept, 1, k), lambda v: v.isNotNull()), F.lit(-1)), F.lit(1000))
    return F.transform(kept, lambda v, k: before(k) - v)
