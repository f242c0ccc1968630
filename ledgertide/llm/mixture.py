"""Mixing sources to target weights: subset-sum budget fitting over exact length counts.

1. Documents are counted by source, exact size and seeded slot (256 slots by hash of the id); texts are not moved.
2. Shares follow from the source totals alone: weights 1, 2, 3, repeating, limits of 3 times a source's size, what is
   over the limit shared out again by weight.
3. A source repeats all its documents floor(target / size) times. For the rest of its budget, nearly the same
   fraction of every length is taken, then lengths from the longest down, one document each, until less than four of
   the longest is left (4096 words at least). A bounded knapsack over all lengths that have documents left fits that as
   nearly as any choice can, from either side.
4. Documents are chosen by length count in the order of their seeded hash: whole slots first, then the first ones of
   the slot in which the count ends. So no task ever orders more than a slot of one length of one source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.llm.common import WORD_PATTERN, written

SLOTS, LIMIT, ROOM = 256, 3, 4096
FEW, FEW_WORDS = 64, 1 << 27  # parts and words of a knapsack over all documents (16 MB of bits, nine of these kept)
WEIGHTS = (1, 2, 3)


def knapsack(sizes: list[int], counts: list[int], target: int) -> list[int]:
    """How many of each size to take, so that the sum comes nearest to target, from below if two are as near.

    Bounded subset sum: sizes are divided by what divides them all, counts split into powers of two, and reachable sums
    are the bits of one integer, as far as one largest size beyond the target. The choice is read back from the sums
    reachable before each part; of these only every so many are kept and those between are made again.
    """
    taken = [0] * len(sizes)
    unit = math.gcd(*[size for size, count in zip(sizes, counts, strict=True) if count]) if sizes else 0
    if target <= 0 or not unit:
        return taken
    goal, rest = divmod(target, unit)
    most = goal + max(sizes) // unit
    parts: list[tuple[int, int]] = []
    for k, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        left, part = min(count, most * unit // size if size else 0), 1
        while left > 0:
            part = min(part, left)
            parts.append((k, part))
            left -= part
            part *= 2
    step = math.isqrt(len(parts)) + 1
    mask, reach, kept, used = (1 << most + 1) - 1, 1, [], 0
    add = lambda bits, k, part: bits | bits << part * (sizes[k] // unit) & mask
    for used, (k, part) in enumerate(parts, 1):
        if (used - 1) % step == 0:
            kept.append(reach)
        reach = add(reach, k, part)
        if not rest and reach >> goal & 1:
            break
    below = (reach & (1 << goal + 1) - 1).bit_length() - 1
    above = reach >> goal + 1
    above = goal + (above & -above).bit_length() if above else None
    at = below if above is None or target - below * unit <= above * unit - target else above
    for block in range((used - 1) // step, -1, -1):
        before = [kept[block]]
        own = parts[block * step : min((block + 1) * step, used)]
        for k, part in own[:-1]:
            before.append(add(before[-1], k, part))
        for (k, part), bits in zip(reversed(own), reversed(before), strict=True):
            if not bits >> at & 1:
                at -= part * (sizes[k] // unit)
                taken[k] += part
    return taken


def fit_counts(sizes: np.ndarray, counts: np.ndarray, target: float, limit: int = LIMIT, room: int = ROOM) -> tuple[int, np.ndarray]:
    """(whole repeats of every document, further documents of each size) whose words come near target, from either side.

    The same fraction of each length goes first, then the longest, until less than four of the largest size is left
    (`room` words at least), which a knapsack over all that remains fits. With few documents it fits the whole target,
    so that the sum is the nearest of all.
    """
    total = int((sizes * counts).sum())
    if total == 0:
        return 1, np.zeros(len(sizes), np.int64)
    whole = min(limit, int(target // total))
    rest = int(round(target)) - whole * total
    extra = np.zeros(len(sizes), np.int64)
    if whole == limit or rest <= 0:
        return whole, extra
    full = sizes > 0
    few = sum(int(c).bit_length() for c in counts[full]) <= FEW and rest <= FEW_WORDS
    span = rest + 1 if few else max(room, 4 * int(sizes.max()))
    extra[full] = np.maximum(np.floor(counts[full] * (rest / total)).astype(np.int64) - 2, 0) if not few else 0
    left = rest - int((extra * sizes).sum())
    for most in (1, 1, 1, total):  # one document of each length at a time, then as many as are needed
        for k in np.argsort(-sizes, kind="stable").tolist():
            if sizes[k] and left - sizes[k] >= span and extra[k] < counts[k]:
                take = int(min(counts[k] - extra[k], (left - span) // sizes[k], most))
                extra[k] += take
                left -= take * int(sizes[k])
    usable = np.flatnonzero(full & (extra < counts))
    picked = knapsack(sizes[usable].tolist(), (counts - extra)[usable].tolist(), left)
    extra[usable] += np.array(picked, np.int64)
    return whole, extra


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size) -> with weight and target. One row a source, in code point order, null last.

    The share of a source that stays below its limit is weight * level. Sources reach their limit in the order of
    size / weight, so the level follows from running sums in that order: it is the highest of the levels, each with all
    sources before one at their limits, that this one can stand.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(limit))).withColumn("ratio", F.col("most") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, after, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    water = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)
    return levels.withColumn("water", water).select("source", "source_size", "weight", F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("water"), F.col("most"))).alias("target"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken): one row for each row of docs.

    size is the number of words of the text (null: 0). taken = copies * size words; copies is 0 to 3. Null sources
    are one source, the last. Rows without words are copied once for each whole repeat, at least once if their
    source has no words at all. Equal ids in one source and size are taken in an order that reruns may swap between
    them, which does not change the rows of the result. Very long texts are counted whole and are not moved. An empty table
    gives no rows. Columns other than the three are not read, whatever their names.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD_PATTERN)).cast("long").alias("size"))
    sized = sized.withColumn("rank", F.xxhash64(F.lit(seed), "doc_id")).withColumn("slot", F.pmod("rank", F.lit(slots)).cast("int"))
    sized = written(sized, "sizes")
    counted = written(sized.groupBy("source", "size", "slot").agg(F.count("*").alias("n")), "counts")
    by_size = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = written(source_targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))), "targets")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", kind="stable")
        whole, extra = fit_counts(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), float(rows["target"].iloc[0]))
        return pd.DataFrame({"code": rows["code"], "size": rows["size"], "whole": whole, "extra": extra})

    code = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))  # groups and joins by a key that is never null
    chosen = by_size.withColumn("code", code).join(targets.select(code.alias("code"), "target"), "code").select("code", "size", "n", "target").groupBy("code").applyInPandas(fit, "code string, size long, whole long, extra long")
    running = Window.partitionBy("code", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    per_slot = counted.withColumn("code", code).join(chosen, ["code", "size"]).withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    per_slot = per_slot.select("code", "size", "slot", "whole", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("part"), "n")
    per_slot = per_slot.join(targets.select(code.alias("code"), "source_size", "target"), "code")
    placed = sized.withColumn("code", code).join(per_slot, ["code", "size", "slot"])
    some = placed.where("part > 0 and part < n").withColumn("at", F.row_number().over(Window.partitionBy("code", "size", "slot").orderBy("rank", "doc_id"))).withColumn("copies", F.col("whole") + (F.col("at") <= F.col("part")).cast("long")).drop("at")
    plain = placed.where("part = 0 or part = n").withColumn("copies", F.col("whole") + (F.col("part") > 0).cast("long"))
    out = plain.unionByName(some)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
