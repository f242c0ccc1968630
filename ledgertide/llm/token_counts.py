"""Token counts: the exact histogram of encoded document lengths, and what its suffix sums answer.

The histogram has one row for each distinct length, however many documents there are. Suffix sums over it give,
for every context limit L: documents that are at least L long, tokens kept when every document is cut at L, and
tokens lost. Sums run by block of lengths and then over the few blocks, never over all lengths in one task.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.llm.common import written

#: The split pattern published with the vocabulary (fixed value; the vocabulary's ranks hold for it alone).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1024
_ENCODERS: dict[int, object] = {}


def encoder(raw: bytes, pattern: str = PATTERN):
    """A byte-level BPE encoder, built once in a worker."""
    import tiktoken

    if (key := hash(raw)) not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file (under 1 MB for 50,000 ranks), read by the driver and sent to each executor once."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def _counted(raw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, found = encoder(raw.value).encode_ordinary, Counter()
        for batch in batches:
            for text in batch.column(0):
                found[len(encode(text.as_py() or ""))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return run


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): how many rows of docs encode to exactly n_tokens tokens.

    Null and empty texts have 0 tokens. Each task counts its own rows first. An empty table gives no rows.
    """
    raw = vocabulary(docs.sparkSession, vocabulary_path)
    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted(raw), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def length_answers(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length L in the histogram, as a context limit:

    docs_at_least, tokens_at_least (suffix sums over lengths >= L), kept_tokens (all documents cut at L), lost_tokens,
    docs_up_to, share_up_to (the quantile at which L lies). Rows with equal n_tokens are added up first.
    """
    histogram = written(histogram.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")  # read twice below
    one = histogram.withColumn("block", F.floor(F.col("n_tokens") / block))
    tokens = F.col("n_docs") * F.col("n_tokens")
    by_block = one.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each 1024 lengths
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = by_block.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_above"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = one.join(above, "block").select("n_tokens", "n_docs", (F.sum("n_docs").over(here) + F.col("d_above")).alias("docs_at_least"), (F.sum(tokens).over(here) + F.col("t_above")).alias("tokens_at_least"), "d_all", "t_all")
    kept = F.col("t_all") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")
    up_to = F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", kept.alias("kept_tokens"), (F.col("t_all") - kept).alias("lost_tokens"), up_to.alias("docs_up_to"), (up_to / F.col("d_all")).alias("share_up_to"))


def truncated_total(histogram: DataFrame, limit: int) -> Column:
    """Tokens kept when each document is cut at `limit`, for any limit; an aggregate of the histogram."""
    return F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit)))


def length_quantiles(answers: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length at which at least that share of documents ends."""
    wanted = answers.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    met = answers.select("n_tokens", "share_up_to", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).where("share_up_to >= share")
    return wanted.join(met.groupBy("share").agg(F.min("n_tokens").alias("n_tokens")), "share", "left")
