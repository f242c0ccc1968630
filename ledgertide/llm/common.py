"""What the operators share: table reading, shared scratch space, Arrow text buffers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`, as a Java and DuckDB character class.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="ledgertide-"))
    return _OWN[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the context may be gone at exit
        pass


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder, and read it back.

    The table outlives lost executors. `forget` removes it early; what is left goes when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgertide/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete_quietly, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgertide_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove written() tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._ledgertide_path)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2: rows that no model may learn from. A null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def least_hashes(rows: DataFrame, group: str, rank: str, most: int) -> DataFrame:
    """Of each group (not null) the `most` rows with the least rank, a 64-bit hash; rows of equal rank stay or go together.

    Counts by the first 20 bits of the hash say which rows surely stay; only those of the one value at the edge are
    ordered, about a millionth of a group. One task reads a group's counts, 2^20 rows at most however large the group is.
    The choice is the same however rows are laid.
    """
    rows = rows.withColumn("__first", F.shiftrightunsigned(rank, 44))
    counts = rows.groupBy(group, "__first").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__first").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    edges = counts.withColumn("__before", before).where(F.col("__before") < most).groupBy(group).agg(F.max("__first").alias("__edge"), F.max("__before").alias("__before"))
    near = rows.join(F.broadcast(edges), group).where("__first <= __edge")  # a row for each label or language
    last = near.where("__first = __edge").withColumn("__nth", F.rank().over(Window.partitionBy(group).orderBy(rank)) + F.col("__before")).where(F.col("__nth") <= most)
    columns = [c for c in rows.columns if c != "__first"]
    return near.where("__first < __edge").select(columns).union(last.select(columns))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and its n + 1 offsets; null rows are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        raise TypeError(f"not a text column: {column.type}")
    if column.null_count:
        empty = pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type)
        column = column.fill_null(empty)
    _, where, data = column.buffers()
    at = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def spans_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `most` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds); x is uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def random_words(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, none empty: eight bytes at a time go through a finaliser that is one to one.

    Ranges of up to 8 bytes and equal length never collide; others do as random 64-bit values would, however regular
    their bytes are. Ranges of over 512 bytes are hashed one by one.
    """
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = np.flatnonzero(size <= 512)
    at, k = start[left], 0
    while len(left):
        rest = np.minimum(size[left] - k, 8).astype(np.uint64)
        part = words[at + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        out[left] = mix(out[left] ^ part)
        k += 8
        more = size[left] > k
        left, at = left[more], at[more]
    for i in np.flatnonzero(size > 512).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


class Rolling:
    """Polynomial hashes of byte ranges modulo 2^64 over random byte codes; any range in a few operations.

    Regular texts can make different ranges equal, so these choose places and buckets only; what decides is compared
    otherwise. powers are kept for `room` bytes and grow when a longer text comes.
    """

    def __init__(self, seed: int, room: int = 1 << 20):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**63, dtype=np.int64)) * 8 + 5 & (2**64 - 1)
        self.back = pow(self.base, -1, 2**64)
        self.up, self.down = self._powers(self.base, room), self._powers(self.back, room)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:
            step = np.uint64(pow(base, done, 2**64))
            take = min(done, n - done)
            out[done : done + take] = out[:take] * step
            done += take
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums, one longer than data."""
        if len(data) + 1 > len(self.up):
            room = 2 * (len(data) + 1)
            self.up, self.down = self._powers(self.base, room), self._powers(self.back, room)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]
