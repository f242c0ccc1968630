"""Word n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

1. Every text becomes its set of distinct word shingles. Equal sets form one class and meet once.
2. Shingles have one order for the whole corpus: by how often a fixed table of counters saw them, then by hash. Two
   sets that reach the threshold share at least one of their first n - ceil(threshold * n) + 1 shingles, so these
   are the tiles that a class enters; no link is missed. The counters only make tiles of common passages small: any
   order gives the same links. Tiles with one class go, tiles that hold the same classes are kept once.
3. In a tile, classes are laid out by set size, and a class meets only the band of sizes that can reach the
   threshold. Parity bitmaps bound the overlap from above: each bit in which two bitmaps differ stands for at least
   one element that only one set has.
4. What passes the bound is decided by intersecting the sorted shingle arrays. First every class tries its closest
   partner in its block of a tile; links found so merge classes. Then all pairs left between different components
   are tried: the classes outside a tile's most frequent component against all of the tile, block by block. No tile
   is capped, and no task holds more than two blocks.
5. Where links are asked for, all pairs of classes inside a component are decided exactly, whichever tiles they share.
   A component of many shingles is cut into blocks by hash, and each pair of blocks is a task of its own.

Classes are told apart by 128 bits, so equal names never link different sets; tiles go by the first 64, and of two
classes that share these (probability n * n / 4e19 for n classes) only one enters tiles. Shingles have 64 bits: a pair
of sets of 20,000 meets an equal hash of different shingles with probability 2e-11, and then its overlap is one too large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.llm.common import forget, mix, spans_of, text_buffer, written
from ledgertide.llm.components import components
from ledgertide.llm.shingles import shingle_sets

CHUNK = 1 << 20
BLOCK = 1 << 18  # shingles of a block, about
TILE = 2048  # classes of a block of a tile, about
COUNTERS = 1 << 20


def _names(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names for each set; sets with both equal are equal."""
    n = np.diff(at)
    out = np.zeros((2, len(n)), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        some = at[:-1][full]
        total, odd = np.add.reduceat(mix(sets), some), np.bitwise_xor.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), some)
        out[0, full], out[1, full] = mix(total + n[full].astype(np.uint64)), mix(odd ^ n[full].astype(np.uint64))
    return out[0], out[1]


def bitmap(own: np.ndarray) -> bytes:
    """A parity bitmap of 64 to 8192 bits, about four for each element: few differing elements share a bit, so the bound is tight."""
    bits = 1 << min(max(int(4 * len(own) - 1).bit_length(), 6), 13)
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


class _Seen:
    """Which sets a task has met. It forgets all when full, which costs a repeated row downstream and nothing else."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.names = most, set()

    def fresh(self, name: tuple[int, int]) -> bool:
        if name in self.names:
            return False
        if len(self.names) >= self.most:
            self.names.clear()
        self.names.add(name)
        return True


def _chunks(batches: Iterator[pa.RecordBatch], words: int, column: int) -> Iterator[tuple]:
    """(batch, i, j, sets, at, first names, second names) of consecutive rows."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(column))
        for i, j in spans_of(offsets, CHUNK):
            sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            yield batch, i, j, sets, at, *_names(sets, at)


def _counter(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(44)).astype(np.int64)


def _frequent(words: int):
    """Counters far above the mean of their task; each set counts once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, count = _Seen(), np.zeros(COUNTERS, np.int64)
        for _, i, j, sets, at, x, y in _chunks(batches, words, 1):
            fresh = np.array([n > 0 and seen.fresh(name) for n, name in zip(np.diff(at).tolist(), zip(x.tolist(), y.tolist(), strict=True), strict=True)], bool)
            count += np.bincount(_counter(sets[np.repeat(fresh, np.diff(at))]), minlength=COUNTERS)
        high = np.flatnonzero(count >= max(4, 8 * count.sum() // COUNTERS))
        yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(count[high])], names=["counter", "n"])

    return run


def shingle_levels(docs: DataFrame, words: int) -> np.ndarray:
    """The level of each of COUNTERS counters: 0, or the binary logarithm of its count over the corpus. Of fixed size."""
    found = docs.mapInArrow(_frequent(words), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    levels = np.zeros(COUNTERS, np.uint8)
    levels[found["counter"].to_numpy(np.int64)] = np.log2(found["n"].to_numpy(float)).astype(np.uint8)
    return levels


def prefix(own: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set in the corpus order, as many as two sets cannot both have without sharing one."""
    size = len(own) + (-percent * len(own)) // 100 + 1
    own_levels = levels[_counter(own)]
    return own[np.argsort(own_levels, kind="stable")[:size]] if own_levels.any() else own[:size]


_SIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("bitmap", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _signatures(words: int, percent: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rank = _Seen(), levels.value
        for batch, i, j, sets, at, x, y in _chunks(batches, words, 1):
            n = np.diff(at)
            maps: list[bytes | None] = [None] * (j - i)
            keys: list[np.ndarray | None] = [None] * (j - i)
            for k in np.flatnonzero(n).tolist():  # a class needs its tiles once in each task
                if seen.fresh((int(x[k]), int(y[k]))):
                    own = sets[at[k] : at[k + 1]]
                    maps[k], keys[k] = bitmap(own), prefix(own, rank, percent).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i), batch.column(0).slice(i, j - i), pa.array(n), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(maps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=_SIGNED)

    return run


def _arrays(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, _, sets, at, _, _ in _chunks(batches, words, 1):
            full = np.flatnonzero(np.diff(at))
            shingles = [sets[at[k] : at[k + 1]].tobytes() for k in full.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full + i)), pa.array(shingles, pa.binary())], names=["cls", "shingles"])

    return run


class _Layers:
    """Rows of ascending set size with their bitmaps, by bitmap width; each can be folded to half its width."""

    def __init__(self, n: np.ndarray, maps: list[bytes]):
        self.n = n
        self.width = np.array([len(m) // 8 for m in maps])
        self.layers = {}
        for w in np.unique(self.width):
            at, end = np.searchsorted(self.width, w), np.searchsorted(self.width, w, "right")
            own = np.frombuffer(b"".join(maps[at:end]), np.uint64).reshape(-1, w)
            self.layers[int(w)] = (int(at), int(end), own, _folded(own) if w > 1 else own)

    def near(self, n: int, mine: np.ndarray, low: int, high: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, differing share) of rows low to high whose overlap bound with a set of n elements reaches the threshold."""
        w = len(mine)
        for level in (w // 2, w, 2 * w):
            if level not in self.layers:
                continue
            at, end, own, half = self.layers[level]
            a, b = max(low, at), min(high, end)
            if a >= b:
                continue
            other = (half if level > w else own)[a - at : b - at]
            both = n + self.n[a:b]
            differ = np.bitwise_count(other ^ (_folded(mine[None, :])[0] if level < w else mine)).sum(1, dtype=np.int64)
            most = (both - differ) // 2
            fit = np.flatnonzero(100 * most >= percent * (both - most))
            yield a + fit, differ[fit] / both[fit]

    def bitmap(self, i: int) -> np.ndarray:
        w = int(self.width[i])
        return self.layers[w][2][i - self.layers[w][0]]


def _folded(maps: np.ndarray) -> np.ndarray:
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def closest_pairs(n: np.ndarray, maps: list[bytes], percent: int) -> list[tuple[int, int]]:
    """For each row of a block the larger or equal one that differs least, if any overlap bound reaches the threshold.

    A row for which only smaller ones do brings the one of these that differs least. Links upwards form trees, so that
    a group of near copies becomes few components at once.
    """
    rows, out = _Layers(n, maps), []
    first, last = np.searchsorted(n, -(-percent * n // 100)), np.searchsorted(n, 100 * n // percent, "right")
    for i in range(len(n)):  # the band of sizes that can link, but for the row itself
        best = None
        for low, high in ((i + 1, int(last[i])), (int(first[i]), i)):
            if best:
                break
            for found, share in rows.near(int(n[i]), rows.bitmap(i), low, high, percent):
                if len(found) and (best is None or share.min() < best[0]):
                    best = share.min(), int(found[share.argmin()])
        if best:
            out.append((i, best[1]))
    return out


def cross_pairs(left: tuple, right: tuple, percent: int) -> list[tuple[int, int]]:
    """Pairs (left, right) in different components whose overlap bound reaches the threshold; each side: n ascending, label, bitmaps."""
    mine, rows, out = _Layers(left[0], left[2]), _Layers(right[0], right[2]), []
    low = np.searchsorted(right[0], -(-percent * left[0] // 100))
    high = np.searchsorted(right[0], 100 * left[0] // percent, "right")
    for i in range(len(left[0])):
        for found, _ in rows.near(int(left[0][i]), mine.bitmap(i), int(low[i]), int(high[i]), percent):
            out += [(i, j) for j in found[right[1][found] != left[1][i]].tolist()]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows with equal values of the first `keys` long columns."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(names[:, a].tolist())
            if parts and key != now:
                yield parts
                parts = []
            now = key
            parts.append(batch.slice(a, b - a))
    if parts:
        yield parts


def _tiles(percent: int, closest: bool):
    """(key, block, other, left, cls, n, label, bitmap), sorted by the first three -> pairs of classes that may link."""

    def solve(parts: list[pa.RecordBatch]) -> set[tuple[int, int]]:
        side, cls, n, label = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in (3, 4, 5, 6))
        maps = [m for p in parts for m in p.column(7).to_pylist()]
        order = np.lexsort((cls, n))
        if closest:
            names = cls[order]
            pairs = [(names[i], names[j]) for i, j in closest_pairs(n[order], [maps[k] for k in order.tolist()], percent)]
        else:
            halves = [order[side[order] == s] for s in (True, False)]
            if not len(halves[0]) or not len(halves[1]):
                return set()
            left, right = ((n[h], label[h], [maps[k] for k in h.tolist()]) for h in halves)
            names = [cls[h] for h in halves]
            pairs = [(names[0][i], names[1][j]) for i, j in cross_pairs(left, right, percent)]
        return {(int(min(p)), int(max(p))) for p in pairs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for parts in _grouped(batches, 3):
            out |= solve(parts)
            if len(out) > 20_000:
                yield _pairs(out)
                out = set()
        yield _pairs(out)

    return run


def _pairs(out: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(right, left), len(right) - 1)
                common = int((right[at] == left).sum())
                good.append(100 * common >= percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def block_links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """(left, right) matrix of links: 100 * |intersection| >= percent * |union|. Sets are sorted and not empty."""
    n = np.array([len(r) for r in right])
    every, at = np.unique(np.concatenate(right), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    out = np.zeros((len(left), len(right)), bool)
    for i, own in enumerate(left):
        where = np.minimum(np.searchsorted(every, own), len(every) - 1)
        held = np.zeros(len(every), np.int32)
        held[where[every[where] == own]] = 1
        common = np.add.reduceat(held[at], starts, dtype=np.int64)
        out[i] = 100 * common >= percent * (len(own) + n - common)
    return out


def _link_counts(percent: int):
    """(label, x, y, block, cls, copies, shingles), sorted by the first three -> (cls, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _grouped(batches, 3):
            x, y = (parts[0].column(k)[0].as_py() for k in (1, 2))
            rows = [(*r, np.frombuffer(s.as_buffer(), np.uint64)) for p in parts for *r, s in zip(*(p.column(k).to_pylist() for k in (3, 4, 5)), p.column(6), strict=True)]
            left, right = [r for r in rows if r[0] == x], [r for r in rows if r[0] == y]
            if not left or not right or (x == y and len(left) < 2):
                continue
            linked = block_links([r[3] for r in left], [r[3] for r in right], percent)
            if x == y:
                np.fill_diagonal(linked, False)
            counts = [(left, linked @ np.array([r[2] for r in right], np.int64))]
            if x != y:
                counts.append((right, linked.T @ np.array([r[2] for r in left], np.int64)))
            for side, n in counts:
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in side], pa.int64()), pa.array(n, pa.int64())], names=["cls", "links"])

    return run


def _counted(classes: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(cls, links): rows of other classes that each class links with. Links lie inside components, whose pairs are all tried."""
    linked = label.join(classes.select("cls", "n", "copies"), "cls")
    blocks = linked.groupBy("label").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).alias("blocks"))
    laid = linked.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    laid = laid.select("label", "block", "cls", "copies", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    laid = laid.join(sets, "cls").select("label", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cls", "copies", "shingles")
    counts = laid.repartition("label", "x", "y").sortWithinPartitions("label", "x", "y").mapInArrow(_link_counts(percent), "cls long, links long")
    return counts.groupBy("cls").agg(F.sum("links").alias("links"))


def _block(blocks: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "cls", "key"), F.col(blocks))


def _sized(members: DataFrame) -> DataFrame:
    return members.join(members.groupBy("key").agg(F.ceil(F.count("*") / F.lit(TILE)).alias("blocks")), "key")


def _one_sided(members: DataFrame) -> DataFrame:
    """Members in blocks of one tile, as _tiles reads them but for n and bitmap."""
    return _sized(members).select("key", _block("blocks", 1).alias("block"), F.lit(0).cast("long").alias("other"), F.lit(False).alias("left"), "cls", F.col("cls").alias("label"))


def _two_sided(members: DataFrame, label: DataFrame, tried: DataFrame) -> DataFrame:
    """What may still link: the classes outside a tile's most frequent component (left) against all of the tile (right).

    In a tile of one block a class without a closest partner has no partner at all.
    """
    some = tried.select(F.col("a").alias("cls")).union(tried.select("b")).distinct().withColumn("tried", F.lit(True))
    sized = _sized(members).join(some, "cls", "left").where("blocks > 1 or tried").drop("tried")
    sized = sized.join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    shares = sized.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("major"), (F.sum("m") - F.max("m")).alias("others"))
    sized = sized.join(shares.where("others > 0").select("key", "major", F.ceil(F.col("others") / F.lit(TILE)).alias("groups")), "key")
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    left = sized.where("label <> major").select("key", _block("groups", 2).alias("block"), every("blocks").alias("other"), F.lit(True).alias("left"), "cls", "label")
    right = sized.select("key", every("groups").alias("block"), _block("blocks", 3).alias("other"), F.lit(False).alias("left"), "cls", "label")
    return left.unionByName(right)


def _sets(docs: DataFrame, met: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(cls, shingles) of the classes in pairs."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(met.select("cls", "row"), "cls")
    return docs.join(wanted.hint("merge"), "row").select("cls", "text").mapInArrow(_arrays(words), "cls long, shingles binary")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, links: bool = False, row_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) and, if links are asked for, n_links: one row for each row of docs.

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets. component_id is the smallest
    id reachable by links, null if no row of the component has an id. Null or empty texts, and texts without words,
    have no shingles and link with nothing; their component is their own id. Rows that repeat an id or have none link
    like others. Very long texts are taken whole, one at a time. An empty table gives no rows. Other columns are not
    read, whatever their names.
    class_id names the set (null: no shingles). n_links is the number of other rows that a row links with, those of
    its own class included; without it only as many links are decided as the components need.

    Rows are told apart by row_col, a long that no two rows share and that is the same on each reading; without one
    they are numbered in a table of their own. With one, row_col comes too, and stays: true for the row with the least
    id of each component (null last, then the least row_col) and for rows without shingles.
    """
    number = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), number.alias("row"))
    docs = docs if row_col else written(docs, "rows")
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, words))
    signed = written(docs.mapInArrow(_signatures(words, percent, levels), "row long, doc_id long, n long, x long, y long, bitmap binary, keys array<long>"), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "row")).alias("least")
    kept = F.min(F.when(F.col("keys").isNotNull(), F.col("row"))).alias("kept")  # a row that carries the tiles
    classes = signed.where("n > 0").groupBy("x", "y").agg(kept, least, F.max("n").alias("n"), F.count("*").alias("copies"))
    main = F.row_number().over(Window.partitionBy("x").orderBy("y")) == 1
    classes = written(classes.withColumn("cls", F.when(main, F.col("x")).otherwise(F.xxhash64("x", "y"))), "classes")
    entered = signed.where("keys is not null").select(F.col("x").alias("cls"), F.explode("keys").alias("key")).repartition("key")
    shared = entered.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("key")
    crowd = written(entered.join(shared.hint("merge"), "key").distinct(), "crowd")
    alike = crowd.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("odd"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("even"))
    members = written(crowd.join(alike.groupBy("m", "odd", "even").agg(F.min("key").alias("key")).select("key"), "key"), "members")
    heads = members.select("cls").distinct().join(classes.select("cls", "kept"), "cls").select("cls", F.col("kept").alias("row"))
    met = written(heads.join(signed.where("keys is not null").select("row", "n", "bitmap"), "row"), "met")
    forget(crowd)

    joined, label, sets, tried, done = None, None, None, None, []
    for closest in (True, False):
        laid = _one_sided(members) if closest else _two_sided(members, label, tried)
        laid = laid.join(met.select("cls", "n", "bitmap"), "cls").select("key", "block", "other", "left", "cls", "n", "label", "bitmap")
        laid = laid.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other")
        pairs = written(laid.mapInArrow(_tiles(percent, closest), "a long, b long").distinct(), "pairs")
        tried, more = (pairs, pairs) if closest else (tried, None)
        if not closest:  # classes that meet a partner only now
            lacking = pairs.select(F.explode(F.array("a", "b")).alias("a")).distinct().join(sets.select(F.col("cls").alias("a")), "a", "left_anti")
            more = None if lacking.isEmpty() else lacking.withColumn("b", F.col("a"))
        if more is not None:
            got = written(_sets(docs, met, more, words), "sets")
            sets = got if sets is None else sets.unionByName(got)
            done.append(got)
        pairs = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
        found = written(pairs.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"), "links")
        joined = found if joined is None else joined.unionByName(found)
        label = components(joined).select(F.col("v").alias("cls"), "label")
        done.append(found)
    whole = classes.select("x", "y", "cls", "least", "copies").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    first = whole.groupBy("label").agg(F.min("least").alias("first"))
    named = whole.join(first, "label").select("x", "y", "cls", "copies", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row"))
    if links:
        counts = written(_counted(classes, label, sets, percent), "link-counts")
        named = named.join(counts, "cls", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    out = signed.select("row", "doc_id", "n", "x", "y").join(named, ["x", "y"], "left")
    forget(members, met, *done)
    if not row_col:
        forget(docs)
    more = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []
    more += [F.col("row").alias(row_col), F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)).alias("stays")] if row_col else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("cls").alias("class_id"), *more)
