"""Depth-limited suffix sorting: every byte inside a 200-byte string that starts more than once in the corpus.

Suffixes matter only through their first `size` bytes, so they are sorted by radix passes from the most significant
digit on, to that depth and no further; a group with a single suffix leaves after the pass that shows it. Equal groups
after the last pass are exactly the repeated windows.

1. First digit: suffixes are put in buckets by their least 40-byte gram (the anchor). Equal windows have equal anchors
   at equal offsets, and neighbouring suffixes share one, so a bucket entry stands for a run of about 80 suffixes.
2. Runs whose whole context (all bytes that any window at that anchor can hold) occurs twice are repeated as a whole.
   One run of every repeated context goes on as a witness for the runs that differ from it.
3. The contexts of a bucket are sorted from the anchor on, and from the anchor backwards, by digits of eight bytes, with
   the lengths that neighbours share. A window at offset o is repeated when another run of the bucket shares o bytes
   before the anchor and size - o bytes from it on: both follow from the two orders. All of this compares bytes.
4. A bucket of more than HOT different contexts is not sorted in one task. Its runs are split into blocks of 23 offsets;
   a block stays only if its common bytes occur twice, and what is left goes by single windows, each step a count by
   a 128-bit hash of bytes with map-side combination.
Entries of one bucket are laid together by each task before they are shuffled, so a passage that very many documents
hold is a few rows a task and not a row for each place.

Whole contexts are compared by two independent 64-bit hashes (of the anchor and of all bytes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.common import Rolling, forget, mix, spans_of, text_buffer, written

SIZE, GRAM, BLOCK = 200, 40, 23
REACH = SIZE - GRAM
CHUNK = 1 << 20
HOT = 4096  # different contexts of a bucket that one task sorts
ROUND = 20_000  # contexts sorted at once, about
_ROLL: list[Rolling] = []


def _hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(_ROLL[0].ranges(sums, a, b))


def _sums(data: np.ndarray) -> np.ndarray:
    if not _ROLL:
        _ROLL.append(Rolling(101, CHUNK + 1))
    return _ROLL[0].sums(data)


def _named(raw: bytes, a: np.ndarray, b: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit names of byte ranges."""
    out = np.empty(len(a), np.uint64)
    out[:] = [xxhash.xxh3_64_intdigest(raw[i:j], k) for i, j, k in zip(a.tolist(), b.tolist(), salt.tolist(), strict=True)]
    return out


def _same(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts of groups in it, their ends): rows with equal names laid together, in order of appearance."""
    order = np.argsort(names, kind="stable")
    cut = np.flatnonzero(np.diff(names[order]) != 0) + 1 if len(order) else np.zeros(0, np.int64)
    return order, np.concatenate(([0], cut)).astype(np.int64)[: len(order)], np.concatenate((cut, [len(order)]))[: len(cut) + 1 if len(order) else 0]


def _others(order: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> list[np.ndarray | None]:
    """For each group the values of its rows but the first; none for single rows."""
    return [values[order[a + 1 : b]] if b - a > 1 else None for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def runs(sums: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, gram hash) of every run of windows, positions in the buffer.

    The anchor of a window is the first of its grams with the least 32-bit value.
    """
    n = int(offsets[-1])
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n - gram + 1)
    grams = _hash(sums, at, at + gram)
    best = (grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    width, step = size - gram + 1, 1
    while 2 * step <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if step < width:
        best = np.minimum(best[: n - size + 1], best[width - step : width - step + n - size + 1])
    inside = np.zeros(n + 1, np.int32)  # windows that lie in one text
    long = np.diff(offsets) >= size
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - size + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[: n - size + 1]) > 0)
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    anchor = (best[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(start)])) - 1
    return anchor[first], start[first], start[last], grams[anchor[first]]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (core, key, pos, keys, positions): the runs of a bucket; what a batch has more than once is one row."""
    longs = pa.list_(pa.int64())
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        names, found = batch.column(0).to_numpy(), []
        for i, j in spans_of(offsets, CHUNK):
            at = offsets[i : j + 1] - offsets[i]
            anchor, _, _, core = runs(_sums(data[offsets[i] : offsets[j]]), at)
            row = np.searchsorted(at, anchor, "right") - 1
            found.append((core.view(np.int64), names[i:j][row], anchor - at[row]))
        if not found:
            continue
        core, key, pos = (np.concatenate([f[k] for f in found]) for k in range(3))
        order, starts, ends = _same(core)
        first = order[starts]
        columns = [pa.array(x[first]) for x in (core, key, pos)] + [pa.array(_others(order, starts, ends, x), longs) for x in (key, pos)]
        yield pa.RecordBatch.from_arrays(columns, names=["core", "key", "pos", "keys", "positions"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, positions, text) -> the runs at these positions with their contexts; equal ones of a batch are one row.

    lead: bytes of the context before the anchor.
    """
    longs = pa.list_(pa.int64())
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        names, wanted, found, contexts = batch.column(0).to_numpy(), batch.column(1), [], {}
        for i, j in spans_of(offsets, CHUNK):
            at = offsets[i : j + 1] - offsets[i]
            own = data[offsets[i] : offsets[j]]
            anchor, first, last, core = runs(_sums(own), at)
            row = np.searchsorted(at, anchor, "right") - 1
            places = wanted.slice(i, j - i)
            asked = places.flatten().to_numpy() + np.repeat(at[:-1], np.diff(places.offsets.to_numpy()))
            keep = np.isin(anchor, asked)
            anchor, first, last, core, row = anchor[keep], first[keep], last[keep], core[keep], row[keep]
            low, high = np.maximum(anchor - REACH, at[row]), np.minimum(anchor + SIZE, at[row + 1])
            lead, raw = anchor - low, own.tobytes()
            whole = _named(raw, low, high, lead)
            found.append((core.view(np.int64), whole.view(np.int64), names[i:j][row], anchor - at[row], anchor - last, anchor - first, lead))
            for name, a, b in zip(whole.tolist(), low.tolist(), high.tolist(), strict=True):
                if name not in contexts:
                    contexts[name] = raw[a:b]
        if not found:
            continue
        core, whole, key, pos, near, far, lead = (np.concatenate([f[k] for f in found]) for k in range(7))
        order, starts, ends = _same(whole)
        first = order[starts]
        columns = [pa.array(x[first]) for x in (core, whole, key, pos)] + [pa.array(x[first].astype(np.int32)) for x in (near, far, lead)]
        columns += [pa.array(_others(order, starts, ends, x), longs) for x in (key, pos)] + [pa.array([contexts[n] for n in whole[first].view(np.uint64).tolist()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["core", "whole", "key", "pos", "near", "far", "lead", "keys", "positions", "context"])


def radix_order(data: np.ndarray, at: np.ndarray, end: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each row in the order, bytes that each place shares with the one before): rows by bucket, then by their bytes.

    Passes over digits of eight bytes, most significant first; a row that no other equals so far is done. Bytes from end
    on count as zeros, so the shared lengths of shorter rows hold only as far as these go. -1 parts buckets.
    """
    padded = np.concatenate((data, np.zeros(depth + 8, np.uint8)))
    digits = np.ndarray((len(data) + depth,), ">u8", padded, strides=(1,))
    order = np.argsort(bucket, kind="stable")
    group = bucket[order]
    shared = np.full(len(order), depth, np.int64)
    shared[np.concatenate(([True], group[1:] != group[:-1]))] = -1
    act = np.arange(len(order))
    for k in range(0, depth, 8):
        twin = group[1:] == group[:-1]
        keep = np.concatenate((twin, [False])) | np.concatenate(([False], twin))
        act, group = act[keep], group[keep]
        if not len(act):
            break
        rows = order[act]
        over = np.clip(at[rows] + k + 8 - end[rows], 0, 8).astype(np.uint64)
        digit = digits[np.minimum(at[rows] + k, len(data))].astype(np.uint64)
        digit = np.where(over < 8, digit >> np.uint64(8) * np.minimum(over, 7) << np.uint64(8) * np.minimum(over, 7), 0)
        by = np.lexsort((digit, group))
        order[act], digit = rows[by], digit[by]
        fresh = np.concatenate(([True], group[1:] != group[:-1]))
        differ = np.concatenate(([0], digit[1:] ^ digit[:-1]))
        split = ~fresh & (differ != 0)
        some = differ[split]
        shared[act[split]] = k + sum((some < np.uint64(1) << np.uint64(64 - 8 * j)).astype(np.int64) for j in range(1, 8))
        group = np.cumsum(fresh | split)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, shared


def repeated_offsets(data: np.ndarray, at: np.ndarray, lead: np.ndarray, near: np.ndarray, far: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """(contexts, REACH + 1): whether the window at each offset also stands in another context of the bucket."""
    start, end = at[:-1], at[1:]
    right, shared_right = radix_order(data, start + lead, end, bucket, SIZE)
    left, shared_left = radix_order(data[::-1].copy(), len(data) - start - lead, len(data) - start, bucket, REACH)
    out = np.zeros((len(start), REACH + 1), bool)
    for o in range(REACH + 1):
        rows = np.flatnonzero((near <= o) & (far >= o))
        if len(rows) < 2:
            continue
        name = np.cumsum(shared_left < o)[left[rows]] * (len(start) + 1) + np.cumsum(shared_right < SIZE - o)[right[rows]]
        by = np.argsort(name)
        twin = np.diff(name[by]) == 0
        out[rows[by], o] = np.concatenate((twin, [False])) | np.concatenate(([False], twin))
    return out


def _radix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(core, key, pos, near, far, lead, lone, context), sorted by core -> (key, start, end): repeated windows of lone contexts."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        core, key, pos, near, far, lead = (np.concatenate([p.column(k).to_numpy() for p in parts]).astype(np.int64) for k in range(6))
        lone = np.concatenate([p.column(6).to_numpy(zero_copy_only=False) for p in parts])
        data, at = text_buffer(pa.concat_arrays([p.column(7) for p in parts]))
        bucket = np.cumsum(np.concatenate(([0], (core[1:] != core[:-1]).astype(np.int64))))
        found = repeated_offsets(data, at, lead, near, far, bucket) & lone[:, None]
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, first), (_, past) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[row], pos[row] - past + 1, pos[row] - first + SIZE)], names=["key", "start", "end"])

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        core = batch.column(0).to_numpy()
        last = held[-1].column(0)[-1].as_py() if held else None
        cuts = (np.flatnonzero(core[1:] != core[:-1]) + 1).tolist()
        cuts = ([0] if last is not None and core[0] != last else []) + cuts
        at = 0
        for cut in cuts:
            if n + cut - at >= ROUND:
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                yield solve(held)
                held, n, at = [], 0, cut
        held.append(batch.slice(at))
        n += batch.num_rows - at
    if held:
        yield solve(held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, near, far, lead, context) -> (id, block, x, y): the blocks of offsets that a run touches, and their common bytes."""
    for batch in batches:
        raw, out = batch.column(4).to_pylist(), []
        for key, near, far, lead, text in zip(*(batch.column(k).to_pylist() for k in range(4)), raw, strict=True):
            for t in range(near // BLOCK, far // BLOCK + 1):
                name = xxhash.xxh3_128_digest(text[lead - t * BLOCK if t * BLOCK <= lead else 0 : lead - min(t * BLOCK + BLOCK - 1, REACH) + SIZE], t)
                out.append((key, t, int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k == 1 else pa.int64()) for k in range(4)], names=["id", "block", "x", "y"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, near, far, lead, context, blocks) -> (id, offset, x, y): single windows of the blocks that are left."""
    for batch in batches:
        out = []
        for key, near, far, lead, text, blocks in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            for t in blocks:
                for o in range(max(near, t * BLOCK), min(far, t * BLOCK + BLOCK - 1) + 1):
                    name = xxhash.xxh3_128_digest(text[lead - o : lead - o + SIZE])
                    out.append((key, o, int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k == 1 else pa.int64()) for k in range(4)], names=["id", "offset", "x", "y"])


def _span(near: Column, far: Column) -> list[Column]:
    return [(F.col("pos") - far).alias("start"), (F.col("pos") - near + SIZE).alias("end")]


def _hot_ranges(hot: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Repeated windows of lone contexts of hot buckets, and the tables that this reads: blocks of offsets, then single windows."""
    hot = written(hot.withColumn("id", F.xxhash64("key", "pos")), "hot")
    split = written(hot.select("id", "near", "far", "lead", "context").mapInArrow(_blocks, "id long, block int, x long, y long"), "split")
    twice = split.groupBy("block", "x", "y").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    left = split.join(twice, ["block", "x", "y"]).groupBy("id").agg(F.collect_set("block").alias("blocks"))
    single = hot.join(left, "id").select("id", "near", "far", "lead", "context", "blocks").mapInArrow(_windows, "id long, offset int, x long, y long")
    single = written(single, "windows")
    again = single.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    out = single.join(again, ["x", "y"]).join(hot.where("lone").select("id", "key", "pos"), "id").select("key", *_span(F.col("offset"), F.col("offset")))
    return out, [hot, split, single]


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(key long, text binary) -> (key, ranges): byte ranges that repeated windows cover; they overlap, in no order."""

    def each(*more: str) -> Column:
        one = F.array(F.struct("key", "pos", *more))
        others = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.col("positions")[i].alias("pos"), *more))
        return F.explode(F.when(F.col("keys").isNull(), one).otherwise(F.concat(one, others))).alias("e")

    size = F.when(F.col("keys").isNull(), F.lit(1)).otherwise(F.size("keys") + 1).cast("long")
    entries = written(docs.mapInArrow(_entries, "core long, key long, pos long, keys array<long>, positions array<long>"), "entries")
    twice = entries.groupBy("core").agg(F.sum(size).alias("n")).where("n > 1").select("core")
    places = written(entries.join(twice, "core").select(each()).groupBy("e.key").agg(F.collect_set("e.pos").alias("positions")), "places")
    forget(entries)
    found = docs.join(places, "key").select("key", "positions", "text").mapInArrow(_contexts, "core long, whole long, key long, pos long, near int, far int, lead int, keys array<long>, positions array<long>, context binary")
    found = written(found, "contexts")
    alike = written(found.groupBy("core", "whole").agg(F.sum(size).alias("same"), F.min(F.struct("key", "pos")).alias("first")), "alike")
    whole = found.join(alike.where("same > 1").select("core", "whole"), ["core", "whole"]).select(each("near", "far")).select("e.*").select("key", *_span(F.col("near"), F.col("far")))
    buckets = alike.groupBy("core").agg(F.count("*").alias("contexts")).where("contexts > 1")
    firsts = alike.join(buckets, "core").select("core", F.col("first.key").alias("key"), F.col("first.pos").alias("pos"), (F.col("same") == 1).alias("lone"), "contexts")
    left = found.join(firsts, ["core", "key", "pos"]).select("core", "key", "pos", "near", "far", "lead", "lone", "context", "contexts")
    left = written(left, "open")
    sorted_ = left.where(F.col("contexts") <= HOT).drop("contexts").repartition("core").sortWithinPartitions("core")
    some = sorted_.mapInArrow(_radix, "key long, start long, end long")
    single, used = _hot_ranges(left.where(F.col("contexts") > HOT).drop("contexts"))
    out = written(whole.unionByName(some).unionByName(single).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    forget(places, found, alike, left, *used)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw, spans = text.as_py() or b"", []
            for r in sorted((r["start"], r["end"]) for r in ranges or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append([*r])
            kept, at = hashlib.sha256(), 0
            for a, b in [*spans, (len(raw), len(raw))]:
                kept.update(raw[at:a])
                at = b
            rows.append((key, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [a for a, _ in spans], [b for _, b in spans]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends): one row for each row of docs.

    Texts are UTF-8 bytes; null texts are empty. starts and ends are the maximal runs of bytes that 200-byte strings
    with another start anywhere (the same text included) cover. Rows that repeat an id, or an id and a text, count
    as separate texts. Spans may cut a character; kept_sha256 is over bytes.
    """
    keyed = docs.select(_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    ranges = repeated_ranges(keyed.where("octet_length(text) > 0").select("key", "text"))
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    return keyed.join(ranges, "key", "left").select("doc_id", "text", "ranges").mapInArrow(_cut, kinds)
