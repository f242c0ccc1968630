"""Benchmark decontamination: pigeonhole pieces, exact piece hits, Myers bit-parallel verification.

Texts are compared in lower case with each run of white space as one space. An item of n characters has an error
budget of floor(n * rate) edits. Cut into budget + 1 pieces, any text within the budget leaves one piece whole; so
every occurrence shows an exact piece hit near its place. Hits come from one Aho-Corasick automaton over the pieces
of a block of items; each is verified by Myers' bit-vector edit distance in a window around it.

The benchmark is processed in blocks of bounded size, so neither the driver nor an executor holds all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.08
#: Characters of benchmark items in one automaton (about 100 bytes of memory each).
BLOCK_CHARS = 2_000_000
_AUTOMATA: dict[int, tuple] = {}


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = RATE) -> tuple[int, list[tuple[int, str]]]:
    """(budget, [(offset, piece)]): floor(length * rate) edits, and budget + 1 pieces of nearly equal length."""
    budget = int(len(item) * rate)
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], length: int, window: str, stop_at: int = -1) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to any substring of window, and its first end.

    The search ends early once the distance is stop_at or less.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    for i, c in enumerate(window):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
        if score < best:
            best, end = score, i + 1
            if best <= stop_at:
                break
    return best, end


def _automaton(key: int, items: list[tuple[int, str]], rate: float) -> tuple:
    if key not in _AUTOMATA:
        import ahocorasick

        found: dict[str, list[tuple[int, int]]] = {}
        whole = []
        for k, (_, text) in enumerate(items):
            budget, parts = pieces(text, rate)
            whole.append((text, budget, letter_masks(text)))
            for at, piece in parts:
                found.setdefault(piece, []).append((k, at))
        machine = ahocorasick.Automaton()
        for piece, places in found.items():
            machine.add_word(piece, (len(piece), places))
        machine.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = machine, whole
    return _AUTOMATA[key]


def item_matches(text: str, machine, whole: list) -> dict[int, tuple[int, int]]:
    """{item index: (least distance, end in the normalised text)} for items within their budget.

    Hits on one diagonal band are verified once; an item found without an edit needs no further look.
    """
    found: dict[int, tuple[int, int]] = {}
    tried: set[tuple[int, int]] = set()
    for end, (length, places) in machine.iter(text):
        for k, at in places:
            if k in found and found[k][0] == 0:
                continue
            item, budget, masks = whole[k]
            start = end + 1 - length - at
            band = (k, start // (budget + 1))
            if band in tried:
                continue
            tried.add(band)
            low = max(0, (start // (budget + 1)) * (budget + 1) - budget)
            high = (start // (budget + 1) + 1) * (budget + 1) + len(item) + budget
            if text[max(0, start) : max(0, start) + len(item)] == item:
                found[k] = 0, max(0, start) + len(item)
                continue
            distance, stop = best_match(masks, len(item), text[low:high])
            if distance <= budget and (k not in found or distance < found[k][0]):
                found[k] = distance, low + stop
    return found


def _search(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = shared.value
        machine, whole = _automaton(key, items, rate)
        for batch in batches:
            rows = []
            for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                for k, (distance, end) in item_matches(normal(text.as_py()), machine, whole).items():
                    rows.append((doc, items[k][0], distance, end))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["doc_id", "item_id", "distance", "end_at"])

    return run


def _blocks(items: Iterator, most: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in items:
        text = normal(row.text)
        if not text:
            continue
        block.append((row.item_id, text))
        size += len(text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end_at): benchmark items that occur in a row of docs within their error budget.

    One row for each row of docs and item found; distance is the least number of edits, end_at where that match ends
    in the normalised text. Null or empty texts and items match nothing. Repeated ids are separate rows, null ids stay
    null; repeated items are one. Very long texts are searched whole. Empty tables give no rows. Columns other than the
    four are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    out = None
    for block in _blocks(items.toLocalIterator(), block_chars):
        part = rows.mapInArrow(_search(spark.sparkContext.broadcast((hash(tuple(block)), block)), rate), "doc_id long, item_id long, distance long, end_at long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, distance long, end_at long")


def contaminated_documents(found: DataFrame) -> DataFrame:
    """(doc_id, n_items, item_ids, least_distance): one row for each contaminated id."""
    return found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.min("distance").alias("least_distance"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that contaminated() would list; all columns stay as they are, nothing is moved.

    Null and empty texts stay, and without benchmark items everything does.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    column = docs.columns.index(text_col)

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, block = shared.value
            machine, whole = _automaton(key, block, rate)
            for batch in batches:
                clean = [not item_matches(normal(text.as_py()), machine, whole) for text in batch.column(column)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for block in _blocks(items.toLocalIterator(), block_chars):
        docs = docs.mapInArrow(keep(docs.sparkSession.sparkContext.broadcast((hash(tuple(block)), block))), docs.schema)
    return docs
