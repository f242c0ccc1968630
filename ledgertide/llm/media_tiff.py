"""TIFF columns: walk image directories, undo compression and predictors, one row per page; and a writer for payloads.

Read: both byte orders, chained image directories, strips and tiles, 8-bit samples, chunky or planar, compression
none (1), LZW (5), deflate (8 and 32946) and PackBits (32773), predictors none (1) and horizontal (2).
Tag numbers and codes below are those of the TIFF 6.0 specification and its deflate supplement (fixed values).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
MOST_SAMPLES = 1 << 28
_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


class BadTiff(ValueError):
    pass


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # (height, width, samples) uint8


# --- codecs -------------------------------------------------------------------------------------------------


def packbits_decode(data: bytes, most: int = 1 << 62) -> bytes:
    """The unpacked bytes; reading ends once there are `most` of them."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = data[k : min(k + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        literal(at, run.start())
        out.append(257 - (run.end() - run.start()))
        out.append(data[run.start()])
        at = run.end()
    literal(at, len(data))
    return bytes(out)


def lzw_decode(data: bytes, most: int = 1 << 62) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends, and so do `most` bytes."""
    out: list[bytes] = []
    made = 0
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    words, width, old = list(base), 9, None
    store, have, at, n = 0, 0, 0, len(data)
    while True:
        while have < width:
            if at >= n or made >= most:
                return b"".join(out)
            store = (store << 8 | data[at]) & 0xFFFFFF
            have += 8
            at += 1
        have -= width
        code = store >> have & ((1 << width) - 1)
        if code == 257:
            return b"".join(out)
        if code == 256:
            words, width, old = list(base), 9, None
            continue
        if old is None:
            if code > 255:
                raise BadTiff("LZW: no root code after a clear")
            word = words[code]
        else:
            if code < len(words):
                word = words[code]
            elif code == len(words):
                word = old + old[:1]
            else:
                raise BadTiff("LZW: code beyond the table")
            words.append(old + word[:1])
            if len(words) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(word)
        made += len(word)
        old = word


def lzw_encode(data: bytes) -> bytes:
    out = bytearray()
    store, have, width = 256, 9, 9
    table: dict[tuple[int, int], int] = {}
    following, prefix = 258, -1
    for c in data:
        if prefix < 0:
            prefix = c
            continue
        if (longer := table.get((prefix, c))) is not None:
            prefix = longer
            continue
        store = store << width | prefix
        have += width
        table[prefix, c] = following
        following += 1
        if following == 4094:
            store = store << width | 256
            have += width
            table.clear()
            following, width = 258, 9
        elif following >= 1 << width:
            width += 1
        prefix = c
        while have >= 8:
            have -= 8
            out.append(store >> have & 255)
        store &= (1 << have) - 1
    if prefix >= 0:
        store = store << width | prefix
        have += width
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    store = store << width | 257
    have += width
    pad = -have % 8
    store <<= pad
    have += pad
    out += (store & ((1 << have) - 1)).to_bytes(have // 8, "big")
    return bytes(out)


def _unpack(data: bytes, compression: int, most: int) -> bytes:
    """The first `most` bytes of a strip or tile; never many more are made, whatever the data says."""
    if compression == NONE:
        return data
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if compression == PACKBITS:
        return packbits_decode(data, most)
    raise BadTiff(f"compression {compression}")


def _pack(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode, DEFLATE: lambda x: zlib.compress(x, 1)}[compression](data)


# --- reading ------------------------------------------------------------------------------------------------


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    if at + 2 > len(data):
        raise BadTiff("directory beyond the end")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise BadTiff("directory beyond the end")
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in _FORMATS:
            continue
        size = _SIZES[kind] * count
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        if place + size > len(data):
            raise BadTiff("values beyond the end")
        tags[tag] = struct.unpack_from(f"{order}{count}{_FORMATS[kind]}", data, place)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def read_pages(data: bytes, most_samples: int = MOST_SAMPLES) -> Iterator[Page]:
    """The pages of a TIFF file, in the order of its chain of directories; BadTiff for what isn't one.

    A page that states more than most_samples samples is refused before memory is taken for it.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise BadTiff("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    if not at:
        raise BadTiff("no directory")
    seen: set[int] = set()
    while at:
        if at in seen:
            raise BadTiff("directories form a loop")
        seen.add(at)
        tags, following = _directory(data, at, order)
        yield _page(data, tags, len(seen) - 1, most_samples)
        at = following


def _page(data: bytes, tags: dict[int, tuple], index: int, most_samples: int) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    if not width or not height or width < 0 or height < 0 or samples < 1 or any(b != 8 for b in tags.get(BITS, (1,))):
        raise BadTiff("only 8-bit samples are read")
    if width * height * samples > most_samples:
        raise BadTiff("a page of too many samples")
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if predictor not in (1, 2):
        raise BadTiff(f"predictor {predictor}")
    tiled = TILE_AT in tags
    part_w, part_h = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    starts, sizes = (tags.get(TILE_AT, ()), tags.get(TILE_BYTES, ())) if tiled else (tags.get(STRIP_AT, ()), tags.get(STRIP_BYTES, ()))
    if part_w < 1 or part_h < 1 or part_w * part_h * samples > most_samples:
        raise BadTiff("strips or tiles of no or too many samples")
    across, down = -(-width // part_w), -(-height // part_h)
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    if min(len(starts), len(sizes)) < planes * across * down:
        raise BadTiff("too few strips or tiles")
    pixels = np.zeros((height, width, samples), np.uint8)
    for k in range(planes * across * down):
        plane, place = divmod(k, across * down)
        y, x = (v * s for v, s in zip(divmod(place, across), (part_h, part_w), strict=True))
        rows = part_h if tiled else min(part_h, height - y)
        raw = _unpack(data[starts[k] : starts[k] + sizes[k]], compression, rows * part_w * deep)
        if len(raw) < rows * part_w * deep:
            raise BadTiff("a strip or tile is too short")
        block = np.frombuffer(raw, np.uint8, rows * part_w * deep).reshape(rows, part_w, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        keep_h, keep_w = min(rows, height - y), min(part_w, width - x)
        target = pixels[y : y + keep_h, x : x + keep_w]
        if planar == 2:
            target[:, :, plane] = block[:keep_h, :keep_w, 0]
        else:
            target[...] = block[:keep_h, :keep_w]
    return Page(index, width, height, samples, compression, predictor, tiled, pixels)


# --- writing ------------------------------------------------------------------------------------------------


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 1024, order: str = "<") -> bytes:
    """Grey 8-bit pages (height, width) as one TIFF file; tile: side of square tiles, 0 for strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for pixels in pages:
        height, width = pixels.shape
        step_h, step_w = (tile, tile) if tile else (rows_per_strip, width)
        starts, sizes = [], []
        for y in range(0, height, step_h):
            for x in range(0, width, step_w):
                block = pixels[y : y + step_h, x : x + step_w]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1), np.uint8))
                packed = _pack(np.ascontiguousarray(block).tobytes(), compression)
                starts.append(len(out))
                sizes.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        tags: list[tuple[int, int, list[int]]] = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_AT, 4, starts), (TILE_BYTES, 4, sizes)] if tile else [(ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_AT, 4, starts), (STRIP_BYTES, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            packed = struct.pack(f"{order}{len(values)}{_FORMATS[kind]}", *values)
            if len(packed) > 4:
                place = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


# --- columns ------------------------------------------------------------------------------------------------


def tiff_pages(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, page, width, height, samples, compression, predictor, tiled, pixels, error): one row per page.

    A null, empty or broken file gives one row with a null page and the reason in error; pages before a fault are kept,
    and no file ends the job. Repeated ids are separate files. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "page", "width", "height", "samples", "compression", "predictor", "tiled", "pixels", "error"]
        kinds = [pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.binary(), pa.string()]
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    for p in read_pages(value.as_py() or b""):
                        rows.append((key, p.index, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None))
                except (ValueError, zlib.error, struct.error, LookupError, TypeError, ArithmeticError, MemoryError) as e:
                    rows.append((key, *[None] * 8, f"{type(e).__name__}: {e}"))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(10)], names=names)

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, "id long, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string")


SIDE, PAGE_ROWS = 64, 4096


def payload_of(text: bytes) -> bytes:
    """The bytes, padded with 0 to a positive multiple of 64."""
    return text.ljust(max(SIDE, -(-len(text) // SIDE) * SIDE), b"\0")


def stored_form(payload: bytes) -> bytes:
    """A payload as TIFF: rows of 64 samples, up to 4096 rows a page. The layout follows from the bytes alone.

    One payload in five each is LZW, PackBits, uncompressed, deflated in strips and deflated in tiles.
    """
    pick = zlib.crc32(payload)
    kind = (LZW, PACKBITS, NONE, DEFLATE, DEFLATE)[pick % 5]
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    pages = [pixels[k : k + PAGE_ROWS] for k in range(0, len(pixels), PAGE_ROWS)]
    return write_pages(pages, kind, 2 if pick >> 5 & 1 and kind in (LZW, DEFLATE) else 1, 64 if pick % 5 == 4 else 0, 512, "<" if pick >> 6 & 1 else ">")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as TIFF and read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (pages, layout, mean sample and number of distinct samples of what was read).

    Null texts are empty: 64 zero bytes. Equal texts give equal values; repeated ids are separate rows. Very long texts
    are stored whole, page after page. An empty table gives no rows. Columns other than the two are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_py() or b""
                media = stored_form(payload_of(raw))
                pages = list(read_pages(media))
                back = b"".join(p.pixels.tobytes() for p in pages)
                counts = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
                mean = int(counts @ np.arange(256)) / len(back)
                first = pages[0]
                feature = f"pages={len(pages)};compression={first.compression};predictor={first.predictor};tiled={int(first.tiled)};mean={mean:.4f};distinct={int((counts > 0).sum())}"
                rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
