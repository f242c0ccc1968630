"""Formats that Spark does not read itself: CSV members of tar.gz archives, Stata files, workbooks.

None of these can be split, so one task reads one file; its bytes must fit a task (Spark's binary reader takes files
under 2 GB). Values come as text, as from CSV: what a column means is decided later.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CHUNK = 100_000


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _schema(columns: list[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def _texts(rows: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """The named columns, headers stripped and lower-cased first; one that a file lacks is null."""
    rows = rows.set_axis([str(c).strip().lower() for c in rows.columns], axis=1).reindex(columns=columns)
    return rows.astype(object).where(rows.notna(), None).map(lambda v: None if v is None or v == "" else str(v))


def members(spark: SparkSession, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """CSV members (gzip inside, too) whose name holds the pattern, streamed out of archives without unpacking them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as archive:
                    for member in archive:
                        if member.isfile() and re.search(pattern, member.name):
                            packed = "gzip" if member.name.endswith(".gz") else None
                            # A member of a stream cannot seek, which readers want; it is read ahead once.
                            body = io.BytesIO(archive.extractfile(member).read())
                            for rows in pd.read_csv(body, dtype=str, chunksize=CHUNK, compression=packed, keep_default_na=False):
                                yield _texts(rows, columns)

    return _binary(spark, path).mapInPandas(run, _schema(columns))


def stata(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Stata files, with codes as they are stored, not their labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                with pd.read_stata(io.BytesIO(content), chunksize=CHUNK, convert_categoricals=False) as parts:
                    for rows in parts:
                        yield _texts(rows, columns)

    return _binary(spark, path).mapInPandas(run, _schema(columns))


def _column(reference: str) -> int:
    at = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        at = 26 * at + ord(letter) - 64
    return at - 1


def sheet_rows(content: bytes, sheet: int = 1) -> list[list[str | None]]:
    """Rows of a workbook's sheet as text; blank cells are None. A sheet has at most 1,048,576 rows."""
    local = lambda node: node.tag.rpartition("}")[2]
    text = lambda node: "".join(t.text or "" for t in node.iter() if local(t) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if local(s) == "si"]
        out = []
        for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter():
            if local(row) != "row":
                continue
            cells: dict[int, str | None] = {}
            for cell in row:
                kind = cell.get("t")
                value = text(cell) if kind == "inlineStr" else next((v.text for v in cell if local(v) == "v"), None)
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                cells[_column(cell.get("r")) if cell.get("r") else len(cells)] = value or None
            out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return out


def workbook(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A sheet's table: the first row names the columns. Read on the driver, as a sheet's size is bounded."""
    head, *rows = sheet_rows(bytes(_binary(spark, path).first().content), sheet)
    names = [(n or f"column{k}").strip().lower() for k, n in enumerate(head)]
    return spark.createDataFrame([tuple([*r, *[None] * len(names)][: len(names)]) for r in rows], _schema(names))
