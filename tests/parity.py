"""Runs queries of the registry in Spark and their SQL in DuckDB and compares values; `python tests/parity.py [DIR] [NAME...]`."""

from __future__ import annotations

import os
import sys
import time
import traceback
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

DIR = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")


def session() -> SparkSession:
    settings = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g"}
    spark = SparkSession.builder.master("local[8]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if hasattr(x, "as_tuple") or isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 6) + 0.0
    return str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


def differences(spark: SparkSession, con, sf_dir: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    con.execute(sql)
    names = [c[0] for c in con.description]
    want = rows_of(names, con.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    odd = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(odd)} of {len(got)} rows differ, such as {odd[0]}" if odd else "" if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parents[1]))
    from ledgertide import registry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), database(sf_dir)
    queries, oracles = registry.queries(), registry.oracle_sql()
    bad = 0
    for name in names or queries:
        began = time.time()
        try:
            said = differences(spark, con, sf_dir, queries[name], oracles[name]) if name in oracles else f"(no SQL) {queries[name](spark, sf_dir).count()} rows"
        except Exception:  # noqa: BLE001
            said = traceback.format_exc()[-600:]
        if said and not said.startswith("(no SQL)"):
            bad += 1
            print(f"BAD {name} {time.time() - began:.1f} s: {said}", flush=True)
    print(f"{len(names or queries) - bad} fine, {bad} bad")
