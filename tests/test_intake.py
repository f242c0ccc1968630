"""Discovery, loaders and report sinks on small files."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from ledgertide.functions.calendar import month
from ledgertide.sources import intake, reports


def test_csv_copies_are_preferred(spark, tmp_path):
    for name in ("csv/cases_2010.csv", "dta/cases_2010.dta", "csv/judges_clean.csv.gz", "dta/disp_name_key.dta", "acts_cases.csv", "notes.txt", "Judge_Case_Key.dta", ".hidden.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {Path(r.path.removeprefix("file:")).relative_to(tmp_path).as_posix(): r.kind for r in intake.discover(spark, str(tmp_path)).collect()}
    assert got == {
        "csv/cases_2010.csv": "cases", "dta/cases_2010.dta": "skipped", "csv/judges_clean.csv.gz": "judges", "dta/disp_name_key.dta": "keys",
        "Judge_Case_Key.dta": "keys", "acts_cases.csv": "skipped", "notes.txt": "skipped",
    }


def test_archives_and_null_paths(spark):
    rows = spark.createDataFrame([("/x/Cases.tar.gz",), ("/x/cases.dta",), (None,)], "path string")
    assert {r.path: r.kind for r in intake.classified(rows).collect()} == {"/x/Cases.tar.gz": "cases", "/x/cases.dta": "cases", None: "skipped"}


def test_cube_parts(spark, tmp_path):
    for name, n in (("state=7_0", 1), ("state=7_1", 2), ("state=12", 3), ("other", 9)):
        spark.createDataFrame([(n,)], "n long").toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert sorted((r.part_of, r.n) for r in intake.cube_parts(spark, str(tmp_path)).select("part_of", "n").collect()) == [("12", 3), ("7", 1), ("7", 2)]


def test_missing_snapshot_is_empty(spark, tmp_path):
    none = intake.snapshot(spark, str(tmp_path / "none"))
    assert none.count() == 0 and none.columns == ["district_id", "t_ym", "stage", "n", "n_gap", "sum_log_gap"]
    spark.range(3).write.parquet(str(tmp_path / "some"))
    assert intake.snapshot(spark, str(tmp_path / "some")).count() == 3


def _postings(spark, dates):
    return spark.createDataFrame([(1, 2, None, s, e) for s, e in dates], "state_code int, dist_code int, judge_position string, start_date string, end_date string")


def test_postings_fall_back_by_column(spark):
    mixed = intake.load_postings(_postings(spark, [("05-01-2010", "2011-03-01"), ("31-12-2010", "2012-04-01"), ("bad", "2012-04-01"), (None, None)])).select("s", "e", "cadre", "district_id")
    assert sorted(map(tuple, mixed.collect())) == [(month(2010, 1), month(2011, 3), "other", 1002), (month(2010, 12), month(2012, 4), "other", 1002)]
    slashes = _postings(spark, [("05/01/2010", None)])
    assert intake.load_postings(slashes).first().s == month(2010, 1)
    assert intake.load_postings(slashes, intake.ISO).count() == 0
    assert intake.load_postings(_postings(spark, [("05-01-2004", "05-01-2006"), ("05-01-2006", None), ("05-01-2006", "05-02-2006")]), closed_from=month(2005, 1)).count() == 1
    assert intake.load_postings(_postings(spark, []).drop("judge_position")).count() == 0


def test_edge_weights(spark):
    edges = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 1, 1), (1, 1, 1, 3), (1, 1, 9, 9)], "src_state int, src_dist int, dst_state int, dst_dist int")
    known = spark.createDataFrame([(1001,), (1002,), (1003,)], "district long")
    got = {(r.district, r.neighbour): r.weight for r in intake.edge_weights(edges, known).collect()}
    assert got == {(1001, 1002): 0.5, (1001, 1003): 0.5, (1002, 1001): 1.0, (1003, 1001): 1.0}


def test_tables_are_rounded_half_even_and_byte_equal(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0.00025), (1, 0.00035), (3, None)], "k int, v double")
    for name in "ab":
        reports.write_table(rows.repartition(3), str(tmp_path / name), ["k"])
    a, b = (next((tmp_path / name).glob("*.csv.gz")).read_bytes() for name in "ab")
    assert a == b and a[4:8] == bytes(4)
    assert [(r.k, float(r.v) if r.v else None) for r in spark.read.option("header", True).csv(str(tmp_path / "a")).collect()] == [("1", 0.0004), ("2", 0.0002), ("3", None)]


def test_documents_nest_and_write(spark, tmp_path):
    rows = spark.createDataFrame([("A b", "x", "t2", 1.5), ("A b", "x", "t1", None), ("A b", "y", None, 2.0)], "state string, district string, t string, v double")
    docs = reports.documents(rows, ("state", "district"), "t", {"v": F.col("v")})
    got = {r.path: r.body for r in docs.collect()}
    assert got["a-b/x.json"] == '{"state":"A b","district":"x","kinds":{"t1":{"v":null},"t2":{"v":1.5}}}'
    assert json.loads(got["a-b/y.json"])["kinds"] == {}
    assert reports.index(docs).first().body == '["a-b/x.json","a-b/y.json"]'
    reports.write_documents(docs, str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).count() == 2


def test_report_of_an_empty_run(spark):
    none = spark.createDataFrame([], "district int, f int, d int, case_type string")
    assert json.loads(reports.run_report(none).first().report) == {"rows": 0, "no_filing": 0, "impossible": 0, "last_decision": 0, "districts": 0, "cells": 0, "filing_years": {}}
