"""Grading, elasticities, the simulated queue, and formats that Spark does not read itself, on small inputs."""

import gzip
import io
import tarfile
import zipfile

import numpy as np
import pandas as pd
import pytest

from ledgertide.operators import elasticity as ela
from ledgertide.operators import grading
from ledgertide.sources import archives
from ledgertide.sources.files import read_any
from ledgertide.sources.simulate import Setting, district_cases, simulate


def test_within_equals_dummies():
    rng = np.random.default_rng(1)
    unit, time = rng.integers(0, 7, 200), rng.integers(0, 11, 200)
    v = rng.normal(size=(200, 2))
    dummies = np.c_[unit[:, None] == np.arange(7), time[:, None] == np.arange(11)].astype(float)
    want = v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]
    assert np.allclose(ela.within(v, unit, time), want, atol=1e-7)


def test_clustered_errors_by_hand():
    x, y, c = np.array([[1.0], [2.0], [3.0], [4.0]]), np.array([1.0, 2.5, 2.5, 4.5]), np.array([0, 0, 1, 1])
    fit = ela.clustered_fit(y, x, x, c)
    b = (x[:, 0] @ y) / 30
    u = x[:, 0] * (y - b * x[:, 0])
    assert fit.slope[0] == pytest.approx(b) and fit.error[0] ** 2 == pytest.approx(2 * 3 / 3 * (u[:2].sum() ** 2 + u[2:].sum() ** 2) / 900)


def _bench_panel(strength, districts=60, months=40):
    rng = np.random.default_rng(3)
    d, m = (a.ravel() for a in np.meshgrid(np.arange(districts), np.arange(months), indexing="ij"))
    z, hidden, p = (rng.normal(size=len(d)) for _ in range(3))
    c = strength * z + hidden + rng.normal(0, 0.3, len(d))
    y = 0.6 * c + 0.2 * p - hidden + rng.normal(0, 0.1, len(d))
    return pd.DataFrame({"district": d, "state": d % 12, "m": m, "log_d": y, "log_c": c, "log_p": p, "load": 1.2, "z": z})


def test_the_instrument_finds_the_slope_that_least_squares_misses():
    out = ela.elasticities(_bench_panel(1.0), 0)
    assert out["identified"] == 1 and out["judges"] == pytest.approx(0.6, abs=0.06) and out["judges_ols"] < 0.45 and out["at_capacity"] == 1


def test_a_weak_instrument_is_not_identified():
    out = ela.elasticities(_bench_panel(0.0), 0)
    assert out["identified"] == 0 and np.isnan(out["judges"]) and out["first_stage_f"] < 10


def test_too_few_rows_give_defaults():
    out = ela.elasticities(_bench_panel(1.0).iloc[:2], 0)
    assert out["rows"] == 2 and out["gap"] == -1 and np.isnan(out["judges"])


def _truth(spark):
    rows = [(1001, 90, 100, 110, 50, 40, 60, 50), (1002, 10, 10, 20, 5, 5, 0, 0), (2001, 100, 100, 100, 10, 10, 10, 10), (2002, 0, 0, 5, 1, 1, 6, 1)]
    return spark.createDataFrame(rows, "district long, past long, p0 long, p1 long, a0 long, d0 long, a1 long, d1 long")


def _recorded(spark):
    return spark.createDataFrame([(1001, 100, 50), (1002, 3, 5), (2001, 90, 9)], "district long, pending long, filed long")


def test_district_losses_by_hand(spark):
    forecasts = spark.createDataFrame([(d, f, t, 0.9, q) for d in (1001, 1002, 2001, 2002) for f, q in (("drift", 0.0), ("model", 0.1)) for t in ("growth", "cr")], "district long, forecaster string, target string, tau double, q double")
    rows = grading.district_losses(forecasts, _truth(spark), _recorded(spark)).collect()
    seen = {(r.subset, r.district, r.forecaster, r.target): r.loss for r in rows}
    assert {d for s, d, _, t in seen if s == "clean" and t == "growth"} == {1001, 2001}
    assert {d for s, d, _, t in seen if s == "all_matched" and t == "growth"} == {1001, 1002, 2001}
    assert {d for s, d, _, t in seen if s == "all_matched" and t == "cr"} == {1001, 2001, 2002}
    y = np.log(1.1)
    assert seen["clean", 1001, "model", "growth"] == pytest.approx(0.1 * (0.1 - y)) and seen["clean", 1001, "drift", "growth"] == pytest.approx(0.9 * y)
    one = {(r.subset, r.forecaster, r.target): r for r in grading.scores(spark.createDataFrame(rows)).collect()}
    m, d = one["clean", "model", "growth"], one["clean", "drift", "growth"]
    assert d.skill is None and m.skill == pytest.approx(1 - m.pinball / d.pinball) and m.coverage == 1.0 and d.coverage == 0.5
    assert {r[1] for r in grading.skill_intervals(spark.createDataFrame(rows), draws=50)} == {"model"}


def test_states_outside_the_filters_are_not_graded(spark):
    truth = spark.createDataFrame([(1001, 100, 100, 120, 50, 40, 60, 40), (2001, 100, 100, 80, 10, 10, 10, 30), (3001, 100, 100, 100, 10, 10, 10, 10), (4001, 100, 100, 50, 10, 10, 10, 60)], _truth(spark).schema)
    recorded = spark.createDataFrame([(1001, 80, 1), (2001, 100, 1), (3001, 10, 1), (4001, 100, 1)], _recorded(spark).schema)
    states = grading.state_table(truth, recorded)
    assert {r.state for r in states.where("graded").collect()} == {1, 2}
    errors = grading.state_errors(states)
    assert {r.state for r in errors.where("subset = 'steady'").collect()} == {1}
    top = {(r.subset, r.target, r.forecaster): r for r in grading.state_scores(errors).collect()}["all_graded", "growth", "no_change"]
    assert top.mae == pytest.approx((np.log(1.2) - np.log(0.8)) / 2) and top.bias == pytest.approx(-(np.log(1.2) + np.log(0.8)) / 2)
    assert grading.national_growth(errors).first().actual == pytest.approx(0.0)


def test_grading_nothing_gives_nothing(spark):
    none = _truth(spark).limit(0)
    states = grading.state_table(none, _recorded(spark))
    assert states.count() == 0 and grading.state_scores(grading.state_errors(states)).count() == 0


def test_the_queue_keeps_its_rules(spark):
    s = Setting(months=60, filings=30.0, shocks=((40, 45, 0.0),))
    rows = district_cases(3, 7, s)
    done = rows[rows.d.notna()]
    assert (done.d >= done.ripe).all() and (rows.ripe >= rows.f).all() and len(done) > 100
    assert not done.d.between(40, 45).any()
    both = simulate(spark, 4, 7, s).where("district = 3").toPandas()
    assert both.f.tolist() == rows.f.tolist() and both.d.fillna(-1).astype(int).tolist() == rows.d.fillna(-1).astype(int).tolist()
    quick = done[done.kind == "bail"]
    assert (quick.d - quick.f).median() < (done[done.kind == "appeal"].d - done[done.kind == "appeal"].f).median()


def test_archive_members_are_streamed(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as out:
        for name, body in (("x/cases_2010.csv", b" ID ,Kind\n1,a\n2,\n"), ("x/cases_2011.csv.gz", gzip.compress(b"id,extra\n3,z\n")), ("x/judges.csv", b"id\n9\n")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            out.addfile(info, io.BytesIO(body))
    got = archives.members(spark, f"file://{tmp_path}/a.tar.gz", r"cases_\d+", ["id", "kind"]).collect()
    assert sorted(map(tuple, got)) == [("1", "a"), ("2", None), ("3", None)]


def test_stata_codes_and_missing_values(spark, tmp_path):
    pd.DataFrame({"Code": [1, 2, 3], "name": ["a", "", "c"], "x": [1.5, np.nan, 2.0]}).to_stata(tmp_path / "t.dta", write_index=False)
    got = archives.stata(spark, f"file://{tmp_path}/t.dta", ["code", "name", "x", "none"]).collect()
    assert sorted(map(tuple, got)) == [("1", "a", "1.5", None), ("2", None, None, None), ("3", "c", "2.0", None)]


def test_a_workbook_is_a_table(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as out:
        out.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t> State </t></si><si><r><t>on</t></r><r><t>e</t></r></si></sst>")
        rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>N</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c></row><row><c r="B3"><v>7</v></c></row>'
        out.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    got = read_any(spark, f"file://{tmp_path}/b.xlsx")
    assert got.columns == ["state", "n"] and sorted(map(tuple, got.collect()), key=str) == [("one", "5"), (None, "7")]
