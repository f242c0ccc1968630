"""Smaller operators against values worked out by hand or in numpy."""

import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgertide.functions.taxonomy import classify_labels
from ledgertide.functions.text import indian_digits, normal_name, slug
from ledgertide.operators import estimation as est
from ledgertide.operators import events, matching, panel
from ledgertide.sources import files
from ledgertide.streaming.cube_stream import streaming_cube


def test_text(spark):
    df = spark.createDataFrame([("Saran at Chapra", 12345678), ("Unakoti  Tripura", 123), ("!!", 1234)], "s string, n long")
    got = df.select(slug(F.col("s")), indian_digits(F.col("n")), normal_name(F.col("s"))).collect()
    assert [r[0] for r in got] == ["saran-at-chapra", "unakoti-tripura", "x"]
    assert [r[1] for r in got] == ["1,23,45,678", "123", "1,234"]


def test_first_rule_wins_and_nulls_are_other(spark):
    rows = spark.createDataFrame([("Bail Appeal",), ("appeal",), (None,)], "s string")
    out = classify_labels(rows, "s", (("bail", "bail"), ("appeal", "appeal")), "other", "k").collect()
    assert sorted((r.s or "", r.k) for r in out) == [("", "other"), ("Bail Appeal", "bail"), ("appeal", "appeal")]


def test_leave_one_out(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (4, "b", 5.0)], "i int, g string, x double")
    assert {r.i: r.v for r in df.select("i", panel.leave_one_out("x", ["g"]).alias("v")).collect()} == {1: 3.0, 2: 1.0, 3: None, 4: None}


def test_bowley_skew(spark):
    df = spark.createDataFrame([(10, 10, 10, 10)], "a int, b int, c int, d int")
    out = df.select(panel.bowley_skew([F.col(c) for c in "abcd"], [0, 1, 3, 5, 10]).alias("s")).first().s
    q1, q2, q3 = np.interp([10, 20, 30], [0, 10, 20, 30, 40], [0, 1, 3, 5, 10])
    assert out == pytest.approx((q3 + q1 - 2 * q2) / (q3 - q1))


def test_ols(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 2))
    y = 1 + x @ [2.0, -3.0]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    assert est.ols(df, "y", ["a", "b"]) == pytest.approx([1, 2, -3])


def test_quantile_line_splits_the_data():
    rng = np.random.default_rng(1)
    x = np.c_[np.ones(400), rng.standard_normal(400)]
    y = x @ [1.0, 2.0] + rng.standard_normal(400)
    for tau in (0.1, 0.5, 0.9):
        below = (y < x @ est.quantile_line(x, y, tau)).mean()
        assert abs(below - tau) < 0.02


def test_conformal_shift():
    r = np.arange(1.0, 20.0)
    assert est.calibration_shift(r, 0.9) == 19.0 and est.calibration_shift(r, 0.1) == 2.0 and est.calibration_shift(r[:0], 0.5) == 0.0


def test_bootstrap_and_ranks(spark):
    lo, hi = est.skill_bounds(np.array([1.0, 2, 3, 4]), np.array([2.0, 4, 6, 8]), 500, 0)
    assert lo == hi == pytest.approx(0.5)
    units = spark.createDataFrame([(7, 0.1, 0.0), (8, 0.5, 0.0), (9, 0.9, 0.0)], "u int, x double, e double")
    assert sorted(map(tuple, est.rank_bounds(units, "u", "x", "e", 50).collect())) == [(7, 1.0, 1.0), (8, 2.0, 2.0), (9, 3.0, 3.0)]
    wide = {r.u: (r.rank_lo, r.rank_hi) for r in est.rank_bounds(units.withColumn("e", F.lit(100.0)), "u", "x", "e", 500).collect()}
    assert set(wide.values()) == {(1.0, 3.0)}


def test_remaining_months_of_a_steady_hazard(spark):
    n = np.round(1e6 * 0.9 ** np.arange(31) * 0.1).astype(int)
    rows = [(k, int(x), int(x)) for k, x in enumerate(n)] + [(31, int(1e6 * 0.9**31), 0)]
    out = est.remaining_months(spark.createDataFrame(rows, "dur int, n long, events long"), 30).toPandas()
    assert len(out) == 31 and out["tail"].iloc[0] == pytest.approx(-np.log(0.9), rel=1e-3)
    assert out.life[out.age == 0].iloc[0] == pytest.approx(sum(0.9 ** (k + 1) for k in range(31)) + 0.9**31 / -np.log(0.9), rel=1e-3)


def test_folds_do_not_reach_into_each_other(spark):
    months = list(range(100, 160)) + [155, 130]
    got = sorted(map(tuple, est.fold_parts(spark.createDataFrame([(m,) for m in months], "m int"), 12, 150, 6).collect()))
    assert {p: [m for q, m in got if q == p] for p, _ in got} == {"train": list(range(100, 120)), "stop": [132, 133, 134], "conformal": [135, 136, 137], "validate": list(range(150, 160))}
    masks = est.fold_masks(np.array(months), 12, 150, 6)
    assert {p: sorted(set(np.array(months)[k].tolist())) for p, k in masks.items()} == {p: sorted({m for q, m in got if q == p}) for p in masks}
    assert not est.fold_masks(np.array(months), 12, 90, 6)["train"].any()


def test_judges_needed(spark):
    rows = [(k, 4.0, 10.0, float(x)) for k, x in enumerate((0, 1, 50, 400, 1000, 1e9))]
    out = est.judges_needed(spark.createDataFrame(rows, "k int, b double, d double, x double"), "b", "d", "x", 0.6).collect()
    gain = lambda more: sum(10 * ((1 + more / 4 * (1 - np.exp((6 - t) / 6))) ** 0.6 - 1) for t in range(7, 37))
    assert [r.judges for r in sorted(out)] == [next((float(m) for m in range(81) if gain(m) >= x), float("inf")) for _, _, _, x in rows]


def test_files(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("state"), (F.col("id") % 7).alias("district"), F.col("id").alias("f"))
    files.write_by_state(df, f"{tmp_path}/cube", rows_per_file=10)
    back = spark.read.parquet(f"{tmp_path}/cube")
    assert files.content_lock(df, ["state", "district", "f"]) == files.content_lock(back.select(F.col("state").cast("long"), "district", "f"), ["state", "district", "f"])
    df.write.option("header", True).csv(f"{tmp_path}/x.csv")
    assert files.read_any(spark, f"{tmp_path}/x.csv").count() == 100
    assert files.kind_of([" State", "PENDING"], {"p": {"state", "pending"}}) == "p"
    with pytest.raises(ValueError):
        files.require(df, {"nothing": "int"}, {})
    assert files.require(df, {"f": "int"}, {"more": "double"}).first().more is None


def test_streaming_cube(spark, tmp_path):
    cases = spark.sql("SELECT 1 AS district, date'2000-01-05' AS filed, date'2000-03-01' AS decided UNION ALL SELECT 1, date'2000-01-20', date'2000-03-09' UNION ALL SELECT 1, date'2000-05-01', date'2000-03-09'")
    cases.write.parquet(f"{tmp_path}/in")
    stream = streaming_cube(spark.readStream.schema(cases.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("update").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT district, f, d, n FROM cells").collect()] == [(1, 24000, 24002, 2)]


def test_curve_drops_keep_gaps_and_lose_the_tail(spark):
    from pyspark.sql import functions as F

    from ledgertide.functions.text import drops

    rows = spark.createDataFrame([([0.9, None, 0.85, 0.85, None],), ([],), ([None, None],), (None,), ([None, 0.5],)], "c array<double>")
    assert [r.d for r in rows.select(drops(F.col("c")).alias("d")).collect()] == [[100, None, 50, 0], [], [], None, [None, 500]]


def test_event_totals_and_clustered_means(spark):
    rows = [("a", 1, 10, k, 0.5 if k >= 0 else 0.1, 4.0, 2) for k in range(-2, 4)] + [("b", 2, 10, k, -0.5, 2.0, 1) for k in range(-2, 4)]
    study = spark.createDataFrame(rows, "district string, court int, t0 int, k int, effect double, base_mean double, n_controls long")
    got = {r.district: (r.after, r.before, r.lost) for r in events.event_totals(study, 2).collect()}
    assert got["a"] == pytest.approx((0.5, 0.1, -4.0)) and got["b"] == pytest.approx((-0.5, -0.5, 2.0))
    (name, mean, low, high), _ = events.clustered_means(events.event_totals(study, 2), ["after", "lost"])
    assert (name, mean, low, high) == ("after", 0.0, -0.5, 0.5)
    assert events.clustered_means(events.event_totals(study.limit(0)), ["after"]) == []


def rows_and_most(df):
    """The rows, and the most that one step of the plan gave; it must be the first run, without adaptive plans."""

    def steps(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from steps(plan.children().apply(k))

    out = df.collect()
    rows = [p.metrics().get("numOutputRows") for p in steps(df._jdf.queryExecution().executedPlan())]
    return out, max(r.get().value() for r in rows if r.isDefined())


def test_event_study_is_that_of_all_pairs_without_laying_them_out(spark):
    first, last, post, rng = 0, 59, 8, np.random.default_rng(7)
    courts = [(1, c) for c in range(120)] + [(2, 500), (2, 501), (3, 600), (None, 700)]
    paths = {dc: rng.integers(0, 5, 60) for dc in courts if dc[1] != 3}
    paths[1, 4] = paths[1, 4] * (np.arange(60) > 40)  # often too few decisions before
    starts = {(d, c): [c % 18 + 18 * k for k in range(3)] for d, c in courts}
    starts[2, 501] = starts[1, 5] = []  # never a start of its own
    dates = {(d, c, s - k) for (d, c), ss in starts.items() for s in ss[1:] for k in (0, 9)} | {(1, 5, 30), (2, 501, 25)}
    want = {}
    for d, c, t in dates:
        if d is None or t - 12 < first or t + post > last or (d, c) not in paths or paths[d, c][t - 12 : t].mean() < 1:
            continue
        free = [p for (e, o), p in paths.items() if e == d and o != c and all(abs(s - t) > post for s in starts[e, o]) and p[t - 12 : t].mean() >= 1]
        for k in range(-6, post + 1) if free else ():
            want[d, c, t, k] = paths[d, c][t + k] / paths[d, c][t - 12 : t].mean() - np.mean([p[t + k] / p[t - 12 : t].mean() for p in free]), len(free)
    flow = spark.createDataFrame([(d, c, m, int(x)) for (d, c), p in paths.items() for m, x in enumerate(p) if x] + [(1, 3, None, 4), (1, 6, 99, 9)], "district int, court int, m int, x long")
    begun = spark.createDataFrame([(*dc, s) for dc, ss in starts.items() for s in ss], "district int, court int, s int")
    asked = spark.createDataFrame(sorted(dates, key=str), "district int, court int, t0 int")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out, most = rows_and_most(events.event_study(flow, asked, begun, first, last, post=post))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    got = {(r.district, r.court, r.t0, r.k): (r.effect, r.n_controls) for r in out}
    assert got.keys() == want.keys() and len({k[:3] for k in got}) > 200
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert any(all(abs(s - t) > post for s in starts[d, c]) for d, c, t, _ in want)  # some are no control of themselves only by the rule
    assert len(out) <= most <= 60 * len(courts)  # courts and months
    none = events.event_study(flow, asked, begun, first, 15, post=post)
    assert none.count() == 0  # no month has both spans


def test_placebo_events_are_moved(spark):
    df = spark.createDataFrame([(1, 2, 100, 3)], "district int, court int, t0 int, vacancy int")
    assert events.moved(df, 18).first().t0 == 82


def test_fuzzy_names(spark):
    left = spark.createDataFrame([(1, "bhojpur"), (1, "bhojpurr"), (1, "zzz"), (2, "bhojpur"), (1, None)], "state int, name string")
    right = spark.createDataFrame([(1, "bhojpur"), (1, "bhagalpur"), (1, "jehanabad"), (3, "x")], "state int, name string")
    got = {(r.state, r.name): (r.match, r.how, r.candidates) for r in matching.fuzzy_match(left, right, "state", "name").collect()}
    assert got == {
        (1, "bhojpur"): ("bhojpur", "exact", "bhojpur; bhagalpur"), (1, "bhojpurr"): ("bhojpur", "fuzzy", "bhojpur"),
        (1, "zzz"): (None, "none", ""), (2, "bhojpur"): (None, "none", ""),
    }
    words = ["bhojpur", "bhojpura", "bhagalpur", "arrah", "jehanabad", "bajpur"]
    assert [k for _, k in matching.closest("bhojpur", words)] == difflib.get_close_matches("bhojpur", words, 3, 0.6)


def test_breaks_leave_the_fitting_parts(spark):
    months = spark.createDataFrame([(m,) for m in range(100, 140)], "m int")
    got = {r.m: r.part for r in est.fold_parts(months, 2, 130, 6, ((110, 111), (124, 124), (135, 136))).collect()}
    assert all(m not in got for m in (*range(108, 112), *range(122, 125)))
    assert [m for m in sorted(got) if got[m] == "validate"] == list(range(130, 140))
    assert [m for m in sorted(got) if got[m] == "conformal"] == [125, 126, 127]
    assert [m for m in sorted(got) if got[m] == "stop"] == [119, 120, 121]
    assert [m for m in sorted(got) if got[m] == "train"] == [*range(100, 108), *range(112, 117)]
