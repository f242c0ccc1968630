"""Boosting, its bundles and attributions, the seam and the instrument on small inputs."""

import numpy as np
import pytest

from ledgertide.operators import boosting, drivers, seam


def _data(n=600):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (n, 3))
    x[::17, 2] = np.nan
    return x, np.where(x[:, 0] > 0.2, 2.0, -1.0) + rng.normal(0, 0.1, n)


def test_boosting_beats_the_constant_quantile_and_covers():
    x, y = _data()
    for tau in (0.1, 0.5, 0.9):
        model = boosting.fit_trees(x[:400], y[:400], tau, (x[400:500], y[400:500]))
        q = model.predict(x[500:])
        constant = np.full(100, np.quantile(y[:400], tau))
        assert boosting.pinball(y[500:], q, tau).mean() < 0.5 * boosting.pinball(y[500:], constant, tau).mean()
        assert abs((y[500:] <= q).mean() - tau) < 0.15


def test_attributions_sum_to_the_prediction_and_name_the_feature():
    x, y = _data()
    model = boosting.fit_trees(x, y, 0.5, rounds=30)
    parts = model.attributed(x)
    by_hand = np.full(len(x), model.start)
    codes = model.codes(x)
    for tree in model.trees:
        for i in range(len(x)):
            node = tree[0]
            while node[0] >= 0:
                node = tree[node[2] if codes[i, node[0]] <= node[1] else node[3]]
            by_hand[i] += node[4]
    assert np.allclose(parts.sum(1), by_hand)
    assert np.abs(parts[:, 1:]).mean(0).argmax() == 0


def test_forecasts_do_not_cross():
    x, y = _data()
    month = np.repeat(np.arange(60), 10)
    models, part = boosting.fit_suite(x, y, np.zeros(len(y)), month, 48)
    q = boosting.predicted(models, x[part["validate"]], np.zeros(part["validate"].sum()))
    assert part["validate"].sum() == 120 and (np.diff(q, axis=1) >= 0).all()


def test_a_bundle_returns_as_it_was_saved(spark, tmp_path):
    x, y = _data(200)
    model = boosting.fit_trees(x, y, 0.5, rounds=5)
    boosting.save_bundle(spark, f"file://{tmp_path}/bundle", [model], ["a", "b", "c"], {"horizon": 12})
    models, features, settings = boosting.load_bundle(spark, f"file://{tmp_path}/bundle")
    assert (models[0].predict(x) == model.predict(x)).all() and features == ["a", "b", "c"] and settings == {"horizon": 12}


def _flat(spark, rows):
    names = ["district", "m", "instituted", "disposed", *seam.BUCKETS]
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))


def test_the_seam_meets_the_snapshot_where_nothing_is_missing(spark):
    records = _flat(spark, [(1, m, 5, 5, 60, 0, 0, 0, 0, 0, 0) for m in range(100, 111)] + [(2, 105, 1, 1, 1, 0, 0, 0, 0, 0, 0)])
    snapshots = _flat(spark, [(1, m, 5, 5, 60, 0, 0, 0, 0, 0, 0) for m in range(112, 130)])
    out = {r.m: r for r in seam.harmonise(records, snapshots, 100, 110, 129, 0.02).collect()}
    assert sorted(out) == list(range(100, 130)) and {r.district for r in out.values()} == {1}
    assert out[105].coverage == pytest.approx(1.0) and out[105].pending == pytest.approx(60.0)
    assert out[111].pending is None and out[112].pending == 60.0


def test_legacy_grows_going_back_and_leaves_through_disposals(spark):
    records = _flat(spark, [(1, m, 0, 0, 10, 0, 0, 0, 0, 0, 0) for m in (109, 110)])
    snapshots = _flat(spark, [(1, 111, 0, 0, 10, 0, 0, 0, 0, 0, 40)])
    out = {r.m: r for r in seam.harmonise(records, snapshots, 100, 110, 111, 0.1).collect()}
    legacy = lambda m: out[m].pending - 10 * out[m].coverage
    assert legacy(109) / legacy(110) == pytest.approx(np.exp(0.1))
    assert out[110].disposed == pytest.approx(legacy(109) - legacy(110)) and out[110].p6 == pytest.approx(40 * np.exp(0.1))


def test_empty_inputs_give_empty_results(spark):
    none = _flat(spark, [])
    assert seam.harmonise(none, none, 100, 110, 120, 0.02).count() == 0
    assert seam.scrape_summary(spark.createDataFrame([], "district int, t int, stage string, gap double"), ["a"], 1).count() == 0


def test_scrape_summary_ignores_a_thin_tail(spark):
    rows = [(1, 10, "a", 4.0)] * 9 + [(1, 10, "b", 9.0), (1, 10, None, -1.0), (1, 99, "a", 1.0)]
    one = seam.scrape_summary(spark.createDataFrame(rows, "district int, t int, stage string, gap double"), ["a", "b"], 5).first()
    assert one.scraped == 10 and one.share_a == pytest.approx(0.9) and one.gap == pytest.approx(np.exp((9 * np.log(4) + np.log(9)) / 10))


def test_a_steady_bench_has_no_shift(spark):
    posts = spark.createDataFrame([(0, d, c, c % 3, 23940, 24023) for d in (1, 2) for c in range(4)], "state int, district int, court int, cadre int, s int, e int")
    seats = drivers.seats_by_cadre(posts, 2)
    z = [r.z for r in drivers.shift_share(seats, 2, 1997).collect()]
    assert sum(v is None for v in z) == 22 and all(abs(v) < 1e-12 for v in z if v is not None)
    assert {r.working for r in drivers.recorded_each_december(seats).collect()} == {8}
