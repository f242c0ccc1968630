"""Hand-computed survival cases, and what must hold for any counts."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgertide.functions.calendar import CALENDAR as C
from ledgertide.functions.calendar import month
from ledgertide.operators import panel, records, survival

CUBE = "state int, district int, f int, d int, case_type string, n int"


def cube(spark, rows):
    return spark.createDataFrame([(d // 1000, d, f, x, "suit", n) for d, f, x, n in rows], CUBE)


def curve(spark, rows, cut, entry=None):
    cuts = spark.createDataFrame([(d, c) for d, c in cut.items()], "district int, cut int")
    entries = entry and spark.createDataFrame(list(entry.items()), "district int, entry int")
    c = survival.curves(survival.spells(cube(spark, rows), cuts, entries), ["case_type"])
    return {r.m: r.s for r in c.collect()}, survival.table_of(c, ["case_type"]).first()


A = month(1995, 1)


def test_half_decided_after_a_year(spark):
    s, t = curve(spark, [(1001, A, A + 12, 50), (1001, A, None, 50)], {1001: A + 48})
    assert s[12] == 0.5 and s[36] == 0.5 and t.median_months == 12 and t.cases == 100


def test_delayed_entry(spark):
    rows = [(1001, A + 12, A + 24, 50), (1001, A + 12, None, 50), (1001, A - 12, A + 18, 25), (1001, A - 12, None, 25)]
    naive, _ = curve(spark, rows, {1001: A + 60})
    late, _ = curve(spark, rows, {1001: A + 60}, {1001: A + 12})
    assert naive[12] > 0.6
    assert abs(late[12] - 0.5) < 1e-12 and abs(late[30] - 0.375) < 1e-12


def test_curve_stops_when_few_are_followed(spark):
    s, t = curve(spark, [(1001, A, A + 6, 15), (1001, A, None, 15)], {1001: A + 40})
    assert (t.followed_months, t.median_months, t.pending_1y, t.p90_months) == (6, 6, None, None)
    assert t.curve.split(" ")[:4] == ["1.000", "1.000", "0.500"] or t.curve.startswith("1.000 1.000 0.500")


def test_never_complete_districts_are_left_out(spark):
    _, t = curve(spark, [(1001, A, A + 5, 30), (1002, A, A + 5, 70)], {1001: A + 40, 1002: A + 40}, {1001: A, 1002: None})
    assert t.cases == 30


def test_decided_only_takes_the_lower_median(spark):
    base = [(1001, m, m, 100) for m in range(month(2000, 1), month(2001, 1))]
    out = survival.decided_only(cube(spark, [*base, (1001, A, A + 6, 40)])).first()
    assert out.decided_cases == 1240 and out.median_months == 0


def test_collection_month_takes_the_earlier_of_district_and_state(spark):
    full = [(d, A, m, 100) for d in (1001, 1002) for m in range(month(2000, 1), month(2001, 7))]
    more = [(1002, A, m, 100) for m in range(month(2001, 7), month(2001, 11))]
    out = {r.district: r.cut for r in records.collection_month(cube(spark, full + more)).collect()}
    assert out == {1001: month(2001, 6), 1002: month(2001, 10)}


def test_completeness_needs_decisions(spark):
    months = range(C.first, C.complete_by + 1)
    rows = [(1001, m, m, 100) for m in months] + [(1002, m, None if m < month(2000, 1) else m, 100) for m in months]
    out = {r.district: r.entry for r in records.completeness_month(cube(spark, rows)).collect()}
    assert out[1001] == C.first and out[1002] >= month(1999, 9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.one_of(st.none(), st.integers(0, 60)), st.integers(1, 9)), min_size=1, max_size=25))
def test_stock_flow_identity(spark, rows):
    made = [(1001, C.first + f, None if d is None else C.first + f + d, n) for f, d, n in rows]
    c = cube(spark, made)
    out = sorted(panel.stock_flow(c).collect(), key=lambda r: r.m)
    stock = 0
    for r in out:
        stock += r.instituted - r.disposed
        assert r.pending == stock == sum(n for _, f, d, n in made if f <= r.m and (d is None or d > r.m))
    ages = {r.m: r.x for r in panel.age_stock(c).groupBy("m").agg(F.sum("pending").alias("x")).collect()}
    assert all(ages.get(r.m, 0) == r.pending for r in out)
