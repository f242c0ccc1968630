"""Relational operators as SQL that Spark plans and another engine checks; `e` supplies what the dialects spell differently."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


class Spark:
    t = staticmethod(lambda name: "{" + name + "}")
    quantile = staticmethod(lambda x, p: f"percentile({x}, {p})")
    rows = staticmethod(lambda a, b: f"explode(sequence({a}, {b}))")
    found = staticmethod(lambda x, p: f"({x} rlike '{p}')")
    replace = staticmethod(lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}')")
    idiv = staticmethod(lambda a, b: f"(({a}) div ({b}))")
    date = staticmethod(lambda x: f"try_to_date({x}, 'yyyy-MM-dd')")
    seconds = staticmethod(lambda x: f"unix_micros(CAST({x} AS TIMESTAMP)) / 1e6")
    halfeven = staticmethod(lambda x, n: f"bround({x}, {n})")
    items = staticmethod(lambda x: f"nullif(array_join(array_sort(collect_list({x})), ','), '')")
    safe_div = staticmethod(lambda a, b: f"try_divide({a}, {b})")
    sequence = staticmethod(lambda a, b: f"sequence({a}, {b})")


class Other:
    t = staticmethod(lambda name: name)
    quantile = staticmethod(lambda x, p: f"quantile_cont({x}, {p})")
    rows = staticmethod(lambda a, b: f"unnest(range({a}, {b} + 1))")
    found = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    replace = staticmethod(lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}', 'g')")
    idiv = staticmethod(lambda a, b: f"(({a}) // ({b}))")
    date = staticmethod(lambda x: f"CAST(try_strptime({x}, '%Y-%m-%d') AS DATE)")
    seconds = staticmethod(lambda x: f"epoch_us({x}) / 1e6")
    halfeven = staticmethod(lambda x, n: f"round_even({x}, {n})")
    items = staticmethod(lambda x: f"string_agg({x}, ',' ORDER BY {x})")
    safe_div = staticmethod(lambda a, b: f"({a}) / nullif({b}, 0)")
    sequence = staticmethod(lambda a, b: f"range({a}, {b} + 1)")


def cases(e) -> str:
    return f"""WITH cases AS (
  SELECT n_regionkey AS state, n_regionkey * 1000 + n_nationkey AS district, n_nationkey AS nation, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS f,
    CASE WHEN l_linestatus = 'F' THEN CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) END AS d, p_type AS case_type, l_suppkey AS court
  FROM {e.t("lineitem")} JOIN {e.t("orders")} ON l_orderkey = o_orderkey JOIN {e.t("customer")} ON o_custkey = c_custkey
  JOIN {e.t("nation")} ON c_nationkey = n_nationkey JOIN {e.t("part")} ON l_partkey = p_partkey),
valid AS (SELECT * FROM cases WHERE f IS NOT NULL AND (d IS NULL OR d >= f)),
cube AS (SELECT state, district, f, d, case_type, count(*) AS n FROM valid GROUP BY state, district, f, d, case_type)"""


def official(e) -> str:
    """Pending and disposed by state and year; state is the nation's name."""
    return (
        cases(e)
        + f""", names AS (SELECT n_nationkey, n_name FROM {e.t("nation")}),
years AS (SELECT {e.rows(1995, 2001)} AS y), ny AS (SELECT n_nationkey, n_name AS unit, y FROM names CROSS JOIN years),
series AS (SELECT unit, CAST(ny.y AS INT) AS y,
    CAST(sum(CASE WHEN f < (ny.y + 1) * 12 AND (d IS NULL OR d >= (ny.y + 1) * 12) THEN n ELSE 0 END) AS DOUBLE) AS pending,
    CAST(sum(CASE WHEN d >= ny.y * 12 AND d < (ny.y + 1) * 12 THEN n ELSE 0 END) AS DOUBLE) AS disposed
  FROM ny JOIN (SELECT nation, f, d, count(*) AS n FROM valid GROUP BY nation, f, d) AS cells ON nation = n_nationkey GROUP BY unit, ny.y)"""
    )


Q: dict[str, Callable] = {}


def query(name: str):
    return lambda f: Q.setdefault(name, f)


def add(name: str, text: Callable) -> None:
    Q[name] = text


S = "CAST(sum({}) AS BIGINT)".format

add("S10_literal_relation", lambda e: "SELECT * FROM (VALUES ('A', 2014, 10.0), ('A', 2015, 12.5), ('B', 2014, 7.0), ('B', 2015, CAST(NULL AS DOUBLE))) AS t(state, year, value)")
add("P2_safe_date", lambda e: f"SELECT o_orderkey, {e.date('s')} AS filed FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN '' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS s FROM {e.t('orders')}) AS x")
add("P3_months", lambda e: f"SELECT o_orderkey, m, CAST({e.idiv('m', '12')} * 100 + m % 12 + 1 AS INT) AS ym FROM (SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS m FROM {e.t('orders')}) AS x")
add("P4_valid_rows", lambda e: cases(e) + " SELECT state, count(*) AS rows_in, count(CASE WHEN d IS NULL OR d >= f THEN 1 END) AS rows_valid, count(CASE WHEN d < f THEN 1 END) AS decided_before_filing FROM cases GROUP BY state")
add("P5_district_key", lambda e: f"SELECT n_name, coalesce(CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey END, -1) * 1000 + coalesce(n_nationkey, -1) AS district FROM {e.t('nation')}")
RULES = (("metal", "ring|nut|bolt"), ("warm", "^hot|warm"), ("cold", "cold|cool"), ("crim_x", "small|tiny"))
_taxonomy = lambda e, c: "CASE " + " ".join(f"WHEN {e.found(f'''lower(coalesce({c}, ''))''', p)} THEN '{k}'" for k, p in RULES) + " ELSE 'other' END"
add("P7_criminal_flag", lambda e: f"SELECT k, CAST(k LIKE 'crim\\_%' ESCAPE '\\' AS INT) AS crim, count(*) AS n FROM (SELECT {_taxonomy(e, 'p_name')} AS k FROM {e.t('part')}) AS x GROUP BY k".replace("k LIKE 'crim\\_%' ESCAPE '\\'", "substr(k, 1, 5) = 'crim_'"))
add("P8_code_decode", lambda e: f"WITH keys AS (SELECT p_partkey % 50 AS code, p_size % 3 AS year, min(p_brand) AS label FROM {e.t('part')} GROUP BY 1, 2), plain AS (SELECT code, min(label) AS label FROM keys GROUP BY code) SELECT p_partkey, coalesce(k.label, q.label) AS label FROM (SELECT p_partkey, p_partkey % 50 AS code, p_size % 4 AS year FROM {e.t('part')}) AS p LEFT JOIN keys k ON k.code = p.code AND k.year = p.year LEFT JOIN plain q ON q.code = p.code")
_gaps = lambda e: f"(SELECT user_id, event_type AS stage, CAST(user_id % 25 AS BIGINT) AS district, ({e.seconds('lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} - {e.seconds('ts')}) / 60 AS gap, ts FROM {e.t('events')}) AS g"
add("P9_gap_log", lambda e: f"SELECT stage, count(*) AS n, count(CASE WHEN gap > 0 THEN 1 END) AS n_gap, round(sum(CASE WHEN gap > 0 THEN ln(least(greatest(gap, 1), 730)) END), 4) AS sum_log_gap FROM {_gaps(e)} GROUP BY stage")
add("P10_normal_name", lambda e: "SELECT n_name, " + "trim(" + e.replace(e.replace(e.replace(e.replace("lower(concat(n_name, ' & Co District of ', n_name))", "&", " and "), "[^a-z]+", " "), "(^| )(district|the|of)( |$)", " "), " +", " ") + f") AS name FROM {e.t('nation')}")
add("P11_slug", lambda e: f"SELECT page_id, CASE WHEN s = '' THEN 'x' ELSE s END AS slug FROM (SELECT page_id, {e.replace(e.replace('lower(url)', '[^a-z0-9]+', '-'), '^-+|-+$', '')} AS s FROM {e.t('pages')}) AS x")
add("P13_clip", lambda e: f"SELECT c_custkey, round(least(greatest(c_acctbal, 0), 5000), 2) AS clipped, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS band FROM {e.t('customer')}")
add("P14_geometric_mean", lambda e: f"SELECT p_brand, round(exp(avg(ln(p_retailprice))), 6) AS gm FROM {e.t('part')} WHERE p_retailprice > 0 GROUP BY p_brand")
add("P15_safe_division", lambda e: f"SELECT p_brand, round({e.safe_div('sum(CASE WHEN p_size < 3 THEN p_retailprice END)', 'sum(CASE WHEN p_size < 3 THEN 1 ELSE 0 END) * 1.0')}, 6) AS mean_small FROM {e.t('part')} GROUP BY p_brand")
add("P17_label_checks", lambda e: f"SELECT count(CASE WHEN {e.found('p_name', '^hot ')} THEN 1 END) AS starts_hot, count(CASE WHEN {e.found('p_name', '^[a-z]+ [a-z]+$')} THEN 1 END) AS two_words, count(*) AS n FROM {e.t('part')}")
add("P18_ranges", lambda e: f"SELECT p_partkey, p_size FROM {e.t('part')} WHERE p_size BETWEEN 5 AND 10 AND p_brand IN (SELECT min(p_brand) FROM {e.t('part')} UNION ALL SELECT max(p_brand) FROM {e.t('part')}) AND p_type IS NOT NULL")
add("J1_inner_one_key", lambda e: f"SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM {e.t('orders')} JOIN {e.t('lineitem')} ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
add("J2_inner_two_keys", lambda e: f"WITH a AS (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS n FROM {e.t('lineitem')} WHERE l_returnflag = 'R' GROUP BY 1, 2), b AS (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS n FROM {e.t('lineitem')} WHERE l_returnflag = 'A' GROUP BY 1, 2) SELECT a.p, a.s, a.n AS n_first, b.n AS n_second FROM a JOIN b ON a.p = b.p AND a.s = b.s")
add("J3_left_enrich", lambda e: f"SELECT s_suppkey, s_name, n_name, r_name FROM {e.t('supplier')} LEFT JOIN {e.t('nation')} ON s_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN {e.t('region')} ON n_regionkey = r_regionkey")
add("J4_map_lookup", lambda e: f"SELECT c_mktsegment, v.code, count(*) AS n FROM {e.t('customer')} LEFT JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2)) AS v(seg, code) ON c_mktsegment = v.seg GROUP BY 1, 2")
add("J5_aligned_outer", lambda e: cases(e) + ", a AS (SELECT f AS m, count(*) AS filed FROM valid GROUP BY f), b AS (SELECT d AS m, count(*) AS decided FROM valid WHERE d IS NOT NULL GROUP BY d) SELECT coalesce(a.m, b.m) AS m, filed, decided FROM a FULL OUTER JOIN b ON a.m = b.m")
add("J6_semi", lambda e: f"SELECT c_custkey, c_name FROM {e.t('customer')} WHERE EXISTS (SELECT 1 FROM {e.t('orders')} WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
add("J7_anti", lambda e: f"SELECT o_orderkey FROM {e.t('orders')} WHERE NOT EXISTS (SELECT 1 FROM {e.t('lineitem')} WHERE l_orderkey = o_orderkey)")
add("J8_complete_grid", lambda e: cases(e) + f", u AS (SELECT DISTINCT district FROM cube), m AS (SELECT {e.rows(23940, 24023)} AS m), g AS (SELECT district, m FROM u CROSS JOIN m), x AS (SELECT district, f AS m, sum(n) AS n FROM cube GROUP BY 1, 2) SELECT g.district, CAST(g.m AS INT) AS m, CAST(coalesce(x.n, 0) AS BIGINT) AS n FROM g LEFT JOIN x ON g.district = x.district AND g.m = x.m")
add("J14_combine_first", lambda e: f"WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM {e.t('orders')} WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM {e.t('orders')} GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, round(coalesce(a.v, b.v), 2) AS v FROM a FULL OUTER JOIN b ON a.k = b.k")
add("J15_latest_version", lambda e: f"SELECT k, o_orderkey, o_orderpriority FROM (SELECT o_custkey AS k, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM {e.t('orders')}) AS x WHERE r = 1")
add("J16_latest_common", lambda e: f"WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM {e.t('orders')}), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM {e.t('lineitem')}), c AS (SELECT max(day) AS day FROM (SELECT day FROM a INTERSECT SELECT day FROM b) AS x) SELECT coalesce((SELECT day FROM c), (SELECT max(day) FROM a)) AS first_day, coalesce((SELECT day FROM c), (SELECT max(day) FROM b)) AS second_day")
add("J17_geography_crosswalk", lambda e: f"WITH links AS (SELECT n_nationkey AS unit, n_regionkey AS shape FROM {e.t('nation')} UNION SELECT n_nationkey, (n_regionkey + 1) % 5 FROM {e.t('nation')} WHERE n_nationkey % 4 = 0), results AS (SELECT s_nationkey AS unit, count(*) AS n FROM {e.t('supplier')} GROUP BY 1 HAVING count(*) > 2) SELECT shape, {e.items('CASE WHEN r.unit IS NOT NULL THEN CAST(l.unit AS STRING) END')} AS shown, {e.items('CASE WHEN r.unit IS NULL THEN CAST(l.unit AS STRING) END')} AS withheld, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM links l LEFT JOIN results r ON l.unit = r.unit GROUP BY shape")
add("A1_counts_and_sums", lambda e: cases(e) + f" SELECT district, case_type, {S('n')} AS n, count(*) AS cells FROM cube GROUP BY district, case_type")
add("A4_statistics", lambda e: f"SELECT l_suppkey, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, round({e.quantile('l_quantity', 0.5)}, 6) AS median, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, count(DISTINCT l_partkey) AS parts FROM {e.t('lineitem')} GROUP BY l_suppkey")
add("A5_mean_distinct", lambda e: cases(e) + " SELECT district, round(avg(courts), 6) AS courts FROM (SELECT district, f, count(DISTINCT court) AS courts FROM valid GROUP BY district, f) AS x GROUP BY district")
add("A6_weighted_mean", lambda e: f"SELECT l_returnflag, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) AS discount FROM {e.t('lineitem')} GROUP BY l_returnflag")
add("A7_weighted_median", lambda e: cases(e) + ", x AS (SELECT case_type, d - f AS m, sum(n) AS w FROM cube WHERE d IS NOT NULL GROUP BY 1, 2), y AS (SELECT case_type, m, sum(w) OVER (PARTITION BY case_type ORDER BY m) AS upto, sum(w) OVER (PARTITION BY case_type) AS every FROM x) SELECT case_type, min(m) AS median FROM y WHERE 2 * upto >= every GROUP BY case_type")
add("A8_quantiles", lambda e: f"SELECT p_brand, round({e.quantile('p_retailprice', 0.1)}, 6) AS q10, round({e.quantile('p_retailprice', 0.9)}, 6) AS q90, max(CASE WHEN r <= hi THEN p_retailprice END) AS q90_higher, max(CASE WHEN r <= lo THEN p_retailprice END) AS q90_lower FROM (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r, 1 + floor(0.9 * (count(*) OVER (PARTITION BY p_brand) - 1)) AS lo, 1 + ceil(0.9 * (count(*) OVER (PARTITION BY p_brand) - 1)) AS hi FROM {e.t('part')}) AS x GROUP BY p_brand")
add("A9_pivot", lambda e: cases(e) + " SELECT district, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN {e.idiv('f', '12')} = {y} THEN n END), 0) AS BIGINT) AS y{y}" for y in range(1995, 2002)) + " FROM cube GROUP BY district")
add("A10_conditional", lambda e: cases(e) + f" SELECT district, {S('CASE WHEN d IS NOT NULL AND d - f <= 12 THEN n ELSE 0 END')} AS within_year, {S('n')} AS n FROM cube GROUP BY district")
add("A11_shares", lambda e: cases(e) + " SELECT state, case_type, round(sum(n) * 1.0 / sum(sum(n)) OVER (PARTITION BY state), 6) AS of_state, round(sum(n) * 1.0 / sum(sum(n)) OVER (), 6) AS of_all FROM cube GROUP BY state, case_type")
add("A12_value_counts", lambda e: f"SELECT p_type, p_brand, count(*) AS n FROM {e.t('part')} GROUP BY p_type, p_brand")
add("A13_total_row", lambda e: cases(e) + f" SELECT CASE WHEN grouping(state) = 1 THEN 'All states' ELSE CAST(state AS STRING) END AS state, {S('n')} AS n FROM cube GROUP BY ROLLUP (state)")
add("A15_top_n", lambda e: cases(e) + f" SELECT state, case_type, n, round(n * 1.0 / every, 6) AS share FROM (SELECT state, case_type, n, sum(n) OVER (PARTITION BY state) AS every, row_number() OVER (PARTITION BY state ORDER BY n DESC, case_type) AS r FROM (SELECT state, case_type, {S('n')} AS n FROM cube GROUP BY 1, 2) AS x) AS y WHERE r <= 3")
add("A16_group_transform", lambda e: f"SELECT s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS apart FROM {e.t('supplier')}")
add("A17_leave_one_out", lambda e: cases(e) + ", x AS (SELECT state, district, CAST(sum(n) AS DOUBLE) AS n FROM cube GROUP BY 1, 2) SELECT district, round((sum(n) OVER (PARTITION BY state) - n) / nullif(count(n) OVER (PARTITION BY state) - 1, 0), 6) AS others FROM x")
add("A18_largest_column", lambda e: "SELECT c_custkey, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS largest FROM (SELECT c_custkey, c_custkey % 7 AS a, c_custkey % 5 AS b, c_custkey % 3 AS c FROM " + e.t("customer") + ") AS x")
add("A19_snapshot", lambda e: f"SELECT district, CAST(year(ts) * 12 + month(ts) - 1 AS INT) AS t, stage, count(*) AS n, count(CASE WHEN gap > 0 THEN 1 END) AS n_gap, round(sum(CASE WHEN gap > 0 THEN ln(least(greatest(gap, 1), 730)) END), 4) AS sum_log_gap FROM {_gaps(e)} GROUP BY 1, 2, 3")
add("W3_shift", lambda e: cases(e) + ", x AS (SELECT district, f AS m, sum(n) AS n FROM cube GROUP BY 1, 2) SELECT district, m, CAST(lag(n, 3) OVER (PARTITION BY district ORDER BY m) AS BIGINT) AS before, CAST(lead(n, 2) OVER (PARTITION BY district ORDER BY m) AS BIGINT) AS after FROM x")
add("W4_log_growth", lambda e: official(e) + " SELECT unit, y, round(ln(pending) - ln(lag(pending) OVER (PARTITION BY unit ORDER BY y)), 6) AS growth FROM series WHERE pending > 0")
add("W7_running", lambda e: cases(e) + f", x AS (SELECT district, f AS m, {S('n')} AS n FROM cube GROUP BY 1, 2) SELECT district, m, {S('n').replace('sum(n)', 'sum(n) OVER (PARTITION BY district ORDER BY m)')} AS upto, CAST(sum(n) OVER (PARTITION BY district ORDER BY m DESC) AS BIGINT) AS left_over FROM x")
add("W8_vacancy", lambda e: f"WITH p AS (SELECT s_nationkey AS district, s_suppkey AS court, CAST(23940 + s_suppkey % 18 + 18 * k AS INT) AS s, CAST(23940 + s_suppkey % 18 + 18 * k + 15 AS INT) AS e FROM (SELECT s_nationkey, s_suppkey, {e.rows(0, 4)} AS k FROM {e.t('supplier')}) AS x), q AS (SELECT district, court, s AS t0, lag(e) OVER (PARTITION BY district, court ORDER BY s, e) AS before FROM p) SELECT DISTINCT district, court, t0, greatest(t0 - before, 0) AS vacancy_months FROM q WHERE before IS NOT NULL")
add("W9_ranks", lambda e: "SELECT s_suppkey, CAST(rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS DOUBLE) AS average_rank, round((rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0) / count(*) OVER (), 6) AS pct, row_number() OVER (ORDER BY k, s_suppkey) AS first_rank FROM (SELECT s_suppkey, s_suppkey % 17 AS k FROM " + e.t("supplier") + ") AS x")
add("W10_quantile_buckets", lambda e: "WITH q AS (SELECT " + ", ".join(f"{e.quantile('p_retailprice', p)} AS q{k}" for k, p in enumerate((0.2, 0.4, 0.6, 0.8), 1)) + f" FROM {e.t('part')}) SELECT fifth, count(*) AS n, round(min(p_retailprice), 6) AS lo, round(max(p_retailprice), 6) AS hi FROM (SELECT p_retailprice, CASE WHEN p_retailprice <= q1 THEN 1 WHEN p_retailprice <= q2 THEN 2 WHEN p_retailprice <= q3 THEN 3 WHEN p_retailprice <= q4 THEN 4 ELSE 5 END AS fifth FROM {e.t('part')} CROSS JOIN q) AS x GROUP BY fifth")
add("O1_sort", lambda e: f"SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM {e.t('orders')} ORDER BY o_custkey, price DESC, o_orderkey")
add("O2_largest", lambda e: f"SELECT o_orderkey, round(o_totalprice, 2) AS price FROM {e.t('orders')} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("O4_best_method", lambda e: "SELECT grp, min_by(method, err) AS method FROM (SELECT p_brand AS grp, p_type AS method, avg(p_retailprice) + min(p_partkey) * 1e-9 AS err FROM " + e.t("part") + " GROUP BY 1, 2) AS x GROUP BY grp")
add("U1_union_all", lambda e: f"SELECT n_name AS name, 'nation' AS kind FROM {e.t('nation')} UNION ALL SELECT r_name, 'region' FROM {e.t('region')} UNION ALL SELECT r_name, 'region' FROM {e.t('region')}")
add("U2_union_flows", lambda e: cases(e) + f" SELECT court, m, {S('filed')} AS filed, {S('disposed')} AS disposed FROM (SELECT court, f AS m, 1 AS filed, 0 AS disposed FROM valid UNION ALL SELECT court, d, 0, 1 FROM valid WHERE d IS NOT NULL) AS x GROUP BY court, m")
add("U3_set_operations", lambda e: f"SELECT 'both' AS part, k FROM (SELECT c_nationkey AS k FROM {e.t('customer')} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {e.t('supplier')}) AS x UNION ALL SELECT 'first only', k FROM (SELECT n_nationkey AS k FROM {e.t('nation')} EXCEPT SELECT s_nationkey FROM {e.t('supplier')} WHERE s_acctbal > 0) AS y")
add("U4_override_rows", lambda e: f"WITH newer AS (SELECT o_orderkey AS k, 'new' AS origin, round(o_totalprice * 2, 2) AS v FROM {e.t('orders')} WHERE o_orderkey % 10 = 3), older AS (SELECT o_orderkey AS k, 'old' AS origin, round(o_totalprice, 2) AS v FROM {e.t('orders')}) SELECT * FROM newer UNION ALL SELECT * FROM older o WHERE NOT EXISTS (SELECT 1 FROM newer n WHERE n.k = o.k)")
add("K11_age_profile", lambda e: cases(e) + f" SELECT least({e.idiv('24022 - f', '12')}, 9) AS age_y, case_type, {S('n')} AS n FROM cube WHERE f <= 24022 AND (d IS NULL OR d > 24022) GROUP BY 1, 2")
add("K12_stage_table", lambda e: f"WITH g AS (SELECT stage, count(*) AS n, count(CASE WHEN gap > 0 THEN 1 END) AS k, sum(CASE WHEN gap > 0 THEN ln(least(greatest(gap, 1), 730)) END) AS s FROM {_gaps(e)} GROUP BY stage) SELECT stage, n, round(n * 1.0 / sum(n) OVER (), 6) AS share, round(exp(s / nullif(k, 0)), 6) AS gap FROM g")
add("K12_standardised_gap", lambda e: f"WITH g AS (SELECT district, stage, gap FROM {_gaps(e)}), nat AS (SELECT stage, count(*) * 1.0 / sum(count(*)) OVER () AS mix, avg(CASE WHEN gap > 0 THEN ln(least(greatest(gap, 1), 730)) END) AS lg FROM g GROUP BY stage), own AS (SELECT district, stage, avg(CASE WHEN gap > 0 THEN ln(least(greatest(gap, 1), 730)) END) AS lg FROM g GROUP BY 1, 2), u AS (SELECT DISTINCT district FROM g) SELECT u.district, round(exp(sum(nat.mix * coalesce(own.lg, nat.lg))), 6) AS gap FROM u CROSS JOIN nat LEFT JOIN own ON own.district = u.district AND own.stage = nat.stage GROUP BY u.district")
add("K16_cohort_reconstruction", lambda e: cases(e) + f", c AS (SELECT district, {e.idiv('f', '12')} AS y, {e.idiv('d', '12')} AS dy, n FROM cube) SELECT district, {S('CASE WHEN y <= 1999 AND (dy IS NULL OR dy > 1999) THEN n ELSE 0 END')} AS p0, {S('CASE WHEN y <= 2000 AND (dy IS NULL OR dy > 2000) THEN n ELSE 0 END')} AS p1, {S('CASE WHEN y <= 2000 AND dy = 2000 THEN n ELSE 0 END')} AS d1, {S('CASE WHEN y = 2000 THEN n ELSE 0 END')} AS a1 FROM c GROUP BY district")
add("K17_implied_filings", lambda e: official(e) + " SELECT unit, y, pending - lag(pending) OVER (PARTITION BY unit ORDER BY y) + disposed AS instituted FROM series")
add("K18_totals_check", lambda e: official(e) + ", t AS (SELECT y, sum(pending) AS total FROM series GROUP BY y) SELECT y, total, abs(total / nullif(total, 0) - 1) <= 0.002 AS ok FROM t")
add("M1_pinball", lambda e: f"WITH x AS (SELECT p_brand, p_retailprice AS y, avg(p_retailprice) OVER (PARTITION BY p_brand) AS q FROM {e.t('part')}) SELECT p_brand, " + ", ".join(f"round(avg(CASE WHEN y >= q THEN {t} * (y - q) ELSE {1 - t:.1f} * (q - y) END), 6) AS loss_{int(t * 100)}" for t in (0.1, 0.5, 0.9)) + ", round(avg(CASE WHEN y <= q THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM x GROUP BY p_brand")
add("M13_counterfactual", lambda e: official(e) + ", g AS (SELECT unit, y, pending, ln(pending) - ln(lag(pending) OVER (PARTITION BY unit ORDER BY y)) AS g FROM series WHERE pending > 0), r AS (SELECT unit, avg(CASE WHEN y BETWEEN 1996 AND 1999 THEN g END) AS g, max(CASE WHEN y = 1999 THEN pending END) AS p, max(CASE WHEN y = 2001 THEN pending END) AS actual FROM g GROUP BY unit) SELECT unit, round(p * exp(2 * g), 4) AS expected, round(actual - p * exp(2 * g), 4) AS excess FROM r")
add("M14_flow_shortfall", lambda e: official(e) + " SELECT unit, round(avg(CASE WHEN y BETWEEN 1997 AND 1999 THEN disposed END), 6) AS normal, max(CASE WHEN y = 2000 THEN disposed END) AS actual, round(avg(CASE WHEN y BETWEEN 1997 AND 1999 THEN disposed END) - max(CASE WHEN y = 2000 THEN disposed END), 6) AS shortfall FROM series GROUP BY unit")
METHODS = {"zero": "0.0", "own_last": "g0", "own_mean3": "m3", "national": "nat", "blend": "0.5 * m3 + 0.5 * nat"}
_backtest = lambda e: official(e) + f""", g AS (SELECT unit, y, pending, ln(pending) - ln(lag(pending) OVER (PARTITION BY unit ORDER BY y)) AS g FROM series WHERE pending > 0),
  w AS (SELECT unit, y, pending, g AS g0, avg(g) OVER (PARTITION BY unit ORDER BY y ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3, lead(g) OVER (PARTITION BY unit ORDER BY y) AS actual, lead(pending) OVER (PARTITION BY unit ORDER BY y) AS next FROM g),
  t AS (SELECT y, ln(sum(pending) / lag(sum(pending)) OVER (ORDER BY y)) AS nat FROM g GROUP BY y),
  b AS (SELECT w.*, nat FROM w JOIN t ON w.y = t.y WHERE w.y BETWEEN 1997 AND 2000),
  m AS ({" UNION ALL ".join(f"SELECT '{k}' AS method, y, unit, pending, actual, next, {x} AS pred FROM b" for k, x in METHODS.items())})"""  # noqa: E731
add("M15_method_backtest", lambda e: _backtest(e) + " SELECT method, CAST(y + 1 AS INT) AS target, round(avg(abs(pred - actual)), 6) AS mae, round(sum(abs(pred - actual) * pending) / sum(pending), 6) AS mae_weighted, round(ln(sum(pending * exp(pred)) / sum(pending)) - ln(sum(next) / sum(pending)), 6) AS national_error FROM m GROUP BY method, y")
add("M15_error_bands", lambda e: _backtest(e) + f" SELECT method, round({e.quantile('pred - actual', 0.1)}, 6) AS e10, round({e.quantile('pred - actual', 0.9)}, 6) AS e90 FROM m GROUP BY method")
add("M20_backlog_clock", lambda e: official(e) + ", x AS (SELECT unit, max(CASE WHEN y = 1998 THEN pending END) AS p0, max(CASE WHEN y = 2000 THEN pending END) AS p1 FROM series GROUP BY unit), z AS (SELECT *, (p1 - p0) / 2 AS dp FROM x) SELECT unit, p1 AS pending, round(dp / p0, 6) AS pct, CASE WHEN dp > 0 THEN 'growing' ELSE 'shrinking' END AS status, CASE WHEN dp < 0 THEN round(p1 / -dp, 6) ELSE CAST('Infinity' AS DOUBLE) END AS years_to_clear, " + f"{e.halfeven('greatest(dp + p1 / 10, 0)', 0)} AS extra_in_10y FROM z")
add("M16_locked_vs_actual", lambda e: official(e) + ", x AS (SELECT unit, max(CASE WHEN y = 1999 THEN pending END) AS o, max(CASE WHEN y = 2000 THEN pending END) AS a, max(CASE WHEN y = 1998 THEN pending END) AS b FROM series GROUP BY unit), s AS (SELECT o, ln(a / o) AS act, ln(o / b) AS pred FROM x WHERE b > 0) SELECT round(sum(abs(pred - act) * o) / sum(o), 6) AS model, round(sum(abs(act) * o) / sum(o), 6) AS no_change, 0.0e0 AS oracle_error FROM s")
add("Q6_coverage", lambda e: official(e) + ", r AS (SELECT n_name AS unit, " + f"{e.idiv('f', '12')}" + " AS y, count(*) * 0.9 AS recorded FROM valid JOIN names ON nation = n_nationkey GROUP BY 1, 2), i AS (SELECT unit, y, pending - lag(pending) OVER (PARTITION BY unit ORDER BY y) + disposed AS off FROM series), c AS (SELECT i.unit, i.y, CAST(recorded AS DOUBLE) AS recorded, off FROM i JOIN r ON i.unit = r.unit AND i.y = r.y WHERE off IS NOT NULL AND i.y BETWEEN 1997 AND 2000), v AS (SELECT unit, sum(recorded) / sum(off) AS cov, sum(off) AS off, max(CASE WHEN y = 2000 THEN recorded / off END) - max(CASE WHEN y = 1997 THEN recorded / off END) AS change FROM c GROUP BY unit) SELECT unit, round(cov, 6) AS coverage, CASE WHEN off < 100 THEN 'too small to classify' WHEN abs(change) <= 0.1 AND cov >= 0.5 THEN 'stable' WHEN change > 0.1 THEN 'growing' ELSE 'other' END AS grp FROM v")
add("Q7_fixed_mix_speedup", lambda e: cases(e) + f", g AS (SELECT {e.idiv('f', '12')} AS year, case_type, sum(n) AS n, sum(CASE WHEN d IS NOT NULL AND d - f <= 12 THEN n ELSE 0 END) AS d12 FROM cube WHERE f + 12 <= 24022 GROUP BY 1, 2), s AS (SELECT year, case_type, n * 1.0 / sum(n) OVER (PARTITION BY year) AS share FROM g), mix AS (SELECT case_type, avg(share) AS share FROM s GROUP BY case_type) SELECT CAST(year AS BIGINT) AS year, round(sum(d12) * 1.0 / sum(n), 6) AS all_records, round(sum(d12 * 1.0 / n * share), 6) AS fixed_mix FROM g JOIN mix ON g.case_type = mix.case_type GROUP BY year")
add("Q8_pending_activity", lambda e: f"WITH s AS (SELECT user_id % 5 AS state, max({e.seconds('ts')}) AS last FROM {e.t('events')} GROUP BY user_id, user_id % 5), z AS (SELECT max(last) AS fin FROM s), a AS (SELECT state, (fin - last) / 3600 AS age FROM s CROSS JOIN z) SELECT CASE WHEN grouping(state) = 1 THEN 'All states' ELSE CAST(state AS STRING) END AS state, count(*) AS pending, round(avg(CASE WHEN age > 12 THEN 1.0 ELSE 0.0 END), 6) AS over_12, round(avg(CASE WHEN age > 24 THEN 1.0 ELSE 0.0 END), 6) AS over_24 FROM a GROUP BY ROLLUP (state)")
add("Q9_age_bands", lambda e: cases(e) + f", b AS (SELECT CASE WHEN age < 12 THEN 'to 1' WHEN age < 36 THEN '1 to 3' ELSE 'over 3' END AS band, sum(n) AS n FROM (SELECT 24022 - f AS age, n FROM cube WHERE f <= 24022 AND (d IS NULL OR d > 24022)) AS x GROUP BY 1) SELECT b.band, {'CAST(n AS BIGINT)'} AS n, round(n * 1.0 / sum(n) OVER (), 6) AS share, v.published FROM b JOIN (VALUES ('to 1', 0.25e0), ('1 to 3', 0.35e0), ('over 3', 0.4e0)) AS v(band, published) ON b.band = v.band")
add("Q11_slowest_fifth", lambda e: cases(e) + f", r AS (SELECT state, district, sum(CASE WHEN d IS NULL THEN n ELSE 0 END) * 1.0 / sum(n) AS x FROM cube GROUP BY 1, 2), q AS (SELECT {e.quantile('CAST(x AS DOUBLE)', 0.8)} AS cut FROM r) SELECT state, count(CASE WHEN x >= cut THEN 1 END) AS slow, count(*) AS districts, round(count(CASE WHEN x >= cut THEN 1 END) * 1.0 / count(*), 6) AS share FROM r CROSS JOIN q GROUP BY state")
add("Q13_published_facts", lambda e: cases(e) + ", u AS (SELECT district, sum(n) AS n, sum(CASE WHEN d IS NOT NULL THEN n ELSE 0 END) AS decided FROM cube GROUP BY district) SELECT count(*) AS units, count(CASE WHEN decided * 2 < n THEN 1 END) AS withheld, count(CASE WHEN decided * 2 < n AND n >= 100 THEN 1 END) AS withheld_large, CASE WHEN sum(decided) * 2 > sum(n) THEN 'faster' ELSE 'slower' END AS verdict FROM u")


def text_of(name: str, e) -> str:
    """The SQL in one dialect; decimal literals become doubles, which both engines divide and average alike."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\de'])", r"\1e0", Q[name](e))


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query_of(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = text_of(name, Spark)
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
        # braces that stand for no table are regular expressions
        text = re.sub(r"\{(?!(?:%s)\})" % "|".join(TABLES), "{{", text)
        return spark.sql(text, **used)

    return query_of


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run(name) for name in Q}


def oracle_sql() -> dict[str, str]:
    return {name: text_of(name, Other) for name in Q}
