"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.operators import cleaning as cl
from duskline.plans.catalog import register
from duskline.plans.fixtures import view, with_views
from duskline.session import table

_H = "(epoch_us(end_ts) - epoch_us(start_ts)) / 3600000000.0"
_RULES = [("no_end", "end_ts is not null"), ("reversed", "end_ts >= start_ts"), ("short", "timestampdiff(hour, start_ts, end_ts) >= 240"), ("pending", "status <> 'P'")]
_CASE = "CASE WHEN end_ts IS NULL THEN {0} WHEN end_ts < start_ts THEN {1} WHEN epoch(end_ts - start_ts) < 864000 THEN {2} WHEN status = 'P' THEN {3} END"


@register("clean_intervals", with_views("dirty") + f" SELECT id, {_H} AS duration_h FROM dirty WHERE end_ts >= start_ts AND {_H} BETWEEN 24 AND 1200")
def clean_intervals(spark, sf):
    return cl.clean_intervals(view(spark, sf, "dirty"), 24, 1200).select("id", "duration_h")


@register("clean_instants", with_views("pts") + " SELECT user_id, event_type, count(*) AS n, count(CASE WHEN hour(t) >= 18 OR hour(t) <= 6 THEN 1 END) AS night FROM (SELECT * FROM pts WHERE t >= TIMESTAMP '2024-01-05' AND x_m BETWEEN 500 AND 4500 AND y_m BETWEEN 500 AND 4500 QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(t AS DATE) ORDER BY t, event_id) = 1) GROUP BY ALL")
def clean_instants(spark, sf):
    p = cl.in_bbox(view(spark, sf, "pts").dropna(subset=["t", "x_m", "y_m"]).where("t >= timestamp_ntz '2024-01-05'"), (500, 500, 4500, 4500))
    p = cl.dedup_by_key(p.withColumn("k", F.concat_ws("|", "user_id", "event_type", F.to_date("t"))), "k", [F.col("t"), F.col("event_id")])
    return p.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(cl.is_night("t")).alias("night"))


@register("dedup_by_key", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def dedup_by_key(spark, sf):
    return cl.dedup_by_key(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", [F.desc("value"), F.col("event_id")]).select("user_id", "event_id")


_MAP = {"click": "use", "view": "use", "purchase": "money"}


@register("map_category", "SELECT CASE event_type WHEN 'click' THEN 'use' WHEN 'view' THEN 'use' WHEN 'purchase' THEN 'money' END AS category, count(*) AS n FROM events GROUP BY 1")
def map_category(spark, sf):
    return cl.map_category(table(spark, sf, "events"), "event_type", _MAP).groupBy("category").agg(F.count("*").alias("n"))


@register("unmapped_codes", "SELECT event_type, event_type AS label, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') AND regexp_matches(event_type, '^[a-m]') GROUP BY ALL")
def unmapped_codes(spark, sf):
    return cl.unmapped_codes(table(spark, sf, "events").selectExpr("event_type", "event_type as label"), "event_type", "label", _MAP, "^[a-m]")


@register("is_night", "SELECT hour(ts) >= 20 OR hour(ts) <= 5 AS night, count(*) AS n FROM events GROUP BY 1")
def is_night(spark, sf):
    return table(spark, sf, "events").groupBy(cl.is_night("ts", 20, 5).alias("night")).agg(F.count("*").alias("n"))


@register("in_bbox", with_views("pts") + " SELECT event_id FROM pts WHERE x_m BETWEEN 1000 AND 2000 AND y_m BETWEEN 100 AND 3000")
def in_bbox(spark, sf):
    return cl.in_bbox(view(spark, sf, "pts"), (1000, 100, 2000, 3000)).select("event_id")


@register("normalise_label", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN trim(raw) <> '' AND lower(trim(raw)) <> 'unspecified' THEN trim(raw) END AS label FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN concat(' ', o_orderpriority, ' ') WHEN 1 THEN ' ' WHEN 2 THEN 'Unspecified' ELSE o_orderstatus END AS raw FROM orders)) GROUP BY 1")
def normalise_label(spark, sf):
    raw = F.expr("case o_orderkey % 4 when 0 then concat(' ', o_orderpriority, ' ') when 1 then ' ' when 2 then 'Unspecified' else o_orderstatus end")
    return table(spark, sf, "orders").groupBy(cl.normalise_label(raw).alias("label")).agg(F.count("*").alias("n"))


@register("standardise_labels_upper", "SELECT CASE WHEN trim(coalesce(m, '')) = '' THEN 'UNKNOWN' ELSE upper(trim(m)) END AS region, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) ELSE ' ' END AS m FROM customer) GROUP BY 1")
def standardise_labels_upper(spark, sf):
    m = F.expr("case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then lower(c_mktsegment) else ' ' end")
    return table(spark, sf, "customer").groupBy(cl.standardise_label(m).alias("region")).agg(F.count("*").alias("n"))


@register("classify_interval", with_views("dirty") + f" SELECT CASE WHEN start_ts IS NULL THEN 'unparseable' WHEN end_ts IS NULL THEN 'open' WHEN end_ts < start_ts THEN 'reversed' WHEN {_H} < 240 THEN 'short' ELSE 'closed' END AS class, count(*) AS n FROM dirty GROUP BY 1")
def classify_interval(spark, sf):
    return view(spark, sf, "dirty").groupBy(cl.classify_interval(240).alias("class")).agg(F.count("*").alias("n"))


@register("cap_interval", with_views("ivals") + " SELECT id, CAST(epoch(least(coalesce(end_ts, TIMESTAMP '2024-02-01'), start_ts + INTERVAL 48 HOUR) - start_ts) AS BIGINT) AS seconds, coalesce(end_ts, TIMESTAMP '2024-02-01') > start_ts + INTERVAL 48 HOUR AS capped FROM ivals")
def cap_interval(spark, sf):
    return cl.cap_interval(view(spark, sf, "ivals"), "2024-02-01 00:00:00", 48).selectExpr("id", "timestampdiff(second, start_ts, cap_ts) as seconds", "capped")


@register("impute_interval", with_views("dirty") + " SELECT id, CAST(epoch(CASE WHEN end_ts >= start_ts THEN end_ts ELSE start_ts + INTERVAL 72 HOUR END - (start_ts - INTERVAL 12 HOUR)) AS BIGINT) AS seconds, CASE WHEN end_ts >= start_ts THEN 'closure' WHEN end_ts IS NULL THEN 'imputed_open' ELSE 'imputed_reversed' END AS how FROM dirty")
def impute_interval(spark, sf):
    return cl.impute_interval(view(spark, sf, "dirty"), 12, 72).selectExpr("id", "timestampdiff(second, dark_start, dark_end) as seconds", "how")


@register("first_failing_rule", with_views("dirty") + " SELECT id, " + _CASE.format("'no_end'", "'reversed'", "'short'", "'pending'") + " AS reason_code, CAST(" + _CASE.format(1, 2, 3, 4) + " AS INT) AS reason_step FROM dirty")
def first_failing_rule(spark, sf):
    return cl.first_failing_rule(view(spark, sf, "dirty"), _RULES).select("id", "reason_code", "reason_step")


@register("attrition", with_views("dirty") + ", r AS (SELECT " + _CASE.format(1, 2, 3, 4) + " AS step FROM dirty) SELECT CAST(s.step AS INT) AS step, s.rule, count(r.step) AS dropped, CAST((SELECT count(*) FROM dirty) - sum(count(r.step)) OVER (ORDER BY s.step) AS BIGINT) AS remaining FROM (VALUES (1, 'no_end'), (2, 'reversed'), (3, 'short'), (4, 'pending')) s(step, rule) LEFT JOIN r ON r.step = s.step GROUP BY s.step, s.rule")
def attrition(spark, sf):
    return cl.attrition(view(spark, sf, "dirty"), _RULES)


@register("add_label", with_views("ivals") + " SELECT id, CAST(CASE WHEN end_ts >= start_ts THEN CASE WHEN end_ts > start_ts + INTERVAL 60 HOUR THEN 1 ELSE 0 END WHEN end_ts IS NULL AND start_ts + INTERVAL 60 HOUR <= (SELECT max(start_ts) FROM ivals) THEN 1 END AS INT) AS label FROM ivals")
def add_label(spark, sf):
    return cl.add_label(view(spark, sf, "ivals"), 60).select("id", "label")


@register("location_key", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN concat('at:', o_custkey, '|', o_orderkey) END, CASE WHEN o_orderstatus <> 'P' THEN concat('st:', o_orderstatus) END, concat('pr:', o_orderpriority)) AS location FROM orders")
def location_key(spark, sf):
    e = F.expr
    key = cl.location_key([("at", [e("cast(case when o_orderkey % 3 = 0 then o_custkey end as string)"), e("cast(o_orderkey as string)")]), ("st", [e("nullif(o_orderstatus, 'P')")]), ("pr", [F.col("o_orderpriority")])])
    return table(spark, sf, "orders").select("o_orderkey", key.alias("location"))


@register("coverage_guard", with_views("ivals", "pts") + " SELECT id FROM ivals WHERE start_ts - INTERVAL 3 DAY < (SELECT min(t) FROM pts) OR start_ts + INTERVAL 3 DAY > (SELECT max(t) FROM pts)")
def coverage_guard(spark, sf):
    w = view(spark, sf, "ivals").selectExpr("id", "start_ts - interval 3 days as w_start", "start_ts + interval 3 days as w_end")
    return cl.coverage_guard(w, view(spark, sf, "pts")).select("id")


@register("sparse_period_warning", "WITH n AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n FROM orders GROUP BY 1) SELECT strftime(period, '%Y-%m') AS period, n FROM n WHERE n < 0.95 * (SELECT median(n) FROM n)")
def sparse_period_warning(spark, sf):
    return cl.sparse_periods(table(spark, sf, "orders"), "o_orderdate", share=0.95).select(F.date_format("period", "yyyy-MM").alias("period"), "n")


@register("shift_dates", with_views("ivals") + " SELECT id, CAST(epoch(start_ts - INTERVAL 90 DAY) AS BIGINT) AS placebo, CAST(epoch(start_ts) AS BIGINT) AS original FROM ivals")
def shift_dates(spark, sf):
    e = "timestampdiff(second, timestamp_ntz '1970-01-01 00:00:00', {})"
    return view(spark, sf, "ivals").selectExpr("id", e.format("start_ts - interval 90 days") + " as placebo", e.format("start_ts") + " as original")


_PHI, _LAM = "radians(12.0 + id % 100 / 50.0)", "(radians(74.0 + id % 90 / 60.0) - radians(75.0))"
_E2 = 0.00669437999014


def _utm_sql() -> str:
    a, k0, e2 = 6378137.0, 0.9996, _E2
    ep = e2 / (1 - e2)
    n, t, c, u = f"({a} / sqrt(1 - {e2} * pow(sin(phi), 2)))", "pow(tan(phi), 2)", f"({ep} * pow(cos(phi), 2))", "(cos(phi) * lam)"
    m = f"({a} * ({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r} * phi - {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r} * sin(2 * phi) + {15 * e2**2 / 256 + 45 * e2**3 / 1024!r} * sin(4 * phi) - {35 * e2**3 / 3072!r} * sin(6 * phi)))"
    x = f"{k0} * {n} * ({u} + (1 - {t} + {c}) * pow({u}, 3) / 6 + (5 - 18 * {t} + pow({t}, 2) + 72 * {c} - 58 * {ep}) * pow({u}, 5) / 120) + 500000"
    y = f"{k0} * ({m} + {n} * tan(phi) * (pow({u}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * pow({c}, 2)) * pow({u}, 4) / 24 + (61 - 58 * {t} + pow({t}, 2) + 600 * {c} - 330 * {ep}) * pow({u}, 6) / 720))"
    return f"SELECT id, round({x}, 3) AS x, round({y}, 3) AS y FROM (SELECT o_orderkey AS id, {_PHI.replace('id', 'o_orderkey')}::DOUBLE AS phi, {_LAM.replace('id', 'o_orderkey')}::DOUBLE AS lam FROM orders)"


@register("project_points", _utm_sql())
def project_points(spark, sf):
    x, y = cl.project_utm(F.expr("74.0D + o_orderkey % 90 / 60.0D"), F.expr("12.0D + o_orderkey % 100 / 50.0D"), 43)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _lambert_sql() -> str:
    """The projection by its published formulas, constants and all, in SQL."""
    lon, lat = "(-74.2 + o_orderkey % 90 / 60.0)::DOUBLE", "(40.4 + o_orderkey % 100 / 120.0)::DOUBLE"
    e = "sqrt((1 / 298.257222101) * (2 - 1 / 298.257222101))"
    m = lambda d: f"cos(radians({d})) / sqrt(1 - pow({e} * sin(radians({d})), 2))"
    t = lambda d: f"tan(pi() / 4 - radians({d}) / 2) * pow((1 + {e} * sin(radians({d}))) / (1 - {e} * sin(radians({d}))), {e} / 2)"
    one, two, lat0 = "(41 + 2 / 60.0::DOUBLE)", "(40 + 40 / 60.0::DOUBLE)", "(40 + 10 / 60.0::DOUBLE)"
    return (
        f"WITH c AS (SELECT (ln({m(one)}) - ln({m(two)})) / (ln({t(one)}) - ln({t(two)})) AS n), k AS (SELECT n, 6378137.0 * {m(one)} / (n * pow({t(one)}, n)) AS s FROM c), "
        f"p AS (SELECT o_orderkey AS id, {lon} AS lon, {lat} AS lat FROM orders), r AS (SELECT id, lon, lat, s * pow({t('lat')}, n) AS rho, s * pow({t(lat0)}, n) AS rho0, n * radians(lon + 74) AS theta FROM p, k) "
        "SELECT id, round(300000 + rho * sin(theta), 3) AS x, round(rho0 - rho * cos(theta), 3) AS y, round(lon, 8) AS lon, round(lat, 8) AS lat, round(lon, 7) AS utm_lon, round(lat, 7) AS utm_lat FROM r"
    )


@register("project_lambert", _lambert_sql())
def project_lambert(spark, sf):
    """Conic metres, and the degrees that both inverse projections give back."""
    p = table(spark, sf, "orders").selectExpr("o_orderkey as id", "-74.2D + o_orderkey % 90 / 60.0D as lon", "40.4D + o_orderkey % 100 / 120.0D as lat")
    x, y = cl.project_lambert(F.col("lon"), F.col("lat"))
    u, v = cl.project_utm(F.col("lon"), F.col("lat"), 18)
    p = p.select("id", x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))
    lon, lat = cl.unproject_lambert(F.col("x"), F.col("y"))
    utm_lon, utm_lat = cl.unproject_utm(F.col("u"), F.col("v"), 18)
    return p.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"), F.round(utm_lon, 7).alias("utm_lon"), F.round(utm_lat, 7).alias("utm_lat"))


@register("display_fields", "SELECT s_suppkey, concat_ws(', ', CASE WHEN s_suppkey % 2 = 0 THEN concat(upper(substr(s_name, 1, 1)), lower(substr(s_name, 2))) ELSE 'Main Street' END, concat(upper(substr(n_name, 1, 1)), lower(substr(n_name, 2)))) AS place, round_even(s_acctbal / 24.0, 1) AS days FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def display_fields(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = cl.display_text(F.expr("case when s_suppkey % 2 = 0 then s_name end"), F.lit(None).cast("string"), F.lit("main street"), F.col("n_name"))
    # Half-even of the tenths as doubles, like the SQL: ``bround`` rounds the printed decimals, and -31.650000000000002 is a tie in tenths.
    return s.select("s_suppkey", place.alias("place"), (F.rint(F.col("s_acctbal") / 24.0 * 10) / 10).alias("days"))
