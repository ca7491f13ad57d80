"""Sources and sinks, exposure panels, features and fitted models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from duskline import functions as fn
from duskline import sources as so
from duskline.operators import aggregates as ag
from duskline.operators import estimate as es
from duskline.operators import evaluate as ev
from duskline.operators import exposure as ex
from duskline.operators import features as fe
from duskline.plans.catalog import register
from duskline.plans.fixtures import view, with_views
from duskline.session import checkpoint_dir, cut, table


def _place(spark) -> str:
    return f"{checkpoint_dir(spark)}/round-trip-{uuid.uuid4().hex}"


@register("csv_round_trip", "SELECT c_custkey, c_mktsegment, round_even(c_acctbal, 1) AS c_acctbal, CAST(NULL AS INTEGER) AS c_name FROM customer")
def csv_round_trip(spark, sf):
    path = _place(spark)
    so.write_csv(table(spark, sf, "customer"), path, 1)
    return so.read_csv_typed(spark, path, "c_custkey long, c_mktsegment string, c_acctbal double, c_name int")


@register("parquet_cols", "SELECT s_suppkey, CAST(NULL AS VARCHAR) AS nickname, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")
def parquet_cols(spark, sf):
    path = _place(spark)
    so.write_parquet(table(spark, sf, "supplier"), path, "s_nationkey long, s_suppkey long")
    return so.read_parquet_cols(spark, path, "s_suppkey long, nickname string, s_nationkey long")


@register("json_doc_round_trip", "SELECT count(*) AS orders, round(max(o_totalprice), 2) AS top FROM orders")
def json_doc_round_trip(spark, sf):
    path = _place(spark)
    so.write_json_doc(table(spark, sf, "orders").agg(F.count("*").alias("orders"), F.round(F.max("o_totalprice"), 2).alias("top"), F.lit(float("nan")).alias("gap")), path)
    return so.read_json_doc(spark, path).select("orders", "top")


@register("union_sources", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS source, count(*) AS n FROM orders GROUP BY 1")
def union_sources(spark, sf):
    o = table(spark, sf, "orders")
    half = lambda m: o.where(f"o_orderkey % 2 = {m}")
    return so.union_sources([("even", half(0), half(0).count()), ("odd", half(1), None)]).groupBy("source").agg(F.count("*").alias("n"))


@register("backup_if_legacy", "SELECT r_regionkey, r_name FROM region")
def backup_if_legacy(spark, sf):
    path, backup = _place(spark), _place(spark)
    table(spark, sf, "region").write.parquet(path)
    so.backup_if_legacy(spark, path, backup, "new_column")
    return spark.read.parquet(backup)


@register("scalar_functions", "SELECT event_id, CAST(floor((user_id - 60) / 7.0) AS BIGINT) AS q, round_even(value, 1) AS r, strftime(ts, '%G-W%V') AS week FROM events")
def scalar_functions(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", fn.floor_div(F.col("user_id") - 60, 7).alias("q"), fn.half_even(F.col("value"), 1).alias("r"), fn.iso_week("ts").alias("week"))


_BAND = "sqrt(pow((c.gx + 0.5) * 500 - s.x_m, 2) + pow((c.gy + 0.5) * 500 - s.y_m, 2))"
_PANEL = (
    with_views("pts", "ivals") + ", p AS (SELECT CAST(floor(x_m / 500) AS BIGINT) AS gx, CAST(floor(y_m / 500) AS BIGINT) AS gy, CAST(floor(epoch_us(t - TIMESTAMP '2024-01-01') / 604800000000.0) AS INT) AS week FROM pts), k AS (SELECT * FROM p WHERE week BETWEEN 0 AND 3), c AS (SELECT DISTINCT gx, gy FROM k), "
    "r AS (SELECT x_m, y_m, greatest(floor(epoch(start_ts - TIMESTAMP '2024-01-01') / 86400), 0) AS f, least(ceil(epoch(end_ts - TIMESTAMP '2024-01-01') / 86400) - 1, 27) AS l FROM ivals WHERE end_ts IS NOT NULL), "
    "n AS (SELECT DISTINCT x_m, y_m, unnest(range(CAST(f AS BIGINT), CAST(l AS BIGINT) + 1)) AS night FROM r WHERE l >= f), s AS (SELECT x_m, y_m, CAST(floor(night / 7) AS INT) AS week, count(*) AS nights FROM n GROUP BY ALL), "
    f"e AS (SELECT c.gx, c.gy, s.week, sum(nights) FILTER ({_BAND} <= 150) AS x_0, sum(nights) FILTER ({_BAND} > 150) AS x_1 FROM c JOIN s ON {_BAND} <= 400 GROUP BY ALL), "
    "w AS (SELECT c.gx, c.gy, g.week FROM c, (SELECT CAST(unnest(range(4)) AS INT) AS week) g), y AS (SELECT gx, gy, week, count(*) AS y FROM k GROUP BY ALL), "
    "f AS (SELECT w.gx, w.gy, w.week, coalesce(y, 0) AS y, CAST(coalesce(x_0, 0) AS BIGINT) AS x_0, CAST(coalesce(x_1, 0) AS BIGINT) AS x_1 FROM w LEFT JOIN y ON y.gx = w.gx AND y.gy = w.gy AND y.week = w.week LEFT JOIN e ON e.gx = w.gx AND e.gy = w.gy AND e.week = w.week)"
)


def _panel(spark, sf, scenario: str = "base"):
    nights = ex.scenario_nights(view(spark, sf, "ivals"), scenario, "2024-01-01 00:00:00", 28)
    return ex.exposure_panel(view(spark, sf, "pts"), nights, 500, [150, 400], "2024-01-01 00:00:00", 4)


@register("exposure_panel", _PANEL + " SELECT gx, gy, week, y, x_0, x_1 FROM f")
def exposure_panel(spark, sf):
    return _panel(spark, sf)


@register("aggregate_period", _PANEL + " SELECT gx, gy, CAST(week // 2 AS INT) AS period, CAST(sum(y) AS BIGINT) AS y, CAST(sum(x_0) AS BIGINT) AS x_0, CAST(sum(x_1) AS BIGINT) AS x_1 FROM f GROUP BY ALL")
def aggregate_period(spark, sf):
    return ex.aggregate_periods(_panel(spark, sf))


@register("drop_zero_groups", "WITH n AS (SELECT user_id, event_type, count(*) FILTER (value > 40) AS v FROM events GROUP BY ALL) SELECT user_id, event_type, v FROM n WHERE user_id IN (SELECT user_id FROM n GROUP BY 1 HAVING sum(v) > 0) AND event_type IN (SELECT event_type FROM n GROUP BY 1 HAVING sum(v) > 0)")
def drop_zero_groups(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 40).alias("v"))
    return es.drop_zero_groups(n, "v", ["user_id", "event_type"])


_SCENARIOS = (
    with_views("ivals") + ", r AS (SELECT 'base' AS scenario, x_m, y_m, start_ts AS s, end_ts AS e FROM ivals WHERE end_ts IS NOT NULL UNION ALL SELECT 'early', x_m, y_m, start_ts - INTERVAL 7 DAY, end_ts FROM ivals WHERE end_ts IS NOT NULL "
    "UNION ALL SELECT 'half', x_m, y_m, start_ts, start_ts + to_seconds(floor(epoch(end_ts - start_ts) / 2)) FROM ivals WHERE end_ts IS NOT NULL UNION ALL SELECT 'open', x_m, y_m, start_ts, coalesce(end_ts, TIMESTAMP '2024-01-29') FROM ivals "
    "UNION ALL SELECT 'deadline', x_m, y_m, start_ts, end_ts FROM ivals WHERE epoch(end_ts - start_ts) / 3600 NOT BETWEEN 55 AND 60), k AS (SELECT *, greatest(floor(epoch(s - TIMESTAMP '2024-01-01') / 86400), 0) AS f, least(ceil(epoch(e - TIMESTAMP '2024-01-01') / 86400) - 1, 27) AS l FROM r WHERE e >= s), "
    "n AS (SELECT DISTINCT scenario, x_m, y_m, unnest(range(CAST(f AS BIGINT), CAST(l AS BIGINT) + 1)) AS night FROM k WHERE l >= f), g AS (SELECT lead(night) OVER (PARTITION BY x_m, y_m ORDER BY night) - night - 1 AS gap FROM n WHERE scenario = 'base'), t AS (SELECT scenario, count(*) AS site_nights FROM n GROUP BY 1) "
    "SELECT * FROM t UNION ALL SELECT concat('gap', m), CAST(site_nights + (SELECT coalesce(sum(gap), 0) FROM g WHERE gap BETWEEN 1 AND m) AS BIGINT) FROM t, (SELECT unnest([2, 7, 14]) AS m) WHERE scenario = 'base'"
)


@register("exposure_scenarios", _SCENARIOS)
def exposure_scenarios(spark, sf):
    """Total exposure of each timing scenario."""
    from functools import reduce

    names = ("base", "open", "early", "half", "deadline", "gap2", "gap7", "gap14")
    nights = [ex.scenario_nights(view(spark, sf, "ivals"), s, "2024-01-01 00:00:00", 28).agg(F.lit(s).alias("scenario"), F.count("*").alias("site_nights")) for s in names]
    return reduce(lambda a, b: a.unionByName(b), nights)


# Every closed interval is the treated unit of a pair whose control is the place 300 m east of it.
_PAIR_UNITS = with_views("pts", "ivals") + ", u AS (SELECT id, cust % 97 AS cluster, treatment, x_m + 300 * (1 - treatment) AS x, y_m AS y, start_ts AS s, end_ts AS e FROM ivals, (SELECT unnest([0, 1]) AS treatment) WHERE end_ts IS NOT NULL), j AS (SELECT u.id, u.treatment, u.s, u.e, p.t, sqrt(pow(p.x_m - x, 2) + pow(p.y_m - y, 2)) AS d FROM u JOIN pts p ON p.x_m BETWEEN x - 250 AND x + 250 AND p.t >= s - INTERVAL 14 DAY AND p.t <= e + INTERVAL 14 DAY AND sqrt(pow(p.x_m - x, 2) + pow(p.y_m - y, 2)) <= 250)"
_PAIR_PANEL = (
    _PAIR_UNITS + ", c AS (SELECT id, treatment, " + ", ".join(f"count(*) FILTER (d <= {r} AND {cond}) AS {name}_{r}" for name, cond in (("pre", "t < s"), ("during", "t BETWEEN s AND e"), ("post", "t > e AND t <= e + INTERVAL 7 DAY")) for r in (100, 250)) + " FROM j GROUP BY ALL), "
    "f AS (SELECT u.*, c.* EXCLUDE (id, treatment) FROM u LEFT JOIN c ON c.id = u.id AND c.treatment = u.treatment) "
    + " UNION ALL ".join(f"SELECT id AS pair, treatment, '{name}' AS period, {k} AS period_order, {int(name == 'post')} AS post, round({days}, 6) AS days, coalesce({name}_100, 0) AS y_100, coalesce({name}_250, 0) AS y_250, coalesce(pre_100, 0) AS baseline FROM f" for k, (name, days) in enumerate((("pre", "14.0::DOUBLE"), ("during", "epoch(e - s) / 86400"), ("post", "7.0::DOUBLE"))))
)


def _pairs_east(spark, sf):
    return view(spark, sf, "ivals").where("end_ts is not null").selectExpr("id as pair", "cust % 97 as cluster", "x_m as t_x", "y_m as t_y", "x_m + 300 as c_x", "y_m as c_y", "start_ts", "end_ts")


@register("pair_panel", _PAIR_PANEL)
def pair_panel(spark, sf):
    p = ex.build_pair_panel(_pairs_east(spark, sf), view(spark, sf, "pts").select("x_m", "y_m", "t"), [100, 250], 14, 7)
    return p.select("pair", "treatment", "period", "period_order", "post", F.round("days", 6).alias("days"), "y_100", "y_250", "baseline")


_SPECS = {"base": (100, 14, 7), "wide": (250, 14, 7), "long": (100, 14, 14), "short": (100, 7, 7)}
_GRID = (
    _PAIR_UNITS + ", c AS (SELECT u.id, u.cluster, u.treatment, " + ", ".join(f"count(*) FILTER (d <= {r} AND t > j.e AND t <= j.e + INTERVAL {post} DAY) / {post}.0 - count(*) FILTER (d <= {r} AND t < j.s AND t >= j.s - INTERVAL {pre} DAY) / {pre}.0 AS {name}" for name, (r, pre, post) in _SPECS.items())
    + " FROM u LEFT JOIN j ON j.id = u.id AND j.treatment = u.treatment GROUP BY ALL), p AS (SELECT id, cluster, unnest([" + ", ".join(f"'{n}'" for n in _SPECS) + "]) AS spec, unnest([" + ", ".join(f"sum((2 * treatment - 1) * {n})" for n in _SPECS) + "]) AS d FROM c GROUP BY id, cluster), "
    "m AS (SELECT spec, avg(d) AS b, count(*) AS n FROM p GROUP BY 1), s AS (SELECT spec, cluster, sum(d - b) AS s FROM p JOIN m USING (spec) GROUP BY ALL), r AS (SELECT spec, b, sqrt(count(*) / (count(*) - 1.0) * sum(s * s)) / n AS se FROM s JOIN m USING (spec) GROUP BY spec, b, n) "
    "SELECT r.spec, round(r.b, 6) AS estimate, round(r.se, 6) AS se, round(r.b - o.b, 6) AS difference, sign(r.b) = sign(o.b) AS same_sign, abs(r.b) <= 1.959963984540054 * r.se AS holds_zero FROM r JOIN r o ON o.spec = 'base'"
)


@register("robustness_grid", _GRID)
def robustness_grid(spark, sf):
    """The effect after an interval under other radii and periods."""
    g = ex.robustness_grid(_pairs_east(spark, sf), view(spark, sf, "pts").select("x_m", "y_m", "t"), _SPECS, "cluster")
    return g.select("spec", *[F.round(c, 6).alias(c) for c in ("estimate", "se", "difference")], "same_sign", "holds_zero")


@register("before_after_naive", with_views("panel") + ", d AS (SELECT unit, max(y) FILTER (period = 2) - max(y) FILTER (period = 0) AS d FROM panel WHERE treatment = 1 GROUP BY 1) SELECT round(avg(d), 6) AS estimate, round(stddev_samp(d) / sqrt(count(d)), 6) AS se, avg(d) - 1.96 * stddev_samp(d) / sqrt(count(d)) <= 0 AND avg(d) + 1.96 * stddev_samp(d) / sqrt(count(d)) >= 0 AS holds_zero FROM d")
def before_after_naive(spark, sf):
    d = view(spark, sf, "panel").where("treatment = 1").groupBy("unit").agg((F.max(F.expr("case when period = 2 then y end")) - F.max(F.expr("case when period = 0 then y end"))).alias("d"))
    se = F.stddev_samp("d") / F.sqrt(F.count("d"))
    return d.agg(F.round(F.avg("d"), 6).alias("estimate"), F.round(se, 6).alias("se"), ((F.avg("d") - 1.96 * se <= 0) & (F.avg("d") + 1.96 * se >= 0)).alias("holds_zero"))


def _history(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = fe.engineer_features(e, "user_id", "ts").withColumn("label", (F.col("value") > 20).cast("double"))
    return out.select("event_id", "user_id", "ts", "event_type", "label", *[F.col(c).cast("double") for c in ("prior_7d", "prior_1d", "since_previous_s", "hour", "dow", "weekend", "business")])


_NUMERIC = ["prior_7d", "prior_1d", "since_previous_s", "hour", "dow", "weekend", "business"]


@register("engineer_features", "WITH e AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS s FROM events) SELECT a.event_id, count(b.event_id) FILTER (b.s >= a.s - 604800) AS prior_7d, count(b.event_id) FILTER (b.s >= a.s - 86400) AS prior_1d, CAST(a.s - max(b.s) AS BIGINT) AS since_previous_s, CAST(hour(a.ts) AS INT) AS hour FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.s < a.s GROUP BY a.event_id, a.s, a.ts")
def engineer_features(spark, sf):
    return fe.engineer_features(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts").select("event_id", "prior_7d", "prior_1d", "since_previous_s", "hour")


def _parts(spark, sf):
    # Fits read their rows many times: the features are made once.
    h = cut(fe.missing_flags(fe.fold_rare(_history(spark, sf), "event_type", 50), ["since_previous_s"]).drop("user_id"))
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return h.where(F.col("ts") < stamp("2024-01-20")), h.where((F.col("ts") >= stamp("2024-01-20")) & (F.col("ts") < stamp("2024-01-26"))), h.where(F.col("ts") >= stamp("2024-01-26"))


@register("fit_candidates")
def fit_candidates(spark, sf):
    """Eleven classifiers with weighted classes, their validation AUC, and which is chosen."""
    train, valid, _ = _parts(spark, sf)
    stages = fe.preprocessing([*_NUMERIC, "since_previous_s_missing"], ["event_type"], logged=("since_previous_s", "prior_7d"))
    return fe.fit_candidates(fe.class_weights(train, "label"), valid, stages, fe.candidates(weight="weight"))[1]


@register("ablation")
def ablation(spark, sf):
    """AUC of a model on prior counts only, on static features only, and on all."""
    from functools import reduce

    from pyspark.ml.classification import LogisticRegression

    train, valid, _ = _parts(spark, sf)
    sets = {"history": ["prior_7d", "prior_1d"], "static": ["hour", "dow", "weekend", "business"], "all": _NUMERIC}
    rows = [fe.fit_candidates(train, valid, fe.preprocessing(cols, ["event_type"]), {name: LogisticRegression(regParam=0.01)})[1].drop("chosen") for name, cols in sets.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@register("permutation_importance")
def permutation_importance(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    train, _, test = _parts(spark, sf)
    model = Pipeline(stages=[*fe.preprocessing(_NUMERIC, ["event_type"]), LogisticRegression(regParam=0.01)]).fit(train)
    return fe.permutation_importance(model, test, ["prior_7d", "hour"], "event_id", repeats=1)


@register("group_kfold_predict")
def group_kfold_predict(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.avg(F.col("o_totalprice") / 1e5).alias("price"), F.countDistinct("o_orderpriority").cast("double").alias("kinds"), F.lit(2.0).alias("exposure"))
    out = fe.group_kfold_predict(o, "o_custkey", "n", "exposure", ["price", "kinds"])
    return out.select("o_custkey", "n", "predicted_rate")


@register("single_feature_auc", "WITH e AS (SELECT CASE WHEN value > 20 THEN 1 ELSE 0 END AS y, CAST(hour(ts) AS DOUBLE) AS p FROM events), r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM e) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r")
def single_feature_auc(spark, sf):
    e = table(spark, sf, "events").select(F.expr("cast(value > 20 as int)").alias("y"), F.hour("ts").cast("double").alias("p"), F.lit(1).alias("g"))
    return ev.ranking_metrics(e, "y", "p", ["g"]).select(F.round("auc", 6).alias("auc"))


_GROUPED = (
    with_views("preds") + ", b AS (SELECT *, {keys} FROM preds), g AS (SELECT {by}, count(*) AS n, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, avg(CASE WHEN y = 1 THEN -ln(greatest(least(p, 1 - 1e-15), 1e-15)) ELSE -ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END) AS ll FROM b GROUP BY ALL HAVING count(*) >= 10 AND count(DISTINCT y) = 2), "
    "k AS (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS r FROM b), a AS (SELECT {by}, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM k GROUP BY ALL HAVING count(DISTINCT y) = 2)"
)


@register("metrics_by_group", _GROUPED.format(keys="1 AS one", by="lang") + " SELECT lang, n, tp, round(ll, 5) AS log_loss, round(auc, 6) AS auc FROM g JOIN a USING (lang)")
def metrics_by_group(spark, sf):
    g = ev.metrics_by_group(view(spark, sf, "preds").where("lang is not null"), "y", "p", ["lang"])
    return g.select("lang", "n", "tp", F.round("log_loss", 5).alias("log_loss"), F.round("auc", 6).alias("auc"))


@register("auc_within_groups", _GROUPED.format(keys="doc_id % 5 AS part", by="lang, part") + " SELECT round(sum(auc * n) / sum(n), 6) AS auc_within, count(*) AS groups FROM g JOIN a USING (lang, part)")
def auc_within_groups(spark, sf):
    """Ranking within language and part only, weighted by rows."""
    p = view(spark, sf, "preds").where("lang is not null").withColumn("part", F.expr("doc_id % 5"))
    return ev.weighted_group_auc(p, "y", "p", ["lang", "part"]).select(F.round("auc_within", 6).alias("auc_within"), "groups")


def _psi_sql(name: str, cells: str) -> str:
    return f"SELECT '{name}' AS column_name, (SELECT sum((q - p) * ln(q / p)) FROM (SELECT greatest(na / sum(na) OVER (), 1e-4) AS p, greatest(nb / sum(nb) OVER (), 1e-4) AS q FROM (SELECT b, count(*) FILTER (NOT new) AS na, count(*) FILTER (new) AS nb FROM ({cells}) GROUP BY 1))) AS psi, avg(CAST({name} IS NULL AS INT)) FILTER (NOT new) AS missing_reference, avg(CAST({name} IS NULL AS INT)) FILTER (new) AS missing_new FROM x"


_DRIFT = (
    "WITH x AS (SELECT CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice END AS price, l_quantity * CASE WHEN year(l_shipdate) = 1999 THEN 1.5 ELSE 1 END AS quantity, l_returnflag AS flag, year(l_shipdate) = 1999 AS new FROM lineitem WHERE year(l_shipdate) IN (1997, 1999)), "
    "e AS (SELECT quantile_cont(price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS price, quantile_cont(quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS quantity FROM x WHERE NOT new), "
    "d AS (" + " UNION ALL ".join([*(_psi_sql(c, f"SELECT len(list_filter(e.{c}, lambda z: z < x.{c})) AS b, new FROM x, e WHERE x.{c} IS NOT NULL") for c in ("price", "quantity")), _psi_sql("flag", "SELECT flag AS b, new FROM x")]) + ") "
    "SELECT column_name, round(psi, 6) AS psi, round(missing_reference, 9) AS missing_reference, round(missing_new, 9) AS missing_new, psi > 0.2 AS drifted FROM d"
)


@register("drift_table", _DRIFT)
def drift_table(spark, sf):
    x = table(spark, sf, "lineitem").where("year(l_shipdate) in (1997, 1999)").selectExpr("case when l_orderkey % 11 <> 0 then l_extendedprice end as price", "l_quantity * case when year(l_shipdate) = 1999 then 1.5D else 1.0D end as quantity", "l_returnflag as flag", "year(l_shipdate) = 1999 as new")
    d = ev.drift_table(x.where("not new"), x.where("new"), ["price", "quantity"], ["flag"])
    return d.select("column_name", F.round("psi", 6).alias("psi"), F.round("missing_reference", 9).alias("missing_reference"), F.round("missing_new", 9).alias("missing_new"), "drifted")


@register("top_decile", with_views("panel") + ", m AS (SELECT y, CAST(1 + unit * 7 % 31 AS DOUBLE) AS mu FROM panel), q AS (SELECT mu AS q FROM m QUALIFY row_number() OVER (ORDER BY mu) = CAST(ceil(0.9 * ((SELECT count(*) FROM m) - 1)) AS BIGINT) + 1), r AS (SELECT sum(y) FILTER (mu >= q) / sum(y) AS capture, avg(CAST(mu >= q AS INT)) AS part FROM m, q) SELECT round(capture, 6) AS capture, round(capture / part, 6) AS lift FROM r")
def top_decile(spark, sf):
    m = view(spark, sf, "panel").selectExpr("y", "cast(1 + unit * 7 % 31 as double) as mu")
    return ev.top_share(m, "y", "mu").select(F.round("capture", 6).alias("capture"), F.round("lift", 6).alias("lift"))


@register("tracking_table", "SELECT event_type, CAST(floor((day(ts) - 1) / 7) AS INT) AS week, count(*) AS n, round(avg(hour(ts) / 24.0), 6) AS predicted, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS observed, round(avg(hour(ts) / 24.0) - avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS difference FROM events GROUP BY ALL")
def tracking_table(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor((F.day("ts") - 1) / 7).cast("int").alias("week"), (F.hour("ts") / 24.0).alias("p"), (F.col("value") > 20).cast("int").alias("y"))
    return ev.tracking_table(e, "y", "p", ["event_type", "week"]).select("event_type", "week", "n", *[F.round(c, 6).alias(c) for c in ("predicted", "observed", "difference")])


@register("score_parity", "SELECT event_id FROM events WHERE event_id % 41 = 0 AND ts >= TIMESTAMP '2024-01-26'")
def score_parity(spark, sf):
    """Events whose score by a fitted pipeline differs from the stored one; one in 41 stored scores is spoilt."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    train, _, test = _parts(spark, sf)
    model = Pipeline(stages=[*fe.preprocessing(_NUMERIC, ["event_type"]), LogisticRegression(regParam=0.01)]).fit(train)
    path = _place(spark)
    fe.with_probability(model, test).select("event_id", F.when(F.col("event_id") % 41 == 0, F.col("p") + 1).otherwise(F.col("p")).alias("p")).write.parquet(path)
    again = fe.with_probability(model, test.repartition(3)).select("event_id", "p")
    return ag.compare_tables(again, spark.read.parquet(path), "event_id", "p").where("difference is null or difference > 1e-9").select("event_id")
