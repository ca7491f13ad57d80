"""Score, summary and data-quality queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from duskline.operators import aggregates as ag
from duskline.operators import quality_checks as qc
from duskline.operators import scores as sc
from duskline.operators import spatial as sp
from duskline.operators import windows as wi
from duskline.plans.catalog import register
from duskline.plans.fixtures import view, with_views
from duskline.session import table


@register("priority_index", with_views("jobs") + ", r AS (SELECT id, CASE WHEN id % 13 <> 0 AND id % 11 <> 0 THEN greatest(0, 0.02 * (score - 50000) * (1 + id % 30)) END AS raw, CASE WHEN id % 143 = 0 THEN 'no rate, no days' WHEN id % 13 = 0 THEN 'no rate' WHEN id % 11 = 0 THEN 'no days' END AS reason FROM jobs), s AS (SELECT id, reason, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) * 100 AS score FROM r) SELECT id, round(score, 6) AS score, CASE WHEN score >= 80 THEN 'High' WHEN score >= 40 THEN 'Medium' WHEN score IS NOT NULL THEN 'Low' END AS tier, reason FROM s")
def priority_index(spark, sf):
    j = view(spark, sf, "jobs").select("id", F.expr("case when id % 13 <> 0 then score - 50000 end").alias("rate"), F.expr("case when id % 11 <> 0 then cast(1 + id % 30 as double) end").alias("days"))
    return sc.priority_index(j, "rate", "days", 0.02).select("id", F.round("score", 6).alias("score"), "tier", "reason")


_W = {"a": 0.5, "b": 0.3, "c": 0.2}
_COMPONENTS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 10 / 10.0 END AS a, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 / 10.0 END AS b, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 9 / 10.0 END AS c FROM customer"
_WEIGHT = "((CASE WHEN a IS NULL THEN 0 ELSE 0.5 END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.3 END) + (CASE WHEN c IS NULL THEN 0 ELSE 0.2 END))"


def _components(spark, sf):
    e = "cast(case when c_custkey % {0} <> 0 then c_custkey % {1} / 10.0 end as double) as {2}"
    return table(spark, sf, "customer").selectExpr("c_custkey as id", e.format(4, 10, "a"), e.format(3, 7, "b"), e.format(5, 9, "c"))


@register("weighted_components", f"WITH x AS ({_COMPONENTS}) SELECT id, round((coalesce(a, 0) * 0.5 + coalesce(b, 0) * 0.3 + coalesce(c, 0) * 0.2) / nullif({_WEIGHT}, 0), 6) AS score FROM x")
def weighted_components(spark, sf):
    return sc.weighted_components(_components(spark, sf), _W).select("id", F.round("score", 6).alias("score"))


@register("top_reasons", f"WITH x AS ({_COMPONENTS}), l AS (SELECT id, 'risk' AS name, a * 0.5 AS v FROM x UNION ALL SELECT id, 'people', b * 0.3 FROM x UNION ALL SELECT id, 'repeat', c * 0.2 FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC NULLS LAST, name) AS k FROM l WHERE v > 0) SELECT x.id, coalesce(string_agg(name, '; ' ORDER BY k) FILTER (k <= 2), '') AS reasons FROM x LEFT JOIN r ON r.id = x.id GROUP BY x.id")
def top_reasons(spark, sf):
    s = sc.weighted_components(_components(spark, sf), _W)
    return s.select("id", F.coalesce(sc.top_reasons({"c_a": "risk", "c_b": "people", "c_c": "repeat"}, 2), F.lit("")).alias("reasons"))


@register("evidence_weight", "SELECT s_suppkey, round(CASE WHEN e <= 0 OR lo <= 0 THEN 0 ELSE least(greatest(e / 5000.0, 0), 1) END, 6) AS w FROM (SELECT s_suppkey, s_acctbal AS e, s_acctbal - 2000 AS lo FROM supplier)")
def evidence_weight(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.round(sc.evidence_weight(F.col("s_acctbal"), F.col("s_acctbal") - 2000, F.lit(5000.0)), 6).alias("w"))


_VARIANTS = sc.weight_variants(_W, 6, "weights")


def _scored(w: dict[str, float]) -> str:
    there = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {v!r}::DOUBLE END" for c, v in w.items())
    return f"round(({' + '.join(f'coalesce({c} * {v!r}::DOUBLE, 0)' for c, v in w.items())}) / nullif({there}, 0), 9)"


@register(
    "weight_sensitivity",
    f"WITH x AS ({_COMPONENTS}), s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, id, {_scored(_W)} AS s0, {_scored(w)} AS s1 FROM x" for n, w in _VARIANTS.items()) + "), q AS (SELECT * FROM s WHERE s0 IS NOT NULL AND s1 IS NOT NULL), "
    "r AS (SELECT variant, rank() OVER (PARTITION BY variant ORDER BY s0) + (count(*) OVER (PARTITION BY variant, s0) - 1) / 2.0 AS r0, rank() OVER (PARTITION BY variant ORDER BY s1) + (count(*) OVER (PARTITION BY variant, s1) - 1) / 2.0 AS r1 FROM q), "
    "a AS (SELECT variant, id FROM s WHERE s0 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variant ORDER BY s0 DESC, id) <= 100), b AS (SELECT variant, id FROM s WHERE s1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variant ORDER BY s1 DESC, id) <= 100), "
    "o AS (SELECT variant, count(*) / 100.0 AS overlap FROM a JOIN b USING (variant, id) GROUP BY 1) SELECT variant, count(*) AS rows, round(corr(r0, r1), 6) AS spearman, round(coalesce(any_value(overlap), 0), 6) AS overlap FROM r LEFT JOIN o USING (variant) GROUP BY 1",
)
def weight_sensitivity(spark, sf):
    """Each component dropped, and six draws of scaled weights."""
    s = sc.weight_sensitivity(_components(spark, sf), "id", _W, _VARIANTS)
    return s.select("variant", "rows", F.round("spearman", 6).alias("spearman"), F.round("overlap", 6).alias("overlap"))


@register("age_activity_repeat_score", with_views("ivals") + ", a AS (SELECT id, epoch(TIMESTAMP '2024-02-01' - start_ts) / 86400.0 / 31 AS age, (count(*) OVER (PARTITION BY cust)) - 1 AS repeats, x_m FROM ivals), e AS (SELECT id, age, repeats, (SELECT count(*) FROM ivals v WHERE v.x_m <= a.x_m) / (SELECT count(*) FROM ivals) AS act FROM a) SELECT id, round((least(age, 1) + act + least(repeats / 5.0, 1)) / 3, 6) AS score FROM e")
def age_activity_repeat_score(spark, sf):
    iv = view(spark, sf, "ivals").withColumn("repeats", F.count("*").over(Window.partitionBy("cust")) - 1)
    iv = wi.ecdf(iv, iv, "x_m", "act")
    age = F.expr("timestampdiff(second, start_ts, timestamp_ntz '2024-02-01 00:00:00')") / 86400.0 / 31
    return iv.select("id", F.round((F.least(age, F.lit(1.0)) + F.col("act") + F.least(F.col("repeats") / 5.0, F.lit(1.0))) / 3, 6).alias("score"))


@register("recommend_action", with_views("jobs") + " SELECT CASE WHEN s >= 80 THEN 'repair' WHEN s >= 40 OR id % 60 > 30 THEN 'schedule' ELSE 'monitor' END AS action, count(*) AS n FROM (SELECT id, score / 5000 AS s FROM jobs) GROUP BY 1")
def recommend_action(spark, sf):
    return view(spark, sf, "jobs").groupBy(sc.recommend_action(F.col("score") / 5000, F.col("id") % 60).alias("action")).agg(F.count("*").alias("n"))


@register(
    "ward_summary",
    with_views("ivals", "regions") + ", a AS (SELECT ivals.id, rid, (ivals.id * 37 % 1000) / 10.0 AS score FROM ivals JOIN regions ON city = cust % 5 QUALIFY row_number() OVER (PARTITION BY ivals.id ORDER BY sqrt((x_m - rx) * (x_m - rx) + (y_m - ry) * (y_m - ry)) / sigma, rid) = 1), "
    "n AS (SELECT r.rid, count(a.id) AS n, count(a.id) / (1 + r.rid % 9) * 10.0 AS per_10k, count(a.id) / (0.5 + r.rid % 7) AS per_km2, avg(score) AS mean_score, max(score) AS max_score FROM regions r LEFT JOIN a ON a.rid = r.rid GROUP BY r.rid), q AS (SELECT quantile_cont(per_10k, [0.33, 0.67]) AS q, min(per_km2) AS lo, max(per_km2) AS hi FROM n) "
    "SELECT rid, n, round(per_10k, 6) AS per_10k, round(per_km2, 6) AS per_km2, round(mean_score, 12) AS mean_score, max_score, round(CASE WHEN hi > lo THEN (per_km2 - lo) / (hi - lo) * 100 ELSE 0 END, 6) AS risk, CASE WHEN per_10k > q[2] THEN 'High' WHEN per_10k > q[1] THEN 'Medium' ELSE 'Low' END AS category FROM n, q",
)
def ward_summary(spark, sf):
    """Intervals of each ward per head and km2, their scores, a risk from 0 to 100 and a category by terciles."""
    iv = view(spark, sf, "ivals").selectExpr("id", "x_m", "y_m", "cast(cust % 5 as int) as city", "(id * 37 % 1000) / 10.0D as score")
    wards = view(spark, sf, "regions").withColumn("people", F.col("rid") % 9 + 1).withColumn("km2", F.col("rid") % 7 + 0.5)
    out = sc.ward_summary(iv, wards, sp.assign_region(iv, wards, "id"), "id", "rid", "score", "people", "km2", 10.0)
    return out.select("rid", "n", F.round("per_head", 6).alias("per_10k"), F.round("per_km2", 6).alias("per_km2"), F.round("mean_score", 12).alias("mean_score"), "max_score", F.round("risk", 6).alias("risk"), "category")


@register("kpi_summary", with_views("jobs") + " SELECT count(*) AS jobs, round(avg(score), 4) AS mean_score, count(*) FILTER (score >= 400000) AS high, count(*) FILTER (score < 200000) AS low, count(DISTINCT region) AS regions FROM jobs")
def kpi_summary(spark, sf):
    s = F.col("score")
    return view(spark, sf, "jobs").agg(F.count("*").alias("jobs"), F.round(F.avg(s), 4).alias("mean_score"), F.count_if(s >= 400000).alias("high"), F.count_if(s < 200000).alias("low"), F.countDistinct("region").alias("regions"))


@register("percentile_compare", "WITH s AS (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS a, count(*) AS b FROM orders GROUP BY 1), r AS (SELECT k, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / count(*) OVER () AS pa, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / count(*) OVER () AS pb FROM s) SELECT k, round(pa, 6) AS pa, round(pb, 6) AS pb FROM r ORDER BY pa DESC, k LIMIT 20")
def percentile_compare(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("a"), F.count("*").alias("b"))
    r = wi.percent_rank_avg(wi.percent_rank_avg(s, "a", "pa"), "b", "pb")
    return r.orderBy(F.desc("pa"), "k").limit(20).select("k", F.round("pa", 6).alias("pa"), F.round("pb", 6).alias("pb"))


@register("estimate_view", "SELECT s_suppkey, split_part(name, ':', 1) AS effect, split_part(name, ':', 2) AS period, lo <= 0 AND hi >= 0 AS contains_zero, CASE WHEN lo > 0 THEN 'increase' WHEN hi < 0 THEN 'decrease' ELSE 'none' END AS significant, n_name AS label FROM (SELECT s_suppkey, concat('net', s_suppkey % 3, ':post') AS name, s_acctbal - 3000 AS lo, s_acctbal + 3000 AS hi, s_nationkey FROM supplier) JOIN nation ON s_nationkey = n_nationkey")
def estimate_view(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey", "concat('net', s_suppkey % 3, ':post') as name", "s_acctbal - 3000 as lo", "s_acctbal + 3000 as hi", "s_nationkey as n_nationkey").join(table(spark, sf, "nation"), "n_nationkey")
    sign = F.when(F.col("lo") > 0, "increase").when(F.col("hi") < 0, "decrease").otherwise("none")
    return s.select("s_suppkey", F.split_part("name", F.lit(":"), F.lit(1)).alias("effect"), F.split_part("name", F.lit(":"), F.lit(2)).alias("period"), F.expr("lo <= 0 and hi >= 0").alias("contains_zero"), sign.alias("significant"), F.col("n_name").alias("label"))


@register("key_checks", "SELECT 'orders_unique' AS check_id, CAST(0 AS BIGINT) AS n, true AS passed UNION ALL SELECT 'customer_repeats', count(*), count(*) = 0 FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'order_customers_known', count(*), count(*) = 0 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0))")
def key_checks(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").where("c_custkey % 10 <> 0").selectExpr("c_custkey as o_custkey")
    return qc.checked({"orders_unique": qc.repeated_keys(o, ["o_orderkey"]), "customer_repeats": qc.repeated_keys(o, ["o_custkey"]), "order_customers_known": qc.missing_keys(o, c, "o_custkey")})


@register("interval_validity", with_views("dirty") + " SELECT id FROM dirty WHERE end_ts < start_ts")
def interval_validity(spark, sf):
    return view(spark, sf, "dirty").where("end_ts < start_ts").select("id")


@register("same_population", "SELECT count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'view') UNION ALL SELECT count(*) FROM (SELECT user_id FROM events WHERE event_type = 'view' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'click')")
def same_population(spark, sf):
    e = table(spark, sf, "events")
    d = qc.different_rows(e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'view'").select("user_id"))
    sides = spark.createDataFrame([("a",), ("b",)], "side string")
    return sides.join(d, "side", "left").groupBy("side").agg(F.count("user_id").alias("n")).select("n")


@register("unbalanced_units", with_views("panel") + " SELECT unit FROM (SELECT * FROM panel WHERE unit % 11 <> 0 OR period < 2) GROUP BY 1 HAVING count(*) <> 3 OR count(DISTINCT period) <> 3 OR count(DISTINCT treatment) <> 1")
def unbalanced_units(spark, sf):
    return qc.unbalanced_units(view(spark, sf, "panel").where("unit % 11 <> 0 or period < 2"), "unit", "period", "treatment", 3).select("unit")


@register("boundary_pairs", with_views("pts", "regions") + ", d AS (SELECT abs(sqrt((x_m - rx) * (x_m - rx) + (y_m - ry) * (y_m - ry)) - 250) AS e FROM pts, regions) SELECT count(*) FILTER (e <= 0.001) AS within_1_mm, count(*) AS within_1_m FROM d WHERE e <= 1")
def boundary_pairs(spark, sf):
    r = view(spark, sf, "regions").groupBy(F.col("rx").alias("bx"), F.col("ry").alias("by")).agg(F.count("*").alias("m"))
    p = view(spark, sf, "pts").groupBy("x_m", "y_m").agg(F.count("*").alias("n"))
    near = sp.radius_join(p, r, 251).where("abs(distance - 250) <= 1").withColumn("n", F.expr("n * m"))
    some = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return near.agg(some(F.expr("case when abs(distance - 250) <= 0.001 then n end")).alias("within_1_mm"), some("n").alias("within_1_m"))


@register("table_rules", "SELECT count(*) FILTER (o_custkey IS NULL) AS no_customer, count(*) FILTER (o_totalprice <= 0) AS bad_price, count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) AS bad_status FROM orders")
def table_rules(spark, sf):
    return table(spark, sf, "orders").agg(F.count_if(F.col("o_custkey").isNull()).alias("no_customer"), F.count_if(F.col("o_totalprice") <= 0).alias("bad_price"), F.count_if(~F.col("o_orderstatus").isin("F", "O", "P")).alias("bad_status"))


_PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@register("table_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS lowest, CAST(max({c}) AS VARCHAR) AS highest FROM orders" for c in _PROFILED))
def table_profile(spark, sf):
    """The number of distinct values is approximate and left out of the comparison."""
    return qc.profile(table(spark, sf, "orders").select(*_PROFILED)).drop("about_distinct")


@register("determinism_check", "SELECT 'as it is' AS run, true AS equal UNION ALL SELECT 'one count changed', false")
def determinism_check(spark, sf):
    """Fingerprints of one result computed under different partitionings, and of a result in which one count is changed."""
    counts = lambda n: sp.count_in_zone_during(view(spark, sf, "pts").repartition(n), view(spark, sf, "ivals"), 100, 250)
    other = ag.fingerprint(counts(7)).withColumnsRenamed({"rows": "r2", "hash_sum": "s2", "hash_xor": "x2"})
    changed = counts(3).withColumn("n_disc", F.expr("n_disc + cast(id = 1 as int)"))
    same = lambda df, name: ag.fingerprint(df).crossJoin(other).select(F.lit(name).alias("run"), F.expr("rows = r2 and hash_sum = s2 and hash_xor = x2").alias("equal"))
    return same(counts(3), "as it is").unionByName(same(changed, "one count changed"))


@register("estimator_identity", "SELECT 'paired mean' AS identity, true AS equal UNION ALL SELECT 'net error', true UNION ALL SELECT 'paired mean of a changed panel', false")
def estimator_identity(spark, sf):
    """The mean of the paired differences of balanced pairs is the fixed-effects coefficient; the standard error of a net
    effect is that of the summed differences. A changed panel breaks the first."""
    from duskline.operators.estimate import mean_cluster_se, net_effect, ols_cluster

    p = view(spark, sf, "panel").where("period <> 1")
    whole = p.groupBy("pair").agg(F.count("*").alias("n")).where("n = 4").select("pair")
    p = p.join(whole, "pair").withColumn("x", F.expr("cast(treatment * cast(period = 2 as int) as double)"))
    paired = lambda df: df.groupBy("pair", "cluster").agg(F.sum(F.expr("(case when period = 2 then 1 else -1 end) * y * (2 * treatment - 1)")).alias("d"))
    r = p
    for c, name in (("y", "ry"), ("x", "rx")):
        r = wi.two_way_demean(r, "unit", "period", c, name)
    beta = float(ols_cluster(r, "ry", ["rx"], [["cluster"]])[0][0])
    mean = lambda df, name: paired(df).groupBy("pair").agg(F.sum("d").alias("d")).agg((F.abs(F.avg("d") - beta) < 1e-9).alias("equal")).select(F.lit(name).alias("identity"), "equal")
    d = view(spark, sf, "panel").groupBy("cluster", "pair").agg(F.sum(F.expr("(case when period = 2 then y else 0 end)")).alias("a"), F.sum(F.expr("(case when period = 1 then -y else 0 end)")).alias("b"))
    net = net_effect(d, "a", "b", "cluster").crossJoin(mean_cluster_se(d.withColumn("s", F.col("a") + F.col("b")), "s", "cluster")).select(F.lit("net error").alias("identity"), (F.abs(F.col("net_se") - F.col("se")) < 1e-9).alias("equal"))
    changed = p.withColumn("y", F.expr("y + cast(unit = 1 and period = 2 as int)"))
    return mean(p, "paired mean").unionByName(net).unionByName(mean(changed, "paired mean of a changed panel"))


@register("ward_relationships", with_views("ivals", "regions") + ", w AS (SELECT rid, CAST(1 + rid % 9 AS DOUBLE) AS population, sigma, count(id) AS n, CAST(count(id) AS DOUBLE) / (1 + rid % 9) AS rate FROM regions LEFT JOIN ivals ON cust % (SELECT count(*) FROM regions) + 1 = rid GROUP BY rid, sigma), l AS (SELECT rid, unnest(['population', 'sigma']) AS factor, unnest([population, sigma]) AS v, rate FROM w), k AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY v) + (count(*) OVER (PARTITION BY factor, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY factor ORDER BY rate) + (count(*) OVER (PARTITION BY factor, rate) - 1) / 2.0 AS rr FROM l) SELECT factor, round(corr(v, rate), 6) AS pearson, round(corr(rv, rr), 6) AS spearman FROM k GROUP BY 1")
def ward_relationships(spark, sf):
    """How the rate of intervals of each ward goes with its other figures."""
    from functools import reduce

    r = view(spark, sf, "regions")
    wards = r.crossJoin(F.broadcast(r.agg(F.count("*").alias("wards"))))
    n = view(spark, sf, "ivals").crossJoin(F.broadcast(r.agg(F.count("*").alias("wards")))).groupBy(F.expr("cast(cust % wards + 1 as bigint)").alias("rid")).agg(F.count("*").alias("n"))
    w = wards.select("rid", "sigma", (1 + F.col("rid") % 9).cast("double").alias("population")).join(n, "rid", "left").fillna(0, ["n"]).withColumn("rate", F.col("n") / F.col("population"))
    one = lambda c: w.agg(F.lit(c).alias("factor"), F.round(F.corr(c, "rate"), 6).alias("pearson")).crossJoin(ag.spearman(w, c, "rate").select(F.round("spearman", 6).alias("spearman")))
    return reduce(lambda a, b: a.unionByName(b), [one("population"), one("sigma")])


@register("kpi_breakdown", with_views("dirty") + ", c AS (SELECT CASE WHEN end_ts IS NULL THEN 'no end' WHEN end_ts < start_ts THEN 'reversed' WHEN epoch(end_ts - start_ts) < 864000 THEN 'short' ELSE 'kept' END AS reason, CASE WHEN epoch(end_ts - start_ts) >= 5184000 THEN 'High' WHEN epoch(end_ts - start_ts) >= 2592000 THEN 'Medium' WHEN end_ts IS NOT NULL THEN 'Low' END AS tier FROM dirty), k AS (SELECT 'reason' AS kind, reason AS label FROM c UNION ALL SELECT 'tier', coalesce(tier, 'none') FROM c) SELECT kind, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY kind), 9) AS share FROM k GROUP BY kind, label")
def kpi_breakdown(spark, sf):
    """Rows by the reason that excludes them and by tier, with shares."""
    hours = F.expr("timestampdiff(second, start_ts, end_ts)")
    reason = F.when(F.col("end_ts").isNull(), "no end").when(F.expr("end_ts < start_ts"), "reversed").when(hours < 864000, "short").otherwise("kept")
    c = view(spark, sf, "dirty").select(reason.alias("reason"), F.coalesce(wi.tier_by_value(hours, 5184000, 2592000), F.lit("none")).alias("tier"))
    long = c.select(F.explode(F.array(F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("label")), F.struct(F.lit("tier").alias("kind"), F.col("tier").alias("label")))).alias("k")).select("k.*")
    n = long.groupBy("kind", "label").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("kind").agg(F.sum("n").alias("all")), "kind").select("kind", "label", "n", F.round(F.col("n") / F.col("all"), 9).alias("share"))


@register("row_rules", with_views("ivals") + ", d AS (SELECT x_m, y_m, start_ts FROM ivals GROUP BY ALL HAVING count(*) > 1) SELECT (SELECT count(*) FROM ivals WHERE x_m < 10 OR x_m > 4990 OR y_m < 10 OR y_m > 4990) AS outside_box, (SELECT count(*) FROM d) AS repeated_time_and_place, (SELECT count(*) FROM ivals WHERE end_ts < start_ts + INTERVAL 1 HOUR) AS closed_too_soon, (SELECT count(*) FROM ivals WHERE end_ts IS NULL) AS without_end")
def row_rules(spark, sf):
    """Rows outside a box, of repeated time and place, closed within the hour, and without an end."""
    iv = view(spark, sf, "ivals")
    inside = F.col("x_m").between(10, 4990) & F.col("y_m").between(10, 4990)
    one = iv.agg(F.count_if(~inside).alias("outside_box"), F.count_if(F.expr("end_ts < start_ts + interval 1 hour")).alias("closed_too_soon"), F.count_if(F.col("end_ts").isNull()).alias("without_end"))
    return one.crossJoin(qc.repeated_keys(iv, ["x_m", "y_m", "start_ts"]).agg(F.count("*").alias("repeated_time_and_place")))
