"""Relational and aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.operators import aggregates as ag
from duskline.operators import scans
from duskline.plans.catalog import register
from duskline.plans.fixtures import view, with_views
from duskline.session import table


@register("left_equi_join", "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def left_equi_join(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey < 3")
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@register("inner_equi_join", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def inner_equi_join(spark, sf):
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@register("validated_join", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def validated_join(spark, sf):
    return ag.validated_join(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, sf, "customer"), "c_custkey").select("o_orderkey", "c_mktsegment")


@register("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 400000")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("lookup_default", "SELECT s_suppkey, coalesce(n_name, 'none') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey")
def lookup_default(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey % 2 = 0")
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


@register("spine_join", "SELECT n_nationkey, p AS period, count(s_suppkey) AS n FROM nation CROSS JOIN (SELECT CAST(unnest(range(3)) AS INT) AS p) LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 3 = p GROUP BY ALL")
def spine_join(spark, sf):
    spine = table(spark, sf, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("period"))
    n = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_suppkey") % 3).cast("int").alias("period")).agg(F.count("*").alias("n"))
    return spine.join(n, ["n_nationkey", "period"], "left").fillna(0)


@register("union_by_name", "SELECT role, count(*) AS n, sum(bal) AS bal FROM (SELECT 'c' AS role, CAST(c_acctbal AS DECIMAL(18,2)) AS bal FROM customer UNION ALL SELECT 's', CAST(s_acctbal AS DECIMAL(18,2)) FROM supplier) GROUP BY 1")
def union_by_name(spark, sf):
    c = table(spark, sf, "customer").selectExpr("'c' as role", "cast(c_acctbal as decimal(18,2)) as bal")
    s = table(spark, sf, "supplier").selectExpr("cast(s_acctbal as decimal(18,2)) as bal", "'s' as role")
    return c.unionByName(s).groupBy("role").agg(F.count("*").alias("n"), F.sum("bal").alias("bal"))


@register("set_accounting", "WITH m AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), u AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') SELECT (SELECT count(*) FROM (SELECT * FROM m UNION SELECT * FROM u)) AS either, (SELECT count(*) FROM (SELECT * FROM m INTERSECT SELECT * FROM u)) AS both_sides, (SELECT count(*) FROM (SELECT * FROM m EXCEPT SELECT * FROM u)) AS only_first")
def set_accounting(spark, sf):
    o = table(spark, sf, "orders")
    m, u = o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderstatus = 'O'").select("o_custkey")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(m.union(u).distinct(), "either").crossJoin(n(m.intersect(u), "both_sides")).crossJoin(n(m.subtract(u), "only_first"))


@register("overlapping_reuse", with_views("ivals") + " SELECT id FROM ivals a WHERE end_ts IS NOT NULL AND EXISTS (SELECT 1 FROM ivals b WHERE b.cust = a.cust AND b.id <> a.id AND b.end_ts IS NOT NULL AND b.start_ts <= a.end_ts AND b.end_ts >= a.start_ts)")
def overlapping_reuse(spark, sf):
    return scans.meets_another(view(spark, sf, "ivals").where("end_ts is not null"), "cust", "start_ts", "end_ts", "id").select("id")


@register("compare_tables", "WITH a AS (SELECT o_custkey AS k, count(*) - 10.0::DOUBLE AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) - 10.0::DOUBLE AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, a.v AS va, b.v AS vb, abs(a.v - b.v) AS difference, coalesce(sign(a.v) = sign(b.v), false) AS same_sign FROM a FULL JOIN b ON a.k = b.k")
def compare_tables(spark, sf):
    side = lambda m: table(spark, sf, "orders").where(f"o_orderkey % {m} = 0").groupBy(F.col("o_custkey").alias("k")).agg((F.count("*") - 10.0).alias("v"))
    return ag.compare_tables(side(2), side(3), "k", "v").fillna(False, ["same_sign"])


@register("explode_nights", with_views("ivals") + ", r AS (SELECT x_m, y_m, greatest(floor(epoch(start_ts - TIMESTAMP '2024-01-01') / 86400), 0) AS f, least(ceil(epoch(end_ts - TIMESTAMP '2024-01-01') / 86400) - 1, 29) AS l FROM ivals WHERE end_ts IS NOT NULL) SELECT night, count(*) AS n FROM (SELECT DISTINCT x_m, y_m, CAST(unnest(range(CAST(f AS BIGINT), CAST(l AS BIGINT) + 1)) AS INT) AS night FROM r WHERE l >= f) GROUP BY 1")
def explode_nights(spark, sf):
    n = ag.explode_nights(view(spark, sf, "ivals").where("end_ts is not null"), "2024-01-01 00:00:00", 30)
    return n.select("x_m", "y_m", "night").distinct().groupBy("night").agg(F.count("*").alias("n"))


@register("detail_lookup", "SELECT o_orderkey, c_mktsegment, CAST(rk AS INT) AS queue_rank FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 77")
def detail_lookup(spark, sf):
    o = table(spark, sf, "orders")
    one = o.where("o_orderkey = 77")
    ahead = o.crossJoin(F.broadcast(one.selectExpr("o_totalprice as p", "o_orderkey as k"))).where("o_totalprice > p or (o_totalprice = p and o_orderkey < k)").agg((F.count("*") + 1).cast("int").alias("queue_rank"))
    return one.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).crossJoin(ahead).select("o_orderkey", "c_mktsegment", "queue_rank")


@register("group_aggregates", "SELECT o_orderpriority AS p, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def group_aggregates(spark, sf):
    v = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"), F.sum(v.cast("decimal(18,2)")).alias("total"), F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.countDistinct("o_custkey").alias("customers"))


@register("value_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1")
def value_counts(spark, sf):
    return ag.value_counts(table(spark, sf, "events"), "event_type").withColumn("share", F.round("share", 9))


@register("crosstab", "SELECT CAST(year(o_orderdate) AS INT) AS y, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS O, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS P, count(CASE WHEN o_orderstatus IN ('F', 'O', 'P') THEN 1 END) AS total FROM orders GROUP BY 1")
def crosstab(spark, sf):
    return ag.crosstab(table(spark, sf, "orders").withColumn("y", F.year("o_orderdate")), "y", "o_orderstatus", ["F", "O", "P"])


@register("pivot_wide", with_views("panel") + " SELECT pair, max(CASE WHEN treatment = 0 AND period = 0 THEN y END) AS c0, max(CASE WHEN treatment = 1 AND period = 0 THEN y END) AS t0, max(CASE WHEN treatment = 0 AND period = 2 THEN y END) AS c2, max(CASE WHEN treatment = 1 AND period = 2 THEN y END) AS t2 FROM panel GROUP BY 1")
def pivot_wide(spark, sf):
    p = view(spark, sf, "panel").withColumn("k", F.expr("case treatment when 0 then 'c' else 't' end || period"))
    return p.groupBy("pair").pivot("k", ["c0", "t0", "c2", "t2"]).agg(F.max("y"))


@register("modal_value", with_views("ivals") + ", n AS (SELECT x_m, region, count(*) AS c FROM ivals GROUP BY ALL) SELECT x_m, min_by(region, ROW(-c, region)) AS modal, count(*) AS labels FROM n GROUP BY 1")
def modal_value(spark, sf):
    return ag.modal_value(view(spark, sf, "ivals"), "x_m", "region")


@register("exact_percentiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(median(o_totalprice), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY 1")
def exact_percentiles(spark, sf):
    q = ag.exact_quantiles(table(spark, sf, "orders"), "o_totalprice", [0.1, 0.5, 0.9, 0.99], ["o_orderpriority"])
    return q.select("o_orderpriority", *[F.round(F.get("q", F.lit(i)), 4).alias(name) for i, name in enumerate(("p10", "p50", "p90", "p99"))])


@register("quantile_higher", "SELECT o_totalprice AS q_value FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice) = CAST(ceil(0.999 * ((SELECT count(*) FROM orders) - 1)) AS BIGINT) + 1")
def quantile_higher(spark, sf):
    return ag.quantile_higher(table(spark, sf, "orders"), "o_totalprice", 0.999)


@register("describe", "SELECT round(avg(v), 6) AS mean, median(v) AS median, round(quantile_cont(v, 0.9), 6) AS p90, max(v) AS max, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), 9) AS zero_share FROM (SELECT CAST(user_id % 7 AS DOUBLE) AS v FROM events)")
def describe(spark, sf):
    d = ag.describe(table(spark, sf, "events").selectExpr("cast(user_id % 7 as double) as v"), "v")
    return d.select(F.round("mean", 6).alias("mean"), "median", F.round("p90", 6).alias("p90"), "max", F.round("zero_share", 9).alias("zero_share"))


@register("log_scale_sd", "SELECT round(stddev_samp(ln(1 + l_quantity)), 9) AS sd, round(var_samp(l_discount), 12) AS variance FROM lineitem")
def log_scale_sd(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(F.stddev_samp(F.log1p("l_quantity")), 9).alias("sd"), F.round(F.var_samp("l_discount"), 12).alias("variance"))


@register("weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS wmean FROM lineitem GROUP BY 1")
def weighted_mean(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(ag.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 9).alias("wmean"))


@register("conditional_shares", with_views("dirty") + " SELECT status, round(avg(CASE WHEN epoch(end_ts - start_ts) <= 864000 THEN 1.0 ELSE 0.0 END), 9) AS within_10d, count(CASE WHEN end_ts < start_ts THEN 1 END) AS reversed FROM dirty WHERE end_ts IS NOT NULL GROUP BY 1")
def conditional_shares(spark, sf):
    d = view(spark, sf, "dirty").where("end_ts is not null")
    return d.groupBy("status").agg(F.round(F.avg(F.expr("cast(timestampdiff(second, start_ts, end_ts) <= 864000 as double)")), 9).alias("within_10d"), F.count_if(F.expr("end_ts < start_ts")).alias("reversed"))


@register("grouped_by_many", "SELECT CASE WHEN grouping(c_mktsegment) = 0 THEN 'c_mktsegment' ELSE 'c_nationkey' END AS dim, CASE WHEN grouping(c_mktsegment) = 0 THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END AS level, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey))")
def grouped_by_many(spark, sf):
    return ag.grouped_by_many(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], [F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean")])


@register("min_max_normalise", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 100, 6) AS score FROM customer")
def min_max_normalise(spark, sf):
    return ag.min_max(table(spark, sf, "customer"), "c_acctbal", "score").select("c_custkey", F.round("score", 6).alias("score"))


@register("correlations", "WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem) SELECT round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r")
def correlations(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return li.agg(F.round(F.corr("x", "y"), 9).alias("pearson")).crossJoin(ag.spearman(li, "x", "y").select(F.round("spearman", 9).alias("spearman")))


@register("daily_counts_full_calendar", "WITH n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series((SELECT min(day) FROM n)::TIMESTAMP, (SELECT max(day) FROM n)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN n ON n.day = d")
def daily_counts(spark, sf):
    return ag.calendar_counts(table(spark, sf, "orders"), "o_orderdate").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@register("period_diagnostics", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT 'all' AS scope, n FROM d UNION ALL SELECT concat('q', quarter(day)), n FROM d) SELECT scope, k, round(avg(n), 6) AS mean, median(n) AS median, max(n) AS max, round(avg(CASE WHEN n > k THEN 1.0 ELSE 0.0 END), 9) AS over_k, round(avg(n) / k, 9) AS load FROM s CROSS JOIN (SELECT CAST(unnest([4, 6, 8]) AS INT) AS k) GROUP BY scope, k")
def period_diagnostics(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    s = d.select("n", F.explode(F.array(F.lit("all"), F.concat(F.lit("q"), F.quarter("day")))).alias("scope")).select("*", F.explode(F.array(*map(F.lit, (4, 6, 8)))).alias("k"))
    return s.groupBy("scope", "k").agg(F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.max("n").alias("max"), F.round(F.avg((F.col("n") > F.col("k")).cast("double")), 9).alias("over_k"), F.round(F.avg("n") / F.first("k"), 9).alias("load"))


@register("first_period_over_threshold", "WITH q AS (SELECT date_trunc('quarter', o_orderdate) AS q, count(*) / count(DISTINCT CAST(o_orderdate AS DATE)) AS mean FROM orders GROUP BY 1) SELECT strftime(min(q), '%Y-%m-%d') AS first_quarter FROM q WHERE mean > (SELECT avg(mean) FROM q)")
def first_period(spark, sf):
    q = table(spark, sf, "orders").groupBy(F.date_trunc("quarter", "o_orderdate").alias("q")).agg((F.count("*") / F.countDistinct(F.to_date("o_orderdate"))).alias("mean"))
    return q.crossJoin(q.agg(F.avg("mean").alias("m"))).where("mean > m").agg(F.date_format(F.min("q"), "yyyy-MM-dd").alias("first_quarter"))


@register("entries_per_group", "WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT median(n) AS p50, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS max, count(CASE WHEN n = 0 THEN 1 END) AS empty_groups FROM n")
def entries_per_group(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    all_ = table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0)
    return all_.agg(F.percentile("n", 0.5).alias("p50"), F.round(F.percentile("n", 0.99), 6).alias("p99"), F.max("n").alias("max"), F.count_if(F.col("n") == 0).alias("empty_groups"))


@register("occupancy_identity", with_views("ivals") + ", t AS (SELECT CAST(sum(epoch(end_ts - start_ts)) AS BIGINT) AS by_row, CAST(sum(epoch(end_ts - start_ts)) FILTER (cust % 100 <> 1) AS BIGINT) AS fewer FROM ivals) SELECT 'as it is' AS run, by_row, by_row AS by_group, true AS equal FROM t UNION ALL SELECT 'groups lost', by_row, fewer, false FROM t")
def occupancy_identity(spark, sf):
    """Occupied time by row and by group; with some groups lost they differ."""
    s = view(spark, sf, "ivals").selectExpr("cust", "timestampdiff(second, start_ts, end_ts) as s")
    groups = s.groupBy("cust").agg(F.sum("s").alias("g"))
    whole = s.agg(F.sum("s").alias("by_row"))
    check = lambda g, name: whole.crossJoin(g.agg(F.sum("g").alias("by_group"))).select(F.lit(name).alias("run"), "by_row", "by_group", (F.col("by_row") == F.col("by_group")).alias("equal"))
    return check(groups, "as it is").unionByName(check(groups.where("cust % 100 <> 1"), "groups lost"))


@register("table_fingerprint", "WITH h AS (SELECT CAST(('0x' || substr(md5(concat_ws('|', '', CAST(l_linenumber AS VARCHAR), CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), coalesce(l_returnflag, '~'))), 1, 15)) AS BIGINT) AS h FROM lineitem) SELECT count(*) AS rows, CAST(sum(h % 1000000007) AS BIGINT) AS hash_sum, bit_xor(h) AS hash_xor FROM h")
def table_fingerprint(spark, sf):
    return ag.fingerprint(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"))
