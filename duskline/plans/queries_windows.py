"""Ranking, trailing-window, queue and schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline import functions as fn
from duskline.operators import aggregates as ag
from duskline.operators import context as ct
from duskline.operators import dispatch as dp
from duskline.operators import scans
from duskline.operators import windows as wi
from duskline.plans.catalog import register
from duskline.plans.fixtures import view, with_views
from duskline.session import cut, table

_T = "CAST(floor(epoch_us(t) / 1000000.0) AS BIGINT)"


@register("rank_queue", with_views("jobs") + " SELECT id, region, CAST(row_number() OVER (PARTITION BY region ORDER BY score DESC, id) AS INT) AS rank, CAST(ceil(row_number() OVER (PARTITION BY region ORDER BY score DESC, id) / 7.0) AS INT) AS repair_day FROM jobs")
def rank_queue(spark, sf):
    return wi.rank_queue(view(spark, sf, "jobs"), [F.desc("score"), F.col("id")], 7, ["region"]).select("id", "region", "rank", "repair_day")


@register("queue_comparison", with_views("jobs") + ", q AS (SELECT region, CAST(ceil(row_number() OVER (PARTITION BY region ORDER BY arrival, id) / 7.0) AS INT) AS fday, CAST(ceil(row_number() OVER (PARTITION BY region ORDER BY score DESC, id) / 7.0) AS INT) AS sday, CAST(score AS DECIMAL(18,2)) AS s FROM jobs), f AS (SELECT region, fday AS day, sum(s) AS s FROM q GROUP BY ALL), g AS (SELECT region, sday AS day, sum(s) AS s FROM q GROUP BY ALL), c AS (SELECT f.region, f.day, CAST(sum(f.s) OVER (PARTITION BY f.region ORDER BY f.day) AS DOUBLE) AS fifo, CAST(sum(g.s) OVER (PARTITION BY f.region ORDER BY f.day) AS DOUBLE) AS scored FROM f JOIN g ON f.region = g.region AND f.day = g.day) SELECT region, day, round(scored - fifo, 2) AS gain, round(CASE WHEN fifo <> 0 THEN (scored - fifo) / fifo END, 9) AS gain_share FROM c")
def queue_comparison(spark, sf):
    j = view(spark, sf, "jobs").withColumn("s", F.col("score").cast("decimal(18,2)"))
    day = lambda order, name: wi.rank_queue(j, order, 7, ["region"]).groupBy("region", F.col("repair_day").alias("day")).agg(F.sum("s").alias(name))
    both = day([F.col("arrival"), F.col("id")], "f").join(day([F.desc("score"), F.col("id")], "g"), ["region", "day"])
    c = scans.scan(both, ["region"], [F.col("day")], {"fifo_sum": ("sum", F.col("f")), "scored_sum": ("sum", F.col("g"))})
    c = c.withColumn("fifo", F.col("fifo_sum").cast("double")).withColumn("scored", F.col("scored_sum").cast("double"))
    return c.select("region", "day", F.round(F.col("scored") - F.col("fifo"), 2).alias("gain"), F.round(F.expr("try_divide(scored - fifo, fifo)"), 9).alias("gain_share"))


@register("prior_count", with_views("pts") + f", e AS (SELECT user_id, event_id, {_T} AS s FROM pts) SELECT a.event_id, count(b.event_id) FILTER (b.s >= a.s - 86400) AS day_before, CAST(a.s - max(b.s) AS BIGINT) AS since_previous FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.s < a.s GROUP BY a.event_id, a.s")
def prior_count(spark, sf):
    p = view(spark, sf, "pts").select("user_id", "event_id", "t")
    return wi.since_previous(wi.prior_count(p, "user_id", "t", 1, "day_before"), "user_id", "t", "since_previous").select("event_id", "day_before", "since_previous")


@register("repeats_in_window", with_views("ivals") + " SELECT a.id, count(b.id) AS n FROM ivals a LEFT JOIN ivals b ON b.cust = a.cust AND b.id <> a.id AND b.start_ts >= a.start_ts - INTERVAL 10 DAY AND b.start_ts < a.end_ts WHERE a.end_ts IS NOT NULL GROUP BY a.id")
def repeats_in_window(spark, sf):
    iv = view(spark, sf, "ivals").select("cust", "id", "start_ts", "end_ts")
    asked = iv.where("end_ts is not null").withColumn("low", F.expr("start_ts - interval 10 days")).withColumn("own", F.expr("cast(start_ts < end_ts as long)"))
    n = scans.count_in_ranges(iv, asked, "cust", "start_ts", ["id", "own"], "low", "end_ts", "n")
    return n.select("id", (F.col("n") - F.col("own")).alias("n"))


# The intervals that do not end before they start; every region and the city (region null) on each day from the first start on.
_CONTEXT = (
    with_views("ivals") + ", v AS (SELECT region, start_ts AS s, end_ts AS e, epoch(end_ts - start_ts) AS sec FROM ivals WHERE end_ts IS NULL OR end_ts >= start_ts), "
    "g AS (SELECT DISTINCT region AS g FROM v UNION ALL SELECT NULL), d AS (SELECT g, CAST(TIMESTAMP '1970-01-01' + to_days(CAST(i AS INT)) AS TIMESTAMP) AS dt, CAST(i AS INT) AS day FROM g, (SELECT unnest(range(CAST(floor(epoch(min(s)) / 86400) AS BIGINT), CAST(floor(epoch(max(s)) / 86400) AS BIGINT) + 1)) AS i FROM v)), "
    "c AS (SELECT d.g AS region, d.day, count(s) FILTER (s >= dt - INTERVAL 20 DAY AND s < dt AND (e IS NULL OR e >= dt)) AS backlog, count(s) FILTER (s >= dt - INTERVAL 7 DAY AND s < dt) AS created, count(s) FILTER (e < dt AND e >= dt - INTERVAL 5 DAY) AS closed, "
    "avg((sec > 172800)::INT) FILTER (e < dt AND e >= dt - INTERVAL 5 DAY) AS slow_share, median(sec) FILTER (e < dt AND e >= dt - INTERVAL 5 DAY) / 3600 AS median_h FROM d JOIN v ON d.g IS NULL OR v.region = d.g GROUP BY d.g, d.day, d.dt)"
)
_SPANS = {"backlog_days": 20, "volume_days": 7, "closure_days": 5, "slow_hours": 48.0}


@register("trailing_context", _CONTEXT + " SELECT region, day, backlog, created, closed, round(slow_share, 9) AS slow_share, round(median_h, 6) AS median_h FROM c")
def trailing_context(spark, sf):
    c = ct.daily_context(view(spark, sf, "ivals"), **_SPANS)
    return c.select("region", "day", "backlog", "created", "closed", F.round("slow_share", 9).alias("slow_share"), F.round("median_h", 6).alias("median_h"))


@register(
    "interval_features",
    _CONTEXT + ", p AS (SELECT i.*, CAST(floor(epoch_us(start_ts) / 1000000.0) AS BIGINT) AS t, c_mktsegment AS segment, n_name AS nation, o_orderpriority AS priority, o_orderstatus AS status, CAST(c_nationkey AS VARCHAR) AS zone, cust % 51 AS district FROM ivals i JOIN orders ON o_orderkey = id JOIN customer ON c_custkey = cust JOIN nation ON n_nationkey = c_nationkey), "
    "h AS (SELECT a.id, count(b.id) FILTER (b.t >= a.t - 90 * 86400) AS n90, count(b.id) AS n365, (a.t - max(b.t)) / 86400.0 AS since FROM p a LEFT JOIN p b ON b.x_m = a.x_m AND b.y_m = a.y_m AND b.t < a.t AND b.t >= a.t - 365 * 86400 GROUP BY a.id, a.t) "
    "SELECT p.id, p.region, segment, nation, priority, status, zone, CAST(hour(start_ts) AS INT) AS hour, CAST(isodow(start_ts) - 1 AS INT) AS dow, CAST(month(start_ts) AS INT) AS month, (isodow(start_ts) >= 6)::INT AS is_weekend, (hour(start_ts) >= 8 AND hour(start_ts) < 18 AND isodow(start_ts) <= 5)::INT AS is_business_hours, "
    "p.x_m, p.y_m, 1 AS has_coords, district, n90 AS place_prior_90d, n365 AS place_prior_365d, round(since, 9) AS place_days_since_prev, c.backlog AS region_backlog, c.created AS region_created, c.closed AS region_closed, round(c.median_h, 6) AS region_median_h, round(z.median_h, 6) AS city_median_h, round(c.slow_share, 9) AS region_slow_share "
    "FROM p JOIN h USING (id) LEFT JOIN c ON c.region = p.region AND c.day = CAST(floor(epoch(start_ts) / 86400) AS INT) LEFT JOIN c z ON z.region IS NULL AND z.day = CAST(floor(epoch(start_ts) / 86400) AS INT)",
)
def interval_features(spark, sf):
    """Twenty-four features of each interval: six categories, eighteen numbers."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("c_nationkey").alias("zone"))
    out = ct.interval_features(view(spark, sf, "ivals").join(o, "id").join(c, "cust").withColumn("district", F.expr("cust % 51")), ["segment", "nation", "priority", "status", "zone"], ["district"], **_SPANS)
    return out.withColumns({c: F.round(c, d) for c, d in (("place_days_since_prev", 9), ("region_median_h", 6), ("city_median_h", 6), ("region_slow_share", 9))})


@register(
    "window_pressure",
    with_views("jobs") + ", k AS (SELECT TIMESTAMP '1992-01-01' + to_days(CAST(28 + 7 * i AS INT)) AS e, i FROM (SELECT unnest(range(0, 261)) AS i) WHERE TIMESTAMP '1992-01-01' + to_days(CAST(28 + 7 * i AS INT)) <= TIMESTAMP '1996-12-31'), "
    "r AS (SELECT region, i, avg(score) AS m FROM k JOIN jobs ON arrival > e - INTERVAL 28 DAY AND arrival <= e GROUP BY ALL HAVING count(*) >= 3), z AS (SELECT max(arrival) AS z FROM jobs), "
    "c AS (SELECT region, count(*) FILTER (arrival > z - INTERVAL 28 DAY) AS n, avg(score) FILTER (arrival > z - INTERVAL 28 DAY) AS m FROM jobs, z GROUP BY 1), d AS (SELECT region, n, CASE WHEN n >= 3 THEN m END AS mean FROM c), "
    "o AS (SELECT d.region, n, mean, count(r.m) AS refs, count(*) FILTER (r.m <= mean) AS below, max(r.m) AS top FROM d LEFT JOIN r USING (region) GROUP BY ALL) "
    "SELECT region, mean IS NOT NULL AND refs >= 10 AS available, n AS observations, round(mean, 4) AS mean, refs AS reference_windows, CASE WHEN mean IS NOT NULL AND refs >= 10 THEN round(100 * below / refs, 6) END AS percentile, CASE WHEN mean IS NOT NULL AND refs >= 10 THEN mean > top END AS above_range, "
    "CASE WHEN mean IS NULL OR refs < 10 THEN NULL WHEN 100 * below / refs >= 80 THEN 'High' WHEN 100 * below / refs >= 40 THEN 'Moderate' ELSE 'Low' END AS level FROM o",
)
def window_pressure(spark, sf):
    """The latest 28 days of each region against its weekly windows of five years."""
    w = ct.window_pressure(view(spark, sf, "jobs"), "region", "arrival", "score", "1992-01-01", "1996-12-31", least=3)
    return w.withColumn("mean", F.round("mean", 4)).withColumn("percentile", F.round("percentile", 6))


@register("percent_rank_avg", "SELECT l_orderkey, l_linenumber, round((rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) / count(*) OVER (), 9) AS pct FROM lineitem")
def percent_rank_avg(spark, sf):
    return wi.percent_rank_avg(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "pct").select("l_orderkey", "l_linenumber", F.round("pct", 9).alias("pct"))


@register("ecdf", "WITH r AS (SELECT o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderstatus = 'O') SELECT o_orderkey, round((SELECT count(*) FROM r WHERE r.v <= n.v) / (SELECT count(*) FROM r), 9) AS share FROM n")
def ecdf(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("v"))
    return wi.ecdf(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "v", "share").select("o_orderkey", F.round("share", 9).alias("share"))


@register("tiers", with_views("jobs") + " SELECT id, CASE WHEN r <= 0.1 * n THEN 'High' WHEN r <= 0.3 * n THEN 'Medium' ELSE 'Low' END AS by_rank, CASE WHEN score >= 400000 THEN 'High' WHEN score >= 200000 THEN 'Medium' ELSE 'Low' END AS by_value FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY region) AS n FROM jobs)")
def tiers(spark, sf):
    j = wi.group_share(view(spark, sf, "jobs"), ["region"], [F.desc("score"), F.col("id")], "r", "n")
    return j.select("id", wi.tier_by_rank(F.col("r"), F.col("n")).alias("by_rank"), wi.tier_by_value(F.col("score"), 400000, 200000).alias("by_value"))


@register("quantile_bin", "WITH e AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer) SELECT c_custkey, CAST(len(list_filter(q, lambda x: x < c_acctbal)) AS INT) AS bin FROM customer, e")
def quantile_bin(spark, sf):
    return wi.quantile_bin(table(spark, sf, "customer"), "c_acctbal", 4, "bin").select("c_custkey", "bin")


@register("two_way_demean", with_views("panel") + " SELECT unit, period, round(y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY period) + (SELECT avg(y) FROM panel), 6) AS r FROM panel")
def two_way_demean(spark, sf):
    return wi.two_way_demean(view(spark, sf, "panel"), "unit", "period", "y", "r").select("unit", "period", F.round("r", 6).alias("r"))


@register("fill_gaps", "WITH n AS (SELECT DISTINCT user_id, CAST(day(ts) AS INT) AS night FROM events), g AS (SELECT user_id, night, lead(night) OVER (PARTITION BY user_id ORDER BY night) AS nx FROM n) SELECT user_id, night FROM n UNION ALL SELECT user_id, CAST(unnest(range(night + 1, nx)) AS INT) FROM g WHERE nx - night > 1 AND nx - night - 1 <= 2")
def fill_gaps(spark, sf):
    return wi.fill_gaps(table(spark, sf, "events").select("user_id", F.day("ts").alias("night")), "user_id", "night", 2)


@register("first_row_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_row_per_group(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@register("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@register("filter_sort_page", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE lower(c_mktsegment) = 'machinery' AND contains(lower(c_name), '1')) AS matches FROM customer WHERE lower(c_mktsegment) = 'machinery' AND contains(lower(c_name), '1') ORDER BY c_acctbal DESC, c_custkey LIMIT 5 OFFSET 5")
def filter_sort_page(spark, sf):
    hits = table(spark, sf, "customer").where((F.lower("c_mktsegment") == "machinery") & F.contains(F.lower("c_name"), F.lit("1")))
    page = hits.orderBy(F.desc("c_acctbal"), "c_custkey").offset(5).limit(5).select("c_custkey", "c_name")
    return page.crossJoin(hits.agg(F.count("*").alias("matches")))


@register("must_keep_top_k", with_views("jobs") + " SELECT id FROM jobs ORDER BY CASE WHEN id % 97 = 0 THEN 0 ELSE 1 END, score DESC, id LIMIT (SELECT greatest(40, count(*) FILTER (id % 97 = 0)) FROM jobs)")
def must_keep_top_k(spark, sf):
    j = view(spark, sf, "jobs").withColumn("keep", F.expr("id % 97 = 0"))
    n = j.agg(F.count_if("keep").alias("n")).first().n
    return j.orderBy(F.desc("keep"), F.desc("score"), "id").limit(max(40, n)).select("id")


@register("time_to_fraction", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1), c AS (SELECT day, sum(v) OVER (ORDER BY day) / sum(v) OVER () AS f FROM d) SELECT strftime(min(day) FILTER (f >= 0.5), '%Y-%m-%d') AS half, strftime(min(day) FILTER (f >= 0.9), '%Y-%m-%d') AS most FROM c")
def time_to_fraction(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    c = ag.running_total(d, "day", "v", "cum").crossJoin(d.agg(F.sum("v").alias("total"))).withColumn("f", F.col("cum") / F.col("total"))
    day = lambda f: F.date_format(F.min(F.when(F.col("f") >= f, F.col("day"))), "yyyy-MM-dd")
    return c.agg(day(0.5).alias("half"), day(0.9).alias("most"))


@register("curve_down_sample", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS c FROM d) SELECT strftime(day, '%Y-%m-%d') AS day, n FROM r WHERE i IN (SELECT CAST(round_even(k * (c - 1) / 19.0, 0) AS BIGINT) FROM (SELECT unnest(range(20)) AS k))")
def curve_down_sample(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    r = ag.running_total(d, "day", "one", "pos").withColumn("i", F.col("pos") - 1)
    at = d.agg(F.count("*").alias("c")).select(F.explode(F.expr("transform(sequence(0, 19), k -> cast(rint(k * (c - 1) / 19.0D) as bigint))")).alias("i")).distinct()
    return r.join(F.broadcast(at), "i").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def _hash(seed: str, column: str) -> str:
    """The SQL of ``functions.text_hash``."""
    return f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', CAST({column} AS VARCHAR))), 1, 15)) AS BIGINT)"


@register("hash_order", f"SELECT c_custkey, row_number() OVER (ORDER BY {_hash('11', 'c_custkey')}) AS place FROM customer")
def hash_order(spark, sf):
    """A seeded permutation of the customers: one global place each."""
    c = table(spark, sf, "customer").select("c_custkey", fn.text_hash("c_custkey", seed="11").alias("h"), F.lit(1).alias("one"))
    return ag.running_total(c, "h", "one", "place").select("c_custkey", "place")


@register("scenario_clones", f"WITH o AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders), q AS (SELECT quantile_cont(o_totalprice, 0.8) AS q FROM o), c AS (SELECT o_orderkey, o_totalprice, CAST(day + CAST({_hash('5', 'o_orderkey')} % 11 - 5 AS INTEGER) AS DATE) AS day, true AS clone FROM o, q WHERE o_totalprice > q AND {_hash('3', 'o_orderkey')} % 2 = 0) SELECT o_orderkey, o_totalprice, strftime(day, '%Y-%m-%d') AS day, clone FROM (SELECT *, false AS clone FROM o UNION ALL SELECT * FROM c)")
def scenario_clones(spark, sf):
    """Half of the orders above the 80th price percentile again, up to five days earlier or later, by hash."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    q = ag.exact_quantiles(o, "o_totalprice", [0.8]).select(F.get("q", F.lit(0)).alias("q"))
    top = o.crossJoin(F.broadcast(q)).where("o_totalprice > q").where(fn.text_hash("o_orderkey", seed="3") % 2 == 0).drop("q")
    moved = top.withColumn("day", F.date_add("day", (fn.text_hash("o_orderkey", seed="5") % 11 - 5).cast("int")))
    return o.withColumn("clone", F.lit(False)).unionByName(moved.withColumn("clone", F.lit(True))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("latest_n", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25")
def latest_n(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "user_id")


@register("queue_view", with_views("jobs") + ", q AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY arrival, id) AS INT) AS rank FROM jobs) SELECT q.id, q.rank, o_orderpriority FROM q JOIN orders ON o_orderkey = q.id WHERE region = 2 ORDER BY rank LIMIT 20 OFFSET 20")
def queue_view(spark, sf):
    q = wi.rank_queue(view(spark, sf, "jobs").where("region = 2"), [F.col("arrival"), F.col("id")], 7, ["region"])
    page = q.orderBy("rank").offset(20).limit(20)
    return page.join(table(spark, sf, "orders"), F.col("id") == F.col("o_orderkey")).select("id", "rank", "o_orderpriority")


_FIFO = (
    with_views("jobs") + ", k AS (SELECT id, region, CAST(greatest(floor(epoch_us(arrival - TIMESTAMP '1995-01-01 08:00:00') / 86400000000.0) + 1, 0) AS BIGINT) AS known_day, row_number() OVER (ORDER BY arrival, id) - 1 AS r FROM jobs), "
    "s AS (SELECT *, CAST(floor((r + max(6 * known_day - r) OVER (ORDER BY r)) / 6.0) AS BIGINT) AS service_day FROM k)"
)


def _fifo(spark, sf, k: int = 6):
    return wi.fifo_schedule(view(spark, sf, "jobs"), k, "1995-01-01 08:00:00")


@register("fifo_schedule", _FIFO + " SELECT id, known_day, service_day FROM s")
def fifo_schedule(spark, sf):
    return _fifo(spark, sf).select("id", "known_day", "service_day")


@register("backlog_series", _FIFO + ", d AS (SELECT unnest(range(0, 1 + (SELECT max(service_day) FROM s))) AS day), x AS (SELECT day, (SELECT count(*) FROM s WHERE known_day = day) AS arrived, (SELECT count(*) FROM s WHERE service_day = day) AS selected FROM d) SELECT day, arrived, selected, CAST(sum(arrived - selected) OVER (ORDER BY day) AS BIGINT) AS waiting FROM x")
def backlog_series(spark, sf):
    s = _fifo(spark, sf)
    days = s.agg(F.max("service_day").alias("m")).select(F.explode(F.expr("sequence(0L, m)")).alias("day"))
    count = lambda c, n: s.groupBy(F.col(c).alias("day")).agg(F.count("*").alias(n))
    x = days.join(count("known_day", "arrived"), "day", "left").join(count("service_day", "selected"), "day", "left").fillna(0).withColumn("net", F.col("arrived") - F.col("selected"))
    return ag.running_total(x, "day", "net", "waiting").select("day", "arrived", "selected", "waiting")


@register("wait_metrics", _FIFO + ", w AS (SELECT region, service_day - known_day AS w FROM s) SELECT region, round(avg(w), 6) AS mean, median(w) AS median, round(quantile_cont(w, 0.9), 6) AS p90, max(w) AS max, round(avg(CASE WHEN w <= 7 THEN 1.0 ELSE 0.0 END), 9) AS within_7, round(avg(CASE WHEN w <= 30 THEN 1.0 ELSE 0.0 END), 9) AS within_30 FROM w GROUP BY 1")
def wait_metrics(spark, sf):
    w = _fifo(spark, sf).withColumn("w", F.col("service_day") - F.col("known_day"))
    share = lambda d: F.round(F.avg((F.col("w") <= d).cast("double")), 9)
    return w.groupBy("region").agg(F.round(F.avg("w"), 6).alias("mean"), F.percentile("w", 0.5).alias("median"), F.round(F.percentile("w", 0.9), 6).alias("p90"), F.max("w").alias("max"), share(7).alias("within_7"), share(30).alias("within_30"))


_QUARTERS = "z AS (SELECT min(q) AS split FROM (SELECT date_trunc('quarter', arrival) AS q, count(*) AS n FROM jobs GROUP BY 1) WHERE n / date_diff('day', q, q + INTERVAL 3 MONTH) > {c})"
_WAITS = "round(avg(w), 6) AS mean, round(median(w), 6) AS median, round(quantile_cont(w, 0.9), 6) AS p90, round(max(w), 6) AS max, round(avg((w <= 7)::INT), 9) AS within_7, round(avg((w <= 30)::INT), 9) AS within_30"


def _split(spark, sf):
    """The jobs and the first quarter that is busier than all in the mean by a twelfth."""
    j = view(spark, sf, "jobs")
    return j, dp.overload_start(j, 1.08 * j.count() / 2400)


@register("regime_waits", _FIFO + ", " + _QUARTERS.format(c="(1.08 * (SELECT count(*) FROM jobs) / 2400)") + f", w AS (SELECT CAST(k.region AS VARCHAR) AS region, epoch(TIMESTAMP '1995-01-01 08:00:00' + to_days(CAST(service_day AS INT)) - arrival) / 86400 AS w, CASE WHEN split IS NOT NULL AND arrival >= split THEN 'overload' ELSE 'stable' END AS regime FROM s k JOIN jobs USING (id), z), x AS (SELECT * FROM w UNION ALL SELECT region, w, 'all' FROM w) SELECT regime, region, count(*) AS n, {_WAITS} FROM x GROUP BY GROUPING SETS ((regime, region), (regime))")
def regime_waits(spark, sf):
    j, split = _split(spark, sf)
    r = dp.wait_report(wi.fifo_schedule(j, 6, "1995-01-01 08:00:00"), "1995-01-01 08:00:00", split)
    return r.select("regime", "region", "n", *[F.round(c, d).alias(c) for c, d in (("mean", 6), ("median", 6), ("p90", 6), ("max", 6), ("within_7", 9), ("within_30", 9))])


@register("queue_report", _FIFO + ", d AS (SELECT unnest(range(0, 1 + (SELECT max(service_day) FROM s))) AS day), n AS (SELECT d.day, coalesce(a.n, 0) AS arrived, coalesce(b.n, 0) AS selected FROM d LEFT JOIN (SELECT known_day, count(*) AS n FROM s GROUP BY 1) a ON known_day = day LEFT JOIN (SELECT service_day, count(*) AS n FROM s GROUP BY 1) b ON service_day = day), x AS (SELECT day, selected, sum(arrived - selected) OVER (ORDER BY day) AS waiting FROM n) SELECT round(avg(waiting) FILTER (day < 800), 6) AS backlog_mean, CAST(max(waiting) FILTER (day < 800) AS BIGINT) AS backlog_max, CAST(max_by(waiting, day) FILTER (day < 800) AS BIGINT) AS backlog_end, round(avg(selected) FILTER (day < 800), 6) AS throughput, round(sum(selected) FILTER (day < 800) / (6.0 * count(*) FILTER (day < 800)), 9) AS utilisation, count(*) FILTER (day >= 800) AS drain_days FROM x")
def queue_report(spark, sf):
    r = dp.queue_report(backlog_series(spark, sf), 6, 800)
    return r.select(*[F.round(c, 9 if c == "utilisation" else 6).alias(c) if c in ("backlog_mean", "throughput", "utilisation") else c for c in r.columns])


@register("capacity_sweep", with_views("jobs") + ", k AS (SELECT c, CAST(greatest(floor(epoch_us(arrival - TIMESTAMP '1995-01-01 08:00:00') / 86400000000.0) + 1, 0) AS BIGINT) AS d, row_number() OVER (PARTITION BY c ORDER BY arrival, id) - 1 AS r FROM jobs, (SELECT CAST(unnest([5, 6, 7, 8, 9]) AS INT) AS c)), s AS (SELECT c, CAST(floor((r + max(c * d - r) OVER (PARTITION BY c ORDER BY r)) / c) AS BIGINT) - d AS w FROM k) SELECT c AS capacity, round(avg(w), 6) AS mean, max(w) AS max, round(avg(CASE WHEN w <= 7 THEN 1.0 ELSE 0.0 END), 9) AS within_7, avg(CASE WHEN w <= 7 THEN 1.0 ELSE 0.0 END) >= 0.9 AS meets FROM s GROUP BY 1")
def capacity_sweep(spark, sf):
    from functools import reduce

    w = reduce(lambda a, b: a.unionByName(b), [_fifo(spark, sf, k).select(F.lit(k).alias("capacity"), (F.col("service_day") - F.col("known_day")).alias("w")) for k in (5, 6, 7, 8, 9)])
    in7 = F.avg((F.col("w") <= 7).cast("double"))
    return w.groupBy("capacity").agg(F.round(F.avg("w"), 6).alias("mean"), F.max("w").alias("max"), F.round(in7, 9).alias("within_7"), (in7 >= 0.9).alias("meets"))


@register("capacity_rule", with_views("jobs") + " SELECT CAST(ceil(count(*) / (date_diff('day', min(CAST(arrival AS DATE)), max(CAST(arrival AS DATE))) + 1) / 0.9) AS BIGINT) AS k FROM jobs")
def capacity_rule(spark, sf):
    return view(spark, sf, "jobs").agg(F.ceil(F.count("*") / (F.datediff(F.max(F.to_date("arrival")), F.min(F.to_date("arrival"))) + 1) / 0.9).alias("k"))


@register("quota_topk", with_views("jobs") + ", q AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, id) <= 12 AS q FROM jobs), r AS (SELECT id FROM q WHERE NOT q AND score > 0 ORDER BY score DESC, id LIMIT 40) SELECT id, region FROM q WHERE q OR id IN (SELECT id FROM r)")
def quota_topk(spark, sf):
    return dp.quota_topk(view(spark, sf, "jobs"), "id", "score", "region", 100, 12).where("selected").select("id", "region")


_PLAN = (
    with_views("jobs") + ", n AS (SELECT region, count(*) AS candidates, CASE region WHEN 3 THEN 30 ELSE CAST(floor(0.5 * 160 * count(*) / (SELECT count(*) FROM jobs) + 1e-9) AS BIGINT) END AS quota FROM jobs GROUP BY 1), "
    "q AS (SELECT id, region, score, quota, row_number() OVER (PARTITION BY region ORDER BY score DESC, arrival, id) AS own, row_number() OVER (ORDER BY score DESC, arrival, id) AS g FROM jobs JOIN n USING (region)), "
    "r AS (SELECT id FROM q WHERE own > quota ORDER BY g LIMIT (SELECT 160 - sum(quota) FROM n)), p AS (SELECT *, own <= quota OR id IN (SELECT id FROM r) AS selected, g <= 160 AS unconstrained FROM q)"
)
_SUMS = "count(*) AS candidates, count(*) FILTER (selected) AS selected, count(*) FILTER (unconstrained) AS unconstrained, CAST(sum(CAST(score AS DECIMAL(28,6))) FILTER (selected) AS DOUBLE) AS benefit, CAST(coalesce(sum(CAST(score AS DECIMAL(28,6))) FILTER (unconstrained), 0) AS DOUBLE) AS unconstrained_benefit"


def _plan(spark, sf):
    """A budget of 400 for jobs of 2.5 each, a quota of 30 set for one region."""
    return dp.plan(view(spark, sf, "jobs").withColumn("region", F.col("region").cast("string")), "id", "score", "region", "arrival", 400, 2.5, overrides={"3": 30})


@register("plan_summary", _PLAN + f" SELECT CAST(region AS VARCHAR) AS region, {_SUMS}, any_value(quota) AS quota, count(*) FILTER (selected) >= any_value(quota) AS compliant FROM p GROUP BY region UNION ALL SELECT NULL, {_SUMS}, (SELECT CAST(sum(quota) AS BIGINT) FROM n), count(*) FILTER (selected) >= (SELECT sum(quota) FROM n) FROM p")
def plan_summary(spark, sf):
    return _plan(spark, sf)[1]


@register("dispatch_plan", _PLAN + " SELECT id, CAST(region AS VARCHAR) AS region, selected, unconstrained FROM p")
def dispatch_plan(spark, sf):
    return _plan(spark, sf)[0].select("id", "region", "selected", "unconstrained")


@register("replay_table", _FIFO + " SELECT s.id, s.known_day, s.service_day, CAST((o_custkey * 7919) % 5000 AS DOUBLE) AS x_m FROM s JOIN orders ON o_orderkey = s.id")
def replay_table(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey as id", "cast((o_custkey * 7919) % 5000 as double) as x_m")
    return _fifo(spark, sf).join(o, "id").select("id", "known_day", "service_day", "x_m")


@register("queue_identity_check", _FIFO + ", d AS (SELECT unnest(range(1, 1 + (SELECT max(service_day) FROM s))) AS day) SELECT day FROM d WHERE (day % 50 = 0) <> ((day - 1) % 50 = 0)")
def queue_identity_check(spark, sf):
    """Days that do not follow from the day before, in a series of which every fiftieth day is one too high."""
    x = backlog_series(spark, sf).withColumn("waiting", F.expr("waiting + cast(day % 50 = 0 as int)"))
    before = x.select((F.col("day") + 1).alias("day"), F.col("waiting").alias("was"))
    return x.join(before, "day").where("waiting <> was + arrived - selected").select("day")


@register("trailing_mean_level", "WITH d AS (SELECT event_type, CAST(TIMESTAMP '2024-01-01' + to_days(CAST(i AS INT)) AS TIMESTAMP) AS w_end, i FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range(7, 31)) AS i)), m AS (SELECT d.event_type, d.i, avg(e.value) AS mean, count(*) AS n FROM d JOIN events e ON e.event_type = d.event_type AND e.ts > d.w_end - INTERVAL 7 DAY AND e.ts <= d.w_end GROUP BY ALL), r AS (SELECT a.event_type, a.i, a.mean, count(b.i) FILTER (b.mean <= a.mean) / count(b.i) AS pct FROM m a JOIN m b ON b.event_type = a.event_type AND b.i <= a.i GROUP BY ALL) SELECT event_type, CAST(i AS INT) AS day, round(mean, 6) AS mean, round(pct, 6) AS pct, CASE WHEN pct >= 0.8 THEN 'High' WHEN pct >= 0.4 THEN 'Moderate' ELSE 'Low' END AS level FROM r")
def trailing_mean_level(spark, sf):
    e = table(spark, sf, "events").select("event_type", "ts", "value")
    # Each event lies in seven window ends; emitting those turns the range join into an aggregation.
    first = F.ceil(F.expr("timestampdiff(microsecond, timestamp_ntz '2024-01-01 00:00:00', ts)") / 8.64e10).cast("int")
    # Computed once: a second evaluation may add in another order, and a mean must not differ from itself in its last bit.
    m = cut(e.withColumn("day", F.explode(F.sequence(first, first + 6))).where("day between 7 and 30").groupBy("event_type", "day").agg(F.avg("value").alias("mean")))
    b = m.select("event_type", F.col("day").alias("bd"), F.col("mean").alias("bm"))
    r = m.join(b, "event_type").where("bd <= day").groupBy("event_type", "day", "mean").agg((F.count_if(F.expr("bm <= mean")) / F.count("*")).alias("pct"))
    level = F.when(F.col("pct") >= 0.8, "High").when(F.col("pct") >= 0.4, "Moderate").otherwise("Low")
    return r.select("event_type", "day", F.round("mean", 6).alias("mean"), F.round("pct", 6).alias("pct"), level.alias("level"))
