"""Matching, estimation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.operators import estimate as es
from duskline.operators import evaluate as ev
from duskline.operators import fixed_effects as fx
from duskline.operators import matching as mt
from duskline.operators import quality_checks as qc
from duskline.operators import spatial as sp
from duskline.operators import windows as wi
from duskline.plans.catalog import register
from duskline.plans.fixtures import view, with_views
from duskline.session import cut, table


def _closed(spark, sf):
    return view(spark, sf, "ivals").where("end_ts is not null").select("id", "x_m", "y_m", "start_ts", "end_ts", "region")


_LINKS = with_views("ivals") + ", l AS (SELECT a.id AS a, b.id AS b FROM ivals a JOIN ivals b ON a.id < b.id AND sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)) <= 25 AND a.start_ts <= b.end_ts AND a.end_ts >= b.start_ts WHERE a.end_ts IS NOT NULL AND b.end_ts IS NOT NULL)"
# Least labels by rounds: each node takes the least label around it, then the label of its label. Twelve rounds are more than
# the longest chain needs; a recursive closure is quadratic in the largest episode.
_ROUNDS = "".join(f", h{i} AS MATERIALIZED (SELECT c.id, least(c.c, coalesce(min(n.c), c.c)) AS c FROM c{i - 1} c LEFT JOIN u ON u.a = c.id LEFT JOIN c{i - 1} n ON n.id = u.b GROUP BY c.id, c.c), c{i} AS MATERIALIZED (SELECT h.id, least(h.c, j.c) AS c FROM h{i} h JOIN h{i} j ON j.id = h.c)" for i in range(1, 13))
_COMP = _LINKS + ", u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), c0 AS MATERIALIZED (SELECT id, id AS c FROM ivals WHERE end_ts IS NOT NULL)" + _ROUNDS + ", m AS MATERIALIZED (SELECT id, c AS episode FROM c12)"


@register("link_pairs", _LINKS + " SELECT a, b FROM l")
def link_pairs(spark, sf):
    return mt.link_pairs(_closed(spark, sf), 25)


@register("episodes", _COMP + " SELECT id, episode FROM m")
def episodes(spark, sf):
    return mt.episodes(_closed(spark, sf), 25)


@register("episode_table", _COMP + " SELECT episode, min_by(id, ROW(start_ts, id)) AS head, count(*) AS size, CAST(epoch(max(end_ts) - min(start_ts)) AS BIGINT) AS seconds, round(sqrt(pow(max(x_m) - min(x_m), 2) + pow(max(y_m) - min(y_m), 2)), 6) AS span_m FROM m JOIN ivals USING (id) GROUP BY 1")
def episode_table(spark, sf):
    iv = _closed(spark, sf)
    t = mt.episode_table(iv, mt.episodes(iv, 25))
    return t.select("episode", "head", "size", F.expr("timestampdiff(second, first_start, last_end)").alias("seconds"), F.round("span_m", 6).alias("span_m"))


@register("flag_chained", _COMP + ", t AS (SELECT episode, count(*) AS size, epoch(max(end_ts) - min(start_ts)) / 86400 AS days FROM m JOIN ivals USING (id) GROUP BY 1) SELECT episode, size FROM t WHERE days > 4.5 ORDER BY size DESC, episode LIMIT 10")
def flag_chained(spark, sf):
    iv = _closed(spark, sf)
    t = mt.episode_table(iv, mt.episodes(iv, 25)).where("timestampdiff(second, first_start, last_end) / 86400 > 4.5")
    return t.orderBy(F.desc("size"), "episode").limit(10).select("episode", "size")


@register("artifact_flag", with_views("ivals") + ", n AS (SELECT x_m, y_m, count(*) AS n FROM ivals GROUP BY ALL), q AS (SELECT n AS q FROM n QUALIFY row_number() OVER (ORDER BY n) = CAST(ceil(0.9 * ((SELECT count(*) FROM n) - 1)) AS BIGINT) + 1) SELECT x_m, y_m, n FROM n WHERE n > (SELECT q FROM q)")
def artifact_flag(spark, sf):
    from duskline.operators.aggregates import quantile_higher

    n = view(spark, sf, "ivals").groupBy("x_m", "y_m").agg(F.count("*").alias("n"))
    return n.crossJoin(quantile_higher(n, "n", 0.9)).where("n > q_value").drop("q_value")


@register("analysis_windows", with_views("ivals") + " SELECT id, CAST(epoch(start_ts - INTERVAL 14 DAY) AS BIGINT) AS b_start, CAST(epoch(start_ts) AS BIGINT) AS b_end, CAST(epoch(end_ts + INTERVAL 7 DAY) AS BIGINT) AS w_end FROM ivals WHERE end_ts IS NOT NULL")
def analysis_windows(spark, sf):
    s = "timestampdiff(second, timestamp_ntz '1970-01-01 00:00:00', {})"
    return _closed(spark, sf).selectExpr("id", s.format("start_ts - interval 14 days") + " as b_start", s.format("start_ts") + " as b_end", s.format("end_ts + interval 7 days") + " as w_end")


_PROFILE = "p AS (SELECT o_custkey AS id, o_custkey % 4 AS region, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT o_orderpriority) AS DOUBLE) AS k FROM orders GROUP BY ALL), s AS (SELECT stddev_samp(ln(1 + n)) AS sn, stddev_samp(ln(1 + k)) AS sk FROM p), z AS (SELECT t.id AS t, p.id AS c, sqrt(pow((ln(1 + t.n) - ln(1 + p.n)) / sn, 2) + pow((ln(1 + t.k) - ln(1 + p.k)) / sk, 2)) AS z FROM p t JOIN p ON t.region = p.region AND t.id <> p.id, s WHERE abs(ln(1 + t.n) - ln(1 + p.n)) <= 0.5 * sn AND abs(ln(1 + t.k) - ln(1 + p.k)) <= 0.5 * sk)"


def _profiles(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("n"), F.countDistinct("o_orderpriority").cast("double").alias("k")).withColumn("region", F.col("id") % 4)


@register("caliper_filter", "WITH " + _PROFILE + " SELECT t, count(*) AS n FROM z GROUP BY 1")
def caliper_filter(spark, sf):
    return mt.caliper_best(_profiles(spark, sf), ["n", "k"]).where("n > 0").select(F.col("id").alias("t"), "n")


@register("match_distance", "WITH " + _PROFILE + " SELECT t, c, round(z, 6) AS z FROM z QUALIFY row_number() OVER (PARTITION BY t ORDER BY round(z, 9), c) = 1")
def match_distance(spark, sf):
    return mt.caliper_best(_profiles(spark, sf), ["n", "k"]).where("c is not null").select(F.col("id").alias("t"), "c", F.round("z", 6).alias("z"))


# Every closed interval is a treatment. Its controls are other places with intervals within 200 m (band), of these the ones
# with no interval of their own meanwhile (clean), of these the ones with about as many intervals (caliper).
_STAGES = (
    with_views("ivals") + ", v AS (SELECT *, CAST(x_m * 10000 + y_m AS BIGINT) AS own FROM ivals WHERE end_ts IS NOT NULL), s AS (SELECT own AS site, x_m AS sx, y_m AS sy, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT v.*, s.n AS tn FROM v JOIN s ON site = own), sd AS (SELECT stddev_samp(ln(1 + tn)) AS sd FROM t), "
    "b AS (SELECT t.id AS treatment, site, abs(ln(1 + tn) - ln(1 + n)) <= 0.5 * sd AS alike, start_ts, end_ts FROM t JOIN s ON site <> own AND sqrt((x_m - sx) * (x_m - sx) + (y_m - sy) * (y_m - sy)) <= 200, sd), "
    "d AS (SELECT DISTINCT b.treatment, b.site FROM b JOIN v ON v.own = b.site AND v.start_ts <= b.end_ts AND v.end_ts >= b.start_ts), "
    "c AS (SELECT b.*, d.site IS NULL AS clean FROM b LEFT JOIN d ON d.treatment = b.treatment AND d.site = b.site), "
    "k AS (SELECT t.id AS treatment, count(c.site) AS band, count(c.site) FILTER (clean) AS clean, count(c.site) FILTER (clean AND alike) AS caliper FROM t LEFT JOIN c ON c.treatment = t.id GROUP BY 1)"
)
_MICROS = "timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', {})"


def _treatments(spark, sf):
    v = _closed(spark, sf).withColumn("own", F.expr("cast(x_m * 10000 + y_m as bigint)"))
    return v.join(v.groupBy("own").agg(F.count("*").alias("tn")), "own").select(F.col("id").alias("treatment"), F.col("id").alias("ord"), "own", "tn", "x_m", "y_m", "region", F.expr(_MICROS.format("start_ts")).alias("w_start"), F.expr(_MICROS.format("end_ts")).alias("w_end"))


def _stages(spark, sf):
    """Treatments and their candidates after each stage."""
    t = cut(_treatments(spark, sf))
    sites = t.groupBy(F.col("own").alias("site"), F.col("x_m").alias("bx"), F.col("y_m").alias("by")).agg(F.count("*").alias("n"))
    sd = t.agg(F.stddev_samp(F.log1p("tn")).alias("sd"))
    places = t.select("own", "x_m", "y_m").distinct()
    near = cut(sp.radius_join(places, sites, 200).where("site <> own").select("own", "site", "n", "distance"))
    # Treatments of a place share its band, so only the number is kept of it.
    band = t.join(near.groupBy("own").agg(F.count("*").alias("n")), "own").select("treatment", "n")
    free = mt.open_candidates(t.select("treatment", "ord", "own", "tn", "w_start", "w_end"), near, t.select(F.col("own").alias("site"), "w_start", "w_end"), mt.DAY)
    clean = cut(free.select("treatment", "ord", "site", F.struct("distance", "site").alias("pref"), "w_start", "w_end", F.abs(F.log1p("tn") - F.log1p("n")).alias("gap")))
    return t, [("band", band), ("clean", clean), ("caliper", clean.crossJoin(F.broadcast(sd)).where("gap <= 0.5 * sd").drop("sd"))]


@register("candidate_stages", _STAGES + " SELECT * FROM k")
def candidate_stages(spark, sf):
    """Nested candidate counts of every treatment."""
    t, stages = _stages(spark, sf)
    none = stages[-1][1].limit(0).select("treatment", "site")
    return mt.match_reasons(t, stages, none).select("treatment", "band", "clean", "caliper")


def _matched(spark, sf, reuse: bool = True):
    t, stages = _stages(spark, sf)
    return t, stages, cut(mt.greedy_match(stages[-1][1], reuse).select("treatment", "site"))


@register("greedy_match")
def greedy_match(spark, sf):
    """Windows of all treatments at their own sites are taken beforehand (the stage ``clean``)."""
    return _matched(spark, sf)[2]


@register("greedy_match_once")
def greedy_match_once(spark, sf):
    return _matched(spark, sf, reuse=False)[2]


@register("match_reason")
def match_reason(spark, sf):
    """Nested candidate counts, how many better candidates were blocked, and the first reason why there is no control."""
    t, stages, m = _matched(spark, sf)
    return mt.match_reasons(t, stages, m)


@register("nested_counts", _STAGES + ", e AS (SELECT * REPLACE (CASE WHEN treatment % 50 = 0 THEN clean + 1 ELSE caliper END AS caliper) FROM k) SELECT treatment, 'caliper' AS stage FROM e WHERE caliper > clean UNION ALL SELECT treatment, 'clean' FROM e WHERE clean > band")
def nested_counts(spark, sf):
    """Rows whose counts do not shrink from stage to stage, in counts of which one in fifty is spoilt."""
    t, stages = _stages(spark, sf)
    k = mt.match_reasons(t, stages, stages[-1][1].limit(0).select("treatment", "site"))
    return qc.not_nested(k.withColumn("caliper", F.expr("case when treatment % 50 = 0 then clean + 1 else caliper end")), "treatment", ["band", "clean", "caliper"])


def _pair_rows(spark, sf):
    """Wide matched pairs: both places, the windows, and how often each control serves."""
    t, _, m = _matched(spark, sf)
    place = t.select(F.col("own").alias("site"), F.col("x_m").alias("c_x"), F.col("y_m").alias("c_y"), F.col("tn").alias("c_n")).distinct()
    return mt.assemble_pairs(m, t.withColumnsRenamed({"x_m": "t_x", "y_m": "t_y", "tn": "t_n"}), place)


@register("assemble_pairs")
def assemble_pairs(spark, sf):
    return _pair_rows(spark, sf)


@register("balance_table", "WITH l AS (SELECT l_orderkey % 2 AS role, variable, v FROM (SELECT l_orderkey, l_quantity AS q, l_discount AS d FROM lineitem) UNPIVOT (v FOR variable IN (q, d))), m AS (SELECT variable, avg(v) FILTER (role = 1) AS mt, avg(v) FILTER (role = 0) AS mc, var_samp(v) FILTER (role = 1) AS vt, var_samp(v) FILTER (role = 0) AS vc FROM l GROUP BY 1) SELECT variable, round(mt, 6) AS mean_t, round(mc, 6) AS mean_c, round((mt - mc) / sqrt((vt + vc) / 2), 6) AS smd, round(vt / vc, 6) AS variance_ratio, abs((mt - mc) / sqrt((vt + vc) / 2)) < 0.1 AND vt / vc BETWEEN 0.5 AND 2 AS passes FROM m")
def balance_table(spark, sf):
    b = mt.balance_table(table(spark, sf, "lineitem").selectExpr("l_orderkey % 2 as role", "l_quantity as q", "l_discount as d"), "role", ["q", "d"])
    return b.select("variable", *[F.round(c, 6).alias(c) for c in ("mean_t", "mean_c", "smd", "variance_ratio")], "passes")


# Estimation -------------------------------------------------------------------------------------------------------------

_PD = with_views("panel") + ", d AS (SELECT pair, max(cluster) AS cluster, sum(CASE WHEN treatment = 1 AND period = 2 THEN y WHEN treatment = 1 AND period = 0 THEN -y WHEN treatment = 0 AND period = 2 THEN -y WHEN treatment = 0 AND period = 0 THEN y END) AS d, sum(CASE WHEN treatment = 1 AND period = 1 THEN y WHEN treatment = 1 AND period = 0 THEN -y WHEN treatment = 0 AND period = 1 THEN -y WHEN treatment = 0 AND period = 0 THEN y END) AS e FROM panel GROUP BY pair HAVING count(DISTINCT treatment) = 2)"


def _paired(spark, sf):
    p = view(spark, sf, "panel")
    term = lambda a: F.sum(F.expr(f"case when period = {a} then 1 when period = 0 then -1 end * y * (2 * treatment - 1)"))
    return p.groupBy("pair").agg(F.max("cluster").alias("cluster"), term(2).alias("d"), term(1).alias("e"), F.countDistinct("treatment").alias("sides")).where("sides = 2").drop("sides")


@register("paired_difference", _PD + " SELECT pair, d, e FROM d")
def paired_difference(spark, sf):
    return _paired(spark, sf).select("pair", "d", "e")


@register("mean_cluster_se", _PD + ", m AS (SELECT avg(d) AS mu, count(*) AS n FROM d), s AS (SELECT cluster, sum(d - mu) AS s FROM d, m GROUP BY 1) SELECT round(mu, 6) AS estimate, n, count(*) AS clusters, round(sqrt(count(*) / (count(*) - 1) * sum(s * s)) / n, 6) AS se FROM s, m GROUP BY mu, n")
def mean_cluster_se(spark, sf):
    return es.mean_cluster_se(_paired(spark, sf), "d", "cluster").select(F.round("estimate", 6).alias("estimate"), "n", "clusters", F.round("se", 6).alias("se"))


@register("net_effect", _PD + ", m AS (SELECT avg(d) AS md, avg(e) AS me, count(*) AS n FROM d), s AS (SELECT cluster, sum(d - md + e - me) AS s FROM d, m GROUP BY 1) SELECT round(md + me, 6) AS net, round(sqrt(count(*) / (count(*) - 1) * sum(s * s)) / n, 6) AS net_se FROM s, m GROUP BY md, me, n")
def net_effect(spark, sf):
    return es.net_effect(_paired(spark, sf), "d", "e", "cluster").select(F.round("net", 6).alias("net"), F.round("net_se", 6).alias("net_se"))


@register("subgroup_estimates", _PD + ", g AS (SELECT *, pair % 3 AS third FROM d), m AS (SELECT third, avg(d) AS mu, count(*) AS n FROM g GROUP BY 1), s AS (SELECT third, cluster, sum(d - mu) AS s FROM g JOIN m USING (third) GROUP BY ALL) SELECT third, round(mu, 6) AS estimate, n, CASE WHEN count(*) > 1 THEN round(sqrt(count(*) / (count(*) - 1) * sum(s * s)) / n, 6) END AS se FROM s JOIN m USING (third) GROUP BY third, mu, n")
def subgroup_estimates(spark, sf):
    e = es.mean_cluster_se(_paired(spark, sf).withColumn("third", F.col("pair") % 3), "d", "cluster", ["third"])
    return e.select("third", F.round("estimate", 6).alias("estimate"), "n", F.round("se", 6).alias("se"))


@register("group_means", with_views("panel") + " SELECT treatment, round(avg(y) FILTER (period = 0), 6) AS pre, round(avg(y) FILTER (period = 1), 6) AS during, round(avg(y) FILTER (period = 2), 6) AS post FROM panel GROUP BY 1")
def group_means(spark, sf):
    m = view(spark, sf, "panel").groupBy("treatment").pivot("period", [0, 1, 2]).avg("y")
    return m.select("treatment", F.round("0", 6).alias("pre"), F.round("1", 6).alias("during"), F.round("2", 6).alias("post"))


_TWO = "p2 AS (SELECT *, CASE WHEN period = 2 THEN 1 ELSE 0 END AS post FROM panel WHERE period <> 1), g AS (SELECT treatment, post, avg(y) AS m, count(*) AS n FROM p2 GROUP BY ALL)"
# A saturated regression in cell means: each coefficient is a contrast L of the four means (or their logs), and its variance is
# the sum over clusters of the squared contrast of the cells' residual sums.
_CELLS = with_views("panel") + f", {_TWO}, l(term, treatment, post, l) AS (VALUES ('const', 0, 0, 1), ('const', 1, 0, 0), ('const', 0, 1, 0), ('const', 1, 1, 0), ('treatment', 0, 0, -1), ('treatment', 1, 0, 1), ('treatment', 0, 1, 0), ('treatment', 1, 1, 0), ('post', 0, 0, -1), ('post', 1, 0, 0), ('post', 0, 1, 1), ('post', 1, 1, 0), ('treatment:post', 0, 0, 1), ('treatment:post', 1, 0, -1), ('treatment:post', 0, 1, -1), ('treatment:post', 1, 1, 1))"


def _erfc(x: str) -> str:
    """SQL of the complementary error function of 0 <= x: exp(-x^2) times the series of x^(2k + 1) / gamma(k + 3/2); 0 beyond 6."""
    series = "list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln({x}) - lgamma(k + 1.5) - {x} * {x})))"
    return f"CASE WHEN {x} > 6 THEN 0.0 WHEN {x} > 0 THEN 1 - {series.replace('{x}', x)} ELSE 1.0 END"


_EFFECT = f"SELECT term, round(b, 6) AS estimate, round(se, 6) AS se, round(b - 1.959963984540054 * se, 6) AS ci_lower, round(b + 1.959963984540054 * se, 6) AS ci_upper, CASE WHEN se > 0 THEN round({_erfc('(abs(b / se) / sqrt(2))')}, 6) END AS p_value, n"


def _contrasts(mean: str, share: str, factor: str, clusters: str = "cluster") -> str:
    """SQL ``b`` (term, b) and ``v`` (term, v, n) of the contrasts for clusters of the given columns."""
    return f", b AS (SELECT term, sum(l * {mean}) AS b FROM l JOIN g USING (treatment, post) GROUP BY 1), {_variance('v', share, factor, clusters)}"


def _variance(name: str, share: str, factor: str, clusters: str) -> str:
    score = f"SELECT term, {clusters}, sum((y - m) * l / {share}) AS s, (SELECT count(*) FROM p2) AS n FROM p2 JOIN g USING (treatment, post) JOIN l USING (treatment, post) GROUP BY term, {clusters}"
    return f"{name} AS (SELECT term, count(*) / (count(*) - 1.0) * {factor} * sum(s * s) AS v, any_value(n) AS n FROM ({score}) GROUP BY 1)"


_SMALL = "(any_value(n) - 1) / (any_value(n) - 4.0)"
_DID = _CELLS + _contrasts("m", "n", _SMALL) + f" {_EFFECT} FROM (SELECT term, b, sqrt(v) AS se, n FROM b JOIN v USING (term))"
_NAMES = ["const", "treatment", "post", "treatment:post"]
_XS = ["1", "treatment", "post", "treatment * post"]


def _two_periods(spark, sf):
    return view(spark, sf, "panel").where("period <> 1").withColumn("post", F.expr("cast(period = 2 as int)"))


def _rounded(effects):
    return effects.select("term", *[F.round(c, 6).alias(c) for c in ("estimate", "se", "ci_lower", "ci_upper", "p_value")], "n")


@register("did_ols", _DID)
def did_ols(spark, sf):
    return _rounded(es.effect_table(spark, _NAMES, *es.ols_cluster(_two_periods(spark, sf), "y", _XS, [["cluster"]])))


@register("did_ols_two_way_clusters", _CELLS + _contrasts("m", "n", _SMALL) + ", " + _variance("vp", "n", _SMALL, "period") + ", " + _variance("vc", "n", _SMALL, "cluster, period") + f" {_EFFECT} FROM (SELECT term, b, CASE WHEN v.v + vp.v - vc.v >= 0 THEN sqrt(v.v + vp.v - vc.v) END AS se, v.n FROM b JOIN v USING (term) JOIN vp USING (term) JOIN vc USING (term))")
def did_two_way(spark, sf):
    return _rounded(es.effect_table(spark, _NAMES, *es.ols_cluster(_two_periods(spark, sf), "y", _XS, [["cluster"], ["period"], ["cluster", "period"]])))


_DEMEAN = "x - avg(x) OVER (PARTITION BY unit) - avg(x) OVER (PARTITION BY period) + avg(x) OVER ()"


@register("fe_ols", with_views("panel") + f", {_TWO}, x AS (SELECT cluster, {_DEMEAN.replace('x', 'y')} AS y, {_DEMEAN.replace('x', '(treatment * post)')} AS x FROM p2), c AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n FROM x), s AS (SELECT cluster, sum(x.x * (x.y - b * x.x)) AS s FROM x, c GROUP BY 1) {_EFFECT} FROM (SELECT 'treatment:post' AS term, b, sqrt((SELECT count(*) / (count(*) - 1.0) * sum(s * s) FROM s)) / xx AS se, n FROM c)")
def fe_ols(spark, sf):
    p = _two_periods(spark, sf).withColumn("x", (F.col("treatment") * F.col("post")).cast("double"))
    p = cut(fx.demean_columns(p.select("unit", "period", "cluster", "y", "x"), "unit", "period", {"ry": "y", "rx": "x"}).select("cluster", "ry", "rx"))
    return _rounded(es.effect_table(spark, ["treatment:post"], *es.ols_cluster(p, "ry", ["rx"], [["cluster"]])))


_WEEKS = [k for k in range(-4, 5) if k != -1]
#: The eight dummies of treated units by week, week -1 being the base. In a balanced panel the coefficient of a week is a
#: difference of four means, the residual is the deviation from the group's week, and a unit moves the estimate by
#: (T - mean T) * (its residual of the week less that of week -1) / sum of (T - mean T)^2.
_STUDY = (
    with_views("weeks") + ", gw AS (SELECT treatment, week, avg(y) AS m FROM weeks GROUP BY ALL), gm AS (SELECT treatment, avg(y) AS m FROM weeks GROUP BY 1), um AS (SELECT unit, avg(y) AS m FROM weeks GROUP BY 1), "
    "e AS (SELECT unit, w.treatment, w.cluster, w.week, y - um.m - gw.m + gm.m AS e FROM weeks w JOIN um USING (unit) JOIN gw ON gw.treatment = w.treatment AND gw.week = w.week JOIN gm ON gm.treatment = w.treatment), "
    "t AS (SELECT avg(treatment) AS tm, sum((treatment - tm0) * (treatment - tm0)) AS st, (SELECT count(*) FROM weeks) AS n FROM (SELECT DISTINCT unit, treatment FROM weeks), (SELECT avg(treatment) AS tm0 FROM (SELECT DISTINCT unit, treatment FROM weeks))), "
    "s AS (SELECT a.cluster, a.week, sum((a.treatment - tm) * (a.e - z.e)) / any_value(st) AS s FROM e a JOIN e z ON z.unit = a.unit AND z.week = -1, t WHERE a.week <> -1 GROUP BY ALL), "
    "f AS (SELECT count(DISTINCT cluster) AS g, count(DISTINCT cluster) / (count(DISTINCT cluster) - 1.0) * (any_value(n) - 1) / (any_value(n) - 8.0) AS f FROM s, t), "
    "v AS (SELECT a.week AS i, c.week AS j, any_value(f) * sum(a.s * c.s) AS v FROM s a JOIN s c ON a.cluster = c.cluster, f GROUP BY ALL), "
    "b AS (SELECT a.week, (a.m - z.m) - (c.m - y.m) AS b FROM gw a JOIN gw z ON z.treatment = 1 AND z.week = -1 JOIN gw c ON c.treatment = 0 AND c.week = a.week JOIN gw y ON y.treatment = 0 AND y.week = -1 WHERE a.treatment = 1 AND a.week <> -1)"
)


@register("event_study", _STUDY + f" {_EFFECT} FROM (SELECT 'treatment:' || week AS term, b, sqrt(v) AS se, (SELECT n FROM t) AS n FROM b JOIN v ON i = week AND j = week)")
def event_study(spark, sf):
    beta, cov, n, _ = _week_effects(spark, sf)
    return _rounded(es.effect_table(spark, [f"treatment:{k}" for k in _WEEKS], beta, cov, n))


def _week_effects(spark, sf):
    p = view(spark, sf, "weeks").withColumn("treated", F.col("treatment").cast("double"))
    dummies = {f"r{i}": f"treated * cast(week = {k} as int)" for i, k in enumerate(_WEEKS)}
    p = cut(fx.demean_columns(p, "unit", "week", {"ry": "y"} | dummies).select("cluster", "ry", *dummies))
    return *es.ols_cluster(p, "ry", list(dummies), [["cluster"]]), p.select("cluster").distinct().count()


# b' V^-1 b of three weeks by the adjugate, and the tail of F as the incomplete beta integral by Simpson's rule.
_LEADS = {f"v{i}{j}": f"max(v) FILTER (i = {p} AND j = {q})" for i, p in enumerate((-4, -3, -2)) for j, q in enumerate((-4, -3, -2))}
_ADJ = {(0, 0): "v11 * v22 - v12 * v21", (0, 1): "v02 * v21 - v01 * v22", (0, 2): "v01 * v12 - v02 * v11", (1, 1): "v00 * v22 - v02 * v20", (1, 2): "v02 * v10 - v00 * v12", (2, 2): "v00 * v11 - v01 * v10"}
_QUADRATIC = " + ".join(f"{1 if i == j else 2} * b{i} * b{j} * ({c})" for (i, j), c in _ADJ.items())
_DET = "(v00 * (v11 * v22 - v12 * v21) - v01 * (v10 * v22 - v12 * v20) + v02 * (v10 * v21 - v11 * v20))"
_SIMPSON = "list_sum(list_transform(range(0, 4001), lambda k: (CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(k * x / 4000, a - 1) * sqrt(1 - k * x / 4000))) * x / 12000"


@register(
    "pretrend_test",
    _STUDY + f", w AS (SELECT {', '.join(f'{c} AS {n}' for n, c in _LEADS.items())} FROM v), c AS (SELECT {', '.join(f'max(b) FILTER (week = {k}) AS b{i}' for i, k in enumerate((-4, -3, -2)))} FROM b), "
    f"q AS (SELECT ({_QUADRATIC}) / {_DET} / 3 AS fs, g - 1 AS df2 FROM w, c, f), x AS (SELECT *, df2 / 2.0 AS a, df2 / (df2 + 3 * fs) AS x FROM q) "
    f"SELECT round(fs, 6) AS f_statistic, 3 AS df1, df2, round({_SIMPSON} * exp(lgamma(a + 1.5) - lgamma(a) - lgamma(1.5)), 6) AS p_value FROM x",
)
def pretrend_test(spark, sf):
    """Weeks -4 to -2 jointly zero, with clusters less one denominator degrees of freedom."""
    beta, cov, _, clusters = _week_effects(spark, sf)
    f, p = fx.wald_test(beta, cov, [0, 1, 2], clusters - 1)
    return spark.createDataFrame([(round(f, 6), 3, clusters - 1, round(p, 6))], "f_statistic double, df1 int, df2 long, p_value double")


_LOG = _CELLS + _contrasts("ln(m)", "(n * m)", "1.0") + f" {_EFFECT} FROM (SELECT term, b, sqrt(v) AS se, n FROM b JOIN v USING (term))"


@register("poisson_did", _LOG.replace("sum((y - m) * l / (n * m))", "sum((y - m) * l / (g.n * m))"))
def poisson_did(spark, sf):
    return _rounded(es.effect_table(spark, _NAMES, *es.poisson_cluster(_two_periods(spark, sf), "y", _XS, "cluster")))


# Newton's steps of a negative binomial model (NB2, dispersion 1) on a constant and a continuous covariate, unrolled.
_NB2_ROUNDS = 14
_NB2 = with_views("panel") + ", d AS MATERIALIZED (SELECT y, cluster, (unit % 97) / 97.0 + period * 0.5 AS x FROM panel), n0 AS (SELECT ln(avg(y)) AS b0, 0.0::DOUBLE AS b1 FROM d)" + "".join(
    f", n{i} AS MATERIALIZED (SELECT any_value(b0) + (sum(w * x * x) * sum(u) - sum(w * x) * sum(u * x)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) AS b0, any_value(b1) + (sum(w) * sum(u * x) - sum(w * x) * sum(u)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) AS b1 FROM (SELECT x, b0, b1, exp(b0 + b1 * x) / (1 + exp(b0 + b1 * x)) AS w, (y - exp(b0 + b1 * x)) / (1 + exp(b0 + b1 * x)) AS u FROM d, n{i - 1}))"
    for i in range(1, _NB2_ROUNDS + 1)
)
_NB2 += (
    f", h AS (SELECT cluster, x, b0, b1, exp(b0 + b1 * x) / (1 + exp(b0 + b1 * x)) AS w, (y - exp(b0 + b1 * x)) / (1 + exp(b0 + b1 * x)) AS u FROM d, n{_NB2_ROUNDS}), g AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(w) AS a, sum(w * x) AS b, sum(w * x * x) AS c, sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x) AS det, count(*) AS n FROM h), "
    "s AS (SELECT cluster, sum(u) AS s0, sum(u * x) AS s1 FROM h GROUP BY 1), m AS (SELECT count(*) / (count(*) - 1.0) AS f, sum(pow((c * s0 - b * s1) / det, 2)) AS v0, sum(pow((a * s1 - b * s0) / det, 2)) AS v1 FROM s, g) "
)


@register("nb2_did", _NB2 + f"{_EFFECT} FROM (SELECT 'const' AS term, b0 AS b, sqrt(f * v0) AS se, n FROM g, m UNION ALL SELECT 'x', b1, sqrt(f * v1), n FROM g, m)")
def nb2_did(spark, sf):
    """Negative binomial on a continuous covariate, where its estimates differ from the Poisson ones."""
    p = view(spark, sf, "panel").withColumn("x", F.expr("(unit % 97) / 97.0D + period * 0.5D"))
    return _rounded(es.effect_table(spark, ["const", "x"], *es.poisson_cluster(p, "y", ["1", "x"], "cluster", family="nb2")))


# Two fixed effects: each unit's effect makes its means add up to its total; Newton's steps of the slope and the effects of the
# second and third period, unrolled. A unit's rows are z = (x, [period 1], [period 2]).
_Z = ("x", "p1", "p2")
_PPML_ROUNDS = 9
_PAIRS3 = [(i, j) for i in range(3) for j in range(i, 3)]


def _cramer(g: str) -> list[str]:
    """The solution of the symmetric system of the columns h00 .. h22 and right side g0 .. g2."""
    h = lambda i, j: f"h{min(i, j)}{max(i, j)}"
    minor = lambda i, j: (lambda r, c: f"({h(r[0], c[0])} * {h(r[1], c[1])} - {h(r[0], c[1])} * {h(r[1], c[0])})")([k for k in range(3) if k != i], [k for k in range(3) if k != j])
    det = " + ".join(f"{h(0, j)} * {'-' if j % 2 else ''}1 * {minor(0, j)}" for j in range(3))
    return [f"(({' + '.join(f'{chr(45) if (i + j) % 2 else chr(32)}1 * {minor(i, j)} * {g}{j}' for j in range(3))}) / ({det}))" for i in range(3)]


def _ppml_sql() -> str:
    sums = ", ".join(f"sum(mu * {_Z[i]} * {_Z[j]}) - (SELECT sum(q{i} * q{j} / t) FROM u{{k}}) AS h{i}{j}" for i, j in _PAIRS3) + ", " + ", ".join(f"sum((y - mu) * {z}) AS g{i}" for i, z in enumerate(_Z))
    out = with_views("panel") + ", live AS MATERIALIZED (SELECT unit, cluster, y, (treatment * CAST(period = 2 AS INT))::DOUBLE AS x, (period = 1)::INT AS p1, (period = 2)::INT AS p2, sum(y) OVER (PARTITION BY unit) AS t FROM panel QUALIFY sum(y) OVER (PARTITION BY unit) > 0), t0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"
    for k in range(_PPML_ROUNDS + 1):
        out += f", m{k} AS MATERIALIZED (SELECT live.*, t * exp(b0 * x + b1 * p1 + b2 * p2) / sum(exp(b0 * x + b1 * p1 + b2 * p2)) OVER (PARTITION BY unit) AS mu FROM live, t{k}), u{k} AS MATERIALIZED (SELECT unit, any_value(t) AS t, sum(mu * x) AS q0, sum(mu * p1) AS q1, sum(mu * p2) AS q2 FROM m{k} GROUP BY 1), s{k} AS MATERIALIZED (SELECT {sums.format(k=k)} FROM m{k})"
        if k < _PPML_ROUNDS:
            out += f", t{k + 1} AS MATERIALIZED (SELECT " + ", ".join(f"b{i} + {c} AS b{i}" for i, c in enumerate(_cramer("g"))) + f" FROM t{k}, s{k})"
    k = _PPML_ROUNDS
    # The slope's influence of a cluster: the first row of the inverse information times its scores.
    out += f", c AS (SELECT cluster, {', '.join(f'sum((y - mu) * ({z} - q{i} / u.t)) AS g{i}' for i, z in enumerate(_Z))} FROM m{k} m JOIN u{k} u USING (unit) GROUP BY 1)"
    return out + f", v AS (SELECT count(*) / (count(*) - 1.0) * sum(pow({_cramer('c.g')[0]}, 2)) AS v FROM c, s{k}) {_EFFECT} FROM (SELECT 'treatment:post' AS term, b0 AS b, sqrt(v) AS se, (SELECT count(*) FROM m{k}) AS n FROM t{k}, v)"


@register("ppml_two_fe", _ppml_sql())
def ppml_two_fe(spark, sf):
    p = es.drop_zero_groups(view(spark, sf, "panel").withColumn("x", F.expr("cast(treatment * cast(period = 2 as int) as double)")), "y", ["unit", "period"])
    return _rounded(es.effect_table(spark, ["treatment:post"], *fx.ppml_two_fe(p, "y", ["x"], ("unit", "period"), "cluster")))


@register("effect_summary", _PD + ", m AS (SELECT avg(e) AS me, avg(d) AS md, count(*) AS n FROM d), s AS (SELECT cluster, sum(e - me) AS se, sum(d - md) AS sd FROM d, m GROUP BY 1), v AS (SELECT count(*) / (count(*) - 1.0) AS f, sum(se * se) AS ee, sum(sd * sd) AS dd, sum((se + sd) * (se + sd)) AS nn FROM s), r AS (SELECT 'during' AS term, me AS b, sqrt(f * ee) / n AS se, n FROM m, v UNION ALL SELECT 'post', md, sqrt(f * dd) / n, n FROM m, v UNION ALL SELECT 'net', me + md, sqrt(f * nn) / n, n FROM m, v UNION ALL SELECT 'ratio', -md / me, NULL, n FROM m) SELECT term, round(b, 6) AS estimate, round(se, 6) AS se, round(se * se, 6) AS variance, round(b - 1.959963984540054 * se, 6) AS ci_lower, round(b + 1.959963984540054 * se, 6) AS ci_upper, CASE WHEN se > 0 THEN round(" + _erfc("(abs(b / se) / sqrt(2))") + ", 6) END AS p_value, n AS pairs FROM r")
def effect_summary(spark, sf):
    """Effects of both periods, their sum with its variance, and their ratio, which has none."""
    return es.effect_summary(_paired(spark, sf), "e", "d", "cluster", ("during", "post")).select("term", *[F.round(c, 6).alias(c) for c in ("estimate", "se", "variance", "ci_lower", "ci_upper", "p_value")], "pairs")


# Evaluation -------------------------------------------------------------------------------------------------------------

_MET = "count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 0) AS tn, count(*) FILTER (p < 0.5 AND y = 1) AS fn"


@register("binary_metrics", with_views("preds") + f", c AS (SELECT lang, {_MET}, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(CASE WHEN y = 1 THEN -ln(greatest(least(p, 1 - 1e-15), 1e-15)) ELSE -ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END), 5) AS log_loss FROM preds GROUP BY 1) SELECT lang, tp, fp, tn, fn, brier, log_loss, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c")
def binary_metrics(spark, sf):
    m = ev.binary_metrics(view(spark, sf, "preds"), "y", "p", 0.5, ["lang"])
    return m.select("lang", "tp", "fp", "tn", "fn", F.round("brier", 6).alias("brier"), F.round("log_loss", 5).alias("log_loss"), *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")])


@register("ranking_metrics", with_views("preds") + ", c AS (SELECT lang, p, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM preds GROUP BY ALL), r AS (SELECT *, sum(a) OVER (PARTITION BY lang ORDER BY p DESC) AS tp, sum(b) OVER (PARTITION BY lang ORDER BY p DESC) AS fp, sum(a) OVER (PARTITION BY lang) AS pos, sum(b) OVER (PARTITION BY lang) AS neg FROM c) SELECT lang, round(sum((tp - a / 2) * b) / (max(pos) * max(neg)), 6) AS auc, round(sum(a * tp / (tp + fp)) / max(pos), 6) AS average_precision, max_by(p, ROW(round(tp / pos - fp / neg, 12), p)) AS youden_threshold FROM r WHERE pos > 0 AND neg > 0 GROUP BY 1")
def ranking_metrics(spark, sf):
    m = ev.ranking_metrics(view(spark, sf, "preds"), "y", "p", ["lang"])
    return m.select("lang", F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"), "youden_threshold")


@register("calibration_table", with_views("preds") + ", b AS (SELECT *, CAST(ntile(10) OVER (ORDER BY p, doc_id) AS INT) AS bin FROM preds) SELECT bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM b GROUP BY 1")
def calibration_table(spark, sf):
    return ev.calibration_table(view(spark, sf, "preds"), "y", "p", "doc_id").select("bin", "n", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"))


_PSI = "SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM (SELECT greatest(na / sum(na) OVER (), 1e-4) AS p, greatest(nb / sum(nb) OVER (), 1e-4) AS q FROM n)"


@register("psi_numeric", "WITH e AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM lineitem WHERE year(l_shipdate) = 1997), n AS (SELECT len(list_filter(q, lambda x: x < l_extendedprice)) AS b, count(*) FILTER (year(l_shipdate) = 1997) AS na, count(*) FILTER (year(l_shipdate) = 1999) AS nb FROM lineitem, e WHERE year(l_shipdate) IN (1997, 1999) GROUP BY 1) " + _PSI)
def psi_numeric(spark, sf):
    li = table(spark, sf, "lineitem")
    return ev.psi_numeric(li.where("year(l_shipdate) = 1997"), li.where("year(l_shipdate) = 1999"), "l_extendedprice").select(F.round("psi", 6).alias("psi"))


@register("psi_categorical", "WITH n AS (SELECT l_returnflag, count(*) FILTER (year(l_shipdate) = 1997) AS na, count(*) FILTER (year(l_shipdate) = 1999) AS nb FROM lineitem WHERE year(l_shipdate) IN (1997, 1999) GROUP BY 1) " + _PSI)
def psi_categorical(spark, sf):
    li = table(spark, sf, "lineitem")
    return ev.psi_categorical(li.where("year(l_shipdate) = 1997"), li.where("year(l_shipdate) = 1999"), "l_returnflag").select(F.round("psi", 6).alias("psi"))


@register("rate_metrics", with_views("panel") + ", m AS (SELECT avg(y) AS c FROM panel), q AS (SELECT y, 1 + unit % 7 AS mu, c FROM panel, m) SELECT round(avg(2 * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu))), 5) AS deviance, round(avg(2 * (CASE WHEN y > 0 THEN y * ln(y / c) ELSE 0 END - (y - c))), 5) AS constant_deviance, round(avg(abs(y - mu)), 6) AS mae, round(sqrt(avg(pow(y - mu, 2))), 6) AS rmse FROM q")
def rate_metrics(spark, sf):
    m = ev.rate_metrics(view(spark, sf, "panel").withColumn("mu", 1.0 + F.col("unit") % 7), "y", "mu")
    return m.select(F.round("deviance", 5).alias("deviance"), F.round("constant_deviance", 5).alias("constant_deviance"), F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


@register("calendar_features", "SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST((dayofweek(ts) + 6) % 7 AS INT) AS dow, CAST(month(ts) AS INT) AS month, dayofweek(ts) IN (0, 6) AS weekend, hour(ts) BETWEEN 9 AND 17 AND dayofweek(ts) NOT IN (0, 6) AS business FROM events")
def calendar_features(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("dow"), F.month("ts").alias("month"), (F.weekday("ts") >= 5).alias("weekend"), (F.hour("ts").between(9, 17) & (F.weekday("ts") < 5)).alias("business"))


@register("time_split", "SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'test' END AS part, count(*) AS n FROM orders GROUP BY 1")
def time_split(spark, sf):
    part = F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), "train").when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "validation").otherwise("test")
    return table(spark, sf, "orders").groupBy(part.alias("part")).agg(F.count("*").alias("n"))
