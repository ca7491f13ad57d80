"""Plans and queues. A day's plan under a budget with quotas: the best of each region first, then the best of the rest.

With jobs of equal cost this is the exact optimum of the selection problem, so no solver is needed. Only the best few rows of
each region can be chosen: tasks keep those of their own rows, which are merged by region before anything is put in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskline.operators.aggregates import exact_quantiles
from duskline.session import cut

UNSPECIFIED = "UNSPECIFIED"


class InfeasibleQuotaError(ValueError):
    """No selection can satisfy all quotas within the budget."""


def capacity_of(budget: float, cost: float) -> int:
    """Jobs of equal ``cost`` that ``budget`` pays for; ValueError unless the budget is finite and not negative."""
    if not (math.isfinite(budget) and budget >= 0):
        raise ValueError("the budget must be a non-negative finite number")
    if not cost > 0:
        raise ValueError("the cost must be positive")
    return math.floor(budget / cost + 1e-9)


def candidates(df: DataFrame, score: str, region: str) -> DataFrame:
    """``df`` with blank or null regions named ``UNSPECIFIED``; ValueError if a score is null, not finite or negative."""
    bad = F.col(score).isNull() | F.isnan(F.col(score).cast("double")) | (F.abs(F.col(score)) == float("inf")) | (F.col(score) < 0)
    if wrong := df.where(bad).limit(1).count():
        raise ValueError(f"{wrong} or more scores are null, not finite or negative")
    text = F.col(region).cast("string")
    return df.withColumn(region, F.when(F.trim(text) != "", text).otherwise(F.lit(UNSPECIFIED)))


def quotas(df: DataFrame, region: str, capacity: int, fraction: float = 0.5, overrides: dict[str, int] | None = None) -> DataFrame:
    """``(region, candidates, quota)``: floor(fraction * capacity * share of the candidates), at most the candidates;
    ``overrides`` replace it. ValueError for a fraction outside 0..1, an unknown region and a quota that is negative or no
    whole number; InfeasibleQuotaError if a quota exceeds its candidates or all of them the capacity."""
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction must be between 0 and 1")
    for name, q in (overrides or {}).items():
        if q < 0 or int(q) != q:
            raise ValueError(f"the quota of {name!r} must be a non-negative whole number")
    counts = df.groupBy(region).agg(F.count("*").alias("candidates"))
    total = counts.agg(F.sum("candidates").alias("_n"))
    own = F.least("candidates", F.floor(F.lit(fraction * capacity) * F.col("candidates") / F.col("_n") + 1e-9).cast("long"))
    out = counts.crossJoin(F.broadcast(total)).select(region, "candidates", own.alias("quota"))
    if overrides:
        set_ = df.sparkSession.createDataFrame([(k, int(q)) for k, q in overrides.items()], "_r string, _q long")
        if unknown := [r._r for r in set_.join(counts, F.col("_r") == F.col(region).cast("string"), "left_anti").collect()]:
            raise ValueError(f"quotas of unknown regions {sorted(unknown)}")
        out = out.join(F.broadcast(set_), F.col("_r") == F.col(region).cast("string"), "left").select(region, "candidates", F.coalesce("_q", "quota").alias("quota"))
    out = cut(out)
    problems = [f"{r[region]}: quota {r.quota} exceeds its {r.candidates} candidates" for r in out.where("quota > candidates").orderBy(region).limit(20).collect()]
    asked = out.agg(F.sum("quota").alias("q")).first().q or 0
    if not problems and asked > capacity:
        problems = [f"the quotas need {asked} jobs but the budget pays for {capacity}"]
    if problems:
        raise InfeasibleQuotaError("; ".join(problems))
    return out


def best_of_groups(df: DataFrame, by: str, order: list[Column], most: int, key: str) -> DataFrame:
    """The first ``most`` rows of each group in the total ``order``, with ``_place`` from 1.

    Each of as many shares of a group as there are shuffle partitions keeps its own first rows; the shares are then merged, so a
    task of the merge holds at most ``most`` rows a share and group, however large the group is.
    """
    shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_share", F.pmod(F.xxhash64(key), F.lit(shares)))
    kept = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(by, "_share").orderBy(*order))).where(F.col("_place") <= most)
    return kept.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_place") <= most).drop("_share")


def _chosen(best: DataFrame, order: list[Column], score: str, capacity: int, quota: Column, out: str) -> DataFrame:
    """Rows of ``best`` within their quota, then the best others of a positive score up to ``capacity``."""
    own = best.where(F.col("_place") <= quota)
    rest = best.where((F.col("_place") > quota) & (F.col(score) > 0))
    left = max(capacity - own.count(), 0)
    return own.unionByName(rest.orderBy(*order).limit(left)).withColumn(out, F.lit(True))


def quota_topk(df: DataFrame, key: str, score: str, region: str, budget: int, quota: int | DataFrame, order: list[Column] | None = None) -> DataFrame:
    """``df`` with ``selected``: the best ``quota`` rows of each region (a number for all, or ``(region, quota)`` rows), then the
    best of the rest with a positive score up to ``budget`` rows. Exact for rows of equal cost."""
    order = order or [F.desc(score), F.col(key)]
    per = quota if isinstance(quota, DataFrame) else df.select(region).distinct().withColumn("quota", F.lit(quota))
    most = max(budget, per.agg(F.max("quota").alias("q")).first().q or 0)
    best = cut(best_of_groups(df, region, order, most, key).join(per.select(F.col(region).alias("_r"), F.col("quota").alias("_quota")), F.col(region).eqNullSafe(F.col("_r")), "left"))
    chosen = _chosen(best, order, score, budget, F.coalesce("_quota", F.lit(0)), "_s").select(F.col(key).alias("_k"), "_s")
    return df.join(chosen, F.col(key) == F.col("_k"), "left").withColumn("selected", F.coalesce("_s", F.lit(False))).drop("_k", "_s")


def plan(df: DataFrame, key: str, score: str, region: str, created: str, budget: float, cost: float = 1.0, fraction: float = 0.5, overrides: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan of a day and its summary.

    Plan: a row per candidate with ``selected`` (under quotas) and ``unconstrained`` (the same budget without quotas), best first
    by score, then ``created``, then ``key``. Summary: a row per region and one with region null for all: ``candidates``,
    ``quota``, ``selected``, ``compliant``, ``unconstrained``, ``benefit`` and ``unconstrained_benefit`` (sums of scores);
    the difference of the last two is the price of the quotas. See ``candidates`` and ``quotas`` for the errors; an empty
    table gives an empty plan and one summary row of zeros.
    """
    capacity = capacity_of(budget, cost)
    rows = cut(candidates(df, score, region))
    per = quotas(rows, region, capacity, fraction, overrides)
    order = [F.desc(score), F.col(created), F.col(key)]
    fair = quota_topk(rows, key, score, region, capacity, per, order)
    free = quota_topk(rows, key, score, region, capacity, 0, order).where("selected").select(F.col(key).alias("_k"), F.lit(True).alias("unconstrained"))
    out = cut(fair.join(free, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("unconstrained", F.coalesce("unconstrained", F.lit(False))))
    worth = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col(score).cast("decimal(28,6)"))), F.lit(0)).cast("double")
    sums = [F.count("*").alias("candidates"), F.count_if(F.col("selected")).alias("selected"), F.count_if(F.col("unconstrained")).alias("unconstrained"), worth("selected").alias("benefit"), worth("unconstrained").alias("unconstrained_benefit")]
    by_region = out.groupBy(region).agg(*sums).join(per.select(region, "quota"), region).withColumn("compliant", F.col("selected") >= F.col("quota"))
    whole = out.agg(*sums).crossJoin(per.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("quota"))).withColumn("compliant", F.col("selected") >= F.col("quota"))
    columns = ["candidates", "quota", "selected", "compliant", "unconstrained", "benefit", "unconstrained_benefit"]
    return out, by_region.select(region, *columns).unionByName(whole.withColumn(region, F.lit(None).cast(out.schema[region].dataType)).select(region, *columns))


def overload_start(jobs: DataFrame, capacity: float, arrival: str = "arrival"):
    """The first quarter whose arrivals per day exceed ``capacity``, as the timestamp of its first day; None if there is none."""
    quarter = F.date_trunc("quarter", arrival)
    n = jobs.groupBy(quarter.alias("q")).agg(F.count("*").alias("n"))
    days = F.datediff(F.expr("q + interval 3 months"), F.col("q"))
    return n.where(F.col("n") / days > capacity).agg(F.min("q").alias("q")).first().q


def wait_report(scheduled: DataFrame, t0: str, split, region: str = "region", arrival: str = "arrival") -> DataFrame:
    """Waits in days by regime and region: ``all`` jobs, those that arrived before ``split`` (``stable``) and from then on
    (``overload``; none without a split); region null is all regions. ``n``, mean, exact median and 90th percentile, maximum and
    the shares served within 7 and 30 days. A job selected before its arrival raises ValueError; jobs without a region are
    named ``<missing>``."""
    selected = F.expr(f"timestamp_ntz '{t0}' + make_dt_interval(cast(service_day as int), 0, 0, 0)")
    wait = F.expr(f"timestampdiff(microsecond, {arrival}, _selected)") / 8.64e10
    late = F.lit(False) if split is None else F.col(arrival) >= F.lit(split)
    rows = scheduled.withColumn("_selected", selected).select(wait.alias("w"), F.coalesce(F.col(region).cast("string"), F.lit("<missing>")).alias("r"), F.when(late, "overload").otherwise("stable").alias("regime"))
    counted = cut(rows.groupBy("regime", "r", "w").agg(F.count("*").alias("n")))
    if counted.where("w <= 0").limit(1).count():
        raise ValueError("a job is selected before its arrival")
    cells = F.array(*[F.struct(a.alias("regime"), b.alias("r")) for a in (F.lit("all"), F.col("regime")) for b in (F.lit(None).cast("string"), F.col("r"))])
    each = cut(counted.select(F.explode(cells).alias("c"), "w", "n").select("c.*", "w", "n").groupBy("regime", "r", "w").agg(F.sum("n").alias("n")))
    within = lambda d: (F.sum(F.when(F.col("w") <= d, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"within_{d}")
    sums = each.groupBy("regime", "r").agg(F.sum("n").alias("n"), (F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("mean"), F.max("w").alias("max"), within(7), within(30))
    q = exact_quantiles(each, "w", [0.5, 0.9], ["regime", "r"], weight="n").withColumnsRenamed({"regime": "_g", "r": "_r"})
    out = sums.join(q, (F.col("regime") == F.col("_g")) & F.col("r").eqNullSafe(F.col("_r")))
    return out.select("regime", F.col("r").alias(region), "n", "mean", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p90"), "max", "within_7", "within_30")


def queue_report(series: DataFrame, capacity: int, horizon: int) -> DataFrame:
    """One row from the days (day, selected, waiting) of a schedule, those before ``horizon``: mean, largest and last backlog,
    jobs served a day, utilisation of the capacity, and how many days after the horizon the queue still takes to drain."""
    inside = F.col("day") < horizon
    only = lambda c: F.when(inside, F.col(c))
    return series.agg(
        F.avg(only("waiting")).alias("backlog_mean"), F.max(only("waiting")).alias("backlog_max"), F.max_by(only("waiting"), only("day")).alias("backlog_end"), F.avg(only("selected")).alias("throughput"),
        F.try_divide(F.sum(only("selected")), capacity * F.count(only("day"))).alias("utilisation"), F.count_if(~inside).alias("drain_days"))
