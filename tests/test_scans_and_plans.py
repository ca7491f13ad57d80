"""Scans over hot keys, and quota plans, against brute force."""

import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskline.operators import dispatch as dp
from duskline.operators import scans

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ROWS = st.lists(st.tuples(st.sampled_from(["a", "a", "a", "b", None]), st.integers(0, 12), st.integers(-5, 9)), max_size=40)


@SLOW
@given(ROWS, st.integers(1, 9))
def test_scan_equals_a_loop(spark, rows, ranges):
    table = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(table, "i int, k string, t int, v int")
    out = {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v"))}
    for before in (False, True):
        got = {r.i: (r.total, r.top, r.low) for r in scans.scan(df, ["k"], [F.desc("t"), F.col("i")], out, before, ranges).collect()}
        for i, k, t, _ in table:
            seen = [v for j, c, u, v in table if c == k and ((-u, j) < (-t, i) or (j == i and not before))]
            assert got[i] == ((sum(seen), max(seen), min(seen)) if seen else (0, None, None))
        assert len(got) == len(table)


@SLOW
@given(ROWS, ROWS, st.integers(1, 7))
def test_counts_in_ranges_equal_brute_force(spark, events, probes, ranges):
    ev = spark.createDataFrame([(k, t if v > -5 else None) for k, t, v in events], "k string, at int")
    pr = [(i, k, t, None if v == -5 else t + v) for i, (k, t, v) in enumerate(probes)]
    got = scans.count_in_ranges(ev, spark.createDataFrame(pr, "i int, k string, low int, high int"), "k", "at", ["i"], "low", "high", "n", ranges).collect()
    want = {i: sum(c == k and v > -5 and high is not None and low <= t < high for c, t, v in events) for i, k, low, high in pr}
    assert {r.i: r.n for r in got} == want and len(got) == len(pr)


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.integers(0, 6)), max_size=30))
def test_meeting_intervals_equal_brute_force(spark, rows):
    table = [(i, k, s, s + n) for i, (k, s, n) in enumerate(rows)]
    got = {r.i for r in scans.meets_another(spark.createDataFrame(table, "i int, k string, s int, e int"), "k", "s", "e", "i", 5).collect()}
    assert got == {a[0] for a in table if any(a[0] != b[0] and a[1] == b[1] and b[2] <= a[3] and b[3] >= a[2] for b in table)}


def test_one_key_is_split_among_tasks(spark):
    """All rows have one key: no task scans more than a small share of them."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = spark.range(20_000).select(F.lit("hot").alias("k"), F.expr("id * 7919 % 100003").alias("t"))
        ran = scans.ranks(df, ["k"], [F.col("t")])
        sizes = [r["count"] for r in ran.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 0.25 * 20_000 and sum(sizes) == 20_000 and ran.agg(F.max("rank"), F.count_distinct("rank")).first() == (20_000, 20_000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def jobs(spark, rows):
    return spark.createDataFrame([(i, float(s), r, i % 3) for i, (s, r) in enumerate(rows)], "id int, score double, region string, created int")


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_the_best_of_all_selections(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 1, 2, 5, 9]), rng.choice(["n", "s", "s", None])) for _ in range(9)]
    capacity, overrides = 5, ({"s": 2} if sum(r == "s" for _, r in rows) >= 2 and seed % 2 else None)
    plan, summary = dp.plan(jobs(spark, rows), "id", "score", "region", "created", 10.5, 2.0, 0.6, overrides)
    region = [r or dp.UNSPECIFIED for _, r in rows]
    quota = {r: min(region.count(r), int(0.6 * capacity * region.count(r) / len(rows) + 1e-9)) for r in set(region)} | (overrides or {})
    best = max(sum(rows[i][0] for i in pick) for n in range(capacity + 1) for pick in itertools.combinations(range(len(rows)), n) if all(sum(region[i] == r for i in pick) >= q for r, q in quota.items()))
    free = sum(sorted((s for s, _ in rows), reverse=True)[:capacity])
    chosen = [r.id for r in plan.where("selected").collect()]
    assert len(chosen) <= capacity and sum(rows[i][0] for i in chosen) == best
    by = {r.region: r for r in summary.collect()}
    assert {r: (by[r].candidates, by[r].quota, by[r].compliant) for r in quota} == {r: (region.count(r), q, True) for r, q in quota.items()}
    assert (by[None].selected, by[None].benefit, by[None].unconstrained_benefit) == (len(chosen), best, free) and len(by) == len(quota) + 1


def test_plan_errors_and_an_empty_table(spark):
    df = jobs(spark, [(5, "n"), (4, "n"), (3, "s"), (2, " ")])
    plan = lambda df=df, budget=3, **k: dp.plan(df, "id", "score", "region", "created", budget, **k)
    for bad in (-1, float("inf"), float("nan")):
        with pytest.raises(ValueError, match="budget"):
            plan(budget=bad)
    with pytest.raises(ValueError, match="cost"):
        plan(cost=0)
    with pytest.raises(ValueError, match="fraction"):
        plan(fraction=1.5)
    with pytest.raises(ValueError, match="unknown regions"):
        plan(overrides={"west": 1})
    for q in (-1, 0.5):
        with pytest.raises(ValueError, match="whole number"):
            plan(overrides={"n": q})
    with pytest.raises(dp.InfeasibleQuotaError, match="s: quota 2 exceeds its 1 candidates"):
        plan(overrides={"s": 2})
    with pytest.raises(dp.InfeasibleQuotaError, match="the quotas need 4 jobs but the budget pays for 3"):
        plan(overrides={"n": 2, "s": 1, dp.UNSPECIFIED: 1})
    for score in (None, float("nan"), -1.0):
        with pytest.raises(ValueError, match="scores"):
            plan(df.withColumn("score", F.when(F.col("id") != 2, F.col("score")).otherwise(F.lit(score))))
    out, summary = plan(df.limit(0))
    assert out.count() == 0 and [(r.region, r.candidates, r.quota, r.selected, r.benefit) for r in summary.collect()] == [(None, 0, 0, 0, 0.0)]


def test_best_of_a_hot_group_is_bounded_before_the_merge(spark):
    df = spark.range(5000).select("id", F.lit("one").alias("region"), (F.col("id") % 100).alias("score"))
    best = dp.best_of_groups(df, "region", [F.desc("score"), F.col("id")], 7, "id").orderBy("_place").collect()
    assert [(r.score, r.id) for r in best] == [(99, 99 + 100 * k) for k in range(7)]


def test_waits_and_queue_by_hand(spark):
    jobs = [(1, "01-01 06:00:00", 1, "n"), (2, "01-01 18:00:00", 3, None), (3, "05-01 00:00:00", 125, "n"), (4, "05-02 12:00:00", 130, "n")]
    rows = spark.createDataFrame(jobs, "id int, a string, service_day long, region string").withColumn("arrival", F.expr("to_timestamp_ntz(concat('2024-', a))"))
    split = dp.overload_start(rows.unionByName(rows.where("id > 2")).unionByName(rows.where("id > 2")), 0.04)
    assert str(split) == "2024-04-01 00:00:00" and dp.overload_start(rows, 5) is None
    got = {(r.regime, r.region): r for r in dp.wait_report(rows, "2024-01-01 08:00:00", split).collect()}
    waits = {1: 26 / 24, 2: 62 / 24}
    assert got["all", None].n == 4 and got["stable", None].n == 2 and got["overload", "n"].n == 2 and got["stable", "<missing>"].mean == pytest.approx(waits[2])
    assert got["stable", None].median == pytest.approx((waits[1] + waits[2]) / 2) and got["stable", None].max == pytest.approx(waits[2]) and got["all", None].within_7 >= 0.5
    assert {r.regime for r in dp.wait_report(rows, "2024-01-01 08:00:00", None).collect()} == {"all", "stable"}
    with pytest.raises(ValueError, match="before its arrival"):
        dp.wait_report(rows.withColumn("service_day", F.lit(0)), "2024-01-01 08:00:00", split)
    series = spark.createDataFrame([(0, 1, 4), (1, 3, 6), (2, 3, 3), (3, 3, 0)], "day long, selected long, waiting long")
    r = dp.queue_report(series, 3, 3).first()
    assert (r.backlog_mean, r.backlog_max, r.backlog_end, r.throughput, r.utilisation, r.drain_days) == (pytest.approx(13 / 3), 6, 3, pytest.approx(7 / 3), pytest.approx(7 / 9), 1)
    assert dp.queue_report(series.limit(0), 3, 3).first().utilisation is None
