"""The state of each day against a loop over all intervals."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from duskline.operators import context as ct

SCHEMA = "id long, region string, start_ts timestamp_ntz, end_ts timestamp_ntz, x_m double, y_m double"
T0 = dt.datetime(2024, 1, 1)


def rows(seed):
    rng = random.Random(seed)
    out = []
    for i in range(150):
        s = T0 + dt.timedelta(hours=rng.choice([0, 24, 24 * rng.randrange(40), rng.randrange(24 * 40)]))  # midnights too
        out.append((i, rng.choice(["n", "s", None]), s, rng.choice([None, s, s - dt.timedelta(hours=1), s + dt.timedelta(hours=24 * rng.randrange(9)), s + dt.timedelta(hours=rng.randrange(300))]), float(rng.randrange(4)), rng.choice([None, 1.0])))
    return [*out, (900, "n", None, T0, 0.0, 0.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_daily_context_equals_a_loop(spark, seed):
    table = rows(seed)
    got = {(r.region, r.day): r for r in ct.daily_context(spark.createDataFrame(table, SCHEMA), backlog_days=12, volume_days=3, closure_days=4, slow_hours=100).collect()}
    used = [(r or "UNKNOWN", s, e) for _, r, s, e, _, _ in table if s and (e is None or e >= s)]
    first, last = min(s for _, s, _ in used).date(), max(s for _, s, _ in used).date()
    days = [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]
    assert set(got) == {(r, (d - dt.date(1970, 1, 1)).days) for r in (None, "n", "s", "UNKNOWN") for d in days}
    for (r, day), row in got.items():
        at = dt.datetime(1970, 1, 1) + dt.timedelta(days=day)
        mine = [(s, e) for q, s, e in used if r in (None, q)]
        ago = lambda n: at - dt.timedelta(days=n)  # noqa: B023, E731
        hours = [(e - s).total_seconds() / 3600 for s, e in mine if e and ago(4) <= e < at]
        want = (sum(ago(12) <= s < at and (e is None or e >= at) for s, e in mine), sum(ago(3) <= s < at for s, _ in mine), len(hours))
        assert (row.backlog, row.created, row.closed) == want
        assert (row.slow_share, row.median_h) == ((pytest.approx(sum(h > 100 for h in hours) / len(hours)), pytest.approx(statistics.median(hours))) if hours else (None, None))


def test_features_see_nothing_of_later_rows(spark):
    """Features of the early rows are the same with and without the late ones, apart from the region's and city's of their own day."""
    df = spark.createDataFrame(rows(3), SCHEMA).where("start_ts is not null").withColumn("code", F.lit(7)).withColumn("district", F.lit(1.5))
    early = df.where(F.col("start_ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    known = early.withColumn("end_ts", F.when(F.col("end_ts") < F.lit("2024-01-20").cast("timestamp_ntz"), F.col("end_ts")))
    whole = {r.id: r for r in ct.interval_features(df, ["code"], ["district"]).collect()}
    part = {r.id: r for r in ct.interval_features(known, ["code"], ["district"]).collect()}
    assert len(part) > 30 and all(whole[i] == r for i, r in part.items())
    some = next(r for r in whole.values() if r.y_m is None)
    assert (some.has_coords, some.place_prior_90d, some.place_days_since_prev, some.code) == (0, None, None, "7")
    assert ct.interval_features(df.limit(0), ["code"], ["district"]).collect() == []
