"""Balance verdicts, differences of coefficients, reasons and trailing windows: edge cases by hand."""

import datetime as dt
import random

import numpy as np
import pytest

from duskline.operators import context as ct
from duskline.operators import estimate as es
from duskline.operators import matching as mt
from duskline.operators import scores as sc


def test_balance_without_variance(spark):
    rows = [(1, 1.0, 1.0, 0.0, None), (1, 1.0, 1.0, 2.0, 5.0), (0, 1.0, 2.0, 1.0, 1.0), (0, 1.0, 2.0, 1.0, 2.0)]
    got = {r.variable: (r.smd, r.variance_ratio, r.passes) for r in mt.balance_table(spark.createDataFrame(rows, "role int, same double, apart double, flat double, one double"), "role", ["same", "apart", "flat", "one"]).collect()}
    assert got["same"] == (0.0, 1.0, True) and got["apart"] == (float("-inf"), 1.0, False)
    assert got["flat"] == (0.0, float("inf"), False) and got["one"] == (None, None, False)


def test_differences_use_the_covariance(spark):
    beta, cov = np.array([1.0, 3.0, -1.0]), np.array([[1.0, 0.5, 1.0], [0.5, 2.0, 0.0], [1.0, 0.0, 1.0]])
    got = {r.term: r for r in es.coef_differences(spark, ["a", "b", "c"], beta, cov, 0).collect()}
    assert (got["b"].difference, got["b"].se, got["b"].same_sign) == (2.0, pytest.approx(2**0.5), True) and got["b"].p_value == pytest.approx(0.157299, abs=1e-6)
    assert (got["c"].difference, got["c"].se, got["c"].p_value, got["c"].same_sign) == (-2.0, None, None, False)  # no variance is left


def test_reasons_of_unscored_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 1.0), (3, 1.0, None), (4, 1.0, 2.0)], "id int, rate double, days double")
    assert {r.id: (r.reason, r.score) for r in sc.priority_index(df, "rate", "days", 1.0).collect()} == {1: ("no rate, no days", None), 2: ("no rate", None), 3: ("no days", None), 4: (None, 0.0)}


def test_window_pressure_equals_a_loop(spark):
    rng, t0 = random.Random(7), dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None]), t0 + dt.timedelta(hours=rng.choice([24 * rng.randrange(-5, 90), rng.randrange(24 * 90)])), rng.random()) for _ in range(500)]
    rows += [("rare", t0 + dt.timedelta(days=89), 1.0)]
    got = {r.g: r for r in ct.window_pressure(spark.createDataFrame(rows, "g string, t timestamp_ntz, v double"), "g", "t", "v", "2024-01-01", "2024-03-20", window=10, step=4, least=8, windows=5).collect()}
    ends = [t0 + dt.timedelta(days=10 + 4 * k) for k in range(100) if t0 + dt.timedelta(days=10 + 4 * k) <= dt.datetime(2024, 3, 20)]
    now = max(t for _, t, _ in rows)
    for g in ("a", "b", None, "rare"):
        held = lambda end: [v for h, t, v in rows if h == g and end - dt.timedelta(days=10) < t <= end]  # noqa: B023, E731
        refs = [sum(w) / len(w) for w in map(held, ends) if len(w) >= 8]
        cur = held(now)
        mean = sum(cur) / len(cur) if len(cur) >= 8 else None
        ready = mean is not None and len(refs) >= 5
        assert (got[g].available, got[g].observations, got[g].reference_windows) == (ready, len(cur), len(refs))
        if ready:
            assert got[g].percentile == pytest.approx(100 * sum(m <= mean + 1e-12 for m in refs) / len(refs)) and got[g].above_range == (mean > max(refs))
        else:
            assert (got[g].percentile, got[g].above_range, got[g].level) == (None, None, None)
    assert len(got) == 4
