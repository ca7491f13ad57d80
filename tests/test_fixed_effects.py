"""Fixed-effects Poisson, negative binomial, joint tests and demeaning against direct algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskline.operators import estimate as es
from duskline.operators import fixed_effects as fx


def dummies_fit(data):
    """Slope, its clustered variance and rows of the regression with a dummy a unit and a period."""
    us, times = sorted({r[0] for r in data}), sorted({r[1] for r in data})
    design = np.array([[r[2], *[float(r[0] == u) for u in us], *[float(r[1] == t) for t in times[1:]]] for r in data])
    y, b = np.array([r[4] for r in data], float), np.zeros(design.shape[1])
    for _ in range(200):
        mu = np.exp(design @ b)
        b = b + np.linalg.solve(design.T @ (design * mu[:, None]), design.T @ (y - mu)) * 0.7
    inverse = np.linalg.inv(design.T @ (design * mu[:, None]))
    c = np.array([r[3] for r in data])
    s = np.array([(design[c == k] * (y - mu)[c == k, None]).sum(0) for k in np.unique(c)])
    return b[0], len(s) / (len(s) - 1) * (inverse @ s.T @ s @ inverse)[0, 0], len(data)


@pytest.mark.parametrize("seed", range(3))
def test_ppml_slope_and_variance_equal_dummies(spark, seed, monkeypatch):
    monkeypatch.setattr(fx, "UNITS", 3)
    rng = np.random.default_rng(seed)
    data = [(u, t, float(rng.integers(0, 3)), int(u % 5), int(rng.poisson(np.exp(0.1 * u + 0.2 * t)) + 1)) for u in range(11) for t in range(5) for _ in range(1 + (u == 3) * 40)]  # unit 3 is hot
    df = spark.createDataFrame(data, "u int, t int, x double, c int, y int")
    beta, cov, n = fx.ppml_two_fe(df, "y", ["x"], ("u", "t"), "c")
    want = dummies_fit(data)
    assert (beta[0], cov[0, 0], n) == (pytest.approx(want[0], abs=1e-8), pytest.approx(want[1], rel=1e-6), want[2])


def test_ppml_cases(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(u, t, float(rng.normal()), 1, int(rng.poisson(3) + 1)) for u in range(6) for t in range(4)], "u int, t int, x double, c int, y int")
    with pytest.raises(RuntimeError, match="no convergence in 1 steps"):
        fx.ppml_two_fe(df, "y", ["x"], ("u", "t"), "c", rounds=1)
    with pytest.raises(ValueError, match="more than 3 levels"):
        fx.ppml_two_fe(df, "y", ["x"], ("u", "t"), "c", most_periods=3)
    with pytest.raises(ValueError, match="no rows"):
        fx.ppml_two_fe(df.limit(0), "y", ["x"], ("u", "t"), "c")
    beta, cov, n = fx.ppml_two_fe(df.unionByName(df.limit(3).withColumn("x", F.lit(None).cast("double"))), "y", ["x"], ("u", "t"), "c")
    assert n == 24 and math.isnan(cov[0, 0])  # rows with a null are left out; one cluster has no variance
    assert es.effect_table(spark, ["x"], beta, cov, n).first().se is None


def test_nb2_and_poisson_on_a_continuous_covariate(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=300)
    y, c = rng.poisson(np.exp(0.5 + 0.4 * x) * rng.gamma(1, 1, 300)).astype(float), rng.integers(0, 20, 300)
    df = spark.createDataFrame([(float(a), float(b), int(k)) for a, b, k in zip(x, y, c, strict=True)], "x double, y double, c int")
    X, found = np.column_stack((np.ones(300), x)), {}
    for family in ("poisson", "nb2"):
        b = np.zeros(2)
        for _ in range(100):
            mu = np.exp(X @ b)
            v = 1 + mu if family == "nb2" else 1.0
            b = b + np.linalg.solve(X.T @ (X * (mu / v)[:, None]), X.T @ ((y - mu) / v))
        inverse = np.linalg.inv(X.T @ (X * (mu / v)[:, None]))
        s = np.array([(X[c == k] * ((y - mu) / v)[c == k, None]).sum(0) for k in np.unique(c)])
        beta, cov, n = es.poisson_cluster(df, "y", ["1", "x"], "c", family)
        assert beta == pytest.approx(b, abs=1e-8) and cov == pytest.approx(len(s) / (len(s) - 1) * inverse @ s.T @ s @ inverse) and n == 300
        found[family] = b[1]
    assert abs(found["poisson"] - found["nb2"]) > 1e-3
    with pytest.raises(RuntimeError, match="no convergence in 2 rounds"):
        es.poisson_cluster(df, "y", ["1", "x"], "c", rounds=2)
    assert np.isnan(es.poisson_cluster(df.withColumn("c", F.lit(1)), "y", ["1", "x"], "c")[1]).all()
    with pytest.raises(ValueError, match="no rows"):
        es.poisson_cluster(df.limit(0), "y", ["1", "x"], "c")


@pytest.mark.parametrize(("f", "a", "b"), [(0.3, 3, 49), (2.8, 3, 49), (9.0, 1, 5), (1.0, 8, 200), (40.0, 2, 12)])
def test_f_tail_equals_its_integral(f, a, b):
    t = (np.arange(400_000) + 0.5) / 400_000 * (b / (b + a * f))
    want = (t ** (b / 2 - 1) * (1 - t) ** (a / 2 - 1)).sum() * (b / (b + a * f)) / 400_000 * math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2))
    assert fx.f_tail(f, a, b) == pytest.approx(want, rel=1e-4, abs=1e-9)
    assert fx.f_tail(0.0, a, b) == 1 and fx.f_tail(float("nan"), a, b) == 1


def test_demean_columns_together(spark):
    rows = [(u, t, float((u or 5) * t * t + t)) for u in (1, 2, None) for t in (1, 2, 3)]
    df = spark.createDataFrame(rows, "u int, t int, y double")
    got = {(r.u, r.t): (r.a, r.b) for r in fx.demean_columns(df, "u", "t", {"a": "y", "b": "2 * y"}).collect()}
    y = {(r.u, r.t): r.y for r in df.collect()}
    mean = lambda f: np.mean([v for k, v in y.items() if f(k)])
    for (u, t), (a, b) in got.items():
        want = y[u, t] - mean(lambda k: k[0] == u) - mean(lambda k: k[1] == t) + mean(lambda k: True)  # noqa: B023
        assert (a, b) == (pytest.approx(want), pytest.approx(2 * want))
    assert len(got) == 9
