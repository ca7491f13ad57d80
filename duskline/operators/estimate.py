"""Estimators: Spark sums cross products and cluster scores; only the k x k algebra happens on the driver (k columns)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.functions import normal_p
from duskline.session import cut

#: The 97.5th percentile of the normal distribution.
Z95 = 1.959963984540054


def mean_cluster_se(df: DataFrame, value: str, cluster: str, by: list[str] | None = None) -> DataFrame:
    """Mean, rows, clusters and cluster-robust standard error: sqrt(G / (G - 1) * sum of squared cluster sums) / n; null
    with fewer than two clusters. One result row per group of ``by``."""
    by = by or []
    means = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("estimate"), F.count("*").alias("n")) if by else df.where(F.col(value).isNotNull()).agg(F.avg(value).alias("estimate"), F.count("*").alias("n"))
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count("*").alias("_c"))
    j = sums.join(F.broadcast(means), by) if by else sums.crossJoin(F.broadcast(means))
    e = (F.col("_s") - F.col("_c") * F.col("estimate")) ** 2
    g = F.count("*")
    return j.groupBy(*by, "estimate", "n").agg(g.alias("clusters"), F.when(g > 1, F.sqrt(g / (g - 1) * F.sum(e)) / F.first("n")).alias("se"))


def net_effect(df: DataFrame, x: str, y: str, cluster: str) -> DataFrame:
    """Means of x and y, the net effect x + y and its cluster-robust standard error (Var x + Var y + 2 Cov), ratio -y / x."""
    m = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.count("*").alias("n"))
    s = df.crossJoin(F.broadcast(m)).groupBy(cluster, "mx", "my", "n").agg(F.sum(F.col(x) - F.col("mx")).alias("sx"), F.sum(F.col(y) - F.col("my")).alias("sy"))
    k = F.count("*") / (F.count("*") - 1) / F.first("n") ** 2
    cov = lambda a, b: (F.sum(F.col(a) * F.col(b)) * k)
    out = s.groupBy("mx", "my").agg(cov("sx", "sx").alias("vx"), cov("sy", "sy").alias("vy"), cov("sx", "sy").alias("cxy"))
    return out.select("mx", "my", (F.col("mx") + F.col("my")).alias("net"), F.sqrt(F.col("vx") + F.col("vy") + 2 * F.col("cxy")).alias("net_se"), F.when(F.abs("mx") > 1e-9, -F.col("my") / F.col("mx")).alias("ratio"))


def _gram(df: DataFrame, xs: list[Column], y: Column, w: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    k = len(xs)
    w = F.lit(1.0) if w is None else w
    cells = [F.sum(w * xs[i] * xs[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(w * xs[i] * y).alias(f"b{i}") for i in range(k)]
    r = df.agg(F.count("*").alias("n"), *cells).first()
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = r[f"g{i}_{j}"] or 0.0
    return a, np.array([r[f"b{i}"] or 0.0 for i in range(k)]), r.n


def _meat(df: DataFrame, xs: list[Column], residual: Column, clusters: list[str]) -> tuple[np.ndarray, int]:
    k = len(xs)
    scores = df.groupBy(*clusters).agg(*[F.sum(xs[i] * residual).alias(f"s{i}") for i in range(k)])
    cells = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
    r = scores.agg(F.count("*").alias("g"), *cells).first()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = r[f"m{i}_{j}"] or 0.0
    return m, r.g


def ols_cluster(df: DataFrame, y: str, xs: list[str], clusters: list[list[str]], small_sample: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients, their robust covariance and rows of the regression of ``y`` on ``xs`` (SQL expressions).

    One grouping in ``clusters`` gives one-way clustering; three (a, b, a and b together) give V_a + V_b - V_ab. Each part
    has the factor G / (G - 1) * (n - 1) / (n - k).
    """
    cols = [F.expr(x).cast("double") for x in xs]
    target = F.col(y).cast("double")
    gram, b, n = _gram(df, cols, target)
    inverse = np.linalg.pinv(gram)
    beta = inverse @ b
    residual = target - sum((c * float(v) for c, v in zip(cols, beta, strict=True)), F.lit(0.0))
    cov = np.zeros_like(gram)
    for sign, names in zip((1, 1, -1), clusters, strict=False):
        meat, g = _meat(df, cols, residual, names)
        factor = g / (g - 1) * ((n - 1) / (n - len(xs)) if small_sample else 1.0) if g > 1 else float("nan")
        cov += sign * factor * (inverse @ meat @ inverse)
    return beta, cov, n


def effect_table(spark: SparkSession, names: list[str], beta: np.ndarray, cov: np.ndarray, n: int) -> DataFrame:
    """One row per coefficient: estimate, standard error, 95 % interval, two-sided normal p, rows. A negative variance, which
    two-way clustering can give, leaves the estimate without inference."""
    rows = []
    for i, name in enumerate(names):
        se = math.sqrt(cov[i, i]) if cov[i, i] >= 0 else None  # not with one cluster either, whose variance is NaN
        p = normal_p(beta[i] / se) if se else None
        ends = [None, None] if se is None else [float(beta[i] + side * Z95 * se) for side in (-1, 1)]
        rows.append((name, float(beta[i]), se, *ends, p, n))
    return spark.createDataFrame(rows, "term string, estimate double, se double, ci_lower double, ci_upper double, p_value double, n long")


def coef_differences(spark: SparkSession, names: list[str], beta: np.ndarray, cov: np.ndarray, base: int) -> DataFrame:
    """Each other coefficient less the one at ``base``: ``difference``, its standard error from the covariance (variances less twice
    the covariance), ``z``, two-sided normal p and whether the signs agree. No inference where the variance is not positive."""
    rows = []
    for i, name in enumerate(names):
        if i != base:
            d, v = float(beta[i] - beta[base]), float(cov[i, i] + cov[base, base] - 2 * cov[i, base])
            se = math.sqrt(v) if v > 0 else None
            rows.append((name, float(beta[i]), d, se, d / se if se else None, normal_p(d / se) if se else None, bool(np.sign(beta[i]) == np.sign(beta[base]))))
    return spark.createDataFrame(rows, "term string, estimate double, difference double, se double, z double, p_value double, same_sign boolean")


def effect_summary(df: DataFrame, x: str, y: str, cluster: str, names: tuple[str, str]) -> DataFrame:
    """Rows for the means of ``x`` and ``y``, their sum ``net`` and their ``ratio`` -y / x: estimate, cluster-robust standard
    error, variance, 95 % interval, p, pairs and clusters. The ratio has no inference; none has with one cluster."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    long = both.select(cluster, F.explode(F.array(*[F.struct(F.lit(n).alias("term"), v.cast("double").alias("v")) for n, v in ((names[0], F.col(x)), (names[1], F.col(y)), ("net", F.col(x) + F.col(y)))])).alias("e")).select(cluster, "e.term", "e.v")
    rows = []
    for r in mean_cluster_se(long, "v", cluster, ["term"]).collect():  # three rows
        ends = [None, None] if r.se is None else [r.estimate + side * Z95 * r.se for side in (-1, 1)]
        rows.append((r.term, r.estimate, r.n, r.clusters, r.se, None if r.se is None else r.se**2, *ends, normal_p(r.estimate / r.se) if r.se else None))
    done = df.sparkSession.createDataFrame(rows, "term string, estimate double, pairs long, clusters long, se double, variance double, ci_lower double, ci_upper double, p_value double")
    ratio = both.agg(F.lit("ratio").alias("term"), F.expr(f"-try_divide(avg({y}), avg({x}))").alias("estimate"), F.count("*").alias("pairs"), F.countDistinct(cluster).alias("clusters"))
    return done.unionByName(ratio, allowMissingColumns=True)


def poisson_cluster(df: DataFrame, y: str, xs: list[str], cluster: str, family: str = "poisson", rounds: int = 50, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, int]:
    """Poisson (or NB2 with dispersion 1) regression with log link by iterated weighted least squares; cluster-robust
    covariance, NaN with one cluster.

    Rows with equal covariates and outcome are counted first and cut, so a round is one Gram aggregate over the distinct
    ones. RuntimeError if ``rounds`` rounds do not settle the coefficients to ``tol``. Rows with a null are ignored.
    """
    names = [f"_x{i}" for i in range(len(xs))]
    rows = df.select(F.col(y).cast("double").alias("_y"), *[F.expr(x).cast("double").alias(n) for x, n in zip(xs, names, strict=True)], F.col(cluster).alias("_c")).dropna()
    distinct = cut(rows.groupBy("_y", *names).agg(F.count("*").cast("double").alias("_n")))
    cols, target, times = [F.col(c) for c in names], F.col("_y"), F.col("_n")
    total = distinct.agg((F.sum(target * times) / F.sum(times)).alias("m"), F.sum(times).cast("long").alias("n")).first()
    if total.n is None:
        raise ValueError("no rows to fit")
    weight = lambda mu: mu / (1 + mu) if family == "nb2" else mu
    beta, eta = np.zeros(len(xs)), F.lit(math.log(max(total.m, 1e-6)))
    for step in range(rounds):
        mu = F.exp(eta)
        gram, b, _ = _gram(distinct, cols, eta + (target - mu) / mu, times * weight(mu))
        new = np.linalg.pinv(gram) @ b
        moved = np.abs(new - beta).max()
        beta = new
        eta = sum((c * float(v) for c, v in zip(cols, beta, strict=True)), F.lit(0.0))
        if step and moved < tol * max(1.0, np.abs(beta).max()):
            break
    else:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    mu = F.exp(eta)
    gram, _, _ = _gram(distinct, cols, eta, times * weight(mu))
    meat, g = _meat(rows, cols, (target - mu) / (1 + mu) if family == "nb2" else target - mu, ["_c"])
    inverse = np.linalg.pinv(gram)
    return beta, (g / (g - 1) if g > 1 else float("nan")) * inverse @ meat @ inverse, total.n


def drop_zero_groups(df: DataFrame, y: str, keys: list[str]) -> DataFrame:
    """Rows of groups whose total is positive for every key, repeated until nothing is dropped."""
    df = cut(df)
    n = df.count()
    while True:
        for k in keys:
            df = df.join(df.groupBy(k).agg(F.sum(y).alias("_t")).where("_t > 0").select(k), k, "left_semi")
        df = cut(df)
        if (m := df.count()) == n:
            return df
        n = m
