"""Fixed effects of units and periods: demeaning of many columns at once, joint tests, and concentrated Poisson regression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.session import cut

#: Levels of the second fixed effect: its square is what the driver solves.
MOST_PERIODS = 500
#: Rows of the dense unit-by-period blocks that a task multiplies.
UNITS = 4096


def demean_columns(df: DataFrame, unit: str, period: str, cols: dict[str, str]) -> DataFrame:
    """``df`` with new columns: each of ``cols`` (new name to SQL expression) less its unit mean and period mean plus the grand
    mean (balanced panels; null keys are a group).

    All columns are taken together: the input is computed once, grouped once by each key, and the grand means come from the
    period sums.
    """
    names = list(cols)
    base = cut(df.select("*", *[F.expr(e).cast("double").alias(f"_v_{n}") for n, e in cols.items()]))
    by_unit = base.groupBy(F.col(unit).alias("_ku")).agg(*[F.avg(f"_v_{n}").alias(f"_u_{n}") for n in names])
    sums = cut(base.groupBy(F.col(period).alias("_kp")).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names], *[F.count(f"_v_{n}").alias(f"_c_{n}") for n in names]))
    grand = sums.agg(*[(F.sum(f"_s_{n}") / F.sum(f"_c_{n}")).alias(f"_g_{n}") for n in names])
    by_period = sums.crossJoin(F.broadcast(grand)).select("_kp", *[(F.expr(f"try_divide(_s_{n}, _c_{n})") - F.col(f"_g_{n}")).alias(f"_p_{n}") for n in names])
    joined = base.join(by_unit, F.col(unit).eqNullSafe(F.col("_ku"))).join(by_period, F.col(period).eqNullSafe(F.col("_kp")))
    return joined.select(*df.columns, *[(F.col(f"_v_{n}") - F.col(f"_u_{n}") - F.col(f"_p_{n}")).alias(n) for n in names])


def _continued_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f) with ``df1`` and ``df2`` degrees of freedom: the regularised incomplete beta function."""
    if not f > 0:
        return 1.0
    a, b, x = df2 / 2, df1 / 2, df2 / (df2 + df1 * f)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x < 1 else 0.0
    return front * _continued_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued_fraction(b, a, 1 - x) / b


def wald_test(beta: np.ndarray, cov: np.ndarray, terms: list[int], df2: float) -> tuple[float, float]:
    """F statistic and p that the coefficients at ``terms`` are all zero, with ``df2`` denominator degrees of freedom."""
    b, v = beta[terms], cov[np.ix_(terms, terms)]
    f = float(b @ np.linalg.solve(v, b)) / len(terms)
    return f, f_tail(f, len(terms), df2)


def _moments(base: DataFrame, k: int, periods: int, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Concentrated log-likelihood, gradient and information at ``theta`` (k slopes, then period effects)."""
    size = k + periods

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, gradient, info = 0.0, np.zeros(size), np.zeros((size, size))
        for unit, time, times, y, x in _whole_units(batches, k):
            value, gradient, info = (a + b for a, b in zip((value, gradient, info), _concentrated(unit, time, times, y, x, theta, periods)[:3], strict=True))
        at = np.flatnonzero(np.triu(info).reshape(-1))
        cell = np.concatenate((at, size * size + np.arange(size + 1)))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate((info.reshape(-1)[at], gradient, [value])))], names=["cell", "value"])

    cells = base.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(size * size + size + 1)
    flat[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    info = flat[: size * size].reshape(size, size)
    return float(flat[-1]), flat[size * size : -1], info + np.triu(info, 1).T


def _whole_units(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows ``(unit number, period, copies, y, x)`` of whole units; a unit is held back until it is complete."""
    held: list[pa.RecordBatch] = []
    for batch in [*batches, None]:
        if batch is not None and batch.num_rows:
            held.append(batch)
        if not held or (batch is not None and sum(b.num_rows for b in held) < 50_000):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        code = table["f"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        change = np.flatnonzero(code[1:] != code[:-1]) + 1
        stop = len(code) if batch is None else (int(change[-1]) if len(change) else 0)
        if stop:
            part = table.slice(0, stop)
            starts = np.concatenate(([0], change[change < stop]))
            unit = np.zeros(stop, np.int64)
            unit[starts[1:]] = 1
            columns = [part[f"x{i}"].to_numpy() for i in range(k)]
            yield np.cumsum(unit), part["p"].to_numpy(), part["n"].to_numpy(), part["y"].to_numpy(), np.stack(columns, 1) if k else np.zeros((stop, 0))
        held = table.slice(stop).to_batches()


def _concentrated(unit: np.ndarray, time: np.ndarray, times: np.ndarray, y: np.ndarray, x: np.ndarray, theta: np.ndarray, periods: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood with each unit's effect at its best, gradient, information, and the means ``mu``.

    Given the rest, a unit's effect makes its means add up to its total, so the unit's rows are a multinomial draw.
    """
    k, units = x.shape[1], int(unit[-1]) + 1
    eta = x @ theta[:k] + theta[k:][time] + np.log(times)
    top = np.full(units, -np.inf)
    np.maximum.at(top, unit, eta)
    eta -= top[unit]
    weight = np.exp(eta)
    total, scale = np.bincount(unit, y, units), np.bincount(unit, weight, units)
    mu = total[unit] * weight / scale[unit]
    value = float(y @ eta - total @ np.log(scale))
    error = y - mu
    gradient = np.concatenate((x.T @ error, np.bincount(time, error, periods)))
    info = np.zeros((k + periods,) * 2)
    info[:k, :k] = x.T @ (x * mu[:, None])
    for i in range(k):
        info[i, k:] = np.bincount(time, mu * x[:, i], periods)
    info[k:, :k] = info[:k, k:].T
    info[np.arange(k, k + periods), np.arange(k, k + periods)] = np.bincount(time, mu, periods)
    share = np.where(total > 0, 1 / np.sqrt(np.maximum(total, 1e-300)), 0.0)
    for first in range(0, units, UNITS):
        a, b = np.searchsorted(unit, [first, first + UNITS])
        here, n = unit[a:b] - first, min(UNITS, units - first)
        columns = [np.bincount(here, mu[a:b] * x[a:b, i], n) for i in range(k)]
        dense = np.bincount(here * periods + time[a:b], mu[a:b], n * periods).reshape(n, periods)
        dense = np.concatenate((np.stack(columns, 1) if k else np.zeros((n, 0)), dense), 1) * share[first : first + n, None]
        info -= dense.T @ dense
    return value, gradient, info, mu


def ppml_two_fe(df: DataFrame, y: str, xs: list[str], fe: tuple[str, str], cluster: str, rounds: int = 40, tol: float = 1e-10, most_periods: int = MOST_PERIODS) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients, cluster-robust covariance and rows of a Poisson regression with two absorbed fixed effects.

    The effects of ``fe[0]`` (units, any number) are concentrated out: given the rest, each has a closed form, a quotient of two
    sums over the unit's rows. Those of ``fe[1]`` (periods, at most ``most_periods``, else ValueError) form a small table that
    Newton steps move together with the coefficients. The panel is dealt by unit and sorted once and never rewritten; a step is
    one pass whose sums have (coefficients + periods) squared cells. Steps that lower the likelihood are halved. RuntimeError
    if ``rounds`` steps do not bring the gradient to ``tol`` of its scale.

    Rows with a null are ignored. Groups of total 0 should be dropped first (``drop_zero_groups``); the effect of one is not
    finite. Covariance: G / (G - 1) times the sandwich of the scores of the clusters, NaN with one cluster. An empty
    table raises ValueError. Columns of equal or no variation within effects have a coefficient of least norm.
    """
    k = len(xs)
    rows = df.select(F.col(fe[0]).alias("f"), F.col(fe[1]).alias("g"), F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)], F.col(cluster).alias("c")).dropna()
    levels = rows.select("g").distinct().orderBy("g").limit(most_periods + 1).collect()
    if not levels:
        raise ValueError("no rows to fit")
    if len(levels) > most_periods:
        raise ValueError(f"{fe[1]} has more than {most_periods} levels; name the effect with more levels first")
    periods = len(levels)
    numbers = df.sparkSession.createDataFrame([(i, r.g) for i, r in enumerate(levels)], f"p long, g {rows.schema['g'].dataType.simpleString()}")
    # Equal rows are one row with their number, so a unit has no more rows than it has different ones.
    counted = rows.groupBy("f", "g", "c", *[f"x{i}" for i in range(k)]).agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    base = cut(counted.join(F.broadcast(numbers), "g").drop("g").repartition("f").sortWithinPartitions("f"))

    theta = np.zeros(k + periods)
    sums = base.groupBy("p").agg(F.sum("y").alias("s"), F.sum("n").alias("n")).collect()
    n = sum(r.n for r in sums)
    for r in sums:
        theta[k + r.p] = math.log(max(r.s, 1e-9) / r.n)
    free = np.arange(k + periods) != k  # the first period's effect is in the units' effects
    value, gradient, info = _moments(base, k, periods, theta)
    for _ in range(rounds):
        step = np.zeros_like(theta)
        step[free] = np.linalg.pinv(info[np.ix_(free, free)], hermitian=True) @ gradient[free]
        scale = np.sqrt(np.maximum(np.diag(info), 0)) + 1e-12
        if np.abs(gradient[free] / scale[free]).max() < tol * math.sqrt(n):
            break
        for _ in range(30):
            new = _moments(base, k, periods, theta + step)
            if new[0] >= value - 1e-9 * abs(value):
                break
            step /= 2
        theta, (value, gradient, info) = theta + step, new
    else:
        raise RuntimeError(f"no convergence in {rounds} steps")

    inverse = np.linalg.pinv(info[np.ix_(free, free)], hermitian=True)[:k, :k]
    delta = np.linalg.pinv(info[k + 1 :, k + 1 :], hermitian=True) @ info[k + 1 :, :k]  # period effects of each x
    delta = np.concatenate((np.zeros((1, k)), delta))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c", *[f"s{i}" for i in range(k)]]
        kept: list[pa.RecordBatch] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept.append(b)
                yield b

        for unit, time, times, target, x in _whole_units(seen(), k):
            mu = _concentrated(unit, time, times, target, x, theta, periods)[3]
            left = x - delta[time]
            weight = np.bincount(unit, mu)
            for i in range(k):
                left[:, i] -= (np.bincount(unit, mu * left[:, i]) / np.where(weight > 0, weight, 1))[unit]
            clusters = pa.Table.from_batches(kept)["c"]
            kept[:] = pa.Table.from_batches(kept).slice(len(unit)).to_batches()
            score = left * (target - mu)[:, None]
            yield from pa.table([clusters.slice(0, len(unit)), *(pa.array(score[:, i]) for i in range(k))], names).to_batches()

    kind = rows.schema["c"].dataType.simpleString()
    by_cluster = base.mapInArrow(scores, ", ".join([f"c {kind}", *[f"s{i} double" for i in range(k)]])).groupBy("c").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = by_cluster.agg(F.count("*").alias("clusters"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    meat = np.zeros((k, k))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = r[f"m{i}_{j}"]
    factor = r.clusters / (r.clusters - 1) if r.clusters > 1 else float("nan")
    return theta[:k], factor * inverse @ meat @ inverse, n
