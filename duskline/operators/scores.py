"""Priority scores built from components, and what explains them."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskline.operators.aggregates import exact_quantiles, min_max, running_totals
from duskline.operators.dispatch import best_of_groups
from duskline.operators.windows import ecdf, tier_by_value
from duskline.session import cut


def priority_index(df: DataFrame, rate: str, days: str, tau: float, high: float = 80.0, medium: float = 40.0) -> DataFrame:
    """``raw`` = max(0, tau * rate * days), ``score`` stretched to 0..100 and ``tier``; rows without rate or days stay null and have
    the ``reason``."""
    raw = F.when(F.col(rate).isNotNull() & F.col(days).isNotNull(), F.greatest(F.lit(0.0), F.lit(tau) * F.col(rate) * F.col(days)))
    out = min_max(df.withColumn("raw", raw), "raw", "score")
    reason = F.when(F.col(rate).isNull() & F.col(days).isNull(), "no rate, no days").when(F.col(rate).isNull(), "no rate").when(F.col(days).isNull(), "no days")
    return out.withColumn("tier", tier_by_value(F.col("score"), high, medium)).withColumn("reason", reason)


def weighted_components(df: DataFrame, weights: dict[str, float], out: str = "score") -> DataFrame:
    """``out``: weighted mean of the components in [0, 1] that are there, and ``c_<name>``, their contributions, which add up to
    it. Missing components are left out and the weights renormalised; null if none has weight."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    for c, w in weights.items():
        df = df.withColumn(f"c_{c}", F.when(total > 0, F.coalesce(F.col(c) * w, F.lit(0.0)) / total))
    return df.withColumn(out, sum((F.col(f"c_{c}") for c in weights), F.lit(0.0)))


def evidence_weight(estimate: Column, lower: Column, rate: Column) -> Column:
    """0 if the interval holds 0 or the effect is not positive, else effect / rate clipped to [0, 1]."""
    return F.when((estimate <= 0) | (lower <= 0), 0.0).otherwise(F.least(F.greatest(estimate / rate, F.lit(0.0)), F.lit(1.0)))


def top_reasons(contributions: dict[str, str], top: int = 3) -> Column:
    """Names of the largest positive contributions (ties: by name), joined by ``; ``."""
    parts = F.array(*[F.struct(F.negative(F.col(c)).alias("n"), F.lit(name).alias("name")) for c, name in contributions.items()])
    return F.array_join(F.transform(F.slice(F.array_sort(F.filter(parts, lambda p: p["n"] < 0)), 1, top), lambda p: p["name"]), "; ")


def percentile_component(df: DataFrame, reference: DataFrame, col: str, out: str) -> DataFrame:
    """Component in [0, 1]: the share of the reference at or below the value."""
    return ecdf(reference, df, col, out)


def recommend_action(score: Column, days_open: Column) -> Column:
    return F.when(score >= 80, "repair").when((score >= 40) | (days_open > 30), "schedule").otherwise("monitor")


def weight_variants(weights: dict[str, float], draws: int, seed: str, least: float = 0.6, most: float = 1.4) -> dict[str, dict[str, float]]:
    """Weights by variant: each component dropped once, and ``draws`` with every weight scaled by a number between ``least`` and
    ``most`` from a hash of the seed, the draw and the component."""
    out = {f"drop {c}": weights | {c: 0.0} for c in weights}
    part = lambda d, c: int(md5(f"{seed}|{d}|{c}".encode()).hexdigest()[:12], 16) / 16**12
    return out | {f"scaled {d}": {c: w * (least + (most - least) * part(d, c)) for c, w in weights.items()} for d in range(1, draws + 1)}


def weight_sensitivity(df: DataFrame, key: str, weights: dict[str, float], variants: dict[str, dict[str, float]], top: int = 100, digits: int = 9) -> DataFrame:
    """``(variant, rows, spearman, overlap)``: how the ranking under other weights compares with that under ``weights``.

    Scores are weighted means of the components that are there (``weighted_components``), to ``digits`` digits. ``spearman`` is
    over the rows that have both scores, ties averaged; ``overlap`` is the share of the ``top`` best (ties: by key) under
    both. All variants are one axis of one table: rows are ranked by variant inside ranges of scores, and tasks keep the
    best of each variant of their own rows. Null scores take no part.
    """
    score = lambda w: F.round(sum((F.coalesce(F.col(c) * v, F.lit(0.0)) for c, v in w.items()), F.lit(0.0)) / F.nullif(sum((F.when(F.col(c).isNotNull(), F.lit(v)).otherwise(0.0) for c, v in w.items()), F.lit(0.0)), F.lit(0.0)), digits)
    every = F.array(*[F.struct(F.lit(n).alias("variant"), score(w).alias("s")) for n, w in variants.items()])
    long = cut(df.select(F.col(key).alias("_k"), score(weights).alias("base"), F.explode(every).alias("v")).select("_k", "base", "v.*").where("base is not null or s is not null"))
    both = long.where("base is not null and s is not null")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("base").alias("x")), F.struct(F.lit(1).alias("side"), F.col("s").alias("x"))))
    counts = cut(both.select("variant", sides.alias("e")).select("variant", "e.*").groupBy("variant", "side", "x").agg(F.count("*").alias("c")))
    ranked = cut(running_totals(counts, "x", {"cum": "c"}, ["variant", "side"]).select("variant", "side", "x", (F.col("cum") - (F.col("c") - 1) / 2).alias("r")))
    of = lambda side, on, name: ranked.where(F.col("side") == side).select(F.col("variant"), F.col("x").alias(on), F.col("r").alias(name))
    spearman = both.join(of(0, "base", "r0"), ["variant", "base"]).join(of(1, "s", "r1"), ["variant", "s"]).groupBy("variant").agg(F.count("*").alias("rows"), F.corr("r0", "r1").alias("spearman"))
    best = lambda col: best_of_groups(long.where(F.col(col).isNotNull()), "variant", [F.desc(col), F.col("_k")], top, "_k").select("variant", "_k")
    overlap = best("base").join(best("s"), ["variant", "_k"]).groupBy("variant").agg((F.count("*") / top).alias("overlap"))
    return spearman.join(overlap, "variant", "left").select("variant", "rows", "spearman", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def ward_summary(rows: DataFrame, wards: DataFrame, assigned: DataFrame, key: str, ward: str, score: str, people: str, area: str, per: float) -> DataFrame:
    """Per ward: rows ``n``, ``per_head`` (n / ``people`` * ``per``), ``per_km2`` (n / ``area``), mean and largest score, ``risk`` (``per_km2``
    stretched to 0..100 over the wards) and ``category`` of ``per_head`` by its exact 33rd and 67th percentiles. Wards without rows
    have 0 and no scores; a ward without people or area has null there and in what follows from it."""
    n = rows.join(assigned, key).groupBy(ward).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"))
    per_ward = cut(wards.select(ward, people, area).join(n, ward, "left").fillna(0, ["n"]).withColumn("per_head", F.expr(f"try_divide(n, {people}) * {per}D")).withColumn("per_km2", F.expr(f"try_divide(n, {area})")))
    q = exact_quantiles(per_ward, "per_head", [0.33, 0.67])
    category = F.when(F.col("per_head") > F.get("q", F.lit(1)), "High").when(F.col("per_head") > F.get("q", F.lit(0)), "Medium").when(F.col("per_head").isNotNull(), "Low")
    return min_max(per_ward, "per_km2", "risk").crossJoin(F.broadcast(q)).withColumn("category", category).drop("q")
