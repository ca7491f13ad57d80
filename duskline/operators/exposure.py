"""Exposure panels: cells by weeks with outcome counts and open nights in distance bands, and variants of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.operators.aggregates import explode_nights
from duskline.operators.estimate import Z95, mean_cluster_se
from duskline.operators.spatial import band_join, count_in_windows
from duskline.operators.windows import fill_gaps
from duskline.session import cut


def open_nights(intervals: DataFrame, origin: str, horizon: int) -> DataFrame:
    """Distinct ``(x_m, y_m, night)`` on which some interval of the site was open."""
    return explode_nights(intervals.where("end_ts is not null"), origin, horizon).select("x_m", "y_m", "night").distinct()


def exposure_panel(points: DataFrame, nights: DataFrame, size: float, edges: list[float], origin: str, weeks: int) -> DataFrame:
    """Balanced ``(cell, week)`` rows: outcome ``y`` (points in the cell), ``x_<band>`` (open site-nights in each band around the
    cell's centre). Cells are those with a point; zeros are kept."""
    week = F.floor(F.expr(f"timestampdiff(microsecond, timestamp_ntz '{origin}', t)") / 6.048e11).cast("int")
    at = points.select(F.floor(F.col("x_m") / size).cast("long").alias("gx"), F.floor(F.col("y_m") / size).cast("long").alias("gy"), week.alias("week")).where(F.col("week").between(0, weeks - 1))
    y = at.groupBy("gx", "gy", "week").agg(F.count("*").alias("y"))
    cells = at.select("gx", "gy").distinct()
    sites = nights.select(F.col("x_m").alias("bx"), F.col("y_m").alias("by")).distinct()
    centres = cells.withColumn("x_m", (F.col("gx") + 0.5) * size).withColumn("y_m", (F.col("gy") + 0.5) * size)
    edges_of = band_join(centres, sites, edges).select("gx", "gy", F.col("bx").alias("x_m"), F.col("by").alias("y_m"), "band")
    per = nights.withColumn("week", F.floor(F.col("night") / 7).cast("int")).where(F.col("week") < weeks).groupBy("x_m", "y_m", "week").agg(F.count("*").alias("nights"))
    x = edges_of.join(per, ["x_m", "y_m"]).groupBy("gx", "gy", "week").agg(*[F.sum(F.when(F.col("band") == i, F.col("nights")).otherwise(0)).alias(f"x_{i}") for i in range(len(edges))])
    spine = cells.select("gx", "gy", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("week"))
    return spine.join(y, ["gx", "gy", "week"], "left").join(x, ["gx", "gy", "week"], "left").fillna(0)


def aggregate_periods(panel: DataFrame, weeks: int = 2) -> DataFrame:
    """Sums over blocks of weeks."""
    xs = [c for c in panel.columns if c == "y" or c.startswith("x_")]
    return panel.groupBy("gx", "gy", F.floor(F.col("week") / weeks).cast("int").alias("period")).agg(*[F.sum(c).alias(c) for c in xs])


def scenario_nights(intervals: DataFrame, name: str, origin: str, horizon: int, deadline: tuple[float, float] = (55.0, 60.0)) -> DataFrame:
    """Open nights under a timing scenario: ``base`` (closed intervals), ``open`` (also those without an end, up to the
    horizon), ``early`` (start 7 days sooner), ``half`` (half the length), ``deadline`` (without lengths of those hours, which a
    closing rule may have set), ``gap<n>`` (gaps of at most n nights at a site closed)."""
    length = F.expr("timestampdiff(second, start_ts, end_ts)")
    if name == "early":
        intervals = intervals.withColumn("start_ts", F.expr("start_ts - interval 7 days"))
    elif name == "half":
        intervals = intervals.withColumn("_h", F.floor(length / 2)).withColumn("end_ts", F.expr("start_ts + make_dt_interval(0, 0, 0, _h)")).drop("_h")
    elif name == "open":
        intervals = intervals.withColumn("end_ts", F.expr(f"coalesce(end_ts, timestamp_ntz '{origin}' + interval {horizon} days)")).where("end_ts >= start_ts")
    elif name == "deadline":
        intervals = intervals.where(~(length / 3600).between(*deadline))
    nights = open_nights(intervals, origin, horizon)
    if name.startswith("gap"):
        keyed = nights.withColumn("site", F.struct("x_m", "y_m"))
        nights = fill_gaps(keyed, "site", "night", int(name[3:])).select("site.x_m", "site.y_m", "night")
    return nights


def build_pair_panel(pairs: DataFrame, points: DataFrame, radii: list[float], pre: int, post: int) -> DataFrame:
    """Unit by period rows of matched pairs (pair, t_x, t_y, c_x, c_y, start_ts, end_ts; further columns are kept): the points
    (x_m, y_m, t) within each radius of the treated (treatment 1) and the control place before (``pre`` days up to the start,
    exclusive), during (both ends inclusive) and after (``post`` days from the end, exclusive), the days of each period and
    ``baseline``, the unit's own count before within the first radius."""
    side = lambda t, x, y: F.struct(F.lit(t).alias("treatment"), F.col(x).alias("x_m"), F.col(y).alias("y_m"))
    rest = [c for c in pairs.columns if c not in ("t_x", "t_y", "c_x", "c_y")]
    units = pairs.select(*rest, F.explode(F.array(side(1, "t_x", "t_y"), side(0, "c_x", "c_y"))).alias("s")).select(*rest, "s.*").withColumn("unit", F.concat("pair", F.when(F.col("treatment") == 1, "_T").otherwise("_C")))
    windows = {"pre": (f"start_ts - interval {pre} days", "start_ts", "[)"), "during": ("start_ts", "end_ts", "[]"), "post": ("end_ts", f"end_ts + interval {post} days", "(]")}
    # A unit's columns are its key, so that counts need no join to come back to it.
    counts = count_in_windows(units.select(F.struct("*").alias("_unit"), "x_m", "y_m", "start_ts", "end_ts"), points, windows, radii, key="_unit").select("_unit.*", *[f"{w}_{i}" for w in windows for i in range(len(radii))])
    within = lambda name, i: sum(F.col(f"{name}_{j}") for j in range(i + 1))
    days = {"pre": F.lit(float(pre)), "during": F.expr("timestampdiff(second, start_ts, end_ts)") / 86400, "post": F.lit(float(post))}
    rows = [F.struct(F.lit(name).alias("period"), F.lit(k).alias("period_order"), F.lit(int(name == "post")).alias("post"), days[name].cast("double").alias("days"), *[within(name, i).alias(f"y_{r:g}") for i, r in enumerate(radii)]) for k, name in enumerate(windows)]
    return counts.select(*rest, "unit", "treatment", "x_m", "y_m", within("pre", 0).alias("baseline"), F.explode(F.array(*rows)).alias("p")).select("*", "p.*").drop("p")


def pair_effects(panel: DataFrame, y: str, cluster: str, period: str = "post") -> DataFrame:
    """Per pair the change of the daily rate from before to ``period``, treated less control; pairs with an empty period of no
    days are left out."""
    sign = F.when(F.col("period") == period, 1).when(F.col("period") == "pre", -1)
    d = panel.where(F.col("period").isin("pre", period)).groupBy("pair", cluster).agg(F.sum(sign * (2 * F.col("treatment") - 1) * F.expr(f"try_divide({y}, days)")).alias("d"), F.count(F.expr(f"try_divide({y}, days)")).alias("n"))
    return d.where("n = 4").drop("n")


def spec_effects(pairs: DataFrame, points: DataFrame, specs: dict[str, tuple[float, int, int]], cluster: str) -> DataFrame:
    """``(pair, cluster, <spec> ...)``: what ``pair_effects`` of ``build_pair_panel`` gives for each parameter set (radius, days before,
    days after), null where a period has no days. All sets are read off one count of the points around the places."""
    radii = sorted({r for r, _, _ in specs.values()})
    before, after = {pre for _, pre, _ in specs.values()}, {post for _, _, post in specs.values()}
    windows = {f"pre{d}": (f"start_ts - interval {d} days", "start_ts", "[)") for d in sorted(before)} | {f"post{d}": ("end_ts", f"end_ts + interval {d} days", "(]") for d in sorted(after)}
    side = lambda t, x, y: F.struct(F.lit(t).alias("treatment"), F.col(x).alias("x_m"), F.col(y).alias("y_m"))
    units = pairs.select("pair", cluster, "start_ts", "end_ts", F.explode(F.array(side(1, "t_x", "t_y"), side(0, "c_x", "c_y"))).alias("s")).select("pair", cluster, "start_ts", "end_ts", "s.*")
    units = units.withColumn("unit", F.struct("pair", cluster, "treatment"))
    counts = count_in_windows(units.select("unit", "x_m", "y_m", "start_ts", "end_ts"), points, windows, radii, key="unit")
    daily = lambda window, r, days: F.try_divide(sum(F.col(f"{window}_{i}") for i in range(radii.index(r) + 1)).cast("double"), F.lit(float(days)))
    change = [F.sum((2 * F.col("treatment") - 1) * (daily(f"post{post}", r, post) - daily(f"pre{pre}", r, pre))).alias(name) for name, (r, pre, post) in specs.items()]
    whole = counts.select("unit.*", *counts.columns[1:]).groupBy("pair", cluster).agg(*change, F.count("*").alias("_n"))
    return whole.where("_n = 2").drop("_n")


def robustness_grid(pairs: DataFrame, points: DataFrame, specs: dict[str, tuple[float, int, int]], cluster: str) -> DataFrame:
    """Mean effects after the interval under parameter sets (radius, days before, days after), all from one count of the points:
    estimate, cluster-robust standard error, difference from the first set's estimate, whether the sign is the same and
    whether the 95 % interval holds 0."""
    effects = cut(spec_effects(pairs, points, specs, cluster))
    parts = [mean_cluster_se(effects.where(F.col(name).isNotNull()).select(F.col(name).alias("d"), cluster), "d", cluster).select(F.lit(name).alias("spec"), "estimate", "se") for name in specs]
    grid = cut(reduce(DataFrame.unionByName, parts))
    base = grid.where(F.col("spec") == next(iter(specs))).select(F.col("estimate").alias("base"))
    at = grid.crossJoin(F.broadcast(base))
    return at.select("spec", "estimate", "se", (F.col("estimate") - F.col("base")).alias("difference"), (F.signum("estimate") == F.signum("base")).alias("same_sign"), (F.abs("estimate") <= Z95 * F.col("se")).alias("holds_zero"))
