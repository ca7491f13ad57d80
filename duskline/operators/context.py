"""What was known at midnight of each day: backlog, arrivals and closures of a region and of the city, and features from them.

An interval is open, new or lately closed on a run of days. It adds one on the first of them and takes one away after the
last, so the state of a day is a running sum over the days and no day is joined with the intervals before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskline.operators.aggregates import exact_quantiles, join_groups
from duskline.operators.cleaning import location_key
from duskline.operators.windows import prior_count, since_previous
from duskline.session import cut

_COUNTS = ("backlog", "created", "closed", "slow")


def _day(ts: str) -> Column:
    return F.unix_date(F.expr(f"to_date({ts})"))


def daily_context(df: DataFrame, region: str = "region", start: str = "start_ts", end: str = "end_ts", backlog_days: int = 60, volume_days: int = 7, closure_days: int = 14, slow_hours: float = 168.0) -> DataFrame:
    """``(region, day, backlog, created, closed, slow_share, median_h)`` for every region and day from the first start to the
    last, and the same of the whole city with region null. ``day`` counts from 1970-01-01; it is seen at its midnight.

    ``backlog``: started in the ``backlog_days`` before and not ended before. ``created``: started in the ``volume_days`` before.
    ``closed``: ended in the ``closure_days`` before; of these ``slow_share`` lasted more than ``slow_hours`` and ``median_h`` is
    the exact median of hours, both null if there are none. Intervals without a start, or that end before it, are left out; those
    without an end stay open. A null region is named ``UNKNOWN``. An empty table gives an empty result.
    """
    rows = df.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    seconds = F.expr(f"timestampdiff(microsecond, {start}, {end})") / 1e6
    rows = rows.select(F.coalesce(F.col(region).cast("string"), F.lit("UNKNOWN")).alias("r"), _day(start).alias("s"), _day(end).alias("e"), seconds.alias("sec"))
    rows = cut(rows.groupBy("r", "s", "e", "sec").agg(F.count("*").alias("n")))
    steps = lambda measure, first, last, weight: [F.struct(F.lit(measure).alias("m"), at.alias("day"), (sign * weight).cast("long").alias("v")) for at, sign in ((first, 1), (last + 1, -1))]
    n, s, e = F.col("n"), F.col("s"), F.col("e")
    last_open = F.least(s + backlog_days, e)  # least() passes over a null end
    held = F.when(last_open > s, n).otherwise(F.lit(0))
    lately = F.when(e.isNotNull(), n).otherwise(F.lit(0))
    slow = F.when(F.col("sec") > slow_hours * 3600, n).otherwise(F.lit(0))
    moves = F.array(*steps("backlog", s + 1, last_open, held), *steps("created", s + 1, s + volume_days, n), *steps("closed", e + 1, e + closure_days, lately), *steps("slow", e + 1, e + closure_days, slow))
    moves = rows.select("r", F.explode(moves).alias("x")).select("r", "x.*").where("day is not null and v <> 0")
    daily = moves.groupBy("r", "day").agg(*[F.sum(F.when(F.col("m") == m, F.col("v"))).alias(m) for m in _COUNTS])
    span = rows.agg(F.min("s").alias("a"), F.max("s").alias("z"))
    spine = rows.select("r").distinct().crossJoin(F.broadcast(span)).select("r", F.explode(F.expr("sequence(a, z)")).alias("day"), F.lit(True).alias("shown"))
    every = cut(spine.join(daily, ["r", "day"], "full_outer").fillna(0, list(_COUNTS)))  # a row a region and day
    run = Window.partitionBy("r").orderBy("day")
    regional = cut(every.select("r", "day", "shown", *[F.sum(m).over(run).alias(m) for m in _COUNTS]).where("shown").drop("shown"))
    city = regional.groupBy("day").agg(*[F.sum(m).alias(m) for m in _COUNTS]).withColumn("r", F.lit(None).cast("string"))

    # Closures by day and length, each seen on the days after it, by its region and by the city.
    closed = rows.where("e is not null").select("e", "sec", "n", F.explode(F.array(F.col("r"), F.lit(None).cast("string"))).alias("r")).groupBy("r", "e", "sec").agg(F.sum("n").alias("n"))
    seen = closed.select("r", F.explode(F.sequence(F.col("e") + 1, F.col("e") + closure_days)).alias("day"), "sec", "n")
    medians = exact_quantiles(seen, "sec", [0.5], ["r", "day"], weight="n").select("r", "day", (F.get("q", F.lit(0)) / 3600).alias("median_h"))
    both = regional.select("r", "day", *_COUNTS).unionByName(city)
    out = both.join(medians.withColumnsRenamed({"r": "_r", "day": "_d"}), F.col("r").eqNullSafe(F.col("_r")) & (F.col("day") == F.col("_d")), "left")
    return out.select(F.col("r").alias(region), "day", "backlog", "created", "closed", F.expr("try_divide(slow, closed)").alias("slow_share"), "median_h")


def interval_features(df: DataFrame, codes: list[str], numbers: list[str], places: list[tuple[str, list[Column]]] | None = None, slow_hours: float = 168.0, backlog_days: int = 60, volume_days: int = 7, closure_days: int = 14) -> DataFrame:
    """``id`` and the features of each interval (id, region, start_ts, end_ts, x_m, y_m), of what was known when it started.

    The region and ``codes`` as categories (text); of its start hour, weekday from Monday = 0, month, weekend and business hours;
    coordinates and whether it has them; ``numbers``; at the same place (``location_key`` of ``places``, by default the
    coordinates; nulls without one) the strictly earlier
    starts of 90 and 365 days and the days since the last; and the daily context of its region and the city's median. Of a
    repeated id each row has its features. An empty table gives an empty result.
    """
    context = cut(daily_context(df, backlog_days=backlog_days, volume_days=volume_days, closure_days=closure_days, slow_hours=slow_hours))
    regional = context.where("region is not null").select(F.col("region").alias("_region"), F.col("day").alias("_day"), *[F.col(c).alias(f"region_{c}") for c in ("backlog", "created", "closed", "median_h", "slow_share")])
    city = context.where("region is null").select(F.col("day").alias("_cday"), F.col("median_h").alias("city_median_h"))
    weekday, hour = F.weekday("start_ts"), F.hour("start_ts")
    placed = df.withColumn("place", location_key(places or [("C", [F.col("x_m").cast("string"), F.col("y_m").cast("string")])])).withColumn("region", F.coalesce(F.col("region").cast("string"), F.lit("UNKNOWN"))).withColumn("_at", _day("start_ts"))
    timed = since_previous(prior_count(prior_count(placed, "place", "start_ts", 90, "place_prior_90d"), "place", "start_ts", 365, "place_prior_365d"), "place", "start_ts", "_since")
    known = F.col("place").isNotNull()
    joined = timed.join(regional, (F.col("region") == F.col("_region")) & (F.col("_at") == F.col("_day")), "left").join(city, F.col("_at") == F.col("_cday"), "left")
    return joined.select(
        "id", "region", *[F.col(c).cast("string").alias(c) for c in codes], hour.alias("hour"), weekday.alias("dow"), F.month("start_ts").alias("month"), (weekday >= 5).cast("int").alias("is_weekend"),
        ((hour >= 8) & (hour < 18) & (weekday < 5)).cast("int").alias("is_business_hours"), "x_m", "y_m", (F.col("x_m").isNotNull() & F.col("y_m").isNotNull()).cast("int").alias("has_coords"), *numbers,
        *[F.when(known, F.col(c)).alias(c) for c in ("place_prior_90d", "place_prior_365d")], F.when(known, F.col("_since") / 86400).alias("place_days_since_prev"),
        "region_backlog", "region_created", "region_closed", "region_median_h", "city_median_h", "region_slow_share")


def window_pressure(df: DataFrame, group: str, ts: str, value: str, first: str, last: str, window: int = 28, step: int = 7, least: int = 30, windows: int = 10) -> DataFrame:
    """How each group's latest trailing window of ``window`` days compares with its own history.

    Reference windows end every ``step`` days, from ``first`` (a date) plus ``window`` days up to ``last``; the current one ends
    at the latest time of the table. A window is open at its start and closed at its end, and has a mean of ``value`` only with
    ``least`` rows. Columns: ``available`` (the current mean is there and ``windows`` reference means are), ``observations`` of the
    current window, ``mean``, ``reference_windows``, ``percentile`` (share of the reference means at or below it, in percent),
    ``above_range`` (above all of them) and ``level`` (High from 80, Moderate from 40, else Low); what is not available is null.
    Each row goes to the few windows that hold it, so nothing is joined on time ranges. Null groups are a group.
    """
    days = F.expr(f"timestampdiff(microsecond, timestamp_ntz '{first} 00:00:00', {ts})") / 8.64e10
    span = F.expr(f"datediff(date '{last}', date '{first}')")
    rows = df.where(F.col(ts).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), days.alias("x"))
    low, high = F.greatest(F.ceil((F.col("x") - window) / step), F.lit(0)), F.least(F.ceil(F.col("x") / step) - 1, F.floor((span - window) / step))
    placed = rows.withColumn("k", F.explode(F.when(low <= high, F.sequence(low.cast("long"), high.cast("long")))))
    reference = placed.groupBy("g", "k").agg(F.when(F.count("v") >= least, F.avg("v")).alias("m")).where("m is not null")
    latest = rows.agg(F.max("x").alias("z"))
    current = rows.crossJoin(F.broadcast(latest)).groupBy("g").agg(F.count(F.expr(f"case when x > z - {window} then v end")).alias("n"), F.avg(F.expr(f"case when x > z - {window} then v end")).alias("mean"))
    current = current.withColumn("mean", F.when(F.col("n") >= least, F.col("mean")))
    both = join_groups(current, reference.groupBy("g").agg(F.count("*").alias("refs"), F.max("m").alias("top")), ["g"], how="left")
    below = join_groups(reference, current.select("g", "mean"), ["g"]).groupBy("g").agg(F.count_if(F.col("m") <= F.col("mean")).alias("below"))
    out = join_groups(both, below, ["g"], how="left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    ready = F.col("mean").isNotNull() & (F.col("refs") >= windows)
    share = F.when(ready, 100 * F.col("below") / F.col("refs"))
    level = F.when(share >= 80, "High").when(share >= 40, "Moderate").when(share.isNotNull(), "Low")
    return out.select(F.col("g").alias(group), ready.alias("available"), F.col("n").alias("observations"), "mean", F.col("refs").alias("reference_windows"), share.alias("percentile"), F.when(ready, F.col("mean") > F.col("top")).alias("above_range"), level.alias("level"))
