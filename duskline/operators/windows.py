"""Ranking, running and trailing windows, queues and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskline.operators.aggregates import average_rank, exact_quantiles, join_groups, running_total
from duskline.operators.scans import count_in_ranges, ranks, scan
from duskline.session import cut

#: Rows of a key that are read in one sorted pass.
USUAL_ROWS = 2000


def rank_queue(df: DataFrame, order: list[Column], capacity: int, within: list[str] | None = None) -> DataFrame:
    """``rank`` from 1 in the given total order (in each group of ``within``) and ``repair_day`` = ceil(rank / capacity)."""
    ranked = ranks(df, within or [], order).withColumn("rank", F.col("rank").cast("int"))
    return ranked.withColumn("repair_day", F.ceil(F.col("rank") / capacity).cast("int"))


def group_share(df: DataFrame, by: list[str], order: list[Column], rank: str, total: str) -> DataFrame:
    """``rank`` from 1 of each row in its group and the ``total`` of the group."""
    return join_groups(ranks(df, by, order, rank), df.groupBy(*by).agg(F.count("*").alias(total)), by)


def prior_count(df: DataFrame, key: str, ts: str, days: int, out: str) -> DataFrame:
    """Rows of the same key in the trailing window, strictly earlier by at least a second."""
    timed = _seconds(df, ts)
    probes = timed.select(key, "_s").distinct().withColumn("_low", F.col("_s") - days * 86400).withColumn("_high", F.col("_s"))
    n = count_in_ranges(timed, probes, key, "_s", ["_s"], "_low", "_high", out)
    return join_groups(timed, n, [key, "_s"]).select(*df.columns, out)


def since_previous(df: DataFrame, key: str, ts: str, out: str) -> DataFrame:
    """Seconds since the latest strictly earlier row of the key; null for the first."""
    timed = _seconds(df, ts)
    last = scan(timed.select(key, "_s").distinct(), [key], [F.col("_s")], {"_last": ("max", F.col("_s"))}, before=True)
    return join_groups(timed, last, [key, "_s"]).select(*df.columns, (F.col("_s") - F.col("_last")).alias(out))


def trailing_counts(df: DataFrame, key: str, ts: str, counts: dict[str, int], since: str, most: int = USUAL_ROWS) -> DataFrame:
    """``df`` with ``prior_count`` of each window of days in ``counts`` and with ``since_previous`` as ``since``.

    Keys of at most ``most`` rows are dealt out once and read in one sorted pass, without probes, checkpoints or a join back.
    Keys with more rows, of which there are few, are scanned in ranges.
    """
    crowded = cut(df.groupBy(key).agg(F.count("*").alias("_n")).where(f"_n > {most}").select(key, F.lit(True).alias("_crowded")))
    rest, large = df, None
    if not crowded.isEmpty():
        marked = join_groups(df, F.broadcast(crowded), [key], "left")
        rest, large = marked.where("_crowded is null").drop("_crowded"), marked.where("_crowded").drop("_crowded")
    along = Window.partitionBy(key).orderBy("_s")
    # Rows without a time count nothing and are counted by none.
    inside = {out: F.when(F.col("_s").isNull(), 0).otherwise(F.count("_s").over(along.rangeBetween(-days * 86400, -1))).alias(out) for out, days in counts.items()}
    last = F.max("_s").over(along.rangeBetween(Window.unboundedPreceding, -1))
    out = _seconds(rest, ts).select(*df.columns, *inside.values(), (F.col("_s") - last).alias(since))
    if large is None:
        return out
    for name, days in counts.items():
        large = prior_count(large, key, ts, days, name)
    return out.unionByName(since_previous(large, key, ts, since))


def _seconds(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("_s", F.floor(F.expr(f"timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', {ts})") / 1e6).cast("long"))


def percent_rank_avg(df: DataFrame, col: str, out: str) -> DataFrame:
    """Rank with ties averaged, as a share of the non-null rows."""
    n = df.agg(F.count(col).alias("_n"))
    return average_rank(df, col, "_r").crossJoin(F.broadcast(n)).withColumn(out, F.col("_r") / F.col("_n")).drop("_r", "_n")


def ecdf(reference: DataFrame, new: DataFrame, col: str, out: str) -> DataFrame:
    """Share of the reference values at or below each new value; null in, null out."""
    both = reference.where(F.col(col).isNotNull()).select(F.col(col).alias("_v"), F.lit(1).alias("_c")).unionByName(new.where(F.col(col).isNotNull()).select(F.col(col).alias("_v"), F.lit(0).alias("_c")))
    steps = running_total(both.groupBy("_v").agg(F.sum("_c").alias("_c")), "_v", "_c", "_cum")
    n = reference.agg(F.count(col).alias("_n"))
    shares = steps.crossJoin(F.broadcast(n)).select("_v", (F.col("_cum") / F.col("_n")).alias(out))
    return new.join(shares, F.col(col) == F.col("_v"), "left").drop("_v")


def tier_by_rank(rank: Column, total: Column, high: float = 0.1, medium: float = 0.3) -> Column:
    return F.when(rank <= high * total, "High").when(rank <= medium * total, "Medium").otherwise("Low")


def tier_by_value(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "High").when(score >= medium, "Medium").when(score.isNotNull(), "Low")


def quantile_bin(df: DataFrame, col: str, parts: int, out: str) -> DataFrame:
    """Bin 0..parts-1 with right-closed edges at the exact linear quantiles; null in, null out."""
    edges = exact_quantiles(df, col, [i / parts for i in range(1, parts)]).withColumnRenamed("q", "_e")
    return df.join(F.broadcast(edges), how="left").withColumn(out, F.when(F.col(col).isNotNull(), F.size(F.filter("_e", lambda e: e < F.col(col))))).drop("_e")


def two_way_demean(df: DataFrame, unit: str, period: str, col: str, out: str) -> DataFrame:
    """Value less its unit mean and period mean plus the grand mean (balanced panels). Means are aggregated and joined, so the
    rows of a period need no task of their own."""
    grand = df.agg(F.avg(col).alias("_g"))
    mean = lambda k, n: df.groupBy(F.col(k).alias(f"_k{n}")).agg(F.avg(col).alias(n))
    same = lambda k, n: F.col(k).eqNullSafe(F.col(f"_k{n}"))
    j = df.join(mean(unit, "_u"), same(unit, "_u")).join(mean(period, "_p"), same(period, "_p")).crossJoin(F.broadcast(grand))
    return j.withColumn(out, F.col(col) - F.col("_u") - F.col("_p") + F.col("_g")).drop("_g", "_u", "_p", "_k_u", "_k_p")


def fill_gaps(df: DataFrame, key: str, night: str, most: int) -> DataFrame:
    """The nights of each key and those of closed gaps of at most ``most`` nights between them."""
    nights = df.select(key, night).distinct()
    nxt = F.lead(night).over(Window.partitionBy(key).orderBy(night))
    gap = nights.withColumn("_n", nxt).where((F.col("_n") - F.col(night) > 1) & (F.col("_n") - F.col(night) - 1 <= most))
    return nights.unionByName(gap.select(key, F.explode(F.expr(f"sequence({night} + 1, _n - 1)")).alias(night)))


def fifo_schedule(jobs: DataFrame, capacity: int, t0: str, key: str = "id", ts: str = "arrival", buckets: int | None = None) -> DataFrame:
    """First-in-first-out service of ``capacity`` jobs a day: ``known_day``, ``fifo_rank`` (from 0), ``service_day``.

    A job is known at the first daily decision strictly after its arrival. With rank r and known day d the slot is
    r + max over earlier ranks of (capacity * d - r), and the day is slot div capacity. Ranks and running maxima are taken
    inside ranges of known days, as many as the session has shuffle partitions and at least 64, and carried over as one
    number a range, so no task sees all jobs.
    """
    buckets = buckets or max(64, int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    day = F.greatest(F.floor(F.expr(f"timestampdiff(microsecond, timestamp_ntz '{t0}', {ts})") / 8.64e10).cast("long") + 1, F.lit(0))
    known = jobs.withColumn("known_day", day)
    span = known.agg(F.min("known_day").alias("_a"), F.max("known_day").alias("_z"))
    known = known.crossJoin(F.broadcast(span)).withColumn("_b", F.expr(f"(known_day - _a) * {buckets} div (_z - _a + 1)")).drop("_a", "_z")
    sizes = known.groupBy("_b").agg(F.count("*").alias("_n"))
    first = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_b").orderBy(ts, key)
    ranked = known.join(F.broadcast(first), "_b").withColumn("fifo_rank", F.row_number().over(inside) - 1 + F.col("_first"))
    ranked = ranked.withColumn("_lag", F.lit(capacity) * F.col("known_day") - F.col("fifo_rank"))
    tops = ranked.groupBy("_b").agg(F.max("_lag").alias("_m"))
    carried = tops.select("_b", F.max("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    best = F.greatest(F.max("_lag").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carry"))
    out = ranked.join(F.broadcast(carried), "_b").withColumn("service_day", F.floor((F.col("fifo_rank") + best) / capacity))
    return out.drop("_b", "_first", "_lag", "_carry")
