"""Aggregates with exact semantics, and relational helpers built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskline.functions import text_hash
from duskline.session import cut


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """``n`` and ``share`` of each value."""
    n = df.groupBy(col).agg(F.count("*").alias("n"))
    return n.crossJoin(df.agg(F.count("*").alias("_total"))).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of ``row`` against fixed columns, zero filled, with ``total``."""
    wide = df.groupBy(row).pivot(col, values).count().fillna(0)
    return wide.withColumn("total", reduce(lambda a, b: a + b, [F.col(v) for v in values]))


def modal_value(df: DataFrame, key: str, label: str) -> DataFrame:
    """Most frequent non-null label of each key (ties: alphabetical), with the key's number of labels."""
    n = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("c"))
    return n.groupBy(key).agg(F.min(F.struct(F.negative("c").alias("c"), label)).getField(label).alias("modal"), F.count("*").alias("labels"))


def quantile_higher(df: DataFrame, col: str, q: float) -> DataFrame:
    """One row ``q_value``: the element at index ceil(q * (n - 1)) of the sorted non-null values.

    Values are counted first, so the ordered pass sees each distinct value once, in range-partitioned order.
    """
    v = df.where(F.col(col).isNotNull())
    counts = v.groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c"))
    ranked = running_total(counts, "v", "c", "cum")
    at = v.agg(F.count("*").alias("n")).select(F.ceil(q * (F.col("n") - 1)).cast("long").alias("at"))
    return ranked.crossJoin(at).where("cum > at").agg(F.min("v").alias("q_value"))


def range_number(ends: Column, value: Column, most: int) -> Column:
    """How many of the sorted ``ends`` (an array of at most ``most``) lie below ``value``, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    further = lambda at, step: F.when((at + step <= F.size(ends)) & (F.get(ends, at + step - 1) < value), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), further)


def join_groups(rows: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group's row in ``groups``, null keys being a group as well; one row for all without
    ``by``."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))
    named = groups.withColumnsRenamed({c: f"_of_{c}" for c in by})
    return rows.join(named, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]), how).drop(*[f"_of_{c}" for c in by])


def running_totals(df: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Cumulative sums, ``sums`` mapping new names to columns, by ``order`` (unique in each group of ``by``), without sorting
    everything, or a whole group, in one task.

    Rows fall into ranges of ``order`` at approximate quantiles, as many as the session has shuffle partitions and at least
    64; sums run inside a range, and each range is offset by the totals of the ranges before it, one row a range and group.
    """
    by = by or []
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ends = df.select(F.percentile_approx(F.col(order), F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), max(1000, 20 * buckets)).alias("_e"))
    placed = cut(df.crossJoin(F.broadcast(ends)).withColumn("_b", range_number(F.col("_e"), F.col(order), buckets)).drop("_e"))
    totals = placed.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_b"]], *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_p_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_b").orderBy(order)
    ran = placed.select("*", *[F.sum(c).over(inside).alias(f"_r_{n}") for n, c in sums.items()])
    meet = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_b"]])
    out = ran.join(before if by else F.broadcast(before), meet)
    return out.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_p_{n}")).alias(n) for n in sums])


def running_total(df: DataFrame, order: str, value: str, out: str, buckets: int | None = None) -> DataFrame:
    """Cumulative sum of ``value`` by ``order``, see ``running_totals``."""
    return running_totals(df, order, {out: value}, buckets=buckets)


def exact_quantiles(df: DataFrame, col: str, shares: list[float], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``q``, an array of the exact quantiles with linear interpolation of the non-null values, a row for each group of
    ``by``. Values are counted (or ``weight``, how often each row counts, added up) and cut; ranges of them carry running counts: no
    task holds all distinct values."""
    by = by or []
    times = F.sum(weight) if weight else F.count("*")
    counts = cut(df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(times.cast("long").alias("_c")))
    ran = running_totals(counts, "_v", {"_cum": "_c"}, by)
    size = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    j = join_groups(ran, size, by)
    at = lambda share, edge: edge(share * (F.col("_n") - 1)).cast("long")
    held = lambda place: (F.col("_cum") > place) & (F.col("_cum") - F.col("_c") <= place)
    picks = [F.max(F.when(held(at(s, edge)), F.col("_v"))).alias(f"_{name}{i}") for i, s in enumerate(shares) for name, edge in (("lo", F.floor), ("hi", F.ceil))]
    r = j.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    mixed = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (s * (F.col("_n") - 1) - at(s, F.floor)) for i, s in enumerate(shares)]
    return r.select(*by, F.array(*mixed).alias("q"))


def describe(df: DataFrame, col: str) -> DataFrame:
    """Mean, median, 90th percentile, maximum and share of zeros of a column."""
    one = df.agg(F.avg(col).alias("mean"), F.max(col).alias("max"), F.avg((F.col(col) == 0).cast("double")).alias("zero_share"))
    return one.crossJoin(exact_quantiles(df, col, [0.5, 0.9])).select("mean", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p90"), "max", "zero_share")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def grouped_by_many(df: DataFrame, dims: list[str], metrics: list[Column]) -> DataFrame:
    """The metrics for each one-column grouping, stacked: ``dim``, ``level`` and the metrics; one scan."""
    keys = [F.when(F.grouping(d) == 0, F.lit(d)) for d in dims]
    level = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d).cast("string")) for d in dims])
    grouped = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims])
    return grouped.agg(F.coalesce(*keys).alias("dim"), level.alias("level"), *metrics).drop(*dims)


def min_max(df: DataFrame, col: str, out: str, scale: float = 100.0) -> DataFrame:
    """``out``: the column stretched to 0..scale; a constant column gives 0; nulls stay null."""
    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    value = F.when(F.col(col).isNotNull(), F.when(F.col("_hi") > F.col("_lo"), (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * scale).otherwise(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, value).drop("_lo", "_hi")


def average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """``out``: rank from 1 with ties averaged, over distinct values counted first."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_c"))
    ranks = running_total(counts, "_v", "_c", "_cum").select("_v", (F.col("_cum") - (F.col("_c") - 1) / 2).alias(out))
    return df.join(ranks, F.col(col) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return average_rank(average_rank(both, x, "_rx"), y, "_ry").agg(F.corr("_rx", "_ry").alias("spearman"))


def calendar_counts(df: DataFrame, day: str) -> DataFrame:
    """Rows of every day from the first to the last, zeros kept: ``day``, ``n``."""
    n = df.groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("n"))
    spine = n.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(n, "day", "left").fillna(0)


def validated_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join whose right side must hold each key once; ValueError with a few repeated keys otherwise."""
    repeated = right.groupBy(key).count().where("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"keys repeat on the right side: {[r[key] for r in repeated]}")
    return left.join(right, key, how)


def compare_tables(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of either side with both values, their absolute difference and whether the signs agree."""
    both = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key, "full_outer")
    return both.withColumn("difference", F.abs(F.col("va") - F.col("vb"))).withColumn("same_sign", F.signum("va") == F.signum("vb"))


def explode_nights(df: DataFrame, origin: str, horizon: int, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """One row per night that [start, end) overlaps, as ``night`` counted in days from ``origin``, clipped to 0..horizon-1."""
    us = lambda c: F.expr(f"timestampdiff(microsecond, timestamp_ntz '{origin}', {c})")
    first = F.greatest(F.floor(us(start) / 8.64e10), F.lit(0)).cast("int")
    last = F.least(F.ceil(us(end) / 8.64e10) - 1, F.lit(horizon - 1)).cast("int")
    return df.withColumn("_f", first).withColumn("_l", last).where("_l >= _f").withColumn("night", F.explode(F.sequence("_f", "_l"))).drop("_f", "_l")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash: rows, sum (modulo a prime each) and xor of row hashes that any engine can repeat."""
    h = text_hash(*sorted(df.columns))
    return df.agg(F.count("*").alias("rows"), F.sum(h % 1_000_000_007).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))
